"""Property tests: Spark expressions against Python's own string/number semantics.

Each example batch is evaluated in one Spark job (values are generated by
hypothesis, collected into one small DataFrame).
"""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leadsmith.functions import columns as X

TEXT = st.text(alphabet=st.sampled_from(list("abcXYZ éÉñ'-3_ \t\n.,Ωω")), max_size=16)
NUM = st.one_of(
    st.floats(allow_nan=False, allow_infinity=False, min_value=-1e12, max_value=1e12).map(repr),
    st.integers(min_value=-10**12, max_value=10**12).map(str),
    st.decimals(min_value=-10**6, max_value=10**6, places=2).map(str),
    st.sampled_from(["1e3", " 12.7 ", "5.", ".5", "1_000", "abc", "1,000", "-0.4", "2.5", "3.5"]),
)


def spark_map(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def py_clean_integer(v):
    if v is None or v == "" or v.lower() in ("nan", "none", "null"):
        return ""
    try:
        return str(int(round(float(v.strip()))))
    except ValueError:
        return v.strip()


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_title_case_matches_python(spark, values):
    assert spark_map(spark, X.title_case, values) == [v.title() for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_normalize_matches_python(spark, values):
    expect = ["" if v == "nan" else re.sub(r"\s+", " ", v.strip()) for v in values]
    assert spark_map(spark, X.normalize_text, values) == expect


@settings(max_examples=5, deadline=None)
@given(st.lists(NUM, min_size=1, max_size=40))
def test_clean_integer_matches_python(spark, values):
    assert spark_map(spark, X.clean_integer, values) == [py_clean_integer(v) for v in values]

"""The SQL function surface agrees with the Column functions."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from leadsmith.functions import columns as X
from leadsmith.functions.sql import register_sql_functions
from test_functions import DOMAIN_CASES, INT_CASES, TITLE_CASES

PAIRS = {
    "clean_domain": X.clean_domain,
    "clean_integer": X.clean_integer,
    "normalize_text": X.normalize_text,
    "title_case": X.title_case,
    "personal_rank": X.personal_rank,
    "company_name_from_domain": X.company_name_from_domain,
    "is_hash_like": X.is_hash_like,
}


def test_sql_functions_match_columns(spark):
    register_sql_functions(spark)
    values = [v for v, _ in DOMAIN_CASES + INT_CASES + TITLE_CASES] + ["a@gmail.com", "5d41402abc4b2a76b9719d911017c592"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select(F.col("page_id").cast("int").alias("i"),
                                                                    F.col("url").alias("v"))
    for frame in (df, pages):
        frame.createOrReplaceTempView("sqlfn_input")
        for name, fn in PAIRS.items():
            a = [r[0] for r in spark.sql(f"select {name}(v) from sqlfn_input order by i").collect()]
            b = [r[0] for r in frame.orderBy("i").select(fn(F.col("v"))).collect()]
            assert a == b, name

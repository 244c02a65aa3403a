"""Edge values for the scalar cleaners (expected = Python-string semantics)."""

from pyspark.sql import functions as F

from conftest import one_col
from leadsmith.functions import columns as X


def run(spark, fn, values):
    df = one_col(spark, values)
    rows = df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


DOMAIN_CASES = [
    ("HTTPS://WWW.Foo.com/path?x=1", "foo.com"),
    (" foo.com , bar.com", "foo.com"),
    ("***redacted***,foo.com", ""),
    ("foo.com,***redacted**", "foo.com"),
    ("foo.com [redacted]", "foo.com"),
    ("(redacted)", ""),
    ("nan", ""),
    ("NULL", ""),
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("foo.com!!", "foo.com"),
    ("münchen.dé", "münchen.dé"),
    ("www2.foo.com", "www2.foo.com"),
    ("a.com:sup", "a.com:sup"),
    ("?x", ""),
    ("\tfoo.com\n", "foo.com"),
    ("foo.com, ", "foo.com"),
    ("www.www.x.com", "www.x.com"),
]


def test_clean_domain(spark):
    got = run(spark, X.clean_domain, [v for v, _ in DOMAIN_CASES])
    assert got == [e for _, e in DOMAIN_CASES]


def test_clean_domain_twice_reaches_fixpoint(spark):
    got = run(spark, lambda c: X.clean_domain(X.clean_domain(c)), ["www.www.x.com"])
    assert got == ["x.com"]


INT_CASES = [
    ("50.0", "50"), ("2.5", "2"), ("3.5", "4"), ("-2.5", "-2"), ("1e3", "1000"),
    ("1,000", "1,000"), ("50-100", "50-100"), (" 12.7 ", "13"), ("0.4", "0"), ("-0.4", "0"),
    (".5", "0"), ("5.", "5"), (None, ""), ("null", ""), ("", ""), ("abc", "abc"),
    ("1_000", "1000"), ("inf", "inf"), ("1d", "1d"), ("007", "7"),
]


def test_clean_integer(spark):
    got = run(spark, X.clean_integer, [v for v, _ in INT_CASES])
    assert got == [e for _, e in INT_CASES]


TITLE_CASES = [
    ("o'neil mcDONALD", "O'Neil Mcdonald"), ("3m co", "3M Co"), ("VP-sales", "Vp-Sales"),
    ("it's", "It'S"), ("a1b2c3", "A1B2C3"), ("élodie du pré", "Élodie Du Pré"), ("", ""),
    ("a中b", "A中B"), ("ǆemal", "ǅemal"),
]


def test_title_case(spark):
    got = run(spark, X.title_case, [v for v, _ in TITLE_CASES])
    assert got == [e for _, e in TITLE_CASES]
    assert got == [v.title() for v, _ in TITLE_CASES]


def test_normalize_text(spark):
    got = run(spark, X.normalize_text, ["  a \t b\n\nc ", None, "nan", " nan ", "x 　y"])
    assert got == ["a b c", "", "", "nan", "x y"]


def test_missing_predicates(spark):
    vals = [None, "", "   ", "nan", "NaN", "None", "null", "x", " nan "]
    expect = {
        "m1": [True, True, False, True, True, False, False, False, False],
        "m3": [True, True, True, True, True, True, True, False, False],
        "m4": [True, True, True, True, True, False, False, False, False],
        "m5": [True, True, False, True, True, True, True, False, False],
        "m6": [True, True, True, True, True, True, False, False, False],
        "m8": [True, True, True, True, True, True, True, False, False],
    }
    for name, exp in expect.items():
        assert run(spark, X.MISSING[name], vals) == exp, name


def test_split_multi_emails(spark):
    got = run(spark, lambda c: F.array_join(X.split_multi_emails(c), "|"),
              ["info@x.com:support@x.com:sales@x.com", "a@x.com, b@y.com;;c", " one@x.com ", "n/a", None,
               "two words@x.com"])
    assert got == ["info@x.com|support@x.com|sales@x.com", "a@x.com|b@y.com", "one@x.com", "", "",
                   "two words@x.com"]


def test_personal_rank_and_free(spark):
    got = run(spark, X.personal_rank, ["a@gmail.com", "b@yahoo.fr", "c@live.com", "d@hotmail.de", "e@aol.com",
                                       "f@corp.com", "no-at"])
    assert got == [4, 3, 2, 1, 0, None, None]
    got = run(spark, X.domain_from_email, [" A@B.com ", "a@b@c", "a@"])
    assert got == ["b.com", "b", ""]


def test_company_name_from_domain(spark):
    got = run(spark, X.company_name_from_domain, ["google-cloud.com", "www.acme.io", "corp3.com", "nodot",
                                                  "sub.foo.co.uk", ".com"])
    assert got == ["Google Cloud", "Acme", "Corp3", None, "Sub.foo.co.uk", None]


def test_hash_like(spark):
    got = run(spark, X.is_hash_like, ["5d41402abc4b2a76b9719d911017c592", "short", "abcdefghij0123456789xyz",
                                      "123e4567-e89b-12d3-a456-426614174000", "has space in it here"])
    assert got == [True, False, True, True, False]

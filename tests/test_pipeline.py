"""Golden cases and properties of the standardise -> enrich -> dedup pipeline."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from leadsmith.operators import dedup, enrich as E, standardize as S
from leadsmith.plans.pipeline import clean_leads
from leadsmith.sources import fixtures as FX

SPEC = {"mapped_files": [{"filename": "a.csv", "mapped_headers": {
    "Full Name": {"primary": "name"}, "Work Email": {"primary": "mail", "secondary": "mail2"},
    "Company Domain": {"primary": "site"}, "Company Name": {"primary": "org"}}}]}
COLS = "name string, mail string, mail2 string, site string, org string, extra string, Source string, _row long"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_merge_longest_first_on_tie(spark):
    rows = [("Ann Lee", "ann@x.com", None, "x.com", "ab", None, "f1.csv", 0),
            ("Ann Lee", "ann@x.com", None, "x.com", "xy", "e1", "f2.csv", 1),
            ("Ann Lee", "ann@x.com", None, "x.com", " abc ", None, "f1.csv", 2),
            ("Ann Lee", "ann@x.com", None, "x.com", "abd", "none", "f3.csv", 3)]
    std = S.standardize(frame(spark, rows), SPEC, "people")
    # dedup on standardized values directly (no normalisation) to see the merge rule
    keyed = std.withColumn("_key", F.lit("k"))
    out = dedup.merge_duplicates(keyed).collect()
    assert len(out) == 1
    r = out[0].asDict()
    assert r["Company Name"] == "abc"
    assert r["Source"] == "f1.csv; f2.csv; f3.csv"
    assert r["extra"] == "e1"
    assert r["Phone Number"] == ""


def test_size_one_group_keeps_raw(spark):
    rows = [(None, None, None, None, None, "None", " s.csv ", 5)]
    out = dedup.deduplicate(S.standardize(frame(spark, rows), SPEC, "people"), "people").collect()[0].asDict()
    assert out["_key"] == "unique_5" and out["extra"] == "None" and out["Source"] == " s.csv "


def test_key_omits_missing_parts(spark):
    rows = [("A", "a@x.com", None, None, "", None, "s", 0), ("A", None, None, None, "a@x.com", None, "s", 1)]
    std = E.enrich(S.standardize(frame(spark, rows), SPEC, "people"))
    keys = [r["_key"] for r in dedup.with_key(std, "people").orderBy("_row").collect()]
    assert keys[0] == "a@x.com|a|x"  # company name generated from the work-mail domain


def test_priority_and_unmapped_overwrite(spark):
    rows = [("n", "", "w2@x.com", "s.com", "o", "keep", "a.csv", 0),
            ("n", "nan", "w3@x.com", "s.com", "o", "keep", "a.csv", 1),
            ("n", "   ", "w4@x.com", "s.com", "o", "keep", "a.csv", 2)]
    df = frame(spark, rows).withColumnRenamed("extra", "Phone Number")
    out = S.standardize(df, SPEC, "people").orderBy("_row").collect()
    assert [r["Work Email"] for r in out] == ["w2@x.com", "w3@x.com", "   "]
    assert [r["Phone Number"] for r in out] == ["keep"] * 3
    assert list(S.standardize(df, SPEC, "people").columns)[:3] == ["First Name", "Last Name", "Full Name"]


def test_consolidation_case_insensitive_last_wins(spark):
    df = spark.createDataFrame([("a", "u1", "u2", "s", 0)],
                               "`Company Name` string, `LinkedIn Url` string, `Linkedin Url` string, Source string, _row long")
    out = S.consolidate_variants(df, "company")
    assert "LinkedIn Url" in out.columns  # only the last case variant is consumed
    assert out.collect()[0]["Company LinkedIn"] == "u2"


def test_enrich_golden(spark):
    rows = [("  mary   o'neil ", "MARY@Gmail.com", None, None, None, " m@acme-labs.io", "a.csv", 0)]
    df = frame(spark, rows).withColumnRenamed("extra", "backup email")
    out = E.enrich(S.standardize(df, SPEC, "people")).collect()[0].asDict()
    assert out["backup email"] == ""
    assert out["First Name"] == "Mary" and out["Last Name"] == "O'Neil" and out["Full Name"] == "Mary O'Neil"
    assert out["Personal Email"] == "mary@gmail.com" and out["Work Email"] == "m@acme-labs.io"
    assert out["Company Domain"] == "acme-labs.io" and out["Company Name"] == "Acme Labs"


def test_properties_on_fixture(spark):
    raw = FX.people_raw(spark, SF_SMALL)
    enriched = E.enrich(S.standardize(raw, FX.PEOPLE_SPEC, "people"))
    keyed = dedup.with_key(enriched, "people")
    n_in = raw.count()
    keys = keyed.select("_key").distinct().count()
    out = clean_leads(raw, FX.PEOPLE_SPEC, "people", keep_internal=True)
    assert out.count() == keys
    assert out.agg(F.sum("_n")).first()[0] == n_in


def test_partition_count_independent(spark):
    raw = FX.people_raw(spark, SF_SMALL)
    a = clean_leads(raw, FX.PEOPLE_SPEC, "people")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = clean_leads(raw.repartition(5), FX.PEOPLE_SPEC, "people")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_record_limit_in_key_order(spark):
    raw = FX.people_raw(spark, SF_SMALL)
    top = clean_leads(raw, FX.PEOPLE_SPEC, "people", record_limit=7, keep_internal=True).collect()
    keys = [r["_key"] for r in top]
    assert len(keys) == 7 and keys == sorted(keys)


def test_table_type_rejected(spark):
    import pytest

    raw = FX.people_raw(spark, SF_SMALL)
    with pytest.raises(ValueError):
        clean_leads(raw, FX.PEOPLE_SPEC, "companies")

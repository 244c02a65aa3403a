"""Mapping spec files, one-pass counters, newest logs from few dates."""

import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from leadsmith.operators import dedup, enrich as E, logs as LG, profile as PR, standardize as S
from leadsmith.sources import fixtures as FX

from conftest import SF_MID, SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_spec_file_bare_or_in_an_array(spark, tmp_path):
    want = S.mapping_table(spark, FX.PEOPLE_SPEC).collect()
    for name, spec in (("bare.json", FX.PEOPLE_SPEC), ("array.json", [FX.PEOPLE_SPEC, {"mapped_files": []}])):
        (tmp_path / name).write_text("\n " + json.dumps(spec, indent=2))
        table = S.read_mapping_spec(spark, str(tmp_path / name))
        assert table.collect() == want
        assert S.plan_mappings(table) == S.plan_mappings(FX.PEOPLE_SPEC)


@pytest.mark.parametrize("text, reason", [
    ('{"mapped_files": [', "malformed"), ("[]", "empty"), ("", "empty"), ("{}", "mapped_files"),
    ('{"mapped_files": []}', "mapped_files"), ('{"mapped_files": {"filename": 1}}', "malformed"), ('["x"]', "malformed"),
])
def test_bad_spec_files_fail_by_name(spark, tmp_path, text, reason):
    (tmp_path / "answer.json").write_text(text)
    with pytest.raises((PySparkException, ValueError), match="answer.json") as error:
        S.read_mapping_spec(spark, str(tmp_path / "answer.json")).collect()
    assert reason in str(error.value) or reason == "malformed" and "empty or malformed" in str(error.value)


def test_two_spec_files_fail(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.json").write_text(json.dumps(FX.PEOPLE_SPEC))
    with pytest.raises(ValueError, match="2 files"):
        S.read_mapping_spec(spark, str(tmp_path))


def test_counters_equal_two_passes_and_read_once(spark):
    std = S.standardize(FX.people_raw(spark, SF_MID), FX.PEOPLE_SPEC, "people")
    flagged = E.enrich_with_stats(std)
    got = E.enrich_stats(flagged, "people")
    row, first = got.first(), E.enrich_stats(flagged).first()
    final = dedup.deduplicate(E.enrich(std), "people", normalized=True)
    again = final.agg(F.sum(E.changed_domains(final))).first()[0]
    assert row["domains_cleaned"] == first["domains_cleaned"] + again
    assert {c: row[c] for c in row.asDict() if c != "domains_cleaned"} == {c: first[c] for c in first.asDict() if c != "domains_cleaned"}
    assert plan_of(got).count("customer.parquet") == plan_of(dedup.deduplicate(E.enrich(std), "people")).count("customer.parquet")


def test_counters_of_no_rows(spark):
    std = S.standardize(FX.people_raw(spark, SF_SMALL), FX.PEOPLE_SPEC, "people").where("false")
    assert set(E.enrich_stats(E.enrich_with_stats(std), "people").first()) == {0}


def logs_of(spark, days, per_day):
    start = datetime(2024, 1, 1)
    rows = [(d * per_day + i, start + timedelta(days=d, minutes=i % 7), "j", "error" if i % 3 else "info")
            for d in range(days) for i in range(per_day)]
    return spark.createDataFrame(rows, "log_id bigint, ts timestamp_ntz, job_id string, level string").withColumn(
        "error_type", F.lit("E"))


def test_newest_logs_read_few_dates(spark, tmp_path):
    path = LG.write_logs(logs_of(spark, 30, 20).coalesce(1), str(tmp_path / "events"))
    end = datetime(2024, 1, 28, 0, 3)
    for limit, level, dates in ((5, None, 1), (25, "ERROR", 4), (30, "INFO", 8), (10_000, None, 28)):
        got = LG.newest_logs(spark, path, start=datetime(2024, 1, 1), end=end, level=level, limit=limit)
        want = LG.query_logs(LG.read_logs(spark, path), start=datetime(2024, 1, 1), end=end, level=level, limit=limit)
        assert [r["log_id"] for r in got.collect()] == [r["log_id"] for r in want.collect()]
        since = re.findall(r"date#\d+ >= (\d{4}-\d\d-\d\d)", plan_of(got))
        assert max(since) >= (datetime(2024, 1, 28) - timedelta(days=dates - 1)).date().isoformat()
    assert LG.newest_logs(spark, path, start=datetime(2025, 1, 1), end=datetime(2025, 2, 1)).collect() == []


def test_unwanted_terms_replace_the_list(spark):
    df = spark.createDataFrame([("x", "y", "f.csv", 0)], "zebra string, city string, Source string, _row bigint")
    junk = lambda **k: {r["column_name"] for r in PR.column_profile(df, **k).where("is_junk").collect()}
    assert junk() == set()
    assert junk(unwanted_terms=["ZEB"]) == {"zebra"}
    hits = PR.term_hits(PR.column_profile(df), unwanted_terms=["cit", "zebra"]).collect()
    assert {(r["column_name"], r["term"]) for r in hits} == {("city", "cit"), ("zebra", "zebra")}

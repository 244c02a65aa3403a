"""Golden cases from the documented behaviour (change-log examples)."""

import json

from pyspark.sql import functions as F

from leadsmith.operators import profile as PR
from leadsmith.operators import standardize as S
from leadsmith.operators.payload import number_emails, payloads


def test_multi_email_numbered_columns(spark):
    rec = spark.createDataFrame(
        [(1, "Steeped Coffee", "steepedcoffee.com",
          "info@steepedcoffee.com:support@steepedcoffee.com:sales@steepedcoffee.com", "Food & Drink"),
         (2, "Example Co", "example.com", "contact@example.com", "Technology")],
        "record_number long, `Company Name` string, `Company Domain` string, emails string, `Company Industry` string")
    out = {r["record_number"]: json.loads(r["payload"])
           for r in payloads(number_emails(rec), "company", 0).collect()}
    first = out[1]
    assert [k for k in first if k.startswith("Company Email")] == ["Company Email 1", "Company Email 2",
                                                                    "Company Email 3"]
    assert first["Company Email 2"] == "support@steepedcoffee.com"
    assert first["additional_fields"] == {"emails": "info@steepedcoffee.com:support@steepedcoffee.com:"
                                                    "sales@steepedcoffee.com"}
    assert first["_metadata"]["total_additional_fields"] == 1
    # one address is still numbered; a record has the keys of its own addresses only
    assert out[2]["Company Email 1"] == "contact@example.com" and "Company Email 2" not in out[2]


def test_linkedin_variant_lands_in_person(spark):
    spec = {"mapped_files": [{"filename": "a.csv", "mapped_headers": {"Full Name": {"primary": "name"}}}]}
    df = spark.createDataFrame([("Ann Lee", "https://linkedin.com/in/ann", "a.csv", 0)],
                               "name string, `Linkedin profile` string, Source string, _row long")
    std = S.standardize(df, spec, "people")
    assert "Linkedin profile" not in std.columns
    p = json.loads(payloads(std.withColumn("record_number", F.lit(1)), "people", 0).first()["payload"])
    assert p["person"]["LinkedIn Profile"] == "https://linkedin.com/in/ann"
    assert p["additional_fields"] == {}


def test_mapped_source_columns_do_not_reappear(spark):
    spec = {"mapped_files": [{"filename": "a.csv", "mapped_headers": {
        "First Name": {"primary": "first_name"}, "Last Name": {"primary": "last_name"},
        "Job Title": {"primary": "current_title"}}}]}
    df = spark.createDataFrame([("Abigail", "Swanson", "Marketing Director", "x", "a.csv", 0)],
                               "first_name string, last_name string, current_title string, other string, "
                               "Source string, _row long")
    std = S.standardize(df, spec, "people")
    p = json.loads(payloads(std.withColumn("record_number", F.lit(1)), "people", 0).first()["payload"])
    assert p["person"]["First Name"] == "Abigail" and p["person"]["Job Title"] == "Marketing Director"
    assert p["additional_fields"] == {"other": "x"}


def test_empty_social_column_survives_junk_filter(spark):
    df = spark.createDataFrame([("Acme", "", "true", "a.csv", 0), ("Beta", "linkedin.com/company/b", "false", "a.csv", 1)],
                               "company string, linkedin_url string, is_flag string, Source string, _row long")
    prof = {r["column_name"]: r.asDict() for r in PR.column_profile(df).collect()}
    assert not prof["linkedin_url"]["is_junk"] and prof["linkedin_url"]["kept"]
    assert prof["linkedin_url"]["sample_value"] == "linkedin.com/company/b"
    assert prof["is_flag"]["is_junk"]  # boolean-like sample without an important term

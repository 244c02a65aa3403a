"""CSV source/sink round trip, scripted delivery, streaming twins, log helpers."""

import json
import os
import random
import re
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from leadsmith.operators import logs as LG
from leadsmith.operators import profile as PR
from leadsmith.operators.delivery import deliver, failure_log
from leadsmith.operators.payload import number_emails, payloads
from leadsmith.sources import csv_scan as CS
from leadsmith.sources import fixtures as FX
from leadsmith.sources.fixtures import rule_transport, scripted_transport


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_csv_edge_cases(spark):
    d = tempfile.mkdtemp(prefix="leadsmith-csv-")
    _write(os.path.join(d, "a.csv"),
           'name,dup,dup,LinkedIn Url,Linkedin Url,e.mail,zip\n'
           '"Smith, ""Jo""",1,2,u1,u2,x@y.com,007\n'
           '\n'
           '"multi\nline",3,4,,u4,NA,\n')
    _write(os.path.join(d, "b.csv"), "e.mail,name,Source\nz@y.com,Bob,orig\n")
    _write(os.path.join(d, "notes.txt"), "ignored\n")
    df = CS.read_csv_files(spark, [d])
    assert df.columns == ["name", "dup", "dup.1", "LinkedIn Url", "Linkedin Url", "e.mail", "zip", "Source", "_row"]
    rows = [r.asDict() for r in df.orderBy("_row").collect()]
    assert [r["_row"] >> 33 for r in rows] == [0, 0, 1]
    assert rows[0]["name"] == 'Smith, "Jo"' and rows[0]["zip"] == "007" and rows[0]["dup.1"] == "2"
    assert rows[0]["Linkedin Url"] == "u2" and rows[0]["Source"] == "a.csv"
    assert rows[1]["name"] == "multi\nline" and rows[1]["e.mail"] is None and rows[1]["LinkedIn Url"] is None
    assert rows[2]["name"] == "Bob" and rows[2]["Source"] == "b.csv" and rows[2]["dup"] is None
    stats = CS.merge_stats(df).first()
    assert (stats["files_processed"], stats["total_records"], stats["total_columns"]) == (2, 3, 7)
    out = os.path.join(tempfile.mkdtemp(prefix="leadsmith-out-"), "processed")
    CS.write_csv(df, out)
    back = CS.read_csv_files(spark, [out])
    assert back.count() == 3
    assert "Linkedin Url" in back.columns


def test_csv_requires_files(spark):
    with pytest.raises(ValueError):
        CS.read_csv_files(spark, [])


def test_record_longer_than_its_header_fails_with_the_file(spark):
    d = tempfile.mkdtemp(prefix="leadsmith-ragged-")
    _write(os.path.join(d, "good.csv"), "name,mail\nann,a@x.io\n")
    _write(os.path.join(d, "ragged.csv"), "name,mail\nann\nbob,b@x.io,EXTRA,MORE\n")
    with pytest.raises(Exception, match="more cells than the header of .*ragged.csv"):
        CS.read_csv_files(spark, [d]).collect()


def test_short_records_are_filled(spark):
    d = tempfile.mkdtemp(prefix="leadsmith-short-")
    _write(os.path.join(d, "a.csv"), "name,mail\nann\n")
    assert [tuple(r)[:2] for r in CS.read_csv_files(spark, [d]).collect()] == [("ann", None)]


def test_empty_file_fails_with_its_name(spark):
    d = tempfile.mkdtemp(prefix="leadsmith-empty-")
    _write(os.path.join(d, "a.csv"), "x\n1\n")
    _write(os.path.join(d, "none.csv"), "")
    with pytest.raises(ValueError, match="none.csv"):
        CS.read_csv_files(spark, [d])


def test_files_with_marks_in_their_names_keep_their_rows(spark, tmp_path):
    names = sorted(["crm a.csv", "#1%.csv", "a+b.csv", "50%25.csv", "plain.csv", "\u00fcber \u00e4.csv", "x&y=z;.csv"])
    folder = tmp_path / "in #1 of 100%"
    folder.mkdir()
    for n in names:
        _write(folder / n, f"name,mail\n{n},{n}@x.io\n")
    rows = CS.read_csv_files(spark, [str(folder)]).orderBy("_row").collect()
    assert [(r["name"], r["Source"], r["_row"] >> 33) for r in rows] == [(n, n, k) for k, n in enumerate(names)]
    counts = {r["file"]: r["records"] for r in CS.count_records(spark, [str(folder)]).collect()}
    assert counts == {n: 1 for n in names} | {"TOTAL": len(names)}


def test_row_without_an_ordinal_fails(spark, tmp_path, monkeypatch):
    _write(tmp_path / "a.csv", "name\nann\n")
    monkeypatch.setattr(CS, "file_path", lambda: F.lit("elsewhere.csv"))
    with pytest.raises(Exception, match="no file of the listing is named elsewhere.csv"):
        CS.read_csv_files(spark, [str(tmp_path)]).collect()


def test_blank_headers_and_blanks_are_kept(spark):
    d = tempfile.mkdtemp(prefix="leadsmith-blank-")
    _write(os.path.join(d, "a.csv"), ",name,\n0,'  lead ',x\n".replace("'", ""))
    df = CS.read_csv_files(spark, [d])
    assert df.columns[:3] == ["Unnamed: 0", "name", "Unnamed: 2"]
    out = os.path.join(tempfile.mkdtemp(prefix="leadsmith-blank-out-"), "people.csv")
    CS.write_csv(df, out, single_file=True)
    assert os.path.isfile(out) and "0,  lead ,x" in open(out, encoding="utf-8").read()


def test_export_name():
    assert CS.export_name("people", datetime(2024, 3, 5, 7, 9)) == "people_leads_processed_2024-03-05_07-09.csv"


def test_throttled_rate_is_shared_by_the_senders(spark):
    """429s on 4 senders: together they fall to 5 requests a second, not each of them."""
    pay = spark.range(1, 201).select(F.col("id").alias("record_number"), F.lit("{}").alias("payload"))
    folder = tempfile.mkdtemp(prefix="leadsmith-rate-")

    def note(seconds):
        from pyspark import TaskContext

        with open(os.path.join(folder, str(TaskContext.get().partitionId())), "a") as fh:
            fh.write(f"{seconds}\n")

    transport = scripted_transport({}, default=429)
    res = deliver(pay, "job", transport, rate=10, partitions=4, sleep=note).collect()
    assert len({r["record_number"] for r in res}) == 200 and any(r["throttled"] for r in res)
    pauses = {f: [float(x) for x in open(os.path.join(folder, f))] for f in os.listdir(folder)}
    last = [1 / p[-1] for p in pauses.values()]  # the pause behind the last record is 1 / rate
    assert len(last) == 4 and sum(last) == pytest.approx(5)


def test_exceptions_are_logged_with_their_type(spark, tmp_path):
    def broken():
        def send(payload, rn, attempt):
            raise ConnectionError("no route")
        return send

    pay = spark.createDataFrame([(1, "{}")], "record_number long, payload string")
    res = deliver(pay, "job", broken, rate=10, partitions=1, sleep=lambda s: None, clock=lambda: 1706659200.5)
    log = failure_log(res, url="u")
    row = log.first()
    assert row["message"] == "Webhook exception for record 1 after 3 attempts: no route"
    assert json.loads(row["metadata"]) == {"exception_type": "ConnectionError", "exception_message": "no route", "webhook_url": "u"}
    path = str(tmp_path / "store")
    LG.write_logs(log, path)
    found = LG.query_logs(LG.read_logs(spark, path), start=datetime(2024, 1, 31), end=datetime(2024, 2, 1), level="error").collect()
    assert [(r["log_id"], str(r["ts"])) for r in found] == [(1, "2024-01-31 00:00:00.500000")]


def test_one_job_with_all_events_is_split(spark, monkeypatch):
    """Per-job values on one hot job, in small blocks, equal those of a plain pass; no window takes a job whole."""
    monkeypatch.setattr(LG, "BLOCK", 16)
    rng = random.Random(2)
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), "hot", rng.choice([200, 429, 429, 429, 500]), rng.randrange(100) / 100)
            for i in range(400)]
    logs = spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, job_id string, status_code int, duration double")
    seq = LG.with_job_sequence(logs)
    assert [(r["log_id"], r["seq"], r["total"]) for r in seq.orderBy("log_id").collect()] == [(i, i + 1, 400) for i in range(400)]
    eta = {r["seq"]: r["eta_seconds"] for r in LG.delivery_eta(seq).collect()}
    for k in (1, 2, 3, 10, 16, 17, 100, 399, 400):
        last = [r[4] for r in rows[max(0, k - 10):k]]
        want = (400 - k) * sum(last) / len(last) if k >= 3 else (400 - k) / 10
        assert eta[k] == pytest.approx(want)
    count = 0
    for r in rows:
        count = 0 if r[3] == 200 else count + (r[3] == 429)
        if count >= 3:
            break
    assert LG.throttle_events(logs).first()["first_throttled_log_id"] == r[0]
    plan = LG.throttle_events(logs)._jdf.queryExecution().executedPlan().toString()
    rows_windows = [w for w in re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan) if "__block" not in w and "__hour" not in w]
    assert all("__n" in line or "__total" in line for line in re.findall(r"Window \[[^\n]*\], \[job_id#\d+\][^\n]*", plan)), rows_windows


def test_stuck_counts_repeats_only(spark):
    def polls(n):
        return [("j", datetime(2024, 1, 1) + timedelta(seconds=20 * i), i, i + 1, 50) for i in range(n)]

    for n, want in ((11, 0), (12, 1)):  # the first sighting is no repeat: 11 repeats are more than 10
        df = spark.createDataFrame(polls(n), "job_id string, ts timestamp_ntz, log_id long, seq long, progress long")
        assert LG.stuck_jobs(df).count() == want


def test_first_alias_match_wins(spark):
    df = spark.createDataFrame([("Ann", "linkedin.com/in/ann", "a@x.io", "f.csv", 0)],
                               "full_name string, linkedin string, email string, Source string, _row long")
    found = {(r["column_name"], r["std"]) for r in PR.alias_matches(PR.column_profile(df), "people").collect()}
    assert ("linkedin", "LinkedIn Profile") in found and len(found) == 3


def test_profile_is_per_file_and_looks_at_all_rows(spark):
    rows = [(None, "x", "a.csv", i) for i in range(150)] + [("late", "x", "a.csv", 150), (None, None, "b.csv", 1 << 33)]
    df = spark.createDataFrame(rows, "sparse string, name string, Source string, _row long")
    prof = PR.column_profile(df, headers=[(["sparse", "name"], ["a.csv"]), (["name"], ["b.csv"])])
    got = {(r["Source"], r["column_name"]): r["is_empty"] for r in prof.collect()}
    assert got == {("a.csv", "sparse"): False, ("a.csv", "name"): False, ("b.csv", "name"): True}


def test_replayed_stream_batch_sends_nothing(spark, tmp_path):
    from leadsmith.streaming.twins import stream_delivery

    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    schema = "record_number long, payload string"
    spark.createDataFrame([(i, "{}") for i in range(5)], schema).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    first = stream_delivery(spark, stream(), "j", rule_transport(0, 0), 1000.0, lambda s: None, state).count()
    spark.createDataFrame([(i, "{}") for i in range(3, 8)], schema).write.mode("append").parquet(src)
    again = stream_delivery(spark, stream(), "j", rule_transport(0, 0), 1000.0, lambda s: None, state)
    assert first == 5 and sorted(r["record_number"] for r in again.collect()) == list(range(8))


def test_numbered_company_emails(spark):
    df = spark.createDataFrame([("info@x.com:support@x.com:sales@x.com", "info@x.com"), ("n/a", None)],
                               "emails string, `Other Email` string")
    out = number_emails(df).collect()
    assert out[0]["__emails"] == ["info@x.com", "support@x.com", "sales@x.com"] and out[1]["__emails"] == []


def test_payload_shapes(spark):
    df = spark.createDataFrame([(1, "Acme", "acme.com", "a.csv", "v", "", "w@acme.com")],
                               "record_number long, `Company Name` string, `Company Domain` string, Source string, "
                               "`Linked In Page` string, empty string, `Work Email` string")
    from leadsmith.functions.constants import PAYLOAD_SOURCE_LABEL

    comp = payloads(df, "company", 10).first()["payload"]
    assert comp == ('{"Company Name":"Acme","Company Domain":"acme.com","Source":"a.csv",'
                    '"additional_fields":{"LinkedIn Page":"v"},"_metadata":{"record_number":1,"timestamp":10,'
                    f'"source":"{PAYLOAD_SOURCE_LABEL}","total_additional_fields":1}}}}')
    ppl = payloads(df, "people", 10).first()["payload"]
    assert ppl.startswith('{"person":{"Work Email":"w@acme.com"},"company":{"Company Name":"Acme"')


def test_scripted_delivery(spark):
    pay = spark.createDataFrame([(i, f'{{"n":{i}}}') for i in range(1, 6)], "record_number long, payload string")
    codes = {2: [500], 3: [429, 200], 4: [429, 429, 429], 5: [200]}
    res = deliver(pay, "job", scripted_transport(codes), rate=10, partitions=1, sleep=lambda s: None)
    rows = {r["record_number"]: r.asDict() for r in res.collect()}
    assert rows[1]["ok"] and rows[1]["attempts"] == 1
    assert not rows[2]["ok"] and rows[2]["attempts"] == 3 and rows[2]["error_type"] == "HTTP_500"
    assert rows[3]["ok"] and rows[3]["attempts"] == 2
    assert not rows[4]["ok"] and rows[4]["error_type"] == "HTTP_429" and rows[4]["throttled"]
    assert not rows[3]["throttled"]
    log = failure_log(res, url="u", ts=datetime(2024, 1, 1)).collect()
    assert [r["record_number"] for r in log] == [2]
    assert log[0]["message"] == "Webhook failed for record 2 after 3 attempts: HTTP 500"


def test_relative_time_bounds():
    now = datetime(2024, 1, 31, 13, 30)
    assert LG.resolve_start("today", now) == datetime(2024, 1, 31)
    assert LG.resolve_start("yesterday", now) == datetime(2024, 1, 30)
    assert LG.resolve_start("2d", now) == datetime(2024, 1, 29, 13, 30)
    assert LG.resolve_start("24h", now) == datetime(2024, 1, 30, 13, 30)
    assert LG.resolve_start(None, now) == datetime(2024, 1, 24, 13, 30)
    assert LG.resolve_start("2024-01-20T12:00:00Z", now) == datetime(2024, 1, 20, 12)


def test_global_index(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("k"))
    out = LG.global_index(df, ["k"]).collect()
    assert sorted((r["k"], r["record_number"]) for r in out) == [(k, k + 1) for k in range(1000)]


def test_stream_errors_equal_batch(spark):
    from leadsmith.streaming.twins import stream_error_counts

    s = stream_error_counts(spark, f"{SF_SMALL}/events.parquet", FX.logs_frame)
    b = LG.daily_errors(FX.logs(spark, SF_SMALL))
    key = lambda r: (str(r["day"]), r["error_type"], r["n"])
    assert sorted(map(key, s.collect())) == sorted(map(key, b.collect()))


def test_stream_dedup_unique(spark):
    from leadsmith.streaming.twins import stream_dedup_events

    s = stream_dedup_events(spark, f"{SF_SMALL}/events.parquet", FX.logs_frame)
    assert s.count() == s.select("log_id").distinct().count() == FX.logs(spark, SF_SMALL).count()


def test_retry_schedule_without_spark():
    import random

    from leadsmith.operators.delivery import _Sender

    sleeps = []
    send = scripted_transport({1: [500], 2: [429, 429, 429], 3: [503, 200]})()
    s = _Sender(send, 10.0, 3, sleeps.append, random.Random(1))
    assert s.send("{}", 1)[:4] == (False, 500, 3, "HTTP_500")
    assert len(sleeps) == 2 and 0.8 <= sleeps[0] <= 1.2 and 1.6 <= sleeps[1] <= 2.4  # none after the last
    sleeps.clear()
    assert s.send("{}", 2)[:4] == (False, 429, 3, "HTTP_429")
    assert sleeps == [0.5, 0.5] and s.throttled and s.rate == 5
    sleeps.clear()
    assert s.send("{}", 3)[:3] == (True, 200, 2) and s.n429 == 0 and s.throttled


def test_deliver_job_status(spark):
    from leadsmith.plans.pipeline import deliver_job

    results, flog, status = deliver_job(FX.company_raw(spark, SF_SMALL), FX.COMPANY_SPEC, "company", "j",
                                        rule_transport(fail_every=5, throttle_every=0), rate=1000.0,
                                        partitions=2, timestamp=0, sleep=lambda s: None)
    n = results.count()
    st = status.orderBy("record_number").collect()
    assert [r["webhooks_sent"] for r in st] == list(range(1, n + 1))
    assert st[-1]["progress"] == 100 and st[-1]["estimated_seconds_remaining"] == 0
    assert sorted(r["record_number"] for r in flog.collect()) == [k for k in range(1, n + 1) if k % 5 == 0]


def test_log_store_partition_pruning(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="leadsmith-logs-"), "logs")
    LG.write_logs(FX.logs(spark, SF_SMALL).withColumn("level", F.lower("level")), out)
    store = LG.read_logs(spark, out)
    q = LG.query_logs(store, start=datetime(2024, 1, 24), end=datetime(2024, 1, 31), level="error",
                      limit=None)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "date" in plan
    direct = LG.query_logs(FX.logs(spark, SF_SMALL), start=datetime(2024, 1, 24), end=datetime(2024, 1, 31),
                           level="ERROR", limit=None)
    assert sorted(r["log_id"] for r in q.collect()) == sorted(r["log_id"] for r in direct.collect())


def test_count_records_per_file(spark):
    d = tempfile.mkdtemp(prefix="leadsmith-count-")
    _write(os.path.join(d, "a.csv"), "x,y\n1,2\n\n3,4\n")
    _write(os.path.join(d, "b.csv"), "y\n5\n")
    got = {r["file"]: r["records"] for r in CS.count_records(spark, [d]).collect()}
    assert got == {"a.csv": 2, "b.csv": 1, "TOTAL": 3}


def test_process_files_end_to_end(spark):
    from leadsmith.plans.pipeline import process_files

    d = tempfile.mkdtemp(prefix="leadsmith-e2e-")
    _write(os.path.join(d, "a.csv"), "full_name,Email,Company,website,avatar_url\n"
                                     "ann lee,ANN@acme.io,,https://www.acme.io/x,http://img\n"
                                     "bob ray,bob@gmail.com,Beta,beta.com,\n")
    _write(os.path.join(d, "b.csv"), "Email,full_name,phone\nann@acme.io,Ann  Lee,555\n")
    out = tempfile.mkdtemp(prefix="leadsmith-e2e-out-")
    res = process_files(spark, [d], "people", out, job_id="t1")
    mapped = res["spec"]["mapped_files"]
    assert {m["filename"] for m in mapped} == {"a.csv", "b.csv"}
    a = next(m for m in mapped if m["filename"] == "a.csv")["mapped_headers"]
    assert a["Full Name"]["primary"] == "full_name" and a["Work Email"]["primary"] == "Email"
    assert "avatar_url" not in {v["primary"] for v in a.values()}
    # plain read: the CSV scan would (by design) overwrite Source with the part-file name
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(res["path"])
    rows = {r["Full Name"]: r.asDict() for r in back.collect()}
    assert res["records"] == 2 and set(rows) == {"Ann Lee", "Bob Ray"}
    ann = rows["Ann Lee"]
    assert ann["Work Email"] == "ann@acme.io" and ann["Company Domain"] == "acme.io"
    assert ann["Company Name"] == "Acme" and ann["Source"] == "a.csv; b.csv" and ann["Phone Number"] == "555"
    assert rows["Bob Ray"]["Personal Email"] == "bob@gmail.com" and rows["Bob Ray"]["Work Email"] is None


def _ingested(spark, folder, pattern, headers, state, spec):
    from leadsmith.streaming.twins import read_stream_result, stream_clean_csv

    path, cols = stream_clean_csv(spark, [(f"{folder}/{pattern}", headers)], spec, "people", state)
    return read_stream_result(spark, path, cols)


def test_stream_numbers_rows_of_all_files_of_a_batch(spark, tmp_path):
    """Several files in one micro-batch, records without any key part, and a batch that comes later."""
    from leadsmith.plans.pipeline import clean_leads

    folder = tmp_path / "in"
    folder.mkdir()
    body = [f"note {k}{'x' * (k % 3)}" for k in range(8)]
    for k in range(4):
        _write(folder / f"f{k}.csv", "remark,phone\n" + "".join(f"{b},{k}{i}\n" for i, b in enumerate(body[2 * k : 2 * k + 2])))
    state = str(tmp_path / "state")
    headers = ["remark", "phone"]
    spec = {"mapped_files": [{"filename": "f0.csv", "mapped_headers": {"Work Email": {"primary": "mail"}}}]}
    got = _ingested(spark, folder, "*.csv", headers, state, spec).collect()
    assert sorted(r["remark"] for r in got) == body and len({r["_row"] for r in got}) == 8
    batch = clean_leads(CS.read_csv_files(spark, [str(folder)]), spec, "people", keep_internal=True).collect()
    assert {r["_row"]: (r["remark"], r["Source"]) for r in got} == {r["_row"]: (r["remark"], r["Source"]) for r in batch}
    for k in (4, 5):
        _write(folder / f"f{k}.csv", f"remark,phone\nlate {k},9\n")
    got = _ingested(spark, folder, "*.csv", headers, state, spec).collect()
    assert sorted(r["remark"] for r in got) == ["late 4", "late 5", *body] and len({r["_row"] for r in got}) == 10
    assert [r["_row"] >> 33 for r in sorted(got, key=lambda r: r["_row"])] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 5]


def test_stream_merges_files_of_a_batch_as_the_batch_reader_does(spark, tmp_path):
    from leadsmith.plans.pipeline import clean_leads

    spec = {"mapped_files": [{"filename": f"f {k}.csv", "mapped_headers": {"Work Email": {"primary": "mail"}}} for k in range(3)]}
    for k in range(3):  # the largest file comes last by name
        _write(tmp_path / f"f {k}.csv", "mail,remark\n" + f"a@acme.io,note {k}\nb{k}@acme.io,x\n" * (k + 1))
    state = tempfile.mkdtemp(prefix="leadsmith-stream-")
    got = _ingested(spark, tmp_path, "*.csv", ["mail", "remark"], state, spec)
    want = clean_leads(CS.read_csv_files(spark, [str(tmp_path)]), spec, "people", keep_internal=True)
    cols = [c for c in want.columns if c in got.columns]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect())) and len(cols) > 20


def test_stream_record_longer_than_its_header_fails_with_the_file(spark, tmp_path):
    spec = {"mapped_files": [{"filename": "a.csv", "mapped_headers": {"Work Email": {"primary": "mail"}}}]}
    _write(tmp_path / "a.csv", "mail,remark\na@x.io,one,\nb@x.io\n")
    _write(tmp_path / "ragged.csv", "mail,remark\nc@x.io,two,EXTRA,MORE\n")
    with pytest.raises(Exception, match="more cells than the header of .*ragged.csv"):
        _ingested(spark, tmp_path, "*.csv", ["mail", "remark"], str(tmp_path / "state"), spec).collect()
    assert _ingested(spark, tmp_path, "a.csv", ["mail", "remark"], str(tmp_path / "other"), spec).count() == 2


def test_one_file_is_written_by_many_tasks(spark, tmp_path):
    """Rows of all partitions stand in one file in their order, under one header; each partition is a task of its own."""
    def tagged(batches):
        from pyspark import TaskContext

        for pdf in batches:
            yield pdf.assign(note='say "hi",\n' + pdf["n o"].astype(str), task=TaskContext.get().taskAttemptId())

    rows = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "n o").mapInPandas(tagged, "`n o` long, note string, task long")
    out = str(tmp_path / "an export.csv")
    for _ in range(2):  # the second write takes the place of the first
        assert CS.write_csv(rows, out, single_file=True) == out
        back = spark.read.options(header="true", multiLine="true", escape='"').csv(out)
        assert back.columns == ["n o", "note", "task"]
        found = back.collect()
        assert [tuple(r)[:2] for r in found] == [(str(k), f'say "hi",\n{k}') for k in range(1000)]
        assert len({r["task"] for r in found}) == 7
    assert open(out, encoding="utf-8").read().count("n o,note") == 1
    assert [f for f in os.listdir(tmp_path) if f[0] != "."] == ["an export.csv"]
    CS.write_csv(rows.where("false"), out, single_file=True)
    assert open(out, encoding="utf-8").read() == "n o,note,task\n"


def test_joined_files_go_to_their_places(spark, tmp_path, monkeypatch):
    parts = []
    for k, text in enumerate(["head\n", "", "x" * 3_000_000, "end"]):
        (tmp_path / f"part {k}").write_text(text)
        parts.append((f"file:{tmp_path}/part {k}", len(text)))
    for scheme in ("file:", ""):  # without a scheme as a store that writes from start to end
        target = tmp_path / f"joined {scheme[:4]}"
        if not scheme:
            import pyarrow.fs as pafs

            monkeypatch.setattr(CS, "file_system", lambda p: (pafs.LocalFileSystem(), p))
        CS.join_files(spark, parts, f"{scheme}{target}")
        assert target.read_text() == "head\n" + "x" * 3_000_000 + "end"
    with pytest.raises(Exception, match="part 3 has 3 bytes, 4 were listed"):
        CS.join_files(spark, [*parts[:3], (parts[3][0], 4)], f"file:{tmp_path}/short")


def test_stream_reads_large_files_by_ranges(spark, tmp_path, monkeypatch):
    """A large file of a micro-batch is many tasks, line breaks in cells included; its rows are those of the batch reader."""
    from leadsmith.plans.pipeline import clean_leads

    spec = {"mapped_files": [{"filename": "a.csv", "mapped_headers": {"Work Email": {"primary": "mail"}}}]}
    folder = tmp_path / "in"
    folder.mkdir()
    for name, n in (("a.csv", 60), ("b [1] x+y.csv", 1)):
        _write(folder / name, "mail,remark\n" + "".join(f'k{k}@acme.io,"note\n{k}, {name}"\n,x{k}\n' for k in range(n)))
    want = clean_leads(CS.read_csv_files(spark, [str(folder / "a.csv")]), spec, "people", keep_internal=True)
    seen = []
    split_records = CS.split_records
    monkeypatch.setattr(CS, "split_records", lambda states: seen.append(states.count()) or split_records(states))
    monkeypatch.setattr(CS.read_listed_files, "__defaults__", (*CS.read_listed_files.__defaults__[:-1], 200))
    got = _ingested(spark, folder, "a.csv", ["mail", "remark"], str(tmp_path / "state"), spec)
    cols = [c for c in want.columns if c in got.columns and c not in ("_row", "_key")]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect())) and got.count() == 120
    assert len(seen) == 1 and seen[0] > 10
    both = _ingested(spark, folder, "*.csv", ["mail", "remark"], str(tmp_path / "both"), spec)
    assert both.count() == 121 and len({r["_row"] for r in both.collect()}) == 121

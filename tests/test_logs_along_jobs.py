"""Values along jobs (W2, W3, W6, W7), folded by hours, against one plain pass over each job."""

import random
from datetime import datetime, timedelta

import pytest

from leadsmith.operators import logs as LG

START = datetime(2024, 1, 1)


def events(seed, n, step):
    """Several jobs, many events of one time, some hours without events, long quiet runs."""
    rng = random.Random(seed)
    rows, at = [], {j: START for j in "abcde"}
    progress = dict.fromkeys(at, 0)
    for i in range(n):
        j = rng.choice("aaaaaabbcde")
        at[j] += timedelta(seconds=rng.choice([0, 0, 1, 7, 60, step]))
        if rng.random() < 0.08:
            progress[j] = rng.choice([None, 100, 10, 20, 30])
        rows.append((i, at[j], j, rng.choice([200, 429, 429, 500]) if rng.random() < 0.3 else rng.choice([429, 500, 500]), rng.randrange(900) / 100, progress[j]))
    return rows


def by_job(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        found.setdefault(r[2], []).append(r)
    return found


def frame(spark, rows):
    return spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, job_id string, status_code int, duration double, progress long").repartition(4)


@pytest.mark.parametrize("seed,step,after", [(1, 900, 3), (2, 5000, 3), (3, 40_000, 4), (4, 20, 1)])
def test_throttle_events(spark, seed, step, after):
    rows = events(seed, 500, step)
    want = {}
    for job, mine in by_job(rows).items():
        count = 0
        for r in mine:
            count = 0 if r[3] == 200 else count + (r[3] == 429)
            if count >= after:
                want[job] = (r[0], r[1])
                break
    found = {r["job_id"]: (r["first_throttled_log_id"], r["throttled_at"]) for r in LG.throttle_events(frame(spark, rows), after).collect()}
    assert found == want


def test_throttle_carries_over_hours_without_429s(spark):
    codes = [429, 500, 429, 500, 500, 429]
    rows = [(i, START + timedelta(hours=3 * i), "j", c, 0.0, 0) for i, c in enumerate(codes)]
    assert [r["first_throttled_log_id"] for r in LG.throttle_events(frame(spark, rows)).collect()] == [5]
    assert LG.throttle_events(frame(spark, rows[:5])).count() == 0


@pytest.mark.parametrize("seed,step,polls", [(1, 900, 4), (2, 5000, 2), (3, 40_000, 10), (4, 20, 3)])
def test_stuck_jobs(spark, seed, step, polls):
    rows = events(seed, 500, step)
    want = []
    for job, mine in by_job(rows).items():
        runs = []
        for r in mine:
            if runs and r[5] is not None and runs[-1][-1][5] == r[5]:
                runs[-1].append(r)
            else:
                runs.append([r])
        for run in runs:
            secs = int(run[-1][1].timestamp() // 1 - run[0][1].timestamp() // 1)
            if run[0][5] is not None and run[0][5] < 100 and len(run) - 1 > polls and secs > 120:
                want.append((job, run[0][5], len(run) - 1, secs, "alert" if secs > 300 else "warn"))
    assert sorted(map(tuple, LG.stuck_jobs(frame(spark, rows), polls).collect())) == sorted(want)


def test_eta_over_block_ends(spark, monkeypatch):
    monkeypatch.setattr(LG, "BLOCK", 12)
    rows = events(5, 300, 900)
    found = {r["log_id"]: (r["seq"], r["eta_seconds"]) for r in LG.delivery_eta(LG.with_job_sequence(frame(spark, rows))).collect()}
    assert len(found) == len(rows)
    for mine in by_job(rows).values():
        for k, r in enumerate(mine, 1):
            last = [x[4] for x in mine[max(0, k - 10):k]]
            left = len(mine) - k
            assert found[r[0]] == (k, pytest.approx(left * sum(last) / len(last) if k >= 3 else left / 10))


def test_each_input_is_read_once(spark):
    """Throttle events and stuck jobs never join their input back: one scan, one exchange by hour, one by job."""
    path = "/root/testdata/sf0.001/events.parquet"
    logs = spark.read.parquet(path).selectExpr("event_id as log_id", "ts", "cast(user_id as string) as job_id", "429 as status_code", "event_id % 3 as progress")
    for df in (LG.throttle_events(logs), LG.stuck_jobs(logs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2

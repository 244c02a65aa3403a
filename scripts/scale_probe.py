"""Scaling probe: the people pipeline on the sf fixture replicated k times.

Replicas are distinct people (person_key, names and e-mails get a replica
suffix), so group counts grow with k. Prints one line per k.
usage: python scripts/scale_probe.py [sf_dir] [k ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from leadsmith.plans.pipeline import clean_leads  # noqa: E402
from leadsmith.session import build_session  # noqa: E402
from leadsmith.sources import fixtures as FX  # noqa: E402


def replicated(spark, sf, k):
    p = FX.people_raw(spark, sf)
    x = p.withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")))
    tag = F.concat(F.lit("r"), F.col("__rep").cast("string"))
    cols = []
    for c in p.columns:
        if c in ("full_name", "work_email", "personal_email", "linkedin", "person_key"):
            cols.append(F.when(F.col(c).isNull(), None).otherwise(F.concat(F.col(c), tag)).alias(c))
        elif c == "_row":
            cols.append((F.col("_row") * k + F.col("__rep")).alias("_row"))
        else:
            cols.append(F.col(c))
    return x.select(*cols)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    ks = [int(a) for a in sys.argv[2:]] or [1, 10]
    spark = build_session(app_name="leadsmith-scale")
    for k in ks:
        raw = replicated(spark, sf, k)
        n = raw.count()
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            out = clean_leads(raw, FX.PEOPLE_SPEC, "people")
            out.write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        print(f"k={k} rows={n} sec={best:.2f} rows_per_sec={n / best:.0f}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

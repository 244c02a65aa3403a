"""Shared-folder tables and small helpers common to the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, the separator of words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="corpus-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    Only a local master may do without ``spark.checkpoint.dir``; a cluster session without it is an error, since
    executors could not see a folder of the driver's.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        master = conf.get("spark.master") or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local_scratch()
    return f"{root.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more; what was made of them is written by now."""
    for table in tables:
        jvm = table.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that go to a Python worker at a time: texts are long, and Spark's default of 10,000 holds too many of them in memory.
ARROW_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they need not have it on their path.

    Where the session has Spark's default size of Arrow batches, a smaller one is set.
    """
    key, default, smaller = ARROW_BATCH
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, smaller)
    context = spark.sparkContext
    if getattr(context, "_corpus_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="corpus-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._corpus_shipped = True


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of passes whose results are written: Spark drops them when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, and this package on the workers."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

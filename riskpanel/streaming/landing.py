"""Batches of a stream landed exactly once, whatever is replayed or lost.

A target holds ``landing_run=R/landing_batch=N`` folders and a log of committed batches. The run number lives in the
stream's checkpoint, so a checkpoint that is lost begins a new run and never meets the batch numbers of an old one.
Only the log makes rows visible: one small file, written after the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "_committed"
LOG_COLUMNS = "landing_run INT, landing_batch LONG"


def read_if_there(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """Rows of a folder that may not exist yet."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, target: str) -> DataFrame:
    return read_if_there(spark, f"{target}/{LOG}", LOG_COLUMNS).distinct()


def run_number(spark: SparkSession, log: DataFrame, checkpoint: str) -> int:
    """The number of this checkpoint's run; a checkpoint without one takes the next after all of the commit log.

    A run that never committed may lend its number: nothing of it is visible.
    """
    path = f"{checkpoint}/landing_run"
    own = read_if_there(spark, path, "landing_run INT").first()
    if own is not None:
        return own["landing_run"]
    last = log.agg(F.max("landing_run")).first()[0]
    run = (last or 0) + 1
    spark.createDataFrame([(run,)], "landing_run INT").coalesce(1).write.mode("overwrite").json(path)
    return run


@contextmanager
def landing(spark: SparkSession, target: str, run: int, batch: int) -> Iterator[str | None]:
    """The folder of a batch, to be overwritten; the batch is committed if the block ends well.

    None for a batch that is committed already: it was replayed and has nothing to do.
    """
    mine = (F.col("landing_run") == run) & (F.col("landing_batch") == batch)
    if not committed(spark, target).where(mine).isEmpty():
        yield None
        return
    yield f"{target}/landing_run={run}/landing_batch={batch}"
    spark.createDataFrame([(run, batch)], LOG_COLUMNS).coalesce(1).write.mode("append").json(f"{target}/{LOG}")


def read_landed(spark: SparkSession, target: str) -> DataFrame:
    """Rows of committed batches with their ``landing_run`` and ``landing_batch``; others are pruned by folder."""
    rows = spark.read.option("basePath", target).option("mergeSchema", "false").parquet(target)
    return rows.join(committed(spark, target), ["landing_run", "landing_batch"])


def landed_before(spark: SparkSession, target: str, run: int) -> DataFrame | None:
    """Committed rows of earlier runs, None if there are none."""
    others = committed(spark, target).where(F.col("landing_run") != run)
    return None if others.isEmpty() else read_landed(spark, target).where(F.col("landing_run") != run)

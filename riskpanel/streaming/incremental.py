"""Incremental collection runs: which keys to process, and landing new files exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize
from riskpanel.sources.writers import write_months
from riskpanel.streaming import landing as L


def collection_status(
    wanted: DataFrame,
    existing: DataFrame,
    ready: DataFrame | None = None,
    limit: int | None = None,
    overwrite: bool = False,
    key: str = "entity",
) -> DataFrame:
    """Status of each wanted key: precondition_failed, skipped (already there), or pending.

    ``limit`` stops after that many keys in key order.
    """
    keys = wanted.select(key).distinct()
    if limit is not None:
        keys = keys.orderBy(key).limit(limit)
    have = existing.select(key).distinct().withColumn("have", F.lit(True))
    status = keys.join(have, key, "left")
    if ready is None:
        status = status.withColumn("ready", F.lit(True))
    else:
        status = status.join(
            ready.select(key).distinct().withColumn("ready", F.lit(True)), key, "left")
    skipped = F.lit(not overwrite) & F.col("have").isNotNull()
    return status.select(
        key, F.when(F.col("ready").isNull(), "precondition_failed").when(skipped, "skipped")
        .otherwise("pending").alias("status"))


def pending_keys(status: DataFrame) -> DataFrame:
    return status.where(F.col("status") == "pending").drop("status")


def collection_counts(status: DataFrame, failed: DataFrame | None = None,
                      key: str = "entity") -> DataFrame:
    """One row of run counts; ``failed`` holds the keys whose collection raised an error."""
    if failed is None:
        marked = status.withColumn("error", F.lit(None).cast("boolean"))
    else:
        marked = status.join(
            failed.select(key).distinct().withColumn("error", F.lit(True)), key, "left")
    pending, error = F.col("status") == "pending", F.col("error").isNotNull()
    return marked.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(pending & ~error).alias("written"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "precondition_failed").alias("precondition_failed"),
        F.count_if(pending & error).alias("errors"))


def popularity_rank(df: DataFrame, n: int, key: str, measure: str) -> DataFrame:
    """The n most popular keys with their rank; n rows at most reach the ranking window."""
    top = df.orderBy(F.desc(measure), key).limit(n)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(measure), key)
    return top.withColumn("downloads_rank", F.row_number().over(order))


def land_new_files(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str,
    month_column: str = "event_yyyymm", fmt: str = "json",
):
    """Append the files that arrived since the last run to the month partitions.

    The checkpoint remembers finished files. Each row keeps its file's name and lies below the number of its run and
    batch; :func:`read_landed` gives the rows of committed batches. A batch that was written but not committed comes
    again under the same numbers and replaces what it left. If the checkpoint is lost, a run with a new number starts
    over: it leaves out the files of batches that earlier runs committed. So every file is landed exactly once.
    """
    run = L.run_number(spark, L.committed(spark, target), checkpoint)
    known = L.landed_before(spark, target, run)
    if known is not None:
        known = materialize(known.select("landing_file").distinct(), "known-files")

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch if known is None else batch.join(known, "landing_file", "left_anti")
        with L.landing(batch.sparkSession, target, run, number) as folder:
            if folder:
                write_months(fresh, folder, overwrite=True, column=month_column)

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return (
        stream.select("*", F.col("_metadata.file_path").alias("landing_file"))
        .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

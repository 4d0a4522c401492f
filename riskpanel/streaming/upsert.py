"""Keyed upserts from a stream into a bucketed table that is switched from version to version.

Keys are dealt to a fixed number of buckets. A batch rewrites the buckets that it touches into a folder of its own
version; a manifest, one row written as one file, then names the version of every bucket. Readers follow the last
manifest, so they see a version whole or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.streaming.landing import read_if_there, run_number

BUCKETS = 256
MANIFEST = "version LONG, landing_run INT, landing_batch LONG, buckets MAP<STRING, LONG>"


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifests(spark: SparkSession, target: str) -> DataFrame:
    return read_if_there(spark, f"{target}/manifest", MANIFEST)


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One record per key: the highest ``order``, then the greatest record, so that no replay changes the outcome."""
    rest = [c for c in rows.columns if c not in keys]
    record = F.max(F.struct(F.struct(*order).alias("order"), F.struct(*rest).alias("record"))).alias("best")
    return rows.groupBy(*keys).agg(record).select(*keys, "best.record.*")


def _read(spark: SparkSession, target: str, schema: str, where: dict[str, int]) -> DataFrame:
    """Rows of some buckets at their versions; the number of paths is at most that of the buckets."""
    paths = [f"{target}/data/version={v}/bucket={b}" for b, v in sorted(where.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_current(spark: SparkSession, target: str, schema: str, version: int | None = None) -> DataFrame:
    """The table at its last version, or at an earlier one."""
    rows = manifests(spark, target)
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    last = rows.orderBy(F.desc("version")).first()
    return _read(spark, target, schema, last["buckets"] if last else {})


def upsert_batch(
    batch: DataFrame, number: int, run: int, target: str, schema: str, keys: Sequence[str], order: Sequence[str],
    buckets: int = BUCKETS,
) -> bool:
    """Merge one batch and switch to the next version; False for a batch that a manifest already names.

    What a crash left behind below the next version is overwritten; nothing refers to it.
    """
    spark = batch.sparkSession
    log = manifests(spark, target)
    if not log.where((F.col("landing_run") == run) & (F.col("landing_batch") == number)).isEmpty():
        return False
    last = log.orderBy(F.desc("version")).first()
    version, held = (last["version"] + 1, dict(last["buckets"])) if last else (1, {})
    columns = spark.createDataFrame([], schema).columns
    fresh = newest(batch.select(*columns), keys, order).withColumn("bucket", bucket_of(keys, buckets)).persist()
    touched = [str(r["bucket"]) for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
    old = _read(spark, target, schema, {b: held[b] for b in touched if b in held})
    merged = newest(old.unionByName(fresh.drop("bucket")), keys, order).withColumn("bucket", bucket_of(keys, buckets))
    folder = f"{target}/data/version={version}"
    merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    fresh.unpersist()
    row = (version, run, number, {**held, **{b: version for b in touched}})
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{target}/manifest")
    return True


def upsert_stream(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str],
    order: Sequence[str], fmt: str = "json", buckets: int = BUCKETS,
):
    """Merge the files that arrived since the last run: per key the record of the highest ``order`` stays.

    The outcome does not depend on how files fall into batches, on replays, or on a lost checkpoint, after which all
    files come again under a new run. One writer at a time.
    """
    run = run_number(spark, manifests(spark, target), checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        upsert_batch(batch, number, run, target, schema, keys, order, buckets)

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

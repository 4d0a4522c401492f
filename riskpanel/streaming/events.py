"""Monthly activity as a stream: event-time aggregates with a watermark, merged into months on reading."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.operators import activity as A
from riskpanel.streaming import landing as L

DAY = "1 day"
FACT_KEYS = ("day", "entity", "month", "actor")
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
DISK_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def actor_days(events: DataFrame, delay: str) -> DataFrame:
    """One mergeable row per day and actor, for a stream or a table of events.

    In a stream a day is emitted once, when the watermark (latest event time less ``delay``) has passed its end;
    rows of a day that was emitted are late and dropped. State holds the open days only, a hot month no more than
    its open days' actors. Events without a time stamp count on their date, or on the first of their month.
    """
    tested = A.tested_events(events).withWatermark("event_time", delay)
    day = F.window("event_time", DAY)
    return tested.groupBy(day.alias("window"), "entity", "month", "actor").agg(*A.actor_measures()).select(
        F.col("window.start").alias("day"), "entity", "month", "actor",
        *A.fact_columns())


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started in this block keep their state in RocksDB, unless the session names a store of its own.

    Spark's default store holds all open days of two versions as objects on the heap. A checkpoint remembers its store.
    """
    own = spark.conf.get(STORE_CONF, None)
    named = own is not None and not own.endswith("HDFSBackedStateStoreProvider")
    if named:
        yield
        return
    spark.conf.set(STORE_CONF, DISK_STORE)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(STORE_CONF)
        else:
            spark.conf.set(STORE_CONF, own)


def stream_activity(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, delay: str = "7 days",
    fmt: str = "json",
):
    """Take in the event files that arrived since the last run and land the days that are complete.

    The checkpoint holds files, open days and the watermark; a restart goes on from them. See
    :mod:`riskpanel.streaming.landing` for what happens to replayed batches and lost checkpoints.
    """
    run = L.run_number(spark, L.committed(spark, target), checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        with L.landing(batch.sparkSession, target, run, number) as folder:
            if folder:
                batch.write.mode("overwrite").parquet(folder)

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    with state_on_disk(spark):
        return (
            actor_days(stream, delay).writeStream.outputMode("append").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def landed_months(spark: SparkSession, target: str) -> DataFrame:
    """The activity columns per (entity, month) over all complete days.

    A run after a lost checkpoint emits days again; the newest run's row of a day and actor counts.
    """
    facts = L.read_landed(spark, target)
    newest = Window.partitionBy(*FACT_KEYS).orderBy(F.desc("landing_run"))  # a row per run
    facts = facts.withColumn("nth", F.row_number().over(newest)).where("nth = 1")
    return A.months_of_actors(A.merge_actor_facts(facts))

"""Session helpers: a tuned local session and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
METHOD_LIMIT_CONF, METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "8000"


def build_session(app_name: str = "riskpanel", cores: int | str = "*") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own session."""
    partitions = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master without that setting
    falls back to a temporary folder, because there driver and executors are one process.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/riskpanel/{name}-{uuid.uuid4().hex}"


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Generated methods that are too long for the JVM to compile are split while this lasts.

    HotSpot interprets methods beyond 8,000 bytes; Spark's own limit is far above that. Results do not depend on it.
    """
    before = spark.conf.get(METHOD_LIMIT_CONF, None)
    spark.conf.set(METHOD_LIMIT_CONF, METHOD_LIMIT)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(METHOD_LIMIT_CONF)
        else:
            spark.conf.set(METHOD_LIMIT_CONF, before)


def materialize(df: DataFrame, name: str, many_columns: bool = False) -> DataFrame:
    """Write a result once to the shared folder and read it back.

    Cuts lineage with a table that survives the loss of any executor. Plans over many columns are written with
    :func:`compiled_methods`.
    """
    path = scratch_path(df.sparkSession, name)
    with compiled_methods(df.sparkSession) if many_columns else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Sinks: JSON lines, CSV, ORC tables, partitioned layouts and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.sources.schemas import ARCHIVE_TABLES


def panel_summary(panel: DataFrame, entity: str = "entity") -> DataFrame:
    """One-row summary of a panel, in one aggregate over all rows."""
    flags = {
        "rows_with_gharchive": "gharchive_present",
        "rows_with_advisory_this_month": "had_advisory_this_month",
    }
    return panel.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_distinct(F.col(entity)).alias("entities_total"),
        F.count_distinct(F.col("month")).alias("months_total"),
        F.min("month").alias("start_month"),
        F.max("month").alias("end_month"),
        *[F.count_if(F.col(c)).alias(k) for k, c in flags.items() if c in panel.columns],
    )


def bundle_summary(bundle: DataFrame) -> DataFrame:
    """One-row coverage summary of the current-point bundle."""
    families = {
        "plugins_with_snapshot": "snapshot_present",
        "plugins_with_advisories": "advisories_present",
        "plugins_with_healthscore": "healthscore_present",
        "plugins_with_software_heritage": "swh_present",
        "plugins_with_github": "github_present",
        "plugins_with_gharchive": "gharchive_present",
    }
    return bundle.agg(
        F.count(F.lit(1)).alias("plugins_total"),
        *[F.count_if(F.col(c)).alias(k) for k, c in families.items() if c in bundle.columns])


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of each written file in the given order."""
    return df.sortWithinPartitions(*order) if order else df


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", order: Sequence[str] = ()) -> None:
    """JSON lines with sorted keys; null fields are kept. ``order`` sorts the rows of each file."""
    in_order(df, order).select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def _csv_scalar(name: str, kind: str) -> Column:
    nested = kind in ("array", "map", "struct")
    return (F.to_json(F.col(name)) if nested else F.col(name)).alias(name)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", order: Sequence[str] = ()) -> None:
    """CSV with a sorted header; nested values become JSON text. ``order`` sorts the rows of each file."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    in_order(df, order).select(*[_csv_scalar(c, kinds[c]) for c in sorted(df.columns)]).write.mode(mode).option(
        "header", True).option("escape", '"').csv(path)


def write_predictions(df: DataFrame, path: str, key: str = "plugin_id") -> None:
    """Prediction table sink: key, month, y_true, y_prob; each file by month and key."""
    in_order(df, ("month", "entity")).select(F.col("entity").alias(key), "month", "y_true", "y_prob").write.mode(
        "overwrite").option("header", True).csv(path)


def write_partitioned(
    df: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite", fmt: str = "parquet"
) -> None:
    """One directory per key. Rows are rebalanced by key: small keys share a task, and a key that holds
    a large share of all rows is written by many tasks as several files."""
    df.hint("rebalance", *columns).write.mode(mode).partitionBy(*columns).format(fmt).save(path)


def write_months(df: DataFrame, path: str, overwrite: bool = False,
                 column: str = "event_yyyymm") -> None:
    """Append to month partitions; with ``overwrite`` each touched month is replaced once.

    Rows are rebalanced by month: small months share a task, a large one is split over many.
    """
    writer = df.hint("rebalance", column).write.partitionBy(column)
    if overwrite:
        writer = writer.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    else:
        writer = writer.mode("append")
    writer.parquet(path)


def create_orc_table(df: DataFrame, name: str, path: str, partition_by: Sequence[str] = ()) -> None:
    """Store a result as a compressed ORC table at a path."""
    writer = df.write.format("orc").mode("overwrite").option("compression", "zstd").option(
        "path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def register_archive_table(
    spark: SparkSession, table: str, name: str, location: str, partition: str | None = None
) -> None:
    """Register landed ORC files as a typed table of the archive graph.

    ``partition`` names a string column that is in the folder names only; :func:`refresh_partitions` then makes
    folders visible that were written by anyone.
    """
    columns = ARCHIVE_TABLES[table] + (f", {partition} STRING" if partition else "")
    by = f" PARTITIONED BY ({partition})" if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING ORC{by} LOCATION '{location}'")


def register_archive(spark: SparkSession, prefix: str, names: dict[str, str] | None = None,
                     partition: str | None = None) -> dict[str, str]:
    """Register all tables of the archive graph below ``prefix/orc``; the names they got, by table."""
    given = {table: (names or {}).get(table, table) for table in ARCHIVE_TABLES}
    for table, name in given.items():
        register_archive_table(spark, table, name, f"{prefix.rstrip('/')}/orc/{table}", partition)
        if partition:
            refresh_partitions(spark, name)
    return given


def refresh_partitions(spark: SparkSession, name: str) -> None:
    """Add the folders that were written since to the catalogue, and drop those that are gone."""
    spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")


def hash_prefix(key: Column, hashed: bool = True) -> Column:
    """Two hex digits: of the key's MD5, or of the key itself where it already is a hash."""
    return F.substring(F.md5(key.cast("string")) if hashed else key, 1, 2)


def write_prefix_layout(
    df: DataFrame, name: str, path: str, key: str, prefix: str, hashed: bool = True,
) -> None:
    """Rewrite a table into 256 prefix directories so that point lookups read one of them.

    Rows are rebalanced by prefix, which keeps files large and splits the prefix of a hot key
    over as many tasks as its size asks for.
    """
    laid_out = df.withColumn(prefix, hash_prefix(F.col(key), hashed)).hint("rebalance", prefix)
    create_orc_table(laid_out, name, path, [prefix])


def create_lookup_view(spark: SparkSession, view: str, table: str, columns: Sequence[str]) -> None:
    """View with the columns of the original table over its rewritten layout."""
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT {', '.join(columns)} FROM {table}")

"""Source and sink queries: everything is written, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskpanel.catalogue import bindings as B
from riskpanel.catalogue import register
from riskpanel.operators import incidents as I
from riskpanel.session import scratch_path
from riskpanel.sources import readers, schemas, writers
from riskpanel.streaming import incremental as N
from riskpanel.streaming.landing import read_landed


def _name(prefix):
    return f"{prefix}_{uuid.uuid4().hex}"


def _orders(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM").alias("event_yyyymm"))


_ORDERS = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day,
  strftime(o_orderdate, '%Y-%m') AS event_yyyymm FROM orders)"""


@register("hash_prefix_layout", f"""WITH {_ORDERS}
SELECT substr(md5(CAST(o_custkey AS VARCHAR)), 1, 2) AS key_prefix, count(*) AS n_rows,
  count(DISTINCT o_custkey) AS n_keys, max(day) AS last_day FROM o GROUP BY 1""")
def hash_prefix_layout(spark, sf_dir):
    table, view = _name("layout"), _name("lookup")
    orders = _orders(spark, sf_dir)
    writers.write_prefix_layout(orders, table, scratch_path(spark, "layout"), "o_custkey",
                                "key_prefix")
    writers.create_lookup_view(spark, view, table, [*orders.columns, "key_prefix"])
    return spark.table(view).groupBy(F.col("key_prefix").cast("string")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_keys"),
        F.max("day").alias("last_day"))


@register("orc_tables", """
SELECT 'c' || CAST(o_custkey AS VARCHAR) AS origin, o_orderkey AS visit, o_orderdate AS date,
  o_orderstatus AS status FROM orders""")
def orc_tables(spark, sf_dir):
    path, name = scratch_path(spark, "orc"), _name("origin_visit_status")
    B.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("origin"),
        F.col("o_orderkey").alias("visit"), F.col("o_orderdate").alias("date"),
        F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("snapshot"),
        F.lit("git").alias("type")).write.orc(path, compression="zstd")
    writers.register_archive_table(spark, "origin_visit_status", name, path)
    return spark.table(name).select("origin", "visit", "date", "status")


def _archive_rows(spark, sf_dir, at, table):
    """Typed rows of one graph table: every column null but an integer, a text and a binary one if it has them."""
    orders = B.table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 12 >= at)
    first: dict[str, str] = {}
    columns = [c.strip().split(" ") for c in schemas.ARCHIVE_TABLES[table].split(",")]
    for name, kind in columns:
        first.setdefault(kind, name)
    values = {"BIGINT": F.col("o_orderkey"), "STRING": F.concat(F.lit("x"), F.col("o_orderkey").cast("string")),
              "BINARY": F.encode(F.col("o_orderstatus"), "utf-8"), "TIMESTAMP": F.col("o_orderdate")}
    part = F.concat(F.lit("p"), (F.col("o_orderkey") % 4).cast("string")).alias("part")
    return orders.select(*[
        (values[kind] if kind in values and first[kind] == name else F.lit(None)).cast(kind).alias(name)
        for name, kind in columns], part)


_ARCHIVE_NAMES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(schemas.ARCHIVE_TABLES))


@register("orc_catalogue", f"""
SELECT name AS table_name, 'p' || CAST(o_orderkey % 4 AS VARCHAR) AS part, count(*) AS n_rows,
  min('x' || CAST(o_orderkey AS VARCHAR)) AS first_id, max('x' || CAST(o_orderkey AS VARCHAR)) AS last_id
FROM orders JOIN (VALUES {_ARCHIVE_NAMES}) t(i, name) ON o_orderkey % 12 >= i GROUP BY ALL""")
def orc_catalogue(spark, sf_dir):
    """All twelve graph tables registered over partitioned files, then a folder that comes late is repaired in."""
    prefix, names = scratch_path(spark, "archive"), {}
    rows = {}
    for at, table in enumerate(schemas.ARCHIVE_TABLES):
        rows[table], names[table] = _archive_rows(spark, sf_dir, at, table), _name(table)
        rows[table].where("part <> 'p3'").write.partitionBy("part").orc(f"{prefix}/orc/{table}", compression="zstd")
    writers.register_archive(spark, prefix, names, "part")
    out = None
    for table, name in names.items():
        late = rows[table].where("part = 'p3'")
        late.write.mode("append").partitionBy("part").orc(f"{prefix}/orc/{table}", compression="zstd")
        writers.refresh_partitions(spark, name)
        key = schemas.ARCHIVE_TABLES[table].split(" ")[0]
        one = spark.table(name).groupBy(F.lit(table).alias("table_name"), "part").agg(
            F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
        out = one if out is None else out.unionByName(one)
    return out


@register("month_partition_append", f"""WITH {_ORDERS}
SELECT event_yyyymm, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM (
  SELECT event_yyyymm, o_orderkey FROM o WHERE event_yyyymm < '1996-01' AND o_orderkey % 2 = 0
  UNION ALL SELECT event_yyyymm, o_orderkey FROM o WHERE event_yyyymm >= '1996-01'
  UNION ALL SELECT event_yyyymm, o_orderkey FROM o WHERE event_yyyymm >= '1999-01')
GROUP BY event_yyyymm""")
def month_partition_append(spark, sf_dir):
    path = scratch_path(spark, "months")
    orders = _orders(spark, sf_dir)
    month = F.col("event_yyyymm")
    writers.write_months(orders, path)
    writers.write_months(orders.where(month >= "1999-01"), path)
    replaced = orders.where((month < "1996-01") & (F.col("o_orderkey") % 2 == 0))
    writers.write_months(replaced, path, overwrite=True)
    return spark.read.parquet(path).groupBy(month.cast("string").alias("event_yyyymm")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


@register("incremental_antijoin", """
WITH s AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'p'
  WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
  THEN 's' ELSE 'w' END AS st FROM customer)
SELECT count(*) AS processed, count(*) FILTER (WHERE st = 'w' AND c_custkey % 9 <> 0) AS written,
  count(*) FILTER (WHERE st = 's') AS skipped, count(*) FILTER (WHERE st = 'p') AS precondition_failed,
  count(*) FILTER (WHERE st = 'w' AND c_custkey % 9 = 0) AS errors FROM s""")
def incremental_antijoin(spark, sf_dir):
    customers = B.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "entity")
    ready = customers.where(F.col("c_mktsegment") != "HOUSEHOLD")
    status = N.collection_status(customers, B.customer_incidents(spark, sf_dir), ready)
    failed = customers.where(F.col("entity") % 9 == 0)
    return N.collection_counts(status, failed)


@register("popularity_rank", """
SELECT p_partkey AS package_id, n AS monthly_downloads, CAST(rank AS BIGINT) AS downloads_rank FROM (
  SELECT l_partkey AS p_partkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS rank
  FROM lineitem GROUP BY 1) WHERE rank <= 100""")
def popularity_rank(spark, sf_dir):
    counts = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("package_id")).agg(
        F.count(F.lit(1)).alias("monthly_downloads"))
    return B.rounded(N.popularity_rank(counts, 100, "package_id", "monthly_downloads"))


_INCIDENT_ROW = f"""WITH {B.CUSTOMER_INCIDENTS_SQL}
SELECT 'e' || CAST(entity AS VARCHAR) AS entity, published, cvss,
  array_to_string(list_sort(list_distinct(cve_ids)), ',') AS cve_ids FROM incidents"""


def _landed_incidents(spark, sf_dir):
    """Incident records in their landed JSON shape."""
    rows = B.customer_incidents(spark, sf_dir)
    return rows.select(
        F.lit("vendor").alias("source"), F.lit("advisory").alias("type"),
        F.concat(F.lit("e"), F.col("entity").cast("string")).alias("plugin_id"),
        F.date_format("published", "yyyy-MM-dd'T'00:00:00'Z'").alias("published_date"), "cve_ids",
        F.struct(F.lit("x").alias("max_severity_label"), F.col("cvss").alias("max_cvss_base_score"))
        .alias("severity_summary"))


def _panel_input(records):
    return I.panel_incidents(records).withColumn(
        "cve_ids", F.array_join(F.array_sort("cve_ids"), ","))


@register("jsonl_round_trip", _INCIDENT_ROW)
def jsonl_round_trip(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    writers.write_jsonl(_landed_incidents(spark, sf_dir), path)
    return _panel_input(readers.read_jsonl_strict(spark, path, schemas.INCIDENT))


@register("tolerant_scan", _INCIDENT_ROW)
def tolerant_scan(spark, sf_dir):
    """Each record once, between a cut-off copy, a non-object line and a blank line."""
    path = scratch_path(spark, "tolerant")
    text = F.to_json(F.struct("*"))
    lines = F.array(text, F.substring(text, 1, 20), F.lit("[1]"), F.lit("7"), F.lit(""))
    _landed_incidents(spark, sf_dir).select(F.explode(lines)).write.text(path)
    return _panel_input(readers.read_jsonl_tolerant(spark, path, schemas.INCIDENT))


@register("csv_round_trip", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, '["' || o_orderstatus || '","a,b"]' AS tags,
  o_orderpriority AS note FROM orders""")
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    writers.write_csv(B.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array("o_orderstatus", F.lit("a,b")).alias("tags"),
        F.col("o_orderpriority").alias("note")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@register("prediction_round_trip", f"""WITH {B.PREDICTIONS_SQL}
SELECT entity, month, CAST(y_true AS BIGINT) AS y_true, y_prob FROM preds""")
def prediction_round_trip(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    writers.write_predictions(B.predictions(spark, sf_dir), path, key="package_id")
    return B.rounded(readers.read_predictions(spark, path))


@register("file_precedence", """
WITH f AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1
  ELSE 2 END AS kind, o_orderkey FROM orders),
b AS (SELECT o_custkey, min(kind) AS kind FROM f GROUP BY 1)
SELECT 'e' || CAST(f.o_custkey AS VARCHAR) AS entity, f.o_orderkey
FROM f JOIN b ON f.o_custkey = b.o_custkey AND f.kind = b.kind""")
def file_precedence(spark, sf_dir):
    status = F.col("o_orderstatus")
    suffix = F.when(status == "F", ".advisories.real.jsonl").when(
        status == "O", ".advisories.sample.jsonl").otherwise(".advisories.jsonl")
    files = B.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("e"), F.col("o_custkey").cast("string"), suffix).alias("file_name"),
        "o_orderkey")
    return readers.best_files(files).select("entity", "o_orderkey")


@register("land_new_files", f"""WITH {_ORDERS}
SELECT event_yyyymm, count(*) AS n_rows FROM o GROUP BY event_yyyymm""")
def land_new_files(spark, sf_dir):
    """Two arrivals of files, landed by two runs that share one checkpoint."""
    source, target = scratch_path(spark, "arrivals"), scratch_path(spark, "landed")
    checkpoint = scratch_path(spark, "progress")
    orders = _orders(spark, sf_dir).select("o_orderkey", "event_yyyymm")
    for first in (True, False):
        part = orders.where((F.col("event_yyyymm") < "1998-06") == F.lit(first))
        part.write.mode("append").json(source)
        N.land_new_files(spark, source, "o_orderkey LONG, event_yyyymm STRING", target,
                         checkpoint).awaitTermination()
    return read_landed(spark, target).groupBy(
        F.col("event_yyyymm").cast("string").alias("event_yyyymm")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@register("bundle_summary", """
SELECT count(*) AS plugins_total, count(*) FILTER (WHERE c_custkey % 10 <> 9) AS plugins_with_snapshot,
  count(*) FILTER (WHERE c_custkey % 5 <> 0) AS plugins_with_healthscore,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
    AND o_orderpriority = '1-URGENT')) AS plugins_with_advisories
FROM customer""")
def bundle_summary(spark, sf_dir):
    from riskpanel.catalogue.bundle import _bundle

    return writers.bundle_summary(_bundle(spark, sf_dir)).select(
        "plugins_total", "plugins_with_snapshot", "plugins_with_healthscore",
        "plugins_with_advisories")

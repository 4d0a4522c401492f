"""How the driver tables play the roles of registry, incidents, activity and visits.

Each binding exists twice: as a DataFrame and as the SQL text the oracle uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "1995-01", "2001-08"
ACTIVITY_START, ACTIVITY_END, ACTIVITY_BUCKET = "1995-01-01", "2001-12-31", 30
TEST_START = "2000-07"
MEMBER_KINDS = (
    "PushEvent", "PullRequestEvent", "PullRequestReviewEvent", "IssuesEvent", "ReleaseEvent",
    "WatchEvent", "ForkEvent", "CreateEvent",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; zone-less timestamps are read as instants of the session zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


# --- registry: customers, or suppliers where activity should be dense -----------------------


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"))


MONTHS_SQL = """
months AS (
  SELECT window_index, window_start, last_day(window_start) AS window_end,
         strftime(window_start, '%Y-%m') AS month,
         CAST(year(window_start) * 12 + month(window_start) - 1 AS INTEGER) AS month_no
  FROM (SELECT CAST(i AS INTEGER) AS window_index,
               CAST(DATE '1995-01-01' + to_months(CAST(i AS INTEGER)) AS DATE) AS window_start
        FROM range(0, 80) AS t(i)))"""
CUSTOMER_GRID_SQL = f"""{MONTHS_SQL},
grid AS (SELECT c_custkey AS entity, m.* FROM customer, months m)"""
SUPPLIER_GRID_SQL = f"""{MONTHS_SQL},
grid AS (SELECT s_suppkey AS entity, m.* FROM supplier, months m)"""


# --- incidents: urgent orders ----------------------------------------------------------------


def _incident_columns(entity: str) -> list[Column]:
    key = F.col("o_orderkey")
    ids = F.transform(
        F.sequence(F.lit(0).cast("long"), key % 3),
        lambda j: F.concat(F.lit("CVE-"), ((key + 3 * j) % 11).cast("string")),
    )
    return [
        F.col(entity).alias("entity"), F.col("o_orderdate").cast("date").alias("published"),
        ((key % 100) / 10).alias("cvss"), ids.alias("cve_ids"), key.alias("incident_key"),
    ]


def customer_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return orders.select(*_incident_columns("o_custkey"))


def supplier_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an urgent order as an incident of its supplier."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        *_incident_columns("l_suppkey")
    )


_INCIDENT_SELECT = """CAST(o_orderdate AS DATE) AS published,
    CAST(o_orderkey % 100 AS DOUBLE) / 10 AS cvss,
    list_transform(range(0, o_orderkey % 3 + 1),
                   lambda j: 'CVE-' || CAST((o_orderkey + 3 * j) % 11 AS VARCHAR)) AS cve_ids,
    o_orderkey AS incident_key"""
CUSTOMER_INCIDENTS_SQL = f"""
incidents AS (
  SELECT o_custkey AS entity, {_INCIDENT_SELECT}
  FROM orders WHERE o_orderpriority = '1-URGENT')"""
SUPPLIER_INCIDENTS_SQL = f"""
incidents AS (
  SELECT l_suppkey AS entity, {_INCIDENT_SELECT}
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_orderpriority = '1-URGENT')"""


# --- activity: order lines as events of their supplier ---------------------------------------

TEXT_CASES = (
    (0, "Fix CVE-2020-1 vulnerability"), (1, "HotFix for login"), (2, "Bump spring from 1 to 2"),
    (3, "Source refactor"), (4, "Sanitize input"),
)


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised events: one per order line."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus",
        "l_shipdate",
    )
    e = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    kind = F.element_at(
        F.array(*[F.lit(k) for k in MEMBER_KINDS]),
        ((order + F.col("l_linenumber")) % 8 + 1).cast("int"),
    )
    actor = (
        F.when(part % 23 == 0, F.lit(None).cast("string"))
        .when(part % 10 == 0, "dependabot")
        .when(part % 10 == 1, F.concat(F.lit("Build"), (part % 7).cast("string"), F.lit("[Bot]")))
        .otherwise(F.concat(F.lit("user"), (part % 50).cast("string")))
    )
    words = F.lit("Update readme")
    for remainder, text in TEXT_CASES:
        words = F.when(order % 13 == remainder, text).otherwise(words)
    day = F.col("l_shipdate").cast("date")
    first = F.to_date(F.lit(ACTIVITY_START))
    start = F.date_add(first, (F.floor(F.datediff(day, first) / ACTIVITY_BUCKET)
                               * ACTIVITY_BUCKET).cast("int"))
    end = F.least(F.date_add(start, ACTIVITY_BUCKET - 1), F.to_date(F.lit(ACTIVITY_END)))
    return e.select(
        F.col("l_suppkey").alias("entity"), F.date_format(day, "yyyy-MM").alias("event_yyyymm"),
        kind.alias("event_type"), F.col("l_shipdate").alias("event_ts"), day.alias("event_date"),
        actor.alias("actor_login"),
        F.when(F.col("l_returnflag") == "R", "closed").otherwise("opened").alias("action"),
        F.when(F.col("l_returnflag") == "A", F.lit(True)).alias("pr_merged"),
        F.col("o_orderdate").alias("pr_created_ts"), F.col("l_shipdate").alias("pr_closed_ts"),
        F.col("o_orderdate").alias("issue_created_ts"),
        F.col("l_shipdate").alias("issue_closed_ts"),
        F.when(F.col("l_linestatus") == "O", "tag").otherwise("branch").alias("ref_type"),
        F.lower(words).alias("text_blob"), F.lit(5.0).alias("sample_percent"),
        F.date_format(start, "yyyyMMdd").alias("source_window_start_yyyymmdd"),
        F.date_format(end, "yyyyMMdd").alias("source_window_end_yyyymmdd"),
    )


def _sql_cases() -> str:
    return " ".join(f"WHEN {r} THEN lower('{t}')" for r, t in TEXT_CASES)


ACTIVITY_SQL = f"""
events_n AS (
  SELECT l_suppkey AS entity, strftime(l_shipdate, '%Y-%m') AS month,
    [{', '.join(f"'{k}'" for k in MEMBER_KINDS)}][CAST((l_orderkey + l_linenumber) % 8 + 1 AS INT)]
      AS kind,
    CAST(l_shipdate AS DATE) AS day,
    CASE WHEN l_partkey % 23 = 0 THEN NULL WHEN l_partkey % 10 = 0 THEN 'dependabot'
         WHEN l_partkey % 10 = 1 THEN 'Build' || CAST(l_partkey % 7 AS VARCHAR) || '[Bot]'
         ELSE 'user' || CAST(l_partkey % 50 AS VARCHAR) END AS actor,
    COALESCE(l_partkey % 23 <> 0 AND l_partkey % 10 IN (0, 1), FALSE) AS bot,
    l_returnflag = 'R' AS closed, l_returnflag = 'A' AS merged,
    date_diff('day', o_orderdate, l_shipdate) * 24.0 AS hours,
    CASE WHEN l_linestatus = 'O' THEN 'tag' ELSE 'branch' END AS ref_type,
    CASE l_orderkey % 13 {_sql_cases()} ELSE 'update readme' END AS blob,
    CAST(floor(date_diff('day', DATE '{ACTIVITY_START}', CAST(l_shipdate AS DATE))
         / {ACTIVITY_BUCKET}.0) AS BIGINT) AS win
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# --- visits: finished orders ------------------------------------------------------------------


def _visit_columns(entity: str) -> list[Column]:
    key = F.col("o_orderkey")
    flags = {
        "has_readme": key % 2 == 0, "has_security_md": key % 3 == 0, "has_changelog": key % 5 == 0,
        "has_tests_directory": key % 7 < 4, "has_dependabot": key % 11 == 0,
        "has_github_actions": key % 4 == 1,
    }
    return [
        F.col(entity).alias("entity"), F.col("o_orderdate").cast("date").alias("visit_day"),
        key.alias("visit"), *[v.alias(k) for k, v in flags.items()],
        (key % 40).cast("int").alias("top_level_entry_count"),
        (key % 900).cast("int").alias("commit_count"),
        F.when(key % 9 > 0, (key % 700) / 2).alias("days_since_last_commit"),
        F.when(key % 6 > 0, (key % 100) / 100).alias("weekend_commit_fraction"),
    ]


def customer_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return orders.select(*_visit_columns("o_custkey"))


def supplier_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        *_visit_columns("l_suppkey")
    )


_VISIT_SELECT = """CAST(o_orderdate AS DATE) AS visit_day, o_orderkey AS visit,
    o_orderkey % 2 = 0 AS has_readme, o_orderkey % 3 = 0 AS has_security_md,
    o_orderkey % 5 = 0 AS has_changelog, o_orderkey % 7 < 4 AS has_tests_directory,
    o_orderkey % 11 = 0 AS has_dependabot, o_orderkey % 4 = 1 AS has_github_actions,
    CAST(o_orderkey % 40 AS INTEGER) AS top_level_entry_count,
    CAST(o_orderkey % 900 AS INTEGER) AS commit_count,
    CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey % 700 AS DOUBLE) / 2 END
      AS days_since_last_commit,
    CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 100 END
      AS weekend_commit_fraction"""
CUSTOMER_VISITS_SQL = f"""
visits AS (SELECT o_custkey AS entity, {_VISIT_SELECT} FROM orders WHERE o_orderstatus = 'F')"""
SUPPLIER_VISITS_SQL = f"""
visits AS (SELECT l_suppkey AS entity, {_VISIT_SELECT}
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey
           WHERE o_orderstatus = 'F')"""


# --- predictions: labelled documents ----------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked rows (entity, month, y_true, y_prob): the source of a document is its entity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return labels.join(docs, "doc_id").select(
        F.col("source").alias("entity"), F.col("doc_id").cast("string").alias("month"),
        F.col("toxic").alias("y_true"), (F.col("doc_id") * 7919 % 1000 / 1000).alias("y_prob"),
    )


PREDICTIONS_SQL = """
preds AS (
  SELECT source AS entity, CAST(d.doc_id AS VARCHAR) AS month, toxic AS y_true,
         CAST(d.doc_id * 7919 % 1000 AS DOUBLE) / 1000 AS y_prob
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Fractions to nine digits, so that only the order of summation is levelled out."""
    return df.select([
        F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
        else F.col(f.name).cast("long").alias(f.name)
        if f.dataType.typeName() in ("integer", "short", "byte") else F.col(f.name)
        for f in df.schema.fields
    ])

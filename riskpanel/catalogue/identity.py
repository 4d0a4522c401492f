"""Identity queries: alias maps and closure, repositories, registry and score payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.catalogue import bindings as B
from riskpanel.catalogue import register
from riskpanel.functions import text as T
from riskpanel.functions import urls as U
from riskpanel.operators import identity as Y
from riskpanel.session import materialize
from riskpanel.sources import readers


def _name(prefix, column):
    return F.concat(F.lit(prefix), column.cast("string"))


def _documents(spark, sf_dir):
    """Customers as documents that list former names: customer k was once named after 3k+1, 3k+2."""
    k = F.col("c_custkey")
    old = [_name("n", k * 3 + 1), F.concat(F.lit(" "), _name("n", k * 3 + 2), F.lit(" "))]
    payload = F.to_json(F.struct(
        F.when(k % 2 == 0, F.array(old[0])).alias("aliases"),
        F.when(k % 2 == 1, old[0]).alias("formerNames"),
        F.struct(F.array(old[1], _name("n", k)).alias("previousNames")).alias("plugin_api")))
    return B.table(spark, sf_dir, "customer").select(
        _name("n", k).alias("entity"), payload.alias("payload"), k.alias("seq"))


def _alias_map(spark, sf_dir):
    """Registry and snapshot names, a name file that overrides some, and part-number loops."""
    docs = _documents(spark, sf_dir)
    customers = B.table(spark, sf_dir, "customer")
    part = F.col("p_partkey")
    k = F.col("c_custkey")
    overrides = customers.where(k % 10 == 3).select(
        _name("n", F.floor(k / 5)).alias("canonical"), F.lit("file").alias("source"),
        k.alias("seq"), F.lit(0).alias("pos"), _name("n", k).alias("alias"))
    loops = B.table(spark, sf_dir, "part").select(
        _name("p", (part * part + 1) % 1000).alias("canonical"), F.lit("file").alias("source"),
        part.alias("seq"), F.lit(0).alias("pos"), _name("p", part).alias("alias"))
    candidates = Y.alias_rows(docs, "registry").unionByName(Y.alias_rows(docs, "snapshot"))
    return Y.build_alias_map(candidates.unionByName(overrides).unionByName(loops))


_MAP_SQL = """
cand AS (
  SELECT 'n' || CAST(c_custkey AS VARCHAR) AS canonical, 'n' || CAST(c_custkey * 3 + j AS VARCHAR) AS alias,
    j AS rank, c_custkey AS seq FROM customer, range(1, 3) AS t(j)
  UNION ALL
  SELECT 'n' || CAST(c_custkey // 5 AS VARCHAR), 'n' || CAST(c_custkey AS VARCHAR), 0, -c_custkey
  FROM customer WHERE c_custkey % 10 = 3
  UNION ALL
  SELECT 'p' || CAST((p_partkey * p_partkey + 1) % 1000 AS VARCHAR), 'p' || CAST(p_partkey AS VARCHAR), 0,
    -p_partkey FROM part),
amap AS (SELECT alias, arg_min(canonical, (rank, seq)) AS canonical FROM cand
         WHERE alias <> canonical GROUP BY alias)"""


@register("alias_map", f"WITH {_MAP_SQL} SELECT alias, canonical FROM amap")
def alias_map(spark, sf_dir):
    return _alias_map(spark, sf_dir)


@register("alias_closure", f"""WITH RECURSIVE {_MAP_SQL},
walk AS (
  SELECT alias, canonical AS cur, [alias] AS path FROM amap
  UNION ALL
  SELECT w.alias, m.canonical, list_append(w.path, w.cur)
  FROM walk w JOIN amap m ON m.alias = w.cur WHERE NOT list_contains(w.path, w.cur))
SELECT alias, arg_max(cur, len(path)) AS canonical FROM walk GROUP BY alias""")
def alias_closure(spark, sf_dir):
    return Y.resolve_aliases(_alias_map(spark, sf_dir))


@register("alias_reverse", f"""WITH RECURSIVE {_MAP_SQL},
walk AS (
  SELECT alias, canonical AS cur, [alias] AS path FROM amap
  UNION ALL
  SELECT w.alias, m.canonical, list_append(w.path, w.cur)
  FROM walk w JOIN amap m ON m.alias = w.cur WHERE NOT list_contains(w.path, w.cur)),
res AS (SELECT alias, arg_max(cur, len(path)) AS canonical FROM walk GROUP BY alias),
own AS (SELECT DISTINCT COALESCE(r.canonical, 'n' || CAST(c_custkey AS VARCHAR)) AS entity
        FROM customer LEFT JOIN res r ON r.alias = 'n' || CAST(c_custkey AS VARCHAR))
SELECT entity, entity AS candidate, CAST(0 AS BIGINT) AS is_alias FROM own
UNION ALL SELECT entity, alias, 1 FROM own JOIN amap ON amap.canonical = own.entity""")
def alias_reverse(spark, sf_dir):
    edges = materialize(_alias_map(spark, sf_dir), "alias-map")  # read by the closure and by the lookup of direct aliases
    names = B.table(spark, sf_dir, "customer").select(_name("n", F.col("c_custkey")).alias("entity"))
    return B.rounded(Y.alias_candidates(names, edges, Y.resolve_aliases(edges)))


@register("canonical_incidents", f"""WITH RECURSIVE {_MAP_SQL},
walk AS (
  SELECT alias, canonical AS cur, [alias] AS path FROM amap
  UNION ALL
  SELECT w.alias, m.canonical, list_append(w.path, w.cur)
  FROM walk w JOIN amap m ON m.alias = w.cur WHERE NOT list_contains(w.path, w.cur)),
res AS (SELECT alias, arg_max(cur, len(path)) AS canonical FROM walk GROUP BY alias)
SELECT COALESCE(r.canonical, 'n' || CAST(o_custkey AS VARCHAR)) AS entity, count(*) AS n
FROM orders LEFT JOIN res r ON r.alias = 'n' || CAST(o_custkey AS VARCHAR) GROUP BY 1""")
def canonical_incidents(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").select(_name("n", F.col("o_custkey")).alias("entity"))
    resolved = Y.resolve_aliases(_alias_map(spark, sf_dir))
    return Y.canonicalize(orders, resolved).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@register("repo_resolution", """
SELECT 'Plug In ' || CAST(c_custkey AS VARCHAR) AS entity, CASE WHEN c_custkey % 4 = 3 THEN
  'org/plug-in-' || CAST(c_custkey AS VARCHAR) || '-plugin'
  ELSE 'own' || CAST(c_nationkey AS VARCHAR) || '/r' || CAST(c_custkey AS VARCHAR) END AS repo_full_name
FROM customer""")
def repo_resolution(spark, sf_dir):
    k = F.col("c_custkey")
    url = F.concat(_name("https://GitHub.com/own", F.col("c_nationkey")), _name("/r", k),
                   F.lit(".git"))
    none = F.lit(None).cast("string")
    entity = _name("Plug In ", k).alias("entity")
    snapshots = B.table(spark, sf_dir, "customer").select(
        entity, F.when(k % 4 == 0, url).when(k % 4 == 3, "https://evil.example/a/b")
        .otherwise("  ").alias("repo_url"),
        F.when(k % 4 == 1, F.concat(F.lit('{"link":"'), url, F.lit('"}'))).alias("scm_url"),
        F.struct(F.when(k % 4 == 2, F.concat(F.lit('{"url":"'), url, F.lit('/tree"}')))
                 .otherwise(none).alias("scm")).alias("plugin_api"))
    fixed = snapshots.withColumn("plugin_api", F.struct(
        F.regexp_replace("plugin_api.scm", "[.]git/tree", ".git/tree").alias("scm")))
    return Y.resolve_repos(snapshots.select("entity"), fixed, fallback_owner="org")


@register("project_repo", """
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'o' || CAST(p_size AS VARCHAR) || '/r'
  || CAST(p_partkey AS VARCHAR) END AS repo,
  lower(regexp_replace(p_name || '__.x', '[-_.]+', '-', 'g')) AS package FROM part""")
def project_repo(spark, sf_dir):
    k = F.col("p_partkey")
    url = F.concat(_name("https://www.github.com/o", F.col("p_size")), _name("/r", k),
                   F.lit(".git"))
    links = F.when(k % 3 == 0, F.create_map(
        F.lit("Homepage"), F.lit("https://docs.example/x"), F.lit("Repository"), url,
    )).otherwise(F.create_map(F.lit("Docs"), F.lit("https://evilgithub.com/a/b")))
    home = F.when(k % 3 == 1, F.concat(url, F.lit("/issues"))).otherwise("https://example.com")
    return B.table(spark, sf_dir, "part").select(
        "p_partkey", U.project_repo(links, home).alias("repo"),
        T.package_name(F.concat("p_name", F.lit("__.x"))).alias("package"))


@register("registry_records", """
SELECT 'e' || CAST(c_custkey AS VARCHAR) AS plugin_id,
  'https://site.example/e' || CAST(c_custkey AS VARCHAR) || '/' AS plugin_site_url,
  'https://site.example/api/plugin/e' || CAST(c_custkey AS VARCHAR) AS plugin_api_url,
  CASE WHEN c_custkey % 2 = 0 THEN c_name END AS plugin_title
FROM customer WHERE c_custkey % 11 <> 0""")
def registry_records(spark, sf_dir):
    k = F.col("c_custkey")
    name = _name("e", k)
    raw = B.table(spark, sf_dir, "customer").select(F.to_json(F.struct(
        F.when(k % 11 == 0, F.lit(" ")).when(k % 3 == 0, name).alias("name"),
        F.when((k % 3 == 1) & (k % 11 > 0), F.concat(F.lit(" "), name)).alias("pluginId"),
        F.when((k % 3 == 2) & (k % 11 > 0), name).alias("artifactId"),
        F.when(k % 2 == 0, F.col("c_name")).alias("title"))).alias("payload"))
    rows = readers.registry_records(raw, "https://site.example/")
    return rows.select("plugin_id", "plugin_site_url", "plugin_api_url", "plugin_title")


@register("score_records", """
SELECT 'e' || CAST(c_custkey AS VARCHAR) AS entity, CAST(c_custkey % 100 AS DOUBLE) / 2 AS value
FROM customer""")
def score_records(spark, sf_dir):
    k = F.col("c_custkey")
    name = _name("e", k)
    value = ((k % 100) / 2).alias("value")
    nested = F.to_json(F.struct(F.struct(name.alias("id")).alias("plugin"), value))
    keyed = F.concat(F.lit('{"'), name, F.lit('":'), F.to_json(F.struct(value)), F.lit("}"))
    payload = (
        F.when(k % 4 == 0, F.concat(F.lit("["), F.to_json(F.struct(name.alias("pluginId"), value)),
                                    F.lit(",3]")))
        .when(k % 4 == 1, F.concat(F.lit('{"scores":['), nested, F.lit("]}")))
        .when(k % 4 == 2, keyed)
        .otherwise(F.concat(F.lit('{"items":['), F.to_json(F.struct(name.alias("id"), value)),
                            F.lit("]}"))))
    docs = B.table(spark, sf_dir, "customer").select(payload.alias("payload"))
    return readers.score_records(docs).select("entity", "value")


@register("identity_backfill", """
SELECT 'e' || CAST(c_custkey AS VARCHAR) AS entity, 'own' || CAST(c_nationkey AS VARCHAR)
  AS github_owner, 'r' || CAST(c_custkey AS VARCHAR) AS github_repo FROM customer
WHERE c_custkey % 6 <> 5""")
def identity_backfill(spark, sf_dir):
    k = F.col("c_custkey")
    full = F.concat(_name("own", F.col("c_nationkey")), F.when(k % 6 != 5, "/").otherwise("-"),
                    _name("r", k))
    index = B.table(spark, sf_dir, "customer").select(
        _name("e", k).alias("entity"), full.alias("repo_full_name"),
        F.lit("u").alias("repo_url"), F.lit("2024").alias("collected_at"))
    return readers.backfill_identities(index).select("entity", "github_owner", "github_repo")

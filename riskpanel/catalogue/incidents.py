"""Incident queries: merging, page extraction, vectors, profiles and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.catalogue import bindings as B
from riskpanel.catalogue import register
from riskpanel.functions import severity as S
from riskpanel.functions import urls as U
from riskpanel.operators import incidents as I

AS_OF = "2001-08-31"
#: Order lines that one task sorts at a time.
LINES_OF_TASK = 500_000
BARE, CANONICAL = "vendor.example", "www.vendor.example"


def _records(spark, sf_dir):
    """Orders as raw incident records; one incident per customer and month, so many duplicates."""
    key = F.col("o_orderkey")
    host = F.when(key % 3 == 0, "http://vendor.example").when(
        key % 3 == 1, "https://other.example").otherwise("https://www.vendor.example")
    day = F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd")
    url = F.concat(host, F.lit("/security/advisory/"), day, F.lit("/?utm=1#x"))
    sid = F.concat(F.lit("SECURITY-"), (key % 5).cast("string"))
    cvss = F.struct(
        F.when(key % 4 == 0, "3.1").alias("version"), F.lit(None).cast("string").alias("vector"),
        F.when(key % 2 == 0, (key % 100) / 10).alias("base_score"),
        F.lit("").alias("url"))
    vulnerability = F.struct(
        F.when(key % 7 != 0, sid).alias("security_warning_id"),
        F.when(key % 3 == 0, F.concat(url, sid)).alias("url_fragment"),
        F.when(key % 2 == 1, F.lit("high")).alias("severity_label"),
        F.lit("page").alias("severity_source"), F.when(key % 6 != 1, cvss).alias("cvss"))
    return B.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "other").otherwise("vendor").alias("source"),
        F.lit("advisory").alias("type"), F.col("o_custkey").alias("entity"),
        F.lit(None).cast("string").alias("advisory_id"), url.alias("url"),
        F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published_date"),
        F.when(key % 4 > 0, F.concat(F.lit("T"), key.cast("string"))).alias("title"),
        F.array(sid, F.lit("SECURITY-9")).alias("security_warning_ids"),
        F.when(key % 5 > 0, key % 10 == 1).alias("active_security_warning"),
        F.array(vulnerability).alias("vulnerabilities"), key.alias("seq"))


_RECORDS = """
records AS (
  SELECT o_custkey AS entity, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-01') AS advisory_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'https://www.vendor.example' WHEN 1 THEN
      'https://other.example' ELSE 'https://www.vendor.example' END || '/security/advisory/'
      || strftime(o_orderdate, '%Y-%m-01') || '/' AS url,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
         ELSE strftime(o_orderdate, '%Y-%m-01') END AS published_date,
    CASE WHEN o_orderkey % 4 > 0 THEN 'T' || CAST(o_orderkey AS VARCHAR) END AS title,
    'SECURITY-' || CAST(o_orderkey % 5 AS VARCHAR) AS sid,
    CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 10 = 1 END AS active
  FROM orders WHERE o_orderstatus <> 'P')"""


@register("incident_leaf_values", """
SELECT o_orderkey AS entity, o_orderdate::DATE AS published,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE greatest((o_orderkey % 100) / 10.0::DOUBLE,
    (o_orderkey % 70) / 7.0::DOUBLE) END AS cvss,
  CASE WHEN o_orderkey % 4 = 0 THEN 'CVE-0' WHEN o_orderkey % 3 = 0 THEN 'CVE-0,CVE-3' ELSE
    'CVE-0,CVE-3,CVE-' || CAST(o_orderkey AS VARCHAR) END AS cve_ids
FROM orders""")
def incident_leaf_values(spark, sf_dir):
    """Records whose scores and further ids stand in their vulnerabilities only."""
    key = F.col("o_orderkey")
    leaves = F.array(
        F.struct(((key % 100) / 10).alias("cvss_base_score"), F.lit(None).cast("string").alias("cvssScore"),
                 F.lit("CVE-3").alias("cve_id"), F.lit("CVE-7").alias("cve")),
        F.struct(F.lit(None).cast("double").alias("cvss_base_score"), ((key % 70) / 7).cast("string").alias("cvssScore"),
                 F.lit("").alias("cve_id"),
                 F.when(key % 3 > 0, F.concat(F.lit("CVE-"), key.cast("string"))).alias("cve")))
    records = B.table(spark, sf_dir, "orders").select(
        key.alias("plugin_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"),
        F.lit(None).cast("double").alias("cvss"), F.array(F.lit(" CVE-0")).alias("cve_ids"),
        F.when(key % 4 != 0, leaves).alias("vulnerabilities"),
        F.struct(F.lit(None).cast("double").alias("max_cvss_base_score")).alias("severity_summary"))
    rows = I.panel_incidents(records)
    return rows.withColumn("cve_ids", F.array_join("cve_ids", ","))


@register("incident_merge_flat", f"""WITH {_RECORDS}
SELECT 'vendor' AS source, 'advisory' AS type, entity, advisory_id,
  COALESCE(arg_min(url, seq) FILTER (WHERE url LIKE 'https://www.vendor.example/%'),
           arg_min(url, seq)) AS url,
  arg_min(title, seq) FILTER (WHERE title IS NOT NULL) AS title,
  min(published_date) AS published_date,
  CASE WHEN count(*) > 1 THEN COALESCE(bool_or(active), FALSE) ELSE bool_or(active) END
    AS active_security_warning,
  CASE WHEN count(*) > 1 THEN count(*) END AS merged_from_count,
  array_to_string(list_sort(list_distinct(list(sid) || ['SECURITY-9'])), ',') AS warning_ids
FROM records GROUP BY entity, advisory_id""")
def incident_merge_flat(spark, sf_dir):
    records = _records(spark, sf_dir).drop("vulnerabilities")
    merged = I.incident_stream(records, "vendor", BARE, CANONICAL)
    return merged.withColumn("warning_ids", F.array_join("security_warning_ids", ",")).drop(
        "security_warning_ids")


@register("incident_merge_nested", """
WITH r AS (
  SELECT o_custkey AS entity, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-01') AS advisory_id,
    count(*) OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m-01')) AS copies,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'SECURITY-' || CAST(o_orderkey % 5 AS VARCHAR) END AS sid,
    CASE WHEN o_orderkey % 2 = 1 THEN 'high' END AS label,
    CASE WHEN o_orderkey % 6 <> 1 THEN 1 END AS has_cvss,
    CASE WHEN o_orderkey % 6 <> 1 AND o_orderkey % 4 = 0 THEN '3.1' END AS version,
    CASE WHEN o_orderkey % 6 <> 1 AND o_orderkey % 2 = 0
      THEN CAST(o_orderkey % 100 AS DOUBLE) / 10 END AS score
  FROM orders WHERE o_orderstatus <> 'P')
SELECT entity, advisory_id, sid, arg_min(label, seq) FILTER (WHERE label IS NOT NULL) AS label,
  arg_min(version, seq) FILTER (WHERE version IS NOT NULL) AS version,
  arg_min(score, seq) FILTER (WHERE score IS NOT NULL) AS score, max(has_cvss) = 1 AS has_cvss
FROM r WHERE sid IS NOT NULL GROUP BY entity, advisory_id, sid""")
def incident_merge_nested(spark, sf_dir):
    merged = I.incident_stream(_records(spark, sf_dir), "vendor", BARE, CANONICAL)
    v = merged.select("entity", "advisory_id", F.explode("vulnerabilities").alias("v"))
    return v.select(
        "entity", "advisory_id", F.col("v.security_warning_id").alias("sid"),
        F.col("v.severity_label").alias("label"), F.col("v.cvss.version").alias("version"),
        F.col("v.cvss.base_score").alias("score"),
        F.when(F.col("v.cvss").isNotNull(), F.lit(True)).alias("has_cvss"))


_METRICS = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "NLH", "I": "LHN",
            "A": "HNL"}


def _vector(key):
    parts, step = [F.lit("CVSS:3.1")], 1
    for name, values in _METRICS.items():
        letters = F.array(*[F.lit(v) for v in values])
        digit = (F.floor(key / step) % len(values)).cast("int") + 1
        parts += [F.lit(f"/{name}:"), F.element_at(letters, digit)]
        step *= len(values)
    return F.concat(*parts)


def _vector_sql() -> str:
    out, step = ["'CVSS:3.1'"], 1
    for name, values in _METRICS.items():
        letters = ", ".join(f"'{v}'" for v in values)
        out.append(f"'/{name}:' || [{letters}][CAST((o_orderkey // {step}) % {len(values)} + 1 AS INT)]")
        step *= len(values)
    return " || ".join(out)


_SCORE_SQL = f"""
v AS (SELECT o_orderkey, {_vector_sql()} AS vector,
  [0.85, 0.62, 0.55, 0.2]::DOUBLE[] AS av, [0.77, 0.44]::DOUBLE[] AS ac,
  [0.85, 0.62]::DOUBLE[] AS ui FROM orders),
m AS (SELECT o_orderkey, vector, av[o_orderkey % 4 + 1] AS av, ac[(o_orderkey // 4) % 2 + 1] AS ac,
  (o_orderkey // 8) % 3 AS pr, ui[(o_orderkey // 24) % 2 + 1] AS ui, (o_orderkey // 48) % 2 = 1 AS ch,
  list_extract([0.0, 0.22, 0.56]::DOUBLE[], (o_orderkey // 96) % 3 + 1) AS c,
  list_extract([0.22, 0.56, 0.0]::DOUBLE[], (o_orderkey // 288) % 3 + 1) AS i,
  list_extract([0.56, 0.0, 0.22]::DOUBLE[], (o_orderkey // 864) % 3 + 1) AS a FROM v),
w AS (SELECT *, CASE WHEN ch THEN list_extract([0.85, 0.68, 0.5]::DOUBLE[], pr + 1)
                ELSE list_extract([0.85, 0.62, 0.27]::DOUBLE[], pr + 1) END AS p FROM m),
x AS (SELECT *, 8.22::DOUBLE * av * ac * p * ui AS reach,
  1.0::DOUBLE - (1.0::DOUBLE - c) * (1.0::DOUBLE - i) * (1.0::DOUBLE - a) AS loss FROM w),
y AS (SELECT *, CASE WHEN ch THEN 7.52::DOUBLE * (loss - 0.029::DOUBLE)
  - 3.25::DOUBLE * pow(loss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * loss END AS impact FROM x),
z AS (SELECT o_orderkey, vector, CASE WHEN impact <= 0 THEN 0.0::DOUBLE ELSE
  ceil(least(CASE WHEN ch THEN 1.08::DOUBLE * (impact + reach) ELSE impact + reach END, 10.0::DOUBLE)
       * 10.0::DOUBLE + 1e-10::DOUBLE) / 10.0::DOUBLE END AS score FROM y)"""
_BUCKET = """CASE WHEN score <= 0 THEN 'none' WHEN score < 4 THEN 'low' WHEN score < 7 THEN 'medium'
  WHEN score < 9 THEN 'high' ELSE 'critical' END"""


@register("cvss_score", f"""WITH {_SCORE_SQL}
SELECT o_orderkey, vector, score, {_BUCKET} AS severity,
  CAST(CASE WHEN score = 0 THEN 0 WHEN score < 4 THEN 1 WHEN score < 7 THEN 3 WHEN score < 9 THEN 6
       ELSE 10 END AS BIGINT) AS bonus FROM z""")
def cvss_score(spark, sf_dir):
    scored = B.table(spark, sf_dir, "orders").select(
        "o_orderkey", _vector(F.col("o_orderkey")).alias("vector")).withColumn(
        "score", S.cvss3_base_score(F.col("vector")))
    return B.rounded(scored.select("*", S.severity_label(F.col("score")).alias("severity"),
                                   S.severity_bonus(F.col("score")).alias("bonus")))


@register("severity_distribution", f"""WITH {B.CUSTOMER_INCIDENTS_SQL},
i AS (SELECT {_BUCKET.replace('score', 'cvss')} AS severity, count(*) AS n_instances
      FROM incidents GROUP BY 1),
e AS (SELECT {_BUCKET.replace('score', 'm')} AS severity, count(*) AS n_entities
      FROM (SELECT entity, max(cvss) AS m FROM incidents GROUP BY entity) GROUP BY 1)
SELECT i.severity, n_instances, COALESCE(n_entities, 0) AS n_entities
FROM i LEFT JOIN e ON e.severity = i.severity""")
def severity_distribution(spark, sf_dir):
    return I.severity_distribution(B.customer_incidents(spark, sf_dir))


@register("worst_entities", f"""WITH {B.CUSTOMER_INCIDENTS_SQL}
SELECT entity, max(cvss) AS max_cvss FROM incidents GROUP BY entity
ORDER BY max_cvss DESC, entity LIMIT 10""")
def worst_entities(spark, sf_dir):
    return I.worst_entities(B.customer_incidents(spark, sf_dir))


@register("severity_bucket", f"""WITH {B.CUSTOMER_INCIDENTS_SQL}
SELECT entity, published, cvss, {_BUCKET.replace('score', 'cvss')} AS severity FROM incidents""")
def severity_bucket(spark, sf_dir):
    return B.customer_incidents(spark, sf_dir).select(
        "entity", "published", "cvss", S.severity_label(F.col("cvss")).alias("severity"))


@register("incident_profile", f"""WITH {B.CUSTOMER_INCIDENTS_SQL}
SELECT i.entity, TRUE AS advisories_present, count(*) AS advisory_count,
  max(published) AS advisory_latest_published_date, min(published) AS advisory_first_published_date,
  max(cvss) AS advisory_max_cvss, CAST(0 AS BIGINT) AS advisory_active_warning_count,
  date_diff('day', min(published), DATE '{AS_OF}') AS advisory_days_since_first,
  date_diff('day', max(published), DATE '{AS_OF}') AS advisory_days_since_latest,
  date_diff('day', min(published), max(published)) AS advisory_span_days,
  count(*) FILTER (WHERE date_diff('day', published, DATE '{AS_OF}') <= 365) AS advisory_count_last_365d,
  count(*) FILTER (WHERE date_diff('day', published, DATE '{AS_OF}') <= 90) AS advisory_count_last_90d,
  count(*) FILTER (WHERE cvss >= 7) AS advisory_cvss_ge_7_count,
  round(avg(cvss), 9) AS advisory_mean_cvss,
  CAST(sum(CASE WHEN cvss = 0 THEN 0 WHEN cvss < 4 THEN 1 WHEN cvss < 7 THEN 3 WHEN cvss < 9 THEN 6
           ELSE 10 END) AS BIGINT) AS advisory_severity_bonus,
  max(c.n) AS advisory_cve_count
FROM incidents i JOIN (SELECT entity, count(DISTINCT cve) AS n FROM
  (SELECT entity, unnest(cve_ids) AS cve FROM incidents) GROUP BY entity) c ON c.entity = i.entity
GROUP BY i.entity""")
def incident_profile(spark, sf_dir):
    return B.rounded(I.incident_profile(B.customer_incidents(spark, sf_dir), AS_OF))


@register("url_canonical", """
WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace(t, '^http://', 'https://'),
  '^https://blog[.]tionsh[.]example[.]net(/|$)', 'https://www.tionsh.example.net' || chr(92) || '1')
    AS canonical, split_part(t, '/', 3) AS host FROM u""")
def url_canonical(spark, sf_dir):
    url = F.col("url")
    return B.table(spark, sf_dir, "pages").select(
        "page_id", U.canonical_url(url, "blog.tionsh.example.net", "www.tionsh.example.net")
        .alias("canonical"), U.url_host(url).alias("host"))


def _pages(spark, sf_dir):
    """Pages as advisory pages: the whole page text, with sections about two warning ids."""
    key = F.col("page_id")
    sid = F.concat(F.lit("SECURITY-"), (key % 50).cast("string"))
    sections = F.concat(
        F.lit("<h2>"), sid, F.lit(" is considered "),
        F.when(key % 2 == 0, "High").otherwise("low"), F.lit(
            '.</h2><a href="https://www.first.org/cvss/calculator/3.1#'), _vector(key * 37),
        F.lit('">score</a> SECURITY-77 text <a href="https://www.first.org/cvss/calculator/3.0#'),
        _vector(key * 41), F.lit('">s</a>'))
    return B.table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("http://vendor.example/security/advisory/2020-01-01/?p="),
                            key.cast("string")).alias("raw_url"),
        F.concat(F.lit("https://vendor.example/p"), key.cast("string")).alias("url"),
        F.concat("html", sections).alias("html"))


@register("page_extract", f"""
WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS t, page_id * 37 AS o_orderkey FROM pages)
SELECT page_id, trim(regexp_replace(t, '[ \t\n\r\f]+', ' ', 'g')) AS title,
  'SECURITY-' || CAST(page_id % 50 AS VARCHAR) AS sid,
  CASE WHEN page_id % 2 = 0 THEN 'high' ELSE 'low' END AS label,
  {_vector_sql()} AS vector, '3.1' AS version FROM p""")
def page_extract(spark, sf_dir):
    fields = I.page_fields(_pages(spark, sf_dir))
    sid = F.map_keys("labels")[0]
    return fields.select(
        "page_id", "title", sid.alias("sid"), F.col("labels")[sid].alias("label"),
        F.col("scores")[sid]["vector"].alias("vector"),
        F.col("scores")[sid]["version"].alias("version"))


@register("incidents_from_pages", f"""
WITH {_SCORE_SQL.replace('FROM orders)', 'FROM (SELECT DISTINCT page_id * 37 AS o_orderkey FROM pages))')},
wn AS (SELECT c_custkey AS entity, c_custkey % (SELECT count(*) FROM pages) AS page_id FROM customer)
SELECT wn.entity, 'https://www.vendor.example/p' || CAST(wn.page_id AS VARCHAR) AS url,
  wn.entity % 3 = 0 AS active_security_warning,
  'SECURITY-' || CAST(wn.page_id % 50 AS VARCHAR) AS warning_ids,
  CASE WHEN wn.page_id % 2 = 0 THEN 'high' ELSE 'low' END AS max_severity_label,
  z.score AS max_cvss_base_score
FROM wn JOIN z ON z.o_orderkey = wn.page_id * 37""")
def incidents_from_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    n = pages.agg(F.count(F.lit(1)).alias("n_pages"))
    # a one-row aggregate joined on a constant key, the page count every customer is spread over
    customers = B.customers(spark, sf_dir).withColumn("one", F.lit(1)).join(
        n.withColumn("one", F.lit(1)), "one")
    page = F.col("entity") % F.col("n_pages")
    warnings = customers.select(
        "entity", F.concat(F.lit("SECURITY-"), (page % 50).cast("string")).alias("warning_id"),
        F.concat(F.lit("http://vendor.example/p"), page.cast("string"), F.lit("#a")).alias("url"),
        (F.col("entity") % 3 == 0).alias("active"))
    rows = I.incidents_from_pages(warnings, pages, "vendor", BARE, CANONICAL, "page")
    return rows.select(
        "entity", "url", "active_security_warning",
        F.array_join("security_warning_ids", ",").alias("warning_ids"),
        F.col("severity_summary.max_severity_label").alias("max_severity_label"),
        F.col("severity_summary.max_cvss_base_score").alias("max_cvss_base_score"))


@register("osv_explode", f"""WITH {_SCORE_SQL},
r AS (SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate, z.score,
        'P-' || CAST(l_partkey % 300 AS VARCHAR) AS package,
        'OSV-' || CAST(l_orderkey % 4000 AS VARCHAR) AS id
      FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey JOIN z ON z.o_orderkey = l_orderkey
      WHERE l_linenumber % 2 = 1)
SELECT lower(package) AS package_id, id AS advisory_id,
  strftime(o_orderdate, '%Y-%m-%d') AS published_date,
  'CVE-' || CAST(l_orderkey AS VARCHAR) AS cve_ids,
  CASE WHEN l_orderkey % 3 > 0 THEN score END AS cvss, 'osv' AS source
FROM (SELECT *, row_number() OVER (PARTITION BY package, id ORDER BY l_orderkey) AS rn FROM r)
WHERE rn = 1""")
def osv_explode(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    lines = B.table(spark, sf_dir, "lineitem")
    affected = F.struct(F.struct(
        F.when(F.col("l_linenumber") % 2 == 1, "PyPI").otherwise("npm").alias("ecosystem"),
        F.concat(F.lit("P_."), (F.col("l_partkey") % 300).cast("string")).alias("name"))
        .alias("package"))
    # both sides meet in tasks of a fixed number of lines, whatever the size of the tables
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_OF_TASK))
    orders, lines = orders.repartition(parts, "o_orderkey"), lines.repartition(parts, "l_orderkey")
    # an order has few lines, so the list of its affected packages is small
    per_order = lines.groupBy("l_orderkey").agg(F.collect_list(affected).alias("affected"))
    key = F.col("o_orderkey")
    records = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey).select(
        F.concat(F.lit("OSV-"), (key % 4000).cast("string")).alias("id"), key.alias("seq"),
        F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("published"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("modified"),
        F.array(F.concat(F.lit("cve-"), key.cast("string")), F.lit("GHSA-1")).alias("aliases"),
        F.array(F.concat(F.lit("CVE-"), key.cast("string"))).alias("related"),
        F.array(F.struct(F.when(key % 3 > 0, "CVSS_V3").otherwise("CVSS_V2").alias("type"),
                         _vector(key).alias("score"))).alias("severity"),
        F.struct(F.lit("HIGH").alias("severity")).alias("database_specific"), "affected")
    rows = I.explode_osv(records, "PyPI", "osv", parts=parts)
    return rows.select("package_id", "advisory_id", "published_date",
                       F.array_join("cve_ids", ",").alias("cve_ids"), "cvss", "source")


@register("nested_severity", """
WITH nested AS (
  SELECT l_orderkey AS k, max(TRY_CAST(CASE WHEN l_partkey % 7 = 0 THEN 'n/a' ELSE CAST(CAST(l_partkey % 100 AS DOUBLE) / 10
    AS VARCHAR) END AS DOUBLE)) AS s FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1),
rec AS (SELECT o_custkey AS entity, COALESCE(s, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 90 AS DOUBLE) / 10 END) AS score
  FROM orders LEFT JOIN nested ON k = o_orderkey),
p AS (SELECT *, CASE WHEN score IS NULL OR score = 0 THEN 0 WHEN score < 4 THEN 1 WHEN score < 7 THEN 3 WHEN score < 9 THEN 6
  ELSE 10 END AS points FROM rec)
SELECT entity, count(*) AS record_count, max(score) AS max_cvss, CAST(sum(points) AS BIGINT) AS severity_bonus,
  CASE WHEN max(score) <= 0 THEN 'none' WHEN max(score) < 4 THEN 'low' WHEN max(score) < 7 THEN 'medium'
    WHEN max(score) < 9 THEN 'high' WHEN max(score) IS NOT NULL THEN 'critical' END AS severity
FROM p GROUP BY entity""")
def nested_severity(spark, sf_dir):
    """Records with nested vulnerabilities: order lines are the vulnerabilities of their order."""
    part, order = F.col("l_partkey"), F.col("o_orderkey")
    score = F.when(part % 7 == 0, "n/a").otherwise(((part % 100) / 10).cast("string"))
    lines = B.table(spark, sf_dir, "lineitem").where(part % 3 == 0).groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.struct(score.alias("base_score")).alias("cvss"))).alias("vulnerabilities"))
    orders = B.table(spark, sf_dir, "orders").select(
        order, F.col("o_custkey").alias("entity"), F.when(order % 5 > 0, ((order % 90) / 10).cast("string")).alias("summary_score"))
    records = orders.join(lines, F.col("l_orderkey") == order, "left")
    return B.rounded(I.nested_severity(records))

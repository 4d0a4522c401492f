"""Incident records: page extraction, merging, profiles and severity distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.functions import dates as D
from riskpanel.functions import numbers as N
from riskpanel.functions import severity as S
from riskpanel.functions import text as T
from riskpanel.functions import urls as U

MERGE_KEYS = ("source", "type", "entity", "advisory_id")
CVSS_FIELDS = ("version", "vector", "base_score", "url")


def normalize_incidents(records: DataFrame, bare_host: str, canonical_host: str) -> DataFrame:
    """Canonical URLs, and id and date derived from the URL where they are missing."""
    url = T.blank_to_null(U.canonical_url(F.col("url"), bare_host, canonical_host))
    derived = F.date_format(U.date_from_advisory_url(url), "yyyy-MM-dd")
    return records.withColumns({
        "url": F.coalesce(url, F.col("url")),
        "advisory_id": F.coalesce(T.blank_to_null(F.col("advisory_id")), derived),
        "published_date": F.coalesce(T.blank_to_null(F.col("published_date")), derived),
    })


def _earliest(value: Column, order: Column, when: Column) -> Column:
    """Value of the first record, in input order, that satisfies the condition."""
    return F.min_by(value, F.when(when, order))


def _filled(value: Column) -> Column:
    return value.isNotNull() & (value.cast("string") != "")


def merge_flat(records: DataFrame, canonical_host: str, order: str = "seq") -> DataFrame:
    """One row per (source, type, entity, incident id) out of near-duplicates.

    Ids are united in their own exploded branch, so copies of a record collapse map-side and no
    list of copies is ever built.
    """
    keyed = records.withColumns(
        {k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in MERGE_KEYS if k != "entity"}
    )
    seq, url, title = F.col(order), F.col("url"), F.col("title")
    active = F.bool_or("active_security_warning")
    copies = F.count(F.lit(1))
    settled = {*MERGE_KEYS, order, "url", "title", "published_date", "active_security_warning",
               "security_warning_ids", "vulnerabilities"}
    others = [c for c in records.columns if c not in settled]
    flat = keyed.groupBy(*MERGE_KEYS).agg(
        F.coalesce(
            _earliest(url, seq, U.url_host(url) == canonical_host),
            _earliest(url, seq, _filled(url)),
        ).alias("url"),
        _earliest(title, seq, _filled(title)).alias("title"),
        F.min(F.when(_filled(F.col("published_date")), F.col("published_date")))
        .alias("published_date"),
        F.when(copies > 1, N.as_flag(active)).otherwise(active).alias("active_security_warning"),
        F.when(copies > 1, copies).alias("merged_from_count"),
        *[F.min_by(F.col(c), seq).alias(c) for c in others],
    )
    ids = (
        keyed.select(*MERGE_KEYS, F.explode("security_warning_ids").alias("warning_id"))
        .groupBy(*MERGE_KEYS)
        .agg(F.array_sort(F.collect_set("warning_id")).alias("security_warning_ids"))
    )
    empty = F.array().cast("array<string>")
    return flat.join(ids, list(MERGE_KEYS), "left").withColumn(
        "security_warning_ids", F.coalesce("security_warning_ids", empty)
    )


def merge_vulnerabilities(records: DataFrame, order: str = "seq") -> DataFrame:
    """Vulnerabilities per incident: entries without a warning id are dropped; for merged
    incidents one entry per warning id, empty fields filled from later records, sorted."""
    keyed = records.withColumns(
        {k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in MERGE_KEYS if k != "entity"}
    )
    copies = keyed.groupBy(*MERGE_KEYS).agg(F.count(F.lit(1)).alias("copies"))
    exploded = keyed.select(
        *MERGE_KEYS, F.col(order).alias("seq"), F.posexplode("vulnerabilities").alias("pos", "v")
    ).where(_filled(F.col("v.security_warning_id")))
    with_copies = exploded.join(copies, list(MERGE_KEYS))
    # within one record the last entry of an id counts, across records the first one
    rank = F.struct(F.col("seq"), -F.col("pos"))
    v = {c: F.col(f"v.{c}") for c in ("url_fragment", "severity_label", "severity_source")}
    cvss = {c: F.col(f"v.cvss.{c}") for c in CVSS_FIELDS}

    def first(value: Column) -> Column:
        return _earliest(value, rank, _filled(value))

    in_record = Window.partitionBy(*MERGE_KEYS, "seq", F.col("v.security_warning_id"))
    repeated = with_copies.where(F.col("copies") > 1).withColumn("last", F.max("pos").over(in_record))
    merged = (
        repeated.where("pos = last")
        .groupBy(*MERGE_KEYS, F.col("v.security_warning_id").alias("sid"))
        .agg(
            *[first(v[c]).alias(c) for c in ("url_fragment", "severity_label")],
            F.min_by(v["severity_source"], rank).alias("severity_source"),
            F.bool_or(F.col("v.cvss").isNotNull()).alias("has_cvss"),
            *[first(value).alias(f"cvss_{c}") for c, value in cvss.items()],
        )
        .select(
            *MERGE_KEYS, F.lit(0).alias("seq"), F.lit(0).alias("pos"), F.col("sid"),
            F.struct(
                F.col("sid").alias("security_warning_id"), "url_fragment", "severity_label",
                "severity_source",
                F.when(F.col("has_cvss"), F.struct(
                    *[F.col(f"cvss_{c}").alias(c) for c in CVSS_FIELDS])).alias("cvss"),
            ).alias("v"),
        )
    )
    single = with_copies.where(F.col("copies") == 1).select(
        *MERGE_KEYS, "seq", "pos", F.lit("").alias("sid"),
        F.struct(
            F.col("v.security_warning_id").alias("security_warning_id"),
            *[value.alias(c) for c, value in v.items()],
            F.when(F.col("v.cvss").isNotNull(), F.struct(
                *[value.alias(c) for c, value in cvss.items()])).alias("cvss"),
        ).alias("v"),
    )
    # one entry per distinct warning id of an incident is left, which is the result itself
    ordered = F.array_sort(F.collect_list(F.struct("sid", "pos", "v")))
    return (
        merged.unionByName(single).groupBy(*MERGE_KEYS).agg(ordered.alias("o"))
        .select(*MERGE_KEYS, F.transform("o", lambda x: x["v"]).alias("vulnerabilities"))
    )


def incident_stream(
    records: DataFrame, source: str, bare_host: str, canonical_host: str,
    kind: str = "advisory", order: str = "seq",
) -> DataFrame:
    """Deduplicated incidents of one source and record type."""
    kept = records.where((F.col("source") == source) & (F.col("type") == kind))
    clean = normalize_incidents(kept, bare_host, canonical_host)
    flat = merge_flat(clean, canonical_host, order)
    if "vulnerabilities" not in records.columns:
        return flat
    return flat.join(merge_vulnerabilities(clean, order), list(MERGE_KEYS), "left")


def page_fields(pages: DataFrame) -> DataFrame:
    """Title, severity labels and vectors per warning id of advisory pages (url, html)."""
    html = F.col("html")
    labels = U.section_severities(html)
    chunks = U.security_sections(html)

    def score(chunk: Column) -> Column:
        link = U.calculator_url(chunk)
        vector = U.vector_from_url(link)
        return F.struct(
            U.vector_version(vector).alias("version"), vector.alias("vector"),
            S.cvss3_base_score(vector).alias("base_score"), link.alias("url"))

    longest = F.aggregate(
        chunks, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda m, c: F.when(
            F.coalesce(F.length(F.try_element_at(m, c["security_id"])), F.lit(-1))
            < F.length(c["chunk"]),
            F.map_concat(F.map_filter(m, lambda k, _: k != c["security_id"]),
                         F.create_map(c["security_id"], c["chunk"])),
        ).otherwise(m),
    )
    last_label = F.aggregate(
        labels, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["security_id"]),
                                  F.create_map(x["security_id"], x["label"])),
    )
    scored = F.transform_values(longest, lambda _, chunk: score(chunk))
    return pages.select(
        *[c for c in pages.columns if c != "html"], U.page_title(html).alias("title"),
        last_label.alias("labels"),
        F.map_filter(scored, lambda _, s: s["vector"].isNotNull()).alias("scores"))


def incidents_from_pages(
    warnings: DataFrame, pages: DataFrame, source: str, bare_host: str, canonical_host: str,
    label_source: str,
) -> DataFrame:
    """Incident records of entities: their warnings matched to advisory pages by URL.

    ``warnings`` holds entity, warning_id, url and active.
    """
    url = U.canonical_url(F.col("url"), bare_host, canonical_host)
    grouped = (
        warnings.where(_filled(F.col("url"))).withColumn("url", url)
        .groupBy("entity", "url")
        .agg(F.array_sort(F.collect_set("warning_id")).alias("security_warning_ids"),
             N.as_flag(F.bool_or("active")).alias("active_security_warning"))
    )
    joined = grouped.join(page_fields(pages.withColumn("url", url)), "url")

    def build(wid: Column) -> Column:
        score = F.try_element_at(F.col("scores"), wid)
        given = F.try_element_at(F.col("labels"), wid)
        derived = S.severity_label(score["base_score"])
        use_derived = given.isNull() & derived.isNotNull()
        return F.struct(
            wid.alias("security_warning_id"), F.concat(F.col("url"), F.lit("#"), wid)
            .alias("url_fragment"), F.coalesce(given, derived).alias("severity_label"),
            F.when(use_derived, "cvss_v3_derived").otherwise(label_source)
            .alias("severity_source"), score.alias("cvss"))

    published = F.date_format(U.date_from_advisory_url(F.col("url")), "yyyy-MM-dd")
    full = joined.withColumn("vulnerabilities", F.transform("security_warning_ids", build))
    return full.select(
        F.lit(source).alias("source"), F.lit("advisory").alias("type"),
        published.alias("advisory_id"), "entity", "url", published.alias("published_date"),
        "title", "security_warning_ids", "active_security_warning", "vulnerabilities",
        F.struct(
            S.max_severity_label(F.transform("vulnerabilities", lambda v: v["severity_label"]))
            .alias("max_severity_label"),
            F.array_max(F.transform("vulnerabilities", lambda v: v["cvss"]["base_score"]))
            .alias("max_cvss_base_score"),
        ).alias("severity_summary"))


def panel_incidents(records: DataFrame, entity: str = "plugin_id") -> DataFrame:
    """Landed incident records as the panel input: entity, published, cvss, cve_ids.

    Scores and ids may stand in the record, its summary or its vulnerabilities, under any of the names
    that sources use; fields that the schema lacks are passed over. Nested score structs do not count
    here; their score arrives through the summary.
    """
    summary = F.array(*[
        F.col(f"severity_summary.{c}").cast("string")
        for c in _flat_fields(records, "severity_summary", ("max_cvss_base_score", "cvss", "max_cvss"))])
    scores = [
        F.transform(F.col(f"vulnerabilities.{c}"), lambda x: x.cast("string"))
        for c in _flat_fields(records, "vulnerabilities", ("cvss", "cvss_base_score", "cvssScore"))]
    no_text = F.array().cast("array<string>")
    leaf_scores = F.concat(no_text, *[F.coalesce(x, no_text) for x in scores])
    names = _flat_fields(records, "vulnerabilities", ("cve_id", "cve"))
    leaf_ids = F.transform("vulnerabilities", lambda v: F.coalesce(
        *[F.when(v[c] != "", v[c]) for c in names])) if names else None
    return records.select(
        F.col(entity).alias("entity"), D.iso_date(F.col("published_date")).alias("published"),
        S.flat_record_score(F.col("cvss"), summary, leaf_scores).alias("cvss"),
        S.record_cve_ids(F.col("cve_ids"), leaf_ids).alias("cve_ids"))


def _flat_fields(records: DataFrame, column: str, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that a struct column, or the structs of an array column, hold as plain values."""
    kind = records.schema[column].dataType
    kind = getattr(kind, "elementType", kind)
    return [f.name for f in kind.fields if f.name in names and not hasattr(f.dataType, "fields")]


def explode_osv(
    records: DataFrame, ecosystem: str, source: str, order: str = "seq", parts: int | None = None
) -> DataFrame:
    """One row per affected package of an ecosystem, first record per (package, incident).

    Rows are sorted by key to find the first record; ``parts`` deals them to that many tasks, so that none sorts more
    as the input grows. Without it Spark's own number of shuffle partitions holds.
    """
    day = F.coalesce(_osv_day(F.col("published")), _osv_day(F.col("modified")))
    v3 = F.filter("severity", lambda s: s["type"].isin("CVSS_V3", "CVSS_V3_1"))
    scores = F.filter(F.transform(v3, lambda s: S.cvss3_base_score(s["score"])),
                      lambda x: x.isNotNull())
    score = F.get(scores, F.lit(0))
    label = F.coalesce(
        S.severity_label(score), F.lower(T.blank_to_null(F.col("database_specific.severity"))))
    rows = (
        records.where(day.isNotNull())
        .select(
            F.col(order).alias("seq"), F.col("id").alias("advisory_id"),
            F.date_format(day, "yyyy-MM-dd").alias("published_date"),
            S.cve_ids_from_aliases(F.col("aliases"), F.col("related")).alias("cve_ids"),
            score.alias("cvss"), label.alias("severity"), F.posexplode("affected").alias("p", "a"))
        .where((F.col("a.package.ecosystem") == ecosystem) & _filled(F.col("a.package.name")))
        .select(F.lit(source).alias("source"), "advisory_id",
                T.package_name(F.col("a.package.name")).alias("package_id"), "published_date",
                "cve_ids", "cvss", "severity", F.struct("seq", "p").alias("input_order"))
    )
    keys = ["package_id", "advisory_id"]
    rest = [c for c in rows.columns if c not in (*keys, "input_order")]
    if parts is not None:
        rows = rows.repartition(parts, *keys)
    return rows.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.col("input_order")).alias("r")).select(*keys, "r.*")


def _osv_day(text: Column) -> Column:
    return D.iso_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1))


def incident_profile(incidents: DataFrame, as_of: str) -> DataFrame:
    """Current-point incident measures per entity, relative to an explicit day."""
    day, today = F.col("published"), F.to_date(F.lit(as_of))
    warned = "active_warnings" in incidents.columns
    base = incidents.groupBy("entity").agg(
        F.lit(True).alias("advisories_present"),
        F.count(F.lit(1)).alias("advisory_count"),
        F.max(day).alias("advisory_latest_published_date"),
        F.min(day).alias("advisory_first_published_date"),
        F.max("cvss").alias("advisory_max_cvss"),
        (F.sum("active_warnings") if warned else F.lit(0)).alias("advisory_active_warning_count"),
        F.datediff(today, F.min(day)).alias("advisory_days_since_first"),
        F.datediff(today, F.max(day)).alias("advisory_days_since_latest"),
        F.datediff(F.max(day), F.min(day)).alias("advisory_span_days"),
        F.count_if(F.datediff(today, day) <= 365).alias("advisory_count_last_365d"),
        F.count_if(F.datediff(today, day) <= 90).alias("advisory_count_last_90d"),
        F.count_if(F.col("cvss") >= 7.0).alias("advisory_cvss_ge_7_count"),
        F.avg("cvss").alias("advisory_mean_cvss"),
        F.sum(S.severity_bonus(F.col("cvss"))).alias("advisory_severity_bonus"),
    )
    cves = (
        incidents.select("entity", F.explode("cve_ids").alias("cve")).distinct()
        .groupBy("entity").agg(F.count(F.lit(1)).alias("advisory_cve_count"))
    )
    return base.join(cves, "entity", "left").withColumn(
        "advisory_cve_count", F.coalesce("advisory_cve_count", F.lit(0)))


def severity_distribution(incidents: DataFrame) -> DataFrame:
    """Scored instances and entities (by their worst score) per severity bucket."""
    bucket = S.severity_label(F.col("cvss"))
    scored = incidents.where(F.col("cvss").isNotNull())
    instances = scored.groupBy(bucket.alias("severity")).agg(F.count(F.lit(1)).alias("n_instances"))
    worst = scored.groupBy("entity").agg(F.max("cvss").alias("cvss"))
    entities = worst.groupBy(bucket.alias("severity")).agg(F.count(F.lit(1)).alias("n_entities"))
    return instances.join(entities, "severity", "left").withColumn(
        "n_entities", F.coalesce("n_entities", F.lit(0)))


def worst_entities(incidents: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` entities with the highest single score."""
    return (
        incidents.where(F.col("cvss").isNotNull()).groupBy("entity")
        .agg(F.max("cvss").alias("max_cvss")).orderBy(F.desc("max_cvss"), "entity").limit(n)
    )


def nested_severity(records: DataFrame, key: str = "entity") -> DataFrame:
    """Worst score, its label and the points of all records per entity, for records with nested scores.

    ``vulnerabilities`` hold ``cvss.base_score``; the record's ``summary_score`` counts only where none of them parses.
    """
    scored = records.select(key, S.nested_record_score(F.col("vulnerabilities"), F.col("summary_score")).alias("score"))
    worst = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("record_count"), F.max("score").alias("max_cvss"),
        F.sum(S.severity_bonus(F.col("score"))).alias("severity_bonus"))
    return worst.withColumn("severity", S.severity_label(F.col("max_cvss")))

"""Entity identity: alias maps, their transitive resolution, and repositories of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.functions import text as T
from riskpanel.functions import urls as U
from riskpanel.session import materialize

# --- fixed values: payload fields that list former names ---
ALIAS_FIELDS = (
    "aliases", "alias_ids", "historical_plugin_ids", "historical_ids", "previous_names",
    "previousNames", "former_names", "formerNames", "legacy_names", "legacyNames",
)
# which source decides when several name the same alias
SOURCE_RANK = {"file": 0, "registry": 1, "snapshot": 2}


def _listed(values: list[Column]) -> Column:
    """Names in field values, in order; a value is a text or a JSON list."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)), empty) for v in values]
    trimmed = F.transform(F.concat(*lists), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def alias_values(payload: Column, prefix: str = "$") -> Column:
    """All former names in a JSON document, in field order; a field is a text or a list."""
    return _listed([F.get_json_object(payload, f"{prefix}.{field}") for field in ALIAS_FIELDS])


def alias_rows(documents: DataFrame, source: str) -> DataFrame:
    """Alias candidates of registry or snapshot documents (entity, payload, seq).

    Documents are dealt out before they are parsed, as a short file is one task. Each is parsed once for all fields, and a
    snapshot once more for those of its API part.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("entity", "seq", "payload").repartition(parts)
    sides = [("payload", "own")]
    if source == "snapshot":
        rows = rows.withColumn("api", F.get_json_object("payload", "$.plugin_api"))
        sides.append(("api", "inner"))
    values: list[str] = []
    for column, prefix in sides:
        names = [f"{prefix}{i}" for i in range(len(ALIAS_FIELDS))]
        rows = rows.select("*", F.json_tuple(column, *ALIAS_FIELDS).alias(*names))
        values += names
    return rows.select(
        F.trim("entity").alias("canonical"), F.lit(source).alias("source"), "seq",
        F.posexplode(_listed([F.col(v) for v in values])).alias("pos", "alias"),
    )


def build_alias_map(candidates: DataFrame) -> DataFrame:
    """One canonical name per alias: the alias file decides, then registry, then snapshots.

    Within the file the last mention wins, within the other sources the first one.
    """
    ranks = [F.lit(x) for item in SOURCE_RANK.items() for x in item]
    rank = F.try_element_at(F.create_map(*ranks), F.col("source"))
    sign = F.when(F.col("source") == "file", -1).otherwise(1)
    order = F.struct(rank, F.col("seq") * sign, F.col("pos") * sign)
    named = (T.blank_to_null(F.col("alias")).isNotNull()
             & T.blank_to_null(F.col("canonical")).isNotNull()
             & (F.col("alias") != F.col("canonical")))
    return candidates.where(named).groupBy("alias").agg(
        F.min_by("canonical", order).alias("canonical"))


HOPS_PER_ROUND = 3


def _follow(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends of all pointers that end, and those that never do, each pointing at a member of a cycle.

    A round lets each open pointer follow the pointers of its targets several times, so reach grows by that factor plus
    one. Pointers that end leave the loop: only those that ended in a round are looked up in the next one, because
    whatever points at them ends in the round itself. A path that ends has some name that ends in every round, so when
    none does, all open pointers lead into cycles; they are on them once they have gone as many steps as there are
    open names.
    """
    active = edges.select(F.col("alias").alias("node"), F.col("canonical").alias("target"))
    recent = active.limit(0)
    ended, reach = [], 1
    while True:
        known = active.withColumn("final", F.lit(False)).unionByName(recent.withColumn("final", F.lit(True)))
        step = known.select(F.col("node").alias("target"), F.col("target").alias("further"), "final")
        moved = active.select("node", "target", F.lit(False).alias("done"))
        for _ in range(HOPS_PER_ROUND):
            # a target without a pointer of its own is an end; finished pointers stay as they are
            met = moved.withColumnRenamed("target", "own").join(step, (F.col("own") == F.col("target")) & ~F.col("done"), "left")
            moved = met.select(
                "node", F.coalesce("further", "own").alias("target"),
                (F.col("done") | F.coalesce("final", F.lit(True))).alias("done"))
        moved = materialize(moved, "alias-round")
        done = moved.where("done").select("node", "target")
        last = recent.unionByName(done).select(F.col("node").alias("target"), F.col("target").alias("final"))
        settled = materialize(
            moved.where("NOT done").select("node", "target").join(last, "target", "left").select(
                "node", F.coalesce("final", "target").alias("target"), F.col("final").isNotNull().alias("done")),
            "alias-settled")
        recent = settled.where("done").select("node", "target")
        ended += [done, recent]
        active = settled.where("NOT done").select("node", "target")
        reach *= HOPS_PER_ROUND + 1
        left = active.count()
        if not left or (left <= reach and done.isEmpty() and recent.isEmpty()):
            break
    ends = ended[0]
    for more in ended[1:]:
        ends = ends.unionByName(more)
    return ends, active


def resolve_aliases(alias_map: DataFrame) -> DataFrame:
    """Final canonical name of every alias.

    The reach of pointers multiplies each round, so a chain of n names needs log n rounds of
    equi-joins. Names that lead into a cycle resolve to the first cycle member on their path;
    cycle members to themselves.
    """
    edges = materialize(
        alias_map.where(F.col("alias") != F.col("canonical")).select("alias", "canonical"),
        "alias-edges",
    )
    ends, endless = _follow(edges)
    if not endless.isEmpty():
        members = materialize(endless.select(F.col("target").alias("alias")).distinct(), "alias-cycles")
        tails = edges.join(endless.select(F.col("node").alias("alias")), "alias", "left_semi").join(members, "alias", "left_anti")
        loops = members.select(F.col("alias").alias("node"), F.col("alias").alias("target"))
        ends = ends.unionByName(loops)
        tails = materialize(tails, "alias-tails")
        if not tails.isEmpty():
            ends = ends.unionByName(_follow(tails)[0])
    return ends.select(F.col("node").alias("alias"), F.col("target").alias("canonical"))


def canonicalize(df: DataFrame, resolved: DataFrame, column: str = "entity") -> DataFrame:
    """Replace a name column by its canonical names; unknown names stay as they are."""
    names = resolved.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_name"))
    trimmed = F.trim(F.col(column))
    return (
        df.join(names, trimmed == F.col("_alias"), "left")
        .withColumn(column, F.coalesce("_name", trimmed, F.col(column)))
        .drop("_alias", "_name")
    )


def alias_candidates(entities: DataFrame, alias_map: DataFrame, resolved: DataFrame) -> DataFrame:
    """Names to look an entity up by: its canonical name first, then its direct aliases.

    Rows instead of one list per entity; ``is_alias`` then name gives the lookup order.
    """
    canonical = canonicalize(entities.select("entity").distinct(), resolved).distinct()
    own = canonical.select("entity", F.col("entity").alias("candidate"), F.lit(0).alias("is_alias"))
    direct = canonical.join(alias_map, canonical.entity == alias_map.canonical).select(
        "entity", F.col("alias").alias("candidate"), F.lit(1).alias("is_alias"))
    return own.unionByName(direct)


def scm_url(value: Column) -> Column:
    """URL of a source-control field that is a text, or a document with ``link`` or ``url``."""
    trimmed = F.trim(value)
    document = trimmed.startswith("{")
    inside = T.first_non_blank(F.get_json_object(trimmed, "$.link"),
                               F.get_json_object(trimmed, "$.url"))
    return F.when(document, inside).otherwise(T.blank_to_null(trimmed))


def snapshot_repo_url(repo_url: Column, scm: Column, api_scm: Column) -> Column:
    return F.coalesce(scm_url(repo_url), scm_url(scm), scm_url(api_scm))


def resolve_repos(
    registry: DataFrame, snapshots: DataFrame, fallback_owner: str | None = None
) -> DataFrame:
    """Repository of each registry entity: from its snapshot, else by naming convention."""
    urls = snapshots.select(
        "entity", snapshot_repo_url(F.col("repo_url"), F.col("scm_url"), F.col("plugin_api.scm"))
        .alias("url"))
    parsed = U.repo_full_name(F.col("url"))
    if fallback_owner is not None:
        guess = F.get(T.fallback_repo_names(F.col("entity"), fallback_owner), F.lit(0))
        parsed = F.coalesce(parsed, guess)
    known = registry.where(T.blank_to_null(F.col("entity")).isNotNull())
    return (
        known.select("entity").distinct().join(urls, "entity", "left")
        .select("entity", parsed.alias("repo_full_name"))
        .where(F.col("repo_full_name").isNotNull())
    )

"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them), so the flow
network has one node per pattern and one per source, whatever the number of documents. Its size is
that of the mix's definition; more than ``MAX_PATTERNS`` patterns raise an error. Token capacity
flows from patterns to source quotas; the k-th repetition of a pattern costs k - 1 a word, so every
document is used once before any is used twice. Documents then are drawn in the order of a seeded
hash: full repetitions for all of a pattern, the rest for a prefix of that order, the last document
of the prefix in part, so that the words taken meet the routed flow to the word.

The running sum along the hash order never meets in one task: words are summed for 1,024 buckets of
the hash, then for 1,024 parts of the one bucket where the flow ends, and only the documents of that
part (a millionth of the pattern) are put in order.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.llm.common import WORD
from riskpanel.session import materialize

MAX_PATTERNS = 20_000
BITS = 10


class Network:
    """A directed graph with capacities and costs; :meth:`solve` sends as much as it can at least cost."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        for start, end, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[start].append(len(self.head))
            self.head.append(end)
            self.left.append(room)
            self.cost.append(price)
        return len(self.head) - 2

    def solve(self, source: int, sink: int) -> None:
        """Successive cheapest paths; node prices keep all remaining costs non-negative."""
        price = [0] * len(self.out)
        while True:
            reach: dict[int, int] = {}
            via: dict[int, int] = {}
            queue = [(0, source, -1)]
            while queue:
                far, node, edge = heapq.heappop(queue)
                if node in reach:
                    continue
                reach[node], via[node] = far, edge
                for e in self.out[node]:
                    if self.left[e] > 0 and self.head[e] not in reach:
                        heapq.heappush(queue, (far + self.cost[e] + price[node] - price[self.head[e]], self.head[e], e))
            if sink not in reach:
                return
            most = max(reach.values())
            price = [p + reach.get(node, most) for node, p in enumerate(price)]
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.head[via[node] ^ 1]
            room = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= room
                self.left[e ^ 1] += room


def capped_shares(sizes: Sequence[int], weights: Sequence[float], whole: float, most: float) -> list[float]:
    """Shares of ``whole`` by weight, none above ``most`` times its size; what is cut off goes to the
    others by weight. Equal to reshared excess carried to its end."""
    caps = [most * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    rest, weight = whole, float(sum(weights))
    shares = list(caps)
    for at, i in enumerate(order):
        if weights[i] * (rest / weight) <= caps[i]:
            for j in order[at:]:
                shares[j] = weights[j] * (rest / weight)
            break
        rest, weight = rest - caps[i], weight - weights[i]
    return shares


def route(
    patterns: Sequence[tuple[Sequence[str | None], int]], targets: dict[str | None, float], max_repeats: int
) -> list[dict[str | None, int]]:
    """Words that each pattern gives to each of its sources, at least total repetition cost."""
    sources = list(targets)
    at = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    net = Network(2 + len(patterns) + len(sources))
    links: list[dict[str | None, int]] = []
    for p, (members, words) in enumerate(patterns):
        for repeat in range(max_repeats):
            net.edge(0, 2 + p, words, repeat)
        links.append({s: net.edge(2 + p, at[s], max_repeats * words) for s in members if s in at})
    for s in sources:
        net.edge(at[s], 1, round(targets[s]))
    net.solve(0, 1)
    return [{s: net.left[e ^ 1] for s, e in own.items()} for own in links]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_order(doc_id: Column, seed: int) -> Column:
    """60 bits of a digest of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def draw(sized: DataFrame, flows: DataFrame) -> DataFrame:
    """Words taken of each row. ``sized`` has ``pattern, size, place`` and a key that orders ties;
    ``flows`` has ``pattern, words, flow``, one row per pattern.

    Rows of the same pattern, place, key and size are interchangeable.
    """
    plan = flows.select(
        "pattern",
        F.when(F.col("words") > 0, F.floor(F.col("flow") / F.col("words"))).otherwise(0).cast("long").alias("full"),
        F.when(F.col("words") > 0, F.col("flow") % F.col("words")).otherwise(0).cast("long").alias("extra"),
    )

    def cut(rows: DataFrame, shift: int, left: str) -> DataFrame:
        """For each pattern the part of the hash order in which ``left`` words end, and the words before it."""
        part = F.shiftright("place", shift)
        sums = rows.groupBy("pattern", part.alias("part")).agg(F.sum("size").alias("part_words"))
        upto = F.sum("part_words").over(Window.partitionBy("pattern").orderBy("part"))
        return (
            sums.select("pattern", "part", "part_words", upto.alias("upto"))
            .join(plan_left(left), "pattern")
            .where((F.col("upto") > F.col("wanted")) & (F.col("upto") - F.col("part_words") <= F.col("wanted")))
            .select("pattern", "part", (F.col("upto") - F.col("part_words")).alias("before"))
        )

    def plan_left(left: str) -> DataFrame:
        return plan.select("pattern", F.col(left).alias("wanted"))

    first = cut(sized, 60 - BITS, "extra").withColumnRenamed("part", "coarse")
    inside = sized.join(F.broadcast(first), "pattern").where(F.shiftright("place", 60 - BITS) == F.col("coarse"))
    plan = plan.join(first.select("pattern", "coarse", F.col("before").alias("coarse_before")), "pattern", "left")
    plan = plan.withColumn("inner", F.col("extra") - F.col("coarse_before"))
    second = cut(inside, 60 - 2 * BITS, "inner").withColumnRenamed("part", "fine")
    plan = materialize(
        plan.join(second.select("pattern", "fine", F.col("before").alias("fine_before")), "pattern", "left"), "mix-plan"
    )
    rows = sized.join(F.broadcast(plan), "pattern")
    coarse, fine = F.shiftright("place", 60 - BITS), F.shiftright("place", 60 - 2 * BITS)
    rows = rows.withColumn(
        "side",
        F.when(F.col("coarse").isNull() | (coarse > F.col("coarse")), 1)
        .when(coarse < F.col("coarse"), -1)
        .when(fine < F.col("fine"), -1)
        .when(fine > F.col("fine"), 1)
        .otherwise(0),
    )
    edge = rows.where("side = 0")
    before = F.sum("size").over(
        Window.partitionBy("pattern").orderBy("place", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.col("inner") - F.col("fine_before") - F.coalesce(before, F.lit(0))
    edge = edge.withColumn("part_taken", F.least(F.col("size"), F.greatest(left, F.lit(0))))
    rest = rows.where("side <> 0").withColumn(
        "part_taken", F.when(F.col("side") < 0, F.col("size")).otherwise(0).cast("long")
    )
    both = rest.unionByName(edge)
    return both.withColumn("taken", F.col("full") * F.col("size") + F.col("part_taken")).select(
        *sized.columns, "taken"
    )


def mix_sources(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeats: int = 2,
    seed: int = 17,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The mix of ``docs``: ``doc_id, source, size, source_size, target, taken``, a row for each row.

    ``keep`` names further columns of ``docs`` that stay with their rows, after the others.

    ``source`` is a column of names, or of arrays of names for documents that several sources hold;
    such a document counts in the size of each, and serves them out of one capacity. A null name is
    a source of its own and comes last; an array that is null or empty is that source alone. Weights
    repeat along the sources in code-point order. A null or empty text has size 0 and gives nothing.
    Rows with one id and different texts are documents of their own; repeated rows count each. An
    empty table gives no rows. Output for array sources carries the targets of all sources of a
    document summed. The order of documents is a digest of ``seed`` and id, so reruns agree.
    """
    named = F.col(source) if docs.schema[source].dataType.typeName() == "array" else F.array(F.col(source))
    named = F.when(named.isNull() | (F.size(named) == 0), F.array(F.lit(None).cast("string"))).otherwise(
        F.array_sort(F.array_distinct(named))
    )
    sized = materialize(
        docs.select(
            F.col(doc_id).alias("key"),
            named.alias("members"),
            word_count(F.col(text)).alias("size"),
            seeded_order(F.col(doc_id), seed).alias("place"),
            F.struct(*keep).alias("row") if keep else F.lit(None).cast("string").alias("row"),
        ).withColumn("pattern", F.to_json(F.struct("members"), {"ignoreNullFields": "false"})),
        "mix-sizes",
    )
    found = (
        sized.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("words"))
        .orderBy("pattern").limit(MAX_PATTERNS + 1).collect()
    )
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = [(row["members"], row["words"]) for row in found]
    sizes: dict[str | None, int] = {}
    for members, words in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + words
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    cycle = [float(weights[i % len(weights)]) for i in range(len(sources))]
    whole = share * sum(words for _, words in patterns)
    targets = dict(zip(sources, capped_shares([sizes[s] for s in sources], cycle, whole, max_repeats), strict=True))
    flows = route(patterns, targets, max_repeats)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [
            (row["pattern"], row["words"], sum(flow.values()), sum(sizes[s] for s in row["members"]),
             float(sum(targets[s] for s in row["members"])))
            for row, flow in zip(found, flows, strict=True)
        ],
        "pattern string, words long, flow long, source_size long, target double",
    )
    drawn = draw(sized.select("key", "pattern", "size", "place", "row"), plan.select("pattern", "words", "flow"))
    shown = "array<string>" if docs.schema[source].dataType.typeName() == "array" else "string"
    member = F.from_json("pattern", "members array<string>")["members"]
    return drawn.join(F.broadcast(plan.select("pattern", "source_size", "target")), "pattern").select(
        F.col("key").alias("doc_id"),
        (member if shown.startswith("array") else member[0]).alias("source"),
        "size",
        "source_size",
        "target",
        "taken",
        *[F.col("row")[c].alias(c) for c in keep],
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of which the mix takes anything, with their columns and ``size, source_size, target, taken``.

    A column of ``docs`` with one of those four names gives way.
    """
    added = ["size", "source_size", "target", "taken"]
    own = [c for c in docs.columns if c not in added]
    mix = mix_sources(docs, keep=[c for c in own if c not in ("doc_id", "source")])
    return mix.where("taken > 0").select(*own, *added)


#: DuckDB SQL for the contract's mix of ``documents``.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place
  FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2 * source_size / weight AS level,
    (1.5 * (sum(source_size) OVER ())
      - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST((sum(weight) OVER ())
      - coalesce(sum(weight) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rate
  FROM sums),
water AS (SELECT max(rate) AS rate FROM levels),
targets AS (
  SELECT source, source_size, CAST(least(weight * water.rate, 2.0 * source_size) AS DOUBLE) AS target FROM levels, water),
summed AS (
  SELECT s.*, t.source_size, t.target, CAST(round_even(t.target, 0) AS BIGINT) AS flow,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE CAST(flow // source_size AS BIGINT) * size
    + least(size, greatest(flow % source_size - before, 0)) END AS taken
FROM summed
"""

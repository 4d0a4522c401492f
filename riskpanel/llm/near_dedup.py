"""Near-duplicate documents: MinHash with banding, verification, and connected components.

Each text's shingles are hashed by ``BANDS * ROWS`` universal functions; the minima of ``ROWS`` of them
make a band. Texts with the same set of shingles are one class and go on as one row. Classes that share
a band are compared twice, so that no bucket is ever unfolded into all its pairs:

1. Each member with the smallest member of its bucket. What passes the test joins components.
2. Members of a bucket that are still in different components, with each other. Lengths, a sketch of one
   bit for each minimum and a bitmap of the set are tested inside the join, so only pairs that look alike
   leave it. Bits in which two bitmaps differ are at most the shingles that only one set has, so this
   test never fails linked texts; it is what keeps large groups of texts just below the threshold apart.

Pairs that look alike are verified on the full sets of shingles. Members of one component need no more
links, as only reachability counts. Two sets at the threshold miss all bands with a chance of
(1 - 0.75 ** ROWS) ** BANDS, 5 in a million; the sketch test stands five standard deviations off.

Components come from alternating large-star and small-star steps over written edge tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.common import spread_join
from riskpanel.session import materialize

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Links are 100 * intersection >= 75 * union, from the contract.
PERCENT = 75
#: Bits in which sketches of linked texts may differ: 16 of 128 are expected at the threshold.
SKETCH_BITS = 36
#: Sets of shingles that a task keeps for pairs to come.
HELD_SETS = 24
#: Bits of a set's bitmap; more shingles than bits only make the test weaker.
BITMAP = 2048
PART = 4096
SEED = 17

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words of the contract: A-Z in lower case, parted by ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    if len(words) < SHINGLE:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def shingle_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words))], np.uint64)
    each = np.fromiter(map(digest, words), np.uint64, len(words))
    count = len(words) - SHINGLE + 1
    with np.errstate(over="ignore"):
        mixed = np.zeros(count, np.uint64)
        for at in range(SHINGLE):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + each[at : at + count]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each universal function over the set, 32 bits each; all ones for the empty set."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        keys = hashes >> np.uint64(32)
        for at in range(0, len(keys), PART):
            grid = keys[at : at + PART, None] * FACTORS[None, :]
            grid += OFFSETS
            np.minimum(least, grid.min(axis=0) >> np.uint64(32), out=least)
    return least.astype(np.uint32)


def sketch(minima: np.ndarray) -> np.ndarray:
    """One mixed bit of each minimum, packed into 64-bit numbers."""
    with np.errstate(over="ignore"):
        bits = (minima.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each hash modulo ``BITMAP``, as 64-bit numbers."""
    bits = np.zeros(BITMAP, np.uint8)
    bits[(hashes & np.uint64(BITMAP - 1)).astype(np.intp)] = 1
    return np.packbits(bits).view(np.int64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band's number and minima."""
    with np.errstate(over="ignore"):
        keys = np.arange(BANDS, dtype=np.uint64)
        for column in minima.astype(np.uint64).reshape(BANDS, ROWS).T:
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + column
        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return keys.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, class, s1, s2, bits, bands`` for each row; ``class`` is a 128-bit digest of the set."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                hashes = shingle_hashes(text)
                minima = signature(hashes)
                rows.append((
                    len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), *sketch(minima).tolist(), bitmap(hashes),
                    band_keys(minima),
                ))
            out = pd.DataFrame(rows, columns=["n_shingles", "class", "s1", "s2", "bits", "bands"])
            yield out.assign(doc_id=batch["doc_id"].to_numpy())[["doc_id", *out.columns]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        made, f"doc_id {kind}, n_shingles long, class binary, s1 long, s2 long, bits array<bigint>, bands array<bigint>"
    )


def alike(a: str, b: str) -> Column:
    """Length, sketch and bitmap test of two sides; linked texts fail the sketch with a chance of 1e-7."""

    def apart(one: Column, two: Column) -> Column:
        return F.bit_count(one.bitwiseXOR(two))

    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    sketches = sum(apart(F.col(f"{a}.{s}"), F.col(f"{b}.{s}")) for s in ("s1", "s2"))
    bits = sum(apart(F.get(f"{a}.bits", F.lit(i)), F.get(f"{b}.bits", F.lit(i))) for i in range(BITMAP // 64))
    return (
        (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (sketches <= SKETCH_BITS)
        & ((100 + PERCENT) * bits <= (100 - PERCENT) * (n + m))
    )


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` of documents whose full sets of shingles link them."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b"
    )

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(HELD_SETS)(shingle_set)
        for batch in batches:
            keep = []
            for a_text, b_text in zip(batch["a_text"], batch["b_text"], strict=True):
                one, two = known(a_text), shingle_set(b_text)
                shared = len(one & two)
                keep.append(100 * shared >= PERCENT * (len(one) + len(two) - shared) > 0)
            yield batch.loc[keep, ["a", "b"]]

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInPandas(linked, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for each node of the undirected ``a, b``.

    Large-star links a node's larger neighbours to the smallest of its neighbourhood, itself included;
    small-star links a node and its smaller neighbours to the smallest of them. They take turns until
    the edges stay as they are. Smallest neighbours are written before they meet the edges again, so a
    node with very many neighbours is a join that can be split, and each round restarts from files.
    """

    def star(rows: DataFrame, least: DataFrame) -> DataFrame:
        met = rows.join(materialize(least, "dup-smallest"), "a")
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")

    def large_star(rows: DataFrame) -> DataFrame:
        both = rows.unionAll(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return materialize(star(both.where("b > a"), least).distinct(), "dup-edges")

    def small_star(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("a").agg(F.min("b").alias("m"))
        own = least.select("a", F.col("m").alias("b"))
        return materialize(star(rows, least).unionAll(own).distinct(), "dup-edges")

    def measure(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    rows = materialize(edges.where("a <> b").select(larger, smaller).distinct(), "dup-edges")
    before = measure(rows)
    while before[0]:
        rows = small_star(large_star(rows))
        after = measure(rows)
        if after == before:
            break
        before = after
    heads = rows.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return rows.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(heads)


def linked_classes(classes: DataFrame, docs: DataFrame, given: DataFrame) -> DataFrame:
    """``node, component`` of all representatives that have a link; ``given`` are links known before."""
    rows = classes.select("rep", F.explode("bands").alias("band"))
    lead = rows.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last")
    lead = materialize(lead.select("band", "lead"), "dup-leaders")
    members = materialize(rows.join(lead, "band"), "dup-members")
    ids = materialize(members.select("rep").distinct(), "dup-ids")
    sides = materialize(classes.drop("bands", "class").join(ids, "rep", "left_semi"), "dup-sides")
    texts = materialize(docs.join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), "dup-texts")

    pairs = members.where("rep > lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    met = pairs.join(sides.alias("l"), F.col("a") == F.col("l.rep")).join(sides.alias("m"), F.col("b") == F.col("m.rep"))
    pairs = materialize(met.where(alike("l", "m")).select("a", "b").distinct(), "dup-pairs")
    links = materialize(given.unionAll(verified(pairs, texts)), "dup-links")
    found = materialize(components(links), "dup-components")

    placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "band", F.coalesce("component", "rep").alias("component")
    )
    placed = materialize(placed, "dup-placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    still = placed.join(materialize(mixed.select("band"), "dup-mixed"), "band", "left_semi").join(sides, "rep")
    still = materialize(still, "dup-open")
    met = still.alias("m").join(
        still.alias("l"),
        (F.col("m.band") == F.col("l.band")) & (F.col("m.component") > F.col("l.component")) & alike("m", "l"),
    )
    more = met.select(F.least("m.rep", "l.rep").alias("a"), F.greatest("m.rep", "l.rep").alias("b")).distinct()
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "dup-pairs")
    if more.isEmpty():
        return found
    return materialize(components(materialize(links.unionAll(verified(more, texts)), "dup-links")), "dup-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Texts without words have no shingles and link to nothing. A row with a null id takes no part in
    linking: its component is null and it is kept. Rows with one id and different texts are one node
    that has the links of all of them; repeated rows come out as often as they went in. An empty table
    gives no rows. Columns other than id and text are not read.
    """
    signed = materialize(signatures(docs), "dup-signatures")
    known = signed.where("doc_id is not null")
    least = F.min(F.when(F.col("n_shingles") > 0, F.col("doc_id"))).alias("rep")
    first = materialize(known.groupBy("class").agg(least, F.count("*").alias("n_rows")), "dup-classes")
    total = known.count()
    member = spread_join(known, first, "class", total).select(
        "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), "class", "s1", "s2", "bits", "bands"
    )
    classes = materialize(
        member.where("n_shingles > 0 and doc_id = rep").dropDuplicates(["rep", "class"]), "dup-representatives"
    )
    member = materialize(member.select("doc_id", "n_shingles", "rep"), "dup-rows")
    many = member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
    given = member.join(many.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")
    ).where("a <> b").distinct()
    linked = linked_classes(classes, docs.where("doc_id is not null").select("doc_id", "text"), materialize(given, "dup-given"))
    sizes = member.groupBy("rep").agg(F.count("*").alias("n_rows"))
    placed = materialize(sizes.join(linked.withColumnRenamed("node", "rep"), "rep", "left"), "dup-components")
    out = spread_join(member, placed, "rep", total).select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    alone = signed.where("doc_id is null").select(
        "doc_id", "n_shingles", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("component_id")
    )
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id, and all rows without an id.

    A repeated id keeps one row of each of its texts that differs, as all of them are that document.
    """
    rows = materialize(near_duplicates(docs), "dup-rows")
    gone = materialize(rows.where("not kept").select("doc_id").distinct(), "dup-gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = materialize(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "dup-again")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, "doc_id", "left_semi").select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(
        repeated.dropDuplicates(["doc_id", "text"])
    )


#: DuckDB SQL: shingle sets, shared shingles, and reachability.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) END) AS s
  FROM words),
sizes AS (SELECT d.doc_id, CAST(count(s.s) AS BIGINT) AS n FROM documents d LEFT JOIN shingles s USING (doc_id) GROUP BY d.doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT doc_id, n AS n_shingles, low AS component_id, doc_id = low AS kept
FROM sizes JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) ON a = doc_id
"""

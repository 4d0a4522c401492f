"""Near-duplicate documents: SimHash fingerprints and covering locality-sensitive hashing.

Each of the 64 bits of a fingerprint gets a code, a non-zero vector of ``RADIUS + 1`` bits. A table belongs to each
non-zero vector ``v`` and its mask keeps the bits whose code has an odd product with ``v``. Fingerprints that
differ in at most ``RADIUS`` bits agree in some table: their codes span less than the whole space, so some ``v`` has
an even product with all of them and its mask keeps none of the bits that differ. No pair is ever missed.

A bucket of at most ``BUCKET`` fingerprints becomes a spanning forest of its links inside one task, never a list of
all pairs. A larger one is split again by up to three more coverings with other codes; what agrees in all four
differs in at most ``OPEN_BITS`` bits, which bounds every bucket by ``BUCKET`` again. Exact copies are one fingerprint from the
start, and components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.common import spread_join
from riskpanel.llm.near_dedup import components
from riskpanel.session import materialize

SHINGLE = 4
#: Seed of the hash of shingles and greatest number of differing bits, from the contract.
HASH_SEED = 42
RADIUS = 4
BITS = 64
#: Fingerprints in a bucket that one task compares; more are split by a further covering.
BUCKET = 4096
PART = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """Majority bits of the hashes of all shingles of a whole text, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words), np.int64)
    np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
    shingles = max(len(words) - SHINGLE + 1, 1)
    ends = (np.append(starts[1:], len(joined) + 1) - 1)[len(words) - shingles :]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:shingles].tolist(), ends.tolist())
    hashes = np.fromiter((digest(joined[s:e], HASH_SEED) for s, e in spans), ">u8", shingles)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, shingles, PART):
        part = hashes[at : at + PART].view(np.uint8).reshape(-1, BITS // 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > shingles).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def covering_masks(seed: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks of the ``2 ** (radius + 1) - 1`` tables; codes are dealt evenly over a seeded order of the bits."""
    codes = (1 << (radius + 1)) - 1
    order = np.random.default_rng(seed).permutation(bits)
    code = {int(bit): at % codes + 1 for at, bit in enumerate(order)}
    return [sum(1 << b for b in range(bits) if (code[b] & v).bit_count() % 2) for v in range(1, codes + 1)]


#: What agrees in one table of each covering differs in at most ``OPEN_BITS`` bits, whichever tables they are.
COVERINGS = [covering_masks(seed) for seed in (170, 127, 102, 54)]
OPEN_BITS = 12


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, node`` for each row; ``node`` is the fingerprint as a signed number."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            nodes = pa.array([signed(fingerprint(t.as_py())) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), nodes], ["doc_id", "node"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, node long")


def tables(rows: DataFrame, level: int) -> DataFrame:
    """``key, node``: a row for each table of the covering; ``key`` hashes the bucket it is in so far as well."""
    node, within = F.col("node"), [F.col("key")] if "key" in rows.columns else []
    keys: list[Column] = [
        F.xxhash64(*within, F.lit(v), node.bitwiseAND(F.lit(signed(mask)))) for v, mask in enumerate(COVERINGS[level])
    ]
    return rows.select(F.explode(F.array(*keys)).alias("key"), "node")


def forest(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of linked nodes, at most one less than each bucket has members, that connect what its links connect.

    ``keys`` are sorted. Each round compares every member with the one ``step`` places on; links between trees are
    added one for each root, and looked at again until no link joins two trees.
    """
    end = np.searchsorted(keys, keys, side="right")
    root = np.arange(len(keys))
    unsigned = nodes.view(np.uint64)
    left, right = [], []
    at, step = np.flatnonzero(end > np.arange(len(keys)) + 1), 1
    while len(at):
        a, b = at, at + step
        near = np.bitwise_count(unsigned[a] ^ unsigned[b]) <= RADIUS
        a, b = a[near], b[near]
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            high, first = np.unique(np.maximum(ra, rb), return_index=True)
            left.append(nodes[a[first]])
            right.append(nodes[b[first]])
            root[high] = np.minimum(ra, rb)[first]
            while not np.array_equal(root, shorter := root[root]):
                root = shorter
        step += 1
        at = at[end[at] > at + step]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def bucket_links(rows: DataFrame) -> DataFrame:
    """Links ``a, b`` inside buckets ``key`` of bounded size; the last bucket of a batch waits for the next."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys = held_nodes = np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
            nodes = np.concatenate([held_nodes, batch.column("node").to_numpy()])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            held_keys, held_nodes = keys[cut:], nodes[cut:]
            yield links(keys[:cut], nodes[:cut])
        yield links(held_keys, held_nodes)

    def links(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        a, b = forest(keys, nodes)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(linked, "a long, b long").distinct()


def links_within_radius(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``node`` values with at most ``RADIUS`` differing bits."""
    rows, found = nodes, None
    for level in range(len(COVERINGS)):
        rows = tables(rows, level)
        last = level == len(COVERINGS) - 1
        large = rows.groupBy("key").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > bucket)
        large = None if last else materialize(large, "simhash-large")
        if large is None or large.isEmpty():
            own = bucket_links(rows)
            return own if found is None else found.unionAll(own)
        marked = spread_join(rows, large.withColumn("large", F.lit(True)), "key", rows.count())
        marked = materialize(marked, "simhash-buckets")
        own = materialize(bucket_links(marked.where("large is null").select("key", "node")), "simhash-links")
        found = own if found is None else found.unionAll(own)
        rows = marked.where("large").select("key", "node")
    return found


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Null, empty and blank texts have fingerprint zero and are linked like any other. A row with a null id takes no
    part in linking: its component is null. Rows with one id and different texts are one node that has the links of
    all of them; repeated rows come out as often as they went in. An empty table gives no rows. Columns other than
    id and text are not read.
    """
    signed_rows = materialize(fingerprints(docs), "simhash-fingerprints")
    known = signed_rows.where("doc_id is not null")
    nodes = materialize(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")), "simhash-nodes")

    own = known.distinct()
    several = own.groupBy("doc_id").agg(F.min("node").alias("b"), F.count("*").alias("n_rows")).where("n_rows > 1")
    several = materialize(several, "simhash-ids")
    links = materialize(links_within_radius(nodes.select("node"), bucket), "simhash-links")
    if not several.isEmpty():
        given = spread_join(own, several, "doc_id", own.count()).where("b <> node").select(F.col("node").alias("a"), "b")
        links = materialize(links.unionAll(given), "simhash-links")

    found = materialize(components(links), "simhash-components")
    placed = nodes.join(found, "node", "left").select("node", "rep", "n_rows", F.coalesce("component", "node").alias("component"))
    placed = materialize(placed, "simhash-placed")
    low = placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    low = materialize(low.where("members > 1").withColumnRenamed("members", "n_rows"), "simhash-low")
    named = spread_join(placed.withColumnRenamed("n_rows", "weight"), low, "component", placed.count())
    named = materialize(
        named.select("node", F.coalesce("component_id", "rep").alias("component_id"), F.col("weight").alias("n_rows")),
        "simhash-named",
    )
    alone = signed_rows.where("doc_id is null").withColumn("component_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    out = spread_join(known, named, "node", known.count()).select("doc_id", "node", "component_id").unionByName(alone)
    return out.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")

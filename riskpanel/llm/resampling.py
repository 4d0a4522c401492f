"""Target-distribution importance resampling: weights from an array of gains, ranks from a distributed radix sort.

Words are hashed into ``BUCKETS`` buckets. What a bucket gains is the floored log ratio of its smoothed share in the
target texts to that in all documents; a document weighs the sum over its words, looked up in one array. A seeded
Gumbel term makes the highest scores a sample without replacement.

Ranks come from a least-significant-digit radix sort over the key (score descending, id ascending). A pass counts
its digit in each block of ``BLOCK`` positions, sums the counts over smaller digits and over earlier blocks, and so
knows where each row goes: start of its digit in its block, plus its place among them. Passes are stable, each is one
shuffle by (block, digit), of which no group has more than ``BLOCK`` rows, and each ends in a written table.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize

#: Buckets of features, scale of gains and scores, seed text, and who is drawn, from the contract.
BUCKETS = 10_000
SCALE = 1000
SEED = "2024"
LEAST_WORDS = 20
DRAWN_PERCENT = 10
#: Positions whose digits are counted together, and bits of a digit.
BLOCK = 1 << 14
DIGIT_BITS = 12
LONG = 64

#: Bytes that part words become blanks; all others stay.
_PARTING = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_TO_BLANKS = bytes.maketrans(_PARTING, b" " * len(_PARTING))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of the contract: digits, letters, and all signs outside ASCII; A-Z in lower case."""
    return (text or b"").lower().translate(_TO_BLANKS).split()


def buckets_of(text: bytes | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Words of all texts by bucket; each task sums its own, so at most ``BUCKETS`` rows leave it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                sums += np.bincount(buckets_of(text.as_py()), minlength=BUCKETS)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["bucket", "n"])

    sums = np.zeros(BUCKETS, np.int64)
    found = texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in found.collect():  # at most BUCKETS rows
        sums[row["bucket"]] = row["n"]
    return sums


def gains_of(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What each bucket gains, from counts of all documents and of the target texts."""
    s_all, t_all = float(own.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [math.floor(SCALE * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(own.tolist(), target.tolist())],
        np.int64,
    )


def gumbel(doc_id: object) -> int:
    """The seeded term of a document's score; a null id counts as empty text."""
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-SCALE * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_features, weight, score`` for each row; the array of gains has a fixed size."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [buckets_of(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            sizes = np.array([len(b) for b in own], np.int64)
            weights = np.array([gains[b].sum() for b in own], np.int64)
            noise = np.array([gumbel(i) for i in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(weights), pa.array(weights + noise)],
                ["doc_id", "n_features", "weight", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, n_features long, weight long, score long")


def signed(value: int) -> int:
    return value - (1 << LONG) if value >> (LONG - 1) else value


def digits(key: Column, bits: int) -> list[tuple[Column, int]]:
    """Digits of an unsigned number of so many bits from the lowest on, as evenly wide as can be, with their widths."""
    passes = -(-bits // DIGIT_BITS)
    widths = [bits // passes + (at < bits % passes) for at in range(passes)]
    shifts = [sum(widths[:at]) for at in range(passes)]
    return [
        (F.shiftrightunsigned(key, s).bitwiseAND(F.lit((1 << w) - 1)).cast("int"), w) for s, w in zip(shifts, widths)
    ]


def span_key(value: str, low: int, high: int, descending: bool) -> tuple[Column, int]:
    """An unsigned number in the order of ``value``, and its bits; a range beyond 63 bits keeps all 64."""
    if high - low < 1 << (LONG - 1):
        key = F.lit(high) - F.col(value) if descending else F.col(value) - F.lit(low)
        return key, (high - low).bit_length()
    flip = (1 << (LONG - 1)) - 1 if descending else 1 << (LONG - 1)
    return F.col(value).bitwiseXOR(F.lit(signed(flip))), LONG


def counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """``rows`` with ``place`` where a stable sort by the digit puts each row, from 0."""
    placed = rows.withColumns({"digit": digit, "block": F.floor(F.col("place") / BLOCK)})
    cells = placed.groupBy("digit", "block").agg(F.count("*").alias("n"))
    cells = materialize(cells, "radix-cells")
    sums = sorted(cells.groupBy("digit").agg(F.sum("n").alias("n")).collect())  # at most 2 ** DIGIT_BITS rows
    starts, total = [], 0
    for row in sums:
        starts.append((row["digit"], total))
        total += row["n"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "digit int, start long"))
    before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, "digit").select(
        "digit", "block", (F.col("start") + F.col("earlier")).alias("offset")
    )
    inside = Window.partitionBy("digit", "block").orderBy("place")
    moved = placed.withColumn("nth", F.row_number().over(inside)).join(offsets, ["digit", "block"])
    return materialize(moved.select(*rows.drop("place").columns, (F.col("offset") + F.col("nth") - 1).alias("place")), "radix-pass")


def radix_order(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place`` from 0 in the order of score descending, id ascending, null ids last."""
    low = rows.agg(
        F.min("score").alias("s0"), F.max("score").alias("s1"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"),
        F.count("*").alias("n"), F.count("doc_id").alias("ids"),
    ).first()
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    if not low["n"]:
        return rows
    plan: list[tuple[Column, int]] = []
    if low["ids"]:
        key, bits = span_key("doc_id", low["d0"], low["d1"], descending=False)
        plan += digits(F.coalesce(key, F.lit(0)), bits) if bits else []
    if low["ids"] < low["n"]:
        plan.append((F.col("doc_id").isNull().cast("int"), 1))
    key, bits = span_key("score", low["s0"], low["s1"], descending=True)
    plan += digits(key, bits) if bits else []
    rows = materialize(rows, "radix-rows")
    for digit, _ in plan or [(F.lit(0), 1)]:
        rows = counting_pass(rows, digit)
    return rows


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs``; undrawn rows have no rank.

    Null, empty and wordless texts have no features and weight 0. Rows with a null id are scored as an empty id and
    rank after equal scores with one. Repeated rows count and are drawn each for themselves; those equal in score and
    id share consecutive ranks in no set order. Empty tables give no rows or, as the target, gains of the smoothing
    alone. Columns other than id and text are not read.
    """
    gains = gains_of(bucket_counts(docs), bucket_counts(target))
    rows = materialize(scored(docs, gains), "resample-scored")
    enough = F.col("n_features") >= LEAST_WORDS
    ranked = radix_order(rows.where(enough))
    drawn = DRAWN_PERCENT * rows.where(enough).count() // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    out = ["doc_id", "n_features", "weight", "score"]
    few = rows.where(~enough).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, rank.alias("rank")).unionByName(few)


#: DuckDB SQL. The first table is that of the common reflected CRC-32, made from its polynomial.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goals AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
own AS (SELECT row, unnest(w) AS f FROM docs),
goal AS (SELECT unnest(w) AS f FROM goals),
vocabulary AS (SELECT f FROM own UNION SELECT f FROM goal),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(octet_length(encode(f)) AS BIGINT)),
    lambda i: CAST(('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc),
s AS (SELECT bucket, count(*) AS s FROM own JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM goal JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM goal) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM own JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY row),
scores AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')),
      1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (row)),
places AS (
  SELECT doc_id, n_features, weight, score, n_features >= 20 AS enough,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scores)
SELECT doc_id, n_features, weight, score,
  CASE WHEN enough AND place <= 10 * (SELECT count(*) FROM places WHERE enough) // 100 THEN place END AS rank
FROM places
"""

"""Phrase collocation mining: best-first branch-and-bound growth of phrases, per language.

Score of a phrase: the least of ``SCALE * a / (l + r)`` over its cuts, with ``a`` its count and ``l``, ``r`` those of the
two parts. No part is rarer than the whole, which gives bounds before a phrase is counted. For everything that begins
with a prefix of count ``p`` and first word of count ``w``, the cut after that word is at most ``SCALE * p / (w + p)``;
for everything that ends in a suffix the same holds with its last word. Bounds only fall as phrases grow.

1. Words are counted, then pairs of frequent words: the roots of all branches, with exact scores.
2. Each language gets a level, the score of its ``2 * FIRST``-th best phrase so far (0 if there are fewer). Only prefixes
   whose bound reaches the level are grown to three and four words; the suffixes that cuts and the containment rule
   need are counted with them. So every phrase that scores at least the level is known, whatever was not grown.
3. A phrase is dropped if it lies in a longer one with ``KEEP_PERCENT`` of its count. If that holds for any longer
   phrase it holds for one that is longer by one word, and all of those are counted for phrases at the level.
4. A language with ``FIRST`` surviving phrases at its level is settled, ties included, and so is one at level 0. The others
   double what they look at, and only phrases between the new level and the last are grown.

Tasks count their own words as arrays of numbers and send sums. Frontiers reach them as bitmaps of a fixed size: a false
positive only counts a phrase that no bound asked for. All counts are exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize

#: Least count, longest phrase, phrases returned a language, scale and containment of the contract.
LEAST = 30
LONGEST = 4
FIRST = 2000
SCALE = 2_000_000
KEEP_PERCENT = 80
NO_LANG = "und"
#: Bits of a bitmap of phrases; words and word kinds that a task holds before it sends its sums.
MAP_BITS = 1 << 25
CHUNK_WORDS = 1 << 21
CHUNK_KINDS = 1 << 19
PART = 1 << 18
#: Sizes of scores an octave when a level is chosen.
LEVEL_STEPS = 12
SENT_ROWS = 1 << 16
FREE_BITS = 64 - (MAP_BITS.bit_length() - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
MARK = b","
_TO_MARKS = bytes.maketrans(_PIECE_ENDS + b"\t", MARK * len(_PIECE_ENDS) + b" ")
COUNTS = "lang string, phrase string, n long"


def tokens(text: bytes | None) -> list[bytes]:
    """Words in order, with ``MARK``, which no word holds, where a piece ends."""
    return (text or b"").lower().translate(_TO_MARKS).replace(MARK, b" " + MARK + b" ").split()


def mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """Places of phrases in a bitmap, from the hashes of their words in order; a word's are its first bits."""
    if len(hashes) == 1:
        return hashes[0] >> np.uint64(FREE_BITS)
    with np.errstate(over="ignore"):
        out = np.full(len(hashes[0]), len(hashes), np.uint64)
        for own in hashes:
            out = (out ^ (out >> np.uint64(29))) * MIX + own
        out ^= out >> np.uint64(32)
        return (out * MIX) >> np.uint64(FREE_BITS)


def word_hash(word: bytes, lang: int) -> int:
    return xxhash.xxh64_intdigest(word, seed=lang)


def lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))


class Bitmap:
    """A fixed-size set of hashed phrases; sent to tasks as the bytes of its bits."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

        self.packed = bits.tobytes()

    def has(self, places: np.ndarray) -> np.ndarray:
        return (self.bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(phrases: DataFrame) -> Bitmap:
    """The bitmap of the rows ``lang, phrase``; tasks turn phrases into places and unite the bits of a byte."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist()):
                seed = lang_hash(lang)
                places.append(mixed([np.array([word_hash(w, seed)], np.uint64) for w in phrase.split(b" ")])[0])
            own = np.unique(np.array(places, np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own >> 3), pa.array(1 << (own & 7))], ["byte", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(placed, "byte long, bits long")
    rows = found.groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MAP_BITS / 8 rows
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    bits[rows["byte"].to_numpy()] = rows["bits"].to_numpy()
    return Bitmap(bits)


class Words(dict):
    """Numbers of the frequent words of one language, given as they come up; -1 for all else and for marks."""

    def __init__(self, lang: str, kinds: list[tuple[str, bytes, int]], common: Bitmap) -> None:
        super().__init__({MARK: -1})
        self.lang, self.seed, self.kinds, self.packed = lang, lang_hash(lang), kinds, common.packed

    def __missing__(self, word: bytes) -> int:
        own = xxhash.xxh64_intdigest(word, self.seed)
        place, number = own >> FREE_BITS, -1
        if self.packed[place >> 3] >> (place & 7) & 1:
            number = len(self.kinds)
            self.kinds.append((self.lang, word, own))
        self[word] = number
        return number


class Chunk:
    """Frequent words of some texts as numbers, which also stand for the language; -1 parts what is no phrase."""

    def __init__(self, common: Bitmap) -> None:
        self.common = common
        self.kinds: list[tuple[str, bytes, int]] = []
        self.words: dict[str, Words] = {}
        self.empty()

    def empty(self) -> None:
        self.parts: list[np.ndarray] = []
        self.size = 0
        if sum(map(len, self.words.values())) >= CHUNK_KINDS:
            self.kinds, self.words = [], {}

    def add(self, lang: str, text: bytes | None) -> None:
        own = tokens(text)
        if lang not in self.words:
            self.words[lang] = Words(lang, self.kinds, self.common)
        self.parts.append(np.fromiter(map(self.words[lang].__getitem__, own), np.int32, len(own)))
        self.parts.append(np.array([-1], np.int32))
        self.size += len(own)

    def full(self) -> bool:
        return self.size >= CHUNK_WORDS or sum(map(len, self.words.values())) >= CHUNK_KINDS

    def counted(self, length: int, wanted) -> Iterator[pa.RecordBatch]:
        """Counts of the phrases of ``length`` words of which ``wanted(hashes of the words)`` holds, in small batches."""
        hashes = np.array([k[2] for k in self.kinds], np.uint64)
        ids = np.concatenate([*self.parts, np.full(length, -1, np.int32)])
        inside = ids >= 0
        last = len(ids) - length + 1
        at = np.flatnonzero(np.logical_and.reduce([inside[k : last + k] for k in range(length)]))
        if wanted is not None:
            parts = [at[k : k + PART] for k in range(0, len(at), PART)]
            at = np.concatenate([at[:0], *(p[wanted([hashes[ids[p + k]] for k in range(length)])] for p in parts)])
        slots, n = distinct([ids[at + k].astype(np.int64) for k in range(length)], max(len(self.kinds), 1))
        words = pa.array([k[1] for k in self.kinds], pa.binary())
        langs = pa.array([k[0] for k in self.kinds], pa.string())
        for k in range(0, len(n), SENT_ROWS):
            own = [pa.array(s[k : k + SENT_ROWS]) for s in slots]
            phrases = pc.binary_join_element_wise(*map(words.take, own), pa.scalar(b" ", pa.binary()))
            columns = [langs.take(own[0]), phrases.cast(pa.string()), pa.array(n[k : k + SENT_ROWS], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])


def distinct(slots: list[np.ndarray], kinds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns of numbers below ``kinds``, and how often each occurs."""
    if kinds ** len(slots) < 1 << 62:
        key = slots[0]
        for own in slots[1:]:
            key = key * kinds + own
        key, n = np.unique(key, return_counts=True)
        out = []
        for _ in slots[1:]:
            key, own = np.divmod(key, kinds)
            out.append(own)
        return [key, *reversed(out)], n
    key = slots[0]
    for own in slots[1:]:  # numbers of prefixes and of words stay below 2 ** 31 each
        key = np.unique(key * kinds + own, return_inverse=True)[1]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [s[first] for s in slots], n


def lang_texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes | None]]:
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
        yield NO_LANG if lang is None else lang, text.as_py()


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, phrase, n`` of all words of whole texts."""

    def sums(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(MARK, None)
            rows = iter(own.items())
            while part := list(islice(rows, SENT_ROWS)):
                words, n = zip(*part)
                columns = [pa.array([lang] * len(n), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in lang_texts(batch):
                counts[lang].update(tokens(text))
                if sum(map(len, counts.values())) >= CHUNK_KINDS:
                    yield from sums(counts)
                    counts.clear()
        yield from sums(counts)

    return summed(docs.select("lang", "text").mapInArrow(counted, COUNTS))


def phrase_counts(docs: DataFrame, length: int, common: Bitmap, wanted=None) -> DataFrame:
    """``lang, phrase, n`` of the phrases of so many frequent words that ``wanted`` lets pass, over whole texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(common)
        for batch in batches:
            for lang, text in lang_texts(batch):
                chunk.add(lang, text)
                if chunk.full():
                    yield from chunk.counted(length, wanted)
                    chunk.empty()
        yield from chunk.counted(length, wanted)

    return summed(docs.select("lang", "text").mapInArrow(counted, COUNTS))


def share(part: Column, whole: Column) -> Column:
    """``floor(SCALE * part / whole)``, exact however large the product is."""
    return F.call_function("div", F.lit(SCALE) * part.cast("decimal(20,0)"), whole.cast("decimal(20,0)"))


def words_joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def with_scores(grown: DataFrame, known: DataFrame) -> DataFrame:
    """Phrases with a known count of every part: ``lang, phrase, size, a, l, r, score`` at the lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = grown.select("lang", "phrase", F.col("n").alias("a"), F.size(words).alias("size"), words.alias("words"))
    cuts = cuts.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "size", "a", "k",
        words_joined(F.col("words"), F.lit(1), F.col("k")).alias("left"),
        words_joined(F.col("words"), F.col("k") + 1, F.col("size")).alias("right"),
    )
    counts = known.select("lang", "phrase", "n")
    both = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(
        counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]
    )
    cut = F.struct(share(F.col("a"), F.col("l") + F.col("r")).alias("score"), "k", "l", "r")
    best = both.groupBy("lang", "phrase", "size", "a").agg(F.min(cut).alias("cut"), F.count("*").alias("cuts"))
    return best.where(F.col("cuts") == F.col("size") - 1).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def with_bounds(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, phrase, bound, back``: what nothing that begins with the phrase, or ends in it, can score above."""
    split = F.split("phrase", " ")
    rows = phrases.select("lang", "phrase", "n", split.getItem(0).alias("first"), F.element_at(split, -1).alias("last"))
    for end in ("first", "last"):
        rows = rows.join(words.select("lang", F.col("phrase").alias(end), F.col("n").alias(f"n_{end}")), ["lang", end])
    n = F.col("n")
    return rows.select("lang", "phrase", share(n, F.col("n_first") + n).alias("bound"), share(n, F.col("n_last") + n).alias("back"))


def levels_of(scores: DataFrame, wanted: int) -> DataFrame:
    """``lang, level``: a score that at least ``wanted`` phrases reach, and not many more; 0 where there are fewer.

    Scores are summed by size on a logarithmic scale, so a language has at most ``20 * LEVEL_STEPS`` rows here; the level is
    the least score of the size in which the ``wanted``-th best phrase lies.
    """
    size = F.floor(F.log2(F.col("score") + 1) * LEVEL_STEPS).alias("size")
    sums = scores.groupBy("lang", size).agg(F.count("*").alias("n"), F.min("score").alias("low"))
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("size")))
    reached = sums.withColumn("so_far", so_far).groupBy("lang")
    return reached.agg(F.max(F.when(F.col("so_far") >= wanted, F.col("low"))).alias("level")).select(
        "lang", F.coalesce("level", F.lit(0)).alias("level")
    )


def ring(rows: DataFrame, levels: DataFrame, bound: str) -> DataFrame:
    """Rows whose bound lies between the new level of their language and the last one."""
    value = F.col(bound)
    inside = (value >= F.col("level")) & (F.col("last_level").isNull() | (value < F.col("last_level")))
    return rows.join(levels, "lang").where(inside).select("lang", "phrase")


def swallowed(scored: DataFrame, longer: DataFrame) -> DataFrame:
    """``lang, phrase`` of phrases that lie in a phrase longer by one word with ``KEEP_PERCENT`` of their count."""
    words = F.split("phrase", " ")
    size = F.size(words)
    parts = longer.select(
        "lang", F.col("n").alias("f"),
        F.explode(F.array(
            words_joined(words, F.lit(1), size - 1), words_joined(words, F.lit(2), size - 1)
        )).alias("phrase"),
    )
    most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    whole = F.col("f").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * KEEP_PERCENT
    return scored.join(most, ["lang", "phrase"]).where(whole).select("lang", "phrase")


def mine(docs: DataFrame, first: int = FIRST, least: int = LEAST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases.

    A null lang is ``und``. Null and empty texts have no words; a text is a piece of its own even without a sign at
    its end. Repeated rows count as often as they are there. Ties are broken by count, then by the phrase's bytes. An
    empty table, or one without frequent phrases, gives no rows. Columns other than lang and text are not read.
    """
    every = docs.select("lang", "text")
    words = materialize(word_counts(every), "phrase-words")
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    often = materialize(words.where(F.col("n") >= least), "phrase-frequent")
    common = bitmap_of(often)
    pairs = phrase_counts(every, 2, common)
    pairs = materialize(pairs.where(F.col("n") >= least), "phrase-pairs")
    scored = materialize(with_scores(pairs, often), "phrase-scored")
    bounds = materialize(with_bounds(pairs, often), "phrase-bounds")

    threes = fours = None
    levels, result, wanted = None, None, 2 * first
    while True:
        fresh = levels_of(scored, wanted)
        if levels is None:
            levels = fresh.withColumn("last_level", F.lit(None).cast(fresh.schema["level"].dataType))
        else:
            open_ones = levels.select("lang", F.col("level").alias("last_level"))
            levels = fresh.join(open_ones, "lang").withColumn("level", F.least("level", "last_level"))
        levels = materialize(levels, "phrase-levels")
        rows = every.withColumn("lang", F.coalesce("lang", F.lit(NO_LANG))).join(levels, "lang", "left_semi")

        grow, back = bitmap_of(ring(bounds, levels, "bound")), bitmap_of(ring(bounds, levels, "back"))
        more = phrase_counts(rows, 3, common, lambda h, grow=grow, back=back: grow.has(mixed(h[:2])) | back.has(mixed(h[1:])))
        more = more.where(F.col("n") >= least)
        threes = materialize((more if threes is None else threes.unionByName(more).distinct()), "phrase-threes")
        of_three = materialize(with_scores(threes, often.unionByName(pairs)), "phrase-scored")

        grow = bitmap_of(ring(with_bounds(threes, often), levels, "bound"))
        back = bitmap_of(ring(of_three, levels, "score"))
        more = phrase_counts(rows, 4, common, lambda h, grow=grow, back=back: grow.has(mixed(h[:3])) | back.has(mixed(h[1:])))
        more = more.where(F.col("n") >= least)
        fours = materialize((more if fours is None else fours.unionByName(more).distinct()), "phrase-fours")
        of_four = with_scores(fours, often.unionByName(pairs).unionByName(threes))

        everything = materialize(scored.where("size = 2").unionByName(of_three).unionByName(of_four), "phrase-scored")
        reached = everything.join(levels, "lang").where(F.col("score") >= F.col("level")).select(*everything.columns)
        gone = swallowed(reached, threes.unionByName(fours))
        alive = materialize(reached.join(gone, ["lang", "phrase"], "left_anti"), "phrase-alive")
        sizes = levels.join(alive.groupBy("lang").agg(F.count("*").alias("alive")), "lang", "left")
        settled = (F.coalesce("alive", F.lit(0)) >= first) | (F.col("level") == 0)
        done = materialize(sizes.withColumn("settled", settled), "phrase-state")
        own = alive.join(done.where("settled").select("lang"), "lang", "left_semi")
        result = own if result is None else result.unionByName(own)
        levels = done.where("not settled")
        if levels.isEmpty():
            break
        scored, wanted = everything, 2 * wanted

    # what cannot be among the first of its language stays out of the order
    cut = levels_of(result, first)
    result = result.join(cut, "lang").where(F.col("score") >= F.col("level"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )


#: DuckDB SQL: all phrases of one to four words, all cuts, all longer candidates.
SQL = r"""
WITH pieces AS (
  SELECT row, lang, row_number() OVER () AS piece, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (
    SELECT row, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM (
      SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents))),
grams AS (
  SELECT lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM pieces, range(1, 5) t(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.cut, x.f AS l, y.f AS r,
    CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, CAST(size AS BIGINT))) AS cut FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.phrase = list_aggregate(c.w[1:c.cut], 'string_agg', ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = list_aggregate(c.w[c.cut + 1:c.size], 'string_agg', ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (
  SELECT lang, a AS f, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase FROM (
    SELECT lang, a, w, k, unnest(range(1, CAST(size AS BIGINT) - k + 2)) AS i FROM candidates, range(2, 4) t(k) WHERE k < size)),
gone AS (
  SELECT DISTINCT s.lang, s.phrase FROM scored s JOIN parts p ON p.lang = s.lang AND p.phrase = s.phrase
  WHERE 100::HUGEINT * p.f >= 80::HUGEINT * s.a),
alive AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM scored ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM alive JOIN totals USING (lang) WHERE rank <= 2000
"""

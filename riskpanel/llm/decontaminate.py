"""Benchmark decontamination by template canonicalisation.

Numbers, units and names of documents and benchmark items become typed placeholders. Windows of
``WINDOW`` tokens of both are hashed and joined; a document that holds ``RUN`` windows of an item (13
tokens in a row), or all of a shorter item's, is a candidate. Its slots then must be consistent: what
stands for one value of the item is one value in the document, for ``CONSISTENT`` of the item's slot
values at least. So a question with other numbers, names or units is caught, and texts that share its
form by chance are not. Windows without slots, and those with the item's own values, agree as they stand: as
many of them as make a candidate are a leak, whatever the slots elsewhere say.

Everything is column expressions and joins. The windows of documents are never shuffled: windows of the
benchmark are broadcast if they are at most ``BROADCAST_WINDOWS`` (8 bytes and an item number each),
which a count proves first; otherwise both sides are shuffled by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.llm.common import SPACE, let
from riskpanel.session import materialize

WINDOW = 8
RUN = 6
CONSISTENT = 0.8
BROADCAST_WINDOWS = 1_000_000
SLOTS = ("<num>", "<unit>", "<name>")
#: Words of measure and money that stand for each other.
UNITS = (
    "mm|cm|m|km|inch|inches|foot|feet|yard|yards|mile|miles|mg|g|kg|ton|tons|ounce|ounces|pound|pounds|ml|l|litre|"
    "litres|liter|liters|second|seconds|minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years|dollar|"
    "dollars|euro|euros|cent|cents|percent|degree|degrees|volt|volts|watt|watts|metre|metres|meter|meters"
)
#: Where a placeholder goes. A number stands alone or before a unit; a unit follows a number; names are
#: capitalised words inside a sentence, that is after a small letter, comma, colon or placeholder.
NUMBER_AT = r"[0-9](?<![\p{L}\p{N}.,/:][0-9])[0-9.,/:]*(?<=[0-9])(?i:" + UNITS + r")?(?![\p{L}\p{N}])"
UNIT_AT = r"(?<=<num> )(?i:" + UNITS + r")(?![\p{L}\p{N}])"
NAME_AT = r"\p{Lu}(?<=[\p{Ll}>,;:] \p{Lu})[\p{Ll}'-][\p{L}'-]*"
NO_WORD = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"
#: Signs other than those of sentences and numbers; they go before names are looked for.
CLUTTER = r"[^\p{L}\p{N}\x20\x09-\x0D.,;:!?'/<>-]+"
NOISE = r"[^\p{L}\p{N}<>\x20\x09-\x0D]+"


def token_pair(text: Column) -> Column:
    """``canon`` and ``raw``, arrays of one length: tokens with placeholders, in lower case and without
    signs, and the same tokens as they stand in the text. Tokens without letters and digits are left out.
    """
    shown = plain(text)
    return let(shown, lambda t: F.struct(split_words(canonical(t)).alias("canon"), split_words(t).alias("raw")))


def canon_tokens(text: Column) -> Column:
    """The first half of :func:`token_pair`."""
    return split_words(canonical(plain(text)))


def plain(text: Column) -> Column:
    """``text`` without tokens that have neither letters nor digits, and without clutter in the others."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, "<>", "  "), NO_WORD, ""), CLUTTER, "")


def canonical(text: Column) -> Column:
    numbers = F.regexp_replace(F.regexp_replace(text, NUMBER_AT, "<num>"), UNIT_AT, "<unit>")
    shown = F.when(F.regexp_like(text, F.lit("[0-9]")), numbers).otherwise(text)
    return F.lower(F.regexp_replace(F.regexp_replace(shown, NAME_AT, "<name>"), NOISE, ""))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def windows(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    return let(words, lambda w: F.when(
        F.size(w) >= size,
        F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(size)))),
    ).otherwise(F.expr("cast(array() as array<bigint>)")))


def slots(pair: Column, first: Column, size: Column) -> Column:
    """Kind and value of the placeholders among ``size`` tokens from ``first`` on (one-based)."""
    both = F.zip_with(
        F.slice(pair["canon"], first, size), F.slice(pair["raw"], first, size),
        lambda c, r: F.struct(c.alias("kind"), F.lower(F.regexp_replace(r, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("value")),
    )
    return F.filter(both, lambda b: b["kind"].isin(*SLOTS))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, hash, size, at, slots, n_windows``: the windows of each item with at least one token.

    Windows that are placeholders for more than half say little and are left out, unless an item has
    no others. Items of fewer than ``WINDOW`` tokens are one window of their own length.
    """
    pair = benchmark.where(F.col("item_id").isNotNull()).select(
        "item_id", token_pair(F.coalesce("text", F.lit(""))).alias("pair")
    ).where(F.size("pair.canon") > 0)
    size = F.least(F.size("pair.canon"), F.lit(WINDOW))
    placed = pair.select("item_id", "pair", size.alias("size"), F.explode(
        F.sequence(F.lit(1), F.size("pair.canon") - size + 1)).alias("at"))
    cut = placed.select(
        "item_id", "size", "at",
        F.xxhash64(F.slice("pair.canon", F.col("at"), F.col("size"))).alias("hash"),
        slots(F.col("pair"), F.col("at"), F.col("size")).alias("slots"),
    )
    own = Window.partitionBy("item_id")
    telling = F.size("slots") * 2 <= F.col("size")
    cut = cut.withColumn("best", F.max(telling).over(own)).where(telling | ~F.col("best"))
    return cut.withColumn("n_windows", F.size(F.collect_set("hash").over(own))).drop("best")


def slot_evidence(docs: DataFrame, candidates: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """``key, item_id, agreement, equal`` of candidates that meet a window with slots.

    ``agreement`` is the share of slot values that agree in the best place; windows of one place lie on
    one diagonal: position in the document less position in the item. ``equal`` are the different windows
    whose slots have the item's values.
    """
    keys = candidates.select("key").distinct()
    pair = docs.join(keys, "key", "left_semi").select("key", token_pair(F.col("text")).alias("pair"))
    parts = []
    for size in sizes:
        rows = pair.where(F.size("pair.canon") >= size).select("key", "pair", F.explode(
            F.sequence(F.lit(1), F.size("pair.canon") - size + 1)).alias("place"))
        parts.append(rows.select(
            "key", "place", F.xxhash64(F.slice("pair.canon", F.col("place"), F.lit(size))).alias("hash"),
            slots(F.col("pair"), F.col("place"), F.lit(size)).alias("own"),
        ))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    met = materialize(rows.where(F.size("own") > 0).join(items.where(F.size("slots") > 0), "hash").join(
        candidates.select("key", "item_id").distinct(), ["key", "item_id"], "left_semi"
    ).select("key", "item_id", "hash", (F.col("place") - F.col("at")).alias("diagonal"), "slots", "own"), "leak-slots")
    values = met.select("key", "item_id", "diagonal", F.explode(F.arrays_zip("slots", "own")).alias("s")).groupBy(
        "key", "item_id", "diagonal", "s.slots.kind", "s.slots.value"
    ).agg((F.count_distinct("s.own.value") == 1).cast("double").alias("agrees"))
    places = values.groupBy("key", "item_id", "diagonal").agg(F.avg("agrees").alias("agreement"))
    best = places.groupBy("key", "item_id").agg(F.max("agreement").alias("agreement"))
    equal = met.where(F.col("slots") == F.col("own")).groupBy("key", "item_id").agg(F.count_distinct("hash").alias("equal"))
    return best.join(equal, ["key", "item_id"], "left")


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, item_id, n_windows, item_windows``: a row for each document and item it gives away.

    ``n_windows`` are the item's windows found in the document, of ``item_windows``. Null and empty
    texts, and items without tokens or id, meet nothing. Documents with a null id are reported under
    it; repeated rows are reported once. Empty tables give no rows. Other columns are not read.
    """
    items = materialize(item_windows(benchmark), "leak-items")
    sizes = [row["size"] for row in items.select("size").distinct().orderBy("size").collect()]
    texts = docs.where(F.col("text").isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("key"), "text"
    )
    if not sizes:
        none = items.select(F.col("item_id"), F.col("n_windows").alias("item_windows"))
        return texts.select("doc_id").limit(0).join(none, F.lit(False)).select(
            "doc_id", "item_id", F.lit(0).cast("long").alias("n_windows"), F.col("item_windows").cast("long")
        )
    known = items.select("hash", "item_id", "n_windows", (F.size("slots") == 0).alias("bare")).distinct()
    if items.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    hashes = let(canon_tokens(F.col("text")), lambda w: F.array_distinct(F.concat(*[windows(w, size) for size in sizes])))
    met = texts.select("doc_id", "key", F.explode(hashes).alias("hash")).join(known, "hash")
    counted = met.groupBy("doc_id", "key", "item_id", "n_windows").agg(
        F.count_distinct("hash").alias("found"), F.count_distinct(F.when(F.col("bare"), F.col("hash"))).alias("bare")
    )
    need = F.least(F.lit(RUN), F.greatest(F.col("n_windows") - 1, F.lit(1)))
    candidates = materialize(counted.where(F.col("found") >= need), "leak-candidates")
    verbatim = candidates.where(F.col("bare") >= need)
    asked = candidates.where(F.col("bare") < need)
    if asked.isEmpty():
        good = verbatim
    else:
        told = materialize(slot_evidence(texts, asked, items, sizes), "leak-evidence")
        kept = (F.col("agreement") >= CONSISTENT) | (F.col("bare") + F.coalesce("equal", F.lit(0)) >= need)
        good = verbatim.unionByName(asked.join(told, ["key", "item_id"]).where(kept).select(*candidates.columns))
    return good.groupBy("doc_id", "item_id").agg(
        F.max("found").cast("long").alias("n_windows"), F.max("n_windows").cast("long").alias("item_windows")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text gives an item away; rows with a null text stay.

    Rows are matched by their text, so ids need not be unique or present.
    """
    keyed = docs.withColumn("__key", F.md5(F.col("text").cast("binary")))
    bad = materialize(
        find_leaks(keyed, benchmark, doc_id="__key").select(F.col("doc_id").alias("__key")).distinct(), "leak-texts"
    )
    return keyed.join(bad, "__key", "left_anti").select(*docs.columns)

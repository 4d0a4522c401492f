"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contract: what parts words, and what a word is.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 256
#: A key with more than this part of all rows counts as hot; there are fewer such keys than this number.
HOT_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body or its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other letters stay."""
    return F.translate(text, UPPER, LOWER)


def word_list(text: Column) -> Column:
    """Words of a text in order; an empty array for null, empty or blank text."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    return F.filter(parts, lambda w: w != "")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """``crc32`` of the id's decimal text modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code-point positions, end exclusive.

    The pieces between the matches and the matches themselves come from the same pattern, so their
    lengths add up to the positions. Sums run over blocks of ``BLOCK`` matches, so a text with very
    many matches costs n * (BLOCK + n / BLOCK) steps, not n * n.
    """
    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("texts")
    )

    def placed(both: Column) -> Column:
        gaps, texts = both["gaps"], both["texts"]
        steps = F.transform(
            texts,
            lambda _, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(texts, i - 1)), F.lit(0)),
        )
        return let(F.struct(texts.alias("texts"), steps.alias("steps")), with_starts)

    def with_starts(both: Column) -> Column:
        steps = both["steps"]
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
            lambda k: total(F.slice(steps, k * BLOCK + 1, F.lit(BLOCK))),
        )
        return let(
            F.struct(both["texts"].alias("texts"), steps.alias("steps"), blocks.alias("blocks")), summed
        )

    def summed(both: Column) -> Column:
        before = F.transform(both["blocks"], lambda _, k: total(F.slice(both["blocks"], F.lit(1), k)))
        return let(
            F.struct(both["texts"].alias("texts"), both["steps"].alias("steps"), before.alias("before")), spans
        )

    def spans(both: Column) -> Column:
        def span(text: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(both["before"], block) + total(
                F.slice(both["steps"], block * BLOCK + 1, i - block * BLOCK + 1)
            )
            return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"))

        return F.transform(both["texts"], span)

    return let(found, lambda both: F.when(F.size(both["texts"]) > 0, placed(both)).otherwise(no_matches()))


def no_matches() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def replace_spans(text: Column, spans: Column) -> Column:
    """``text`` with each span's characters replaced by its ``mark``; spans are sorted by start.

    A span that begins inside an earlier one gives no mark of its own; what it covers goes too.
    """

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.when(fresh, F.concat(state["out"], F.array(between, s["mark"]))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    def rest(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(0).alias("at"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def spread_join(rows: DataFrame, values: DataFrame, key: str, total_rows: int) -> DataFrame:
    """Left join of ``rows`` with ``values``, which holds each key once and its number of rows as ``n_rows``.

    Keys with more than one in ``HOT_PARTS`` of the ``total_rows`` rows are fewer than ``HOT_PARTS``, so they are
    broadcast and their rows stay where they are; only the rest is shuffled by the key. Both tables should be
    written ones, as they are read twice.
    """
    hot = F.col("n_rows") * HOT_PARTS > total_rows
    few = F.broadcast(values.where(hot))
    rest = values.where(~hot)
    return rows.join(few, key).unionByName(rows.join(few, key, "left_anti").join(rest, key, "left"))


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with another text and, where there is such a column, its ``n_chars``; nulls stay null."""
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        known = F.col("n_chars").isNotNull() & F.col("text").isNotNull()
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(known, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out

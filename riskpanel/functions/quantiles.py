"""Exact order statistics per group that never place a whole group in one task.

Values are counted first, so repeated values travel once. Groups with few distinct values are ordered as they are.
A larger group is split into cells, first on a logarithmic scale, then by the least and greatest value of the cell
itself; only cells that hold a wanted rank go on, until each is small enough to be put in order. A cell's range falls
by ``PIECES`` each time, so values that lie close together are spread as well as others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize

#: Distinct values of one group or cell that a task puts in order.
ORDERED_VALUES = 100_000
BUCKETS_PER_OCTAVE = 2048
PIECES = 1024
SMALLEST_OCTAVE, LARGEST_OCTAVE = 1100, 1100.0
Ranks = dict[str, Callable[[Column], Column]]


def _bucket(value: Column) -> Column:
    """Order-preserving coarse key on a logarithmic scale that small fractions share with large numbers."""
    octave = F.least(F.log2(F.abs(value)), F.lit(LARGEST_OCTAVE)) + SMALLEST_OCTAVE
    size = F.floor(octave * BUCKETS_PER_OCTAVE)
    return F.when(value == 0, F.lit(0)).when(value < 0, -size).otherwise(size).cast("long")


def _piece(value: Column, low: Column, high: Column) -> Column:
    """Place of a value among ``PIECES`` equal parts of its cell; halves keep the widest ranges finite."""
    share = (value / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0))
    return F.coalesce(F.least(F.floor(share * PIECES), F.lit(PIECES - 1)), F.lit(0)).cast("long")


def _same(keys: Sequence[str], mark: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in keys], F.lit(True))


def _pick(rows: DataFrame, cell: Sequence[str], keys: Sequence[str], ranks: Ranks, before: Column) -> DataFrame:
    """Values at the wanted ranks of cells that are put in order; ``rows`` hold ``v, n, n_values``."""
    inside = Window.partitionBy(*(cell or [F.lit(0)])).orderBy("v")
    ordered = rows.withColumn("upto", before + F.sum("n").over(inside))
    at = {name: rank(F.col("n_values")).cast("long") for name, rank in ranks.items()}
    picks = [
        F.max(F.when((r >= F.col("upto") - F.col("n")) & (r < F.col("upto")), F.col("v"))).alias(name)
        for name, r in at.items()
    ]
    return ordered.groupBy(*keys).agg(F.max("n_values").alias("n_values"), *picks)


def _refined(rows: DataFrame, keys: list[str], ranks: Ranks) -> DataFrame:
    """Only the cells that hold a wanted rank, each with at most ``ORDERED_VALUES`` distinct values.

    Adds ``low`` (the cell's least value, which names it within its group) and ``before`` (rows of the group below it).
    """
    piece, cell = _bucket(F.col("v")), list(keys)
    rows = rows.withColumns({"low": F.lit(None).cast("double"), "before": F.lit(0).cast("long")})
    while True:
        marked = rows.withColumn("piece", piece)
        histogram = marked.groupBy(*cell, "piece", "before", "n_values").agg(
            F.sum("n").alias("piece_n"), F.count("*").alias("kinds"), F.min("v").alias("next_low"), F.max("v").alias("next_high"))
        so_far = Window.partitionBy(*(cell or [F.lit(0)])).orderBy("piece")  # pieces of one cell
        histogram = histogram.withColumn("next_before", F.col("before") + F.sum("piece_n").over(so_far) - F.col("piece_n"))
        inside = [
            (r >= F.col("next_before")) & (r < F.col("next_before") + F.col("piece_n"))
            for r in (rank(F.col("n_values")).cast("long") for rank in ranks.values())]
        wanted = materialize(histogram.where(reduce(lambda a, b: a | b, inside)), "quantile-cells")
        named = [*cell, "piece"]
        kept = wanted.select(*[F.col(k).alias(f"w_{k}") for k in named], "next_low", "next_high", "next_before")
        rows = materialize(marked.join(kept, _same(named, "w_")).select(
            *keys, "v", "n", "n_values", F.col("next_low").alias("low"), F.col("next_high").alias("high"),
            F.col("next_before").alias("before")), "quantile-values")
        if wanted.where(F.col("kinds") > ORDERED_VALUES).isEmpty():
            return rows
        piece, cell = _piece(F.col("v"), F.col("low"), F.col("high")), [*keys, "low"]


def values_at_ranks(
    df: DataFrame, keys: Sequence[str], value: Column, ranks: Ranks, weight: str | None = None,
) -> DataFrame:
    """Value at zero-based ranks per group; each rank is a function of the group size.

    Returns the keys, ``n_values`` and one column per rank. Null values do not count. ``weight``
    names a column that says how many times a row counts.
    """
    keys = list(keys)
    counted = (
        df.select(
            *keys, value.cast("double").alias("v"),
            (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("times"),
        )
        .where(F.col("v").isNotNull())
        .groupBy(*keys, "v")
        .agg(F.sum("times").alias("n"))
    )
    counted = materialize(counted, "quantile-values")
    sizes = counted.groupBy(*keys).agg(F.count("*").alias("kinds"), F.sum("n").alias("n_values"))
    large = sizes.where(F.col("kinds") > ORDERED_VALUES)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    if large.isEmpty():
        small = counted.withColumn("n_values", F.sum("n").over(whole))
        return _pick(small, keys, keys, ranks, F.lit(0))
    if not keys:
        total = F.lit(large.first()["n_values"])
        return _pick(_refined(counted.withColumn("n_values", total), keys, ranks), ["low"], keys, ranks, F.col("before"))
    large = materialize(large.select(*[F.col(k).alias(f"l_{k}") for k in keys], "n_values"), "quantile-groups")
    refined = _refined(counted.join(large, _same(keys, "l_")).select(*keys, "v", "n", "n_values"), keys, ranks)
    found = _pick(refined, [*keys, "low"], keys, ranks, F.col("before"))
    rest = counted.join(large, _same(keys, "l_"), "left_anti").withColumn("n_values", F.sum("n").over(whole))
    return found.unionByName(_pick(rest, keys, keys, ranks, F.lit(0)))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, fractions: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per named fraction."""
    ranks: Ranks = {}
    for name, p in fractions.items():
        ranks[f"{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"{name}_hi"] = lambda n, p=p: F.least(F.floor((n - 1) * F.lit(p)) + 1, n - 1)
    found = values_at_ranks(df, keys, value, ranks, weight)

    def blend(name: str, p: float) -> Column:
        position = (F.col("n_values") - 1) * F.lit(p)
        share = position - F.floor(position)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (low + (high - low) * share).alias(name)

    return found.select(*keys, "n_values", *[blend(k, p) for k, p in fractions.items()])


def upper_median(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Middle value, the upper one for an even count (no interpolation)."""
    return values_at_ranks(df, keys, value, {name: lambda n: F.floor(n / 2)})

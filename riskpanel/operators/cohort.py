"""Cohort statistics: contingency tables, odds ratios, strata, dependence profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.functions import numbers as N
from riskpanel.functions.quantiles import exact_quantiles, upper_median
from riskpanel.functions.text import feature_family
from riskpanel.operators.prefix import with_constants
from riskpanel.session import materialize

# --- fixed values: cohort thresholds and criteria ---
RELEASE_MONTHS, TEAM_SIZE, COMMIT_DAYS = 12.0, 2.0, 365.0
ODDS_CRITERION = 1.5
WEAK_CORRELATION = 0.2
SMALLEST_BIN = 5
CELLS = ("exposed_pos", "exposed_neg", "unexposed_pos", "unexposed_neg")


def default_factors() -> dict[str, Column]:
    """Stale releases, small team, either of them, and stale commits; null where unobserved."""
    release = F.col("gharchive_months_since_release_tag") >= RELEASE_MONTHS
    team = F.col("gharchive_unique_human_actors_trailing_6m") <= TEAM_SIZE
    return {
        "releases": release, "team": team,
        "either": F.when(release.isNotNull() & team.isNotNull(), release | team),
        "commits": F.col("swh_days_since_last_commit") >= COMMIT_DAYS,
    }


def _cells(exposed: Column, positive: Column) -> list[Column]:
    return [
        F.count_if(exposed & positive), F.count_if(exposed & ~positive),
        F.count_if(~exposed & positive), F.count_if(~exposed & ~positive),
    ]


def contingency(
    panel: DataFrame, factors: Mapping[str, Column], label: str, test_start: str
) -> DataFrame:
    """2 × 2 counts per factor and window, plus both windows together.

    One pass: each factor is a handful of conditional counts, so rows are not multiplied by the
    number of factors. A null label counts as negative, a null factor as missing.
    """
    positive = N.as_flag(F.col(label) == 1)
    window = F.when(F.col("month") < test_start, "train").otherwise("test")
    flagged = panel.select(
        window.alias("window"), positive.alias("positive"),
        *[v.alias(f"f_{k}") for k, v in factors.items()])
    counted = flagged.rollup("window").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.struct(
            F.lit(name).alias("factor"),
            *[c.alias(cell) for c, cell in
              zip(_cells(F.col(f"f_{name}"), F.col("positive")), CELLS, strict=True)],
            F.count_if(F.col(f"f_{name}").isNull()).alias("rows_excluded_missing"),
        ).alias(f"t_{name}") for name in factors],
    )
    return counted.select(
        F.coalesce("window", F.lit("all")).alias("window"), "n_rows",
        F.inline(F.array(*[F.col(f"t_{name}") for name in factors])))


def with_odds(table: DataFrame) -> DataFrame:
    """Rates, odds ratio and its 95 % interval; half a count is added when a cell is empty.

    Null when one exposure arm has no rows at all.
    """
    a, b, c, d = (F.col(cell) for cell in CELLS)
    usable = ((a + b) > 0) & ((c + d) > 0)
    add = F.when(F.least(a, b, c, d) == 0, 0.5).otherwise(0.0)
    a2, b2, c2, d2 = a + add, b + add, c + add, d + add
    odds = (a2 * d2) / (b2 * c2)
    spread = 1.96 * F.sqrt(1 / a2 + 1 / b2 + 1 / c2 + 1 / d2)
    exposed, unexposed = a / (a + b), c / (c + d)
    out = {
        "exposed_rate": N.half_even(exposed, 5), "unexposed_rate": N.half_even(unexposed, 5),
        "rate_ratio": N.half_even(N.safe_div(exposed, unexposed), 3),
        "odds_ratio": N.half_even(odds, 3),
        "ci_low": N.half_even(F.exp(F.log(odds) - spread), 3),
        "ci_high": N.half_even(F.exp(F.log(odds) + spread), 3),
        "criterion_met": (F.exp(F.log(odds) - spread) >= 1.0) & (odds >= ODDS_CRITERION),
    }
    return table.select("*", *[F.when(usable, v).alias(k) for k, v in out.items()])


def odds_ratios(
    panel: DataFrame, factors: Mapping[str, Column], label: str, test_start: str
) -> DataFrame:
    return with_odds(contingency(panel, factors, label, test_start))


def stratified_rates(
    panel: DataFrame, factor: Column, attention: str, label: str
) -> DataFrame:
    """Contingency per attention stratum and pooled; rows without the factor are left out.

    Strata are none, up to, and above the upper median of the non-zero attention.
    """
    rows = panel.select(
        factor.alias("exposed"), N.number_or_zero(F.col(attention)).alias("attention"),
        N.as_flag(F.col(label) == 1).alias("positive"),
    ).where(F.col("exposed").isNotNull())
    middle = upper_median(
        rows.where(F.col("attention") > 0), [], F.col("attention"), "median_nonzero_attention"
    ).agg(F.max("median_nonzero_attention").alias("median_nonzero_attention"))
    level = F.col("attention")
    stratum = F.when(level <= 0, "none").when(
        level <= F.coalesce("median_nonzero_attention", F.lit(0.0)), "lower").otherwise("higher")
    placed = with_constants(rows, middle).withColumn("stratum", stratum)
    counted = placed.rollup("stratum").agg(
        F.max("median_nonzero_attention").alias("median_nonzero_attention"),
        F.count(F.lit(1)).alias("n"),
        *[c.alias(cell) for c, cell in
          zip(_cells(F.col("exposed"), F.col("positive")), CELLS, strict=True)])
    named = counted.withColumn("stratum", F.coalesce("stratum", F.lit("pooled")))
    return with_odds(named).drop("criterion_met")


def value_correlations(df: DataFrame, features: Sequence[str], contribution: str = "{}_contrib",
                       ) -> DataFrame:
    """Correlation of each feature's value with its contribution, in one pass over the rows."""
    per_feature = df.agg(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.avg(F.abs(F.col(contribution.format(f)))).alias("mean_abs"),
            F.stddev_pop(F.col(f).cast("double")).alias("sx"),
            F.stddev_pop(contribution.format(f)).alias("sc"),
            F.corr(F.col(f).cast("double"), F.col(contribution.format(f))).alias("r"),
        ).alias(f"f{i}") for i, f in enumerate(features)])
    rows = per_feature.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(features))])))
    corr = F.when((F.col("sx") > 0) & (F.col("sc") > 0), F.col("r")).otherwise(0.0)
    return rows.select(
        "feature", feature_family(F.col("feature")).alias("family"),
        N.half_even(F.col("mean_abs"), 4).alias("mean_abs_contribution"),
        N.half_even(corr, 3).alias("value_corr"),
        F.when(corr > 0, "increasing").otherwise("decreasing").alias("direction"),
        (F.abs(corr) < WEAK_CORRELATION).alias("direction_weak"))


def _long(df: DataFrame, features: Sequence[str], contribution: str, missing: str) -> DataFrame:
    """Rows (feature, x, s, missing) counted per distinct value before they travel."""
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"),
                 F.col(contribution.format(f)).alias("s"),
                 (F.col(missing.format(f)) if missing.format(f) in df.columns else F.lit(False))
                 .alias("missing")) for f in features])))
    return stacked.groupBy("feature", "x", "missing").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"))


def _profile(placed: DataFrame) -> DataFrame:
    """Mean contribution per bin; bins with few rows are dropped."""
    return (
        placed.groupBy("feature", "bin")
        .agg(F.min("lo").alias("value_lo"), F.max("hi").alias("value_hi"), F.sum("n").alias("n"),
             (F.sum("s") / F.sum("n")).alias("mean"))
        .where(F.col("n") >= SMALLEST_BIN)
        .select("feature", "bin", "value_lo", "value_hi", "n",
                N.half_even(F.col("mean"), 4).alias("mean_contribution"))
    )


def _edge_bins(values: DataFrame, edges: DataFrame, smallest_edges: int) -> DataFrame:
    """Place values between distinct edges; the last bin includes its upper edge."""
    e = F.col("edges")
    last = F.size(e) - 2
    index = F.greatest(F.lit(0), F.least(
        F.size(F.filter(e, lambda q: q <= F.col("x"))) - 1, last)).cast("int")
    return (
        values.join(edges, "feature").where(F.size(e) >= smallest_edges)
        .withColumn("bin", index)
        .withColumns({"lo": F.get(e, F.col("bin")), "hi": F.get(e, F.col("bin") + 1)})
    )


def binned_profiles(
    df: DataFrame, features: Sequence[str], contribution: str = "{}_contrib",
    missing: str = "{}_missing",
) -> DataFrame:
    """Mean contribution over adaptive bins of each feature's value.

    Up to six distinct values: one bin each. More than half of the rows at the minimum: one bin
    for it and thirds above. Otherwise fifths. ``scope`` observed holds the quarters of the
    rows that were not imputed, for features with more than a tenth imputed.
    """
    # distinct values with their counts: read once, then small enough to pass over repeatedly
    counted = materialize(_long(df, features, contribution, missing), "profile-values")
    values = counted.groupBy("feature", "x").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    low = values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.min("x").alias("x_min"),
        F.sum("n").alias("n_all"), F.min_by("n", "x").alias("n_min"))
    mode = F.when(F.col("n_distinct") <= 6, "each").when(
        F.col("n_min") / F.col("n_all") > 0.5, "minimum").otherwise("fifths")
    moded = values.join(low.select("feature", "x_min", mode.alias("mode")), "feature")

    each_order = Window.partitionBy("feature").orderBy("x")
    each = moded.where(F.col("mode") == "each").select(
        "feature", "n", "s", F.col("x").alias("lo"), F.col("x").alias("hi"),
        (F.row_number().over(each_order) - 1).alias("bin"))

    at_min = moded.where((F.col("mode") == "minimum") & (F.col("x") == F.col("x_min"))).select(
        "feature", "n", "s", F.col("x").alias("lo"), F.col("x").alias("hi"), F.lit(0).alias("bin"))
    rest = moded.where((F.col("mode") == "minimum") & (F.col("x") != F.col("x_min")))
    thirds = _edges(rest, (0.0, 1 / 3, 2 / 3, 1.0))
    above = _edge_bins(rest, thirds, 2).withColumn("bin", F.col("bin") + 1)

    wide = moded.where(F.col("mode") == "fifths")
    fifths = _edge_bins(wide, _edges(wide, (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)), 3)

    kept = ["feature", "n", "s", "lo", "hi", "bin"]
    placed = each.select(*kept)
    for part in (at_min, above, fifths):
        placed = placed.unionByName(part.select(*kept))
    main = _profile(placed).withColumn("scope", F.lit("all"))

    share = counted.groupBy("feature").agg(
        F.sum("n").alias("n_all"), F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0))
        .alias("n_missing"))
    sparse = share.where(
        (F.col("n_missing") / F.col("n_all") > 0.10)
        & (F.col("n_all") - F.col("n_missing") >= 25)).select("feature")
    seen = counted.where(~F.col("missing")).join(sparse, "feature", "left_semi")
    quarters = _edge_bins(seen, _edges(seen, (0.0, 0.25, 0.5, 0.75, 1.0)), 3)
    observed = _profile(quarters.select(*kept)).withColumn("scope", F.lit("observed"))
    return main.unionByName(observed)


def _edges(values: DataFrame, fractions: Sequence[float]) -> DataFrame:
    names = {f"q{i}": p for i, p in enumerate(fractions)}
    found = exact_quantiles(values, ["feature"], F.col("x"), names, weight="n")
    return found.select("feature", F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))


def profile_shapes(profiles: DataFrame) -> DataFrame:
    """Increasing, decreasing or neither, for features with at least three bins."""
    order = Window.partitionBy("feature").orderBy("bin")
    step = F.col("mean_contribution") - F.lag("mean_contribution").over(order)
    steps = profiles.where(F.col("scope") == "all").withColumn("step", step)
    return steps.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_bins"), F.min("step").alias("lowest"),
        F.max("step").alias("highest"),
    ).select(
        "feature", F.when(F.col("n_bins") >= 3, F.when(F.col("lowest") >= -1e-9, "increasing")
                          .when(F.col("highest") <= 1e-9, "decreasing")
                          .otherwise("non-monotone")).alias("bin_shape"))


def importance_consistency(importances: DataFrame) -> DataFrame:
    """Agreement of runs on the direction of features.

    ``importances`` has run, feature, direction (increasing or decreasing) and magnitude.
    """
    from riskpanel import constants as K

    kept = importances.where(~F.col("feature").isin(*K.WINDOW_COLUMNS))
    per = kept.groupBy("feature").agg(*[
        c for d in ("increasing", "decreasing") for c in (
            F.count_if(F.col("direction") == d).alias(f"n_{d}"),
            F.avg(F.when(F.col("direction") == d, F.col("magnitude"))).alias(f"avg_{d}"))])

    def line(d: str, other: str) -> Column:
        return F.struct(
            F.lit(d).alias("direction"), F.col(f"n_{d}").alias("models"),
            N.half_even(F.col(f"avg_{d}"), 4).alias("avg_magnitude"),
            F.col(f"n_{other}").alias("models_opposite_direction"),
            (F.col(f"n_{other}") >= F.col(f"n_{d}")).alias("direction_conflict"))

    rows = per.select("feature", feature_family(F.col("feature")).alias("family"), F.inline(
        F.array(line("increasing", "decreasing"), line("decreasing", "increasing"))))
    return rows.where(F.col("models") > 0)

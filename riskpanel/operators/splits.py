"""Column selection, splits, imputation and weights ahead of training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.functions import dates as D
from riskpanel.functions.numbers import stable_bucket
from riskpanel.functions.quantiles import exact_quantiles
from riskpanel.operators.prefix import with_constants

NUMERIC_TYPES = ("double", "float", "integer", "long", "short", "byte", "boolean", "decimal")
INCIDENT_PREFIXES = ("advisory_", "advisories_")
# --- fixed values: columns every family projection keeps ---
ALWAYS_KEPT = (
    "entity", "plugin_id", "month", "window_start", "window_end", "window_year", "window_month",
    "window_index", "had_advisory_this_month", "months_until_next_advisory",
    "future_advisory_count",
)


def family_projection(
    df: DataFrame, prefixes: Sequence[str], keep_time_fields: bool = True
) -> DataFrame:
    """Identity and label columns plus the columns of the wanted families, sorted by name."""
    dropped = () if keep_time_fields else K.WINDOW_COLUMNS
    kept = [
        c for c in sorted(df.columns)
        if (c in ALWAYS_KEPT and c not in dropped) or c.startswith("label_")
        or any(c.startswith(p) for p in prefixes)
    ]
    return df.select(*kept)


def candidate_columns(
    df: DataFrame, target: str, prefixes: Sequence[str] | None = None,
    include_window: bool = False, exclude: Sequence[str] = (),
) -> list[str]:
    """Numeric or boolean columns that may train, by name and type alone."""
    banned = {*K.NEVER_TRAIN_COLUMNS, target, *exclude}
    if not include_window:
        banned |= set(K.WINDOW_COLUMNS)
    return [
        f.name for f in sorted(df.schema.fields, key=lambda f: f.name)
        if f.name not in banned and f.dataType.typeName() in NUMERIC_TYPES
        and (not prefixes or any(f.name.startswith(p) for p in prefixes))
    ]


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null counts per column, from one aggregate."""
    counts = df.agg(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("n_observed"),
                 F.count(F.lit(1)).alias("n_rows")).alias(f"c{i}") for i, c in enumerate(columns)])
    return counts.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))


def select_feature_columns(
    df: DataFrame, target: str, prefixes: Sequence[str] | None = None,
    include_window: bool = False, exclude: Sequence[str] = (),
) -> list[str]:
    """Trainable columns in training order: incident block first, all-null columns dropped."""
    columns = candidate_columns(df, target, prefixes, include_window, exclude)
    if not columns:
        return []
    # one count per column comes back to the driver
    observed = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    kept = [c for c in columns if observed[c] > 0]
    return [c for c in kept if c.startswith(INCIDENT_PREFIXES)] + [
        c for c in kept if not c.startswith(INCIDENT_PREFIXES)]


def split_rows(
    df: DataFrame, strategy: str, test_start: str, group: str = "entity",
    test_fraction: float = 0.2, seed: int = 42,
) -> DataFrame:
    """Adds ``split`` (train or test); rows on neither side are dropped.

    Strategies: time; group by a stable hash of the key; both together.
    """
    late = F.col("month") >= test_start
    has_group = F.col(group).isNotNull() & (F.col(group).cast("string") != "")
    held_out = F.coalesce(has_group & (stable_bucket(F.col(group), seed) < test_fraction),
                          F.lit(False))
    if strategy == "time":
        side = F.when(late, "test").otherwise("train")
    elif strategy == "group":
        side = F.when(held_out, "test").otherwise("train")
    elif strategy == "group_time":
        side = F.when(held_out & late, "test").when(~held_out & ~late, "train")
    else:
        raise ValueError(f"unknown split strategy: {strategy}")
    return df.withColumn("split", side).where(F.col("split").isNotNull())


def embargo_split(
    df: DataFrame, test_start: str, cutoff: str | None = None, test_end: str | None = None,
    horizon: int = 6,
) -> DataFrame:
    """Time split whose training rows end at a cutoff; test rows do not depend on the cutoff.

    ``matured`` is the month by which the label of a row is fully known.
    """
    month = F.col("month")
    in_test = month >= test_start
    if test_end is not None:
        in_test = in_test & (month <= test_end)
    in_train = month < test_start
    if cutoff is not None:
        in_train = in_train & (month <= cutoff)
    side = F.when(in_test, "test").when(in_train, "train")
    return df.withColumns({
        "split": side, "matured": D.add_month_key(month, horizon),
    }).where(F.col("split").isNotNull())


def split_summary(df: DataFrame, target: str) -> DataFrame:
    """Rows, positives, entities and month range per side."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(target) == 1).alias("n_positive"),
        F.count_distinct("entity").alias("n_entities"), F.min("month").alias("first_month"),
        F.max("month").alias("last_month"))


def as_matrix(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Feature columns as doubles; booleans count as 0 and 1."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def number(c: str) -> Column:
        value = F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)
        return value.cast("double").alias(c)

    return df.select(*keep, *[number(c) for c in columns])


def train_medians(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact training median of every column."""
    stacked = matrix.where(F.col("split") == "train").select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])))
    medians = exact_quantiles(stacked, ["column"], F.col("value"), {"median": 0.5})
    return medians.agg(*[
        F.coalesce(F.max(F.when(F.col("column") == c, F.col("median"))), F.lit(0.0))
        .alias(f"median_{c}") for c in columns])


def fill_values(matrix: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """What replaces a missing value of each column: 0 for incident columns, else the training median.

    The incident feed is complete, so a missing value there means no history. One row of medians comes to the driver.
    """
    other = [c for c in columns if not c.startswith(INCIDENT_PREFIXES)]
    medians = train_medians(matrix, other).first().asDict() if other else {}
    return {c: medians.get(f"median_{c}", 0.0) for c in columns}


def missing_columns(matrix: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that lack a value in some row: only these need a filling."""
    if not columns:
        return []
    there = matrix.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns]).first().asDict()
    return [c for c in columns if there[c] < there["_rows"]]


def impute(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values replaced as :func:`fill_values` says, in one plan."""
    zero = [c for c in columns if c.startswith(INCIDENT_PREFIXES)]
    other = [c for c in columns if not c.startswith(INCIDENT_PREFIXES)]
    filled = matrix.fillna(0.0, subset=zero) if zero else matrix
    if not other:
        return filled
    joined = with_constants(filled, train_medians(matrix, other))
    kept = [c for c in matrix.columns if c not in other]
    return joined.select(*kept, *[F.coalesce(c, f"median_{c}").alias(c) for c in other])


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """One row: balanced weights per class, and the negative to positive ratio."""
    y = F.col(target) == 1
    sizes = df.agg(F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg"))
    n = F.col("n_pos") + F.col("n_neg")
    return sizes.select(
        "n_pos", "n_neg", (n / (2 * F.nullif(F.col("n_pos"), F.lit(0)))).alias("weight_pos"),
        (n / (2 * F.nullif(F.col("n_neg"), F.lit(0)))).alias("weight_neg"),
        F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(1.0)
        .alias("neg_pos_ratio"))

"""Forward-looking labels, positional and by calendar, and the density check before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.functions import dates as D

MONTH_ALIASES = ("month", "month_id", "period", "yyyymm")
INDICATOR_ALIASES = (
    "had_advisory_this_month", "has_advisory_this_month", "advisory_this_month",
)


def month_of_row(df: DataFrame) -> Column:
    """Month key of a table, whichever of the accepted column names it uses."""
    for name in MONTH_ALIASES:
        if name in df.columns:
            return D.month_key_from_text(F.col(name).cast("string"))
    raise KeyError(f"no month column; expected one of {MONTH_ALIASES}")


def incident_indicator(df: DataFrame) -> Column:
    """Incident indicator of a table, whichever of the accepted column names it uses."""
    for name in INDICATOR_ALIASES:
        if name in df.columns:
            return F.coalesce(F.col(name).try_cast("boolean"), F.lit(False))
    if "advisory_count_this_month" in df.columns:
        count = F.col("advisory_count_this_month").try_cast("long")
        return F.coalesce(count > 0, F.lit(False))
    raise KeyError(f"no incident indicator; expected one of {INDICATOR_ALIASES}")


def density_violations(df: DataFrame, entity: str = "entity") -> DataFrame:
    """Rows whose month does not directly follow the month before it of the same entity.

    Rows are counted per entity and month first, so repeated months of a hot entity collapse
    before the ordered comparison; each surplus row is still reported on its own.
    """
    month = month_of_row(df)
    months = df.groupBy(F.col(entity).alias("entity"), month.alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    number = D.month_number_of_key(F.col("month"))
    order = Window.partitionBy("entity").orderBy("month_no")
    step = F.col("month_no") - F.col("previous_no")
    compared = months.withColumn("month_no", number).select(
        "*", F.lag("month_no").over(order).alias("previous_no"),
        F.lag("month").over(order).alias("previous_month"))
    gaps = compared.where(step != 1).select(
        "entity", "previous_month", "month", F.lit("gap").alias("violation"),
        (step - 1).alias("missing_months"))
    surplus = months.where(F.col("n") > 1).select(
        "entity", "month", F.explode(F.sequence(F.lit(2).cast("long"), "n")))
    return gaps.unionByName(surplus.select(
        "entity", F.col("month").alias("previous_month"), "month",
        F.lit("duplicate").alias("violation"), F.lit(-1).alias("missing_months")))


def attach_labels(
    df: DataFrame,
    horizons: Sequence[int] = K.LABEL_HORIZONS,
    entity: str = "entity",
    require_dense: bool = True,
) -> DataFrame:
    """Horizon labels from the next rows of each entity, null where the future is cut off.

    The current month never counts. With ``require_dense`` the running query fails on the first
    gap or duplicate month, because the labels are positional. All frames, the check included, run
    over one reversed order, so "following" frames stay incremental.
    """
    month = month_of_row(df)
    backwards = Window.partitionBy(entity).orderBy(F.desc("label_month_no"))
    number = F.col("month_no") if "month_no" in df.columns else D.month_number_of_key(month)
    rows = df.withColumns({"label_month_no": number, "label_had": incident_indicator(df)})
    if require_dense:
        step = F.col("label_month_no") - F.col("label_previous_no")
        message = F.concat(
            F.when(step == 0, "Duplicate month ").otherwise("Month gap before "), month,
            F.lit(" for entity "), F.col(entity).cast("string"),
            F.lit("; labels need one row per consecutive month"),
        )
        rows = rows.withColumn("label_previous_no", F.lead("label_month_no").over(backwards))
        rows = rows.withColumn(
            "label_had",
            F.when(F.col("label_previous_no").isNull() | (step == 1), F.col("label_had"))
            .otherwise(F.raise_error(message).cast("boolean")),
        ).drop("label_previous_no")
    rows = rows.withColumn("label_pos", F.row_number().over(backwards))
    had = F.col("label_had").cast("int")
    later = backwards.rowsBetween(Window.unboundedPreceding, -1)
    added = {
        f"label_advisory_within_{h}m": F.when(
            F.col("label_pos") > h, F.max(had).over(backwards.rowsBetween(-h, -1))
        )
        for h in horizons
    }
    next_pos = F.max(F.when(F.col("label_had"), F.col("label_pos"))).over(later)
    added["months_until_next_advisory"] = F.col("label_pos") - next_pos
    added["future_advisory_count"] = F.coalesce(F.sum(had).over(later), F.lit(0))
    return rows.select("*", *[v.alias(k) for k, v in added.items()]).drop(
        "label_month_no", "label_had", "label_pos"
    )


def calendar_panel(
    grid: DataFrame, incidents: DataFrame, horizons: Sequence[int] = (6,)
) -> DataFrame:
    """Second-ecosystem variant: features strictly before the month, labels by calendar.

    Incidents after the last grid month still make labels positive, and a label is 0 instead of
    null when nothing is known about its later months.
    """
    from riskpanel.operators.panel import incident_months, month_window, new_cve_months, panel_rows

    rows = panel_rows(grid, [incident_months(incidents), new_cve_months(incidents)])
    before = month_window().rangeBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    carried = [c for c in grid.columns if c != "month_no"]
    labels = [
        F.coalesce(
            F.max((F.col("inc_n") > 0).cast("int")).over(month_window().rangeBetween(1, h)), zero
        ).alias(f"label_advisory_within_{h}m")
        for h in horizons
    ]
    return rows.select(
        *carried, "month_no", "in_grid",
        F.coalesce(F.sum("inc_n").over(before), zero).alias("advisory_count_to_date"),
        F.coalesce(F.sum("inc_new_cves").over(before), zero).alias("advisory_cve_count_to_date"),
        F.max("inc_cvss_max").over(before).alias("advisory_max_cvss_to_date"),
        *labels,
    ).where("in_grid").drop("in_grid")


def label_summary(df: DataFrame, horizons: Sequence[int] = K.LABEL_HORIZONS) -> DataFrame:
    """Non-null and positive counts, one row per horizon, from a single aggregate."""
    counts = df.agg(*[
        F.struct(
            F.lit(h).alias("horizon"),
            F.count(f"label_advisory_within_{h}m").alias("non_null"),
            F.count_if(F.col(f"label_advisory_within_{h}m") == 1).alias("positive"),
            F.count(F.lit(1)).alias("n_rows"),
        ).alias(f"h{h}")
        for h in horizons
    ])
    return counts.select(
        F.inline(F.array(*[F.col(f"h{h}") for h in horizons]))
    )

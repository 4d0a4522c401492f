"""Ranking evaluation of prediction tables (entity, month, y_true, y_prob)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.functions import dates as D
from riskpanel.functions import numbers as N
from riskpanel.operators.prefix import running_totals, with_constants

# --- fixed values: named review scenarios ---
SCENARIOS = (
    ("Weekly triage — very tight capacity", 10),
    ("Monthly review — small team", 25),
    ("Quarterly review — moderate capacity", 50),
    ("Semi-annual audit — larger team", 100),
)
ROW_ORDER = ("month", "entity")


def rank_order(ties: Sequence[str] = ROW_ORDER) -> list[Column]:
    """Highest score first; equal scores in the stated order of the tie columns."""
    return [F.desc("y_prob"), *[F.asc(c) for c in ties]]


def top_rows(preds: DataFrame, k: int, ties: Sequence[str] = ROW_ORDER) -> DataFrame:
    """The k best rows with their rank; k rows at most reach the ranking window."""
    best = preds.orderBy(*rank_order(ties)).limit(k)
    order = Window.partitionBy(F.lit(0)).orderBy(*rank_order(ties))
    return best.withColumn("rank", F.row_number().over(order))


def totals(preds: DataFrame) -> DataFrame:
    return preds.agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(F.col("y_true").cast("long")).alias("n_positive"))


def _at_ks(ranked: DataFrame, counted: DataFrame, ks: Sequence[int]) -> DataFrame:
    """True positives among the first k rows, for each k that the table can fill."""
    sums = ranked.agg(*[
        F.struct(F.lit(k).alias("k"), F.coalesce(
            F.sum(F.when(F.col("rank") <= k, F.col("y_true").cast("long"))), F.lit(0))
            .alias("true_positives")).alias(f"k{k}") for k in ks])
    rows = sums.select(F.inline(F.array(*[F.col(f"k{k}") for k in ks])))
    return with_constants(rows, counted).where(F.col("k") <= F.col("n_test"))


def precision_at(preds: DataFrame, ks: Sequence[int] = K.PRECISION_KS) -> DataFrame:
    """Precision among the k best rows; a k beyond the number of rows is left out."""
    rows = _at_ks(top_rows(preds, max(ks)), totals(preds), ks)
    return rows.select("k", (F.col("true_positives") / F.col("k")).alias("precision"))


def operational_table(preds: DataFrame, ks: Sequence[int] = K.OPERATIONAL_KS) -> DataFrame:
    """True and false positives, precision, recall and lift at each k."""
    rows = _at_ks(top_rows(preds, max(ks)), totals(preds), ks)
    precision = F.col("true_positives") / F.col("k")
    base = F.col("n_positive") / F.col("n_test")
    return rows.select(
        "k", "true_positives", (F.col("k") - F.col("true_positives")).alias("false_positives"),
        N.half_even(precision, 4).alias("precision"),
        N.half_even(F.coalesce(N.safe_div(F.col("true_positives"), F.col("n_positive")),
                               F.lit(0.0)), 4).alias("recall"),
        N.half_even(F.coalesce(N.safe_div(precision, base), F.lit(0.0)), 2).alias("lift"))


def scenarios(preds: DataFrame) -> DataFrame:
    table = operational_table(preds, [k for _, k in SCENARIOS])
    label = F.coalesce(*[F.when(F.col("k") == k, text) for text, k in SCENARIOS])
    return table.select(label.alias("label"), "k", "true_positives", "precision", "recall", "lift")


def full_ranking(preds: DataFrame, ties: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Rank and running true positives of every row, computed range by range."""
    return running_totals(preds, rank_order(ties), {
        "rank": F.lit(1).cast("long"), "cum_tp": F.col("y_true").cast("long")})


def recall_targets(preds: DataFrame, targets: Sequence[float] = K.RECALL_TARGETS) -> DataFrame:
    """Rows to review until each share of the positives is found."""
    ranked = with_constants(full_ranking(preds), totals(preds))
    needed = {t: F.ceil(F.lit(t) * F.col("n_positive")) for t in targets}
    found = ranked.agg(
        F.max("n_test").alias("n_test"), F.max("n_positive").alias("n_positive"),
        *[F.min_by(F.struct("rank", "cum_tp"), F.when(F.col("cum_tp") >= need, F.col("rank")))
          .alias(f"t{i}") for i, need in enumerate(needed.values())])
    rows = found.select("n_test", "n_positive", F.inline(F.array(*[
        F.struct(F.lit(t).alias("target_recall"), F.col(f"t{i}.rank").alias("rank"),
                 F.col(f"t{i}.cum_tp").alias("tp")) for i, t in enumerate(needed)])))
    review = F.coalesce("rank", "n_test")
    hits = F.coalesce("tp", "n_positive")
    return rows.select(
        "target_recall", review.alias("plugins_to_review"),
        N.half_even(review / F.col("n_test") * 100, 1).alias("pct_of_ecosystem"),
        F.least(hits, F.col("n_positive")).alias("true_positives"),
        N.half_even(hits / review, 4).alias("precision"))


def best_rows(preds: DataFrame) -> DataFrame:
    """Each entity's highest-scored row; among equal scores the earliest one."""
    order = F.struct(-F.col("y_prob"), F.col("month"))
    return preds.groupBy("entity").agg(
        F.min_by(F.struct("month", "y_true", "y_prob"), order).alias("best")
    ).select("entity", "best.*")


def dedup_precision(preds: DataFrame, ks: Sequence[int] = K.PRECISION_KS) -> DataFrame:
    """Row and entity level precision at k, distinct entities among the top rows, and lift."""
    best = best_rows(preds)
    ranked = top_rows(preds, max(ks))
    distinct = ranked.groupBy("entity").agg(F.min("rank").alias("rank"))
    in_top = distinct.agg(*[
        F.struct(F.lit(k).alias("k"), F.count_if(F.col("rank") <= k).alias("distinct_entities"))
        .alias(f"k{k}") for k in ks]).select(F.inline(F.array(*[F.col(f"k{k}") for k in ks])))
    rows = _at_ks(ranked, totals(preds), ks).select(
        "k", (F.col("true_positives") / F.col("k")).alias("row_precision"))
    entity = _at_ks(top_rows(best, max(ks)), totals(best), ks)
    base = F.col("n_positive") / F.col("n_test")
    precision = F.col("true_positives") / F.col("k")
    return rows.join(in_top, "k").join(entity.select(
        "k", "true_positives", N.half_even(precision, 4).alias("dedup_precision"),
        N.half_even(F.coalesce(N.safe_div(precision, base), F.lit(0.0)), 2).alias("lift"),
        F.col("n_test").alias("n_components"), F.col("n_positive").alias("n_positive_components"),
        N.half_even(base, 6).alias("component_base_rate")), "k", "left")


def precision_coverage(preds: DataFrame) -> DataFrame:
    """Precision and coverage after each entity of the deduplicated ranking."""
    best = best_rows(preds)
    ranked = with_constants(full_ranking(best, ["entity"]), totals(best).select("n_positive"))
    return ranked.select(
        F.col("rank").alias("k"), "cum_tp", (F.col("cum_tp") / F.col("rank")).alias("precision"),
        N.safe_div(F.col("cum_tp"), F.col("n_positive")).alias("coverage"))


def score_steps(preds: DataFrame) -> DataFrame:
    """Per distinct score, highest first: its counts and the counts down to it."""
    histogram = preds.groupBy("y_prob").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("long")).alias("pos"))
    return running_totals(histogram, [F.desc("y_prob")], {
        "cum_n": F.col("n"), "cum_pos": F.col("pos")})


def ranking_quality(preds: DataFrame) -> DataFrame:
    """ROC-AUC with mid-ranks for ties, and average precision as a step sum.

    Both are null unless both classes occur.
    """
    steps = score_steps(preds)
    negatives = F.col("n") - F.col("pos")
    above = F.col("cum_pos") - F.col("pos")
    sums = steps.agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"),
        F.sum(negatives * (above + F.col("pos") / 2)).alias("wins"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("area"))
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return sums.select(
        "n", "pos", F.when(both, F.col("wins") / (F.col("pos") * (F.col("n") - F.col("pos"))))
        .alias("roc_auc"), F.when(both, F.col("area") / F.col("pos")).alias("average_precision"))


def pr_curve(preds: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score, and the closing point."""
    steps = score_steps(preds)
    points = with_constants(steps, totals(preds).select("n_positive")).select(
        F.col("y_prob").alias("threshold"), (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        N.safe_div(F.col("cum_pos"), F.col("n_positive")).alias("recall"))
    end = preds.agg(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                    F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def brier(preds: DataFrame) -> DataFrame:
    """Brier score, the score of always predicting the base rate, and the skill against it."""
    y = F.col("y_true").cast("double")
    base = preds.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("long")).alias("positives"),
        F.avg(y).alias("base_rate"), F.avg(F.pow(F.col("y_prob") - y, F.lit(2))).alias("brier_score"))
    reference = F.col("base_rate") * (1 - F.col("base_rate"))
    return base.select("*", reference.alias("brier_reference"),
                       (1 - N.safe_div(F.col("brier_score"), reference)).alias("brier_skill_score"))


def reliability_bins(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width probability bins: rows, mean probability, observed rate."""
    index = F.least(F.floor(F.col("y_prob") * bins), F.lit(bins - 1))
    return preds.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_prob").alias("mean_probability"),
        F.avg(F.col("y_true").cast("double")).alias("observed_rate"))


def confusion(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, one row."""
    y, hit = F.col("y_true") == 1, F.col("y_prob") >= threshold
    return preds.agg(F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"),
                     F.count_if(y & ~hit).alias("fn"), F.count_if(y & hit).alias("tp"))


def classification_report(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class with macro and weighted means.

    A quotient with an empty denominator is 0.
    """
    cells = confusion(preds, threshold)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(N.safe_div(a, b), F.lit(0.0))

    def line(name: str, right: str, wrong: str, missed: str) -> Column:
        p = ratio(F.col(right), F.col(right) + F.col(wrong))
        r = ratio(F.col(right), F.col(right) + F.col(missed))
        return F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"),
                        ratio(2 * p * r, p + r).alias("f1"),
                        (F.col(right) + F.col(missed)).alias("support"))

    classes = cells.select(line("0", "tn", "fn", "fp").alias("a"), line("1", "tp", "fp", "fn").alias("b"))
    size = F.col("a.support") + F.col("b.support")

    def mean(name: str, weighted: bool) -> Column:
        parts = []
        for m in ("precision", "recall", "f1"):
            if weighted:
                top = F.col(f"a.{m}") * F.col("a.support") + F.col(f"b.{m}") * F.col("b.support")
                parts.append(ratio(top, size).alias(m))
            else:
                parts.append(((F.col(f"a.{m}") + F.col(f"b.{m}")) / 2).alias(m))
        return F.struct(F.lit(name).alias("label"), *parts, size.alias("support"))

    return classes.select(F.inline(F.array(
        F.col("a"), F.col("b"), mean("macro avg", False), mean("weighted avg", True))))


def flag_rule_comparison(snapshot: DataFrame, preds: DataFrame, smallest: int = 1) -> DataFrame:
    """A count rule as a set, and the model at the same review budget.

    ``snapshot`` has entity, advisory_count and positive of one month; ``preds`` the ranking of
    the same month. The budget is the size of the flagged set.
    """
    facts = snapshot.agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if("positive").alias("n_positive"),
        F.count_if(F.col("advisory_count") >= smallest).alias("budget"),
        F.count_if((F.col("advisory_count") >= smallest) & F.col("positive")).alias("rule_tp"))
    ranked = full_ranking(preds, ["entity"])
    model = with_constants(ranked.select("rank", "y_true"), facts.select("budget")).agg(
        F.count_if((F.col("rank") <= F.col("budget")) & (F.col("y_true") == 1)).alias("model_tp"),
        F.count_if(F.col("rank") <= F.col("budget")).alias("model_n"))
    base = F.col("n_positive") / F.col("n_entities")

    def line(name: str, tp: Column, n: Column) -> Column:
        precision = F.coalesce(N.safe_div(tp, n), F.lit(0.0))
        return F.struct(
            F.lit(name).alias("method"), n.alias("n"), tp.alias("true_positives"),
            N.half_even(precision, 4).alias("precision"),
            N.half_even(N.safe_div(tp, F.col("n_positive")), 4).alias("coverage"),
            N.half_even(N.safe_div(precision, base), 1).alias("lift"))

    return with_constants(facts, model).select(F.inline(F.array(
        line("rule", F.col("rule_tp"), F.col("budget")),
        line("model", F.col("model_tp"), F.col("model_n")))))


def heuristic_vs_model(
    snapshot: DataFrame, preds: DataFrame, ks: Sequence[int] = K.PRECISION_KS
) -> DataFrame:
    """Precision and coverage at k of the count ranking and of the model ranking."""
    counted = snapshot.select(
        "entity", F.lit("").alias("month"), F.col("positive").cast("int").alias("y_true"),
        F.col("advisory_count").cast("double").alias("y_prob"))
    facts = totals(counted)

    def side(rows: DataFrame, name: str) -> DataFrame:
        found = _at_ks(top_rows(rows, max(ks), ["entity"]), facts, ks)
        return found.select(
            "k", N.half_even(F.col("true_positives") / F.col("k"), 4).alias(f"{name}_precision"),
            N.half_even(N.safe_div(F.col("true_positives"), F.col("n_positive")), 4)
            .alias(f"{name}_coverage"))

    return side(counted, "heuristic").join(side(preds, "model"), "k")


def tie_groups(snapshot: DataFrame, smallest: int = 1, n: int = 5) -> DataFrame:
    """Number of entities that share each of the highest counts."""
    return (
        snapshot.where(F.col("advisory_count") >= smallest).groupBy("advisory_count")
        .agg(F.count(F.lit(1)).alias("n_entities")).orderBy(F.desc("advisory_count")).limit(n)
    )


def case_study(
    preds: DataFrame, incidents: DataFrame, observed: str, months: int = 6, n: int = 25
) -> DataFrame:
    """The n riskiest entities with the worst incident after their observation month key.

    The lower bound is a text comparison with the month key, so incidents of the observation
    month itself count; the window ends with the last day of the last month.
    """
    ranked = top_rows(best_rows(preds), n)
    text = F.date_format("published", "yyyy-MM-dd")
    end = F.date_format(F.last_day(F.add_months(D.month_start(F.lit(observed)), months)),
                        "yyyy-MM-dd")
    worst = (
        incidents.where((text > observed) & (text <= end))
        .join(ranked.select("entity"), "entity", "left_semi")
        .groupBy("entity")
        .agg(F.min_by(F.struct("published", "cvss"),
                      F.struct(-F.coalesce("cvss", F.lit(0.0)), F.col("published"))).alias("w"))
    )
    start = D.month_start(F.lit(observed))
    return ranked.join(worst, "entity", "left").select(
        "rank", "entity", F.col("y_prob").alias("score"),
        (F.col("w").isNotNull() | (F.col("y_true") == 1)).alias("confirmed"),
        F.col("w.published").alias("adv_date"), F.col("w.cvss").alias("adv_cvss"),
        F.datediff(F.col("w.published"), start).alias("days_to_adv"))


def metric_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metrics of two runs side by side; tables are (model, average_precision, roc_auc)."""
    metrics = ("average_precision", "roc_auc")
    b, a = (t.select("model", *[F.col(m).alias(f"{m}_{side}") for m in metrics])
            for t, side in ((before, "before"), (after, "after")))
    return b.join(a, "model", "full_outer").select(
        "model", *[c for m in metrics for c in (
            F.col(f"{m}_before"), F.col(f"{m}_after"),
            N.half_even(F.col(f"{m}_after") - F.col(f"{m}_before"), 4).alias(f"{m}_delta"))])


def largest_movers(diff: DataFrame, n: int = 5) -> DataFrame:
    delta = F.col("average_precision_delta")
    return diff.where(delta.isNotNull()).orderBy(F.desc(F.abs(delta)), "model").limit(n).select(
        "model", "average_precision_delta")


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys only on one side, label disagreements, and the largest score difference."""
    keys = ["entity", "month"]
    a = left.select(*keys, F.col("y_true").alias("a_true"), F.col("y_prob").alias("a_prob"))
    b = right.select(*keys, F.col("y_true").alias("b_true"), F.col("y_prob").alias("b_prob"))
    both = F.col("a_true").isNotNull() & F.col("b_true").isNotNull()
    return a.join(b, keys, "full_outer").agg(
        F.count_if(F.col("b_true").isNull()).alias("only_left"),
        F.count_if(F.col("a_true").isNull()).alias("only_right"),
        F.count_if(both).alias("in_both"),
        F.count_if(both & (F.col("a_true") != F.col("b_true"))).alias("label_disagreements"),
        F.max(F.abs(F.col("a_prob") - F.col("b_prob"))).alias("max_abs_diff"))


def key_set_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes of the differences and of the intersection of two key sets."""
    a = left.select(*keys).distinct().withColumn("in_left", F.lit(1))
    b = right.select(*keys).distinct().withColumn("in_right", F.lit(1))
    joined = a.join(b, list(keys), "full_outer")
    return joined.agg(
        F.count_if(F.col("in_right").isNull()).alias("only_left"),
        F.count_if(F.col("in_left").isNull()).alias("only_right"),
        F.count_if(F.col("in_left").isNotNull() & F.col("in_right").isNotNull()).alias("shared"))


def duplicate_key_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
                       F.count_if(F.col("n") > 1).alias("n_duplicated_keys"))


def metric_table(documents: DataFrame) -> DataFrame:
    """Metric documents (run, payload JSON) as one table, with fallbacks for older key names."""
    def pick(kind: str, *paths: str) -> Column:
        values = [F.get_json_object("payload", f"$.{p}").try_cast(kind) for p in paths]
        # zero counts as absent, as older documents wrote it for unknown
        return F.coalesce(*[F.when(v != 0, v) for v in values], *values)

    return documents.select(
        "run", pick("long", "feature_count", "n_features", "features").alias("features"),
        pick("long", "train_row_count", "train_rows").alias("train_rows"),
        pick("long", "test_row_count", "test_rows").alias("test_rows"),
        pick("long", "train_positive_count", "train_positives", "train_pos").alias("train_pos"),
        pick("long", "test_positive_count", "test_positives", "test_pos").alias("test_pos"),
        pick("double", "roc_auc").alias("roc_auc"),
        pick("double", "average_precision", "avg_precision").alias("avg_prec"),
        *[pick("double", f"ranking_metrics.precision_at_{k}", f"precision_at_{k}")
          .alias(f"p_at_{k}") for k in (10, 25, 100)],
    ).orderBy(F.desc_nulls_last("avg_prec"), "run")

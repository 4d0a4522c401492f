"""Severity scores and labels of incident records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.functions.numbers import finite_double


def _metric(vector: Column, name: str) -> Column:
    """Value of one metric; when a vector repeats a metric its last mention counts."""
    return F.regexp_extract(vector, rf"^[^/]*/(?:.*/)?{name}:([^/]*)", 1)


def _weight(value: Column, table: dict[str, float]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def cvss3_base_score(vector: Column) -> Column:
    """Base score of a version 3 vector; a vector that lacks a base metric scores null."""
    weights = K.CVSS_WEIGHTS
    read = _let(
        F.named_struct(*[x for m in ("AV", "AC", "PR", "UI", "S", "C", "I", "A")
                         for x in (F.lit(m), _metric(vector, m))]),
        lambda m: F.named_struct(
            F.lit("changed"), m["S"] == "C",
            F.lit("reach"), (F.lit(8.22) * _weight(m["AV"], weights["AV"]) * _weight(m["AC"], weights["AC"])
             * F.when(m["S"] == "C", _weight(m["PR"], weights["PR_CHANGED"]))
             .otherwise(_weight(m["PR"], weights["PR_UNCHANGED"]))
             * _weight(m["UI"], weights["UI"])),
            F.lit("loss"), (F.lit(1.0) - (F.lit(1.0) - _weight(m["C"], weights["CIA"]))
             * (F.lit(1.0) - _weight(m["I"], weights["CIA"]))
             * (F.lit(1.0) - _weight(m["A"], weights["CIA"]))),
        ),
    )
    rated = _let(
        read,
        lambda r: F.named_struct(
            F.lit("changed"), r["changed"], F.lit("reach"), r["reach"],
            F.lit("impact"), F.when(
                r["changed"],
                F.lit(7.52) * (r["loss"] - 0.029)
                - F.lit(3.25) * F.pow(r["loss"] - 0.02, F.lit(15.0)),
            ).otherwise(F.lit(6.42) * r["loss"]),
        ),
    )

    def score(r: Column) -> Column:
        total = F.when(r["changed"], F.lit(1.08) * (r["impact"] + r["reach"])).otherwise(
            r["impact"] + r["reach"])
        rounded_up = F.ceil(F.least(total, F.lit(10.0)) * 10.0 + 1e-10) / F.lit(10.0)
        return F.when(r["reach"].isNotNull() & r["impact"].isNotNull(),
                      F.when(r["impact"] <= 0, F.lit(0.0)).otherwise(rounded_up))

    return F.when(vector.startswith("CVSS:3"), _let(rated, score))


def severity_label(score: Column) -> Column:
    return (
        F.when(score <= 0.0, "none")
        .when(score < 4.0, "low")
        .when(score < 7.0, "medium")
        .when(score < 9.0, "high")
        .when(score.isNotNull(), "critical")
    )


def severity_rank(label: Column) -> Column:
    pairs = [F.lit(x) for item in K.SEVERITY_RANK.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(label)), F.lit(-1))


def max_severity_label(labels: Column) -> Column:
    """Worst label of an array; unknown labels rank below every known one."""
    ranked = F.transform(labels, lambda x: F.struct(severity_rank(x).alias("r"),
                                                    F.lower(x).alias("l")))
    return F.array_max(F.filter(ranked, lambda s: s["r"] >= 0))["l"]


def severity_bonus(score: Column) -> Column:
    """Points per record; a record without a score earns none."""
    bonus = K.SEVERITY_BONUS
    return (
        F.when(score == 0.0, bonus["none"])
        .when(score < 4.0, bonus["low"])
        .when(score < 7.0, bonus["medium"])
        .when(score < 9.0, bonus["high"])
        .when(score.isNotNull(), bonus["critical"])
        .otherwise(0)
    )


def flat_record_score(
    cvss: Column, summary_scores: Column | None = None, leaf_scores: Column | None = None
) -> Column:
    """Largest parseable score among the record, its summary and its flat leaf scores."""
    candidates = F.array(cvss.cast("string"))
    for extra in (summary_scores, leaf_scores):
        if extra is not None:
            extra = F.coalesce(extra, F.array().cast("array<string>"))
            candidates = F.concat(candidates, F.transform(extra, lambda x: x.cast("string")))
    return F.array_max(F.transform(candidates, finite_double))


def nested_record_score(vulnerabilities: Column, summary_score: Column) -> Column:
    """Largest nested base score; the summary only counts when no nested score exists."""
    nested = F.array_max(
        F.transform(vulnerabilities, lambda v: v["cvss"]["base_score"].try_cast("double"))
    )
    return F.coalesce(nested, summary_score.try_cast("double"))


def record_cve_ids(direct: Column, leaf_ids: Column | None = None) -> Column:
    """Distinct trimmed non-empty ids from the record and from its vulnerabilities."""
    empty = F.array().cast("array<string>")
    merged = F.coalesce(direct, empty)
    if leaf_ids is not None:
        merged = F.concat(merged, F.coalesce(leaf_ids, empty))
    trimmed = F.transform(merged, lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def cve_ids_from_aliases(aliases: Column, related: Column) -> Column:
    empty = F.array().cast("array<string>")
    upper = F.transform(
        F.concat(F.coalesce(aliases, empty), F.coalesce(related, empty)), lambda x: F.upper(x)
    )
    return F.array_sort(F.array_distinct(F.filter(upper, lambda x: x.startswith("CVE-"))))

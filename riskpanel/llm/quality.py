"""Quality classifier: naive Bayes support vectors.

Word and word-shape n-gram indicators are scaled by class log-count ratios; a linear hinge-loss model
is fitted on them by dual coordinate descent. Fitting uses a bounded sample of the labelled rows
(``fit_rows``, drawn by a hash of the id), so labels reach the text by a broadcast of a proven size and
fitting is one small task whatever the table's size. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.common import id_remainder

FEATURE_BITS = 18
FIT_ROWS = 8000
PART_WORDS = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def shapes(words: list[bytes]) -> list[bytes]:
    """A word's first and last byte class, a length class, and whether it repeats the word before it."""
    kinds = SHAPE_OF
    return [
        b"%c%c%c%c" % (kinds[w[0]], kinds[w[-1]], min(len(w), 12) // 4 + 65, 61 if w == before else 126)
        for before, w in zip([b""] + words[:-1], words)
    ]


def byte_class(code: int) -> int:
    """Letters, capitals, digits and bytes of other scripts by class; other signs stand for themselves."""
    if 97 <= code <= 122:
        return 97
    if 65 <= code <= 90:
        return 65
    if 48 <= code <= 57:
        return 48
    return 128 if code >= 128 else code


SHAPE_OF = bytes(byte_class(code) for code in range(256))


def hashed(keys: np.ndarray, kind: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (keys + np.uint64(kind)) * MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def indicators(text: str | None, bits: int = FEATURE_BITS) -> np.ndarray:
    """Distinct hashed features of a whole text: uni- and bigrams of words, uni- to trigrams of shapes.

    Texts are read in parts of ``PART_WORDS`` words, overlapping by two, so memory stays bounded.
    """
    words = (text or "").encode("utf-8", "replace").split()
    found: list[np.ndarray] = []
    for at in range(0, max(len(words), 1), PART_WORDS):
        part = words[max(at - 2, 0) : at + PART_WORDS]
        low = np.fromiter((zlib.crc32(w) for w in map(bytes.lower, part)), np.uint64, len(part))
        shape = np.fromiter(map(zlib.crc32, shapes(part)), np.uint64, len(part))
        with np.errstate(over="ignore"):
            one, two = np.uint64(1000003), np.uint64(8191)
            keys = [low, low[:-1] * one + low[1:], shape, shape[:-1] * one + shape[1:]]
            keys.append(shape[:-2] * one * two + shape[1:-1] * one + shape[2:])
        found.append(np.unique(np.concatenate([hashed(k, kind, bits) for kind, k in enumerate(keys)])))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float) -> np.ndarray:
    counts = np.full((2, 1 << bits), alpha)
    for row, label in zip(rows, labels, strict=True):
        counts[label, row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(
    rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: float, epochs: int, seed: int
) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias of rows ``scale[row]``, each brought to length 1."""
    weights, bias = np.zeros(len(scale)), 0.0
    alphas = np.zeros(len(rows))
    signs = np.where(labels > 0, 1.0, -1.0)
    values = [unit(scale[row]) for row in rows]
    diagonal = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        widest = 0.0
        for i in order.permutation(len(rows)):
            row, value = rows[i], values[i]
            gradient = signs[i] * (weights[row] @ value + bias) - 1.0
            fresh = min(max(alphas[i] - gradient / diagonal[i], 0.0), cost)
            step = (fresh - alphas[i]) * signs[i]
            if step:
                weights[row] += step * value
                bias += step
                alphas[i] = fresh
                widest = max(widest, abs(step))
        if widest < 1e-3:
            break
    return weights, bias


def unit(values: np.ndarray) -> np.ndarray:
    return values / max(float(np.sqrt(values @ values)), 1e-12)


def logistic_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities; the slope is never negative."""
    high, low = labels.sum(), len(labels) - labels.sum()
    wanted = np.where(labels > 0, (high + 1) / (high + 2), 1 / (low + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - wanted) * margins).sum(), (p - wanted).sum()])
        h = np.array([[(w * margins**2).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(slope), 0.0), float(offset)


def fit_model(
    rows: list[np.ndarray], labels: np.ndarray, *, bits: int = FEATURE_BITS, alpha: float = 1.0, cost: float = 1.0,
    epochs: int = 20, seed: int = 17,
) -> dict[str, np.ndarray | float]:
    """Linear weights, squared ratios for row lengths, and a logistic fit on margins of unseen thirds."""
    if len(labels) < 6 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        zero = np.zeros(1 << bits, np.float32)
        return {"weights": zero, "squares": zero, "bias": 0.0, "slope": 0.0, "offset": float(np.log(share / (1 - share)))}

    def fit(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        own = [rows[i] for i in keep]
        ratios = log_count_ratios(own, labels[keep], bits, alpha)
        weights, bias = dual_coordinate_descent(own, ratios, labels[keep], cost, epochs, seed)
        return ratios, weights, bias

    folds = np.random.default_rng(seed).permutation(len(labels)) % 3
    margins = np.zeros(len(labels))
    for k in range(3):
        ratios, weights, bias = fit(np.flatnonzero(folds != k))
        for i in np.flatnonzero(folds == k):
            margins[i] = unit(ratios[rows[i]]) @ weights[rows[i]] + bias
    slope, offset = logistic_fit(margins, labels)
    ratios, weights, bias = fit(np.arange(len(labels)))
    return {
        "weights": (ratios * weights).astype(np.float32), "squares": (ratios * ratios).astype(np.float32),
        "bias": bias, "slope": slope, "offset": offset,
    }


def score_text(text: str | None, model: dict) -> float:
    row = indicators(text, int(model["weights"].size).bit_length() - 1)
    length = max(float(np.sqrt(model["squares"][row].sum(dtype=np.float64))), 1e-12)
    margin = model["weights"][row].sum(dtype=np.float64) / length + model["bias"]
    return float(1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -30, 30))))


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """About ``fit_rows`` labelled rows outside the held-out quarter, by a hash of the id.

    Of several labels of one id the majority holds; a tie leaves the id out.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), 4) != 2))
        .groupBy("doc_id").agg(F.avg("quality").alias("share")).where("share <> 0.5")
        .select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"))
    )
    rows = known.count()
    parts = 1 << 20
    keep = parts if rows <= fit_rows else max(1, parts * fit_rows // rows)
    place = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(parts))
    few = known.where(place < keep)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, bits: int = FEATURE_BITS) -> dict:
    """The fitted model of a bounded sample; features are made where the text is, fitting is one task."""

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "label": batch["label"],
                "row": [indicators(t, bits).astype(np.int32).tobytes() for t in batch["text"]],
            })

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        own = pd.concat(parts).sort_values(["doc_id", "row"], kind="stable")
        rows = [np.frombuffer(r, np.int32) for r in own["row"]]
        model = fit_model(rows, own["label"].to_numpy(), bits=bits)
        yield pd.DataFrame({k: [v.tobytes() if isinstance(v, np.ndarray) else v] for k, v in model.items()})

    sample = labelled_sample(docs, labels, fit_rows)
    rows = sample.mapInPandas(featured, "doc_id long, label int, row binary").repartition(1)
    shape = "weights binary, squares binary, bias double, slope double, offset double"
    got = rows.mapInPandas(fitted, shape).collect()
    if not got:
        return fit_model([], np.zeros(0, int), bits=bits)
    model = got[0].asDict()
    return model | {k: np.frombuffer(model[k], np.float32) for k in ("weights", "squares")}


def scorer(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """Score column of a text column; the model is a broadcast of two arrays of ``2 ** bits`` floats."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        held = shared.value
        return pd.Series([score_text(t, held) for t in texts], dtype="float64")

    return score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts have no features and get the score of a margin equal to the bias. Rows with
    a null id are scored like others; their remainder is that of an empty text. Repeated rows stay.
    Without labels of both kinds the score is the smoothed share of label 1. Empty tables give no rows.
    """
    model = train(docs, labels, fit_rows=fit_rows)
    return docs.select(
        "doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), scorer(docs, model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; all columns stay as they are."""
    model = train(docs, labels, fit_rows=fit_rows)
    return docs.where(scorer(docs, model) >= threshold)

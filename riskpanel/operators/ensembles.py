"""Tree ensembles fitted on rows that are merged once their values are binned.

MLlib's trees see a value only by its bin, so rows of equal bins, label and weight are one row that counts several times:
every sample takes as many of them as it would have taken of single rows. Boosting is one task whose levels are sums over bins,
a forest deals its trees to tasks. Splits, gains, leaves, residuals, weights of trees and pruning are MLlib's, and so is the
model: it is written in MLlib's own form and loaded by it. Tables that stay too large once merged are fitted by MLlib itself.
"""

from __future__ import annotations

import json
import math
import sys
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.session import materialize, scratch_path

# Workers receive these functions themselves; the package need not be installed beside the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of merged rows (a byte each) that one task takes in.
TASK_BINS = 100_000_000
#: Deepest boosted trees grown here: a level holds the sums of all its nodes.
DEEPEST = 8
#: Bins that features counted in one go have together.
JOINT = 1024
#: Different values of a feature that a task keeps before it hands their counts on.
KEPT_VALUES = 200_000
#: Gains below this share of what they are a difference of are rounding.
NOISE = 1e-12
NODES = ("treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
         "leftChild int, rightChild int, feature int, threshold double")


# --- bins ---

def thresholds(values: np.ndarray, weights: np.ndarray, n_bins: int) -> np.ndarray:
    """Where a feature's sorted distinct values are cut: between all of them, or after like shares of the weight."""
    middle = values[:-1] + (values[1:] - values[:-1]) / 2
    if len(values) <= n_bins:
        return middle
    stride, total = weights.sum() / n_bins, np.cumsum(weights).tolist()
    target, found = stride, []
    for at in range(1, len(values)):
        before, after = abs(total[at - 1] - target), abs(total[at] - target)
        if before < after:
            found.append(middle[at - 1])
            target += stride
    return np.array(found[: n_bins - 1])


def _matrix(batch: pa.RecordBatch, n_features: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)


def bin_edges(rows: DataFrame, n_features: int, n_bins: int) -> list[np.ndarray]:
    """Thresholds of each feature from all rows of ``features array<double>, weight``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0), np.zeros(0)) for _ in range(n_features)]

        def handed(at: int) -> pa.RecordBatch:
            values, weights = kept[at]
            kept[at] = (np.zeros(0), np.zeros(0))
            return pa.RecordBatch.from_pydict({"feature": np.full(len(values), at, np.int32), "value": values, "weight": weights})

        for batch in batches:
            matrix, weight = _matrix(batch, n_features), batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(n_features):
                column = np.concatenate([kept[at][0], matrix[:, at] + 0.0])
                own = np.concatenate([kept[at][1], weight])
                there = ~np.isnan(column)
                values, which = np.unique(column[there], return_inverse=True)
                kept[at] = (values, np.bincount(which, own[there], len(values)))
                if len(values) > KEPT_VALUES:
                    yield handed(at)
        for at in range(n_features):
            if len(kept[at][0]):
                yield handed(at)

    def cut(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("value")
        edges = thresholds(of["value"].to_numpy(), of["weight"].to_numpy(), n_bins)
        return pd.DataFrame({"feature": of["feature"][:1], "edges": [edges.tobytes()]})

    counts = rows.select("features", "weight").mapInArrow(counted, "feature int, value double, weight double")
    counts = counts.groupBy("feature", "value").agg(F.sum("weight").alias("weight"))
    found = {r["feature"]: np.frombuffer(r["edges"]) for r in counts.groupBy("feature").applyInPandas(
        cut, "feature int, edges binary").collect()}  # one row of fixed size per feature
    return [found.get(at, np.zeros(0)) for at in range(n_features)]


def merge_rows(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """``bins, label, weight, n``: rows of equal bins, label and weight, and how many they are. Uncut features have no bin."""
    cut = [at for at, own in enumerate(edges) if len(own)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch, len(edges))
            bins = np.empty((len(matrix), len(cut)), np.uint8)
            for i, at in enumerate(cut):
                bins[:, i] = np.searchsorted(edges[at], matrix[:, at], side="left")
            width = pa.binary(len(cut)) if cut else pa.binary()
            own = pa.FixedSizeBinaryArray.from_buffers(width, len(matrix), [None, pa.py_buffer(bins.tobytes())]).cast(
                pa.binary()) if cut else pa.array([b""] * len(matrix), pa.binary())
            yield pa.RecordBatch.from_arrays([own, batch.column(1), batch.column(2)], ["bins", "label", "weight"])

    found = rows.select("features", "label", "weight").mapInArrow(binned, "bins binary, label double, weight double")
    return found.groupBy("bins", "label", "weight").agg(F.count(F.lit(1)).alias("n"))


class Rows:
    """Merged rows in a fixed order: bins by feature, label, weight and number."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, n: np.ndarray) -> None:
        self.bins, self.label, self.weight, self.n = bins, label, weight, n

    @staticmethod
    def of(parts: list[tuple], n_cut: int) -> Rows:
        """Rows out of ``bins, label, weight, n`` in bytes; their order hangs on their content only."""
        bins = np.concatenate([np.frombuffer(p[0], np.uint8).reshape(-1, n_cut) if n_cut else np.zeros((len(p[1]) // 8, 0), np.uint8)
                               for p in parts])
        label, weight = (np.concatenate([np.frombuffer(p[i]) for p in parts]) for i in (1, 2))
        n = np.concatenate([np.frombuffer(p[3], np.int64) for p in parts])
        whole = np.concatenate([bins, label.astype(">f8").view(np.uint8).reshape(-1, 8), weight.astype(">f8").view(np.uint8).reshape(-1, 8)], axis=1)
        order = np.argsort(np.ascontiguousarray(whole).view(f"S{whole.shape[1]}").ravel(), kind="stable")
        return Rows(np.ascontiguousarray(bins[order].T), label[order], weight[order], n[order])


def packed(batch: pa.RecordBatch) -> tuple[bytes, bytes, bytes, bytes]:
    """A batch of :func:`merge_rows` in bytes."""
    return (b"".join(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False).tobytes(),
            batch.column(2).to_numpy(zero_copy_only=False).tobytes(), batch.column(3).to_numpy(zero_copy_only=False).tobytes())


# --- nodes ---

class Nodes:
    """Nodes of a tree while it grows."""

    def __init__(self) -> None:
        self.stats, self.raw, self.impurity, self.prediction, self.gain, self.split, self.children = [], [], [], [], [], [], []

    def add(self, stats: list[float], raw: int, impurity: float, prediction: float) -> int:
        for kept, value in ((self.stats, stats), (self.raw, raw), (self.impurity, impurity), (self.prediction, prediction),
                            (self.gain, -1.0), (self.split, None), (self.children, None)):
            kept.append(value)
        return len(self.raw) - 1

    def part(self, node: int, gain: float, feature: int, at: int, children: tuple[int, int]) -> None:
        self.gain[node], self.split[node], self.children[node] = gain, (feature, at), children

    def prune(self) -> None:
        """Children that are leaves and say the same are their parent; children have higher numbers than parents."""
        for node in range(len(self.raw) - 1, -1, -1):
            if self.children[node]:
                a, b = self.children[node]
                if not self.children[a] and not self.children[b] and self.prediction[a] == self.prediction[b]:
                    self.gain[node], self.split[node], self.children[node] = -1.0, None, None

    def table(self, tree: int, cut: list[int], edges: list[np.ndarray]) -> pd.DataFrame:
        """Rows of ``NODES``, parents before their left, then their right branch."""
        order, waiting = [], [0]
        while waiting:
            node = waiting.pop()
            order.append(node)
            waiting += reversed(self.children[node] or ())
        number = {node: i for i, node in enumerate(order)}
        rows = []
        for node in order:
            feature, at = self.split[node] or (None, 0)
            left, right = self.children[node] or (None, None)
            rows.append((tree, number[node], self.prediction[node], self.impurity[node], self.stats[node], int(self.raw[node]), self.gain[node],
                         number.get(left, -1), number.get(right, -1), -1 if feature is None else cut[feature],
                         None if feature is None else float(edges[cut[feature]][at])))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])


def subset_size(strategy: str, n_features: int, default: str) -> int:
    """Features that each node looks at, by MLlib's names, shares and numbers."""
    strategy = default if strategy == "auto" else strategy
    named = {"all": n_features, "sqrt": math.ceil(math.sqrt(n_features)), "onethird": math.ceil(n_features / 3),
             "log2": max(1, math.ceil(math.log2(n_features)))}
    if strategy in named:
        return named[strategy]
    if strategy.isdigit():
        return min(int(strategy), n_features)
    return math.ceil(float(strategy) * n_features)


# --- boosting ---

class Booster:
    """Boosted regression trees of the log loss, on merged rows of one task."""

    def __init__(self, rows: Rows, n_features: int, looked: int, depth: int, sampled: float, least_gain: float, seed: int) -> None:
        self.rows, self.n_features, self.looked, self.depth = rows, n_features, looked, depth
        self.sampled, self.least_gain = sampled, least_gain
        self.rng = np.random.default_rng(seed)
        self.sizes = rows.bins.max(axis=1).astype(np.int64) + 1 if rows.bins.size else np.zeros(0, np.int64)
        self.bundles = self.bundled()
        self.joint = np.zeros((len(self.bundles), rows.bins.shape[1]), np.uint16)
        for at, bundle in enumerate(self.bundles):
            for f in bundle:
                self.joint[at] = self.joint[at] * np.uint16(self.sizes[f]) + rows.bins[f]
        self.most = int(self.sizes.max(initial=1))

    def bundled(self) -> list[list[int]]:
        """Features in groups that have ``JOINT`` bins together at most: sums over joint bins hold those over each."""
        found: list[list[int]] = []
        room = 0
        for f in np.argsort(self.sizes, kind="stable").tolist():
            if not found or room // self.sizes[f] < 1:
                found.append([])
                room = JOINT
            found[-1].append(f)
            room //= self.sizes[f]
        return found

    def sums(self, joint: np.ndarray, base: np.ndarray | None, pick: np.ndarray | None, n_nodes: int, values: list[np.ndarray]) -> np.ndarray:
        """Sums of each of ``values`` by node, feature and bin."""
        out = np.zeros((len(values), n_nodes, len(self.sizes), self.most))
        for at, bundle in enumerate(self.bundles):
            sizes = self.sizes[bundle]
            whole = int(sizes.prod())
            place = joint[at] if pick is None else joint[at].take(pick)
            place = place.astype(np.intp) if base is None else base * whole + place
            for i, value in enumerate(values):
                cells = np.bincount(place, value, n_nodes * whole).reshape(n_nodes, *sizes)
                for j, f in enumerate(bundle):
                    other = tuple(1 + k for k in range(len(bundle)) if k != j)
                    out[i, :, f, : sizes[j]] = cells.sum(axis=other) if other else cells
        return out

    def tree(self, target: np.ndarray) -> tuple[Nodes, np.ndarray]:
        """One tree on a sample of the rows, and its value for each of all rows."""
        rows, rng = self.rows, self.rng
        took = rows.n if self.sampled >= 1 else rng.binomial(rows.n, self.sampled)
        inside = np.flatnonzero(took)
        joint = self.joint if len(inside) == len(took) else self.joint.take(inside, axis=1)
        raw = took[inside].astype(np.float64)
        w = raw * rows.weight[inside]
        y = target[inside]
        wy = w * y
        nodes = Nodes()
        here, at = np.arange(len(inside)), np.zeros(len(inside), np.intp)  # rows and their places in the level; those of leaves leave it
        total = [float(x.sum()) for x in (w, wy, wy * y)]
        tiny = 1e-11 * total[0]

        def add(sums: list[float], count: float) -> int:
            n, of_y, of_yy = map(float, sums)
            mean = of_y / n if n else 0.0
            return nodes.add([n, of_y, of_yy], int(count), max(0.0, of_yy / n - mean * mean) if n else 0.0, mean)

        level = [add(total, raw.sum())]
        held = self.sums(joint, None, None, 1, [w, wy]) if len(self.sizes) and self.depth else None
        for depth in range(self.depth if held is not None else 0):
            gains, features, cuts = self.best(held, np.array([nodes.stats[n] for n in level]), tiny)
            open_ = np.flatnonzero(gains > 0)
            if not len(open_):
                break
            slot = np.full(len(level), -1)
            slot[open_] = np.arange(len(open_))
            stay = slot[at] >= 0
            here, at = here[stay], slot[at[stay]]
            f, c = features[open_], cuts[open_]
            right = rows.bins[f[at], inside[here]] > c[at]
            child = 2 * at + right
            n_child = 2 * len(open_)
            counts = np.bincount(child, raw[here], n_child)
            own = [np.bincount(child, v[here], n_child) for v in (w, wy, wy * y)]
            new = []
            for i, parent in enumerate(open_):
                a, b = (add([v[2 * i + side] for v in own], counts[2 * i + side]) for side in (0, 1))
                nodes.part(level[parent], float(gains[parent]), int(f[i]), int(c[i]), (a, b))
                new += [a, b]
            if depth + 1 < self.depth:
                length = np.bincount(child, minlength=n_child).reshape(-1, 2)
                less = (length[:, 1] < length[:, 0]).astype(np.intp)
                picked = np.flatnonzero(right == less[at].astype(bool))
                pick = here[picked]
                part = self.sums(joint, at[picked], pick, len(open_), [w[pick], wy[pick]])
                rest = held[:, open_] - part
                held = np.empty((2, n_child, *held.shape[2:]))
                held[:, 2 * np.arange(len(open_)) + less] = part
                held[:, 2 * np.arange(len(open_)) + 1 - less] = rest
            level, at = new, child
        nodes.prune()
        return nodes, self.values(nodes)

    def best(self, held: np.ndarray, stats: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each node its best gain (0: none), feature and bin."""
        n_nodes, n_cut = len(stats), len(self.sizes)
        left_w, left_y = np.cumsum(held[0], axis=2)[:, :, :-1], np.cumsum(held[1], axis=2)[:, :, :-1]
        all_w, all_y = stats[:, 0, None, None], stats[:, 1, None, None]
        right_w = all_w - left_w
        fits = (left_w > tiny) & (right_w > tiny)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = left_y**2 / left_w + (all_y - left_y) ** 2 / right_w - all_y**2 / all_w
        fits &= (np.arange(self.most - 1)[None, :] < (self.sizes - 1)[:, None])[None]
        if self.looked < self.n_features:
            seen = self.rng.random((n_nodes, self.n_features)).argsort(axis=1)[:, : self.looked]
            asked = np.zeros((n_nodes, self.n_features), bool)
            np.put_along_axis(asked, seen, True, axis=1)
            fits &= asked[:, :n_cut, None]  # which features are cut is no matter of chance, so the first stand for them
        score = np.where(fits, score, -1.0).reshape(n_nodes, -1)
        if not score.shape[1]:
            return np.zeros(n_nodes), np.zeros(n_nodes, int), np.zeros(n_nodes, int)
        found = score.argmax(axis=1)
        top = score[np.arange(n_nodes), found]
        gain = np.where(top > NOISE * np.maximum(stats[:, 2], 1e-300), top / stats[:, 0], 0.0)
        gain[gain < self.least_gain] = 0.0
        feature, at = np.divmod(found, self.most - 1)
        return gain, feature, at

    def values(self, nodes: Nodes) -> np.ndarray:
        n = len(nodes.raw)
        feature, cut, left, right = np.zeros(n, np.intp), np.full(n, 255), np.arange(n), np.arange(n)
        for node in range(n):
            if nodes.children[node]:
                (feature[node], cut[node]), (left[node], right[node]) = nodes.split[node], nodes.children[node]
        at = np.zeros(self.rows.bins.shape[1], np.intp)
        every = np.arange(len(at))
        for _ in range(self.depth if self.rows.bins.size else 0):
            at = np.where(self.rows.bins[feature[at], every] > cut[at], right[at], left[at])
        return np.array(nodes.prediction)[at]

    def grow(self, n_trees: int, step: float) -> Iterator[Nodes]:
        """Trees in turn: the first fits the labels, each other one what is left of them."""
        sign = 2 * self.rows.label - 1
        raw = np.zeros(len(sign))
        for tree in range(n_trees):
            nodes, values = self.tree(4 * sign / (1 + np.exp(2 * sign * raw)) if tree else sign)
            raw += values if tree == 0 else step * values
            yield nodes


# --- forests ---

def forest_tree(rows: Rows, by_row: np.ndarray, n_features: int, looked: int, depth: int, least: int, least_gain: float,
                sampled: float, bootstrap: bool, seed: list[int]) -> Nodes:
    """One classification tree on a sample of the rows; ``by_row`` are their bins, row by row."""
    rng = np.random.default_rng(seed)
    if bootstrap:
        took = rng.poisson(rows.n * sampled)
    else:
        took = rows.n if sampled >= 1 else rng.binomial(rows.n, sampled)
    nodes, n_cut = Nodes(), by_row.shape[1]
    size = int(by_row.max(initial=0)) + 1
    raw = took.astype(np.float64)
    weight = raw * rows.weight
    ones = weight * rows.label
    zeros = weight - ones

    def add(inside: np.ndarray) -> int:
        a, b = float(zeros[inside].sum()), float(ones[inside].sum())
        share = b / (a + b) if a + b else 0.0
        return nodes.add([a, b], int(raw[inside].sum()), 2 * share * (1 - share), float(b > a))

    inside = np.flatnonzero(took)
    waiting = [(add(inside), inside, 0)]
    while waiting:
        node, inside, level = waiting.pop()
        a, b = nodes.stats[node]
        if level >= depth or not a or not b or nodes.raw[node] < 2 * least or not n_cut:
            continue
        asked = rng.permutation(n_features)[:looked]
        asked = asked[asked < n_cut]  # features without a cut offer none
        if not len(asked):
            continue
        place = (by_row[inside[:, None], asked] + np.arange(len(asked)) * size).ravel()
        each = len(asked) * size
        sums = [np.cumsum(np.bincount(place, np.repeat(v[inside], len(asked)), each).reshape(-1, size), axis=1)[:, :-1]
                for v in (zeros, ones, raw)]
        whole = a + b
        left = sums[0] + sums[1]
        fits = (sums[2] >= least - 0.5) & (nodes.raw[node] - sums[2] >= least - 0.5)
        with np.errstate(divide="ignore", invalid="ignore"):
            kept = (sums[0] ** 2 + sums[1] ** 2) / left + ((a - sums[0]) ** 2 + (b - sums[1]) ** 2) / (whole - left)
        kept = np.where(fits, kept, -1.0).ravel()
        if not len(kept):
            continue
        found = int(kept.argmax())
        over = kept[found] - (a * a + b * b) / whole
        gain = over / whole
        if over <= NOISE * whole or gain < least_gain:
            continue
        at, cut = divmod(found, size - 1)
        feature = int(asked[at])
        goes = by_row[inside, feature] <= cut
        parts = inside[goes], inside[~goes]
        children = add(parts[0]), add(parts[1])
        nodes.part(node, float(gain), feature, cut, children)
        waiting += [(child, own, level + 1) for child, own in zip(children, parts, strict=True)]
    nodes.prune()
    return nodes


# --- estimators ---

def _saved(estimator, kind: type, tree_kind: str, nodes: DataFrame, weights: list[float], extra: dict) -> object:
    """The model whose nodes these are, written in MLlib's form and loaded by MLlib."""
    spark = nodes.sparkSession
    path = scratch_path(spark, "fitted")
    inner = F.col("feature") >= 0
    nodes.select(F.col("treeID"), F.struct(
        "id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild",
        F.struct(F.col("feature").alias("featureIndex"),
                 F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                 F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData")).write.parquet(f"{path}/data")
    own = {p.name: v for p, v in estimator._paramMap.items()}
    default = {p.name: v for p, v in estimator._defaultParamMap.items()}
    base = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    of_tree = {"maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "seed", "cacheNodeIds", "checkpointInterval", "maxMemoryInMB"}
    shared = {k: v for k, v in own.items() if k in of_tree}
    trees = [(i, json.dumps(base | {"class": f"org.apache.spark.ml.{tree_kind}", "uid": f"{estimator.uid}_tree_{i}",
                                    "paramMap": shared, "defaultParamMap": {}}), w) for i, w in enumerate(weights)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    whole = base | {"class": f"org.apache.spark.ml.classification.{kind.__name__}", "uid": estimator.uid,
                    "paramMap": own, "defaultParamMap": default, "numTrees": len(weights)} | extra
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return kind.load(path)


def _merged(estimator, dataset: DataFrame) -> tuple[DataFrame, list[int], list[np.ndarray], int] | None:
    """Merged rows, cut features, thresholds and number of features; None if MLlib has to fit them."""
    rows = dataset.select(
        vector_to_array(estimator.getFeaturesCol()).alias("features"), F.col(estimator.getLabelCol()).cast("double").alias("label"),
        F.col(estimator.getWeightCol()).cast("double").alias("weight") if estimator.isSet("weightCol") else F.lit(1.0).alias("weight"))
    first = rows.select(F.size("features").alias("n")).first()
    if first is None or estimator.getMaxBins() > 256 or rows.where(~F.col("label").isin(0.0, 1.0) | ~(F.col("weight") > 0)).limit(1).count():
        return None
    edges = bin_edges(rows, first["n"], estimator.getMaxBins())
    cut = [at for at, own in enumerate(edges) if len(own)]
    merged = materialize(merge_rows(rows, edges), "merged")
    if merged.count() * (len(cut) + 8) > TASK_BINS:
        return None
    return merged, cut, edges, first["n"]


class MergedGBTClassifier(GBTClassifier):
    """Gradient-boosted trees on merged rows."""

    def _fit(self, dataset: DataFrame):
        found = None if self.isSet("validationIndicatorCol") or self.getMaxDepth() > DEEPEST or self.getMinInstancesPerNode() > 1 \
            or self.getMinWeightFractionPerNode() else _merged(self, dataset)
        if found is None:
            return super()._fit(dataset)
        merged, cut, edges, n = found
        looked, depth, rate = subset_size(self.getFeatureSubsetStrategy(), n, "all"), self.getMaxDepth(), self.getSubsamplingRate()
        n_trees, step, gain, seed = self.getMaxIter(), self.getStepSize(), self.getMinInfoGain(), self.getSeed() & (1 << 63) - 1

        def boosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [packed(b) for b in batches if b.num_rows]
            if parts:
                booster = Booster(Rows.of(parts, len(cut)), n, looked, depth, rate, gain, seed)
                for tree, nodes in enumerate(booster.grow(n_trees, step)):
                    yield pa.RecordBatch.from_pandas(nodes.table(tree, cut, edges), SCHEMA, preserve_index=False)

        nodes = merged.select("bins", "label", "weight", "n").repartition(1).mapInArrow(boosted, NODES)
        return _saved(self, GBTClassificationModel, "regression.DecisionTreeRegressionModel", nodes,
                      [1.0] + [step] * (n_trees - 1), {"numFeatures": n})


class MergedForestClassifier(RandomForestClassifier):
    """A random forest on merged rows; each task grows some of its trees on all of them."""

    def _fit(self, dataset: DataFrame):
        found = None if self.getImpurity() != "gini" or self.getMinWeightFractionPerNode() else _merged(self, dataset)
        if found is None:
            return super()._fit(dataset)
        merged, cut, edges, n = found
        n_trees, spark = self.getNumTrees(), merged.sparkSession
        looked = subset_size(self.getFeatureSubsetStrategy(), n, "sqrt" if n_trees > 1 else "all")
        depth, least, gain = self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMinInfoGain()
        rate, bootstrap, seed = self.getSubsamplingRate(), self.getBootstrap(), self.getSeed() & (1 << 63) - 1

        def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_pydict({c: [zlib.compress(p, 1)] for c, p in zip("abcd", packed(batch), strict=True)})

        parts = [tuple(map(zlib.decompress, r)) for r in merged.select("bins", "label", "weight", "n").mapInArrow(
            packs, "a binary, b binary, c binary, d binary").collect()]  # bounded by TASK_BINS
        rows = Rows.of(parts, len(cut))
        del parts
        shared = spark.sparkContext.broadcast((rows.bins, rows.label, rows.weight, rows.n))

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Rows(*shared.value)
            by_row = np.ascontiguousarray(own.bins.T)
            for batch in batches:
                for tree in batch.column(0).to_pylist():
                    nodes = forest_tree(own, by_row, n, looked, depth, least, gain, rate, bootstrap, [seed, tree])
                    yield pa.RecordBatch.from_pandas(nodes.table(tree, cut, edges), SCHEMA, preserve_index=False)

        tasks = min(n_trees, spark.sparkContext.defaultParallelism)
        nodes = materialize(spark.range(0, n_trees, 1, tasks).mapInArrow(grown, NODES), "forest")
        shared.destroy()
        return _saved(self, RandomForestClassificationModel, "classification.DecisionTreeClassificationModel", nodes,
                      [1.0] * n_trees, {"numFeatures": n, "numClasses": 2})


SCHEMA = pa.schema([
    ("treeID", pa.int32()), ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()),
    ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()),
    ("rightChild", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64())])

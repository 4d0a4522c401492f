"""Operators that must not gather a group in one task: quantiles of close values, closures with long chains."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.functions import quantiles as Q
from riskpanel.operators import identity as Y


@pytest.mark.parametrize("limit", [1, 4, 100_000])
def test_quantiles_of_close_far_and_odd_values(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "ORDERED_VALUES", limit)
    rng = random.Random(4)
    groups = {
        "close": [1.7e9 + i * 1e-3 for i in range(300)], "wide": [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(200)],
        "same": [7.25] * 50, "few": [3.0, -1.0], "signs": [-0.5, 0.0, 0.5, -0.5], "clustered": [1 + 2.0**-k for k in range(50)],
        None: [5.0, 6.0, 8.0], "ends": [-1.7e308, 1.7e308, 0.0, 1.0],
    }
    rows = [(g, v) for g, own in groups.items() for v in own] + [("few", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(5)
    got = {r.g: r for r in Q.exact_quantiles(df, ["g"], F.col("v"), {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        ordered = sorted(own)
        assert got[g].n_values == len(own)
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)):
            at = (len(own) - 1) * p
            low, high = ordered[int(at)], ordered[min(int(at) + 1, len(own) - 1)]
            assert got[g][name] == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)
    whole = Q.upper_median(df.where("g <> 'wide'"), [], F.col("v"), "m").first()
    values = sorted(v for g, own in groups.items() if g not in ("wide", None) for v in own)
    assert whole.m == values[len(values) // 2] and whole.n_values == len(values)


def test_a_million_close_values_are_spread(spark, monkeypatch):
    """Values within 0.01 % of each other: no cell that is put in order holds more than the limit."""
    monkeypatch.setattr(Q, "ORDERED_VALUES", 20_000)
    seen, real = [], Q._pick

    def watched(rows, cell, *more):
        if cell:
            seen.append(rows.groupBy(*cell).count().agg(F.max("count")).first()[0])
        return real(rows, cell, *more)

    monkeypatch.setattr(Q, "_pick", watched)
    df = spark.range(1_000_000).select((F.lit(1_700_000_000.0) + F.col("id") * 0.1).alias("v"))
    row = Q.exact_quantiles(df, [], F.col("v"), {"p50": 0.5}).first()
    assert row.p50 == pytest.approx(np.quantile(1_700_000_000.0 + np.arange(1_000_000) * 0.1, 0.5), rel=1e-15)
    assert seen and max(seen) <= 20_000


def plain_ends(edges):
    out = {}
    for node in edges:
        path, at = [], node
        while at in edges and at not in path:
            path.append(at)
            at = edges[at]
        if at in path:  # a cycle: its first member on the path, a member itself
            cycle = path[path.index(at) :]
            at = node if node in cycle else next(p for p in path if p in cycle)
        out[node] = at
    return out


@pytest.mark.parametrize("hops", [1, 3])
def test_closure_of_chains_trees_and_cycles(spark, monkeypatch, hops):
    monkeypatch.setattr(Y, "HOPS_PER_ROUND", hops)
    rng = random.Random(6)
    edges = {f"c{i}": f"c{i + 1}" for i in range(70)}
    edges |= {f"t{i}": f"t{rng.randrange(i)}" for i in range(1, 60)}
    edges |= {"x1": "x2", "x2": "x3", "x3": "x1", "p9": "x2"} | {f"p{i}": f"p{i + 1}" for i in range(9)}
    edges |= {"y1": "y2", "y2": "y1", "hub": "t0"} | {f"h{i}": "hub" for i in range(30)}
    df = spark.createDataFrame([*edges.items(), ("self", "self")], "alias STRING, canonical STRING")
    got = {r.alias: r.canonical for r in Y.resolve_aliases(df).collect()}
    assert got == plain_ends(edges)
    assert Y.resolve_aliases(df.limit(0)).count() == 0


def test_frontier_shrinks(spark, monkeypatch):
    written, real = [], Y.materialize

    def watched(df, name):
        out = real(df, name)
        if name == "alias-round":
            written.append(out.count())
        return out

    monkeypatch.setattr(Y, "materialize", watched)
    edges = {f"c{i:03d}": f"c{i + 1:03d}" for i in range(200)} | {f"s{i}": f"c{150 + i}" for i in range(40)}
    Y.resolve_aliases(spark.createDataFrame(list(edges.items()), "alias STRING, canonical STRING"))
    assert written == sorted(written, reverse=True) and written[-1] < written[0] / 2

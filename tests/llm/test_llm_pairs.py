"""Near duplicates, leaks and search against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
from odd_tables import frame, words

from riskpanel.llm import decontaminate, near_dedup, topk


def brute_components(rows):
    sets = {}
    for i, text, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(near_dedup.shingle_set(text))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 75 * len(x | y) > 0 for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def edited(base, rng, n):
    out = list(base)
    for at in rng.sample(range(len(out)), n):
        out[at] = rng.choice(words(rng.random(), 3))
    return " ".join(out)


def test_components_equal_brute_force(spark):
    """Groups of copies with many edits: some meet only through the text they come from."""
    rng = random.Random(5)
    rows = []
    for g in range(3):
        base = words(1000 + g, 120)
        rows += [(500 * g + i, edited(base, rng, rng.choice([0, 0, 1, 2, 3, 4, 5, 8])), None, None) for i in range(60)]
    rows += [(5000 + i, " ".join(words(2000 + i, 30)), None, None) for i in range(40)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_odd_documents(spark, odd_docs, odd_rows):
    got = near_dedup.near_duplicates(odd_docs).collect()
    expected = brute_components(odd_rows)
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = {(i, len(near_dedup.shingle_set(t))) for i, t, *_ in odd_rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes
    assert near_dedup.near_duplicates(odd_docs.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark, odd_docs, odd_rows):
    kept = near_dedup.deduplicate(odd_docs)
    expected = brute_components(odd_rows)
    heads = {i for i, c in expected.items() if i == c}
    rows = kept.collect()
    assert kept.columns == odd_docs.columns and {r.doc_id for r in rows if r.doc_id is not None} == heads
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 12 for r in rows) == 2


def test_alternating_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {i: find(i) for i in root}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 50, 3000):
        a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        b[: n // 2] = a[: n // 2]
        apart = sum(int(x).bit_count() for x in (near_dedup.bitmap(a) ^ near_dedup.bitmap(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


ITEM = "The train from Oldtown leaves at 7 with 120 people, and after 15 minutes, Marta counts 30 bags in the last blue wagon."


def leaks(spark, texts, items):
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect())


def test_leaks_and_changed_parameters(spark):
    lead = " ".join(words(1, 50)) + ". "
    changed = ITEM.replace("Oldtown", "Newport").replace(" 7 ", " 9 ").replace("120", "80").replace("15 minutes", "3 hours").replace("Marta", "Peter")
    inside = [lead + ITEM, lead + changed, ITEM.replace(" ", "%% ")]
    clean = [lead, "", None, "The train from Oldtown leaves at 7.", lead * 40]
    got = leaks(spark, inside + clean, [(7, ITEM), (8, None), (9, ""), (None, ITEM), (10, "two words")])
    assert got == [(0, 7), (1, 7), (2, 7)]
    assert leaks(spark, [lead + "x two words y"], [(10, "Two words")]) == [(0, 10)]


def test_inconsistent_slots_are_no_leak(spark):
    item = "so it goes that Anna met Boris and Anna saw Boris and then Anna told Boris what Anna and Boris had done"
    same = item.replace("Anna", "Clara").replace("Boris", "David")
    names = iter("Aaron Betty Carla Denis Edgar Fiona Georg Hilda Inger Jonas".split())
    mixed = " ".join(next(names) if w in ("Anna", "Boris") else w for w in item.split())
    assert leaks(spark, [same, mixed], [(1, item)]) == [(0, 1)]


def test_quotations_without_the_slots_of_an_item(spark):
    """The part of an item that has no slots, and a passage with the item's own values beside others."""
    tail = " ".join(words(6, 30))
    item = "so it goes that Anna met Boris and Anna saw Boris and then Anna told Boris what Anna and Boris had done, " + tail
    names = iter("Aaron Betty Carla Denis Edgar Fiona Georg Hilda Inger Jonas".split())
    mixed = " ".join(next(names) if w in ("Anna", "Boris") else w for w in item.split()[:20])
    lead, few = "a text that quotes ", " ".join(tail.split()[:12])
    inside = [lead + tail, mixed + " " + tail, mixed.replace("Aaron met Betty and Carla saw Denis", "Anna met Boris and Anna saw Boris")]
    assert leaks(spark, [*inside, lead + few, mixed + " but " + few], [(1, item)]) == [(0, 1), (1, 1), (2, 1)]
    item = "It was 7 kg, " + tail
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate([lead + tail, lead])])
    kept = decontaminate.without_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [1]


def test_leaks_leave_and_the_rest_stays(spark, odd_docs, odd_rows):
    text = next(t for i, t, *_ in odd_rows if i == 4)
    benchmark = spark.createDataFrame([(1, " ".join(text.split()[20:50]))], "item_id long, text string")
    kept = decontaminate.without_leaks(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns
    expected = sorted(str(i) for i, t, *_ in odd_rows if text.lower() not in (t or "").lower())
    assert sorted(str(r.doc_id) for r in kept.collect()) == expected
    assert decontaminate.find_leaks(odd_docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(odd_docs, benchmark.limit(0)).count() == 0


def brute_top(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: v for i, v in sorted(good, reverse=True) if i % 50 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def top(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank", "3 as v")
    return {tuple(r) for r in topk.top_k(vectors).collect()}


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(600)]
    rows += [(i, rows[100][1]) for i in range(600, 800)]  # a very common vector
    rows += [(i, [1.0, 2.0]) for i in range(800, 804)] + [(900, None), (950, []), (1000, [1.0, None]), (1050, [float("nan")] * 6), (1100, [float("inf")] * 6), (None, rows[0][1])]
    assert top(spark, rows) == brute_top(rows)
    assert top(spark, [(50, [1.0])]) == set() and top(spark, []) == set()


def test_tree_bounds_hold():
    rng = np.random.default_rng(4)
    tree = topk.Tree(np.arange(500), rng.integers(-100, 100, (500, 5)))
    queries = rng.integers(-100, 100, (20, 5))
    bounds = tree.bounds(queries)
    for leaf, (a, b) in enumerate(zip(tree.edges[:-1], tree.edges[1:])):
        assert ((queries @ tree.points[a:b].T).max(axis=1) <= bounds[:, leaf]).all()


def test_top_k_of_components_of_any_size(spark, monkeypatch):
    """Integer inner products of Python, for components up to the ends of doubles, with ties and several shards."""
    import math
    import random
    from fractions import Fraction

    monkeypatch.setattr(topk, "SHARD_ROWS", 7)
    monkeypatch.setattr(topk, "LEAF_ROWS", 3)
    rng = random.Random(8)
    rows = [(50, [1.0, 1.0]), (1, [2e6, 1.0]), (2, [1.0, 1.0]), (3, [2.0**40, -(2.0**40)]), (4, [2.0**40, -(2.0**40) + 1]),
            (100, [2.0**41, 3.0]), (5, [1.7e308, 1e300]), (6, [1.7e308, 2e300]), (150, [-1.5e308, 4.0]), (7, [1e-300, -1e-300])]
    rows += [(8 + i, [rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 30), rng.uniform(-1, 1)]) for i in range(25)]
    rows += [(60, [float("nan"), 1.0]), (61, [float("inf"), 1.0]), (62, [None, 1.0]), (63, None)]
    ints = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    limit = (1 << 63) - 1
    expected = set()
    for q in (50, 100, 150):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        expected |= {(q, rank, i, max(-limit - 1, min(limit, -s))) for rank, (s, i) in enumerate(scores, 1)}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {tuple(r) for r in got} == expected

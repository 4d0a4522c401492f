"""Phrases, resampling and SimHash against brute force, and their odd inputs."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from odd_tables import frame, words
from oracle import compare, connect

from riskpanel.llm import collocations, queries, resampling, simhash

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_collocations", "op12_resampling"])
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, SF_DIR, queries.QUERIES, queries.ORACLES) is None


# --- phrases ---


def plain_phrases(rows, first, least):
    """All phrases of up to four words, all cuts and all longer candidates of each language."""
    f, n = {}, Counter()
    for _, text, lang, _ in rows:
        own = f.setdefault(lang or "und", Counter())
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {
            p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
            if 100 * a >= 80 * own[p[i : i + k]]
        }
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def spoken(seed, n, kinds):
    rng = random.Random(seed)
    own = words(seed, kinds)
    fixed = [rng.sample(own, rng.randint(2, 5)) for _ in range(12)]
    text = []
    while len(text) < n:
        text += rng.choice(fixed) if rng.random() < 0.4 else [rng.choice(own)]
        text[-1] += rng.choice(["", "", "", ",", ".", "\n", "\t"])
    return " ".join(text)


@pytest.mark.parametrize("first", [3, 8, 40, 2000])
def test_phrases_equal_brute_force(spark, first):
    """Small numbers of phrases wanted leave branches ungrown and need several rounds."""
    rows = [(i, spoken(i % 7, 400, 25), ("en", "fr", None)[i % 3], "a") for i in range(30)]
    got = sorted(tuple(r) for r in collocations.mine(frame(spark, rows), first=first, least=4).collect())
    assert got == plain_phrases(rows, first, 4) and len({r[0] for r in got}) == 3


def test_growing_is_pruned_and_goes_on(spark, monkeypatch):
    """A frontier smaller than the whole settles a language whose best phrases survive; the rest needs more rounds."""
    grown, real = [], collocations.phrase_counts

    def watched(docs, length, *more):
        grown.append(length)
        return real(docs, length, *more)

    monkeypatch.setattr(collocations, "phrase_counts", watched)
    rows = [(i, " ".join(["one two three four"] * 40 + [f"w{j % 9} v{j % 7}" for j in range(200)]), "en", "a") for i in range(4)]
    got = sorted(tuple(r) for r in collocations.mine(frame(spark, rows), first=2, least=4).collect())
    assert got == plain_phrases(rows, 2, 4)
    assert grown[:3] == [2, 3, 4]


def test_chunks_do_not_change_phrases(spark, monkeypatch, odd_docs, odd_rows):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 50)
    monkeypatch.setattr(collocations, "CHUNK_KINDS", 40)
    rows = [r for r in odd_rows if len(r[1] or "") < 5000]
    got = sorted(tuple(r) for r in collocations.mine(frame(spark, rows), first=50, least=2).collect())
    assert got == plain_phrases(rows, 50, 2) and got
    assert collocations.mine(odd_docs).collect() is not None
    assert collocations.mine(odd_docs.limit(0)).count() == 0


def test_distinct_rows_of_large_numbers():
    rng = np.random.default_rng(1)
    slots = [rng.integers(0, 4, 500) * 300_000 for _ in range(4)]
    got, n = collocations.distinct(slots, 1_000_001)
    assert Counter(zip(*(s.tolist() for s in slots))) == dict(zip(zip(*(s.tolist() for s in got)), n.tolist()))


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    row = spark.createDataFrame([(big, big)], "a long, b long").select(
        collocations.share(resampling.F.col("a"), resampling.F.col("b") + resampling.F.lit(0)).alias("s")).first()
    assert row.s == 2_000_000


# --- resampling ---


def plain_resampling(rows, goals):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [zlib.crc32(w.encode()) % 10_000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]

    s, t = Counter(), Counter()
    for _, text, _, _ in rows:
        s.update(features(text))
    for text in goals:
        t.update(features(text))
    n_s, n_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for i, text, _, _ in rows:
        own = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in own)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((-r[3], r[0] is None, r[0] or 0, r) for r in out if r[1] >= 20)
    drawn = [r for *_, r in enough[: 10 * len(enough) // 100]]
    ranks = {}
    for at, r in enumerate(drawn, 1):
        ranks.setdefault(r, []).append(at)
    return [(*r, ranks[r].pop(0) if ranks.get(r) else None) for r in out]


def same(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_resampling_equals_brute_force(spark, odd_docs, odd_rows):
    rows = odd_rows + [(100 + i, " ".join(words(i % 20, 15 + i % 30)), "en", "a") for i in range(150)]
    goals = [" ".join(words(3, 60)), None, "", " ".join(words(7, 90))]
    target = spark.createDataFrame([(g,) for g in goals], "text string")
    expected = plain_resampling(rows, goals)
    got = [tuple(r) for r in resampling.resample(frame(spark, rows), target).collect()]
    same(got, expected)
    same([r[:4] for r in map(tuple, resampling.resample(odd_docs, target.limit(0)).collect())],
         [r[:4] for r in plain_resampling(odd_rows, [])])
    assert resampling.resample(odd_docs.limit(0), target).count() == 0


@pytest.mark.parametrize("block", [3, 1 << 14])
def test_radix_order_of_wide_and_equal_keys(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rng = random.Random(4)
    far = (1 << 63) - 1
    ids = [far, -far - 1, 0, -1, 1, None, *(rng.randint(-far, far) for _ in range(40))]
    rows = [(i, rng.choice([-5, 0, 7, 1 << 40])) for i in ids]
    got = resampling.radix_order(spark.createDataFrame(rows, "doc_id long, score long").repartition(3)).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r.place)] == order
    assert sorted(r.place for r in got) == list(range(len(rows)))
    alike = spark.createDataFrame([(5, 5)] * 9, "doc_id long, score long")
    assert sorted(r.place for r in resampling.radix_order(alike).collect()) == list(range(9))


# --- SimHash ---


def plain_fingerprint(text):
    w = [x for x in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    own = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """Component by row of ``(id, fingerprint)``: ids and fingerprints are united until nothing changes."""
    ids = sorted({i for i, _ in pairs if i is not None})
    own = {i: {f for j, f in pairs if j == i} for i in ids}
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(ids, 2):
            if root[i] != root[j] and any((f ^ g).bit_count() <= 4 for f in own[i] for g in own[j]):
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    return root


def near_texts(seed, copies):
    """A text and copies that differ in a few words, so that fingerprints differ in a few bits."""
    rng = random.Random(seed)
    own = words(seed, 120)
    out = []
    for _ in range(copies):
        text = list(own)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = "changed"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("bucket", [1, 3, simhash.BUCKET])
def test_simhash_equals_brute_force(spark, odd_rows, bucket):
    rows = odd_rows + [(50 + n, t, "en", "a") for n, t in enumerate(near_texts(5, 25) + near_texts(6, 15))]
    rows += [(2, "again another text of this id", "en", "a"), (51, near_texts(6, 1)[0], "en", "b")]
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    root = plain_components(prints)
    got = [tuple(r) for r in simhash.near_duplicates(frame(spark, rows), bucket).collect()]
    same(got, [(i, f"{f:016x}", root.get(i)) for i, f in prints])
    assert len(set(root.values())) < len(root) - 20


def test_simhash_of_empty_tables_and_texts(spark, odd_docs):
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    blank = frame(spark, [(3, None, "en", "a"), (9, "", "en", "a"), (4, " \t", "en", "a")])
    assert {tuple(r) for r in simhash.near_duplicates(blank).collect()} == {(i, "0" * 16, 3) for i in (3, 9, 4)}


def test_every_pair_within_the_radius_meets():
    """For each set of at most four bits some mask of each covering keeps none of them."""
    for masks in simhash.COVERINGS:
        free = [~np.uint64(m) for m in masks]
        kept = np.zeros((64, 64, 64, 64), bool)
        for m in free:
            bits = (np.uint64(m) >> np.arange(64, dtype=np.uint64)) & np.uint64(1) == 1
            where = np.flatnonzero(bits)
            kept[np.ix_(where, where, where, where)] = True
        assert kept.all()
    covered = np.array([0], np.uint64)
    for masks in simhash.COVERINGS:
        covered = np.unique((covered[:, None] | np.array(masks, np.uint64)[None, :]).ravel())
    assert np.bitwise_count(~covered).max() == simhash.OPEN_BITS
    assert 1 << simhash.OPEN_BITS <= simhash.BUCKET


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(2)
    centre = rng.integers(-(1 << 62), 1 << 62)
    nodes = np.unique(np.array([centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 60, (300, 3))]))
    keys = np.sort(rng.integers(0, 5, len(nodes)))
    a, b = simhash.forest(keys, nodes)
    assert len(a) <= len(nodes) - len(np.unique(keys))
    for key in np.unique(keys):
        own = nodes[keys == key].tolist()
        root = {x: x for x in own}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        linked = {frozenset((x, y)) for x, y in itertools.combinations(own, 2) if ((x ^ y) & (2**64 - 1)).bit_count() <= 4}
        for x, y in (p for p in zip(a.tolist(), b.tolist()) if p[0] in root):
            assert frozenset((x, y)) in linked
            root[find(x)] = find(y)
        assert all(find(x) == find(y) for x, y in map(tuple, linked))

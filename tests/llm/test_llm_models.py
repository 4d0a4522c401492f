"""Languages, mixing, scores, quality and the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from odd_tables import frame, words
from oracle import compare, connect

import corpus_pipeline
from riskpanel.llm import decontaminate, language_id, lm_score, mixing, near_dedup, quality, queries, secret_scan

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, SF_DIR, queries.QUERIES, queries.ORACLES) is None


# --- languages ---


def test_evidence_is_fused(spark):
    rng = random.Random(1)
    texts = {"aa": ["tala ", "mora ", "sila "], "bb": ["zwick ", "hroft ", "gnulp "]}
    say = lambda lang, n: "".join(rng.choice(texts[lang]) for _ in range(n))
    docs = frame(spark, [(i, say(lang, 50), lang, "s") for i, lang in enumerate(["aa", "bb"] * 10)] + [(99, None, "aa", "s"), (98, "x", None, "s")])
    page = lambda lang, text: f"<html lang='{lang}'><body><article><p>{text}</p></article>"
    rows = [(i, f"https://www.h{i % 3}.{lang}/p", page(lang, say(lang, 20))) for i, lang in enumerate(["aa", "bb"] * 12)]
    rows += [(100, "https://www.h0.aa/x", page("bb", say("aa", 30))), (101, "https://www.h0.aa/y", "<html>"), (102, None, None), (103, "odd", ""), (102, None, None)]
    pages = spark.createDataFrame([(*r, "l", 0.1) for r in rows], "page_id long, url string, html string, lang string, probability double")
    got = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    assert language_id.identify(pages, docs).count() == len(rows)
    assert all(got[i].lang == ("aa", "bb")[i % 2] for i in range(24))
    assert got[100].lang == "aa" and got[100].declared == "bb" and got[101].lang == "aa"
    assert got[102].host is None and 0 < got[102].probability <= 1
    assert language_id.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in language_id.identify(pages, docs.limit(0)).collect()} == {None}


# --- mixing ---


def mix_by_hand(spark, rows):
    con = duckdb.connect()
    frame(spark, rows).select("doc_id", "text", "source").toPandas().to_parquet(path := f"/tmp/mix-{random.random()}.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return sorted(con.execute(f"SELECT doc_id, source, size, source_size, target, taken FROM ({mixing.SQL})").fetchall(), key=repr)


def test_mix_equals_sql_on_odd_documents(spark, odd_docs, odd_rows):
    got = sorted((tuple(r) for r in mixing.mix_sources(odd_docs).collect()), key=repr)
    assert got == mix_by_hand(spark, odd_rows)
    assert mixing.mix_sources(odd_docs.limit(0)).count() == 0
    sizes = {r[1]: (r[3], r[4]) for r in got}
    taken = Counter()
    for r in got:
        taken[r[1]] += r[5]
        assert 0 <= r[5] <= 2 * r[2]
    assert all(taken[s] == round(t) for s, (_, t) in sizes.items())
    assert sum(t for _, t in sizes.values()) == pytest.approx(1.5 * sum(s for s, _ in sizes.values()))


def test_capped_shares_end_reshared():
    sizes, weights, whole = [10, 100, 1000, 0, 50], [5, 2, 1, 5, 2], 1500.0
    shares, left = [0.0] * 5, whole
    open_ = set(range(5))
    while left > 1e-9 and open_:
        part = left / sum(weights[i] for i in open_)
        left = 0.0
        for i in sorted(open_):
            shares[i] += weights[i] * part
            if shares[i] > 2 * sizes[i]:
                left += shares[i] - 2 * sizes[i]
                shares[i] = 2.0 * sizes[i]
                open_.discard(i)
    assert mixing.capped_shares(sizes, weights, whole, 2) == pytest.approx(shares)


def test_flow_repeats_as_little_as_it_can():
    """The shared pattern serves the source that would have to repeat its own documents."""
    flows = mixing.route([(("a",), 10), (("a", "b"), 10), (("b",), 30)], {"a": 20, "b": 30}, 2)
    assert flows == [{"a": 10}, {"a": 10, "b": 0}, {"b": 30}]
    flows = mixing.route([(("a",), 10)], {"a": 50}, 2)
    assert flows == [{"a": 20}]


def test_overlapping_sources(spark):
    rows = [(i, " ".join(words(i, 10)), ["a"] if i < 30 else ["b", "a"] if i < 50 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix_sources(docs, share=1.0).collect()
    assert len(got) == 60 and all(r.taken <= 2 * r.size for r in got) and sum(r.taken for r in got) > 0


# --- language model ---


def scored(spark, rows):
    return lm_score.language_model_scores(frame(spark, rows)).collect()


def test_base_counts_equal_brute_force(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(lm_score, "TOP", 20)
    rows = odd_rows + [(i, " ".join(random.Random(i).choices(words(7, 50), k=30)), "en", "a") for i in range(100, 160)]
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (-1 if i is None else i, held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n,
         round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t, *_ in rows
    )
    got = scored(spark, rows)
    assert expected == sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    assert all(r.score < 0 for r in got) and scored(spark, []) == []


def test_model_beats_counts_on_held_out_texts(spark):
    """Half of the texts end their words in a sign; the word before tells which half it is."""
    own = words(11, 400)
    mark = lambda i: "!!" if i % 2 else ""
    rows = [(i, " ".join(w + mark(i) for w in random.Random(i).choices(own, k=60)), "en", "a") for i in range(700)]
    held = [r for r in scored(spark, rows) if r.held_out]
    assert len(held) > 50 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up():
    """Over all next bytes the model's probabilities sum to one in each context."""
    seen = lm_score.Counts()
    batch = lm_score.Batch(["the cat and the hat", "a hat on the mat"])
    own = [batch.words[i] for i in batch.pair_word]
    seen.add(own, batch.pair_state, np.bincount(batch.pair), np.ones(len(own), bool))
    model = lm_score.Model([lm_score.log_odds(x[::2], x[1::2]) for x in seen.seen], [lm_score.trust(x[::2], x[1::2]) for x in seen.seen])
    slots, bits, word, where = lm_score.decisions([bytes([c]) for c in range(1, 256) if c != 32], np.zeros(254, np.int64))
    first = np.flatnonzero(np.diff(np.append(-1, word)))
    odds, gate = model.inputs(slots[:, first])
    p, _, _ = model.refine(model.mix(odds, gate), (where[first][:, None] * 8 + np.arange(8)).ravel())
    each = np.where(bits[first].ravel(), p, 1 - p).reshape(-1, 8).prod(axis=1)
    assert 0.9 < each.sum() < 1


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(i, " ".join(random.Random(i).choices(words(11, 90), k=40)), "en", "a") for i in range(120)]
    one = {r.doc_id: r.score for r in lm_score.language_model_scores(frame(spark, rows).coalesce(1)).collect()}
    two = {r.doc_id: r.score for r in lm_score.language_model_scores(frame(spark, rows).repartition(5)).collect()}
    assert one == pytest.approx(two, rel=1e-6)


# --- quality ---


def graded(n: int):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        own = words(3000 + i, 40)
        good = rng.random() < 0.7
        rows.append((i, " ".join(own) + "." if good else " ".join(w + "###" for w in own), "en", "a"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = graded(400)
    marks = spark.createDataFrame(labels + [(5, 0, 0), (5, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(frame(spark, rows), marks).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_quality_of_odd_documents(spark, odd_docs, odd_rows):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(odd_docs, marks).collect()
    assert len(got) == len(odd_rows) and {r.score for r in got} == {0.5}
    rows, labels = graded(60)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(frame(spark, rows).unionByName(odd_docs), marks).collect()
    assert len(got) == 60 + len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(odd_docs.limit(0), marks).count() == 0


def test_dual_coordinate_descent_finds_the_optimum():
    """The primal objective of the solution is that of plain subgradient steps or better."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(80)]
    labels = np.array([int(r[0] % 2) for r in rows])
    scale = np.ones(30)
    signs = np.where(labels > 0, 1, -1)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0, 1 - s * (w[r] @ quality.unit(scale[r]) + b)) for r, s in zip(rows, signs))

    w, b = quality.dual_coordinate_descent(rows, scale, labels, 1.0, 300, 1)
    best, v, c = math.inf, np.zeros(30), 0.0
    for t in range(1, 3000):
        gw, gc = v.copy(), c
        for r, s in zip(rows, signs):
            if s * (v[r] @ quality.unit(scale[r]) + c) < 1:
                gw[r] -= s * quality.unit(scale[r])
                gc -= s
        v, c = v - gw / (t + 10), c - gc / (t + 10)
        best = min(best, loss(v, c))
    assert loss(w, b) <= best * 1.01


# --- pipeline ---


def test_stages_equal_brute_force(spark):
    """Each stage on its own input: what it drops is what a plain check of its decision drops."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near duplicates", "benchmark decontamination", "secret scans", "mixing sources"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = stages["quality classifier"](spark, docs, SF_DIR).cache()
    left = {r.doc_id for r in good.collect()}
    wrong = [i for i, q in labels.items() if (i in left) != bool(q)]
    assert good.columns == docs.columns and len(wrong) <= 0.05 * len(labels)

    texts = {r.doc_id: r.text for r in good.collect()}
    root = {}
    sets = {i: near_dedup.shingle_set(t) for i, t in texts.items()}
    for i in sorted(sets):
        linked = [root[j] for j in root if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) > 0]
        root[i] = min([i, *linked])
        for j in root:
            if root[j] in linked:
                root[j] = root[i]
    unique = stages["near duplicates"](spark, good, SF_DIR).cache()
    assert {r.doc_id for r in unique.collect()} == {i for i, c in root.items() if i == c}

    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = stages["benchmark decontamination"](spark, unique, SF_DIR).cache()
    fold = lambda t: " ".join("".join(c for c in t.lower() if c.isalnum() or c.isspace()).split())
    leaks = {r.doc_id for r in unique.collect() if any(fold(x) in fold(r.text) for x in items)}
    assert {r.doc_id for r in unique.collect()} - {r.doc_id for r in clean.collect()} == leaks

    told = [(10**6 + i, f"words before {t} and after", "en", "src1") for i, t in enumerate(
        ("password=hunter2222", "AKIA" + "Q7" * 10, "0123456789abcdef" * 2 + "ff", "api_key: 'abcdef'"))]
    clean = clean.unionByName(frame(spark, told).select(*clean.columns)).cache()
    masked = stages["secret scans"](spark, clean, SF_DIR).cache()
    assert masked.columns == docs.columns and masked.count() == clean.count()
    before = {r.doc_id: r.text for r in clean.collect()}
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = re.compile(rf"(?:{word}|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    plain = lambda t: any(len(m[1]) >= 6 for m in assign.finditer(t)) or any(
        len(m) >= 20 for m in re.findall("AKIA[A-Z0-9]+", t)) or re.search("[0-9a-f]{24,}", t)
    changed = {r.doc_id for r in masked.collect() if r.text != before[r.doc_id]}
    assert changed >= {i for i, t in before.items() if plain(t)} and len(changed) >= len(told)
    for r in masked.collect():
        assert r.n_chars == len(r.text) and not plain(r.text)
        pieces = r.text.split("[SECRET]")
        at = 0
        for piece in pieces:  # what is left stands in the text as it was, in order
            assert piece in before[r.doc_id][at:]
            at = before[r.doc_id].index(piece, at) + len(piece)

    mixed = stages["mixing sources"](spark, masked, SF_DIR).collect()
    whole = {r.doc_id: r for r in masked.collect()}
    assert all(r.text == whole[r.doc_id].text and r.lang == whole[r.doc_id].lang and r.size == len(r.text.encode().split()) for r in mixed)
    sizes = {}
    for r in whole.values():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    targets, rest, weights = {}, 1.5 * sum(sizes.values()), dict(zip(sorted(sizes), [5, 2, 1] * len(sizes)))
    while True:  # shares by weight; a source that cannot hold its share gets twice its size, the others the excess
        rate = rest / sum(w for s, w in weights.items() if s not in targets)
        over = [s for s, w in weights.items() if s not in targets and w * rate > 2 * sizes[s]]
        if not over:
            break
        targets |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2.0 * sizes[s] for s in over)
        if len(targets) == len(sizes):
            break
    targets |= {s: weights[s] * rate for s in sizes if s not in targets}
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        assert 0 < r.taken <= 2 * r.size and r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_pipeline_of_odd_documents(spark, odd_docs):
    out = odd_docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, out, SF_DIR)
    assert out.columns == odd_docs.columns and out.count() == near_dedup.deduplicate(odd_docs).count()
    empty = odd_docs.limit(0)
    assert all(stage(spark, empty, SF_DIR).count() == 0 for _, stage in corpus_pipeline.STAGES)
    assert decontaminate.WINDOW == 8

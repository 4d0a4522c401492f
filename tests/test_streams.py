"""Streams: late rows, restarts, replayed batches, crashes and lost checkpoints."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskpanel.operators import activity as A
from riskpanel.streaming import events as E
from riskpanel.streaming import incremental as N
from riskpanel.streaming import landing as L
from riskpanel.streaming import upsert as U

EVENTS = (
    "entity STRING, event_yyyymm STRING, event_type STRING, event_ts TIMESTAMP, event_date DATE, actor_login STRING, "
    "action STRING, pr_merged BOOLEAN, ref_type STRING, text_blob STRING, sample_percent DOUBLE"
)


def event(rng, day):
    ts = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=rng.randint(0, 23))
    kind = rng.choice(["PushEvent", "PullRequestEvent", "IssuesEvent", "CreateEvent"])
    return (rng.choice("ab"), f"{ts:%Y-%m}", kind, ts, ts.date(), rng.choice(["u1", "u2", "dependabot", None]),
            rng.choice(["opened", "closed"]), rng.random() < 0.3, "tag", rng.choice(["fix CVE-1", "Bump x", "docs"]), float(day))


def arrive(spark, rows, source):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(source)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stream_equals_batch_inside_the_watermark(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rng = random.Random(1)

    def run():
        E.stream_activity(spark, source, EVENTS, target, progress, "2 days").awaitTermination()

    early, later = [event(rng, d % 20) for d in range(120)], [event(rng, 18 + d % 25) for d in range(120)]
    arrive(spark, early, source)
    run()
    arrive(spark, later, source)
    run()  # a restart from the checkpoint
    too_late, in_time = event(rng, 3), event(rng, 42)
    arrive(spark, [too_late, in_time], source)
    run()
    last = max(r[3] for r in [*early, *later, in_time]) - dt.timedelta(days=2)
    complete = [r for r in [*early, *later, in_time] if dt.datetime.combine(r[4], dt.time()) + dt.timedelta(days=1) <= last]
    assert 0 < len(complete) < 241
    expected = A.activity_counts(spark.createDataFrame(complete, EVENTS))
    got = E.landed_months(spark, target)
    assert rows_of(got.select(*expected.columns)) == rows_of(expected)


def test_stream_after_a_lost_checkpoint_counts_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(2)
    rows = [event(rng, d % 20) for d in range(60)]
    arrive(spark, rows, source)
    for progress in ("one", "two"):
        E.stream_activity(spark, source, EVENTS, target, str(tmp_path / progress), "0 days").awaitTermination()
        first = rows_of(E.landed_months(spark, target)) if progress == "one" else first
    assert rows_of(E.landed_months(spark, target)) == first
    assert L.committed(spark, target).select("landing_run").distinct().count() == 2


SCHEMA = "k STRING, v LONG, payload STRING"


def table(spark, target):
    return {r.k: (r.v, r.payload) for r in U.read_current(spark, target, SCHEMA).collect()}


def test_upsert_replayed_batch_changes_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], SCHEMA)
    assert U.upsert_batch(first, 0, 1, target, SCHEMA, ["k"], ["v"], 4)
    assert not U.upsert_batch(first, 0, 1, target, SCHEMA, ["k"], ["v"], 4)
    assert table(spark, target) == {"a": (2, "y"), "b": (1, "z")} and U.manifests(spark, target).count() == 1
    older = spark.createDataFrame([("a", 1, "old"), ("c", 5, "new")], SCHEMA)
    assert U.upsert_batch(older, 1, 1, target, SCHEMA, ["k"], ["v"], 4)
    assert table(spark, target) == {"a": (2, "y"), "b": (1, "z"), "c": (5, "new")}
    assert U.read_current(spark, target, SCHEMA, version=1).count() == 2


def test_upsert_crash_between_write_and_switch(spark, tmp_path):
    target = str(tmp_path / "t")
    U.upsert_batch(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], SCHEMA), 0, 1, target, SCHEMA, ["k"], ["v"], 4)
    torn = spark.createDataFrame([("zzz", 9, "torn")], SCHEMA).withColumn("bucket", F.lit(3))
    torn.write.partitionBy("bucket").parquet(f"{target}/data/version=2")  # written, never named by a manifest
    assert table(spark, target) == {"a": (1, "x"), "b": (1, "y")}
    U.upsert_batch(spark.createDataFrame([("b", 2, "new")], SCHEMA), 1, 1, target, SCHEMA, ["k"], ["v"], 4)
    assert table(spark, target) == {"a": (1, "x"), "b": (2, "new")}


def test_upsert_stream_with_a_lost_checkpoint(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "t")
    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 9)}", v, f"p{v}") for v in range(90)]
    rng.shuffle(rows)
    for at, progress in enumerate(["one", "one", "two"]):
        spark.createDataFrame(rows[30 * at : 30 * at + 30], SCHEMA).write.mode("append").json(source)
        U.upsert_stream(spark, source, SCHEMA, target, str(tmp_path / progress), ["k"], ["v"], buckets=4).awaitTermination()
    best = {}
    for k, v, p in rows:
        best[k] = max(best.get(k, (-1, "")), (v, p))
    assert table(spark, target) == best
    assert {r.landing_run for r in U.manifests(spark, target).collect()} == {1, 2}


def test_equal_orders_do_not_depend_on_arrival(spark, tmp_path):
    one, two = [("a", 1, "x")], [("a", 1, "y"), ("a", None, "z")]
    outcomes = []
    for name, batches in (("p", (one, two)), ("q", (two, one))):
        for n, rows in enumerate(batches):
            U.upsert_batch(spark.createDataFrame(rows, SCHEMA), n, 1, str(tmp_path / name), SCHEMA, ["k"], ["v"], 2)
        outcomes.append(table(spark, str(tmp_path / name)))
    assert outcomes[0] == outcomes[1] == {"a": (1, "y")}
    assert U.read_current(spark, str(tmp_path / "none"), SCHEMA).count() == 0


FILES = "id LONG, event_yyyymm STRING"


def land(spark, tmp_path, progress):
    N.land_new_files(spark, str(tmp_path / "in"), FILES, str(tmp_path / "out"), str(tmp_path / progress)).awaitTermination()
    return sorted(r.id for r in L.read_landed(spark, str(tmp_path / "out")).collect())


def test_landing_is_exactly_once_with_lost_checkpoints(spark, tmp_path):
    def put(*ids):
        spark.createDataFrame([(i, f"2024-0{i % 3 + 1}") for i in ids], FILES).write.mode("append").json(str(tmp_path / "in"))

    put(1, 2, 3)
    assert land(spark, tmp_path, "one") == [1, 2, 3]
    put(4, 5)
    assert land(spark, tmp_path, "two") == [1, 2, 3, 4, 5]  # the first files come again and are left out
    put(6)
    assert land(spark, tmp_path, "two") == [1, 2, 3, 4, 5, 6]
    assert land(spark, tmp_path, "two") == [1, 2, 3, 4, 5, 6]


def test_uncommitted_batches_are_invisible(spark, tmp_path):
    target = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id LONG, s STRING")
    with L.landing(spark, target, 1, 0) as folder:
        rows.write.parquet(folder)
    with pytest.raises(RuntimeError), L.landing(spark, target, 1, 1) as folder:
        rows.write.parquet(folder)
        raise RuntimeError("lost before the commit")
    assert L.read_landed(spark, target).count() == 2
    with L.landing(spark, target, 1, 0) as folder:
        assert folder is None

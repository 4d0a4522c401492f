"""One small case for each mended finding of the third round."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel import catalogue
from riskpanel.operators import activity as A

SF_DIR = "/root/testdata/sf0.001"
catalogue.load_all()


def test_events_are_counted_before_they_are_copied(spark, monkeypatch):
    """what is copied to a repository's entities is one row per repository, however many events it has."""
    copied, plain = [], A.fan_out
    monkeypatch.setattr(A, "fan_out", lambda events, repos: copied.append(events.count()) or plain(events, repos))
    assert catalogue.QUERIES["event_fan_out"](spark, SF_DIR).count() > 150
    assert copied and copied[0] <= 150


def test_months_of_several_repositories_add_up(spark):
    """an entity with two repositories, a repeated mapping, an unmapped repository, blank entities."""
    events = spark.createDataFrame(
        [("a", "2024-01", 5), ("a", "2024-01", 3), ("b", "2024-01", 4), ("b", None, 7), ("x", "2024-01", 1)],
        "repo STRING, month STRING, event_id LONG")
    repos = spark.createDataFrame([("e", "a"), ("e", "a"), ("e", "b"), ("f", "b"), (" ", "a"), (None, "b")], "entity STRING, repo_full_name STRING")
    got = {(r.entity, r.month): (r.n_events, r.first_event) for r in A.fan_out_months(events, repos).collect()}
    assert got == {("e", "2024-01"): (3, 3), ("e", None): (1, 7), ("f", "2024-01"): (1, 4), ("f", None): (1, 7)}


def test_permuted_values_are_never_broadcast(spark):
    """tables of arrays look small to the planner, whatever their length."""
    from riskpanel.operators import permutation as I

    rows = spark.range(200).select(F.col("id").alias("entity"), F.lit("m").alias("month"), F.rand(1).alias("a"), (F.col("id") % 3).alias("b"))
    both = I.permuted(rows, ["a", "b"], ["entity", "month"])
    assert "Broadcast" not in both.select("place", "own", "other")._jdf.queryExecution().sparkPlan().toString()
    for r in I.with_replaced(both, 2).collect():
        want = list(r.own)
        if r.feature != I.UNTOUCHED:
            want[r.feature] = r.other[r.feature]
        assert r.features == want


def test_snapshot_of_a_month_is_stored(spark):
    """comparisons read the month's rows, not the plan of the panel of all months."""
    from riskpanel.catalogue import ranking

    for table in ranking._snapshot(spark, SF_DIR):
        assert "Window" not in table._jdf.queryExecution().executedPlan().toString()


def test_documents_of_a_short_file_are_dealt_out_and_parsed_once(spark, tmp_path):
    """one small file is parsed by many tasks, with the same names as field by field."""
    from riskpanel.operators import identity as Y

    payloads = [
        '{"aliases": ["a", " b ", null, ""], "formerNames": "c", "plugin_api": {"aliases": "d", "legacy_names": ["e"]}}',
        '{"aliases": "[x", "previous_names": 7, "plugin_api": null}', '{"plugin_api": {"formerNames": ["f", "f"]}, "alias_ids": []}',
        '{"aliases": {"k": 1}, "plugin_api": "text"}', "not json", "", None, "[1]", '{"aliases": "caf\\u00e9 \\\\"q\\\\""}', '{"other": 1}',
    ]
    rows = [(f" e{i} ", p, i) for i, p in enumerate(payloads)] + [(f"n{i}", f'{{"aliases": "o{i}"}}', i) for i in range(100, 200)]
    spark.createDataFrame(rows, "entity STRING, payload STRING, seq LONG").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for source in ("registry", "snapshot"):
        names = Y.alias_values(F.col("payload"))
        if source == "snapshot":
            names = F.concat(names, Y.alias_values(F.col("payload"), "$.plugin_api"))
        plain = docs.select(F.trim("entity").alias("canonical"), F.lit(source).alias("source"), "seq", F.posexplode(names).alias("pos", "alias"))
        got = Y.alias_rows(docs, source)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
        assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_stacked_rows_hold_one_column_per_part(spark):
    """a stacked row is its keys and one struct per family, whatever the number of columns."""
    from riskpanel.operators.panel import dense_grid, panel_rows

    grid = dense_grid(spark.createDataFrame([(1,), (2,)], "entity LONG"), "2020-01", "2020-02")
    a = spark.createDataFrame([(1, 24240, 5, None), (1, 24239, 7, None)], "entity LONG, month_no INT, a INT, b INT")
    b = spark.createDataFrame([(1, 24240, None, 3.0), (3, 24241, 4, 1.0)], "entity LONG, month_no INT, c INT, d DOUBLE")
    rows = panel_rows(grid, [a, b])
    plan = rows._jdf.queryExecution().optimizedPlan()
    unions = [n for n in _nodes(plan) if n.nodeName() == "Union"]
    assert [u.output().size() for u in unions] == [5]
    found = {(r.entity, r.month_no): (r.in_grid, r.month, r.a, r.b, r.c, r.d) for r in rows.collect()}
    assert found == {
        (1, 24239): (False, None, 7, None, None, None), (1, 24240): (True, "2020-01", 5, None, None, 3.0),
        (1, 24241): (True, "2020-02", None, None, None, None), (2, 24240): (True, "2020-01", None, None, None, None),
        (2, 24241): (True, "2020-02", None, None, None, None), (3, 24241): (False, None, None, None, 4, 1.0)}


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_long_methods_are_split_while_wide_tables_are_written(spark):
    """the setting lasts for the write and no longer."""
    from riskpanel import session

    before = spark.conf.get(session.METHOD_LIMIT_CONF, None)
    with session.compiled_methods(spark):
        assert spark.conf.get(session.METHOD_LIMIT_CONF) == "8000"
    assert spark.conf.get(session.METHOD_LIMIT_CONF, None) == before


def test_rows_of_a_linear_fit_are_not_kept_twice(spark, monkeypatch):
    """The linear fit keeps blocks of its own, so its input is not cached as well."""
    from riskpanel.plans import training as M

    rows = [(i, "2020-01", "train" if i % 4 else "test", float(i % 3 == 0), float(i % 7)) for i in range(60)]
    prepared = spark.createDataFrame(rows, "entity LONG, month STRING, split STRING, label DOUBLE, x DOUBLE")
    kept, plain = {}, M.get_model

    def spied(name, **settings):
        estimator = plain(name, **settings)
        fit = estimator.fit
        estimator.fit = lambda rows: kept.update({name: rows.storageLevel.useMemory}) or fit(rows)
        return estimator

    monkeypatch.setattr(M, "get_model", spied)
    assert M.fit_and_score(prepared, ["x"], "logistic").predictions.count() == 15
    M.fit_and_score(prepared, ["x"], "xgboost", maxIter=1)
    assert kept == {"logistic": False, "xgboost": True}


def test_a_fit_fills_its_share_of_tasks(spark, monkeypatch):
    """A forest's work grows with its trees, fits share the tasks, large tasks send few counts."""
    from riskpanel.plans import training as M

    assert M.task_count(3_000_000, 12, 500) == 12  # was 2, so that most tasks idled
    assert M.task_count(9_500_000, 1) == 1 and M.task_count(9_500_000, 12) == 5
    assert M.task_count(690_000_000, 12) == 35  # was 345, each sending counts of all bins
    cores = spark.sparkContext.defaultParallelism
    assert M.fits_at_once(spark, 9_500_000, 16) == max(M.FITS_TOGETHER, min(16, cores))
    assert M.fits_at_once(spark, 10**9, 16) == M.FITS_TOGETHER

    rows = [(i, "2020-01", "train" if i % 4 else "test", float(i % 3 == 0), float(i % 7)) for i in range(60)]
    prepared = spark.createDataFrame(rows, "entity LONG, month STRING, split STRING, label DOUBLE, x DOUBLE")
    seen, plain = {}, M.get_model
    monkeypatch.setattr(M, "get_model", lambda name, **settings: seen.update(settings) or plain(name, **settings))
    trained = M.fit_and_score(prepared, ["x"], "random_forest", numTrees=7)
    assert seen["cacheNodeIds"] and trained.model.getNumTrees == 7 and trained.predictions.count() == 15
    monkeypatch.setattr(M, "NODE_IDS", 10)
    M.fit_and_score(prepared, ["x"], "random_forest", numTrees=7)
    assert not seen["cacheNodeIds"]


def test_tasks_of_exploded_records_do_not_grow(spark, monkeypatch):
    """twice the lines are sorted by twice the tasks, with the same rows."""
    from riskpanel.catalogue import incidents as Q

    def tasks(df):
        return int(df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")), df

    plain = sorted(map(str, catalogue.QUERIES["osv_explode"](spark, SF_DIR).collect()))
    monkeypatch.setattr(Q, "LINES_OF_TASK", 300)
    dealt, small = tasks(catalogue.QUERIES["osv_explode"](spark, SF_DIR))
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    parts = -(-lines // 300)
    assert dealt == 3 and parts > spark.sparkContext.defaultParallelism
    assert small.rdd.getNumPartitions() == parts
    assert sorted(map(str, small.collect())) == plain


def test_state_of_activity_is_kept_on_disk(spark, tmp_path):
    """open days are no objects on the heap; the session's own setting is as before."""
    from riskpanel.streaming import events as E

    before = spark.conf.get(E.STORE_CONF, None)
    rows = spark.createDataFrame(
        [("a", f"2024-01-{d:02}") for d in range(1, 29)], "entity STRING, day STRING").selectExpr(
        "entity", "'2024-01' AS event_yyyymm", "'PushEvent' AS event_type", "to_timestamp(day) AS event_ts", "to_date(day) AS event_date",
        "'u' AS actor_login", "'opened' AS action", "false AS pr_merged", "'tag' AS ref_type", "'x' AS text_blob", "1.0D AS sample_percent")
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows.write.parquet(source)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    query = E.stream_activity(spark, source, schema, target, progress, "1 days", "parquet")
    query.awaitTermination()
    assert any("rocksdb" in k for p in query.recentProgress for s in p["stateOperators"] for k in s["customMetrics"])
    assert spark.conf.get(E.STORE_CONF, None) == before
    assert E.landed_months(spark, target).first()["gharchive_events_total"] == 26

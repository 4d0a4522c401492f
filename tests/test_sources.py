"""Files, artifacts and incremental runs that need real paths."""

from __future__ import annotations

import json
import zipfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from riskpanel.plans import training as M
from riskpanel.sources import readers, schemas, writers
from riskpanel.streaming import incremental as N


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_zip_members_are_parsed_and_broken_ones_dropped(spark, tmp_path):
    record = {"id": "O-1", "published": "2024-01-02T00:00:00Z", "aliases": ["CVE-1"],
              "affected": [{"package": {"ecosystem": "PyPI", "name": "A.b"}}]}
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("a.json", json.dumps(record))
        z.writestr("b.json", "{broken")
        z.writestr("c.txt", "x")
    rows = readers.read_zipped_json(spark, str(tmp_path / "*.zip")).collect()
    assert [r["id"] for r in rows] == ["O-1"]
    assert rows[0]["affected"][0]["package"]["name"] == "A.b"


def test_documents_take_their_key_from_the_file_name(spark, tmp_path):
    write(tmp_path / "p1.snapshot.json", json.dumps({"current_version": "1"}, indent=2))
    write(tmp_path / "p1.index.json", "{}")
    docs = readers.read_documents(spark, str(tmp_path), "current_version STRING", ".snapshot.json")
    assert [(r["entity"], r["current_version"]) for r in docs.collect()] == [("p1", "1")]
    days = spark.range(1).select(
        readers.commit_window_days(F.lit("p1.commits_365d.json")).alias("d"),
        readers.commit_window_days(F.lit("p1.commits_xd.json")).alias("n")).first()
    assert (days["d"], days["n"]) == (365, None)


def test_strict_scan_fails_and_missing_path_is_empty(spark, tmp_path):
    write(tmp_path / "bad.jsonl", '{"plugin_id": "a"}\n\n{"plugin_id": \n')
    with pytest.raises(Py4JJavaError, match="FAILED_READ_FILE"):
        readers.read_jsonl_strict(spark, str(tmp_path / "bad.jsonl"), schemas.REGISTRY).collect()
    tolerant = readers.read_jsonl_tolerant(spark, str(tmp_path / "bad.jsonl"), schemas.REGISTRY)
    assert [r["plugin_id"] for r in tolerant.collect()] == ["a"]
    missing = readers.read_jsonl_tolerant(spark, str(tmp_path / "none.jsonl"), schemas.REGISTRY)
    assert missing.count() == 0


def test_best_file_per_entity(spark):
    names = ["a.advisories.jsonl", "a.advisories.real.jsonl", "old.advisories.real.jsonl",
             "b.advisories.sample.jsonl", "b.advisories.real.jsonl", "b.other.json"]
    files = spark.createDataFrame([(n,) for n in names], "file_name STRING")
    real = {r["entity"]: r["file_name"] for r in readers.best_files(files).collect()}
    assert real["a"] == "a.advisories.real.jsonl" and real["b"] == "b.advisories.real.jsonl"
    sample = {r["entity"]: r["file_name"] for r in
              readers.best_files(files, readers.PREFER_SAMPLE).collect()}
    assert sample["b"] == "b.advisories.sample.jsonl"
    candidates = spark.createDataFrame([("n", "n", 0), ("n", "old", 1), ("a", "a", 0), ("a", "old", 1)],
                                       "entity STRING, candidate STRING, is_alias INT")
    named = {r["entity"]: r["file_name"] for r in
             readers.best_files(files, candidates=candidates).collect()}
    assert named == {"n": "old.advisories.real.jsonl", "a": "a.advisories.real.jsonl"}
    listing = spark.createDataFrame([("b.advisories.real.jsonl",), ("b.advisories.sample.jsonl",)], "file_name STRING")
    rows = spark.createDataFrame([("b.advisories.sample.jsonl", 1)], "file_name STRING, x INT")
    assert readers.best_files(rows, listing=listing).count() == 0 and readers.best_files(rows).count() == 1


def test_empty_day_range_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([("20240101", 1)], "day STRING, v INT")
    writers.write_partitioned(df, str(tmp_path / "d"), ["day"])
    assert readers.read_day_shards(spark, str(tmp_path / "d"), "20240101", "20240102").count() == 1
    with pytest.raises(ValueError):
        readers.read_day_shards(spark, str(tmp_path / "d"), "20250101", "20250102")


def test_collection_run_counts(spark):
    wanted = spark.createDataFrame([(c,) for c in "abcde"], "entity STRING")
    existing = wanted.where("entity = 'a'")
    ready = wanted.where("entity <> 'b'")
    status = N.collection_status(wanted, existing, ready, limit=4)
    counts = N.collection_counts(status, wanted.where("entity = 'c'")).first().asDict()
    assert counts == {"processed": 4, "written": 1, "skipped": 1, "precondition_failed": 1,
                      "errors": 1}
    assert N.collection_counts(N.collection_status(wanted, existing, overwrite=True)).first()[
        "written"] == 5


def test_train_save_and_load(spark, tmp_path):
    rows = [(f"e{i % 20}", f"2025-{i % 12 + 1:02d}", float(i % 7), None if i % 3 else float(i % 5),
             int(i % 7 > 3)) for i in range(240)]
    df = spark.createDataFrame(
        rows, "entity STRING, month STRING, advisory_a DOUBLE, swh_b DOUBLE, "
              "label_advisory_within_6m INT")
    trained = M.train_model(df, "logistic", test_start="2025-09", maxIter=20)
    assert trained.columns == ["advisory_a", "swh_b"]
    assert trained.metrics["roc_auc"] > 0.9 and trained.metrics["train_row_count"] == 160
    M.save_artifacts(trained, str(tmp_path / "run"))
    scorer = M.load_scorer(spark, str(tmp_path / "run"))
    assert scorer.columns == trained.columns and scorer.pipeline.stages[-1].numFeatures == 2
    assert scorer.name == "logistic" and scorer.settings["maxIter"] == 20
    assert scorer.metrics["average_precision"] == pytest.approx(trained.metrics["average_precision"])
    saved = readers.read_predictions(spark, str(tmp_path / "run" / "test_predictions"))
    assert saved.count() == 80
    with pytest.raises(ValueError):
        M.get_model("unknown")

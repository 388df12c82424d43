"""Stores, listings and sharded sinks on temporary folders."""

import hashlib
import json
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from quarry.sources import shards, stores


def test_embeddings_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [3.0, 4.0], {"k": "v"}), ("b", [0.0, 0.0], None)], "spectrum_id string, embedding array<double>, m map<string,string>")
    for kind in ("parquet", "jsonl"):
        stores.save_embeddings(df, f"{tmp_path}/{kind}", metadata="m", kind=kind)
        got = {r.spectrum_id: (r.embedding, r.metadata) for r in stores.load_embeddings(spark, f"{tmp_path}/{kind}", kind).collect()}
        assert [round(x, 6) for x in got["a"][0]] == [0.6, 0.8] and got["a"][1] == {"k": "v"} and got["b"] == ([0.0, 0.0], {})
    stores.save_embeddings(df, f"{tmp_path}/raw", normalise=False)
    assert stores.load_embeddings(spark, f"{tmp_path}/raw").where("spectrum_id = 'a'").first().embedding == [3.0, 4.0]
    split = stores.spectra_with_metadata(df.withColumnRenamed("spectrum_id", "sample_id"))
    assert split.columns == ["sample_id", "metadata"]


def test_versions_by_content(spark, tmp_path):
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    (source / "a.txt").write_text("one")
    (source / "sub/b.txt").write_text("one")
    first = stores.commit(spark, "d", str(source), f"{tmp_path}/store", {"x": 1})
    assert first == stores.commit(spark, "d", str(source), f"{tmp_path}/store", {"x": 1})
    assert os.listdir(tmp_path / "store/blobs") and len([x for x in os.listdir(tmp_path / "store/blobs") if not x.startswith(".")]) == 1
    (source / "a.txt").write_text("two")
    second = stores.commit(spark, "d", str(source), f"{tmp_path}/store", {"x": 1}, parent=first)
    assert second != first
    assert stores.checkout(spark, "d", first, f"{tmp_path}/store", f"{tmp_path}/out") == 2
    assert (tmp_path / "out/a.txt").read_text() == "one" and (tmp_path / "out/sub/b.txt").read_text() == "one"


def test_line_shards_and_streamed_checksums(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "PIECE_BYTES", 7)
    got = stores.write_lines(spark.range(50), f"{tmp_path}/lines", 3, "id").collect()
    assert len(got) == 3
    for r in got:
        data = next(pathlib.Path(tmp_path, "lines").glob(r.file)).read_bytes()
        assert (r.bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())


def test_quarantine(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None), (3, None)], "id long, v double")
    rules = {"known": F.col("v").isNotNull(), "positive": F.col("v") > 0}
    manifest = shards.write_shards(df, f"{tmp_path}/s", "id", rules=rules, quarantine=f"{tmp_path}/q")
    assert manifest.agg(F.sum("num_samples")).first()[0] == 1
    assert sorted((r.id, r.fault) for r in spark.read.parquet(f"{tmp_path}/q").collect()) == [(2, "positive"), (3, "known"), (3, "known")]
    with pytest.raises(Exception, match="a row fails"):
        shards.write_shards(df, f"{tmp_path}/t", "id", rules=rules)


def test_reports_listings_and_dumps(spark, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    (folder / "eval_report_one.json").write_text(json.dumps({"metrics": {"loss": 0.5, "acc": 1}}))
    (folder / "eval_report_two.json").write_text(json.dumps({"metrics": {"loss": 0.25}}))
    (folder / "eval_report_bad.json").write_text("[1]")
    got = {r.run_id: (r.loss, r.acc) for r in stores.evaluation_reports(spark, str(folder)).collect()}
    assert got == {"one": ("0.5", "1"), "two": ("0.25", None)}
    for i, name in enumerate(("eval_report_one.json", "eval_report_two.json", "eval_report_bad.json")):
        os.utime(folder / name, (1_000_000 + i * 86400, 1_000_000 + i * 86400))
    assert [r.file for r in stores.listing(spark, str(folder), "json", 1, 1).collect()] == ["eval_report_two.json"]
    old = stores.older_than(stores.listing(spark, str(folder)), 1, F.timestamp_seconds(F.lit(1_000_000 + 2 * 86400)))
    assert [r.file for r in old.collect()] == ["eval_report_one.json"]
    (folder / "eval_report_bad.json").write_text('{"error": "x"}')
    assert {r.file for r in stores.crash_dumps(spark, str(folder)).where("error = 'x'").collect()} == {"eval_report_bad.json"}


def test_training_columns_samples_and_batches(spark, tmp_path):
    assert stores.resolved_columns(["idx", "sentence", "label"]) == ("sentence", "label")
    assert stores.resolved_columns(["q", "a", "gold"]) == ("q", "gold") and stores.resolved_columns([]) == ("text", "label")
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    assert stores.labelled(df, 4).columns == ["text", "labels"] and stores.labelled(df, 4).count() == 4
    df.write.parquet(f"{tmp_path}/p")
    assert [tuple(r) for r in stores.sample_of(spark, f"{tmp_path}/p", "id", 7).collect()] == [(7, 14)]
    plain = {r.id: r.batch for r in stores.loader(df, "val", 4).collect()}
    assert plain == {i: i // 4 for i in range(10)}
    train = stores.loader(df, "train", 4, drop_last=True)
    assert sorted(r["count"] for r in train.groupBy("batch").count().collect()) == [4, 4]
    probs = spark.createDataFrame([([0.25, 0.75], 1)], "p array<float>, t long")
    assert stores.distilled_rows(probs, "p", "t").first().asDict() == {"teacher_probs": [0.25, 0.75], "target": 1}


def test_manifests_and_batches_of_files(spark, tmp_path):
    shards.write_shards(spark.range(20), f"{tmp_path}/a", "id", 100, "d", "run1")
    shards.write_shards(spark.range(5), f"{tmp_path}/b", "id", 1 << 20, "d", "run2")
    got = stores.manifests(spark, str(tmp_path)).where("run_id IS NOT NULL").collect()
    assert [r.run_id for r in got][0] == "run2" and {r.run_id for r in stores.manifests(spark, str(tmp_path), "run1").collect()} == {"run1"}
    spark.range(6).repartition(3).write.json(f"{tmp_path}/j")
    query = stores.batches(spark, f"{tmp_path}/j", "id long").writeStream.format("memory").queryName("batches_seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("batches_seen").count() == 6 and len([p for p in query.recentProgress if p["numInputRows"]]) == 3

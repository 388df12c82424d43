"""Readers, sinks, shards and registries on temporary folders."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.sources import files, registry, shards


def test_formats_round_trip(spark, tmp_path):
    rows = [(1, "é", None), (2, "b", 2.5)]
    df = spark.createDataFrame(rows, "a long, b string, c double")
    files.write_parquet(df, f"{tmp_path}/x.parquet")
    files.write_jsonl(df, f"{tmp_path}/x.jsonl")
    for path in ("x.parquet", "x.jsonl"):
        got = files.read(spark, f"{tmp_path}/{path}", None if path.endswith("parquet") else df.schema)
        assert sorted(map(tuple, got.select("a", "b", "c").collect())) == rows
    assert files.read(spark, f"{tmp_path}/x.parquet", columns=["b"]).columns == ["b"]
    with pytest.raises(ValueError):
        files.format_of("x.bin")


def test_blank_and_broken_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a"\n')
    kept = files.read(spark, f"{tmp_path}/x.jsonl", "a long, _corrupt_record string").cache()
    assert sorted(r.a for r in kept.collect() if r.a is not None) == [1, 2]
    with pytest.raises(Exception, match="Malformed records"):
        files.read(spark, f"{tmp_path}/x.jsonl", "a long").collect()


def test_union_with_missing_columns_and_provenance(spark, tmp_path):
    spark.createDataFrame([(1,)], "id long").coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.createDataFrame([(2, "m")], "id long, model string").coalesce(1).write.parquet(f"{tmp_path}/two")
    for name in ("one", "two"):
        part = next((tmp_path / name).glob("part*.parquet"))
        part.rename(tmp_path / f"outputs_{name}.parquet")
    got = files.with_source(files.union_of(spark, str(tmp_path), "outputs_")).collect()
    assert {(r.id, r.model, r["__source_path"].split("/")[-1]) for r in got} == {(1, None, "outputs_one.parquet"), (2, "m", "outputs_two.parquet")}


def test_csv_conversion_counts_rows_by_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("col1,col2\n1,2\n3,4\n")
    (tmp_path / "in/b.csv").write_text("col1,col2\n5,6\n")
    (tmp_path / "in/c.txt").write_text("no")
    got = files.convert(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert {(r.file, r.rows) for r in got.collect()} == {("a.csv", 2), ("b.csv", 1)}
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("col1")).first()[0] == 9


def test_prompts_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([(" a ", None), ("", "q"), (None, " ")], "prompt string, question string")
    assert sorted(r.prompt for r in files.prompts(df).collect()) == ["a", "q"]
    for i, v in enumerate((3, 5.5)):
        (tmp_path / f"{i}_metrics.json").write_text(json.dumps({"config": f"c{i}", "rate": v}))
    got = files.flat_metrics(spark, str(tmp_path), order="rate").collect()
    assert [(r.config, r.rate) for r in got] == [("c1", 5.5), ("c0", 3.0)]


def test_ion_text(spark):
    df = spark.createDataFrame([("s1", [1.0, 2.0], [0.5, 1.0])], "spectrum_id string, mzs array<double>, intensities array<double>")
    assert files.ion_text(df).first().value == "BEGIN IONS\nTITLE=s1\n1.0 0.5\n2.0 1.0\nEND IONS\n"


def test_shards(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 400).alias("sample_id"), F.lit("x" * 50).alias("t"))
    manifest = shards.write_shards(df, f"{tmp_path}/s", "sample_id", shard_bytes=10_000)
    rows = manifest.collect()
    assert sum(r.num_samples for r in rows) == 400 and len(rows) > 1
    assert shards.verify(spark, f"{tmp_path}/s").count() == 0
    assert shards.rebalance(spark, f"{tmp_path}/s", f"{tmp_path}/r", "sample_id", 1 << 20) == 1
    assert spark.read.parquet(f"{tmp_path}/r/data").count() == 400
    shards.copy_tree(spark, f"file://{tmp_path}/s", f"file://{tmp_path}/copy")
    assert shards.dataset_hash(shards.describe(spark, f"{tmp_path}/copy")).first() == shards.dataset_hash(manifest).first()
    part = sorted((tmp_path / "s/data").glob("part*.parquet"))[0]
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/other")
    part.write_bytes(next((tmp_path / "other").glob("part*.parquet")).read_bytes())
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)  # only Hadoop writers leave one
    assert [tuple(r) for r in shards.verify(spark, f"{tmp_path}/s").collect()] == [(part.name, "checksum")]
    assert shards.runs(manifest).first().samples == 400


def test_null_keys_raise(spark, tmp_path):
    with pytest.raises(PySparkException):
        shards.write_shards(spark.createDataFrame([(None, 1)], "k string, v long"), f"{tmp_path}/s", "k")


def test_registries(spark):
    data = registry.Datasets()
    data.register("toy", lambda s, c, split: registry.synthetic_classification(s, c.get("n", 10)).withColumn("split", F.lit(split)))
    df = data.build(spark, "toy", {"n": 20}, "val", (lambda d: d.where("id < 5"),))
    assert df.count() == 5 and df.first().split == "val"
    with pytest.raises(KeyError):
        data.build(spark, "none")
    with pytest.raises(ValueError):
        data.register("toy", None)
    assert data.views(spark, {"toy": {}}) == ["toy"] and spark.sql("SELECT count(*) FROM toy").first()[0] == 10
    pairs = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0)], "y double, p double")
    got = registry.Metrics().evaluate(pairs, "y", "p", ["accuracy", "rmse"]).first()
    assert got.accuracy == 0.5 and abs(got.rmse - 0.5**0.5) < 1e-12

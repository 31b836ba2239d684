import json

import pytest
from pyspark.sql import functions as F

from polyphony.operators import vectors
from polyphony.sources import io
from polyphony.streaming import incremental


def test_prompt_pool_and_counts(spark, tmp_path):
    spark.createDataFrame([("p1", "en")], "prompt_id string, language string").write.parquet(str(tmp_path / "a" / "one.parquet"))
    spark.createDataFrame([("m", 1), ("m", 2), ("k", 1)], "model string, x int").write.parquet(str(tmp_path / "g"))
    pool = io.prompt_pool(spark, str(tmp_path / "a" / "*.parquet"))
    assert "dataset" in pool.columns and pool.first().human_responses is None
    _, n = io.merged_counts(spark, str(tmp_path / "g"))
    assert {r.model: r.n for r in n.collect()} == {"m": 2, "k": 1}


def test_registry(spark, tmp_path):
    y = tmp_path / "r.yaml"
    y.write_text("models:\n  # note\n  - id: org/A-1\n    family: Fam   # why\n    gpus: 'A40:1'\n  - id: api-x\n    slug: apix\n")
    assert [tuple(r) for r in io.registry(spark, str(y)).collect()] == [("org/A-1", "org_A-1", "Fam", "A40:1"), ("api-x", "apix", "Other", None)]
    assert io.self_hosted(io.registry(spark, str(y))).count() == 1
    j = tmp_path / "r.json"
    j.write_text(json.dumps({"A": "org/a", "B": {"slug": "b", "family": "G"}}))
    assert [tuple(r)[:3] for r in io.registry(spark, str(j)).collect()] == [("A", "org_a", "Other"), ("B", "b", "G")]
    e = tmp_path / "e.yaml"
    e.write_text("models:\n")
    with pytest.raises(ValueError, match="no models"):
        io.registry(spark, str(e))


def test_lines_and_fingerprint(spark, tmp_path):
    for lang, text in (("en", "a\n\n b\n"), ("de", "c\nd\n \n")):
        (tmp_path / f"{lang}.txt").write_text(text)
    lines = io.text_lines(spark, str(tmp_path / "*.txt"))
    assert lines.count() == 4
    io.check_parallel(lines)
    with pytest.raises(ValueError):
        io.check_parallel(lines.where("line <> 'c'"))
    a = io.fingerprint(spark, str(tmp_path / "*.txt"))
    assert len(a) == 64 and a == io.fingerprint(spark, str(tmp_path / "*.txt"))
    (tmp_path / "en.txt").write_text("a\nx\n")
    assert a != io.fingerprint(spark, str(tmp_path / "*.txt"))


def test_metric_sources(spark, tmp_path):
    for n in ("intra__a", "human_intra__a", "intra__b", "inter__a"):
        (tmp_path / f"{n}.parquet").write_bytes(b"x")
    got = {tuple(r) for r in io.metric_sources(spark, str(tmp_path / "*.parquet")).collect()}
    assert got == {("intra", "a"), ("human_intra", "a"), ("inter", "a")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 0.5), ("a", "a", 1.0)], "resp_a string, resp_b string, sim double")
    wide = df.groupBy("resp_a").pivot("resp_b", ["a", "b"]).agg(F.first("sim"))
    io.write_csv(wide, str(tmp_path / "w"))
    assert sorted(map(tuple, io.read_matrix(spark, str(tmp_path / "w")).collect())) == [("a", "a", 1.0), ("a", "b", 0.5)]
    io.write_new(df, str(tmp_path / "n"))
    io.write_new(df.limit(0), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2
    assert io.missing_keys(df, df.where("resp_b = 'a'"), "resp_b").count() == 1
    io.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    v = df.select(F.lit("e").alias("embed_slug"), F.col("resp_a").alias("model"), F.array("sim").alias("e"))
    io.write_vectors(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).where("embed_slug = 'e'").count() == 2


def test_provider(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("hello world",)], "text string")
    got = io.through_provider(df, io.hashing_embedder(16), "text string, embedding array<float>").collect()
    assert got[0].embedding == got[2].embedding and sum(x * x for x in got[0].embedding) == pytest.approx(1, abs=1e-5) and not any(got[1].embedding)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("m", "L", f"p{i % 2}", [float(i), 1.0], f"2026-01-0{i % 3 + 1} 00:00:00", i // 2) for i in range(12)]
    schema = "model string, language string, prompt_id string, e array<double>, ts string, key int"
    for k in range(3):
        spark.createDataFrame(rows[k * 4 : k * 4 + 4], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.partial_sums(s).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {r.prompt_id: (r.n, list(r.s)) for r in incremental.cells(spark.table("sums")).collect()}
    want = {r.prompt_id: (r.n, list(r.s)) for r in vectors.cell_sums(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
    u = incremental.unique_in_time(s.withColumn("ts", F.to_timestamp("ts")), "key", "ts").writeStream.outputMode("append").format("memory").queryName("uniq").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    u.awaitTermination(120)
    assert spark.table("uniq").count() == 6

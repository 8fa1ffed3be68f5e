import json

import pytest
from pyspark.sql import functions as F

from regionkit.operators import runs, store
from regionkit.plans import index
from regionkit.sources import readers, schemas, writers
from regionkit.streaming.questions import answer_stream


def test_question_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "1", "question": "q", "answer": "x", "supporting_facts": [{"title": "B", "sent_id": 0}, {"title": "A", "sent_id": 1}, {"title": "B", "sent_id": 2}]}) + "\n\n")
    (tmp_path / "b.json").write_text(json.dumps([{"_id": "2", "question": "q", "supporting_facts": [["T_x", 0], ["U", 1]]}, {"id": "3", "question": "r", "answer": "y", "supporting_facts": []}]))
    (tmp_path / "c.jsonl").write_text(json.dumps({"id": "4", "question": "q", "answer": "z", "paragraphs": [{"idx": 0, "title": "P", "paragraph_text": "t", "is_supporting": True}, {"idx": 1, "title": "N", "paragraph_text": "t", "is_supporting": False}]}))
    assert readers.read_hotpot(spark, str(tmp_path / "a.jsonl")).first().supporting_titles == ["A", "B"]
    assert readers.load_questions(spark, "hotpotqa", str(tmp_path / "a.jsonl")).first().gold_titles == ["B", "A"]
    b = {r.id: r for r in readers.load_questions(spark, "2wiki", str(tmp_path / "b.json")).collect()}
    assert b["2"].gold_titles == ["T x", "U"] and b["2"].answer == "" and b["3"].n_hops == 0
    assert readers.load_questions(spark, "musique", str(tmp_path / "c.jsonl")).first().gold_titles == ["P"]
    with pytest.raises(ValueError):
        readers.load_questions(spark, "other", "x")


def test_torn_log_and_last_line(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"id": "a", "prediction": "1"}\n\n{"id": "b", "prediction": "2"}\n{"id": "a", "prediction": "3"}\n{"id": "c", "pred')
    assert {r.id for r in readers.done_keys(spark, str(log), ["id"]).collect()} == {"a", "b"}
    got = readers.read_latest(spark, str(log), "id string, prediction string").collect()
    assert {(r.id, r.prediction) for r in got} == {("a", "3"), ("b", "2")}


def test_shards_projection_and_parameters(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    assert writers.append_shard(df.limit(1), f"{tmp_path}/s") == 1
    assert writers.append_shard(df, f"{tmp_path}/s") == 1
    assert readers.read_shards(spark, f"{tmp_path}/s").count() == 2
    writers.write_projection(spark, str(tmp_path), 6, 3)
    assert writers.read_projection(spark, str(tmp_path)).shape == (3, 6)
    bad = spark.read.parquet(f"{tmp_path}/projection").withColumn("seed", F.lit(5)).collect()
    spark.createDataFrame(bad, "row int, weights array<double>, seed int").write.mode("overwrite").parquet(f"{tmp_path}/bad/projection")
    with pytest.raises(ValueError):
        writers.read_projection(spark, f"{tmp_path}/bad")
    writers.write_parameter(spark.createDataFrame([(1.5, 3)], "tau double, n int"), f"{tmp_path}/tau.json")
    assert readers.read_parameter(spark, f"{tmp_path}/tau.json") == {"tau": 1.5, "n": 3}
    assert readers.read_parameter(spark, f"{tmp_path}/none.json") is None
    with pytest.raises(FileNotFoundError):
        readers.read_built(spark, str(tmp_path), "boxes")
    assert "| 1.5000 |" in writers.markdown_table(spark.createDataFrame([(1.5,)], "x double"), "Scores")
    assert json.loads(writers.scores_json(df.select("chunk_id").limit(1)))[0]["chunk_id"] in "ab"


def test_index_build(spark, tmp_path):
    rows = [(f"c{i:02d}", [float((i * 7) % 11), float((i * 3) % 5), 1.0]) for i in range(30)]
    v = spark.createDataFrame(rows, "chunk_id string, v array<double>")
    index.build_dense(v, str(tmp_path))
    alpha = index.build_boxes(v, str(tmp_path), n_pairs=50)
    assert alpha > 0 and readers.read_built(spark, str(tmp_path), "boxes").count() == 30
    assert sorted(r.idx for r in index.numbered(v).collect()) == list(range(30))


def test_stream_answers_each_question_once(spark, tmp_path):
    src, log = tmp_path / "in", str(tmp_path / "log")
    src.mkdir()
    line = lambda i: json.dumps({"id": i, "dataset": "d", "question": f"q{i}", "answer": "", "gold_titles": [], "n_hops": 0})
    answer = lambda df: runs.generate(df.select("id", F.col("question").alias("prompt")))
    (src / "1.json").write_text("\n".join([line("a"), line("a"), line("b")]))
    answer_stream(spark, str(src), log, str(tmp_path / "cp"), answer).awaitTermination()
    (src / "2.json").write_text("\n".join([line("b"), line("c")]))
    answer_stream(spark, str(src), log, str(tmp_path / "cp"), answer).awaitTermination()
    assert sorted(r.id for r in readers.read_log(spark, log, "id string, prediction string").collect()) == ["a", "b", "c"]


def test_region_store(spark):
    base = spark.createDataFrame([("x", [0.0, 0.0], [1.0, 1.0], None, None, 0, [], 1.0), ("y", [0.5, 0.5], [1.5, 1.5], None, None, 5, [], 0.1)], store.SCHEMA)
    lens = store.intersect(base, spark.createDataFrame([("x", "y")], "a string, b string"))
    assert (lens.first().depth, set(lens.first().citations)) == (6, {"x", "y"})
    assert store.intersect(base, spark.createDataFrame([("x", "y")], "a string, b string"), tau=10.0).count() == 0
    more = store.promote(base, lens).persist()
    assert more.count() == 3 and store.promote(more, lens).count() == 3
    cited = {r.region_id: set(r.citations) for r in more.collect()}
    assert cited["x"] == {lens.first().region_id}
    assert {r.region_id: r.steps for r in store.walk(more, more.where("region_id = 'x'"), 2).collect()} == {"x": 0, lens.first().region_id: 1, "y": 2}
    assert store.decay(base, 0.5, 0.4).count() == 1
    v = store.vote(spark.createDataFrame([("c", "m", 0.0), ("c", "n", 0.0)], "council string, member string, score double"))
    assert [r.weight for r in v.collect()] == [0.5, 0.5]


def test_schemas_parse(spark):
    for name in dir(schemas):
        if name.isupper():
            spark.createDataFrame([], getattr(schemas, name))

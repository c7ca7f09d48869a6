import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import readers as RS
from tessera.sources import sinks as SK


def test_read_table_prefers_train_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "test"), (2, "b", "train"), (3, "c", "train")],
                               "id long, text string, split string")
    df.write.partitionBy("split").parquet(str(tmp_path / "t"))
    got = sorted(r.id for r in RS.read_table(spark, str(tmp_path / "t")).collect())
    assert got == [2, 3]
    df.where("split = 'test'").write.partitionBy("split").parquet(str(tmp_path / "only_test"))
    assert [r.id for r in RS.read_table(spark, str(tmp_path / "only_test")).collect()] == [1]


def test_optional_source_is_empty(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    df = RS.read_table(spark, str(tmp_path / "missing"), optional=True, schema=schema)
    assert df.count() == 0 and df.columns == ["id", "text"]
    with pytest.raises(Exception):
        RS.read_table(spark, str(tmp_path / "missing"))


def test_optional_source_with_a_wrong_column_is_an_error(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType())])
    spark.range(3).write.parquet(str(tmp_path / "there"))
    with pytest.raises(Exception, match="idd"):
        RS.read_table(spark, str(tmp_path / "there"), optional=True, schema=schema, columns=["idd"])


def test_ingest_with_a_fresh_checkpoint_adds_to_the_output(spark, tmp_path):
    from tessera.streaming.ingest import ingest
    for name, k in (("in1", 1), ("in2", 2)):
        spark.createDataFrame([(k, str(k))], "id long, dedup_key string").write.parquet(str(tmp_path / name))

    def go(landing, checkpoint):
        ingest(spark, str(tmp_path / landing), spark.read.parquet(str(tmp_path / landing)).schema, lambda d: d,
               str(tmp_path / "out"), str(tmp_path / checkpoint))
    go("in1", "one")
    go("in1", "one")
    go("in2", "two")
    go("in1", "three")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_generated_fallback_to_raw(spark, tmp_path):
    raw = [{"prompt": "a prompt longer than ten", "response": "a response longer than ten", "success": True,
            "request_index": 0, "timestamp": "t", "model": "m"},
           {"prompt": "p", "response": None, "success": False, "request_index": 1, "error": "timeout",
            "timestamp": "t", "model": "m"}]
    (tmp_path / "gen_raw.json").write_text(json.dumps(raw))
    got = RS.read_generated(spark, str(tmp_path / "gen.json"))
    assert [(r.prompt, r.response) for r in got.collect()] == [("a prompt longer than ten", "a response longer than ten")]
    with pytest.raises(FileNotFoundError):
        RS.read_generated(spark, str(tmp_path / "nothing.json"))


def _results(spark):
    return spark.createDataFrame(
        [("a prompt", "an answer", "t", "m", True, 0, None, 0), ("b prompt", None, "t", "m", False, 1, "boom", 0),
         ("c prompt", "", "t", "m", True, 2, None, 1)],
        "prompt string, response string, timestamp string, model string, success boolean, request_index long, "
        "error string, batch_id long")


def test_pair_and_raw_sinks(spark, tmp_path):
    res = _results(spark)
    SK.write_pairs(res, str(tmp_path / "pairs"))
    SK.write_raw(res, str(tmp_path / "raw"))
    valid, rejected = RS.read_pairs(spark, str(tmp_path / "pairs"), multiline=False)
    assert [list(r.data) for r in valid.collect()] == [["a prompt", "an answer"]]
    assert spark.read.json(str(tmp_path / "raw")).count() == 3


def test_append_batches_is_idempotent(spark, tmp_path):
    res = _results(spark)
    out = str(tmp_path / "batches")
    SK.append_batches(res, out)
    SK.append_batches(res.where("batch_id = 1"), out)      # replay of one batch
    assert spark.read.json(out).count() == 3


def test_question_outputs(spark, tmp_path):
    numbered = spark.createDataFrame([(1, "  1. What?"), (2, "  2. Why?")], "n long, line string")
    env = SK.question_envelope(numbered, "2024-01-01T00:00:00").first()
    assert (env.generated_at, env.total_questions) == ("2024-01-01T00:00:00", 2)
    lines = SK.question_lines(numbered, "2024-01-01 00:00:00").orderBy("n").collect()
    assert [r.line for r in lines] == ["# Common Questions Generated on 2024-01-01 00:00:00", "# Total: 2 questions",
                                       "", "  1. What?", "  2. Why?"]
    SK.write_lines(SK.question_lines(numbered), str(tmp_path / "q"))
    assert spark.read.text(str(tmp_path / "q")).count() == 5


def test_report_and_windows(spark, tmp_path):
    w = spark.createDataFrame([("train", 0, [1, 2], [2, 3]), ("val", 0, [4, 5], [5, 6])],
                              "split string, seq long, inputs array<int>, targets array<int>")
    SK.write_windows(w, str(tmp_path / "w"))
    back = spark.read.parquet(str(tmp_path / "w"))
    assert sorted(r.split for r in back.collect()) == ["train", "val"]
    SK.write_report(w.groupBy("split").count(), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 2

"""Committed outputs and resumable generation."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import generation as GN
from tessera.sources import committed as CM
from tessera.sources import sinks as SK


def test_parts_are_replaced_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    a = CM.publish(spark.range(10), out, "a")
    CM.publish(spark.range(5), out, "b", "json")
    assert a["rows"] == 10 and sum(f["bytes"] for f in a["files"]) > 0
    assert CM.read_committed(spark, out).count() == 15
    CM.publish(spark.range(3), out, "a")
    got = CM.read_committed(spark, out, part="part").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in got} == {"a": 3, "b": 5}
    assert CM.read_committed(spark, out, names=["b"]).count() == 5
    assert not any(n.startswith("_staging") for n in os.listdir(out)) and len(os.listdir(out)) == 3


@pytest.mark.parametrize("step", ["move", "write"])
def test_an_interrupted_write_is_never_read(spark, tmp_path, monkeypatch, step):
    out = str(tmp_path / "out")
    CM.publish(spark.range(4), out, "a")
    with monkeypatch.context() as m:
        m.setattr(CM._Store, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            CM.publish(spark.range(100), out, "b")
        with pytest.raises(OSError):
            CM.publish(spark.range(100), out, "a")
    assert CM.read_committed(spark, out).count() == 4
    CM.publish(spark.range(6), out, "b")
    assert CM.read_committed(spark, out).count() == 10


def test_empty_parts_and_folders(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert CM.read_committed(spark, out, schema=schema, part="p").columns == ["id", "p"]
    with pytest.raises(FileNotFoundError):
        CM.read_committed(spark, out)
    assert CM.publish(spark.range(0), out, "none")["rows"] == 0
    assert CM.read_committed(spark, out).count() == 0


def test_question_file_in_manifest_order(spark, tmp_path):
    """K5: the part's files, one behind the other, are the numbered file."""
    out = str(tmp_path / "q")
    numbered = spark.range(1, 301).select(F.col("id").alias("n"), F.format_string("%3d. Question %d?", "id", "id").alias("line"))
    m = CM.publish_lines(SK.question_lines(numbered.repartition(7), "2024-01-01 00:00:00"), out, "questions")
    text, at = b"", 0
    for f in m["files"]:
        assert f["offset"] == at
        text += open(f"{out}/{m['folder']}/{f['name']}", "rb").read()
        at += f["bytes"]
    want = ["# Common Questions Generated on 2024-01-01 00:00:00", "# Total: 300 questions", ""]
    want += [f"{i:3d}. Question {i}?" for i in range(1, 301)]
    assert text.decode() == "\n".join(want) + "\n" and m["rows"] == 303
    assert CM.whole_file_order(m) == [f["name"] for f in m["files"]]


def _responder(log):
    def answer(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt.endswith("3"):
            raise TimeoutError("Request timed out")
        return "re: " + prompt
    return answer


class Killed(Exception):
    pass


@pytest.mark.parametrize("stop_at", [1, 2, 3])
def test_a_killed_run_goes_on_without_second_calls(spark, tmp_path, stop_at):
    prompts = spark.range(43).select("id", F.concat(F.lit("p"), "id").alias("prompt"), F.floor(F.col("id") / 5).alias("batch_id"))
    out, whole, log = str(tmp_path / "out"), str(tmp_path / "whole"), str(tmp_path / "calls")
    done = []

    def kill(m):
        done.append(m)
        if len(done) == stop_at:
            raise Killed
    with pytest.raises(Killed):
        GN.generate(prompts, _responder(log), out, every=2, after_step=kill)
    before = open(log).read().split()
    assert len(before) == 10 * stop_at == GN.results(spark, out).count()
    rest = GN.generate(prompts, _responder(log), out, every=3)  # another step size
    calls = open(log).read().split()
    assert len(calls) == len(set(calls)) == 43 and sum(m["rows"] for m in rest) == 43 - len(before)
    assert GN.generate(prompts, _responder(log), out) == [] and len(open(log).read().split()) == 43
    GN.generate(prompts, _responder(str(tmp_path / "other")), whole)
    cols = ["request_index", "prompt", "response", "success", "error", "error_type", "batch_id"]
    a, b = (sorted((tuple(r) for r in GN.results(spark, p).select(*cols).collect())) for p in (out, whole))
    assert a == b and sum(not r[3] for r in a) == 4  # p3 p13 p23 p33
    assert [r["total_succeeded"] for r in GN.progress(spark, out).orderBy("batch_id").collect()][-1] == 39


def test_a_step_that_fails_keeps_nothing(spark, tmp_path, monkeypatch):
    prompts = spark.range(10).select("id", F.lit("p").alias("prompt"), F.floor(F.col("id") / 5).alias("batch_id"))
    out = str(tmp_path / "out")
    with monkeypatch.context() as m:
        m.setattr(CM._Store, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            GN.generate(prompts, str.upper, out, every=1)
    assert GN.results(spark, out).count() == 0
    GN.generate(prompts, str.upper, out, every=1)
    assert sorted(r["request_index"] for r in GN.results(spark, out).collect()) == list(range(10))


def test_null_and_repeated_keys_and_no_prompts(spark, tmp_path):
    out = str(tmp_path / "out")
    prompts = spark.createDataFrame([(None, "a", None), (1, "b", 0), (1, "c", 0)], "id long, prompt string, batch_id long")
    GN.generate(prompts, str.upper, out)
    assert sorted((r["request_index"], r["response"]) for r in GN.results(spark, out).collect() if r["request_index"]) == [(1, "B"), (1, "C")]
    assert GN.results(spark, out).count() == 3
    assert [m["rows"] for m in GN.generate(prompts, str.upper, out)] == [1]
    assert GN.generate(prompts.where("id > 1"), str.upper, str(tmp_path / "none")) == []

"""JSON arrays in byte ranges against one reader."""

import io
import json
import random

import pytest
from pyspark.sql import types as T

from tessera.sources import json_array as JA
from tessera.sources import readers as RS

ODD = ['plain', 'a "quoted" word', 'back\\slash\\', '\\"', '[1, 2]', '{"a": "]"}', '日本 é 🙂', 'line\nend\r\n', '', ',', '\\\\\\"', ' ', '"' * 9]


def by_ranges(data: bytes, step: int):
    """Both passes over ranges of ``step`` bytes, in one process."""
    file, size, out = io.BytesIO(data), len(data), []
    inside, depth = 0, 0
    for start in range(0, size, step):
        end = min(start + step, size)
        out += list(JA.elements(file, start, end, size, bool(inside), depth))
        parity, outside, within = JA.scan(file, start, end)
        depth += within if inside else outside
        inside = (inside + parity) % 2
    return out


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_any_range_gives_the_same_elements(block, monkeypatch):
    monkeypatch.setattr(JA, "BLOCK", block)
    r = random.Random(1)
    for _ in range(12):
        rows = [r.choice([{"data": [r.choice(ODD), r.choice(ODD)], "n": [1, [2, {"x": None}]]}, r.choice(ODD), 3.5, None, [], {}, [r.choice(ODD)]])
                for _ in range(r.randint(0, 9))]
        for data in (json.dumps(rows), json.dumps(rows, indent=2, ensure_ascii=False), " \n" + json.dumps(rows) + "\r\n"):
            raw = data.encode()
            for step in (1, 2, 3, 7, 50, 10_000):
                got = by_ranges(raw, step)
                assert [json.loads(v) for _, v, _ in got] == rows and not any(e for *_, e in got)
                assert all(raw[at:].lstrip().startswith(v) for at, v, _ in got)


@pytest.mark.parametrize("step", [1, 4, 1000])
def test_faults_have_reasons(step):
    assert by_ranges(b"", step) == [] and by_ranges(b"[]", step) == [] and by_ranges(b"\xef\xbb\xbf[1]", step) == [(4, b"1", None)]
    assert [e for *_, e in by_ranges(b"[1,,2]", step)] == [None, "empty element", None]
    assert by_ranges(b'[1, {"a": "b', step) == [(1, b"1", None), (3, b'{"a": "b', "the file ends inside the array")]
    assert {e for *_, e in by_ranges(b"[1] x", step)} == {None, "text outside the array"}


def test_files_of_several_ranges(spark, tmp_path):
    r, rows = random.Random(2), []
    for i in range(400):
        rows.append({"data": [f"prompt {i} {r.choice(ODD)}", r.choice(ODD) * r.randint(0, 30)], "metadata": {"timestamp": "t", "model": None, "source": "s"}})
    rows[7], rows[11], rows[13] = {"other": 1}, {"data": ["one"]}, {"data": 5}
    for k in range(2):
        (tmp_path / f"part{k}.json").write_text(json.dumps(rows[k * 200:(k + 1) * 200], ensure_ascii=bool(k)))
    one = None
    for split in (1 << 20, 500, 4099):
        valid, rejected = RS.read_pairs(spark, str(tmp_path), split_bytes=split)
        assert valid.columns == ["data", "metadata", "_file"]
        got = (sorted((list(x["data"]), x["metadata"]["source"]) for x in valid.collect()),
               sorted((x["reject_reason"], x["_record"]) for x in rejected.select("reject_reason", "_record").fillna("").collect()))
        one = one or got
        assert got == one
    assert one[0] == sorted((x["data"], "s") for i, x in enumerate(rows) if i not in (7, 11, 13))
    assert one[1] == [("missing data", ""), ("not a record of the schema", '{"data": 5}'), ("not two messages", "")]
    tasks = JA.read_elements(spark, str(tmp_path), 500)
    assert tasks.rdd.getNumPartitions() > 20


def test_json_lines_keep_broken_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": ["p", "r"]}\n{"data": ["p", \n')
    valid, rejected = RS.read_pairs(spark, str(tmp_path), multiline=False)
    assert valid.count() == 1
    assert [(x["reject_reason"], x["_record"]) for x in rejected.collect()] == [("not a record of the schema", '{"data": ["p", ')]


def test_written_arrays_are_json(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    df = spark.createDataFrame([(i, None if i % 7 == 0 else t) for i, t in enumerate(ODD * 20)], schema)
    JA.write_array(df.repartition(3), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part*"))
    assert sum(len(json.loads(f.read_text())) for f in files) == df.count()
    back = JA.read_array(spark, str(tmp_path / "out"), schema, 300)
    assert sorted((x["id"], x["t"] or "") for x in back.collect()) == sorted((x["id"], x["t"] or "") for x in df.collect())
    JA.write_array(df.where("id < 0"), str(tmp_path / "none"))
    assert JA.read_array(spark, str(tmp_path / "none"), schema).count() == 0

"""Preparation over a user's own sources, and the files it reads."""

import hashlib
import json

import pytest

from tessera.operators.tokens import build_vocab, decode
from tessera.plans import corpus as C
from tessera.plans.prepare import Source, prepare
from tessera.sources import readers as RS
from tessera.sources import sinks as SK
from tessera.sources.committed import manifests, read_committed

LONG = "This article says something of its own, and it says so in more than a hundred characters of text, number "


def articles(spark, n=40):
    return spark.createDataFrame([(i, f"  {LONG}{i}.\n" if i % 10 else "too short") for i in range(n)], "id long, text string")


def texts(spark, out):
    return [r["text"] for r in read_committed(spark, out, ["documents"]).orderBy(*C.UNIT_ORDER).collect()]


def test_all_kinds_from_files(spark, tmp_path):
    SK.write_text_files(spark.createDataFrame([("book2.txt", "junk\r\nCHAPTER I\r\nTwo."), ("book10.txt", "PREFACE\nTen."), ("book3.txt", "CHAPTER\n \n")],
                                              "path string, text string"), str(tmp_path / "books"))
    (tmp_path / "pairs.json").write_text(json.dumps([{"data": ["first prompt", "first response"]}, {"data": ["short", "second response"]}, {"data": ["one"]},
                                                     {"data": ["third prompt", "no no no no no no no"]}, {"other": 1}]))
    chats = spark.createDataFrame([("b", ["hi", "ho"]), ("a", ["alone"]), ("c", None), (None, ["x", None, "z"])], "id string, data array<string>")
    out = str(tmp_path / "out")
    report = prepare(spark, [Source("book", path=str(tmp_path / "books")), Source("chat", rows=chats), Source("pair", path=str(tmp_path / "pairs.json")),
                             Source("article", rows=articles(spark)), Source("article", path=str(tmp_path / "none"), name="more"),
                             Source("article", name="off", rows=articles(spark), sample=0), Source("chat", name="nothing")], out, length=16).collect()
    got = {r["source"]: (r["rows_in"], r["rows_kept"], r["rejected"], r["note"]) for r in report}
    assert [r["source"] for r in report] == ["book", "chat", "pair", "article", "more", "off", "nothing"]
    assert got == {"book": (3, 3, "", None), "chat": (4, 2, "min_turns_2: 2", None),
                   "pair": (5, 1, "exact_turns_2: 2, min_len_10: 1, repetitive: 1", None), "article": (40, 36, "too_short: 4", None),
                   "more": (0, 0, "", f"no such path: {tmp_path}/none"), "off": (0, 0, "", "switched off"), "nothing": (0, 0, "", "not given")}
    docs = texts(spark, out)
    assert docs[:6] == ["PREFACE\nTen.", "CHAPTER I\nTwo.", "CHAPTER", "Human: x\n\nAssistant: None\n\nHuman: z\n\n<|endofconversation|>\n\n",
                        "Human: hi\n\nAssistant: ho\n\n<|endofconversation|>\n\n",
                        "first prompt\n\nfirst response\n\n<|endofconversation|>\n\n"]
    assert docs[6:] == [f"{LONG}{i}." for i in range(40) if i % 10]
    assert sum(r["tokens"] for r in report) == sum(r["train_tokens"] + r["val_tokens"] for r in report) and abs(sum(r["pct"] for r in report) - 100) < 1e-9
    assert set(manifests(spark, out)) == {"documents", "report", "windows-train", "windows-val"}


def test_windows_hold_the_whole_stream(spark, tmp_path):
    """Every id of both splits comes back from the published windows, in order."""
    out = str(tmp_path / "out")
    report = prepare(spark, [Source("article", rows=articles(spark))], out, length=16, frac=0.7).collect()
    docs = read_committed(spark, out, ["documents"])
    vocab = build_vocab(docs, "text")
    text = "".join(t + "<|endoftext|>" for t in texts(spark, out))
    streams = []
    for split, column in (("windows-train", "train_tokens"), ("windows-val", "val_tokens")):
        w = read_committed(spark, out, [split]).orderBy("seq").collect()
        assert [r["seq"] for r in w] == list(range(len(w))) and all(len(r["inputs"]) == 16 for r in w[:-1])
        ids = [i for r in w for i in r["inputs"]] + [w[-1]["targets"][-1]]
        assert len(ids) == report[0][column] and ids[1:] == [i for r in w for i in r["targets"]]
        streams += ids
    back = decode(spark.createDataFrame([(1, streams)], "k long, ids array<long>"), vocab, "k").first()["text"]
    assert back == text


def test_samples_and_caps(spark, tmp_path):
    many = articles(spark, 200)
    out = str(tmp_path / "out")
    report = prepare(spark, [Source("article", rows=many, sample=50), Source("article", name="first", rows=many, cap=5)], out).collect()
    assert [(r["source"], r["rows_in"]) for r in report] == [("article", 50), ("first", 5)]
    drawn = sorted(range(200), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:50]
    ids = [r["id"] for r in read_committed(spark, out, ["documents"]).collect() if r["source"] == "article"]
    assert sorted(ids) == sorted(i for i in drawn if i % 10)
    assert report[1]["rows_kept"] == 4


def test_empty_sources(spark, tmp_path):
    """Given rows that are none, no source at all, and a source that must be there."""
    none = articles(spark, 3).where("id < 0")
    empty = spark.createDataFrame([], "id long, text string")
    report = prepare(spark, [Source("article", rows=none), Source("article", name="made", rows=empty)], str(tmp_path / "a")).collect()
    assert [(r["rows_in"], r["rows_kept"], r["tokens"], r["note"]) for r in report] == [(0, 0, 0, None)] * 2
    assert prepare(spark, [], str(tmp_path / "b")).count() == 0
    with pytest.raises(RS.SourceMissing):
        prepare(spark, [Source("article", path=str(tmp_path / "none"), optional=False)], str(tmp_path / "c"))
    with pytest.raises(RS.SourceMissing):
        prepare(spark, [Source("book", path=str(tmp_path), optional=False)], str(tmp_path / "c"))
    with pytest.raises(ValueError, match="poem"):
        prepare(spark, [Source("poem")], str(tmp_path / "c"))

from pyspark.sql import functions as F

from tessera.operators import render as RD
from tessera.operators import rules as R


def test_pair_length_boundary(spark):
    df = spark.createDataFrame([(1, ["x" * 9, "y" * 20]), (2, ["x" * 10, "y" * 10]), (3, ["x" * 20, "y" * 9])],
                               "id long, data array<string>")
    kept = sorted(r.id for r in RD.render_pair(df).collect())
    assert kept == [2]


def test_finetune_strip_boundary(spark):
    df = spark.createDataFrame([(1, ["  " + "a" * 10 + " ", "b" * 11]), (2, [" " + "a" * 11 + "\n", "b" * 11])],
                               "id long, data array<string>")
    assert sorted(r.id for r in RD.render_finetune(df).collect()) == [2]


def test_repetition_rule(spark):
    resp = {1: "same same same", 2: "same same same same", 3: "a b c a b c a b c a",
            4: "a a a a a a a a a b"}
    df = spark.createDataFrame([(k, ["prompt long enough", v + " " * 0]) for k, v in resp.items()],
                               "id long, data array<string>")
    kept = sorted(r.id for r in RD.render_pair(df).collect())
    # 3 words: no check; 4 equal words: 0.25 < 0.3 dropped; 10 words / 3 distinct = 0.3 kept; 2/10 dropped
    expect = [k for k, v in resp.items() if not (len(v.split()) > 3 and len(set(v.split())) / len(v.split()) < 0.3)]
    assert kept == sorted(expect) == [1, 3]


def test_article_length(spark):
    base = "a" * 99
    rows = [(1, base), (2, "a" * 100), (3, "a" * 101), (4, "\n" + "a" * 100 + " "),
            (5, " " + "a" * 101 + "\n"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    fast = sorted(r.id for r in RD.render_article(df, end_marker=False).collect())
    std = sorted(r.id for r in RD.render_article(df, end_marker=True).collect())
    assert fast == [k for k, t in rows if t and len(t.strip()) > 100] == [3, 5]
    assert std == [k for k, t in rows if t and len(t.strip()) >= 100] == [2, 3, 4, 5]
    r = {x.id: x.text for x in RD.render_article(df, end_marker=False).collect()}
    assert r[5] == "a" * 101


def test_chat_size(spark):
    rows = [(0, []), (1, ["h"]), (2, ["h", "a"]), (3, ["h", "a", "h2"]), (4, None)]
    df = spark.createDataFrame(rows, "conv_id long, data array<string>")
    out = {r.conv_id: r.text for r in RD.render_chat(df).collect()}
    assert sorted(out) == [2, 3]
    assert out[3] == "Human: h\n\nAssistant: a\n\nHuman: h2\n\n<|endofconversation|>\n\n"


def test_pair_size_and_reasons(spark):
    rows = [(1, ["only one prompt"]), (2, ["a prompt here", "a response here"]),
            (3, ["p" * 12, "r" * 12, "x" * 12]), (4, None), (5, ["p" * 12, None])]
    df = RD.pair_columns(spark.createDataFrame(rows, "id long, data array<string>"))
    tagged = {r.id: r.reject_reason for r in R.with_reject_reason(df, RD.pair_rules()).collect()}
    assert tagged == {1: "exact_turns_2", 2: None, 3: "exact_turns_2", 4: "exact_turns_2", 5: "min_len_10"}
    counts = {r.outcome: r.n for r in R.reject_counts(R.with_reject_reason(df, RD.pair_rules())).collect()}
    assert counts == {"exact_turns_2": 3, "kept": 1, "min_len_10": 1}

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import candidates as CD


def _c(spark, rows):
    return spark.createDataFrame(rows, "g string, token string, logit double")


def test_top_k_keeps_ties(spark):
    c = _c(spark, [("g", "a", 3.0), ("g", "b", 2.0), ("g", "c", 2.0), ("g", "d", 1.0)])
    assert sorted(r.token for r in CD.top_k(c, 2).collect()) == ["a", "b", "c"]


def test_nucleus_first_alone_and_exact_mass(spark):
    c = _c(spark, [("g", "a", math.log(0.95)), ("g", "b", math.log(0.05))])
    assert [r.token for r in CD.nucleus(c, 0.9).collect()] == ["a"]
    # masses 0.5 / 0.25 / 0.25: the mass before "c" is 0.75; with p = 0.75 it is kept
    c2 = _c(spark, [("h", "a", math.log(0.5)), ("h", "b", math.log(0.25)), ("h", "c", math.log(0.25))])
    got = sorted(r.token for r in CD.nucleus(c2, 0.5).collect())
    assert got == ["a", "b"]
    probs = {r.token: r.prob for r in CD.nucleus(c2, 0.5).collect()}
    assert abs(sum(probs.values()) - 1.0) < 1e-12


def test_penalty_divides_whatever_sign(spark):
    c = spark.createDataFrame([("g", "a", 2.0), ("g", "b", -2.0), ("g", "c", 1.0)], "g string, token string, score double")
    h = spark.createDataFrame([("a",), ("b",)], "token string")
    got = {r.token: r.logit for r in CD.penalize(c, h, 2.0).collect()}
    assert got == {"a": 1.0, "b": -1.0, "c": 1.0}


def test_draw_deterministic(spark):
    c = _c(spark, [("g", "a", 0.0), ("g", "b", 0.0), ("k", "x", 0.0)])
    s = CD.softmax(c)
    d1 = sorted(tuple(r) for r in CD.draw(s, 1).collect())
    d2 = sorted(tuple(r) for r in CD.draw(s, 1).collect())
    assert d1 == d2 and len(d1) == 2


def test_presets_count_their_candidates_once(spark):
    docs = spark.createDataFrame([("a b a c a b",)], "text string")
    got = CD.apply_presets(CD.bigram_candidates(docs), spark.createDataFrame([(" b",)], "token string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and plan.count("FileScan parquet") >= len(CD.PRESETS)
    assert {r["preset"] for r in got.collect()} == set(CD.PRESETS)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_text_is_cut_into_pieces_once(spark):
    texts = ["a b a b", "a", "", None, " b", "a b"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    c = CD.bigram_candidates(docs)
    assert _plan(c).count("regexp_extract_all") == 1
    got = {(r.g, r.token): (r.n, round(r.score, 9)) for r in c.collect()}
    assert got == {("a", " b"): (2, round(math.log(2), 9)), (" b", " a"): (1, 0.0), (" a", " b"): (1, 0.0)}


def test_nucleus_sorts_once_and_equals_the_two_softmaxes(spark):
    rows = [(f"g{i % 7}", f"t{i:03d}", float((i * 37) % 11) / 3) for i in range(200)]
    rows += [("even", f"t{i:02d}", 0.0) for i in range(20)] + [(None, "a", 1.0), (None, "b", 0.0)]
    rows += [("odd", "a", None), ("odd", "b", 1.0), ("void", "a", None), ("void", "b", None),
             ("nan", "a", float("nan")), ("nan", "b", 1.0), ("inf", "a", float("inf")), ("inf", "b", 1.0)]
    c = _c(spark, rows)
    got = CD.nucleus(c, 0.9)
    plan = _plan(got)
    assert plan.count("Sort [") == 1 and plan.count("EXP(") == 1

    w = Window.partitionBy("g").orderBy(F.col("logit").desc(), "token").rowsBetween(Window.unboundedPreceding, -1)
    s = CD.softmax(c, out="_p").withColumn("_b", F.coalesce(F.sum("_p").over(w), F.lit(0.0))).where("_b <= 0.9")
    want = CD.softmax(s.drop("_p", "_b"))
    shown = lambda df: sorted(map(str, df.select("g", "token", "logit", F.round("prob", 12).alias("prob")).collect()))
    assert got.columns == want.columns and shown(got) == shown(want)

"""Scored-candidate filters (W7-W13) over a table ``g, token, score``.

One group is one decoding context; its rows are its distinct candidate
tokens, so a group is bounded by the vocabulary, never by the data volume.
All steps are windows per group plus one equi-join for the history.
Ties are broken by ``token`` so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import pieces
from tessera.operators.ordering import broadcast_if_small
from tessera.session import cut_table

# The three sampling presets (temperature, repetition
# penalty, top-k, top-p).
PRESETS = {
    "conservative": (1.2, 1.3, 40, 0.85),
    "balanced": (1.5, 1.2, 50, 0.9),
    "creative": (2.0, 1.1, 60, 0.95),
}


def bigram_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Next-piece counts over texts: ``g`` = a piece, ``token`` = the piece
    after it, ``score = ln(count)``.  Map-side partial counts.  Pieces are a
    column of their own and no filter reads them: each text is cut once."""
    cut = docs.select(pieces(F.col(text)).alias("_p"))
    n = F.greatest(F.size("_p") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("_p", F.lit(1), n).alias("g"), F.slice("_p", F.lit(2), n).alias("token"))
    ex = cut.select(F.explode(pairs).alias("_b")).select("_b.g", "_b.token")
    return ex.groupBy("g", "token").agg(F.count(F.lit(1)).alias("n")).withColumn("score", F.log(F.col("n")))


def penalize(cand: DataFrame, history: DataFrame, penalty: float, token: str = "token",
             score: str = "score") -> DataFrame:
    """Divide the score of tokens found in ``history`` by ``penalty``
    (whatever the sign of the score, as in the original rule)."""
    h = broadcast_if_small(history.select(F.col(token).alias("_h")).distinct().withColumn("_hit", F.lit(True)))
    j = cand.join(h, F.col(token) == F.col("_h"), "left")
    return j.withColumn("logit", F.when(F.col("_hit"), F.col(score) / penalty).otherwise(F.col(score))).drop("_h", "_hit")


def _grp(g: str):
    return Window.partitionBy(g)


def temperature(cand: DataFrame, t: float, logit: str = "logit") -> DataFrame:
    return cand.withColumn(logit, F.col(logit) / t)


def top_k(cand: DataFrame, k: int, g: str = "g", logit: str = "logit") -> DataFrame:
    """Keep logits not below the k-th largest (ties with it kept)."""
    r = F.rank().over(Window.partitionBy(g).orderBy(F.col(logit).desc()))
    return cand.withColumn("_r", r).where(F.col("_r") <= k).drop("_r")


def softmax(cand: DataFrame, g: str = "g", logit: str = "logit", out: str = "prob") -> DataFrame:
    """Probabilities per group (max-shifted exponentials)."""
    e = F.exp(F.col(logit) - F.max(logit).over(_grp(g)))
    c = cand.withColumn("_e", e)
    return c.withColumn(out, F.col("_e") / F.sum("_e").over(_grp(g))).drop("_e")


def nucleus(cand: DataFrame, p: float, g: str = "g", logit: str = "logit",
            token: str = "token", prob: str = "prob") -> DataFrame:
    """In descending order keep a row while the probability mass before
    it is at most ``p`` (the first row always), then renormalize.  The first
    row has the largest logit, before and after the cut: one sort, and both
    softmaxes share their exponentials."""
    w = Window.partitionBy(g).orderBy(F.col(logit).desc(), F.col(token))
    upto, ahead = (w.rowsBetween(Window.unboundedPreceding, e) for e in (Window.currentRow, -1))
    s = cand.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(upto)))
    s = s.withColumn("_p", F.col("_e") / F.sum("_e").over(_grp(g)))
    kept = s.withColumn("_before", F.coalesce(F.sum("_p").over(ahead), F.lit(0.0))).where(
        F.col("_before") <= p).drop("_p", "_before")
    return kept.withColumn(prob, F.col("_e") / F.sum("_e").over(_grp(g))).drop("_e")


def top_n_view(cand: DataFrame, n: int = 5, g: str = "g", prob: str = "prob",
               token: str = "token") -> DataFrame:
    """The ``n`` most probable candidates of each group with rank."""
    w = Window.partitionBy(g).orderBy(F.col(prob).desc(), F.col(token))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def draw(cand: DataFrame, seed: int, g: str = "g", prob: str = "prob", token: str = "token") -> DataFrame:
    """One seeded draw per group by inverse CDF: ``u`` from
    ``md5(seed:g)``; the first candidate (probability desc, token) whose
    cumulative probability reaches ``u``; the last one if rounding leaves
    the total just below ``u``."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(g))), 1, 13), 16, 10).cast(
        "double") / float(1 << 52)
    w = Window.partitionBy(g).orderBy(F.col(prob).desc(), F.col(token))
    c = cand.withColumn("_cum", F.sum(prob).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("_u", u).withColumn("_rn", F.row_number().over(w))
    c = c.withColumn("_last", F.max("_rn").over(_grp(g)))
    hit = c.where((F.col("_cum") >= F.col("_u")) | (F.col("_rn") == F.col("_last")))
    first = hit.groupBy(g).agg(F.min(F.struct("_rn", token)).alias("_f"))
    return first.select(g, F.col(f"_f.{token}").alias(token))


def apply_preset(cand: DataFrame, history: DataFrame, temperature_: float, penalty: float,
                 k: int, p: float) -> DataFrame:
    """W7 -> temperature -> W9 -> W10 -> W8, as one decoding step."""
    c = penalize(cand, history, penalty)
    c = temperature(c, temperature_)
    c = top_k(c, k)
    return nucleus(c, p)


def apply_presets(cand: DataFrame, history: DataFrame, presets: dict | None = None) -> DataFrame:
    """Every preset applied, tagged; a union of one plan per preset
    (three fixed plans), not a cross join of candidates and presets."""
    presets = presets or PRESETS
    cand = cut_table(cand)      # counted once, not once per preset
    out = None
    for name, (t, pen, k, p) in presets.items():
        d = apply_preset(cand, history, t, pen, k, p).withColumn("preset", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out

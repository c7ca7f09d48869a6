"""Quality rules with robust multivariate outliers.

Per document four statistics are taken from the whole text (mean word length,
symbols per word, share of repeated lines, share of words in repeated windows)
and transformed (logarithm, square roots).  For every (language, source) a
minimum-covariance-determinant estimate of centre and scatter is made by
concentration steps: start at medians and quartile ranges, keep the half of
the rows nearest by Mahalanobis distance, re-estimate, repeat; then one
reweighting step.  A document whose squared distance exceeds the chi-square
cutoff is rejected.  Groups below ``MIN_GROUP`` documents use the estimate of
their language, and languages below it the one of all documents.

Statistics are per-row array expressions (no shuffle); the estimates are
aggregates with map-side partial sums, so a hot source costs one row per task.
A variance floor per dimension keeps groups of equal documents regular.

Defined results: a null text has no words; null language or source form a
group of their own; documents that fail the base rules are neither learnt from
nor kept; an empty table gives an empty result; repeated rows count and are
judged row by row; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import WHITE, cut, let

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_GROUP = 100
KEPT_SHARE = 0.5
STEPS = 3
REWEIGHT = 0.975
#: Probability with which a regular document stays.
STAYS = 0.99999
DIMS = ("word_len", "symbols", "dup_lines", "repeats")
#: Least standard deviation per dimension, in transformed units.  Each lets its
#: dimension alone pass the cutoff (5.34 floors from the centre), so shares need
#: less than 1 / 5.34 (``dup_lines``) and sqrt(0.5) / 5.34 (``repeats``, half of the
#: words by the base rules).  One repeated line in a text of two is the coarsest
#: step of ``dup_lines``: 0.135 is the least floor (rounded up) that leaves it.
FLOOR = (0.05, 0.06, 0.135, 0.12)
#: Estimates are broadcast up to this many groups, else joined by shuffle.
BROADCAST_GROUPS = 20_000


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function for an even number of degrees."""
    h = x / 2
    return 1 - math.exp(-h) * sum(h ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency(share: float, k: int) -> float:
    """Makes the scatter of the nearest ``share`` of normal rows unbiased."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array."""
    def spread(starts):  # union of [s, s + 2] over sorted window starts
        gaps = F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts) - 1),
                          lambda a, b: F.least(b - a, F.lit(3)))
        return F.aggregate(gaps, F.lit(3), lambda s, g: s + g)

    def repeated(found):  # sorted (window, start): neighbours with the same window
        n = F.size(found)
        pairs = F.zip_with(F.slice(found, 1, n - 1), F.slice(found, 2, n - 1),
                           lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
        return let(F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))), spread)

    def counted(windows):
        hit = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(hit, repeated))

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), counted))).cast("long")


def marked(name: str) -> Column:
    """A group key: null is a value of its own."""
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"),
                       F.col(f"`{source_col}`").alias("source"), text.alias("text"))
    worded = F.filter(F.split("text", "\n", -1), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split("text", WHITE, -1), lambda w: w != "")
    base = base.select(
        "id", "lang", "source",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("w"),
        F.length(F.regexp_replace("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(worded, lambda l: F.struct(F.size(l).cast("long").alias("n"),
                                       (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("d"))).alias("l"))
    n, r = F.col("w.n"), F.col("w.r")
    out = base.select("id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"),
                      r.alias("n_repeat_words"), F.col("l.n").alias("n_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    vector = (F.log(F.col("word_chars") / F.col("n_words")), F.sqrt(F.col("n_symbols") / F.col("n_words")),
              F.sqrt(F.col("n_dup_lines") / F.col("n_lines")), F.sqrt(F.col("n_repeat_words") / F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumns(
        {f"x{i}": F.when(~F.col("base_failed"), x) for i, x in enumerate(vector)}).withColumns(
        {"lang": marked("lang"), "source": marked("source")}).drop("n_lines")


P = range(len(DIMS))
KEY = ["level", "lang", "source"]
CENTRE = [f"m{i}" for i in P]
WHITEN = [f"w{i}{j}" for i in P for j in range(i + 1)]


def whitened(state: DataFrame) -> DataFrame:
    """Scatter entries ``s{i}{j}`` (i >= j) replaced by the inverse of their
    Cholesky factor, with the variance floor added first."""
    for i in P:
        for j in range(i + 1):
            left = F.col(f"s{i}{j}") + (F.lit(FLOOR[i] ** 2) if i == j else 0)
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            state = state.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l{j}{j}"))
    for i in P:
        for j in range(i, -1, -1):
            if i == j:
                w = 1 / F.col(f"l{i}{i}")
            else:
                w = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j + 1, i)),
                        F.col(f"l{i}{j}") * F.col(f"w{j}{j}"))
                w = -w / F.col(f"l{i}{i}")
            state = state.withColumn(f"w{i}{j}", w)
    return state.select(*KEY, "n", *CENTRE, *WHITEN)


def distance() -> Column:
    """Squared Mahalanobis distance of ``x`` from centre and whitening columns."""
    total = F.lit(0.0)
    for i in P:
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        total = total + z * z
    return total


def moments(near: DataFrame, factor: float) -> DataFrame:
    """Centre and scatter of rows that carry their group's last centre."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in P]
    sums = near.groupBy(*KEY).agg(
        F.max("n").alias("n"), F.count("*").alias("c"), *(F.max(m).alias(f"old_{m}") for m in CENTRE),
        *(F.sum(d[i]).alias(f"d{i}") for i in P), *(F.sum(d[i] * d[j]).alias(f"q{i}{j}") for i in P for j in range(i + 1)))
    c = F.col("c")
    return sums.select(*KEY, "n", *((F.col(f"old_m{i}") + F.col(f"d{i}") / c).alias(f"m{i}") for i in P), *(
        (factor * (F.col(f"q{i}{j}") / c - F.col(f"d{i}") * F.col(f"d{j}") / (c * c))).alias(f"s{i}{j}")
        for i in P for j in range(i + 1)))


def estimates(stats: DataFrame) -> DataFrame:
    """Reweighted MCD estimates: a row per (language, source), per language
    and for all, groups with too few documents left out."""
    levels = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), "lang", "source"),
        F.struct(F.lit(1).alias("level"), "lang", F.lit("").alias("source")),
        F.struct(F.lit(2).alias("level"), F.lit("").alias("lang"), F.lit("").alias("source"))))
    xs = [f"x{i}" for i in P]
    rows = stats.where(~F.col("base_failed")).select(levels.alias("g"), *xs).select("g.*", *xs)
    start = rows.groupBy(*KEY).agg(F.count("*").alias("n"), *(
        F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(f"p{i}") for i, x in enumerate(xs)))
    start = start.where((F.col("n") >= MIN_GROUP) | (F.col("level") == 2)).select(
        *KEY, "n", *(F.col(f"p{i}")[1].alias(f"m{i}") for i in P), *(
            (F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"s{i}{j}")
            for i in P for j in range(i + 1)))
    state = cut(whitened(start))
    small = state.count() <= BROADCAST_GROUPS
    hint = F.broadcast if small else (lambda d: d)
    for _ in range(STEPS):
        near = rows.join(hint(state), KEY).withColumn("d2", distance())
        half = near.groupBy(*KEY).agg(F.percentile_approx("d2", KEPT_SHARE, 2000).alias("limit"))
        near = near.join(hint(half), KEY).where(F.col("d2") <= F.col("limit"))
        state = cut(whitened(moments(near, consistency(KEPT_SHARE, len(DIMS)))))
    near = rows.join(hint(state), KEY).where(distance() <= chi2_quantile(REWEIGHT, len(DIMS)))
    return cut(whitened(moments(near, consistency(REWEIGHT, len(DIMS)))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """Per row: id, the counts, ``base_failed``, ``kept`` and ``distance``
    (null where the base rules fail)."""
    stats = cut(statistics(docs, id_col, text_col, lang_col, source_col))
    est = estimates(stats)
    own = [*CENTRE, *WHITEN]
    groups = stats.select("lang", "source").distinct()

    def level(k: int, on: list[str]) -> DataFrame:
        return est.where(F.col("level") == k).select(*on, F.struct(*own).alias(f"e{k}"))
    every = level(2, []).withColumn("one", F.lit(1))  # a single row
    chosen = groups.join(level(0, ["lang", "source"]), ["lang", "source"], "left").join(
        level(1, ["lang"]), ["lang"], "left").withColumn("one", F.lit(1)).join(F.broadcast(every), "one", "left").select(
        "lang", "source", F.coalesce("e0", "e1", "e2").alias("e")).select("lang", "source", "e.*")
    chosen = cut(chosen)
    if chosen.count() <= BROADCAST_GROUPS:
        chosen = F.broadcast(chosen)
    d2 = F.when(~F.col("base_failed"), distance())
    limit = chi2_quantile(STAYS, len(DIMS))
    return stats.join(chosen, ["lang", "source"], "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(d2 <= limit, F.lit(True))).alias("kept"), d2.alias("distance"))

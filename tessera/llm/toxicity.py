"""Toxicity: character n-gram linear classifier with naive Bayes scaling.

A text's features are its distinct character n-grams (4 to 6 characters of the
lower-cased text, white space made single), hashed into ``2**BITS`` buckets.
Each feature is scaled by its naive Bayes log-count ratio between toxic and
other texts, then a logistic regression is fitted on the scaled features.

The classifier is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``
of either label, chosen by a hash of the id, so it is the same sample at every
partitioning); the fit runs in one task over that bounded sample and returns
``2**BITS`` weights.  Scoring is a narrow pass over whole texts.

Defined results: null and empty texts are scored like a text without any
n-gram (the intercept); a null id is no labelled row and is in no held-out
fold; rows with a null label are not learnt from; a doc with several label
rows counts as toxic if one of them says so; without labels of both kinds
every score is 0 with no toxic label and 1 with only such; repeated rows are
scored alike; further columns are ignored or passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
GRAMS = (4, 5, 6)
#: Bound of the training sample: at most so many rows of each label.
TRAIN_ROWS = 4000
ALPHA = 1.0
L2 = 1e-2
STEPS = 60
#: Texts whose features are worked on at a time, so that the fit needs little memory.
CHUNK = 250
#: Features whose log-count ratio is nearer to zero say little and stay out.
LEAST_RATIO = 0.5
_SPACE = re.compile(r"\s+")
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


def grams(text: str) -> np.ndarray:
    """Hash buckets of the n-grams of a text, repeats included."""
    text = " " + _SPACE.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out, h = [], None
    for n in range(1, max(GRAMS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = c * _MUL[0] if h is None else (h[:m] ^ (h[:m] >> np.uint32(15))) * _MUL[1] + c[n - 1:] * _MUL[n - 1]
        if n in GRAMS:
            out.append(((h ^ (h >> np.uint32(13))) * _MUL[2]) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def chunks(texts) -> Iterator[list[str]]:
    """The texts (a list or an Arrow column) ``CHUNK`` at a time."""
    for at in range(0, len(texts), CHUNK):
        part = texts[at:at + CHUNK]
        yield part.to_pylist() if isinstance(part, pa.ChunkedArray) else part


def fit(texts, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (with the naive Bayes scale folded in) and intercept.  The texts
    are read twice: all their features are counted, then only telling ones kept."""
    size = 1 << BITS
    if y.all() or not y.any():  # one label only, or no row
        return np.zeros(size, np.float32), 50.0 if y.any() else -50.0
    pos, neg = np.full(size, ALPHA), np.full(size, ALPHA)
    for k, t in enumerate(t for part in chunks(texts) for t in part):
        (pos if y[k] else neg)[np.unique(grams(t))] += 1
    # document shares, so that long texts of one label don't move every ratio
    r = np.log(pos / (y.sum() + 2 * ALPHA)) - np.log(neg / ((1 - y).sum() + 2 * ALPHA))
    r[np.abs(r) < LEAST_RATIO] = 0
    parts = []  # per chunk of texts: telling features, where each text's begin
    for part in chunks(texts):
        rows = [k[r[k] != 0] for k in map(np.unique, map(grams, part))]
        parts.append((np.concatenate(rows), np.cumsum([0, *map(len, rows)])))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both labels weigh alike
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, STEPS + 1):
        wr, g, gb = w * r, np.zeros(size), 0.0
        for k, (col, ends) in enumerate(parts):
            mine = slice(k * CHUNK, k * CHUNK + len(ends) - 1)
            total = np.concatenate([[0.0], np.cumsum(wr[col])])
            z = np.clip(np.diff(total[ends]) + b, -50, 50)
            e = share[mine] * (1 / (1 + np.exp(-z)) - y[mine])
            g += np.bincount(col, weights=np.repeat(e, np.diff(ends)), minlength=size)
            gb += e.sum()
        g = g * r + L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (1 + t / 40)
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-8)
    return (w * r).astype(np.float32), float(b)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.w, self.b, self.tmp = weights, bias, np.zeros(1 << BITS, np.float32)

    def __call__(self, text: str | None) -> float:
        k = grams(text or "")
        self.tmp[k] = self.w[k]  # distinct features: repeats write the same value
        z = self.b + float(self.tmp.sum(dtype=np.float64) if len(k) > 1 << 14 else self.w[np.unique(k)].sum(dtype=np.float64))
        self.tmp[k] = 0
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def held_out(id_col: str):
    """The fixed fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most ``rows`` labelled documents of each label outside the held-out fold."""
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(
        F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    pick = [lab.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    sample = F.broadcast(pick[0].unionByName(pick[1]))  # at most 2 * rows rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = texts.join(sample, "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def one_fit(batches):
        got = list(batches)
        rows = pa.Table.from_batches(got).sort_by("id") if got else None
        w, b = fit(rows["text"], rows["y"].to_numpy().astype(int)) if got else fit([], np.zeros(0, int))
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes()], pa.binary()), "b": [b]})

    got = told.repartition(1).mapInArrow(one_fit, "w binary, b double").collect()  # 2**BITS weights
    if not got:  # no labelled document at all
        return fit([], np.zeros(0, int))
    return np.frombuffer(got[0]["w"], np.float32), got[0]["b"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text",
          out_col: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1 in ``out_col`` (replaced if there)."""
    share = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    @F.pandas_udf("double")
    def scored(texts):
        one = Scorer(*share.value)
        return texts.map(one, na_action=None)

    return docs.withColumn(out_col, scored(F.col(text_col)))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below ``threshold``, with their columns."""
    col = "_toxicity"
    while col in docs.columns:
        col += "_"
    return score(docs, train(docs, labels), out_col=col).where(F.col(col) < threshold).drop(col)

"""Chunkers for long texts (T3-T6), each a per-row array expression.

Documents are independent, so each chunker runs inside one task per row with
no shuffle; the only sequential parts (greedy accumulation, chained cut
points) are ``aggregate`` folds over a document's own sentences or chunk
slots, never over the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# A trailing run of text up to and including the last . ! or ?
_LAST_END = r"^([\s\S]*)[.!?]"


def _last_sentence_end(s: Column) -> Column:
    """0-based index of the last ``.``/``!``/``?`` in ``s``, -1 if none
    (``max(s.rfind('.'), s.rfind('!'), s.rfind('?'))``)."""
    return F.when(s.rlike("[.!?]"), F.length(F.regexp_extract(s, _LAST_END, 1))).otherwise(F.lit(-1))


def sentences(df: DataFrame, text: str = "text", min_chars: int = 0, out: str = "part") -> DataFrame:
    """T5: texts split after ``.!?`` + whitespace, each part stripped; parts
    of at most ``min_chars`` characters are dropped (by default only empty
    ones).  One row per part with ``part_no``."""
    parts = F.filter(F.transform(T.sentences(F.col(text)), T.strip), lambda s: F.length(s) > min_chars)
    return df.select("*", F.posexplode(parts).alias("part_no", out))


def _slots(text: Column, size: int) -> Column:
    """The text in consecutive pieces of ``size`` characters, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


def chunk_overlap(df: DataFrame, text: str = "text", size: int = 10_000, lookback: int = 200,
                  out: str = "chunk") -> DataFrame:
    """Fixed ``size`` slots; an interior slot reaches back at most
    ``lookback`` characters (of the slot before it) to just after the last
    sentence end (that span is duplicated, as in the original rule).  ``eos``
    is true for every chunk but the last of its text.  An empty text has none."""
    if not 0 < lookback <= size:
        raise ValueError("lookback must be positive and at most size")
    # columns of their own: slots are cut once per text, chunks are made of two slots
    cut = df.withColumn("_t", _slots(F.col(text), size)).withColumn("_k", F.size("_t"))

    def chunk(slot: Column, k: Column) -> Column:
        back = F.substring(F.get(F.col("_t"), k - 1), -lookback, lookback)
        last = _last_sentence_end(back)
        reach = F.when((k > 0) & (last > 0), F.substring(back, last + 2, lookback)).otherwise(F.lit(""))
        # only a slot that is full and has text behind it is an interior one
        return F.concat(F.when(k + 1 < F.col("_k"), reach).otherwise(F.lit("")), slot)
    ex = cut.select(*df.columns, "_k", F.posexplode(F.transform("_t", chunk)).alias("chunk_no", out))
    return ex.withColumn("eos", F.col("chunk_no") + 1 < F.col("_k")).drop("_k")


def chunk_fixed(df: DataFrame, text: str = "text", size: int = 50_000, window: int = 1000,
                out: str = "chunk") -> DataFrame:
    """T4: texts are cut into ``size`` pieces, each but the last trimmed back
    to its last sentence end within its final ``window`` characters, then
    stripped.  An empty text has no chunk.

    The next piece starts where the previous one was cut (a fold over the
    slots of one text), so only the white space stripped off is lost.
    """
    cut = df.withColumn("_t", _slots(F.col(text), size)).withColumn("_n", F.length(F.col(text)))
    n = F.col("_n")

    def part(pos: Column, length: Column) -> Column:
        """Up to ``size`` characters from ``pos``: they lie in two slots."""
        k = F.floor(pos / size).cast("int")
        two = F.concat(F.get(F.col("_t"), k), F.coalesce(F.get(F.col("_t"), k + 1), F.lit("")))
        return F.substring(two, pos - k * size + 1, length)

    def step(acc, _):
        pos = acc["pos"]
        # a piece that isn't the last is full: its window starts at a fixed place
        last = _last_sentence_end(part(pos + max(size - window, 0), F.lit(min(window, size))))
        end = F.when(pos + size >= n, n).when(last > 0, pos + max(size - window, 0) + last + 1).otherwise(pos + size)
        return F.when(pos < n, F.struct(F.concat(acc["starts"], F.array(pos)).alias("starts"), end.alias("pos"))).otherwise(acc)
    init = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("pos"))
    # chained cut points; every chunk advances by more than size - window
    turns = F.sequence(F.lit(0), F.floor(n / F.lit(max(size - window, 1))).cast("int"))
    cut = cut.withColumn("_b", F.aggregate(turns, init, step)["starts"])
    chunks = F.transform("_b", lambda b, k: T.strip(part(b, F.coalesce(F.get(F.col("_b"), k + 1), n) - b)))
    return cut.select(*df.columns, F.posexplode(chunks).alias("chunk_no", out))


def chunk_sentences(df: DataFrame, text: str = "text", limit: int = 50_000, out: str = "chunk") -> DataFrame:
    """Texts are cut into sentences and greedily packed: a sentence joins
    the current chunk with one space unless that would pass ``limit``
    characters, then the chunk is closed.  Chunks are stripped; empty ones are dropped."""
    cut = df.withColumn("_s", T.sentences(F.col(text)))
    lens = F.transform("_s", lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i")))

    def step(acc, x):
        close = (acc["cur"] + x["n"] > limit) & (acc["cur"] > 0)
        starts = F.when(close, F.concat(acc["starts"], F.array(x["i"]))).otherwise(acc["starts"])
        cur = F.when(close | (acc["cur"] == 0), x["n"]).otherwise(acc["cur"] + 1 + x["n"])
        return F.struct(starts.alias("starts"), cur.alias("cur"))
    init = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("cur"))
    # a column of its own: computed once per text, read once per chunk
    cut = cut.withColumn("_b", F.aggregate(lens, init, step)["starts"])
    chunks = F.transform("_b", lambda b, k: T.strip(F.array_join(F.slice(
        F.col("_s"), b + 1, F.coalesce(F.get(F.col("_b"), k + 1), F.size("_s")) - b), " ")))
    parts = F.filter(chunks, lambda c: c != "")
    return cut.select(*df.columns, F.posexplode(parts).alias("chunk_no", out))

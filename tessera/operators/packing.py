"""Stream offsets, train/validation split, fixed windows, fine-tune batches
(T8-T12, L7).

The token stream is never materialized as one list: every document keeps its
pieces (or ids) plus ``offset`` (position of its first id in the stream, a prefix
sum of piece counts, known before any id is).  ``fragments`` cuts documents at
window borders with a halo of one; ``tokens.encode_fragments`` turns them into ids
in one shuffle keyed by window.  Each window group holds at most ``length + 1``
ids, whatever the skew of documents or sources.  ``pack_windows`` and ``blocks``
do the same for documents that are encoded already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import prefix_sum


def with_offsets(encoded: DataFrame, order: list[str], ids: str = "ids",
                 out: str = "offset") -> DataFrame:
    """``offset`` = number of ids before the row in ``order``."""
    return prefix_sum(encoded.withColumn("_n", F.size(F.col(ids)).cast("bigint")), order, "_n", out).drop("_n")


def stream_total(with_off: DataFrame, ids: str = "ids") -> int:
    return with_off.agg(F.coalesce(F.sum(F.size(F.col(ids))), F.lit(0))).first()[0]


def split_stream(with_off: DataFrame, frac: float, total: int, ids: str = "ids",
                 offset: str = "offset") -> DataFrame:
    """The first ``floor(total * frac)`` ids are ``train``, the rest
    ``val``; a document that straddles the cut is cut too.  Output rows are
    document parts with ``split``, ``start`` (position inside the split's
    stream) and their ``ids``."""
    cut = int(total * frac)
    n = F.size(F.col(ids))
    o = F.col(offset)
    train_len = F.least(F.greatest(F.lit(cut) - o, F.lit(0)), n)
    parts = F.array(
        F.struct(F.lit("train").alias("split"), o.alias("start"),
                 F.slice(F.col(ids), 1, train_len).alias("ids")),
        F.struct(F.lit("val").alias("split"), F.greatest(o - cut, F.lit(0)).alias("start"),
                 F.slice(F.col(ids), (train_len + 1).cast("int"), (n - train_len).cast("int")).alias("ids")))
    keep = [c for c in with_off.columns if c not in (ids, offset)]
    ex = with_off.select(*keep, F.explode(parts).alias("_p"))
    ex = ex.select(*keep, "_p.split", F.col("_p.start").cast("bigint").alias("start"), F.col("_p.ids").alias(ids))
    return ex.where(F.size(F.col(ids)) > 0)


def _frag(ids: Column, s: Column, lo: Column, hi: Column) -> Column:
    """ids at stream positions [lo, hi) of a part that starts at s."""
    a = F.greatest(lo, s)
    b = F.least(hi, s + F.size(ids))
    return F.slice(ids, F.greatest(a - s + 1, F.lit(1)).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))


def pack_windows(parts: DataFrame, length: int, totals: dict[str, int], ids: str = "ids",
                 start: str = "start", group: str = "split") -> DataFrame:
    """Windows ``seq`` of ``length`` inputs and the same ids shifted by
    one as targets; ``(M - 1) div length`` windows for a stream of ``M`` ids
    (the tail is dropped).  ``totals`` maps each ``group`` value to ``M``."""
    L = length
    s = F.col(start)
    m = F.size(F.col(ids))
    first = F.greatest(F.floor((s - 1) / L), F.lit(0)).cast("bigint")
    last = F.floor((s + m - 1) / L).cast("bigint")
    ex = parts.select(F.col(group), s.alias("_s"), F.col(ids).alias("_ids"),
                      F.explode(F.sequence(first, last)).alias("seq"))
    lo = F.col("seq") * L
    inp = _frag(F.col("_ids"), F.col("_s"), lo, lo + L)
    tgt = _frag(F.col("_ids"), F.col("_s"), lo + 1, lo + L + 1)
    limit = F.lit(None).cast("bigint")
    for g, total in totals.items():
        limit = F.when(F.col(group) == g, F.lit(max((total - 1) // L, 0))).otherwise(limit)
    ex = ex.where(F.col("seq") < limit).select(group, "seq", "_s", inp.alias("_in"), tgt.alias("_tg"))
    g = ex.groupBy(group, "seq").agg(F.array_sort(F.collect_list(F.struct("_s", "_in", "_tg"))).alias("_f"))
    return g.select(group, "seq",
                    F.flatten(F.transform("_f", lambda x: x["_in"])).alias("inputs"),
                    F.flatten(F.transform("_f", lambda x: x["_tg"])).alias("targets"))


def fragments(parts: DataFrame, size: int, halo: int = 0, pcs: str = "pcs", start: str = "start",
              group: str = "split") -> DataFrame:
    """``group, seq, slot, pcs``: every part cut at the multiples of ``size``;
    with ``halo`` each run also takes that many pieces of the next one, so no
    later step has to look at its neighbour.  ``slot`` is the place in the run."""
    s, n = F.col(start), F.size(pcs)
    first = F.greatest(F.floor((s - halo) / size), F.lit(0)).cast("bigint")
    last = F.floor((s + n - 1) / size).cast("bigint")
    ex = parts.where(n > 0).select(group, s.alias("_s"), F.col(pcs).alias("_pcs"), F.explode(F.sequence(first, last)).alias("seq"))
    lo = F.col("seq") * size
    inside = F.least(lo + size + halo, F.col("_s") + F.size("_pcs")) > F.greatest(lo, F.col("_s"))
    return ex.where(inside).select(group, "seq", (F.greatest(lo, F.col("_s")) - lo).alias("slot"),
                                   _frag(F.col("_pcs"), F.col("_s"), lo, lo + size + halo).alias(pcs))


def shifted(runs: DataFrame, length: int, ids: str = "ids", tail: bool = False) -> DataFrame:
    """T10 from runs of ``length + 1`` ids: ``inputs`` and the same ids shifted by
    one as ``targets``.  With ``tail`` the rest of each stream comes too, as a
    shorter window (its last id has no target and a single id makes none)."""
    n = F.size(ids)
    kept = runs.where(n > 1 if tail else n == length + 1)
    inputs, targets = shift_pair(ids)
    return kept.withColumn("inputs", inputs).withColumn("targets", targets).drop(ids)


def checksum(ids: Column) -> Column:
    """Position-weighted sum of an id array (order-sensitive)."""
    return F.aggregate(F.transform(ids, lambda x, i: (i + 1).cast("bigint") * x.cast("bigint")),
                       F.lit(0).cast("bigint"), lambda a, b: a + b)


# --- fine-tuning samples ----------------------------------------------------
def truncate(ids, n: int = 512) -> Column:
    """T8."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(c, 1, n)


def shift_pair(ids) -> tuple[Column, Column]:
    """(inputs, targets) = (all but the last id, all but the first)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    n = F.size(c)
    return F.slice(c, 1, n - 1), F.slice(c, 2, n - 1)


def pad_batches(df: DataFrame, batch="batch_id", inputs: str = "inputs",
                targets: str = "targets", pad: int = 0) -> DataFrame:
    """Pad inputs and targets with ``pad`` to the longest input of the
    batch; ``len`` keeps the real length, so a real id equal to the pad value
    is never mistaken for padding.  The window is per batch (bounded rows)."""
    keys = [batch] if isinstance(batch, str) else list(batch)
    m = F.max(F.size(F.col(inputs))).over(Window.partitionBy(*keys))
    fill = F.array_repeat(F.lit(pad), (F.col("_max") - F.col("len")).cast("int"))
    return (df.withColumn("_max", m).withColumn("len", F.size(F.col(inputs)))
              .withColumn(inputs, F.concat(F.col(inputs), fill))
              .withColumn(targets, F.concat(F.col(targets), fill)).drop("_max"))


def blocks(parts: DataFrame, size: int, totals: dict[str, int], ids: str = "ids",
           start: str = "start", group: str = "split") -> DataFrame:
    """Complete blocks of ``size`` consecutive ids per ``group`` stream
    (``(block + 1) * size <= M``), assembled from fragments like windows."""
    s = F.col(start)
    m = F.size(F.col(ids))
    ex = parts.select(F.col(group), s.alias("_s"), F.col(ids).alias("_ids"),
                      F.explode(F.sequence(F.floor(s / size).cast("bigint"),
                                           F.floor((s + m - 1) / size).cast("bigint"))).alias("block"))
    limit = F.lit(None).cast("bigint")
    for g, total in totals.items():
        limit = F.when(F.col(group) == g, F.lit(total // size)).otherwise(limit)
    lo = F.col("block") * size
    ex = ex.where(F.col("block") < limit).select(group, "block", "_s",
                                                 _frag(F.col("_ids"), F.col("_s"), lo, lo + size).alias("_f"))
    g = ex.groupBy(group, "block").agg(F.array_sort(F.collect_list(F.struct("_s", "_f"))).alias("_fs"))
    return g.select(group, "block", F.flatten(F.transform("_fs", lambda x: x["_f"])).alias(ids))

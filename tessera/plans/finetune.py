"""The fine-tuning data path: pairs -> validated -> rendered -> encoded ->
truncated -> split 90/10 -> shuffled per epoch -> batches -> shifted and
padded.  Every step is distributed; the only globally ordered steps use the
two-level index (no single-task window)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import packing as P
from tessera.operators import render as RD
from tessera.operators import sampling as SM
from tessera.operators.ordering import global_index
from tessera.operators.tokens import build_vocab, encode
from tessera.session import cut_table
from tessera.sources import tables as S

VAL_SPLIT = 0.9      # fixed value: share of samples used for training
BATCH = 8            # fixed value: fine-tune batch size
SEED = 42


def samples(pairs: DataFrame, max_len: int | None = None, min_ids: int = 1) -> DataFrame:
    """``id, ids`` per usable pair (V2, V4, R4, T1/T2, V8): whole samples of
    more than ``min_ids`` ids (one id has no target); ``max_len`` keeps only
    the first so many ids of each (T8)."""
    r = RD.render_finetune(pairs)
    vocab = build_vocab(r, "text")
    enc = encode(r, vocab, "id", "text")
    if max_len is not None:
        enc = enc.withColumn("ids", P.truncate("ids", max_len))
    return enc.where(F.size("ids") > min_ids)


def batches(spark: SparkSession, sf_dir: str, epoch: int = 1) -> DataFrame:
    """``split, batch_id, id, idx, inputs, targets, len`` (padded)."""
    sm = SM.split_rows(cut_table(samples(S.pair_rows(spark, sf_dir))), VAL_SPLIT, "id", SEED)
    n_train = sm.where(F.col("split") == "train").count()
    h = SM.seeded_hash("id", SEED, epoch)
    idx = global_index(sm.withColumn("_h", h), ["split", "_h", "id"], out="_g")
    idx = idx.withColumn("idx", F.when(F.col("split") == "train", F.col("_g")).otherwise(F.col("_g") - n_train))
    b = SM.with_batches(idx, BATCH, "idx", "batch_id").drop("_h", "_g")
    inputs, targets = P.shift_pair("ids")
    b = b.withColumn("inputs", inputs).withColumn("targets", targets)
    return P.pad_batches(b, ["split", "batch_id"])

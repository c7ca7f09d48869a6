"""Seeded exact sampling, caps, dedup, exact splits, epoch shuffles, batches
(L1, L2, L5, L8-L10).

Nothing here uses ``rand()``, ``sample`` or ``randomSplit``: every random
choice is a function of ``md5(seed:key)``, so reruns, recomputed partitions
and a DuckDB oracle all agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import global_index
from tessera.session import cut_lineage, cut_table

TOP_K_DIRECT = 10_000       # candidates up to this many are cut with a plain top-k
HASH_SPACE = float(1 << 60)


def seeded_hash(key, seed, *extra) -> Column:
    """``md5('<seed>[:<extra>...]:<key>')`` as hex text."""
    parts = [F.lit(str(seed))] + [F.lit(str(e)) for e in extra] + [F.col(key).cast("string")]
    return F.md5(F.concat_ws(":", *parts))


def _hash60(h: Column) -> Column:
    """First 15 hex digits of the md5 as a non-negative bigint (uniform)."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def _cut(cand: DataFrame, n: int, order: list[str], top_k_direct: int) -> DataFrame:
    """Exactly the ``n`` first candidates in ``order``: a top-k when the
    candidate set is small, a distributed rank otherwise."""
    if cand.count() <= top_k_direct:
        return cand.orderBy(*order).limit(n)
    ranked = global_index(cand, order, out="_r")
    return ranked.where(F.col("_r") <= n).drop("_r")


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42,
                 top_k_direct: int = TOP_K_DIRECT) -> DataFrame:
    """L1: exactly ``min(n, N)`` rows, the ones with the smallest
    ``(md5(seed:key), key)``; without replacement, reproducible.

    A plain ``orderBy().limit(n)`` would send the top ``n`` of *every*
    partition to one task (partitions x n rows).  Instead the hash is uniform,
    so a filter below the ``(n + margin) / N`` quantile keeps about ``n``
    candidates in one pass; a count verifies there are at least ``n`` (the
    margin is widened otherwise, so the result stays exact), and the exact
    cut runs on the candidates only.
    """
    keyed = df.withColumn("_h", seeded_hash(key, seed))
    total = df.count()
    if n >= total:
        return df
    margin = 6.0 * math.sqrt(n) + 1000
    while True:
        frac = min(1.0, (n + margin) / total)
        cand = cut_lineage(keyed.where(_hash60(F.col("_h")) <= F.lit(int(frac * HASH_SPACE))))
        if frac >= 1.0 or cand.count() >= n:
            break
        margin *= 4
    return _cut(cand, n, ["_h", key], top_k_direct).drop("_h")


def first_n(df: DataFrame, n: int, order: list[str] | str) -> DataFrame:
    """L2: the first ``n`` rows in ``order``, nulls first; columns of any
    sortable type.  A tree of two levels: every partition keeps its own first ``n``
    (Spark's group limit, before any shuffle), groups of about sqrt(partitions)
    partitions keep theirs, and those meet.  Only candidates are shuffled, no
    task receives partitions x n rows, and the rule is the same at every size."""
    order = [order] if isinstance(order, str) else list(order)
    groups = math.isqrt(max(df.rdd.getNumPartitions() - 1, 0)) + 1
    w = Window.partitionBy("_b").orderBy(*order)
    near = df.withColumn("_b", F.pmod(F.spark_partition_id(), F.lit(groups))).withColumn("_r", F.row_number().over(w))
    return near.where(F.col("_r") <= n).drop("_b", "_r").orderBy(*order).limit(n)


def nth_hash(hashes: DataFrame, n: int) -> tuple[str, int]:
    """The shortest found prefix of hex digits up to which (inclusive) there are ``n``
    or more rows of ``_h``, and the number of rows with smaller prefixes of that length.

    Descends through a histogram of 65,536 counts per four digits, so no row is
    sorted or moved; it ends where the ``n``-th row is the last of its prefix."""
    prefix, before = "", 0
    for digits in (4, 8, 12, 32):
        counts = hashes.where(F.col("_h").startswith(prefix)).groupBy(
            F.substring("_h", 1, digits).alias("p")).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
        got = counts.withColumn("upto", upto).where(F.col("upto") >= n - before).orderBy("p").first()
        prefix = got["p"]
        if before + got["upto"] == n:
            return prefix, before + got["upto"] - got["c"]
        before += got["upto"] - got["c"]
    return prefix, before


def split_rows(df: DataFrame, frac: float, key: str, seed: int = 42,
               out: str = "split") -> DataFrame:
    """Exact-size random split: rows ranked by ``md5(seed:key)``; the
    first ``floor(frac * N)`` are ``train``, the rest ``val``.

    Only hashes are stored and counted; the rows themselves are split where they
    are, by comparison with the hash at the boundary.  Rows that share the key at
    the boundary (repeated or null keys) are numbered among themselves, if the
    boundary falls between them.  ``df`` is read twice and must give the same keys."""
    keyed = df.withColumn("_h", seeded_hash(key, seed))
    hashes = cut_table(keyed.select("_h"))
    total = hashes.count()
    cut = int(frac * total)

    def named(train: Column) -> Column:
        return F.when(train, "train").otherwise("val").alias(out)
    if not 0 < cut < total:
        return df.select("*", named(F.lit(cut > 0)))
    prefix, before = nth_hash(hashes, cut)
    place = F.substring("_h", 1, len(prefix))
    if len(prefix) < 32 or hashes.where(place == prefix).count() == cut - before:
        return keyed.select(*df.columns, named(place <= prefix))
    tied = global_index(keyed.where(place == prefix), [key], out="_r")
    return keyed.where(place != prefix).select(*df.columns, named(place < prefix)).unionByName(
        tied.select(*df.columns, named(F.col("_r") <= cut - before)))


def shuffle_epoch(df: DataFrame, key: str, seed: int, epoch: int, out: str = "idx") -> DataFrame:
    """A per-epoch permutation: 1-based position by ``md5(seed:epoch:key)``."""
    h = seeded_hash(key, seed, epoch)
    return global_index(df.withColumn("_h", h), ["_h", key], out=out).drop("_h")


def with_batches(df: DataFrame, size: int, index: str = "idx", out: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``size`` rows over a 1-based index; the
    last batch may be short."""
    return df.withColumn(out, F.floor((F.col(index) - 1) / size).cast("bigint"))

"""Aggregates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_table


def union_sources(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Ordered union-all; ``source_ord`` is the position in ``parts``."""
    out = None
    for i, (name, df) in enumerate(parts):
        tagged = df.withColumn("source", F.lit(name)).withColumn("source_ord", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def mix(df: DataFrame, value: str = "tokens", out: str = "pct", digits: int | None = None) -> DataFrame:
    """A2: share of each row in percent (rounded only when ``digits`` is
    given, for display; null where all are 0).  The window runs over the already aggregated
    per-source rows (a handful), never over documents."""
    total = F.sum(F.col(value)).over(Window.partitionBy(F.lit(0)))
    pct = F.try_divide(F.col(value) * 100.0, total).cast("double")
    return df.withColumn(out, pct if digits is None else F.round(pct, digits))


def source_stats(docs: DataFrame, tokens: str = "tokens", split_col: str | None = None) -> DataFrame:
    """A1: per source documents and tokens (train / validation when a split
    column is given), plus a grand-total row (``source`` null) by rollup."""
    aggs = [F.count(F.lit(1)).alias("documents"), F.sum(tokens).cast("bigint").alias("tokens")]
    if split_col:
        aggs += [F.sum(F.when(F.col(split_col) == "train", F.col(tokens)).otherwise(0)).cast("bigint").alias("train_tokens"),
                 F.sum(F.when(F.col(split_col) == "val", F.col(tokens)).otherwise(0)).cast("bigint").alias("val_tokens")]
    return docs.rollup("source").agg(*aggs)


def batch_progress(results: DataFrame, batch: str = "batch_id", success: str = "success") -> DataFrame:
    """A3: per batch success / failed, running totals and success rate.
    Running totals use the two-level prefix sum over the per-batch rows, so
    even millions of batches never meet in one task."""
    from tessera.operators.ordering import prefix_sum
    per = results.groupBy(batch).agg(
        F.sum(F.when(F.col(success), 1).otherwise(0)).cast("bigint").alias("succeeded"),
        F.sum(F.when(F.col(success), 0).otherwise(1)).cast("bigint").alias("failed"))
    run = prefix_sum(per, [batch], ["succeeded", "failed"], ["_s", "_f"])
    run = (run.withColumn("total_succeeded", F.col("_s") + F.col("succeeded"))
              .withColumn("total_failed", F.col("_f") + F.col("failed")).drop("_s", "_f"))
    return run.withColumn("success_rate",
                          (F.col("total_succeeded") * 100.0 / (F.col("total_succeeded") + F.col("total_failed"))).cast("double"))


def count_parity(a: DataFrame, b: DataFrame, key: str, value: str, tol: float = 0.05) -> DataFrame:
    """Two token counts of the same documents agree within ``tol``; a
    document without a second count has 0 there."""
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "left").fillna(0, ["b"])
    return j.withColumn("within_tol", F.abs(F.col("a") - F.col("b")) < F.lit(tol) * F.col("a"))


def compare_runs(runs: DataFrame, run: str, duration: str, amount: str) -> DataFrame:
    """Each run against the first (speed-up, rate) and the fastest run.
    What all runs are held against is one aggregate row, broadcast."""
    one = F.lit(1).alias("_one")
    base = runs.agg(F.min_by(duration, run).alias("_first"),
                    F.min_by(F.col(run), F.struct(F.col(duration), F.col(run))).alias("fastest")).select(one, "*")
    held = runs.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one")
    return held.select(*runs.columns, (F.col("_first") / F.col(duration)).cast("double").alias("speedup"),
                       (F.col(amount) / F.col(duration)).cast("double").alias("rate"), "fastest")


def catalogue_sizes(values: DataFrame, slot: str = "slot", value: str = "value") -> DataFrame:
    """A10: entries and distinct entries per slot."""
    return values.groupBy(slot).agg(F.count(F.lit(1)).alias("entries"),
                                    F.countDistinct(value).alias("distinct_entries"))


def size_guards(totals: DataFrame, batch_size: int, length: int, split: str = "split",
                tokens: str = "tokens") -> DataFrame:
    """Windows and batches per split, from the ids of every split (one
    row each, splits without a window included), and whether one batch of
    ids exceeds half of the split's ids."""
    n = F.col(tokens)
    per = totals.select(F.col(split), n.cast("bigint").alias("tokens"),
                        F.greatest(F.floor((n - 1) / length), F.lit(0)).cast("bigint").alias("windows"))
    per = per.withColumn("batches", F.ceil(F.col("windows") / F.lit(batch_size)).cast("bigint"))
    per = per.withColumn("no_batches", F.col("batches") == 0)
    return per.withColumn("batch_over_half", F.lit(batch_size * length) > F.col("tokens") / 2)


def block_diagnostics(blocks: DataFrame, eos_id: int, ids: str = "ids") -> DataFrame:
    """A4-A6 per block: immediate repetitions (``b[j] == b[j+1]``) and their
    rate, end-of-text count, distinct ids and their ratio — array
    expressions over each bounded block."""
    b = F.col(ids)
    n = F.size(b)
    pairs = F.arrays_zip(F.slice(b, 1, n - 1).alias("a"), F.slice(b, 2, n - 1).alias("z"))
    reps = F.size(F.filter(pairs, lambda p: p["a"] == p["z"])).cast("bigint")
    uniq = F.size(F.array_distinct(b)).cast("bigint")
    return blocks.select(
        "*", n.cast("bigint").alias("n"), reps.alias("repetitions"),
        (reps / n).alias("repetition_rate"),
        F.size(F.filter(b, lambda x: x == eos_id)).cast("bigint").alias("eos"),
        uniq.alias("unique_ids"), (uniq / n).alias("unique_ratio")).drop(ids)


LG_K = 14                  # 2^14 registers: a relative standard error of 1.04 / 2^7, 0.8 %


def unique_sketches(blocks: DataFrame, keys: list[str], ids: str = "ids", lg_k: int = LG_K) -> DataFrame:
    """A6 at scale: ``*keys, n, sketch``, a mergeable distinct-count sketch of the ids of every block
    (a few KB each).  Blocks roll up without their ids: ``roll_up_unique``."""
    each = blocks.where(F.size(ids) > 0).select(*keys, F.size(ids).cast("long").alias("_n"), F.posexplode(F.array_distinct(ids)).alias("_at", "_id"))
    return each.groupBy(*keys).agg(F.sum(F.when(F.col("_at") == 0, F.col("_n")).otherwise(0)).alias("n"), F.hll_sketch_agg("_id", lg_k).alias("sketch"))


def exact_unique(blocks: DataFrame, keys: list[str], ids: str = "ids", out: str = "exact") -> DataFrame:
    """A6 exactly: ``*keys, out``, the distinct ids per ``keys`` (two of them, the second one a block's, one row
    each), per first key and in total (null keys).  Blocks are counted where they are; only their distinct
    ids go on, each level folding those of the one below: no id is copied per level."""
    group, block = keys
    per = blocks.select(group, block, F.size(F.array_distinct(ids)).cast("long").alias(out))
    pairs = cut_table(blocks.select(group, F.explode(F.array_distinct(ids)).alias("_id")).distinct())
    null = F.lit(None).cast(blocks.schema[block].dataType).alias(block)
    groups = pairs.groupBy(group).agg(F.count("_id").alias(out)).select(group, null, out)
    total = pairs.select("_id").distinct().agg(F.count("_id").alias(out)).select(F.lit(None).cast(blocks.schema[group].dataType).alias(group), null, out)
    return per.unionByName(groups).unionByName(total)


def roll_up_unique(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, n, unique_ids`` (an estimate) per block, per every prefix of ``keys`` and in
    total (null keys), from sketches alone."""
    return sketches.rollup(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_ids"))


def shift_mismatches(windows: DataFrame, group: str = "split") -> DataFrame:
    """Targets must be the inputs moved by one: inside a window
    ``targets[j] == inputs[j+1]``, and the last target equals the first
    input of the next window (an equi-join on ``seq + 1``)."""
    w = windows
    n = F.size("inputs")
    inner = F.size(F.filter(F.arrays_zip(F.slice("targets", 1, n - 1).alias("t"),
                                         F.slice("inputs", 2, n - 1).alias("i")),
                            lambda p: p["t"] != p["i"])).cast("bigint")
    # what the join needs of a window is a few numbers, written once: no ids are joined, none made twice
    w = cut_table(w.select(F.col(group), F.col("seq"), inner.alias("_inner"), F.get("inputs", F.lit(0)).alias("_own"),
                           F.try_element_at("targets", F.lit(-1)).alias("_last")))
    nxt = w.select(F.col(group).alias("_g"), (F.col("seq") - 1).alias("_seq"), F.col("_own").alias("_first"))
    j = w.join(nxt, (F.col(group) == F.col("_g")) & (F.col("seq") == F.col("_seq")), "left")
    edge = F.when(F.col("_first").isNotNull() & (F.col("_last") != F.col("_first")), 1).otherwise(0)
    return j.groupBy(group).agg(F.count(F.lit(1)).alias("windows"),
                                F.sum(F.col("_inner") + edge).cast("bigint").alias("mismatches"))

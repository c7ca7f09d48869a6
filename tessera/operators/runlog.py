"""Training-log analytics (W1-W6) over a metrics table
``run_id, epoch, step, loss, grad_norm``.

Amounts of ordinary size (0, or 1e-9 up to 1e15) are summed as wide decimals (12
places), so results do not depend on summation order — the same on 1 or 1000
partitions, and equal to an SQL engine's.  All others are summed as doubles beside
them: very large and very small amounts count, and a NaN or an infinity
makes the mean NaN or infinite, since that is what a log is read for.  Null amounts are
left out of a mean; a mean of none is null.  A null run is a run of its own.

Skew: a single run may hold a large share of all steps.  The moving average
therefore numbers the steps by a range-partitioned rank and runs its window
inside blocks of consecutive steps, each with the few steps before it, never
inside a whole run.  Epoch-level windows run on the per-epoch aggregate (a
handful of rows per run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import global_index

BLOCK = 8192     # steps per block of the moving average


SMALL, LARGE = 1e-9, 1e15


def _mean(col: str, over=None) -> Column:
    x = F.col(col).cast("double")
    plain = (x == 0) | (F.abs(x) >= SMALL) & (F.abs(x) < LARGE)  # false for NaN, which exceeds all
    sums = [F.sum(F.when(plain, x).try_cast("decimal(28,12)")), F.sum(F.when(~plain, x)), F.count(x)]
    exact, rest, n = [s.over(over) for s in sums] if over is not None else sums
    total = F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))
    return F.when(n > 0, total / n)


def smooth(log: DataFrame, window: int = 50, run: str = "run_id", step: str = "step",
           value: str = "loss", out: str = "smoothed") -> DataFrame:
    """Mean of the last ``window`` values of the run (fewer at its start).

    One range shuffle numbers the steps in (run, step) order; the last
    ``window - 1`` steps of every block are also sent to the next one, whose
    first windows reach back to them."""
    size = max(BLOCK, window)
    idx = global_index(log, [run, step], out="_i")
    block, place = F.floor((F.col("_i") - 1) / size).cast("bigint"), F.pmod(F.col("_i") - 1, F.lit(size))
    home = F.when(place > size - window, F.array(block, block + 1)).otherwise(F.array(block))
    placed = idx.withColumn("_home", block).withColumn("_block", F.explode(home))
    w = Window.partitionBy("_block", run).orderBy("_i").rowsBetween(1 - window, 0)
    means = placed.withColumn(out, _mean(value, w)).where(F.col("_block") == F.col("_home"))
    return means.drop("_i", "_home", "_block")


def epoch_means(log: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "loss",
                grad: str = "grad_norm", val: str | None = "val_loss") -> DataFrame:
    """Per run and epoch, mean loss, mean gradient norm and (unless
    ``val`` is None) mean validation loss."""
    means = [_mean(loss).alias("mean_loss"), _mean(grad).alias("mean_grad")]
    if val:
        means.append(_mean(val).alias("mean_val"))
    return log.groupBy(run, epoch).agg(*means, F.count(F.lit(1)).alias("steps"))


def running_best(epochs: DataFrame, run: str = "run_id", epoch: str = "epoch",
                 val: str = "mean_val", out: str = "is_best") -> DataFrame:
    """An epoch is a new best when its validation loss is strictly below
    infinity and every earlier epoch's of the run.  An epoch without one (null
    or NaN) never is a best and doesn't count as an earlier one."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    number = F.when(~F.isnan(val), F.col(val))
    best_before = F.coalesce(F.min(number).over(w), F.lit(float("inf")))
    return epochs.withColumn(out, F.coalesce(number < best_before, F.lit(False)))


def patience(best: DataFrame, limit: int = 5, run: str = "run_id", epoch: str = "epoch",
             flag: str = "is_best") -> DataFrame:
    """Epochs since the last best, or since the start if there was none
    (``counter``), ``stop`` when it reaches ``limit``, and ``trained`` = the epoch was reached before the
    first stop (gaps-and-islands over the per-epoch rows)."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    g = best.withColumn("_grp", F.sum(F.col(flag).cast("int")).over(w))
    # the first epoch of an island is its best, except before the run's first best
    g = g.withColumn("counter", (F.row_number().over(Window.partitionBy(run, "_grp").orderBy(epoch))
                                 - F.when(F.col("_grp") > 0, 1).otherwise(0)).cast("bigint"))
    g = g.withColumn("stop", F.col("counter") >= limit)
    first_stop = F.min(F.when(F.col("stop"), F.col(epoch))).over(Window.partitionBy(run))
    return g.withColumn("trained", first_stop.isNull() | (F.col(epoch) <= first_stop)).drop("_grp")


def flag_explosions(log: DataFrame, max_grad_norm: float = 1.0, grad: str = "grad_norm",
                    out: str = "exploded") -> DataFrame:
    """Gradient norm above ten times the clipping norm."""
    return log.withColumn(out, F.col(grad) > 10 * max_grad_norm)


def quick_val(log: DataFrame, batches: int = 10, run: str = "run_id", step: str = "step",
              loss: str = "val_loss") -> DataFrame:
    """Per run, mean loss of the first ``batches`` steps.  ``row_number
    <= k`` is planned as a per-partition group limit before the shuffle, so
    a hot run contributes only k rows per map task."""
    w = Window.partitionBy(run).orderBy(step)
    first = log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= batches)
    return first.groupBy(run).agg(_mean(loss).alias("quick_loss"), F.count(F.lit(1)).alias("batches"))


def events_as_log(events: DataFrame) -> DataFrame:
    """Driver ``events`` as a training log: run = user, step = event id,
    loss = value / 1000, epoch = day since 2024-01-01, grad norm = props.k / 10,
    validation loss = (value + k) / 1000."""
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("epoch"),
        F.col("event_id").alias("step"),
        (F.col("value") / 1000.0).alias("loss"),
        (k / 10.0).alias("grad_norm"),
        ((F.col("value") + k) / 1000.0).alias("val_loss"))

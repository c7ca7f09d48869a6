"""Global order without a single-partition window.

A window without ``partitionBy`` moves every row to one task.  The helpers
here compute an exclusive prefix sum over an arbitrary order in two levels:

1. range-partition the rows on the order key and sort inside each partition
   (one shuffle);
2. per partition, an Arrow-batched running sum (``mapInArrow``) gives the
   local offset and the partition id;
3. the result is checkpointed (reliable, shared folder) so the sampled range
   bounds cannot change between the jobs that read it, and a lost executor
   does not recompute different partition ids;
4. partition totals (one row per partition: bounded by the partition count)
   become bases through a tiny window and a broadcast join.

All columns go through the range pass, so nothing is joined back: rows with
null or repeated keys keep their places like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut_lineage


ROW_BITS = 40           # a partition holds fewer rows than 2^40
PLACE_BITS = 33         # fixed value: the low bits of monotonically_increasing_id


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _local_running_sum(values: list[str], row: str | None):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        acc, seen = [0] * len(values), 0
        for b in batches:
            out = []
            for k, v in enumerate(values):
                x = b.column(b.schema.get_field_index(v)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                cum = np.cumsum(x)
                out.append(pa.array(cum - x + acc[k], pa.int64()))
                acc[k] += int(cum[-1]) if len(x) else 0
            out.append(pa.array(np.full(b.num_rows, pid, np.int32)))
            names = [*b.schema.names, *(f"_local{k}" for k in range(len(values))), "_pid"]
            if row:
                out.append(pa.array((pid << ROW_BITS) + seen + np.arange(b.num_rows, dtype=np.int64)))
                names.append(row)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=names)
    return run


def ranged(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted on ``order`` (one shuffle)."""
    return df.repartitionByRange(_partitions(df, partitions), *order).sortWithinPartitions(*order)


def running_sum(df: DataFrame, value, out="offset", row: str | None = None, store=cut_lineage) -> DataFrame:
    """Exclusive running sums over the rows of a ``ranged`` DataFrame as they lie
    (columns derived from it row by row may have been added).  ``row`` names a
    column for the row's number, unique and in order, frozen like the sums by ``store``
    (``cut_table`` where later jobs read few of the columns)."""
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    locals_ = [f"_local{k}" for k in range(len(values))]
    numbers = [row] if row else []
    schema = T.StructType(df.schema.fields + [T.StructField(lo, T.LongType()) for lo in locals_]
                          + [T.StructField("_pid", T.IntegerType())] + [T.StructField(r, T.LongType()) for r in numbers])
    local = store(df.mapInArrow(_local_running_sum(values, row), schema))
    totals = local.groupBy("_pid").agg(*[F.sum(v).alias(f"_ptotal{k}") for k, v in enumerate(values)])
    # one row per partition: a bounded table, broadcast by construction
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_pid", *[F.coalesce(F.sum(f"_ptotal{k}").over(w), F.lit(0)).alias(f"_base{k}")
                                    for k in range(len(values))])
    sums = [(F.col(f"_base{k}") + F.col(lo)).cast("bigint").alias(o)
            for k, (lo, o) in enumerate(zip(locals_, outs))]
    return local.join(F.broadcast(bases), "_pid").select(*df.columns, *sums, *numbers)


def prefix_sum(df: DataFrame, order: list[str], value, out="offset",
               partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows strictly before this row
    in ``order``.  Nulls come first; rows equal in ``order`` follow each other
    in some order, fixed by the checkpoint.  Every row of ``df`` gives one row.
    ``value``/``out`` may be lists to compute several sums in one pass.
    Values are integers (counts, lengths; null counts as 0): the sums are exact.
    """
    return running_sum(ranged(df, order, partitions), value, out)


def global_index(df: DataFrame, order: list[str], out: str = "idx",
                 partitions: int | None = None, store=cut_lineage) -> DataFrame:
    """1-based position of every row in ``order`` (a distributed row_number).
    Positions need no running sum: ``monotonically_increasing_id`` tells a row's
    partition and place, and ``store`` keeps it with the row, so no row passes
    through Python."""
    at, pid, base, n = "_at", "_pid", "_base", "_n"
    held = store(ranged(df, order, partitions).withColumn(at, F.monotonically_increasing_id()))
    held = held.withColumn(pid, F.shiftright(at, PLACE_BITS))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a bounded table, broadcast by construction
    bases = held.groupBy(pid).agg(F.count("*").alias(n)).select(pid, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    place = F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return held.join(F.broadcast(bases), pid).select(*df.columns, (F.col(base) + place + 1).cast("bigint").alias(out))


BROADCAST_MAX_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only when its counted size is within
    ``max_rows``; otherwise leave the join to a shuffle (with AQE's skew-join
    split for hot keys).  Use on sides that are usually small but not bounded
    by construction (one row per run, per token, ...)."""
    return F.broadcast(df) if df.count() <= max_rows else df

"""Incremental corpus ingestion (G8) with Structured Streaming.

New files in a landing directory -> the caller's stateless transform
(clean / filter / render) -> deduplicated output.  No watermark is needed (no event time).

Stored keys are an index beside the output, not the output itself: 128-bit
digests of the keys, partitioned by ``bucket`` (a prefix of the digest).  A micro-batch

1. stores its transformed rows once, with row numbers, and finds the first row of
   every digest from the narrow columns alone (digest, order, row number; the
   texts don't take part in the aggregate or the join);
2. reads the index of the buckets that its digests fall into, no others, and
   drops the digests found there (ignoring what this very batch has written before);
3. overwrites its own ``run_id=<id>/batch_id=<epoch>`` folder of the output, then its own
   part of the index.

So a batch that is replayed after a failure at any point rewrites the same rows.
The index grows by one small file per batch and bucket touched; ``compact_keys`` joins them.

Defined cases: a null key is a key like any other (one row of it is kept); of
rows with one key the one of the least ``order`` stays, nulls first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordering import broadcast_if_small
from tessera.session import cut_table

BUCKETS = 256
KEYS = "_keys"                 # hidden from readers of the output
INDEX = "digest binary, bucket int, run_id string, batch_id long"


def _has_files(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))


def key_digest(key: Column) -> Column:
    """16 bytes per key; null has a digest of its own."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-"))))


def bucket_of(digest: Column, buckets: int) -> Column:
    return (F.conv(F.substring(F.hex(digest), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def read_keys(spark: SparkSession, out: str, buckets: list[int] | None = None) -> DataFrame:
    """The index, or those of its buckets (partition pruning: the others aren't listed or read)."""
    if not _has_files(spark, f"{out}/{KEYS}"):
        return spark.createDataFrame([], INDEX)
    keys = spark.read.schema(INDEX).parquet(f"{out}/{KEYS}")
    return keys if buckets is None else keys.where(F.col("bucket").isin(buckets))


def _write_keys(digests: DataFrame, out: str, run: str, batch: int) -> None:
    # few files: a bucket's digests of this batch go to one task
    digests.repartition("bucket").withColumn("run_id", F.lit(run)).withColumn("batch_id", F.lit(batch)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket", "run_id", "batch_id").parquet(f"{out}/{KEYS}")


def build_keys(spark: SparkSession, out: str, key: str, buckets: int = BUCKETS) -> None:
    """Index of an output that has none yet."""
    digest = key_digest(F.col(key))
    _write_keys(spark.read.parquet(out).select(digest.alias("digest")).distinct().withColumn("bucket", bucket_of(F.col("digest"), buckets)),
                out, "built", -1)


def compact_keys(spark: SparkSession, out: str) -> None:
    """One file per bucket instead of one per batch.  The joined index is stored apart
    first, so an interruption loses nothing; not for use while batches run."""
    joined = cut_table(read_keys(spark, out).select("digest", "bucket").distinct())
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{KEYS}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _write_keys(joined, out, "joined", -1)
    for b in fs.listStatus(p):
        for r in fs.listStatus(b.getPath()) if b.isDirectory() else ():
            if r.getPath().getName() != "run_id=joined":
                fs.delete(r.getPath(), True)


def store_batch(rows: DataFrame, out: str, run: str, batch: int, key: str, order: str, buckets: int = BUCKETS) -> None:
    """One micro-batch: the rows whose key is new, each key once."""
    spark = rows.sparkSession
    if _has_files(spark, out) and not _has_files(spark, f"{out}/{KEYS}"):
        build_keys(spark, out, key, buckets)
    rows = cut_table(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_digest", key_digest(F.col(key))))
    first = rows.groupBy("_digest").agg(F.min(F.struct(F.col(order).alias("o"), F.col("_row").alias("r"))).alias("_f")).select(
        F.col("_digest").alias("digest"), bucket_of(F.col("_digest"), buckets).alias("bucket"), F.col("_f.r").alias("_row"))
    first = cut_table(first)
    touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    stored = read_keys(spark, out, touched).where((F.col("run_id") != run) | (F.col("batch_id") != batch))
    new = cut_table(first.join(stored.select("digest", "bucket"), ["digest", "bucket"], "left_anti"))
    kept = rows.join(broadcast_if_small(new.select("_row")), "_row", "left_semi").drop("_row", "_digest")
    kept.write.mode("overwrite").parquet(f"{out}/run_id={run}/batch_id={batch}")
    _write_keys(new.select("digest", "bucket"), out, run, batch)


def ingest(spark: SparkSession, landing: str, schema: T.StructType,
           transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
           key: str = "dedup_key", order: str = "id", files_per_trigger: int = 1000,
           fmt: str = "parquet", buckets: int = BUCKETS) -> None:
    """Process every file now in ``landing`` (``availableNow``) and return.

    ``transform`` must return ``order`` and ``key`` columns; rows whose key
    is already in ``out`` (or repeated inside the batch) are dropped.
    Batches are numbered within a checkpoint, so the output folders also carry
    the checkpoint's id: a fresh checkpoint adds to stored batches.  ``buckets`` must
    stay the same for one output."""
    stream = (spark.readStream.schema(schema).format(fmt)
              .option("maxFilesPerTrigger", files_per_trigger).load(landing))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # the id in the checkpoint's metadata is kept over restarts
        run = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        store_batch(transform(batch), out, run, epoch_id, key, order, buckets)

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()

"""Resumable generation (G5, G6, K3, A3): prompts through a responder, in committed steps.

The prompts' batches are taken ``every`` at a time.  One step is one Spark job: its prompts are
answered (``synth.enrich``) and the results, failures included, are published as one
part of the output folder; the part's manifest is the ledger entry.  A run that is started again
reads the ledger first: prompts whose ``request_index`` is in a published part are
left out by an anti-join on the stored indexes (not by step numbers, so other batch sizes or more
prompts may follow), and only what is left is answered.  So a run that is killed
after a commit never repeats a committed call, and ends with the rows that an
undisturbed run gives.  Calls of the step that was under way are repeated: nothing of it was kept.

Progress (succeeded, failed, running totals) comes from the published rows.

Defined cases: prompts without a key are numbered as null and answered in every run; prompts that repeat
a key are answered each in the step they are in; an empty table publishes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.stats import batch_progress
from tessera.operators.synth import RESULT_SCHEMA, enrich
from tessera.session import cut_table
from tessera.sources.committed import manifests, publish, read_committed

RESULTS = T.StructType([*RESULT_SCHEMA.fields, T.StructField("batch_id", T.LongType())])


def results(spark: SparkSession, path: str) -> DataFrame:
    """All published results, with the ``step`` they came in."""
    return read_committed(spark, path, schema=RESULTS, part="step")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """A3 over the published results: per batch and in total."""
    return batch_progress(results(spark, path))


def generate(prompts: DataFrame, responder: Callable[[str], str], path: str, key: str = "id", text: str = "prompt",
             batch: str = "batch_id", every: int = 5, after_step: Callable[[dict], None] | None = None, **options) -> list[dict]:
    """Answer the prompts that ``path`` has no result for; returns the manifests of the
    steps of this run.  ``every`` batches make a step (choose it so that a step is worth a
    job); ``options`` go to ``enrich``; ``after_step`` is called with each manifest."""
    spark = prompts.sparkSession
    done = results(spark, path).select(F.col("request_index").alias("_done")).distinct()
    todo = prompts.select(F.col(key).cast("long").alias("id"), F.col(text).alias("prompt"),
                          F.coalesce(F.col(batch).cast("long"), F.lit(0)).alias("batch_id"))
    # what is left is stored, so the steps don't read the growing output
    todo = cut_table(todo.join(done, todo["id"] == done["_done"], "left_anti").withColumn("step", F.floor(F.col("batch_id") / every)))
    steps = [r["step"] for r in todo.select("step").distinct().orderBy("step").collect()]  # one number per job
    taken, out = len(manifests(spark, path)), []
    for n, step in enumerate(steps):
        rows = todo.where(F.col("step") == step)
        answered = enrich(rows, responder, "id", "prompt", carry=["batch_id"], **options)
        out.append(publish(answered, path, f"step-{taken + n:06d}"))
        if after_step:
            after_step(out[-1])
    return out

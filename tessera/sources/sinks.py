"""Sinks (K1-K7).  Every writer is a distributed write (one file per task);
JSON outputs are JSON Lines, which ``read_pairs(..., multiline=False)``
reads back.  Where the original wrote one JSON document, the header is a
separate one-row output and the items stay rows, so nothing is gathered on
one task."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.render import to_pair_records


def write_pairs(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: successful results as ``{data:[prompt, response], metadata:{...}}``."""
    to_pair_records(results).select("data", "metadata").write.mode(mode).json(path)


def write_raw(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: every result, failures included."""
    results.write.mode(mode).json(path)


def append_batches(results: DataFrame, path: str, batch: str = "batch_id") -> None:
    """K3: per-batch output partitioned by ``batch``; rewriting a batch
    replaces only its own directory (dynamic partition overwrite), so a
    replayed batch is idempotent."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).json(path)


def question_envelope(numbered: DataFrame, generated_at: str | None = None) -> DataFrame:
    """K4 header: ``generated_at, total_questions`` (one aggregate row)."""
    stamp = generated_at or datetime.now().isoformat()
    return numbered.agg(F.count(F.lit(1)).cast("int").alias("total_questions")).select(
        F.lit(stamp).alias("generated_at"), "total_questions")


def question_lines(numbered: DataFrame, generated_on: str | None = None) -> DataFrame:
    """K5: the text file as ordered rows: two header lines, a blank line,
    then ``%3d. question`` per question (``n`` orders the lines)."""
    stamp = generated_on or datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    total = numbered.agg(F.count(F.lit(1)).alias("c"))
    header = total.select(F.explode(F.array(
        F.struct(F.lit(-2).cast("bigint").alias("n"), F.lit(f"# Common Questions Generated on {stamp}").alias("line")),
        F.struct(F.lit(-1).cast("bigint").alias("n"), F.format_string("# Total: %d questions", "c").alias("line")),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("").alias("line")))).alias("h")).select("h.*")
    return header.unionByName(numbered.select(F.col("n").cast("bigint"), "line"))


def write_lines(lines: DataFrame, path: str, order: str = "n", text: str = "line") -> None:
    lines.orderBy(order).select(text).write.mode("overwrite").text(path)


def write_report(stats: DataFrame, path: str) -> None:
    """K6: the mix / statistics rows as JSON."""
    stats.write.mode("overwrite").json(path)


def write_windows(windows: DataFrame, path: str, split: str = "split") -> None:
    """K7: packed windows as parquet, one directory per split."""
    windows.write.mode("overwrite").partitionBy(split).parquet(path)


def write_text_files(rows: DataFrame, directory: str, name: str = "path", text: str = "text") -> None:
    """One UTF-8 file per row, named by its ``name`` column, from the tasks that
    hold the rows.  A file is put in place by a rename, so a repeated task replaces it whole."""
    def run(batches):
        import uuid

        import pandas as pd
        from pyarrow import fs
        uri = "file://" + directory[5:] if directory.startswith("file:/") and not directory.startswith("file://") else directory
        system, base = fs.FileSystem.from_uri(uri)
        system.create_dir(base, recursive=True)
        for frame in batches:
            for n, t in zip(frame["_n"], frame["_t"]):
                staged = f"{base}/_{uuid.uuid4().hex}"
                with system.open_output_stream(staged, compression=None) as f:
                    f.write((t or "").encode())
                system.move(staged, f"{base}/{n}")
            yield pd.DataFrame({"n": [len(frame)]})
    rows.select(F.col(name).alias("_n"), F.col(text).alias("_t")).mapInPandas(run, "n long").agg(F.sum("n")).collect()

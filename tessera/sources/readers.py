"""File sources.

Readers return DataFrames with an explicit order key; none of them pulls data
through the driver (the only driver-side values are file listings, but for books
by lines, which tasks list, and, for the split choice, the distinct partition
values of a split column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import universal_newlines
from tessera.session import cut_table
from tessera.sources.json_array import SPLIT, read_array

PAIR_SCHEMA = T.StructType([
    T.StructField("data", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.StructType([
        T.StructField("timestamp", T.StringType()), T.StructField("model", T.StringType()),
        T.StructField("source", T.StringType())])),
])
RAW_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType()), T.StructField("response", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("success", T.BooleanType()), T.StructField("request_index", T.LongType()),
    T.StructField("error", T.StringType()),
])


class SourceMissing(FileNotFoundError):
    pass


def read_books(spark: SparkSession, directory: str, pattern: str = "book*.txt") -> DataFrame:
    """One row per file, ``path`` (file name) and ``text`` read as UTF-8
    with CRLF / CR turned into LF (a BOM is kept).  Order by ``path``
    (string order: book10 sorts before book2).  Error when nothing matches."""
    if not _exists(spark, f"{directory}/{pattern}"):
        raise SourceMissing(f"no {pattern} files in {directory}")
    _, tasks = _files(spark, directory, pattern)
    return (_matching(spark, "text", directory, pattern, wholetext=True)
            .select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("path"),
                    universal_newlines(F.col("value")).alias("text")).coalesce(tasks))


def _matching(spark: SparkSession, kind: str, directory: str, pattern: str, **options) -> DataFrame:
    """The files of a folder by their names, from one listing of the folder: as a path, a pattern
    becomes a path per file, each of which is looked up by itself."""
    if "/" in pattern:
        return spark.read.format(kind).options(**options).load(f"{directory}/{pattern}")
    return spark.read.format(kind).options(pathGlobFilter=pattern, **options).load(directory)


def _files(spark: SparkSession, directory: str, pattern: str) -> tuple[DataFrame, int]:
    """``(file, size)`` and how many tasks read them: by their bytes, not by their number (Spark
    deals a small file as if it had several MB, so that a task gets a handful)."""
    least = 4 * spark.sparkContext.defaultParallelism
    files = _matching(spark, "binaryFile", directory, pattern).select(F.col("path").alias("file"), F.col("length").alias("size")).coalesce(least)
    total = files.agg(F.sum("size")).first()[0] or 0
    return files, max(least, -(-total // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))


LISTED = 10_000        # files a listing holds at a time
CHUNK = 1 << 22        # bytes a task reads at a time
PACKED = (".gz", ".bz2", ".zst")
BOM = b"\xef\xbb\xbf"


def _system(place: str):
    """The file system of a folder, and the folder's name in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri("file://" + place[5:] if place.startswith("file:/") and not place.startswith("file://") else place)


def _listing(names: str, number: dict):
    """Folders -> their files ``at, name, size`` (the folder's number) whose names match: as they are met where
    the system is a local one, else from one listing."""
    def run(frames):
        import os
        import re

        import pandas as pd
        from pyarrow import fs
        fits = re.compile(names).fullmatch

        def met(system, base):
            if isinstance(system, fs.LocalFileSystem):
                with os.scandir(base) as found:
                    for x in found:
                        if fits(x.name) and x.is_file():
                            yield x.name, x.stat().st_size
            else:
                for x in system.get_file_info(fs.FileSelector(base)):
                    if fits(x.base_name) and x.type == fs.FileType.File:
                        yield x.base_name, x.size
        for frame in frames:
            for folder in frame["folder"]:
                rows = []
                for name, size in met(*_system(folder)):
                    if not (name[0] == "." or name[0] == "_" and "=" not in name or name.endswith("._COPYING_")):  # hidden to Spark's readers
                        rows.append((number[folder], name, size))
                    if len(rows) == LISTED:
                        yield pd.DataFrame(rows, columns=["at", "name", "size"])
                        rows = []
                yield pd.DataFrame(rows, columns=["at", "name", "size"]).astype({"at": "int32", "size": "int64"})
    return run


def _lines_from(f, start: int, end: int):
    """``(lines, ended)``, some at a time: the lines that begin in [start, end), without their ends;
    ``ended``, at the end of the file, whether a line ends there."""
    at, skip, rest, last = max(start - 1, 0), start > 0, [], b""
    if at:
        f.seek(at)
    while True:
        data = f.read(CHUNK)
        last = data[-1:] or last
        if data and rest and not rest[-1].endswith(b"\r") and b"\n" not in data and b"\r" not in data:
            rest.append(data)  # a long line goes on
            continue
        lines, rest = b"".join([*rest, data]).splitlines(keepends=True), []
        if data and lines and not lines[-1].endswith(b"\n"):
            rest = [lines.pop()]  # goes on, or its "\n" comes next
        out = []
        for line in lines:
            if skip:  # begins before the range
                skip = False
            elif at >= end:
                yield out, False
                return
            elif at or not line.startswith(BOM):
                out.append(line.rstrip(b"\r\n"))
            elif line != BOM:
                out.append(line[len(BOM):].rstrip(b"\r\n"))
            at += len(line)
        yield out, not data and last in (b"\n", b"\r", b"")
        if not data:
            return


def _reading(folders: list[str]):
    """Ranges ``at, name, start, end, tail`` of files -> ``path, block, line``."""
    def run(batches):
        import pyarrow as pa
        systems = {}
        path, block, text, size = [], [], [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(block, pa.int64()), pa.array(text, pa.binary())], names=["path", "block", "line"])
        for b in batches:
            for r in b.to_pylist():
                if r["at"] not in systems:
                    systems[r["at"]] = _system(folders[r["at"]])
                system, base = systems[r["at"]]
                whole = r["name"].endswith(PACKED)
                with (system.open_input_stream if whole else system.open_input_file)(f"{base}/{r['name']}") as f:
                    for lines, ended in _lines_from(f, r["start"], r["end"]):
                        path += [r["name"]] * len(lines)
                        block += [r["start"]] * len(lines)
                        text += lines
                        size += sum(map(len, lines))
                        if ended and r["tail"]:
                            path.append(r["name"])
                            block.append((1 << 63) - 1)
                            text.append(b"")
                        if size > CHUNK or len(path) > LISTED:
                            yield packed()
                            path, block, text, size = [], [], [], 0
        yield packed()
    return run


def read_book_lines(spark: SparkSession, directory: str, pattern: str = "book*.txt") -> DataFrame:
    """S1 by lines, for books larger than a value or a split: ``path, block, at, line``; (block, at)
    orders a book.  Line ends of all three kinds; a text that ends with one has an empty last line, as in
    the whole text.  (A byte order mark at the start isn't kept, other than by ``read_books``.)

    Files are listed and read by tasks, dealt by their bytes (large ones in ranges): the driver knows the folders
    and the sum of the sizes, however many files there are."""
    folder, glob = f"{directory}/{pattern}".rsplit("/", 1)
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    folders = [x.getPath().toString() for x in found or [] if x.isDirectory()]
    names = jvm.GlobPattern(glob).compiled().pattern()
    listed = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(max(len(folders), 1), "folder")
    files = cut_table(listed.mapInPandas(_listing(names, {x: k for k, x in enumerate(folders)}), "at int, name string, size long"))
    count, total = files.agg(F.count("*"), F.sum("size")).first()
    if not count:
        raise SourceMissing(f"no {pattern} files in {directory}")
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    whole = F.lit(False)
    for x in PACKED:
        whole = whole | F.col("name").endswith(x)
    step = F.when(whole, F.lit((1 << 62))).otherwise(F.lit(split)).cast("long")
    ranges = files.withColumn("step", step).withColumn("start", F.explode(F.sequence(
        F.lit(0).cast("long"), F.when(whole, 0).otherwise(F.greatest(F.col("size") - 1, F.lit(0))).cast("long"), F.col("step"))))
    end = F.col("start") + F.col("step")
    ranges = ranges.select("at", "name", "start", end.alias("end"), (whole | (end >= F.col("size"))).alias("tail"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-total // split))
    lines = ranges.repartition(tasks, "at", "name", "start").mapInArrow(_reading(folders), "path string, block long, line binary")
    return lines.select("path", "block", F.monotonically_increasing_id().alias("at"), F.col("line").cast("string").alias("line"))


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, split: str = "train", optional: bool = False,
               schema: T.StructType | None = None, fmt: str = "parquet",
               columns: list[str] | None = None) -> DataFrame:
    """A dataset directory; when it is partitioned by ``split``,
    ``split`` is preferred and the first split (by name) is used otherwise.
    With ``optional=True`` a missing path becomes an empty DataFrame of
    ``schema`` (the run goes on; the stats show zero rows); any other fault,
    such as a wrong column, is an error."""
    if optional and schema is not None and not _exists(spark, path):
        return empty_like(spark, schema).select(*(columns or schema.names))
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if "split" in df.columns:
        names = [r[0] for r in df.select("split").distinct().orderBy("split").collect()]
        chosen = split if split in names else (names[0] if names else split)
        df = df.where(F.col("split") == chosen).drop("split")
    return df.select(*columns) if columns else df


def read_pairs(spark: SparkSession, paths, multiline: bool = True, split_bytes: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """S4 + V2: generated pairs; a file is either one JSON array of any size
    (``multiline=True``; read in byte ranges) or JSON Lines.  Returns ``(valid, rejected)``:
    valid rows hold exactly two messages; the rest are kept aside with their
    reason (and their text, where they don't parse) instead of being dropped silently."""
    if multiline:
        df = read_array(spark, paths, PAIR_SCHEMA, split_bytes).withColumn("_broken", F.col("_error"))
    else:
        whole = T.StructType([*PAIR_SCHEMA.fields, T.StructField("_record", T.StringType())])
        df = spark.read.schema(whole).option("columnNameOfCorruptRecord", "_record").json(paths)
        df = df.withColumn("_file", F.col("_metadata.file_path")).withColumn(
            "_broken", F.when(F.col("_record").isNotNull(), "not a record of the schema"))
    ok = F.coalesce(F.size("data") == 2, F.lit(False))
    reason = F.coalesce("_broken", F.when(F.col("data").isNull(), "missing data").when(~ok, "not two messages"))
    tagged = df.select("data", "metadata", "_file", F.when(F.col("_broken").isNotNull(), F.col("_record")).alias("_record"), reason.alias("reject_reason"))
    return tagged.where(F.col("reject_reason").isNull()).drop("reject_reason", "_record"), tagged.where(
        F.col("reject_reason").isNotNull())


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))  # a path or a pattern


def read_generated(spark: SparkSession, data_file: str, multiline: bool = True) -> DataFrame:
    """The first existing of ``data_file``, ``temp_<name>`` and
    ``<name>_raw.json``.  The raw-results shape is accepted too (``data``
    is built from prompt/response of successful rows).  Then V2 and the
    fine-tune length rule apply; no usable row is an error."""
    import posixpath
    d, name = posixpath.split(data_file)
    candidates = [data_file, posixpath.join(d, "temp_" + name), data_file.replace(".json", "_raw.json")]
    found = next((c for c in candidates if _exists(spark, c)), None)
    if found is None:
        raise SourceMissing(f"no generated data; tried {candidates}")
    if found.endswith("_raw.json"):
        raw = read_array(spark, found, RAW_SCHEMA) if multiline else spark.read.schema(RAW_SCHEMA).json(found)
        valid = raw.where(F.col("success") & F.col("response").isNotNull()).select(
            F.array("prompt", "response").alias("data"))
    else:
        valid, _ = read_pairs(spark, found, multiline)
    from tessera.operators import rules as R
    from tessera.operators.render import pair_columns
    kept = R.keep(pair_columns(valid), [R.exact_turns(2), R.min_stripped_len(10, "prompt", "response")])
    if kept.isEmpty():
        raise ValueError("No valid conversations found in the data file")
    return kept

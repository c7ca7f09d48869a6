r"""JSON arrays of any size, read by several tasks.

A file that is one JSON array can't be cut at line ends: a bracket, comma or
line end may stand inside a string, and a string may hold anything.  So the file is read in
two passes over byte ranges, both spread over tasks:

1. every range reports how its quotes and brackets change the state, once as if it began
   outside a string and once as if inside: the parity of its unescaped quotes and the
   change of depth in either case.  (Whether a quote at its very start is escaped
   is seen from the backslashes right before it.)
2. running sums over a file's ranges, a few numbers each, say what is true where each range
   begins.  A range then yields the elements whose opening bracket or comma of depth
   one lies in it, and reads on past its end to finish the last one.

The result is that of a single reader, whatever the size of the ranges.  Elements come as text
with their byte offsets; records that don't parse are kept with a reason.  A task holds a block
of ``BLOCK`` bytes and one element.

Defined cases: an empty array or file gives no rows; an empty element, an element that
ends with the file, text outside the array (a byte order mark aside) and bytes that aren't UTF-8 give a row with a reason.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = 64 << 20
BLOCK = 4 << 20
QUOTE, BACKSLASH, COMMA = 34, 92, 44
WHITE = b" \t\r\n"
BOM = b"\xef\xbb\xbf"


def _open(uri: str):
    """A seekable file by its URI as Spark writes it (any store ``pyarrow.fs`` knows)."""
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _backslashes_before(file, at: int) -> int:
    """Length of the run of backslashes that ends right before ``at``."""
    run = 0
    while at > 0:
        n = min(4096, at)
        file.seek(at - n)
        data = file.read(n)
        tail = len(data) - len(data.rstrip(b"\\"))
        run, at = run + tail, at - n
        if tail < n:
            break
    return run


def _unescaped_quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Quotes behind an even number of backslashes; ``before`` of them precede the block."""
    place = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(data != BACKSLASH, place, -1))
    previous = np.concatenate([[-1], last_other[:-1]])
    run = place - 1 - previous + np.where(previous < 0, before, 0)
    return (data == QUOTE) & (run % 2 == 0)


def _depth_change(data: np.ndarray) -> np.ndarray:
    return ((data == ord("[")) | (data == ord("{"))).astype(np.int64) - ((data == ord("]")) | (data == ord("}")))


def _blocks(file, start: int, end: int):
    """``(offset, bytes, backslashes before)`` of a range."""
    before = _backslashes_before(file, start)
    while start < end:
        file.seek(start)
        data = file.read(min(BLOCK, end - start))
        if not data:
            return
        yield start, data, before
        run = len(data) - len(data.rstrip(b"\\"))
        before = run + (before if run == len(data) else 0)
        start += len(data)


def scan(file, start: int, end: int) -> tuple[int, int, int]:
    """Parity of the range's quotes, and its change of depth if it begins outside or inside a string."""
    parity, outside, inside = 0, 0, 0
    for _, data, before in _blocks(file, start, end):
        a = np.frombuffer(data, np.uint8)
        quotes = _unescaped_quotes(a, before)
        in_string = (np.cumsum(quotes) - quotes + parity) % 2
        change = _depth_change(a)
        outside += int(change[in_string == 0].sum())
        inside += int(change[in_string == 1].sum())
        parity = (parity + int(quotes.sum())) % 2
    return parity, outside, inside


def elements(file, start: int, end: int, size: int, in_string: bool, depth: int):
    """``(offset, bytes, reason)`` of the elements that begin in the range."""
    state, begun, held, outside = int(in_string), None, [], False
    file.seek(0)
    mark = len(BOM) if start < len(BOM) and file.read(len(BOM)) == BOM else 0
    for at, data, before in _blocks(file, start, size):
        if at >= end and begun is None:
            return
        a = np.frombuffer(data, np.uint8)
        quotes = _unescaped_quotes(a, before)
        free = (np.cumsum(quotes) - quotes + state) % 2 == 0
        state = (state + int(quotes.sum())) % 2
        change = np.where(free, _depth_change(a), 0)
        level = depth + np.cumsum(change) - change
        depth += int(change.sum())
        borders = np.flatnonzero(free & ((a == COMMA) & (level == 1) | (a == ord("[")) & (level == 0) | (a == ord("]")) & (level == 1)))
        stray = free & (level <= 0) & ~np.isin(a, np.frombuffer(WHITE + b"[", np.uint8))
        stray[:max(mark - at, 0)] = False
        stray = np.flatnonzero(stray[:max(end - at, 0)])
        if len(stray) and not outside:
            outside = True
            yield at + int(stray[0]), b"", "text outside the array"
        cursor = 0
        for b in borders.tolist():
            if begun is not None:
                held.append(data[cursor:b])
                value = b"".join(held).strip(WHITE)
                closing = a[b] == ord("]")
                if value:
                    yield begun, value, None
                elif not (closing and opened):
                    yield begun, value, "empty element"
                begun, held = None, []
            if at + b >= end:
                return
            if a[b] != ord("]"):
                begun, opened, cursor = at + b + 1, a[b] == ord("["), b + 1
        if begun is not None:
            held.append(data[cursor:])
    if begun is not None:
        yield begun, b"".join(held).strip(WHITE), "the file ends inside the array"


def _scans(frames):
    for frame in frames:
        out = []
        for path, start, end in zip(frame["path"], frame["start"], frame["end"]):
            with _open(path) as f:
                out.append(scan(f, start, end))
        frame["parity"], frame["outside"], frame["inside"] = zip(*out) if out else ((), (), ())
        yield frame


def _elements(frames):
    import pandas as pd
    for frame in frames:
        for path, start, end, size, in_string, depth in zip(*(frame[c] for c in ("path", "start", "end", "size", "in_string", "depth"))):
            out, held = [], 0
            with _open(path) as f:
                for offset, value, reason in elements(f, start, end, size, in_string, depth):
                    try:
                        text = value.decode()
                    except UnicodeDecodeError:
                        text, reason = value.decode("utf-8", "replace"), reason or "not UTF-8"
                    out.append((path, offset, text, reason))
                    held += len(value) + 100
                    if held > BLOCK:
                        yield pd.DataFrame(out, columns=["_file", "_offset", "_record", "_error"])
                        out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=["_file", "_offset", "_record", "_error"])


def read_elements(spark: SparkSession, paths, split_bytes: int = SPLIT) -> DataFrame:
    """``_file, _offset, _record, _error``: the elements of the arrays as text, in
    no order (``_offset`` orders a file)."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"))  # a listing, no contents
    splits = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, "size"))
    tasks = max(1, splits.count())
    scanned = splits.repartition(tasks, "path", "start").mapInPandas(
        _scans, "path string, size long, start long, end long, parity int, outside long, inside long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = scanned.withColumn("in_string", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    state = state.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    return state.select("path", "start", "end", "size", "in_string", "depth").repartition(tasks, "path", "start").mapInPandas(
        _elements, "_file string, _offset long, _record string, _error string")


def read_array(spark: SparkSession, paths, schema: T.StructType, split_bytes: int = SPLIT) -> DataFrame:
    """The fields of ``schema`` per element, with ``_file, _offset, _record, _error``: an
    element that isn't a record of the schema has the reason there (its fields are null)."""
    rows = read_elements(spark, paths, split_bytes)
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = rows.withColumn("_r", F.when(F.col("_error").isNull(), F.from_json("_record", whole, {"columnNameOfCorruptRecord": "_corrupt"})))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    return parsed.select(*[F.when(~bad, F.col("_r")[f.name]).alias(f.name) for f in schema.fields], "_file", "_offset", "_record",
                         F.coalesce("_error", F.when(bad, "not a record of the schema")).alias("_error"))


def write_array(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Every task's rows as one JSON array file (an empty task writes an empty array or nothing)."""
    def run(batches):
        import pyarrow as pa
        first = True
        for b in batches:
            if b.num_rows:
                lines = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first and i == 0 else ",") + x for i, x in enumerate(lines)])], names=["value"])
                first = False
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(run, "value string").write.mode(mode).text(path)

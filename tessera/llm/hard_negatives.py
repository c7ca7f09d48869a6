"""Hard-negative mining over Hilbert-ordered Parquet blocks with zone maps.

1. Vectors become integers, ``floor(256 x)``.  The dimensions of greatest spread
   (one aggregate over all rows) span a Hilbert curve; the rows are range-partitioned by
   (label, place on the curve, id) and written as Parquet, one row per block of
   up to ``BLOCK`` rows of one label: the least and greatest value of every
   dimension (the zone map), the ids and the packed vectors.  The anchors among the
   rows are kept in their block's row, each with the score that its own block's rows already give
   to its last positive.
2. Groups of up to ``GROUP`` anchors meet the zone maps only (the Parquet columns
   of the payload stay unread) in a grid of tasks: interval arithmetic bounds
   the scores of a group's anchors with a block's rows from above and below.  For positives a block of the
   same label is read if its upper bound reaches that score; for negatives
   a block of another label is read if some window [low, high] of an anchor meets
   its bounds.
3. The chosen (group, block) pairs are joined with the anchors' vectors and then
   with the payload of the blocks; numpy scores them exactly, keeps the best
   of each block and Spark's ranked window the best of all.

Every choice only leaves out blocks that cannot hold a result, so the results
are those of the brute-force search.  A group of equal vectors (or of one label) is spread over
blocks by id, so no key holds more than a block; what a task holds is bounded by ``BLOCK``,
``GROUP`` and a page of ``PAGE`` zone maps.

Defined cases: rows without an id, a label or a vector, or with a null or
non-finite component take no part; shorter vectors end in zeros; rows that repeat an id
are rows of their own (equal scores come by id, then by place); scores must stay below
2^52, else the task fails with a message.  Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tessera.llm.shared import cut
from tessera.session import ensure_checkpoint_dir

SCALE = 256
BLOCK = 1024             # rows of a block
GROUP = 128              # anchors of a group
PAGE = 512               # zone maps of a page
CURVE_DIMS = 10          # dimensions of the Hilbert curve
CURVE_BITS = 6           # bits of each
SPREAD = 3.0             # standard deviations on either side that the curve's cells cover
LIMIT = 1 << 52
NO_ROW = -(1 << 62)


# --- the curve ---------------------------------------------------------------
def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (columns are
    dimensions): per bit plane the axes are exchanged or inverted as the curve turns,
    then the Gray code is undone and the planes are read across."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    plane = 1 << (bits - 1)
    while plane > 1:
        below = plane - 1
        for d in range(n):
            set_ = (x[:, d] & plane) != 0
            x[set_, 0] ^= below
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= swap
            x[:, d] ^= swap
        plane >>= 1
    for d in range(1, n):
        x[:, d] ^= x[:, d - 1]
    turn, plane = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while plane > 1:
        turn ^= np.where((x[:, n - 1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            out = (out << 1) | ((x[:, d] >> b) & 1)
    return out


def _matrix(column, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` numbers, shorter ones ending in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(int)] = flat
    return out


def _with_place(dims: list[int], low: list[float], width: list[float], size: int):
    def run(batches):
        for b in batches:
            q = _matrix(b.column(b.schema.get_field_index("q")), size)
            if dims:
                cells = np.clip((q[:, dims] - np.array(low)) / np.array(width), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
                place = hilbert(cells, CURVE_BITS)
            else:
                place = np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], names=[*b.schema.names, "place"])
    return run


# --- packed vectors ------------------------------------------------------------
def _pack(q: np.ndarray) -> bytes:
    top = int(np.abs(q).max(initial=0))
    return q.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64).tobytes()


def _unpack(data: bytes, rows: int, dims: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (rows * dims)] if rows * dims else np.int16
    return np.frombuffer(data, kind).reshape(rows, dims)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if top >= LIMIT:
        raise ValueError("vectors too large for exact scores: components times 256 and their products must stay below 2^52")
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


BLOCKS = pa.schema([
    ("block", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), ("zone_min", pa.binary()), ("zone_max", pa.binary()),
    ("ids", pa.binary()), ("vectors", pa.binary()),
    ("anchors", pa.list_(pa.struct([("slot", pa.int32()), ("id", pa.int64()), ("vector", pa.binary()), ("reached", pa.int64())])))])


def _block_row(held, label: int, number: int, positives: int) -> dict:
    """One block: its rows by id, its zone map, its anchors."""
    ids, q, marks = (np.concatenate([h[k] for h in held]) for k in range(3))
    order = np.argsort(ids, kind="stable")
    ids, q, slots = ids[order], q[order], np.flatnonzero(marks[order])
    reached = [None] * len(slots)
    if len(slots) and len(ids) > positives:
        s = _scores(q[slots], q)
        s[np.arange(len(slots)), slots] = NO_ROW
        reached = np.sort(s, axis=1)[:, -positives].tolist()
    return {"block": number, "label": label, "n": len(ids), "zone_min": q.min(0).astype(np.int64).tobytes(),
            "zone_max": q.max(0).astype(np.int64).tobytes(), "ids": ids.tobytes(), "vectors": _pack(q),
            "anchors": [{"slot": int(i), "id": int(ids[i]), "vector": _pack(q[i:i + 1]), "reached": r} for i, r in zip(slots, reached)]}


def _blocks_of(size: int, positives: int):
    """Sorted (id, label, anchor, q) -> blocks: full, or cut where the label changes."""
    def run(batches):
        from pyspark import TaskContext
        number, held, count, label = TaskContext.get().partitionId() << 32, [], 0, None
        for b in batches:
            ids, labels, marks = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            q, at = _matrix(b.column(3), size), 0
            while at < len(ids):
                if held and (labels[at] != label or count == BLOCK):
                    yield pa.RecordBatch.from_pylist([_block_row(held, label, number, positives)], schema=BLOCKS)
                    held, count, number = [], 0, number + 1
                label = int(labels[at])
                end = min(at + BLOCK - count, at + int(np.argmax(np.append(labels[at:] != label, True))))
                held.append((ids[at:end], q[at:end], marks[at:end]))
                count, at = count + end - at, end
        if held:
            yield pa.RecordBatch.from_pylist([_block_row(held, label, number, positives)], schema=BLOCKS)
    return run


def index(vectors: DataFrame, path: str, row_id: str, vector: str, label: str, anchor: Column, positives: int) -> int:
    """Write the blocks of ``vectors`` as Parquet under ``path``; returns the number of dimensions."""
    whole = F.col(vector).cast("array<double>")
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(row_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.transform(whole, lambda x: F.floor(SCALE * x)).alias("q"))
    size = rows.agg(F.max(F.size("q"))).first()[0] or 0
    dims, low, width = [], [], []
    if size:  # one row of a mean and a spread per dimension
        part = lambda d: F.coalesce(F.get("q", F.lit(d)), F.lit(0))
        stats = rows.agg(*[f(part(d)) for d in range(size) for f in (F.avg, F.stddev_pop)]).first()
        spread = [stats[2 * d + 1] for d in range(size)]
        dims = sorted(sorted(range(size), key=lambda d: (-spread[d], d))[:CURVE_DIMS])
        low = [stats[2 * d] - SPREAD * spread[d] for d in dims]
        width = [max(2 * SPREAD * spread[d] / (1 << CURVE_BITS), 1e-9) for d in dims]
    schema = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())])
    placed = rows.mapInArrow(_with_place(dims, low, width, size), schema)
    order = ["label", "place", "id"]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "label", "anchor", "q")
    ranged.mapInArrow(_blocks_of(size, positives), from_arrow_schema(BLOCKS)).write.parquet(path)
    return size


# --- anchors and zone maps ------------------------------------------------------
GROUPS = pa.schema([("group", pa.int64()), ("n", pa.int32()), ("anchors", pa.binary()), ("labels", pa.binary()), ("q", pa.binary()),
                    ("low", pa.binary()), ("high", pa.binary())])
PAGES = pa.schema([("page", pa.int64()), ("blocks", pa.binary()), ("labels", pa.binary()), ("zone_min", pa.binary()), ("zone_max", pa.binary())])
PAIRS = pa.schema([("group", pa.int64()), ("block", pa.int64())])
FOUND = pa.schema([("anchor", pa.int64()), ("nth", pa.int32()), ("found", pa.int64()), ("place", pa.int64()), ("score", pa.int64())])
#: A row's place: its block's number and its slot there.
SLOTS = 1 << 11


def _grouped(dims: int):
    """Rows (anchor, label, vector, low[], high[]) -> groups; every anchor has equally many windows."""
    def run(batches):
        from pyspark import TaskContext
        number, held = TaskContext.get().partitionId() << 32, []

        def group():
            pack = lambda k: np.array([h[k] for h in held], np.int64).tobytes()
            q = np.concatenate([_unpack(h[2], 1, dims) for h in held])
            return pa.RecordBatch.from_pylist([{"group": number, "n": len(held), "anchors": pack(0), "labels": pack(1), "q": _pack(q),
                                                "low": pack(3), "high": pack(4)}], schema=GROUPS)
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5))):
                held.append(row)
                if len(held) == GROUP:
                    yield group()
                    held, number = [], number + 1
        if held:
            yield group()
    return run


def _paged(batches):
    """Zone maps -> pages."""
    from pyspark import TaskContext
    number, held = TaskContext.get().partitionId() << 32, []

    def page():
        return pa.RecordBatch.from_pylist([{
            "page": number, "blocks": np.array([h[0] for h in held], np.int64).tobytes(), "labels": np.array([h[1] for h in held], np.int64).tobytes(),
            "zone_min": b"".join(h[2] for h in held), "zone_max": b"".join(h[3] for h in held)}], schema=PAGES)
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(4))):
            held.append(row)
            if len(held) == PAGE:
                yield page()
                held, number = [], number + 1
    if held:
        yield page()


def _arrays(row, dims: int):
    """A group's anchors, labels, vectors and windows."""
    n = row["n"]
    windows = [np.frombuffer(row[k], np.int64).reshape(n, -1) for k in ("low", "high")]
    return (np.frombuffer(row["anchors"], np.int64), np.frombuffer(row["labels"], np.int64), _unpack(row["q"], n, dims), *windows)


def bounds(q: np.ndarray, zone_min: np.ndarray, zone_max: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner products of each row of ``q`` with any row inside each zone."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return _scores(up, zone_min) + _scores(down, zone_max), _scores(up, zone_max) + _scores(down, zone_min)


def _chosen(same_label: bool, dims: int):
    """(group, page) -> the pairs of a group and a block that may hold results."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                _, labels, q, low, high = _arrays(row, dims)
                blocks, of = np.frombuffer(row["blocks"], np.int64), np.frombuffer(row["zone_labels"], np.int64)
                zones = [np.frombuffer(row[k], np.int64).reshape(len(blocks), dims) for k in ("zone_min", "zone_max")]
                least, most = bounds(q, *zones)
                wanted = np.zeros(least.shape, bool)
                for k in range(low.shape[1]):
                    wanted |= (most >= low[:, k:k + 1]) & (least <= high[:, k:k + 1]) & (low[:, k:k + 1] <= high[:, k:k + 1])
                wanted &= (labels[:, None] == of[None, :]) == same_label
                hit = blocks[wanted.any(0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), row["group"])), pa.array(hit)], schema=PAIRS)
    return run


def _scored(same_label: bool, count: int, dims: int):
    """(group, block payload) -> the best ``count`` rows of the block for every window of every anchor."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                anchors, labels, q, low, high = _arrays(row, dims)
                ids, n, first = np.frombuffer(row["ids"], np.int64), row["rows"], row["block"] * SLOTS
                at = np.flatnonzero((labels == row["label"]) == same_label)
                s = _scores(q[at], _unpack(row["vectors"], n, dims))
                if same_label:  # not the anchor itself
                    own = anchors[at] - first
                    here = np.flatnonzero((own >= 0) & (own < n))
                    s[here, own[here]] = NO_ROW
                order = np.argsort(-s, axis=1, kind="stable")  # rows are in the order of ids
                s = np.take_along_axis(s, order, 1)
                out = []
                for k in range(low.shape[1]):
                    skip = (s > high[at, k:k + 1]).sum(1)
                    for j in range(count):
                        col = np.minimum(skip + j, n - 1)
                        got = s[np.arange(len(at)), col]
                        ok = (skip + j < n) & (got >= low[at, k]) & (got != NO_ROW)
                        slot = order[np.arange(len(at)), col][ok]
                        out.append((anchors[at][ok], np.full(len(slot), k, np.int32), ids[slot], first + slot, got[ok]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]), FOUND[c].type) for c in range(5)], schema=FOUND)
    return run


def _search(anchors: DataFrame, blocks: DataFrame, dims: int, same_label: bool, count: int) -> DataFrame:
    """``anchor, nth, rank, found, place, score``: the first ``count`` rows of
    every window ``nth`` of every anchor, among rows of the same or of other labels."""
    spark = anchors.sparkSession
    groups = cut(anchors.mapInArrow(_grouped(dims), from_arrow_schema(GROUPS)))
    pages = blocks.select("block", "label", "zone_min", "zone_max").mapInArrow(_paged, from_arrow_schema(PAGES))
    side = math.isqrt(max(int(spark.conf.get("spark.sql.shuffle.partitions")) - 1, 0)) + 1
    across = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    # a grid of tasks: every group goes to a row of it, every page to a column
    left = groups.withColumn("x", F.pmod(F.hash("group"), F.lit(side))).withColumn("y", across)
    right = pages.withColumnRenamed("labels", "zone_labels").withColumn("y", F.pmod(F.hash("page"), F.lit(side))).withColumn("x", across)
    met = left.join(right, ["x", "y"]).drop("x", "y")
    pairs = cut(met.mapInArrow(_chosen(same_label, dims), from_arrow_schema(PAIRS)))
    payload = blocks.select("block", "label", F.col("n").alias("rows"), "ids", "vectors")
    scored = pairs.join(groups, "group").join(payload, "block").mapInArrow(_scored(same_label, count, dims), from_arrow_schema(FOUND))
    best = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "found", "place")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)


def _hundredth(value: Column) -> Column:
    """The greatest integer not above a hundredth of an integer."""
    return F.call_function("div", value - F.pmod(value, F.lit(100)), F.lit(100))


def mine(vectors: DataFrame, anchor: Column, row_id: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, path: str | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``:
    for each anchor (rows where ``anchor`` holds) and each of its first ``positives`` other
    rows of the same label, the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    ``path`` is where the block index goes (default: the session's shared folder)."""
    spark = vectors.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/vector-blocks-{uuid.uuid4().hex}"
    dims = index(vectors, path, row_id, vector, label, anchor, positives)
    blocks = spark.read.schema(from_arrow_schema(BLOCKS)).parquet(path)
    a = blocks.where(F.size("anchors") > 0).select("block", "label", F.explode("anchors").alias("a")).select(
        (F.col("block") * SLOTS + F.col("a.slot")).alias("anchor"), "label", F.col("a.vector").alias("vector"), F.col("a.id").alias("anchor_id"),
        F.col("a.reached").alias("reached"))
    bound = F.lit(LIMIT).cast("long")
    open_windows = a.select("anchor", "label", "vector", F.array(F.coalesce("reached", -bound)).alias("low"), F.array(bound).alias("high"))
    best = cut(_search(open_windows, blocks, dims, True, positives).select(
        "anchor", F.col("rank").alias("nth"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    # windows by the place of the positive; a missing one is empty
    score = [F.max(F.when(F.col("nth") == k + 1, F.col("positive_score"))) for k in range(positives)]
    lows = F.array(*[F.coalesce(-_hundredth(s * -low), F.lit(1)) for s in score])
    highs = F.array(*[F.coalesce(_hundredth(s * high), F.lit(0)) for s in score])
    windows = best.groupBy("anchor").agg(lows.alias("low"), highs.alias("high"))
    closed = a.join(windows, "anchor").select("anchor", "label", "vector", "low", "high")
    hard = _search(closed, blocks, dims, False, negatives).withColumn("nth", F.col("nth") + 1)
    return hard.join(best, ["anchor", "nth"]).join(a.select("anchor", "anchor_id"), "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))

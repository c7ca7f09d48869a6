"""K-d tree sharding by bytes.

The documents are points of a metadata space (by default language, source,
length and id).  A node that stands for ``k`` shards is split along its widest
dimension (its range over the root's range) at the distributed weighted
quantile that leaves ``floor(k / 2) / k`` of its bytes on the left, a median
for even ``k``; leaves stand for one shard and hold the target bytes.  The
quantile is found by repeated histograms: one row per node and bin reaches the
driver, never more.  Where one value holds the quantile (a hot source, equal
documents), its rows are split by a hash of their row number, so shards are
near equal whatever the ties.

Text is read once, into a narrow checkpointed table (id, size, digest,
dimensions); all else runs on that table.  Slots are numbered per shard in two
levels: offsets of (shard, partition), then the rows of one such group.

Defined results: a null text has 8 bytes and digest 0; null dimensions sort
first; repeated rows are separate rows (each with its own slot); an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut

BINS = 2048
#: A split point is fine enough when its bin holds this share of a shard.
CLOSE = 0.001
HASH_MAX = (1 << 62) - 1


def ordinal(df: DataFrame, name: str) -> Column:
    """A dimension as an order-preserving long: numbers as they are, strings
    by their first seven bytes."""
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind == "string":
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(0))
    return F.coalesce(c.cast("long"), F.lit(-1))


class Node:
    def __init__(self, where: Column, first: int, shards: int):
        self.where, self.first, self.shards = where, first, shards


class Search:
    """The search for one node's split point: first along the dimension, then
    among the rows of one value by their hash."""

    def __init__(self, dim: str, lo: int, hi: int, want: float, close: float):
        self.key, self.dim, self.lo, self.hi = dim, dim, lo, hi
        self.value, self.left, self.want, self.close, self.done = None, 0, want, close, None

    def active(self) -> Column:
        inside = F.col(self.key).between(self.lo, self.hi)
        return inside if self.value is None else (F.col(self.dim) == self.value) & inside

    def width(self) -> int:
        return (self.hi - self.lo) // BINS + 1

    def bin(self) -> Column:
        return F.expr(f"({self.key} - {self.lo}L) div {self.width()}L")

    def narrow(self, sums: dict[int, int]):
        """Go to the bin that holds the wanted weight."""
        width, at = self.width(), 0
        last = max(sums)
        for b in sorted(sums):
            at = b
            if self.left + sums[b] >= self.want or b == last:
                break
            self.left += sums[b]
        lo, hi = self.lo + at * width, min(self.hi, self.lo + (at + 1) * width - 1)
        if sums[at] <= self.close or (lo == hi and self.value is not None):
            near_end = self.left + sums[at] - self.want < self.want - self.left
            self.done = hi + 1 if near_end else lo
        elif lo == hi:
            self.value, self.key, self.lo, self.hi = lo, "tie", 0, HASH_MAX
        else:
            self.lo, self.hi = lo, hi

    def goes_left(self) -> Column:
        if self.value is None:
            return F.col(self.dim) < F.lit(self.done)
        return (F.col(self.dim) < F.lit(self.value)) | ((F.col(self.dim) == F.lit(self.value)) & (F.col("tie") < F.lit(self.done)))


def label(nodes: list[Node], value) -> Column:
    out = F.lit(None)
    for i, n in enumerate(nodes):
        out = F.when(n.where, value(i, n)).otherwise(out) if i else F.when(n.where, value(i, n))
    return out


def shard_documents(docs: DataFrame, n_shards: int = 24, dims: tuple[str, ...] = ("lang", "source", "n_chars", "doc_id"),
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` per row."""
    xs = [f"x{i}" for i in range(len(dims))]
    text = F.col(f"`{text_col}`")
    points = cut(docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        *(ordinal(docs, d).alias(x) for d, x in zip(dims, xs))))
    # the checkpoint fixes partitions and row order, hence the row numbers
    rows = points.withColumn("rid", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()).withColumn(
        "tie", F.shiftrightunsigned(F.xxhash64("rid"), 2))

    nodes, leaves, ranges = [Node(F.lit(True), 0, n_shards)], [], None
    while nodes:
        stats = {r["node"]: r for r in rows.groupBy(label(nodes, lambda i, n: F.lit(i)).alias("node")).agg(
            F.sum("size").alias("size"), *(F.min(x).alias(f"lo_{x}") for x in xs),
            *(F.max(x).alias(f"hi_{x}") for x in xs)).collect() if r["node"] is not None}  # a row per node
        spans = {i: {x: stats[i][f"hi_{x}"] - stats[i][f"lo_{x}"] for x in xs} for i in stats}
        ranges = ranges or spans.get(0)
        searches = {}
        for i, s in stats.items():
            if nodes[i].shards > 1:
                dim = max(xs, key=lambda x: spans[i][x] / max(1, ranges[x]))
                share = nodes[i].shards // 2 / nodes[i].shards
                searches[i] = Search(dim, s[f"lo_{dim}"], s[f"hi_{dim}"], s["size"] * share,
                                     CLOSE * s["size"] / nodes[i].shards)
        while open_ := {i: s for i, s in searches.items() if s.done is None}:
            picked = [Node(nodes[i].where & s.active(), i, 0) for i, s in open_.items()]
            order = list(open_)
            hist = rows.select("size", label(picked, lambda k, n: F.lit(order[k])).alias("node"),
                               label(picked, lambda k, n: open_[order[k]].bin()).alias("bin")).where(
                "node is not null").groupBy("node", "bin").agg(F.sum("size").alias("size"))
            sums: dict[int, dict[int, int]] = {}
            for r in hist.collect():  # at most nodes * BINS rows
                sums.setdefault(r["node"], {})[r["bin"]] = r["size"]
            for i, s in open_.items():
                s.narrow(sums[i])
        grown = []
        for i, n in enumerate(nodes):
            if i in searches:
                left, k = searches[i].goes_left(), n.shards // 2
                grown += [Node(n.where & left, n.first, k), Node(n.where & ~left, n.first + k, n.shards - k)]
            else:
                leaves.append(n)
        nodes = [n for n in grown if n.shards > 1]
        leaves += [n for n in grown if n.shards == 1]

    placed = rows.select("id", "size", "text_crc32", "rid", "part",
                         label(leaves, lambda i, n: F.lit(n.first)).cast("int").alias("shard"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").count().select(
        "shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))  # a row per shard and partition
    own = Window.partitionBy("shard", "part").orderBy("rid")
    return placed.withColumn("at", F.row_number().over(own)).join(offsets, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))

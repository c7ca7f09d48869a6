"""User-supplied BPE merges (T2 option): encode with them and decode again.

The merges are a table ``rank, left, right`` and the ids a table ``token, id``, read
from a tokenizer file or given by the caller; nothing is trained here.

* Rows are rewritten where they are (Arrow batches, in blocks of a bounded number of pieces): no explode,
  join, shuffle or table on the way.  Both tables are held by the tasks (``MAX_TABLE`` rows at most: they are
  parameters, not data).
* Per block only the distinct pieces are looked up, and the merges run once per distinct piece of a task as long as
  ``KEPT_BYTES`` hold its pieces; of more, those met last are kept.  A piece keeps its neighbours in a linked
  list and its possible merges in a heap, so a long piece costs n log n.
* Ids are decoded the same way; above ``MAX_TABLE`` tokens by a join of each block's distinct ids (``tokens._by_blocks``).

Byte-level tables spell the bytes of UTF-8 as printable characters: bytes that are
printable Latin-1 characters as themselves, the others as the characters from 256 on.

Defined cases: a null or empty text has no ids; a symbol without an id gives -1;
ids without a token decode to nothing that is text: a replacement character; keys may repeat or be null.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import pieces
from tessera.operators.tokens import BLOCK_VALUES, _by_blocks
from tessera.session import cut_table

MAX_TABLE = 2_000_000          # rows of a merges or token table
KEPT_BYTES = 64 << 20          # about what the encoded pieces that a task keeps may take
UNKNOWN = "EFBFBD"             # hex of the replacement character


@dataclass
class Bpe:
    merges: DataFrame           # rank BIGINT, left STRING, right STRING
    tokens: DataFrame           # token STRING, id BIGINT
    byte_level: bool = True


def read_bpe(spark: SparkSession, path: str, byte_level: bool = True) -> Bpe:
    """Merges and token ids of a tokenizer file (JSON with ``model.merges`` as pairs
    or as "left right", and ``model.vocab``)."""
    doc = spark.read.text(path, wholetext=True)
    merges = F.get_json_object("value", "$.model.merges")
    split = F.transform(F.from_json(merges, "array<string>"), lambda m: F.split(m, " ", 2))
    pairs = F.when(merges.startswith("[["), F.from_json(merges, "array<array<string>>")).otherwise(split)
    table = doc.select(F.posexplode(pairs).alias("rank", "m")).select(
        F.col("rank").cast("long").alias("rank"), F.col("m")[0].alias("left"), F.col("m")[1].alias("right"))
    ids = doc.select(F.explode(F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,bigint>")).alias("token", "id"))
    return Bpe(table, ids, byte_level)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(printable)]
    return [chr(256 + rest.index(b)) if b in set(rest) else chr(b) for b in range(256)]


def merge(symbols: list[str], ranks: dict) -> list[str]:
    """Join neighbours in the order of their ranks, equal ranks from the left."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = left + right, ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (symbols[a], symbols[b]) in ranks:
                heapq.heappush(heap, (ranks[symbols[a], symbols[b]], a, (symbols[a], symbols[b])))
    return [s for s in symbols if s]


def _collected(table: DataFrame, what: str) -> list:
    rows = table.limit(MAX_TABLE + 1).collect()
    if len(rows) > MAX_TABLE:
        raise ValueError(f"more than {MAX_TABLE} {what}")
    return rows


class _Kept:
    """Ids by piece in bounded memory: of the pieces beyond it, those met last stay."""

    def __init__(self, make):
        self.make, self.new, self.old, self.size = make, {}, {}, 0

    def get(self, piece: str) -> list:
        ids = self.new.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                ids = self.make(piece)
            self.size += 200 + 4 * len(piece) + 8 * len(ids)
            if self.size > KEPT_BYTES // 2:
                self.new, self.old, self.size = {}, self.new, 0
            self.new[piece] = ids
        return ids


def _blocks(batches, values: str):
    """``(rows, their lists)``: slices of the batches with ``BLOCK_VALUES`` values or one row."""
    import numpy as np
    for b in batches:
        ends = np.cumsum(np.asarray(b.column(b.schema.get_field_index(values)).value_lengths().fill_null(0)), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = max(int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + BLOCK_VALUES, "right")), at + 1)
            part = b.slice(at, to - at)
            yield part, part.column(part.schema.get_field_index(values))
            at = to


def _in_place(df: DataFrame, values: str, out: str, kind: T.DataType, rewrite) -> DataFrame:
    """``df`` with its lists ``values`` replaced by ``out``: ``rewrite()``, once per task, gives the function of a block's lists."""
    names = [f.name for f in df.schema.fields if f.name != values]

    def run(batches):
        import pyarrow as pa
        new = rewrite()
        for rows, lists in _blocks(batches, values):
            kept = [rows.column(rows.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, new(lists)], names=[*names, out])
    return df.mapInArrow(run, T.StructType([*(f for f in df.schema.fields if f.name != values), T.StructField(out, kind)]))


def encode_bpe(df: DataFrame, bpe: Bpe, key, text: str = "text", out: str = "ids") -> DataFrame:
    """``*key, out ARRAY<BIGINT>`` per row of ``df``."""
    keys = [key] if isinstance(key, str) else list(key)
    ranks: dict = {}
    for r in _collected(bpe.merges, "merges"):
        p = (r["left"], r["right"])
        ranks[p] = min(r["rank"], ranks.get(p, r["rank"]))
    shared = df.sparkSession.sparkContext.broadcast((ranks, {r["token"]: r["id"] for r in _collected(bpe.tokens, "tokens")}))
    byte_level = bpe.byte_level

    def rewrite():
        import numpy as np
        import pyarrow as pa
        ranks, known = shared.value
        alphabet = byte_alphabet()

        def make(piece):
            symbols = [alphabet[x] for x in piece.encode()] if byte_level else list(piece)
            return [known.get(s, -1) for s in merge(symbols, ranks)]
        kept = _Kept(make)

        def new(lists):
            coded = lists.flatten().dictionary_encode()
            answers = pa.array([kept.get(p) for p in coded.dictionary.to_pylist()], pa.list_(pa.int64()))
            found = answers.take(coded.indices)
            ends = np.append(0, np.cumsum(np.asarray(found.value_lengths()), dtype=np.int64))
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            return pa.ListArray.from_arrays(pa.array(ends[np.append(0, np.cumsum(sizes))], pa.int32()), found.flatten())
        return new
    rows = df.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(keys)], pieces(F.col(text)).alias("_pcs"))
    done = _in_place(rows, "_pcs", "_ids", T.ArrayType(T.LongType()), rewrite)
    return done.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(keys)], F.col("_ids").alias(out))


def decode_bpe(df: DataFrame, bpe: Bpe, key, ids: str = "ids", out: str = "text") -> DataFrame:
    """``*key, out`` per row of ``df``: the tokens of the ids, put together as bytes."""
    keys = [key] if isinstance(key, str) else list(key)
    if bpe.byte_level:  # a character of the alphabet back to its byte, in one translation per token
        alphabet = byte_alphabet()
        at = F.transform(F.split("token", ""), lambda c: F.array_position(F.array(*[F.lit(c) for c in alphabet]), c) - 1)
        spelled = F.array_join(F.transform(at, lambda b: F.lpad(F.hex(b), 2, "0")), "")
    else:
        spelled = F.hex("token")
    spelled = F.coalesce(spelled, F.lit(UNKNOWN))
    side = cut_table(bpe.tokens.where("id is not null").groupBy(F.col("id").alias("_id")).agg(
        F.unhex(F.array_join(F.array_sort(F.collect_list(spelled)), "")).alias("_bytes")))
    rows = df.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(keys)], F.col(ids).cast("array<bigint>").alias("_ids"))

    def joined(lists, places, answers):
        """The bytes at ``places`` of ``answers``, list by list; the last of ``answers`` stands for nulls."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        ends = np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0))))
        offsets = pa.array(ends, pa.int32(), mask=np.append(np.asarray(lists.is_null()), False))
        found = answers.fill_null(bytes.fromhex(UNKNOWN)).take(pa.array(places, pa.int64()))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, found), pa.scalar(b"", pa.binary()))

    if side.count() > MAX_TABLE:
        import numpy as np
        done = _by_blocks(rows, side, "_ids", "_id", "_bytes", "_text", T.BinaryType(),
                          lambda lists, codes, answers: joined(lists, np.where(codes < 0, len(answers) - 1, codes), answers))
    else:
        shared = df.sparkSession.sparkContext.broadcast({r["_id"]: bytes(r["_bytes"]) for r in side.collect()})

        def rewrite():
            import numpy as np
            import pyarrow as pa
            known = shared.value

            def new(lists):
                coded = lists.flatten().dictionary_encode()
                answers = pa.array([*map(known.get, coded.dictionary.to_pylist()), None], pa.binary())
                return joined(lists, coded.indices.fill_null(len(answers) - 1).to_numpy(zero_copy_only=False).astype(np.int64), answers)
            return new
        done = _in_place(rows, "_ids", "_text", T.BinaryType(), rewrite)
    return done.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(keys)], F.make_valid_utf8(F.col("_text").cast("string")).alias(out))

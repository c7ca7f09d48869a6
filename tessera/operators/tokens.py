"""Pieces, corpus vocabulary, encode / decode.

The pre-trained GPT-2 vocabulary is not available, so ids come from a
*corpus vocabulary*: every distinct piece, ranked by (count desc, piece asc),
id = rank - 1; the end-of-text id is the vocabulary size.  Pre-tokenization
(pieces) is the exact public GPT-2 pattern.

Scale notes
* Vocabulary: ``groupBy(piece)`` with map-side partial counts, then a
  distributed rank (``ordering.global_index``), never a one-task window.
* Encode: a vocabulary of a counted ``IN_PLACE_MAX_PIECES`` or less is sent to the
  tasks, and rows become ids where they are (Arrow batches, distinct pieces looked up once):
  no explode, join or shuffle.  Above that, and to decode, rows come in blocks of a bounded number of
  pieces: the distinct pieces of a block are joined to the vocabulary, the rows are rewritten where block and
  answers meet (``_by_blocks``).  Pieces never become rows, so nothing is regrouped, and the caller's
  keys may repeat or be null.
* Windows and blocks are encoded straight from the pieces (``encode_fragments``):
  offsets are known from piece counts, so ids cross one shuffle, to their window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import pieces
from tessera.operators.ordering import global_index
from tessera.session import cut_table

END_OF_TEXT = "<|endoftext|>"          # fixed value: text of the end-of-text id
BROADCAST_MAX_PIECES = 2_000_000       # vocabulary rows that may be broadcast
IN_PLACE_MAX_PIECES = 500_000          # vocabulary rows that Python tasks may hold
EXPLODED_MAX_PIECES = 500_000          # vocabulary rows up to which fragments may be exploded, where tasks may hold fewer in Python
MAX_PIECES = (1 << 32) - 2
UNKNOWN = "\ufffd"


def _pieces_of(df: DataFrame, text: str | None, pieces_col: str | None):
    return F.col(pieces_col) if pieces_col else pieces(F.col(text))


def piece_counts(df: DataFrame, text: str = "text", pieces_col: str | None = None) -> DataFrame:
    """``piece, n``: map-side partial counts, so a hot piece is folded
    before the shuffle.  A null piece (an end-of-text mark) doesn't count."""
    return (df.select(F.explode(_pieces_of(df, text, pieces_col)).alias("piece")).where(F.col("piece").isNotNull())
            .groupBy("piece").agg(F.count(F.lit(1)).alias("n")))


def build_vocab(df: DataFrame, text: str = "text", pieces_col: str | None = None) -> DataFrame:
    """``piece STRING, n BIGINT, id BIGINT`` over all distinct pieces.

    The counts are written once (the distributed rank reads them twice); the
    rank itself comes from a written table, so every consumer (size check,
    encode, decode) reads stored rows instead of recounting the corpus."""
    counts = cut_table(piece_counts(df, text, pieces_col).withColumn("_neg_n", -F.col("n")))
    ranked = global_index(counts, ["_neg_n", "piece"], out="_rank", store=cut_table)
    # written once more: each broadcast of the vocabulary would otherwise
    # re-run the rank's join with the partition bases
    return cut_table(ranked.select("piece", "n", (F.col("_rank") - 1).alias("id")))


BLOCK_VALUES = 1 << 20                 # values of a block of rows: what one task holds at a time


def _coded_blocks(names: list[str], values: str):
    """Arrow batches -> their rows with ``values`` as places in the list of their block's distinct values
    (``_codes``; -1 for null), and behind each block one row with that list (``_entries``)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 40
        for b in batches:
            lists = b.column(b.schema.get_field_index(values))
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(int(np.searchsorted(ends, before + BLOCK_VALUES, "right")), at + 1)
                part, rows = lists.slice(at, to - at), b.slice(at, to - at)
                coded = part.flatten().dictionary_encode()
                codes = coded.indices.cast(pa.int32()).fill_null(-1)
                offsets = pa.array(np.concatenate([[0], ends[at:to] - before]), pa.int32(), mask=np.append(np.asarray(part.is_null()), False))
                n, kept = to - at, [rows.column(rows.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *kept, pa.array(np.ones(n, bool)), pa.ListArray.from_arrays(offsets, codes),
                                                  pa.nulls(n, part.type)], names=["_block", *names, "_is_row", "_codes", "_entries"])
                entries = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary).cast(part.type)
                yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.nulls(1, c.type) for c in kept), pa.array([False]),
                                                  pa.nulls(1, pa.list_(pa.int32())), entries], names=["_block", *names, "_is_row", "_codes", "_entries"])
                block, at = block + 1, to
    return run


def _by_blocks(df: DataFrame, side: DataFrame, values: str, key: str, value: str, out: str, kind: T.DataType, finish) -> DataFrame:
    """``df`` with its lists ``values`` replaced by ``out``, each value looked up in ``side`` (``key`` -> ``value``),
    whatever the size of either.  Rows come in blocks of a bounded number of values; a block's distinct values, not
    its values, are joined to ``side``, and block and answers meet in one task.  Values never become rows, so no join,
    sort or regroup grows with them.  ``finish(lists of places, answers)`` makes the column: the answers hold a
    null where ``side`` has none, and one more at the end for nulls in the lists."""
    kept = [f for f in df.schema.fields if f.name != values]
    names = [f.name for f in kept]
    plain = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("_block", T.LongType()), *(T.StructField(f.name, f.dataType) for f in kept), T.StructField("_is_row", T.BooleanType()),
                           T.StructField("_codes", plain), T.StructField("_entries", df.schema[values].dataType)])
    stored = cut_table(df.mapInArrow(_coded_blocks(names, values), schema))
    rows = stored.where("_is_row").select("_block", *names, "_codes")
    asked = stored.where(~F.col("_is_row")).select("_block", F.posexplode("_entries").alias("_code", key))
    known = asked.join(side.select(key, value), key).select(F.col("_block").alias("_of"), "_code", value)
    fields = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), T.StructField(out, kind)])

    def solve(left, right):
        import numpy as np
        import pyarrow as pa
        left = left.combine_chunks()
        lists = left.column("_codes").combine_chunks() if left.num_rows else pa.array([], pa.list_(pa.int32()))
        codes = np.asarray(lists.flatten())
        size = int(codes.max(initial=-1)) + 1
        found = np.full(size, -1, np.int64)
        found[right.column("_code").to_numpy()] = np.arange(right.num_rows)
        # the last place is the one of nulls: a code of -1
        answers = pa.concat_arrays([right.column(value).combine_chunks().take(pa.array(found, mask=found < 0)),
                                    pa.nulls(1, right.schema.field(value).type)])
        return pa.Table.from_arrays([*(left.column(c) for c in names), finish(lists, codes, answers)], names=[*names, out])
    return rows.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(solve, fields)


def ids_by_blocks(df: DataFrame, vocab: DataFrame, pcs: str, out: str, eos_id: int | None = None) -> DataFrame:
    """Like ``ids_in_place`` for a vocabulary of any size (``_by_blocks``)."""
    end = -1 if eos_id is None else eos_id

    def finish(lists, codes, answers):
        import numpy as np
        import pyarrow as pa
        of = answers.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        of[-1] = end
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(of[codes], pa.int64()))
    return _by_blocks(df, vocab, pcs, "piece", "id", out, T.ArrayType(T.LongType()), finish)


def _packed(pos: Column, value: Column) -> Column:
    """(position, id + 1) as one bigint: the regroup collects and sorts primitive
    longs instead of structs (measured ~10-20% faster).  Ids up to 2^32 - 2."""
    return F.shiftleft(pos.cast("long"), 32).bitwiseOR(value + 1)


def _unpacked(items: Column) -> Column:
    return F.transform(F.array_sort(items), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)) - 1)


def _ids_of(ex: DataFrame, vocab: DataFrame, keys: list[str], eos_id: int, out: str) -> DataFrame:
    """Rows (keys, pos, piece) -> one row of ids per ``keys``, by a broadcast of the vocabulary.  A piece
    outside the vocabulary gives -1, a null piece the end-of-text id."""
    j = ex.join(F.broadcast(vocab.select("piece", F.col("id").alias("_vid"))), "piece", "left")
    known = F.when(F.col("piece").isNull(), F.lit(eos_id).cast("long")).otherwise(F.coalesce(F.col("_vid"), F.lit(-1).cast("long")))
    return j.groupBy(*keys).agg(_unpacked(F.collect_list(_packed(F.col("pos"), known))).alias(out))


def ids_in_place(df: DataFrame, vocab: DataFrame, pcs: str, out: str, eos_id: int | None = None) -> DataFrame:
    """``pcs`` of every row replaced by its ids ``out``, where the rows are: no join, no shuffle.  The
    vocabulary (at most ``IN_PLACE_MAX_PIECES``, counted by the caller) is broadcast to the tasks; per Arrow
    batch only the distinct pieces are looked up."""
    table = {r["piece"]: r["id"] for r in vocab.select("piece", "id").collect()}
    shared = df.sparkSession.sparkContext.broadcast(table)
    end = -1 if eos_id is None else eos_id

    def run(batches):
        import numpy as np
        import pyarrow as pa
        known = shared.value
        for b in batches:
            at = b.schema.get_field_index(pcs)
            lists = b.column(at)
            coded = lists.flatten().dictionary_encode()
            places = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            of = np.array([known.get(p, -1) for p in coded.dictionary.to_pylist()] + [end], np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(of[places], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != at), ids],
                                             names=[*(n for k, n in enumerate(b.schema.names) if k != at), out])
    schema = T.StructType([*(f for f in df.schema.fields if f.name != pcs), T.StructField(out, T.ArrayType(T.LongType()))])
    return df.mapInArrow(run, schema)


def with_end(pieces_col: Column, ends: Column) -> Column:
    """Pieces with the end-of-text mark (a null piece) behind them where ``ends``."""
    return F.when(ends, F.concat(pieces_col, F.array(F.lit(None).cast("string")))).otherwise(pieces_col)


def encode(df: DataFrame, vocab: DataFrame, key, text: str = "text",
           eos_id: int | None = None, carry: list[str] | None = None,
           out: str = "ids", broadcast_max: int = BROADCAST_MAX_PIECES,
           eos_col: str | None = None, pieces_col: str | None = None,
           vocab_rows: int | None = None, row: str | None = None) -> DataFrame:
    """``*key, *carry, out ARRAY<BIGINT>`` per row of ``df`` — the ids of the pieces of
    ``text`` in order.  ``eos_id`` is appended to every row, or only to rows whose
    boolean ``eos_col`` is true when that is given; a null in a given
    ``pieces_col`` is an end of text too.  Keys may repeat or be null: rows are never
    told apart by them, nor need a number (``row`` is not looked at)."""
    keys = [key] if isinstance(key, str) else list(key)
    carry = list(carry or [])
    if eos_col and eos_col not in carry:
        carry.append(eos_col)
    kept = [*keys, *(c for c in carry if c not in keys)]
    mark = eos_id if pieces_col else None
    vocab_rows = vocab.count() if vocab_rows is None else vocab_rows
    if vocab_rows > MAX_PIECES:
        raise ValueError(f"{vocab_rows} pieces: ids must stay below 2^32 - 1")
    src = df.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(kept)], _pieces_of(df, text, pieces_col).alias("_pcs"))
    coded = ids_in_place if vocab_rows <= min(broadcast_max, IN_PLACE_MAX_PIECES) else ids_by_blocks
    g = coded(src, vocab, "_pcs", "_ids", mark).select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(kept)], F.col("_ids").alias(out))
    if eos_id is not None:
        tail = F.concat(F.col(out), F.array(F.lit(eos_id).cast("long")))
        g = g.withColumn(out, F.when(F.col(eos_col), tail).otherwise(F.col(out)) if eos_col else tail if not pieces_col else F.col(out))
    return g.select(*kept, out)


def encode_fragments(fragments: DataFrame, vocab: DataFrame, keys: list[str], slot: str, pcs: str, eos_id: int,
                     broadcast_max: int = BROADCAST_MAX_PIECES, vocab_rows: int | None = None, out: str = "ids") -> DataFrame:
    """``*keys, out``: the ids of all fragments of a key in the order of their
    places (``slot`` is the place of a fragment's first piece).  The pieces become ids and
    meet under their key in one shuffle."""
    size = vocab.count() if vocab_rows is None else vocab_rows
    if IN_PLACE_MAX_PIECES < size <= min(broadcast_max, EXPLODED_MAX_PIECES):
        ex = fragments.select(*keys, slot, F.posexplode(pcs).alias("_at", "piece"))
        return _ids_of(ex.select(*keys, (F.col(slot) + F.col("_at")).alias("pos"), "piece"), vocab, keys, eos_id, out)
    coded = ids_in_place if size <= min(broadcast_max, IN_PLACE_MAX_PIECES) else ids_by_blocks
    rows = coded(fragments.select(*keys, slot, pcs), vocab, pcs, "_ids", eos_id)
    pieces_ = F.array_sort(F.collect_list(F.struct(F.col(slot).alias("s"), F.col("_ids").alias("i"))))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(pieces_, lambda x: x["i"])).alias(out))


def decode(df: DataFrame, vocab: DataFrame, key, ids: str = "ids",
           out: str = "text", broadcast_max: int = BROADCAST_MAX_PIECES, row: str | None = None) -> DataFrame:
    """Ids back to text, per row of ``df``; the end-of-text id (vocabulary size) becomes
    ``<|endoftext|>``, an id that the vocabulary doesn't have a replacement
    character.  A null array gives null."""
    keys = [key] if isinstance(key, str) else list(key)
    size = vocab.count()
    src = df.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col(ids).cast("array<bigint>").alias("_ids"))
    side = vocab.select("id", "piece").unionByName(df.sparkSession.createDataFrame([(size, END_OF_TEXT)], "id long, piece string"))

    def finish(lists, codes, answers):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        texts = answers.fill_null(UNKNOWN).take(pa.array(np.where(codes < 0, len(answers) - 1, codes), pa.int64()))
        ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
        offsets = pa.array(ends, pa.int32(), mask=np.append(np.asarray(lists.is_null()), False))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, texts), "")
    back = _by_blocks(src, side, "_ids", "id", "piece", "_text", T.StringType(), finish)
    return back.select(*[F.col(f"_c{i}").alias(k) for i, k in enumerate(keys)], F.col("_text").alias(out))

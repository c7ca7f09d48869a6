"""The corpus plan: four sources -> rendered documents -> one ordered stream.

Spark shape (no driver-side data, no single-task step):

  sources -> clean / filter / render (narrow)  -> unionByName with an order key
          -> range shuffle on the order -> pieces, their counts, running offsets (one pass, stored)
          -> vocabulary (shuffle on piece, distributed rank)
          -> split and window fragments of pieces (narrow) -> ids by broadcast or
          skew-aware join -> windows (the one shuffle of ids)

Source order in the stream is fixed: books, chats, pairs, articles.  Inside a
source: books by path string, the others by id.  Books get no end-of-text id;
every other document gets one (as in the original pipeline).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import render as RD
from tessera.operators.cleaning import clean_book
from tessera.sources import tables as S

SOURCES = ("book", "chat", "pair", "article")       # fixed stream order


def _tag(df: DataFrame, name: str, okey, ident, eos: bool) -> DataFrame:
    return df.select(
        F.lit(name).alias("source"),
        F.lit(SOURCES.index(name)).alias("source_ord"),
        okey.alias("okey"),
        ident.cast("bigint").alias("id"),
        F.col("text"),
        F.lit(eos).alias("eos"))


def book_docs(spark: SparkSession, sf_dir: str, end_rule: str = "intended") -> DataFrame:
    b = clean_book(S.book_rows(spark, sf_dir), end_rule=end_rule).where("text <> ''")
    return _tag(b, "book", F.col("path"), F.col("doc_id"), False)


def chat_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = RD.render_chat(S.chat_rows(spark, sf_dir))
    return _tag(c, "chat", F.lit(""), F.col("conv_id"), True)


def pair_docs(spark: SparkSession, sf_dir: str, cap: int | None = None) -> DataFrame:
    """All pairs; with ``cap`` the first so many (rejects count against it)."""
    from tessera.operators.sampling import first_n
    p = S.pair_rows(spark, sf_dir)
    p = RD.render_pair(p if cap is None else first_n(p, cap, "id"))
    return _tag(p, "pair", F.lit(""), F.col("id"), True)


def article_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = RD.render_article(S.article_rows(spark, sf_dir), end_marker=False)
    return _tag(a, "article", F.lit(""), F.col("id"), True)


def rendered_sources(spark: SparkSession, sf_dir: str, include=SOURCES) -> DataFrame:
    """``source, source_ord, okey, id, text, eos`` for every kept document."""
    parts = {
        "book": book_docs, "chat": chat_docs, "pair": pair_docs, "article": article_docs,
    }
    dfs = [parts[s](spark, sf_dir) for s in SOURCES if s in include]
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


# ---------------------------------------------------------------------------
# Token stream
# ---------------------------------------------------------------------------
UNIT_ORDER = ["source_ord", "okey", "id", "part_no"]
WINDOW = 256                 # packed window length
TRAIN_SPLIT = 0.8


def stream_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodable units in stream order: every kept document is one unit,
    whatever its length.  ``eos`` marks the units that end with an end-of-text
    id; a book, which has none, ends with an empty line instead."""
    docs = rendered_sources(spark, sf_dir)
    ended = F.when(F.col("source") == "book", F.concat("text", F.lit("\n\n"))).otherwise(F.col("text"))
    return docs.select("source", "source_ord", "okey", "id", F.lit(0).cast("bigint").alias("part_no"),
                       ended.alias("part"), "eos")


def counted(units: DataFrame) -> DataFrame:
    """Units (``*UNIT_ORDER, source, part, eos``) in stream order: ``*UNIT_ORDER, source, pcs, n,
    offset, row``.  ``pcs`` ends with a null piece where the unit ends with an
    end-of-text id, ``n`` is its size: offsets need no ids.  One shuffle by range, one regex pass,
    written once as a table, so that counts read only the columns of counts."""
    from tessera.functions.text import pieces
    from tessera.operators.ordering import ranged, running_sum
    from tessera.operators.tokens import with_end
    from tessera.session import cut_table
    rows = ranged(units, UNIT_ORDER).select(*UNIT_ORDER, "source", with_end(pieces(F.col("part")), F.col("eos")).alias("pcs"))
    return running_sum(rows.withColumn("n", F.size("pcs").cast("bigint")), "n", "offset", row="row", store=cut_table)


def counted_stream(spark: SparkSession, sf_dir: str, units: DataFrame | None = None) -> DataFrame:
    return counted(units if units is not None else stream_units(spark, sf_dir))


def stream_totals(rows: DataFrame, frac: float = TRAIN_SPLIT) -> dict[str, int]:
    """The stream's length per split, from piece counts."""
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cut = int(total * frac)
    return {"train": cut, "val": total - cut}


def encoded_stream(spark: SparkSession, sf_dir: str, units: DataFrame | None = None):
    """``(vocab, encoded, eos_id)``: encoded units carry ``source``, ``offset`` and ``ids``."""
    from tessera.operators.tokens import build_vocab, encode
    rows = counted_stream(spark, sf_dir, units)
    vocab = build_vocab(rows, pieces_col="pcs")
    eos_id = vocab.count()
    enc = encode(rows, vocab, UNIT_ORDER, eos_id=eos_id, carry=["source", "offset"],
                 pieces_col="pcs", vocab_rows=eos_id, row="row")
    return vocab, enc, eos_id


def runs_of(rows: DataFrame, size: int, halo: int = 0, frac: float = TRAIN_SPLIT):
    """``(runs, totals, eos_id)`` of ``counted`` units: the ids of every run of ``size`` (and
    ``halo`` of the next) of each split as ``split, seq, ids``, the last run of a split
    being what is left."""
    from tessera.operators.packing import fragments, split_stream
    from tessera.operators.tokens import build_vocab, encode_fragments
    vocab = build_vocab(rows, pieces_col="pcs")
    eos_id = vocab.count()
    totals = stream_totals(rows, frac)
    parts = split_stream(rows.select("offset", "pcs"), frac, sum(totals.values()), ids="pcs")
    runs = encode_fragments(fragments(parts, size, halo), vocab, ["split", "seq"], "slot", "pcs", eos_id, vocab_rows=eos_id)
    return runs, totals, eos_id


def stream_runs(spark: SparkSession, sf_dir: str, size: int, halo: int = 0, frac: float = TRAIN_SPLIT):
    return runs_of(counted_stream(spark, sf_dir), size, halo, frac)


def stream_parts(spark: SparkSession, sf_dir: str, frac: float = TRAIN_SPLIT):
    """``(off, parts, totals, eos_id)``: encoded units with offsets, their
    train/validation parts, the stream length per split, the end-of-text id."""
    from tessera.operators.packing import split_stream, stream_total
    from tessera.session import cut_table
    _, enc, eos_id = encoded_stream(spark, sf_dir)
    off = cut_table(enc)
    total = stream_total(off)
    cut = int(total * frac)
    return off, split_stream(off, frac, total), {"train": cut, "val": total - cut}, eos_id


def packed(spark: SparkSession, sf_dir: str, length: int = WINDOW, frac: float = TRAIN_SPLIT, tail: bool = False):
    """``(windows, runs, totals)``: windows per split, the runs of ids they
    come from, and the stream length of each split."""
    from tessera.operators.packing import shifted
    runs, totals, _ = stream_runs(spark, sf_dir, length, 1, frac)
    return shifted(runs, length, tail=tail), runs, totals

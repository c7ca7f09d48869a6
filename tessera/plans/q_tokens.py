"""Registered queries: pieces, vocabulary, encode/decode, chunkers, offsets,
split and packed windows (steps 4-5)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as CH
from tessera.operators import merges as MG
from tessera.operators.packing import checksum
from tessera.operators.tokens import build_vocab, decode
from tessera.plans import corpus as C
from tessera.plans import sqlfrag as Q
from tessera.plans.q_corpus import SQL_FILES, SQL_UNITS
from tessera.session import cut_table
from tessera.sources import tables as S

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- SQL building blocks -----------------------------------------------------------
SQL_STREAM_CTES = f"""
units AS ({SQL_UNITS}),
toks AS (SELECT source_ord, okey, id, part_no, unnest(pcs) AS piece, unnest(range(len(pcs))) AS pos
         FROM (SELECT *, {Q.pieces('part')} AS pcs FROM units)),
vocab AS (SELECT piece, count(*)::BIGINT AS n,
                 (row_number() OVER (ORDER BY count(*) DESC, piece) - 1)::BIGINT AS vid
          FROM toks GROUP BY piece),
stream AS (SELECT t.source_ord, t.okey, t.id, t.part_no, t.pos, v.vid FROM toks t JOIN vocab v ON t.piece = v.piece
           UNION ALL
           SELECT source_ord, okey, id, part_no, 1000000000 AS pos, (SELECT count(*) FROM vocab) AS vid
           FROM units WHERE eos),
enc AS (SELECT u.source, u.source_ord, u.okey, u.id, u.part_no,
               count(s.vid)::BIGINT AS n_ids, coalesce(sum(s.rn * s.vid), 0)::BIGINT AS checksum
        FROM units u LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY source_ord, okey, id, part_no ORDER BY pos) AS rn
                                FROM stream) s
          ON u.source_ord = s.source_ord AND u.okey = s.okey AND u.id = s.id AND u.part_no = s.part_no
        GROUP BY ALL)
"""


def _sql_last_end(s: str) -> str:
    return f"(CASE WHEN regexp_matches({s}, '[.!?]') THEN length(regexp_extract({s}, '^([\\s\\S]*)[.!?]', 1)) ELSE -1 END)"


# --- T1: pieces per document -------------------------------------------------------
def pieces_per_doc(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.pieces(F.col("text"))).cast("bigint").alias("n_pieces"))


register("pieces_per_doc", f"SELECT doc_id, len({Q.pieces('text')})::BIGINT AS n_pieces FROM documents")(pieces_per_doc)


# --- T2: corpus vocabulary ----------------------------------------------------------
def vocab(spark, sf_dir):
    return build_vocab(C.stream_units(spark, sf_dir), "part")


register("vocab", f"WITH {SQL_STREAM_CTES} SELECT piece, n, vid AS id FROM vocab")(vocab)


# --- T2 + T7: encoded units ----------------------------------------------------------
def encode_docs(spark, sf_dir):
    _, enc, _ = C.encoded_stream(spark, sf_dir)
    return enc.select("source", "id", "part_no", F.size("ids").cast("bigint").alias("n_ids"),
                      checksum(F.col("ids")).alias("checksum"))


register("encode_docs", f"WITH {SQL_STREAM_CTES} SELECT source, id, part_no, n_ids, checksum FROM enc")(encode_docs)


# --- T9: stream offsets ---------------------------------------------------------------
def doc_offsets(spark, sf_dir):
    return C.counted_stream(spark, sf_dir).select("source", "id", "part_no", "offset")


register("doc_offsets", f"""WITH {SQL_STREAM_CTES}
SELECT source, id, part_no,
       (sum(n_ids) OVER (ORDER BY source_ord, okey, id, part_no ROWS UNBOUNDED PRECEDING) - n_ids)::BIGINT AS offset
FROM enc""")(doc_offsets)


# --- T13: decode round trip ------------------------------------------------------------
def decode_roundtrip(spark, sf_dir):
    voc, enc, _ = C.encoded_stream(spark, sf_dir)
    dec = decode(enc, voc, ["source", "id", "part_no"], "ids", "decoded")
    return dec.select("source", "id", "part_no", F.md5("decoded").alias("digest"))


register("decode_roundtrip", f"""
SELECT source, id, part_no, md5(part || CASE WHEN eos THEN '<|endoftext|>' ELSE '' END) AS digest
FROM ({SQL_UNITS})
""")(decode_roundtrip)


# --- L7 + T10: split and packed windows ---------------------------------------------------
SQL_POSITIONS = f"""
pos AS (SELECT vid, (row_number() OVER (ORDER BY source_ord, okey, id, part_no, pos) - 1) AS p FROM stream),
tot AS (SELECT count(*) AS n, floor(count(*) * {C.TRAIN_SPLIT}::DOUBLE)::BIGINT AS s FROM pos),
sp AS (SELECT vid, CASE WHEN p < s THEN 'train' ELSE 'val' END AS split,
              CASE WHEN p < s THEN p ELSE p - s END AS q,
              CASE WHEN p < s THEN s ELSE n - s END AS m FROM pos, tot)
"""


def packed_windows(spark, sf_dir):
    return _window_sums(C.packed(spark, sf_dir)[0])


def _window_sums(windows):
    return windows.select("split", F.col("seq").cast("bigint").alias("seq"),
                          F.size("inputs").cast("bigint").alias("n_in"),
                          checksum(F.col("inputs")).alias("in_sum"), checksum(F.col("targets")).alias("tg_sum"))


def packed_tails(spark, sf_dir):
    """What is left of each split behind its last full window, as a shorter window."""
    windows = C.packed(spark, sf_dir, tail=True)[0]
    return _window_sums(windows.where(F.size("inputs") < C.WINDOW))


L = C.WINDOW
register("packed_windows", f"""WITH {SQL_STREAM_CTES}, {SQL_POSITIONS},
i AS (SELECT split, q // {L} AS seq, count(*)::BIGINT AS n_in, sum((q % {L} + 1) * vid)::BIGINT AS in_sum
      FROM sp WHERE q // {L} < (m - 1) // {L} GROUP BY ALL),
t AS (SELECT split, (q - 1) // {L} AS seq, sum(((q - 1) % {L} + 1) * vid)::BIGINT AS tg_sum
      FROM sp WHERE q >= 1 AND (q - 1) // {L} < (m - 1) // {L} GROUP BY ALL)
SELECT i.split, i.seq::BIGINT AS seq, n_in, in_sum, tg_sum FROM i JOIN t ON i.split = t.split AND i.seq = t.seq
""")(packed_windows)


register("packed_tails", f"""WITH {SQL_STREAM_CTES}, {SQL_POSITIONS}
SELECT split, (q // {L})::BIGINT AS seq, count(*) FILTER (q < m - 1)::BIGINT AS n_in,
       sum(CASE WHEN q < m - 1 THEN (q % {L} + 1) * vid END)::BIGINT AS in_sum,
       sum(CASE WHEN q % {L} > 0 THEN (q % {L}) * vid END)::BIGINT AS tg_sum
FROM sp WHERE q // {L} >= (m - 1) // {L} AND (m - 1) % {L} > 0 GROUP BY ALL
""")(packed_tails)


def train_val_tokens(spark, sf_dir):
    """From piece counts alone."""
    totals = C.stream_totals(C.counted_stream(spark, sf_dir))
    rows = [(k, m, max(m - 1, 0) // L) for k, m in totals.items() if m]
    return spark.createDataFrame(rows, "split string, tokens long, windows long")


register("train_val_tokens", f"""WITH {SQL_STREAM_CTES}, {SQL_POSITIONS}
SELECT split, count(*)::BIGINT AS tokens, ((max(m) - 1) // {L})::BIGINT AS windows FROM sp GROUP BY split
""")(train_val_tokens)


# --- T5: sentence parts of all documents ---------------------------------------------------
MIN_PART = 10


def sentence_parts(spark, sf_dir):
    b = CH.sentences(S.book_rows(spark, sf_dir, None), "text", MIN_PART, "part")
    return b.select("path", F.col("part_no").cast("bigint").alias("part_no"),
                    F.length("part").cast("bigint").alias("n_chars"),
                    F.size(T.pieces(F.col("part"))).cast("bigint").alias("n_pieces"), F.md5("part").alias("digest"))


register("sentence_parts", f"""
SELECT path, unnest(range(len(ps)))::BIGINT AS part_no, length(unnest(ps))::BIGINT AS n_chars,
       len({Q.pieces('unnest(ps)')})::BIGINT AS n_pieces, md5(unnest(ps)) AS digest
FROM (SELECT path, list_filter(list_transform({Q.sentences('text')}, lambda s: {Q.strip('s')}), lambda s: length(s) > {MIN_PART}) AS ps FROM ({SQL_FILES}))
""")(sentence_parts)


# --- T6: overlapping chunks (size lowered so several chunks per text) ---------------
OV_SIZE, OV_BACK = 1000, 200


def chunk_overlap(spark, sf_dir):
    c = CH.chunk_overlap(S.book_rows(spark, sf_dir, None), "text", OV_SIZE, OV_BACK)
    return c.select("path", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                    F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("digest"), "eos")


register("chunk_overlap", f"""
SELECT path, (i // {OV_SIZE})::BIGINT AS chunk_no, length(c)::BIGINT AS n_chars, md5(c) AS digest, eos FROM (
  SELECT path, i, i + {OV_SIZE} < n AS eos, substr(text, b + 1, i + {OV_SIZE} - b) AS c FROM (
    SELECT *, CASE WHEN i > 0 AND i + {OV_SIZE} < n AND last > 0 THEN ov + last + 1 ELSE i END AS b FROM (
      SELECT *, {_sql_last_end('substr(text, ov + 1, i - ov)')} AS last FROM (
        SELECT *, greatest(i - {OV_BACK}, 0) AS ov FROM (
          SELECT path, text, length(text) AS n, unnest(range(0, length(text), {OV_SIZE})) AS i FROM ({SQL_FILES}))))))
""")(chunk_overlap)


# --- T4 -----------------------------------------------------------------------------------
FX_SIZE, FX_WIN = 1000, 200


def chunk_fixed(spark, sf_dir):
    """Lossless: each piece starts where the previous one was cut."""
    c = CH.chunk_fixed(S.book_rows(spark, sf_dir, None), "text", FX_SIZE, FX_WIN)
    return c.select("path", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                    F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("digest"))


def _sql_cut(pos: str) -> str:
    piece = f"substr(text, {pos} + 1, {FX_SIZE})"
    ts = f"greatest(length({piece}) - {FX_WIN}, 0)"
    last = _sql_last_end(f"substr({piece}, {ts} + 1, {FX_WIN})")
    return f"(CASE WHEN {pos} + {FX_SIZE} < n AND {last} > 0 THEN {ts} + {last} + 1 ELSE length({piece}) END)"


# the chained cut points as a recursive CTE, one step per chunk
register("chunk_fixed", f"""
WITH RECURSIVE b AS (SELECT path, text, length(text) AS n FROM ({SQL_FILES})),
r(path, chunk_no, pos) AS (
  SELECT path, 0::BIGINT, 0::BIGINT FROM b WHERE n > 0
  UNION ALL
  SELECT r.path, r.chunk_no + 1, r.pos + {_sql_cut('r.pos')} FROM r JOIN b ON r.path = b.path
  WHERE r.pos + {_sql_cut('r.pos')} < b.n)
SELECT path, chunk_no, length(c)::BIGINT AS n_chars, md5(c) AS digest FROM (
  SELECT r.path, r.chunk_no, {Q.strip(f"substr(text, r.pos + 1, {_sql_cut('r.pos')})")} AS c
  FROM r JOIN b ON r.path = b.path)
""")(chunk_fixed)


# --- T3: greedy sentence chunks --------------------
GR_LIMIT = 1000


def chunk_sentences(spark, sf_dir):
    c = CH.chunk_sentences(S.book_rows(spark, sf_dir, None), "text", limit=GR_LIMIT)
    return c.select("path", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                    F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("digest"))


# the greedy packing as a recursive CTE over each text's sentences
register("chunk_sentences", f"""
WITH RECURSIVE b AS (SELECT path, text FROM ({SQL_FILES})),
s AS (SELECT path, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i
      FROM (SELECT path, {Q.sentences('text')} AS ss FROM b)),
r(path, i, cur, cid) AS (
  SELECT path, 1::BIGINT, length(s)::BIGINT, 0::BIGINT FROM s WHERE i = 1
  UNION ALL
  SELECT r.path, r.i + 1,
         CASE WHEN r.cur + length(s.s) > {GR_LIMIT} AND r.cur > 0 THEN length(s.s)
              WHEN r.cur > 0 THEN r.cur + 1 + length(s.s) ELSE length(s.s) END,
         CASE WHEN r.cur + length(s.s) > {GR_LIMIT} AND r.cur > 0 THEN r.cid + 1 ELSE r.cid END
  FROM r JOIN s ON s.path = r.path AND s.i = r.i + 1),
g AS (SELECT r.path, r.cid, {Q.strip("string_agg(s.s, ' ' ORDER BY s.i)")} AS c
      FROM r JOIN s ON s.path = r.path AND s.i = r.i GROUP BY r.path, r.cid)
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY cid) - 1)::BIGINT AS chunk_no,
       length(c)::BIGINT AS n_chars, md5(c) AS digest FROM g WHERE c <> ''
""")(chunk_sentences)


# --- T2 option: user-supplied merges -------------------------------------------------------
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(spark, sf_dir):
    """Ids by the merges of a tokenizer file, and the text they decode to."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    bpe = MG.read_bpe(spark, BPE_FILE)
    enc = MG.encode_bpe(docs, bpe, "doc_id").select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), checksum(F.col("ids")).alias("checksum"))
    # ids are read once and not stored: sums and digest of a row are known where its ids are
    done = cut_table(MG.decode_bpe(enc, bpe, ["doc_id", "n_ids", "checksum"]).select("doc_id", "n_ids", "checksum", F.md5("text").alias("digest")))
    return done.select("doc_id", "n_ids", "checksum").join(done.select("doc_id", "digest"), "doc_id")


# Symbols of a piece stand between marks; each step joins the neighbours of least rank.
register("bpe_encode", f"""
WITH RECURSIVE file AS (SELECT content::JSON AS j FROM read_text('{BPE_FILE}')),
merges AS (SELECT unnest(range(len(ms)))::BIGINT AS rank, unnest(list_transform(ms, lambda m: m[1])) AS l, unnest(list_transform(ms, lambda m: m[2])) AS r
           FROM (SELECT from_json(j->'$.model.merges', '[["VARCHAR"]]') AS ms FROM file)),
vocab AS (SELECT e.key AS token, e.value AS id FROM (SELECT unnest(map_entries((j->'$.model.vocab')::MAP(VARCHAR, BIGINT))) AS e FROM file)),
toks AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS pos FROM (SELECT doc_id, {Q.pieces('text')} AS ps FROM documents)),
hexed AS (SELECT piece, hex(encode(piece)) AS h FROM (SELECT DISTINCT piece FROM toks)),
bytes AS (SELECT piece, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT) AS bs FROM hexed),
step(piece, syms) AS (
  SELECT piece, chr(1) || array_to_string(list_transform(bs, lambda b: chr(CASE WHEN b <= 32 THEN 256 + b
    WHEN b BETWEEN 127 AND 160 THEN b + 162 WHEN b = 173 THEN 323 ELSE b END)), chr(1)) || chr(1) FROM bytes
  UNION ALL
  SELECT piece, replace(any_value(syms), chr(1) || arg_min(l, rank) || chr(1) || arg_min(r, rank) || chr(1), chr(1) || arg_min(l, rank) || arg_min(r, rank) || chr(1))
  FROM (SELECT piece, syms, unnest(a[:-2]) AS a1, unnest(a[2:]) AS a2 FROM (SELECT piece, syms, string_split(syms[2:-2], chr(1)) AS a FROM step)) s
  JOIN merges ON l = a1 AND r = a2 GROUP BY piece),
done AS (SELECT piece, arg_min(syms, length(syms)) AS syms FROM step GROUP BY piece),
pids AS (SELECT piece, list(id ORDER BY k) AS ids FROM (SELECT piece, unnest(a) AS token, unnest(range(len(a))) AS k
         FROM (SELECT piece, string_split(syms[2:-2], chr(1)) AS a FROM done)) JOIN vocab USING (token) GROUP BY piece),
flat AS (SELECT doc_id, pos, unnest(range(len(ids))) AS k, unnest(ids) AS id FROM toks JOIN pids USING (piece)),
sums AS (SELECT doc_id, count(*) AS n, sum(rn * id) AS s FROM (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS rn FROM flat) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_ids, coalesce(s, 0)::BIGINT AS checksum, md5(text) AS digest FROM documents d LEFT JOIN sums USING (doc_id)
""")(bpe_encode)

"""Registered queries: stream diagnostics and reports (A1, A3, A4-A9, A12) and
the fine-tuning batches (T8, T11, T12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as CH
from tessera.operators import packing as P
from tessera.operators import stats as ST
from tessera.plans import corpus as C
from tessera.plans import finetune as FT
from tessera.plans import sqlfrag as Q
from tessera.plans.q_corpus import SQL_FILES, SQL_PAIRS
from tessera.plans.q_tokens import SQL_POSITIONS, SQL_STREAM_CTES
from tessera.plans.q_text import SQL_RAW
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


BLOCK = 48 * 256     # fixed value: tokens per diagnostic block
L = C.WINDOW


# --- A4-A6 --------------------------------------------------------------------------
def block_diagnostics(spark, sf_dir):
    runs, _, eos_id = C.stream_runs(spark, sf_dir, BLOCK)
    b = runs.where(F.size("ids") == BLOCK).withColumnRenamed("seq", "block")
    return ST.block_diagnostics(b, eos_id).select(
        "split", F.col("block").cast("bigint").alias("block"), "n", "repetitions", "repetition_rate", "eos",
        "unique_ids", "unique_ratio")


register("block_diagnostics", f"""WITH {SQL_STREAM_CTES}, {SQL_POSITIONS},
bl AS (SELECT split, q // {BLOCK} AS block, q, vid FROM sp WHERE (q // {BLOCK} + 1) * {BLOCK} <= m),
lx AS (SELECT *, lead(vid) OVER (PARTITION BY split, block ORDER BY q) AS nx FROM bl)
SELECT split, block::BIGINT AS block, count(*)::BIGINT AS n,
       sum(CASE WHEN vid = nx THEN 1 ELSE 0 END)::BIGINT AS repetitions,
       sum(CASE WHEN vid = nx THEN 1 ELSE 0 END) / count(*) AS repetition_rate,
       sum(CASE WHEN vid = (SELECT count(*) FROM vocab) THEN 1 ELSE 0 END)::BIGINT AS eos,
       count(DISTINCT vid)::BIGINT AS unique_ids, count(DISTINCT vid) / count(*) AS unique_ratio
FROM lx GROUP BY split, block
""")(block_diagnostics)


# --- A6 by sketches, rolled up ----------------------------------------------------------
def unique_rollup(spark, sf_dir):
    """Distinct ids per block, split and in total: the exact number and whether the estimate that was
    rolled up from block sketches is within four standard errors of it."""
    runs = cut_table(C.stream_runs(spark, sf_dir, BLOCK)[0])
    est = ST.roll_up_unique(ST.unique_sketches(runs, ["split", "seq"]), ["split", "seq"])
    exact = ST.exact_unique(runs, ["split", "seq"])
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("split", "seq")]
    return est.alias("a").join(exact.alias("b"), same[0] & same[1]).select(
        "a.split", F.col("a.seq").alias("block"), "n", "exact",
        (F.abs(F.col("unique_ids") - F.col("exact")) <= F.col("exact") * (4 * 1.04 / 2 ** (ST.LG_K / 2))).alias("within"))


register("unique_rollup", f"""WITH {SQL_STREAM_CTES}, {SQL_POSITIONS}
SELECT split, (q // {BLOCK})::BIGINT AS block, count(*) AS n, count(DISTINCT vid) AS exact, true AS within FROM sp
GROUP BY ROLLUP (split, q // {BLOCK})
""")(unique_rollup)


# --- A7 -----------------------------------------------------------------------------
def shift_check(spark, sf_dir):
    return ST.shift_mismatches(C.packed(spark, sf_dir)[0])


register("shift_check", f"""WITH {SQL_STREAM_CTES}, {SQL_POSITIONS}
SELECT split, ((max(m) - 1) // {L})::BIGINT AS windows, 0::BIGINT AS mismatches FROM sp GROUP BY split
""")(shift_check)


# --- A1 -----------------------------------------------------------------------------
def source_rollup(spark, sf_dir):
    counted = C.counted_stream(spark, sf_dir)
    cut = C.stream_totals(counted)["train"]
    train = F.least(F.greatest(F.lit(cut) - F.col("offset"), F.lit(0)), F.col("n"))
    u = counted.select("source", "id", F.col("n").alias("tokens"), train.alias("train"))
    return u.rollup("source").agg(
        F.countDistinct("source", "id").alias("documents"), F.sum("tokens").cast("bigint").alias("tokens"),
        F.sum("train").cast("bigint").alias("train_tokens"),
        (F.sum("tokens") - F.sum("train")).cast("bigint").alias("val_tokens"))


register("source_rollup", f"""WITH {SQL_STREAM_CTES},
o AS (SELECT source, id, n_ids,
             sum(n_ids) OVER (ORDER BY source_ord, okey, id, part_no ROWS UNBOUNDED PRECEDING) - n_ids AS off
      FROM enc),
s AS (SELECT floor(sum(n_ids) * {C.TRAIN_SPLIT}::DOUBLE)::BIGINT AS cut FROM enc),
u AS (SELECT source, id, n_ids AS tokens, least(greatest(cut - off, 0), n_ids) AS train FROM o, s)
SELECT source, count(DISTINCT (source, id)) AS documents, sum(tokens)::BIGINT AS tokens,
       sum(train)::BIGINT AS train_tokens, (sum(tokens) - sum(train))::BIGINT AS val_tokens
FROM u GROUP BY ROLLUP (source)
""")(source_rollup)


# --- A12 ----------------------------------------------------------------------------
TRAIN_BATCH = 32


def size_guards(spark, sf_dir):
    totals = C.stream_totals(C.counted_stream(spark, sf_dir))
    return ST.size_guards(spark.createDataFrame(list(totals.items()), "split string, tokens long"), TRAIN_BATCH, L)


register("size_guards", f"""WITH {SQL_STREAM_CTES}, {SQL_POSITIONS},
w AS (SELECT split, max(m)::BIGINT AS tokens, ((max(m) - 1) // {L})::BIGINT AS windows FROM sp GROUP BY split)
SELECT split, tokens, windows, ceil(windows / {TRAIN_BATCH})::BIGINT AS batches, ceil(windows / {TRAIN_BATCH}) = 0 AS no_batches,
       {TRAIN_BATCH * L} > tokens / 2 AS batch_over_half FROM w
""")(size_guards)


# --- A8: whole-text pieces against the sentence path ------------------------------------
def count_parity(spark, sf_dir):
    b = S.book_rows(spark, sf_dir, None)
    a = b.select("path", F.size(T.pieces(F.col("text"))).cast("bigint").alias("n"))
    s = CH.sentences(b, "text", 10, "part").groupBy("path").agg(
        F.sum(F.size(T.pieces(F.col("part")))).cast("bigint").alias("n"))
    return ST.count_parity(a, s, "path", "n", 0.05)


register("count_parity", f"""
SELECT path, a, b, abs(a - b) < 0.05 * a AS within_tol FROM (
  SELECT path, len({Q.pieces('text')})::BIGINT AS a,
         coalesce((SELECT sum(len({Q.pieces('x')})) FROM (SELECT unnest(ps) AS x)), 0)::BIGINT AS b
  FROM (SELECT path, text, list_filter(list_transform({Q.sentences('text')}, lambda s: {Q.strip('s')}),
                                       lambda s: length(s) > 10) AS ps FROM ({SQL_FILES})))
""")(count_parity)


# --- A3 -----------------------------------------------------------------------------
RESP_BATCH = 10


def batch_progress(spark, sf_dir):
    r = S.raw_result_rows(spark, sf_dir).withColumn(
        "batch_id", F.floor(F.col("request_index") / RESP_BATCH).cast("bigint"))
    return ST.batch_progress(r)


register("batch_progress", f"""
SELECT batch_id, succeeded, failed,
       sum(succeeded) OVER w::BIGINT AS total_succeeded, sum(failed) OVER w::BIGINT AS total_failed,
       sum(succeeded) OVER w * 100.0 / (sum(succeeded) OVER w + sum(failed) OVER w) AS success_rate
FROM (SELECT (request_index // {RESP_BATCH})::BIGINT AS batch_id,
             sum(CASE WHEN success THEN 1 ELSE 0 END)::BIGINT AS succeeded,
             sum(CASE WHEN success THEN 0 ELSE 1 END)::BIGINT AS failed
      FROM ({SQL_RAW}) GROUP BY 1)
WINDOW w AS (ORDER BY batch_id ROWS UNBOUNDED PRECEDING)
""")(batch_progress)


# --- A9: runs compared with the first one ----------------------------------------------
def compare_runs(spark, sf_dir):
    ev = S.table(spark, sf_dir, "events")
    runs = ev.groupBy(F.col("user_id").alias("run")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0).alias("duration"),
        F.count(F.lit(1)).alias("samples"))
    return ST.compare_runs(runs, "run", "duration", "samples")


register("compare_runs", """
SELECT run, duration, samples, first_value(duration) OVER (ORDER BY run) / duration AS speedup,
       samples / duration AS rate,
       first_value(run) OVER (ORDER BY duration, run ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fastest
FROM (SELECT user_id AS run, sum(round(value * 100)::BIGINT) / 100.0 AS duration, count(*) AS samples
      FROM events GROUP BY user_id)
""")(compare_runs)


# --- T8 T11 T12: fine-tune batches --------------------------------------------------------
def padded_batches(spark, sf_dir):
    b = FT.batches(spark, sf_dir, epoch=1)
    return b.select("split", "batch_id", "id", F.col("idx").cast("bigint").alias("idx"),
                    F.col("len").cast("bigint").alias("len"), F.size("inputs").cast("bigint").alias("padded_len"),
                    F.size("targets").cast("bigint").alias("padded_tg_len"),
                    P.checksum(F.col("inputs")).alias("in_sum"), P.checksum(F.col("targets")).alias("tg_sum"))


register("padded_batches", f"""
WITH r AS (SELECT id, 'Human: ' || prompt || {Q.SEP} || 'Assistant: ' || response AS text FROM ({SQL_PAIRS})
           WHERE len(data) = 2 AND length({Q.strip('prompt')}) > 10 AND length({Q.strip('response')}) > 10),
toks AS (SELECT id, unnest(pc) AS piece, unnest(range(len(pc))) AS pos FROM (SELECT id, {Q.pieces('text')} AS pc FROM r)),
vocab AS (SELECT piece, row_number() OVER (ORDER BY count(*) DESC, piece) - 1 AS vid FROM toks GROUP BY piece),
ids AS (SELECT t.id, t.pos, v.vid FROM toks t JOIN vocab v ON t.piece = v.piece),
smp AS (SELECT id, count(*) AS n FROM ids GROUP BY id HAVING count(*) > 1),
sp AS (SELECT id, n, CASE WHEN row_number() OVER (ORDER BY md5('{FT.SEED}:' || id::VARCHAR), id)
                              <= floor({FT.VAL_SPLIT}::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split
       FROM smp),
ix AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('{FT.SEED}:1:' || id::VARCHAR), id) AS idx FROM sp),
bt AS (SELECT *, ((idx - 1) // {FT.BATCH})::BIGINT AS batch_id, n - 1 AS len FROM ix),
pd AS (SELECT *, max(len) OVER (PARTITION BY split, batch_id) AS padded_len FROM bt),
cs AS (SELECT i.id, sum(CASE WHEN i.pos < s.n - 1 THEN (i.pos + 1) * i.vid ELSE 0 END)::BIGINT AS in_sum,
              sum(CASE WHEN i.pos >= 1 THEN i.pos * i.vid ELSE 0 END)::BIGINT AS tg_sum
       FROM ids i JOIN smp s ON i.id = s.id GROUP BY i.id)
SELECT split, batch_id, id, idx::BIGINT AS idx, len::BIGINT AS len, padded_len::BIGINT AS padded_len,
       padded_len::BIGINT AS padded_tg_len, in_sum, tg_sum
FROM pd JOIN cs USING (id)
""")(padded_batches)

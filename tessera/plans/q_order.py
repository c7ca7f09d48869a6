"""Registered queries: sampling, caps, dedup, exact splits, shuffles, batches (step 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import questions as QS
from tessera.operators import render as RD
from tessera.operators import sampling as SM
from tessera.plans import sqlfrag as Q
from tessera.plans.q_corpus import SQL_ALL_ARTICLES, SQL_PAIRS, sql_pair_keep
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


SEED = 42


# --- L1: exact seeded sample of articles --------------------------------------
def seeded_sample(spark, sf_dir):
    a = S.article_rows(spark, sf_dir, None)
    return SM.sample_exact(a, 300, "id", SEED).select("id")


register("seeded_sample", f"""
SELECT id FROM ({SQL_ALL_ARTICLES}) ORDER BY md5('{SEED}:' || id::VARCHAR), id LIMIT 300
""")(seeded_sample)


def seeded_sample_large(spark, sf_dir):
    """The large-n path (hash pre-filter, count check, distributed rank),
    forced by a zero top-k limit."""
    a = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return SM.sample_exact(a, 700, "id", SEED, top_k_direct=0).select("id")


register("seeded_sample_large", f"""
SELECT doc_id AS id FROM documents ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id LIMIT 700
""")(seeded_sample_large)


# --- L2 + Q7: cap first, then filter -------------------------------------------
CAP = 50


def cap_then_filter(spark, sf_dir):
    p = SM.first_n(S.pair_rows(spark, sf_dir), CAP, "id")
    return RD.render_pair(p).select("id")


register("cap_then_filter", f"""
SELECT id FROM (SELECT * FROM ({SQL_PAIRS}) ORDER BY id LIMIT {CAP}) WHERE {sql_pair_keep()}
""")(cap_then_filter)


# --- L5: ordered dedup of documents --------------------------------------------
def ordered_dedup(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    u = QS.dedup_ordered(d.select("doc_id", "text"), "text", ("doc_id",))
    return u.select("doc_id", F.md5("text").alias("digest"))


register("ordered_dedup", f"""
SELECT doc_id, md5(text) AS digest FROM (
  SELECT doc_id, text, row_number() OVER (PARTITION BY {Q.strip('lower(text)')} ORDER BY doc_id) AS rn
  FROM documents) WHERE rn = 1
""")(ordered_dedup)


# --- L8: exact 90/10 split ------------------------------------------------------
def exact_split(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id")
    return SM.split_rows(d, 0.9, "doc_id", SEED)


register("exact_split", f"""
SELECT doc_id, CASE WHEN r <= floor(0.9::DOUBLE * n) THEN 'train' ELSE 'val' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id) AS r,
         count(*) OVER () AS n FROM documents)
""")(exact_split)


# --- L9 + L10: per-epoch shuffle and batches -----------------------------------
EPOCH = 3
BATCH = 32


def shuffle_batches(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id")
    s = SM.with_batches(SM.shuffle_epoch(d, "doc_id", SEED, EPOCH), BATCH)
    return s.select("doc_id", F.col("idx").cast("bigint").alias("idx"), "batch_id")


register("shuffle_batches", f"""
SELECT doc_id, idx, ((idx - 1) // {BATCH})::BIGINT AS batch_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:{EPOCH}:' || doc_id::VARCHAR), doc_id)::BIGINT AS idx
  FROM documents)
""")(shuffle_batches)

"""Registered queries that go through files: sink -> source round trip
(K1, S4, V2) and incremental streaming ingestion (G8).  Files go under the
session's checkpoint directory (a shared folder on a cluster)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import render as RD
from tessera.plans import corpus as C
from tessera.plans import prepare as PR
from tessera.plans import sqlfrag as Q
from tessera.plans.q_corpus import SQL_ARTICLES, SQL_BOOKS, SQL_CHATS, SQL_PAIRS
from tessera.plans.q_text import SQL_RAW
from tessera.plans.q_tokens import SQL_STREAM_CTES
from tessera.session import ensure_checkpoint_dir
from tessera.sources import json_array as JA
from tessera.sources import readers as RS
from tessera.sources import sinks as SK
from tessera.sources import tables as S
from tessera.streaming.ingest import ingest

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _scratch(spark, what):
    return f"{ensure_checkpoint_dir(spark)}/tessera-io/{what}-{uuid.uuid4().hex}"


def pairs_json_roundtrip(spark, sf_dir):
    path = _scratch(spark, "pairs")
    SK.write_pairs(S.raw_result_rows(spark, sf_dir), path)
    valid, _ = RS.read_pairs(spark, path, multiline=False)
    return valid.select(F.col("data")[0].alias("prompt"), F.col("data")[1].alias("response"),
                        F.col("metadata.source").alias("source"))


register("pairs_json_roundtrip", f"""
SELECT prompt, response, 'generated_training_data' AS source FROM ({SQL_RAW})
WHERE success AND response IS NOT NULL AND response <> ''
""")(pairs_json_roundtrip)


LANDING_FILES = 4


def ingest_incremental(spark, sf_dir):
    base = _scratch(spark, "ingest")
    docs = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    lo, hi = docs.agg(F.min("id"), F.max("id")).first()
    step = (hi - lo) // LANDING_FILES + 1
    for i in range(LANDING_FILES):          # files land one after another, in id order
        part = docs.where((F.col("id") >= lo + i * step) & (F.col("id") < lo + (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(f"{base}/landing")

    def transform(batch):
        r = RD.render_article(batch, end_marker=False)
        return r.select("id", F.md5("text").alias("dedup_key"), "text")

    ingest(spark, f"{base}/landing", docs.schema, transform, f"{base}/out", f"{base}/checkpoint", buckets=32)
    out = spark.read.parquet(f"{base}/out")
    return out.select("id", F.col("dedup_key").alias("digest"))


register("ingest_incremental", f"""
SELECT min(doc_id) AS id, md5(t) AS digest FROM (SELECT doc_id, {Q.strip('text')} AS t FROM documents
  WHERE text IS NOT NULL AND text <> '' AND length({Q.strip('text')}) > 100) GROUP BY md5(t)
""")(ingest_incremental)


def raw_array_roundtrip(spark, sf_dir):
    """Raw results as JSON array files, read back in small byte ranges."""
    path = _scratch(spark, "raw")
    JA.write_array(S.raw_result_rows(spark, sf_dir).repartition(4), path)
    back = JA.read_array(spark, path, RS.RAW_SCHEMA, split_bytes=20_000)
    return back.select("request_index", "success", "error", F.md5("prompt").alias("prompt"), F.md5("response").alias("response"), F.col("_error").alias("reason"))


register("raw_array_roundtrip", f"""
SELECT request_index, success, error, md5(prompt) AS prompt, md5(response) AS response, NULL::VARCHAR AS reason FROM ({SQL_RAW})
""")(raw_array_roundtrip)


# --- the whole preparation over files ------------------------------------------------------
def prepared_report(spark, sf_dir):
    """The stand-in sources as files of each kind (and one that is missing), prepared."""
    base = _scratch(spark, "prepare")
    SK.write_text_files(S.book_rows(spark, sf_dir), f"{base}/books")
    chats = S.chat_rows(spark, sf_dir).withColumnRenamed("conv_id", "id")
    other = chats.withColumn("id", F.col("id") + 1_000_000).withColumn("split", F.lit("test"))
    chats.withColumn("split", F.lit("train")).unionByName(other).write.partitionBy("split").parquet(f"{base}/chats")
    JA.write_array(S.pair_rows(spark, sf_dir).select("data", "metadata"), f"{base}/pairs")
    return PR.prepare(spark, [
        PR.Source("book", path=f"{base}/books"), PR.Source("chat", path=f"{base}/chats"),
        PR.Source("pair", path=f"{base}/pairs", options={"split_bytes": 100_000}),
        PR.Source("article", rows=S.article_rows(spark, sf_dir)),
        PR.Source("article", path=f"{base}/none", name="more articles")], f"{base}/out").withColumn("note", F.regexp_replace("note", ": .*", ""))


register("prepared_report", f"""
WITH {SQL_STREAM_CTES},
o AS (SELECT source, n_ids, sum(n_ids) OVER (ORDER BY source_ord, okey, id, part_no ROWS UNBOUNDED PRECEDING) - n_ids AS off FROM enc),
c AS (SELECT floor(sum(n_ids) * {C.TRAIN_SPLIT}::DOUBLE)::BIGINT AS cut FROM enc),
t AS (SELECT source, sum(n_ids)::BIGINT AS tokens, sum(least(greatest(cut - off, 0), n_ids))::BIGINT AS train FROM o, c GROUP BY source),
r AS (SELECT 'book' AS source, CASE WHEN {Q.clean_book('text')} <> '' THEN NULL ELSE 'empty' END AS reason FROM ({SQL_BOOKS})
      UNION ALL SELECT 'chat', CASE WHEN len(data) >= 2 THEN NULL ELSE 'min_turns_2' END FROM ({SQL_CHATS})
      UNION ALL SELECT 'pair', CASE WHEN len(data) <> 2 THEN 'exact_turns_2' WHEN NOT (length(prompt) >= 10 AND length(response) >= 10) THEN 'min_len_10'
        WHEN coalesce({Q.unique_ratio_bad('response')}, false) THEN 'repetitive' END FROM ({SQL_PAIRS})
      UNION ALL SELECT 'article', CASE WHEN text <> '' AND length({Q.strip('text')}) > 100 THEN NULL ELSE 'too_short' END FROM ({SQL_ARTICLES})),
n AS (SELECT source, reason, count(*) AS k FROM r GROUP BY ALL),
s AS (SELECT source, sum(k)::BIGINT AS rows_in, coalesce(sum(k) FILTER (reason IS NULL), 0)::BIGINT AS rows_kept,
             coalesce(string_agg(reason || ': ' || k, ', ' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS rejected FROM n GROUP BY source)
SELECT source, rows_in, rows_kept, rejected, NULL::VARCHAR AS note, tokens, train AS train_tokens, tokens - train AS val_tokens,
       (tokens * 100.0 / sum(tokens) OVER ())::DOUBLE AS pct FROM s JOIN t USING (source)
UNION ALL SELECT 'more articles', 0, 0, '', 'no such path', 0, 0, 0, 0.0
""")(prepared_report)

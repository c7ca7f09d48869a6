"""Registered queries: source mix and rendering (steps 0-2 of the build plan)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import stats as ST
from tessera.plans import corpus as C
from tessera.plans import sqlfrag as Q
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


# --- SQL stand-ins for the four sources ------------------------------------
SQL_BOOKS = ("SELECT format('book{}.txt', doc_id) AS path, doc_id, text FROM documents "
             "WHERE n_chars > 10000")
#: All documents as files.
SQL_FILES = "SELECT format('book{}.txt', doc_id) AS path, doc_id, text FROM documents"
SQL_ARTICLES = "SELECT doc_id AS id, text FROM documents WHERE NOT (n_chars > 10000) OR n_chars IS NULL"
#: All documents as articles.
SQL_ALL_ARTICLES = "SELECT doc_id AS id, text FROM documents"
SQL_CHATS = ("SELECT conv_id, list(text ORDER BY turn) AS data FROM conversations "
             "WHERE role <> 'system' GROUP BY conv_id")
SQL_PAIRS = """
SELECT u.conv_id AS id, u.text AS prompt, a.text AS response,
       CASE WHEN a.text IS NULL THEN [u.text] ELSE [u.text, a.text] END AS data
FROM (SELECT c.conv_id, c.turn, c.text FROM conversations c
      JOIN (SELECT conv_id, min(turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id) f
        ON c.conv_id = f.conv_id AND c.turn = f.t) u
LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
"""


def sql_pair_keep(prefix: str = "") -> str:
    p = prefix
    return (f"len({p}data) = 2 AND length({p}prompt) >= 10 AND length({p}response) >= 10 "
            f"AND NOT coalesce({Q.unique_ratio_bad(p + 'response')}, false)")


SQL_RENDERED = f"""
SELECT 'book' AS source, 0 AS source_ord, path AS okey, doc_id AS id,
       {Q.clean_book('text')} AS text, false AS eos FROM ({SQL_BOOKS}) WHERE {Q.clean_book('text')} <> ''
UNION ALL
SELECT 'chat', 1, '', conv_id, {Q.render_chat('data')}, true FROM ({SQL_CHATS}) WHERE len(data) >= 2
UNION ALL
SELECT 'pair', 2, '', id, prompt || {Q.SEP} || response || {Q.SEP} || '<|endofconversation|>' || {Q.SEP}, true
FROM ({SQL_PAIRS}) WHERE {sql_pair_keep()}
UNION ALL
SELECT 'article', 3, '', id, {Q.strip('text')}, true FROM ({SQL_ARTICLES})
WHERE text IS NOT NULL AND text <> '' AND length({Q.strip('text')}) > 100
"""


SQL_UNITS = f"""
SELECT source, source_ord, okey, id, 0::BIGINT AS part_no,
       text || CASE WHEN source = 'book' THEN {Q.SEP} ELSE '' END AS part, eos FROM ({SQL_RENDERED})
"""


# --- step 0: the minimum slice ---------------------------------------------
def corpus_mix(spark, sf_dir):
    """Per source: kept documents, tokens in the stream (pieces plus
    end-of-text ids) and the share of tokens; one pass over the units."""
    per = C.stream_units(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.size(T.pieces(F.col("part"))) + F.col("eos").cast("int")).cast("bigint").alias("tokens"))
    return ST.mix(per, "tokens", "pct")


register("corpus_mix", f"""
WITH per AS (SELECT source, count(*) AS documents,
                    sum(len({Q.pieces('part')}) + CASE WHEN eos THEN 1 ELSE 0 END)::BIGINT AS tokens
             FROM ({SQL_UNITS}) GROUP BY source)
SELECT source, documents, tokens, (tokens * 100.0 / sum(tokens) OVER ())::DOUBLE AS pct FROM per
""")(corpus_mix)

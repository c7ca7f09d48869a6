"""The registered queries of the corpus operators, with oracle SQL where SQL
can express the result."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import (conv_repair, decontam, hard_negatives, html_main, jaccard_join, kd_shards, line_runs, mcd_quality, pii,
                         piece_codec, token_counts, toxicity, warc)
from tessera.llm.shared import table
from tessera.session import ensure_checkpoint_dir

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
TOKEN_LIMIT = 512


def op1_html_main_text(spark, sf_dir):
    return html_main.extract(table(spark, sf_dir, "pages"))


def op2_kd_tree_shards(spark, sf_dir):
    return kd_shards.shard_documents(table(spark, sf_dir, "documents"), 24)


def op3_mcd_quality(spark, sf_dir):
    return mcd_quality.judge(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_line_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.delete_repeated_runs(docs, deleted_col="n_deleted").select("doc_id", "n_deleted", "text")


def op6_token_counts(spark, sf_dir):
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_pii_deobfuscation(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_piece_roundtrip(spark, sf_dir):
    return piece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op9_benchmark_leaks(spark, sf_dir):
    leaks = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.groupBy("doc_id", "item_id").agg(
        F.min(F.struct("edits", "first_word")).alias("best"), F.max("n_words").alias("n_words")).select(
        "doc_id", "item_id", "n_words", "best.edits", "best.first_word")


def op10_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_zone_map_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_conversation_repair(spark, sf_dir):
    damaged = conv_repair.damage(table(spark, sf_dir, "conversations"))
    return conv_repair.report(conv_repair.repair(damaged, present="present")).withColumnRenamed("conv", "conv_id")


def op13_warc_roundtrip(spark, sf_dir):
    """Lengths and digests of responses are those of the payloads read back; a revisit has only headers."""
    pages, path = table(spark, sf_dir, "pages"), f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.page_records(pages), path)
    records = warc.read(spark, path, ["record_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"],
                        types=["response", "revisit"], payload_types=["response"])
    whole, kind = F.col("record_type") == "response", pages.schema["page_id"].dataType
    return records.select(
        warc.named_id(F.col("record_id")).cast(kind).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, warc.sha1_base32(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", warc.named_id(F.col("refers_to")).cast(kind).alias("refers_to"))


QUERIES = {f.__name__: f for f in (op1_html_main_text, op2_kd_tree_shards, op3_mcd_quality, op4_jaccard_join, op5_line_runs, op6_token_counts,
                                   op7_pii_deobfuscation, op8_piece_roundtrip, op9_benchmark_leaks,
                                   op10_toxicity, op11_zone_map_negatives, op12_conversation_repair, op13_warc_roundtrip)}
#: Runs as joined line text, compared literally.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w
      FROM d, unnest(generate_series(1, len(ls))) AS g(i)),
s AS (SELECT doc_id, i, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM l),
u AS (SELECT doc_id, i, c, c - w AS u FROM s),
r AS (SELECT a.doc_id, a.i AS f, min(b.i) AS t FROM u a JOIN u b
        ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.u >= 50 GROUP BY 1, 2
      UNION
      SELECT a.doc_id, max(b.i) AS f, a.i AS t FROM u a JOIN u b
        ON a.doc_id = b.doc_id AND b.i <= a.i AND a.c - b.u >= 50 GROUP BY 1, 3),
k AS (SELECT r.doc_id, f, t, array_to_string(ls[f:t], chr(10)) AS run FROM r JOIN d USING (doc_id)),
c AS (SELECT doc_id, f, t, row_number() OVER (PARTITION BY run ORDER BY doc_id, f) AS n FROM k),
gone AS (SELECT DISTINCT doc_id, i FROM c, unnest(generate_series(f, t)) AS g(i) WHERE n > 1),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text
         FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i WHERE gone.i IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_deleted,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Every anchor against every row.
OP11_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, other) AS INT) AS rank,
       other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, other) <= 3
"""

#: The digest's 160 bits as 32 groups of 5, and the least id of each payload.
OP13_SQL = r"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first_id FROM d GROUP BY x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
           ((CAST('0x' || substr(d.x, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (x)
"""

ORACLE = {"op5_line_runs": OP5_SQL, "op11_zone_map_negatives": OP11_SQL, "op13_warc_roundtrip": OP13_SQL}

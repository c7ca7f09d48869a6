"""Readers for the corpus sources and the stand-ins built from driver tables.

Source shapes (one DataFrame each, every one with an explicit order key,
because Spark rows have no list position):

* books     ``path STRING, text STRING``          order: ``path`` (string order)
* chats     ``conv_id BIGINT, data ARRAY<STRING>`` order: ``conv_id``
* pairs     ``id BIGINT, data ARRAY<STRING>, metadata STRUCT<...>`` order: ``id``
* articles  ``id BIGINT, text STRING``            order: ``id``

The driver tables stand in for them (fixed choice): books are the documents
longer than 10,000 characters, articles the rest; chats are the
conversations without system turns, ordered by turn; a generated pair is the
first user turn of a conversation and the assistant turn that follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK_MIN_CHARS = 10000
PAIR_SOURCE = "generated_training_data"
PAIR_MODEL = "stand-in"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_UPPER = ASCII_LOWER.upper()


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the session can
    run at once (a small file with one row group is read by one task).  A
    large multi-file scan already has enough partitions and is left as is,
    so this never adds a shuffle at scale."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def book_rows(spark: SparkSession, sf_dir: str, min_chars: int | None = BOOK_MIN_CHARS) -> DataFrame:
    """Long documents (all, without ``min_chars``) as book files: ``path`` is
    ``book<doc_id>.txt`` so that path order is the lexicographic file order of
    a directory listing."""
    docs = table(spark, sf_dir, "documents")
    if min_chars is not None:
        docs = docs.where(F.col("n_chars") > min_chars)
    return docs.select(
        F.format_string("book%d.txt", F.col("doc_id")).alias("path"),
        F.col("doc_id"),
        F.col("text"))


def article_rows(spark: SparkSession, sf_dir: str, book_min_chars: int | None = BOOK_MIN_CHARS) -> DataFrame:
    """Documents that aren't books (all, without ``book_min_chars``)."""
    docs = table(spark, sf_dir, "documents")
    if book_min_chars is not None:
        docs = docs.where(~(F.col("n_chars") > book_min_chars) | F.col("n_chars").isNull())
    return docs.select(F.col("doc_id").alias("id"), F.col("text"))


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form chat turns without system messages."""
    conv = table(spark, sf_dir, "conversations")
    return conv.where(F.col("role") != "system").select("conv_id", "turn", "role", "text")


def chats_from_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn",
                     text: str = "text") -> DataFrame:
    """Long form -> array form ``(key, data ARRAY<STRING>)``.

    One shuffle on the conversation key; each group is one conversation, so
    its size is that of a single chat row in the array-form source.
    """
    return turns.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))),
                    lambda x: x[text]).alias("data"))


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats_from_turns(chat_turns(spark, sf_dir))


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated pairs: first user turn + the assistant turn right after it.

    A conversation whose first user turn is not followed by an assistant turn
    yields a one-element ``data`` array, i.e. a malformed pair that the pair
    validation rejects.  The metadata timestamp is derived from the id so the
    rows are deterministic.
    """
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first_user = conv.where(F.col("role") == "user").groupBy("conv_id").agg(
        F.min("turn").alias("u_turn"))
    u = conv.alias("c").join(first_user.alias("f"),
                             (F.col("c.conv_id") == F.col("f.conv_id"))
                             & (F.col("c.turn") == F.col("f.u_turn")))
    u = u.select(F.col("c.conv_id").alias("id"), F.col("c.turn").alias("u_turn"),
                 F.col("c.text").alias("prompt"))
    a = conv.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_id"), F.col("turn").alias("a_turn"), F.col("text").alias("response"))
    j = u.join(a, (F.col("id") == F.col("a_id")) & (F.col("a_turn") == F.col("u_turn") + 1), "left")
    return j.select(
        F.col("id"),
        F.when(F.col("response").isNull(), F.array(F.col("prompt")))
         .otherwise(F.array(F.col("prompt"), F.col("response"))).alias("data"),
        F.struct(
            F.format_string("2024-01-01T00:00:%02d", (F.col("id") % 60).cast("int")).alias("timestamp"),
            F.lit(PAIR_MODEL).alias("model"),
            F.lit(PAIR_SOURCE).alias("source")).alias("metadata"))


def raw_result_rows(spark: SparkSession, sf_dir: str, fail_every: int = 7) -> DataFrame:
    """Raw responder results derived from the pairs: ``request_index`` is the
    pair id; every ``fail_every``-th request failed (alternating timeout and
    other errors) so that success filtering and error classes have input."""
    p = pair_rows(spark, sf_dir)
    failed = (F.col("id") % fail_every) == 0
    err = F.when((F.col("id") % (2 * fail_every)) == 0,
                 F.lit("Request timed out")).otherwise(F.lit("Connection reset by peer"))
    return p.select(
        F.col("data")[0].alias("prompt"),
        F.when(failed, F.lit(None).cast("string")).otherwise(F.get(F.col("data"), 1)).alias("response"),
        F.col("metadata.timestamp").alias("timestamp"),
        F.col("metadata.model").alias("model"),
        (~failed).alias("success"),
        F.col("id").alias("request_index"),
        F.when(failed, err).alias("error"))


def responder_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for responder replies ``(batch, response_text)``: one reply
    per document, derived from its lines so every extraction branch occurs —
    a JSON list of strings (doc_id % 5 = 0), a list that is none (% 5 = 1: with
    a number, a null, or text or lines behind it), else lines rewritten by position as quoted, quoted with a
    comma, numbered, question-marked and plain.  doc_id % 7 = 3 is upper-cased
    so the case-insensitive dedup has work (ASCII letters only, so the
    result does not depend on a locale-specific upper-casing of ß and the like)."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split(F.col("text"), "\n", -1)
    bare = F.transform(lines, lambda l: F.regexp_replace(l, r'["\\]', ""))
    json_list = F.concat(F.lit("["), F.array_join(
        F.transform(bare, lambda l: F.concat(F.lit('"'), l, F.lit('"'))), ", "), F.lit("]"))
    b, shape = F.element_at(bare, 1), F.col("doc_id") % 4
    bad_json = (F.when(shape == 0, F.concat(F.lit('[1, "'), b, F.lit('?"]')))
                 .when(shape == 1, F.concat(F.lit('["'), b, F.lit('?", null]')))
                 .when(shape == 2, F.concat(F.lit('["'), b, F.lit('?"] trailing text?')))
                 .otherwise(F.concat(F.lit('["'), b, F.lit('?"]\n"'), b, F.lit(' again?"'))))
    mixed = F.array_join(F.transform(lines, lambda l, i: (
        F.when(i % 5 == 0, F.concat(F.lit('"'), l, F.lit('"')))
         .when(i % 5 == 1, F.concat(F.lit('"'), l, F.lit('",')))
         .when(i % 5 == 2, F.concat((i + 1).cast("string"), F.lit(". "), l))
         .when(i % 5 == 3, F.concat(l, F.lit("?")))
         .otherwise(l))), "\n")
    reply = (F.when(F.col("doc_id") % 5 == 0, json_list)
              .when(F.col("doc_id") % 5 == 1, bad_json).otherwise(mixed))
    reply = F.when(F.col("doc_id") % 7 == 3, F.translate(reply, ASCII_LOWER, ASCII_UPPER)).otherwise(reply)
    return docs.select(F.col("doc_id").alias("batch"), reply.alias("response_text"))

"""Question harvesting (V10, R7, L4, L5, L6, K4, K5, G7) and the keyword
category heuristic (V12).

Everything is an array expression over one reply row or a hash aggregate:
no per-row Python, no window over a skewable key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators.ordering import global_index

TARGET = 90           # fixed value: fewer unique questions than this is flagged

NUMBERED = r"^([1-9][0-9]?|100)\."


def _unquote(q: Column) -> Column:
    return F.when(q.startswith('"') & q.endswith('"'),
                  F.substring(q, 2, F.length(q) - 2)).otherwise(q)


def _line_question(raw: Column) -> Column:
    line = strip(raw)
    after_dot = strip(F.substring(line, F.instr(line, ".") + 1, F.length(line)))
    return (F.when(line.startswith('"') & line.endswith('"'), F.substring(line, 2, F.length(line) - 2))
             .when(line.startswith('"') & line.endswith('",'), F.substring(line, 2, F.length(line) - 3))
             .when(line.rlike(NUMBERED), _unquote(after_dot))
             .when((line != "") & line.contains("?"), line))


def is_string_list(text: Column) -> Column:
    """The whole text parses as JSON and is a list of strings (an empty
    list counts).  A list holding a null or any other non-string is not one,
    nor is a list with text behind it: as the value of a one-field object the
    text must be complete in itself."""
    kind = F.schema_of_variant(F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))))
    null_in = F.exists(F.from_json(text, "array<string>"), lambda q: q.isNull())
    return F.coalesce(kind.isin("OBJECT<a: ARRAY<STRING>>", "OBJECT<a: ARRAY<VOID>>") & ~null_in, F.lit(False))


def questions_of(text: Column, per_batch: int | None = None) -> Column:
    """The questions of one reply, in order; of a reply read line by line
    only the first ``per_batch``, where given."""
    t = strip(text)
    fallback = F.filter(F.transform(F.split(t, "\n", -1), _line_question), lambda q: q.isNotNull())
    if per_batch is not None:
        fallback = F.slice(fallback, 1, per_batch)
    return F.when(is_string_list(t), F.from_json(t, "array<string>")).otherwise(fallback)


def extract_questions(df: DataFrame, batch: str = "batch", text: str = "response_text",
                      per_batch: int | None = None) -> DataFrame:
    """``batch, pos, question`` (pos 1-based inside the reply).  Narrow."""
    return df.select(F.col(batch).alias("batch"),
                     F.posexplode(questions_of(F.col(text), per_batch)).alias("pos", "question")
                     ).withColumn("pos", F.col("pos") + 1)


def dedup_key(q: Column) -> Column:
    return strip(F.lower(q))


def dedup_ordered(df: DataFrame, text: str = "question", order: tuple[str, ...] = ("batch", "pos")) -> DataFrame:
    """Keep the first spelling of every case- and edge-space-insensitive
    text.  A hash aggregate with ``min(struct(order..., text))``: partial
    aggregation folds a hot key map-side, so one very frequent text never
    lands whole on one task."""
    first = F.min(F.struct(*[F.col(c) for c in order], F.col(text).alias("_t")))
    # group on a 128-bit digest of the normalized text: documents can be
    # tens of kilobytes, a digest keeps hashing and shuffle keys small
    g = df.groupBy(F.md5(dedup_key(F.col(text))).alias("_key")).agg(first.alias("_f"))
    return g.select(*[F.col(f"_f.{c}").alias(c) for c in order], F.col("_f._t").alias(text))


def dedup_summary(before: DataFrame, after: DataFrame, target: int = TARGET) -> DataFrame:
    """Totals of a dedup, with the under-target flag (one aggregate over
    the tagged union of both sides)."""
    u = before.select(F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(
        after.select(F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    s = u.agg(F.sum("_b").cast("bigint").alias("total_generated"),
              F.sum("_a").cast("bigint").alias("unique_questions"))
    return (s.withColumn("duplicates_removed", F.col("total_generated") - F.col("unique_questions"))
             .withColumn("under_target", F.col("unique_questions") < target))


def number_questions(unique: DataFrame, text: str = "question",
                     order: tuple[str, ...] = ("batch", "pos")) -> DataFrame:
    """K5: ``n`` (1-based, distributed) and the ``%3d. question`` line."""
    idx = global_index(unique, list(order), out="n")
    return idx.withColumn("line", F.format_string("%3d. %s", F.col("n"), F.col(text)))


def harvest(replies: DataFrame, batch: str = "batch", text: str = "response_text") -> DataFrame:
    """Replies -> extracted -> ordered dedup -> numbered lines."""
    return number_questions(dedup_ordered(extract_questions(replies, batch, text)))


def match_category(prompts: DataFrame, keywords: dict[str, list[str]], text: str = "prompt") -> DataFrame:
    """Prompts with every category one of whose keywords occurs in the
    lower-cased prompt, one output row per prompt and matching category.  The
    keywords are a fixed catalogue and stand in the expressions: narrow, no
    join.  Prompts that are equal stay rows of their own; a null prompt
    matches nothing."""
    low = F.lower(F.col(text))
    hits = [F.struct(F.lit(c).alias("category"), F.coalesce(
        sum((low.contains(k.lower()).cast("bigint") for k in ks), F.lit(0).cast("bigint")), F.lit(0)).alias("keyword_hits"))
        for c, ks in keywords.items()]
    found = F.filter(F.array(*hits), lambda h: h["keyword_hits"] > 0)
    return prompts.select("*", F.inline(found))

"""Registered queries: cleaning, filters, rendering, previews, questions (steps 1-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import questions as QS
from tessera.operators import render as RD
from tessera.operators import rules as R
from tessera.operators.cleaning import clean_text
from tessera.plans import sqlfrag as Q
from tessera.plans.q_corpus import SQL_ALL_ARTICLES, SQL_CHATS, SQL_FILES, SQL_PAIRS, sql_pair_keep
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


# --- C1-C10: book cleaning on documents with injected book furniture --------
# Fixed injected text (the shipped documents have no boundaries, page
# numbers or chapter headers, so both the query and its SQL add the same).
BOOK_HEAD_EVEN = ("Produced by the Gutenberg volunteers\nContents\n  CHAPTER I.  The start\n\n \n\n"
                  " 12 \nPREFACE\nCHAPTER IV\n")
BOOK_TAIL_EVEN = "\n\n 7 \n\t\tEnd of the Project Gutenberg EBook\nlicence line"
BOOK_HEAD_ODD = "A plain title\r\n\r\n\r\nCHAPTER XL \r\n"
BOOK_TAIL_ODD = "\r\n  33  \r\nCopyright notice 1999"


def _injected_book(col):
    even = F.col("doc_id") % 2 == 0
    return T.universal_newlines(F.when(
        even, F.concat(F.lit(BOOK_HEAD_EVEN), col, F.lit(BOOK_TAIL_EVEN))).otherwise(
        F.concat(F.lit(BOOK_HEAD_ODD), col, F.lit(BOOK_TAIL_ODD))))


def _sql_injected_book(x):
    return (f"regexp_replace(CASE WHEN doc_id % 2 = 0 THEN {Q.lit(BOOK_HEAD_EVEN)} || {x} || {Q.lit(BOOK_TAIL_EVEN)} "
            f"ELSE {Q.lit(BOOK_HEAD_ODD)} || {x} || {Q.lit(BOOK_TAIL_ODD)} END, {Q.lit(chr(13) + chr(10) + '?')}, chr(10), 'g')")


def _book_clean(end_rule):
    def q(spark, sf_dir):
        b = S.book_rows(spark, sf_dir, None)
        c = clean_text(_injected_book(F.col("text")), end_rule)
        return b.select("path", F.length(c).cast("bigint").alias("n_chars"), F.md5(c).alias("digest"))
    return q


def _sql_book_clean(end_rule):
    c = Q.clean_book(_sql_injected_book("text"), end_rule)
    return (f"SELECT path, length(c)::BIGINT AS n_chars, md5(c) AS digest FROM "
            f"(SELECT path, {c} AS c FROM ({SQL_FILES}))")


register("book_clean", _sql_book_clean("intended"))(_book_clean("intended"))
register("book_clean_reference", _sql_book_clean("reference"))(_book_clean("reference"))


# --- C9 / Q2: strip with Unicode padding ------------------------------------
PAD_HEAD = " \n  "
PAD_TAIL = " \t　\r\n"


def strip_len(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    padded = F.concat(F.lit(PAD_HEAD), F.col("text"), F.lit(PAD_TAIL))
    return d.select("doc_id", F.length(padded).cast("bigint").alias("raw_len"),
                    F.length(T.strip(padded)).cast("bigint").alias("stripped_len"),
                    F.length(T.collapse_ws(padded)).cast("bigint").alias("collapsed_len"))


register("strip_len", f"""
SELECT doc_id, length(p)::BIGINT AS raw_len, length({Q.strip('p')})::BIGINT AS stripped_len,
       length({Q.collapse_ws('p')})::BIGINT AS collapsed_len
FROM (SELECT doc_id, {Q.lit(PAD_HEAD)} || text || {Q.lit(PAD_TAIL)} AS p FROM documents)
""")(strip_len)


# --- V5: repetition rule over every document --------------------------------
def repetition_filter(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    w = T.words(F.col("text"))
    name, keep_c = R.unique_ratio(0.3, 3, "text")
    return d.select("doc_id", F.size(w).cast("bigint").alias("n_words"),
                    F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
                    keep_c.alias("kept"))


register("repetition_filter", f"""
SELECT doc_id, len({Q.words('text')})::BIGINT AS n_words,
       len(list_distinct({Q.words('text')}))::BIGINT AS n_distinct,
       NOT coalesce({Q.unique_ratio_bad('text')}, false) AS kept
FROM documents
""")(repetition_filter)


# --- V6 + R3: articles, both paths ------------------------------------------
def article_render(spark, sf_dir):
    a = RD.render_article(S.article_rows(spark, sf_dir, None), end_marker=False)
    return a.select("id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


register("article_render", f"""
SELECT id, length(t)::BIGINT AS n_chars, md5(t) AS digest
FROM (SELECT id, {Q.strip('text')} AS t FROM ({SQL_ALL_ARTICLES})
      WHERE text IS NOT NULL AND text <> '' AND length({Q.strip('text')}) > 100)
""")(article_render)


def article_render_marked(spark, sf_dir):
    a = RD.render_article(S.article_rows(spark, sf_dir, None), end_marker=True)
    return a.select("id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


register("article_render_marked", f"""
SELECT id, length(t)::BIGINT AS n_chars, md5(t) AS digest
FROM (SELECT id, text || {Q.SEP} || '<|endofarticle|>' || {Q.SEP} AS t FROM ({SQL_ALL_ARTICLES})
      WHERE text IS NOT NULL AND text <> '' AND length({Q.strip('text')}) >= 100)
""")(article_render_marked)


# --- V2 V3 V5 + R2: generated pairs -----------------------------------------
def pair_render(spark, sf_dir):
    p = RD.render_pair(S.pair_rows(spark, sf_dir))
    return p.select("id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


register("pair_render", f"""
SELECT id, length(t)::BIGINT AS n_chars, md5(t) AS digest
FROM (SELECT id, prompt || {Q.SEP} || response || {Q.SEP} || '<|endofconversation|>' || {Q.SEP} AS t
      FROM ({SQL_PAIRS}) WHERE {sql_pair_keep()})
""")(pair_render)


# --- A11: rejection reasons of the pair rules --------------------------------
def reject_reasons(spark, sf_dir):
    p = RD.pair_columns(S.pair_rows(spark, sf_dir))
    return R.reject_counts(R.with_reject_reason(p, RD.pair_rules()))


register("reject_reasons", f"""
SELECT outcome, count(*) AS n FROM (
  SELECT CASE WHEN NOT coalesce(len(data) = 2, false) THEN 'exact_turns_2'
              WHEN NOT coalesce(length(prompt) >= 10 AND length(response) >= 10, false) THEN 'min_len_10'
              WHEN coalesce({Q.unique_ratio_bad('response')}, false) THEN 'repetitive'
              ELSE 'kept' END AS outcome
  FROM ({SQL_PAIRS})) GROUP BY outcome
""")(reject_reasons)


# --- V1 + R1: chats ----------------------------------------------------------
def chat_render(spark, sf_dir):
    c = RD.render_chat(S.chat_rows(spark, sf_dir))
    return c.select("conv_id", F.size("data").cast("bigint").alias("turns"),
                    F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


register("chat_render", f"""
SELECT conv_id, len(data)::BIGINT AS turns, length(t)::BIGINT AS n_chars, md5(t) AS digest
FROM (SELECT conv_id, data, {Q.render_chat('data')} AS t FROM ({SQL_CHATS}) WHERE len(data) >= 2)
""")(chat_render)


# --- V2 V4 + R4: fine-tune rendering -----------------------------------------
def finetune_render(spark, sf_dir):
    f = RD.render_finetune(S.pair_rows(spark, sf_dir))
    return f.select("id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


register("finetune_render", f"""
SELECT id, length(t)::BIGINT AS n_chars, md5(t) AS digest
FROM (SELECT id, 'Human: ' || prompt || {Q.SEP} || 'Assistant: ' || response AS t FROM ({SQL_PAIRS})
      WHERE len(data) = 2 AND length({Q.strip('prompt')}) > 10 AND length({Q.strip('response')}) > 10)
""")(finetune_render)


# --- R5 / L3 / C12 / C13 / V13: previews per source ---------------------------
def preview(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    p = RD.preview(d, "text", n=3, width=300, min_chars=50, order="doc_id", group="source")
    return p.select("source", "doc_id", "preview")


register("preview", f"""
SELECT source, doc_id, {Q.ellipsize(Q.collapse_ws('text'), 300)} AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
      FROM documents WHERE length(text) > 50) WHERE rn <= 3
""")(preview)


def preview_chunks(spark, sf_dir):
    b = S.book_rows(spark, sf_dir, None)
    c = RD.preview_chunks(b, "text", n=10, width=300, min_chars=50)
    return c.select("path", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk")


register("preview_chunks", f"""
SELECT path, unnest(range(0, len(v)))::BIGINT AS chunk_no, unnest(v) AS chunk FROM (
  SELECT path, list_transform(list_slice(list_filter(
           list_transform(range(0, least(length(text), 9000), 300), lambda s: {Q.strip('substr(text, s + 1, 300)')}),
           lambda c: length(c) > 50), 1, 10), lambda c: {Q.ellipsize(Q.collapse_ws('c'), 250)}) AS v
  FROM ({SQL_FILES}))
""")(preview_chunks)


# --- V11: error classes of raw results ----------------------------------------
SQL_RAW = f"""
SELECT prompt, CASE WHEN id % 7 = 0 THEN NULL ELSE response END AS response,
       id AS request_index, id % 7 <> 0 AS success,
       CASE WHEN id % 7 = 0 THEN (CASE WHEN id % 14 = 0 THEN 'Request timed out'
                                       ELSE 'Connection reset by peer' END) END AS error
FROM ({SQL_PAIRS})
"""


def error_class(spark, sf_dir):
    r = S.raw_result_rows(spark, sf_dir)
    return r.select("request_index", "success", T.error_class(F.col("error")).alias("error_class"))


register("error_class", f"""
SELECT request_index, success,
       CASE WHEN error IS NULL THEN NULL
            WHEN lower(error) LIKE '%timeout%' OR lower(error) LIKE '%timed out%' THEN 'timeout'
            ELSE 'error' END AS error_class
FROM ({SQL_RAW})
""")(error_class)


# --- V9 + R8 / K1 rows: successful results as pair records --------------------
def pair_records(spark, sf_dir):
    r = RD.to_pair_records(S.raw_result_rows(spark, sf_dir))
    return r.select("request_index", F.col("data")[0].alias("prompt"), F.col("data")[1].alias("response"),
                    F.col("metadata.source").alias("source"))


register("pair_records", f"""
SELECT request_index, prompt, response, 'generated_training_data' AS source FROM ({SQL_RAW})
WHERE success AND response IS NOT NULL AND response <> ''
""")(pair_records)


# --- V10 R7 L4 L5 L6 K5: question harvesting -----------------------------------
def _sql_line_question(l):
    line = Q.strip(l)

    def inner(x, k):
        return f"(CASE WHEN length({x}) >= {k} THEN substr({x}, 2, length({x}) - {k}) ELSE '' END)"
    after = Q.strip(f"substr({line}, strpos({line}, '.') + 1)")
    unq = f"(CASE WHEN starts_with({after}, '\"') AND ends_with({after}, '\"') THEN {inner(after, 2)} ELSE {after} END)"
    return (f"(CASE WHEN starts_with({line}, '\"') AND ends_with({line}, '\"') THEN {inner(line, 2)} "
            f"WHEN starts_with({line}, '\"') AND ends_with({line}, '\",') THEN {inner(line, 3)} "
            f"WHEN regexp_matches({line}, '^([1-9][0-9]?|100)\\.') THEN {unq} "
            f"WHEN {line} <> '' AND contains({line}, '?') THEN {line} END)")


SQL_REPLIES = f"""
SELECT doc_id AS batch,
  CASE WHEN doc_id % 7 = 3 THEN translate(r, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE r END
    AS response_text
FROM (SELECT doc_id, CASE
  WHEN doc_id % 5 = 0 THEN '[' || array_to_string(list_transform(string_split(text, chr(10)),
        lambda l: '"' || regexp_replace(l, '["\\\\]', '', 'g') || '"'), ', ') || ']'
  WHEN doc_id % 5 = 1 THEN CASE doc_id % 4 WHEN 0 THEN '[1, "' || b || '?"]' WHEN 1 THEN '["' || b || '?", null]'
    WHEN 2 THEN '["' || b || '?"] trailing text?' ELSE '["' || b || '?"]' || chr(10) || '"' || b || ' again?"' END
  ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
        CASE WHEN (i - 1) % 5 = 0 THEN '"' || l || '"'
             WHEN (i - 1) % 5 = 1 THEN '"' || l || '",'
             WHEN (i - 1) % 5 = 2 THEN i::VARCHAR || '. ' || l
             WHEN (i - 1) % 5 = 3 THEN l || '?'
             ELSE l END), chr(10))
  END AS r FROM (SELECT *, regexp_replace(string_split(text, chr(10))[1], '["\\\\]', '', 'g') AS b FROM documents))
"""

SQL_QUESTIONS = f"""
SELECT batch, unnest(range(1, len(qs) + 1))::BIGINT AS pos, unnest(qs) AS question FROM (
  SELECT batch, CASE
    WHEN json_valid(t) AND json_type(t) = 'ARRAY'
         AND coalesce(list_bool_and(list_transform(json_extract(t, '$[*]'), lambda e: json_type(e) = 'VARCHAR')), true)
      THEN json_extract_string(t, '$[*]')
    ELSE list_filter(list_transform(string_split(t, chr(10)), lambda l: {_sql_line_question('l')}),
                     lambda x: x IS NOT NULL) END AS qs
  FROM (SELECT batch, {Q.strip('response_text')} AS t FROM ({SQL_REPLIES})))
"""

SQL_UNIQUE = f"""
SELECT batch, pos, question FROM (
  SELECT *, row_number() OVER (PARTITION BY {Q.strip('lower(question)')} ORDER BY batch, pos) AS rn
  FROM ({SQL_QUESTIONS})) WHERE rn = 1
"""


def question_extract(spark, sf_dir):
    q = QS.extract_questions(S.responder_replies(spark, sf_dir))
    return q.select(F.col("batch"), F.col("pos").cast("bigint").alias("pos"), "question")


register("question_extract", SQL_QUESTIONS)(question_extract)


def question_dedup(spark, sf_dir):
    q = QS.dedup_ordered(question_extract(spark, sf_dir))
    return q


register("question_dedup", SQL_UNIQUE)(question_dedup)


def question_numbered(spark, sf_dir):
    n = QS.number_questions(question_dedup(spark, sf_dir))
    return n.select(F.col("n").cast("bigint").alias("n"), "line")


register("question_numbered", f"""
SELECT n, printf('%3d. %s', n, question) AS line FROM (
  SELECT row_number() OVER (ORDER BY batch, pos)::BIGINT AS n, question FROM ({SQL_UNIQUE}))
""")(question_numbered)


def question_summary(spark, sf_dir):
    allq = question_extract(spark, sf_dir)
    return QS.dedup_summary(allq, QS.dedup_ordered(allq))


register("question_summary", f"""
SELECT t AS total_generated, u AS unique_questions, t - u AS duplicates_removed, u < 90 AS under_target
FROM (SELECT (SELECT count(*) FROM ({SQL_QUESTIONS}))::BIGINT AS t, (SELECT count(*) FROM ({SQL_UNIQUE}))::BIGINT AS u)
""")(question_summary)


# --- C11: ordered concatenation per group (turns of a conversation) ------------
def concat_turns(spark, sf_dir):
    from tessera.operators.cleaning import concat_ordered
    c = concat_ordered(S.chat_turns(spark, sf_dir), "conv_id", "turn", "text", "\n\n")
    return c.select("conv_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


register("concat_turns", f"""
SELECT conv_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (
  SELECT conv_id, string_agg(text, {Q.SEP} ORDER BY turn) AS t FROM conversations WHERE role <> 'system' GROUP BY conv_id)
""")(concat_turns)


# --- C11 in parts; C1-C10 over the lines of files ------------------------------------------
PART = 500


def concat_turn_parts(spark, sf_dir):
    from tessera.operators.cleaning import concat_parts
    c = concat_parts(S.chat_turns(spark, sf_dir), "conv_id", "turn", "text", "\n\n", PART)
    return c.select("conv_id", "part_no", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def _sql_parts(key: str, t: str) -> str:
    return (f"SELECT {key}, i // {PART} AS part_no, length(x)::BIGINT AS n_chars, md5(x) AS digest FROM ("
            f"SELECT {key}, i, substr(t, (i + 1)::INT, {PART}) AS x FROM (SELECT *, unnest(range(0, greatest(length(t), 1), {PART})) AS i FROM ({t})))")


register("concat_turn_parts", _sql_parts("conv_id", f"""SELECT conv_id, string_agg(text, {Q.SEP} ORDER BY turn) AS t
FROM conversations WHERE role <> 'system' GROUP BY conv_id"""))(concat_turn_parts)


def book_clean_lines(spark, sf_dir):
    """All documents as files, cleaned line by line, shown in parts of equal length."""
    import uuid

    from tessera.operators.cleaning import clean_book_lines, concat_parts
    from tessera.session import ensure_checkpoint_dir
    from tessera.sources.readers import read_book_lines
    from tessera.sources.sinks import write_text_files
    folder = f"{ensure_checkpoint_dir(spark)}/books-{uuid.uuid4().hex}"
    write_text_files(S.book_rows(spark, sf_dir, None).select("path", _injected_book(F.col("text")).alias("text")), folder)
    done = concat_parts(clean_book_lines(read_book_lines(spark, folder)), "path", "place", "text", "", PART)
    return done.select("path", "part_no", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


register("book_clean_lines", _sql_parts("path", f"""SELECT * FROM (SELECT path, {Q.clean_book(_sql_injected_book("text"), "intended")} AS t
FROM ({SQL_FILES})) WHERE t <> ''"""))(book_clean_lines)

"""Registered queries: prompt synthesis (G1-G5), the category heuristic
and the responder hook (G6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import generation as GN
from tessera.operators import questions as QS
from tessera.operators import synth as SY
from tessera.session import ensure_checkpoint_dir
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
BATCH = 100


def _ids(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(vals) -> str:
    return "[" + ", ".join(_q(v) for v in vals) + "]"


def _sql_h(name: str) -> str:
    return f"('0x' || substr(md5('{SEED}:{name}:' || id::VARCHAR), 1, 8))::BIGINT"


def _sql_prompts() -> str:
    n = len(SY.CATEGORIES)
    tpls = "[" + ", ".join(_sql_list(SY.TEMPLATES[c]) for c in SY.CATEGORIES) + "]"
    sizes = "[" + ", ".join(str(len(SY.TEMPLATES[c])) for c in SY.CATEGORIES) + "]"
    cat = f"({_sql_h('category')} % {n})"
    tpl = f"({_sql_h('template')} % {sizes}[{cat} + 1])"
    expr = f"{tpls}[{cat} + 1][{tpl} + 1]"
    for slot, (lst, pre, suf) in SY.SLOTS.items():
        vals = SY.LISTS[lst]
        value = f"{_q(pre)} || {_sql_list(vals)}[{_sql_h(slot)} % {len(vals)} + 1] || {_q(suf)}"
        expr = f"replace({expr}, '{{{slot}}}', {value})"
    return (f"SELECT doc_id AS id, {_sql_list(SY.CATEGORIES)}[{cat.replace('id::', 'doc_id::')} + 1] AS category, "
            f"{expr.replace('id::VARCHAR', 'doc_id::VARCHAR')} AS prompt, (doc_id // {BATCH})::BIGINT AS batch_id "
            f"FROM documents")


SQL_PROMPTS = _sql_prompts()


def prompt_synth(spark, sf_dir):
    return SY.synthesize_prompts(_ids(spark, sf_dir), "id", SEED, BATCH)


register("prompt_synth", SQL_PROMPTS)(prompt_synth)


def prompt_category(spark, sf_dir):
    p = SY.synthesize_prompts(_ids(spark, sf_dir), "id", SEED, BATCH).select("id", "prompt")
    return QS.match_category(p, SY.CATEGORY_KEYWORDS).select("id", "category", "keyword_hits")


def document_category(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    return QS.match_category(docs, SY.CATEGORY_KEYWORDS, "text").select("doc_id", "category", "keyword_hits")


_kw_rows = ", ".join(f"({_q(c)}, {_q(k)})" for c, ks in SY.CATEGORY_KEYWORDS.items() for k in ks)
_SQL_KW = f"kw AS (SELECT * FROM (VALUES {_kw_rows}) AS t(category, keyword))"
register("prompt_category", f"""
WITH p AS ({SQL_PROMPTS}), {_SQL_KW}
SELECT p.id, kw.category, count(*) AS keyword_hits FROM p JOIN kw ON contains(lower(p.prompt), lower(kw.keyword))
GROUP BY p.id, kw.category
""")(prompt_category)
register("document_category", f"""
WITH {_SQL_KW}
SELECT doc_id, kw.category, count(*) AS keyword_hits FROM documents JOIN kw ON contains(lower(text), lower(kw.keyword))
GROUP BY doc_id, kw.category
""")(document_category)


def responder_stub(spark, sf_dir):
    p = SY.synthesize_prompts(_ids(spark, sf_dir), "id", SEED, BATCH)
    r = SY.enrich(p, SY.stub_responder, "id", "prompt", parallelism=8, concurrency=4, timeout=30.0)
    return r.select("request_index", "success", "error_type", F.length("response").cast("bigint").alias("n_chars"))


register("responder_stub", f"""
WITH p AS ({SQL_PROMPTS}), d AS (SELECT id, prompt, substr(md5(prompt), 1, 1) AS c FROM p)
SELECT id AS request_index, c NOT IN ('0', '1') AS success,
       CASE c WHEN '0' THEN 'TimeoutError' WHEN '1' THEN 'ConnectionError' END AS error_type,
       CASE WHEN c NOT IN ('0', '1') THEN length('A short answer about: ' || prompt) END::BIGINT AS n_chars
FROM d
""")(responder_stub)


# --- G6 + K3 + A3: a run that stops after its second step and is started again ----------------
class Stopped(Exception):
    pass


def generation_resumed(spark, sf_dir):
    """Progress of all batches after the second start."""
    path = f"{ensure_checkpoint_dir(spark)}/generation-{uuid.uuid4().hex}"
    prompts = SY.synthesize_prompts(_ids(spark, sf_dir), "id", SEED, BATCH)
    every = max(1, prompts.agg(F.max("batch_id")).first()[0] // 4)
    steps = []

    def stop(manifest):
        steps.append(manifest)
        if len(steps) == 2:
            raise Stopped

    try:
        GN.generate(prompts, SY.stub_responder, path, every=every, after_step=stop, parallelism=8, concurrency=4)
    except Stopped:
        pass
    GN.generate(prompts, SY.stub_responder, path, every=every, parallelism=8, concurrency=4)
    return GN.progress(spark, path)


register("generation_resumed", f"""
WITH p AS ({SQL_PROMPTS}),
b AS (SELECT batch_id, count(*) FILTER (substr(md5(prompt), 1, 1) NOT IN ('0', '1'))::BIGINT AS succeeded,
             count(*) FILTER (substr(md5(prompt), 1, 1) IN ('0', '1'))::BIGINT AS failed FROM p GROUP BY batch_id)
SELECT batch_id, succeeded, failed, sum(succeeded) OVER w::BIGINT AS total_succeeded, sum(failed) OVER w::BIGINT AS total_failed,
       sum(succeeded) OVER w * 100.0 / (sum(succeeded) OVER w + sum(failed) OVER w) AS success_rate
FROM b WINDOW w AS (ORDER BY batch_id ROWS UNBOUNDED PRECEDING)
""")(generation_resumed)

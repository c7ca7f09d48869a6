"""Registered queries: run-log analytics (W1-W6) and candidate filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import candidates as CD
from tessera.operators import runlog as RL
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


def _log(spark, sf_dir):
    return RL.events_as_log(S.table(spark, sf_dir, "events"))


SQL_LOG = """
SELECT user_id AS run_id, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS epoch, event_id AS step,
       value / 1000.0 AS loss, json_extract(props, '$.k')::DOUBLE / 10.0 AS grad_norm,
       (value + json_extract(props, '$.k')::DOUBLE) / 1000.0 AS val_loss FROM events
"""


def _sql_mean(x: str, over: str = "") -> str:
    """Amounts of ordinary size as decimals, the others (also NaN and infinities) as doubles."""
    plain = f"({x} = 0 OR abs({x}) >= 1e-9 AND abs({x}) < 1e15)"
    return (f"CASE WHEN count({x}) {over} > 0 THEN (coalesce((sum(CASE WHEN {plain} THEN {x}::DECIMAL(28,12) END) {over})::DOUBLE, 0)"
            f" + coalesce(sum(CASE WHEN NOT {plain} THEN {x} END) {over}, 0)) / count({x}) {over} END")


def _sql_epochs(log: str) -> str:
    return f"""SELECT run_id, epoch, {_sql_mean('loss')} AS mean_loss, {_sql_mean('grad_norm')} AS mean_grad,
       {_sql_mean('val_loss')} AS mean_val, count(*) AS steps FROM ({log}) GROUP BY run_id, epoch"""


def _sql_best(log: str) -> str:
    return f"""SELECT *, coalesce(v < coalesce(b, 'inf'::DOUBLE), false) AS is_best FROM (
  SELECT *, min(v) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM (SELECT *, CASE WHEN NOT isnan(mean_val) THEN mean_val END AS v FROM ({_sql_epochs(log)})))"""


def _sql_patience(log: str) -> str:
    return f"""SELECT run_id, epoch, counter, stop, (fs IS NULL OR epoch <= fs) AS trained, mean_val, is_best FROM (
  SELECT *, min(CASE WHEN stop THEN epoch END) OVER (PARTITION BY run_id) AS fs FROM (
    SELECT *, counter >= 5 AS stop FROM (
      SELECT *, (row_number() OVER (PARTITION BY run_id, grp ORDER BY epoch) - CASE WHEN grp > 0 THEN 1 ELSE 0 END)::BIGINT AS counter FROM (
        SELECT *, sum(is_best::INT) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS grp
        FROM ({_sql_best(log)})))))"""


SQL_EPOCHS, SQL_BEST = _sql_epochs(SQL_LOG), _sql_best(SQL_LOG)


# --- W1 ---------------------------------------------------------------------------
def smoothed_loss(spark, sf_dir):
    return RL.smooth(_log(spark, sf_dir), 50).select("run_id", "step", "smoothed")


register("smoothed_loss", f"""
SELECT run_id, step, {_sql_mean('loss', 'OVER w')} AS smoothed
FROM ({SQL_LOG}) WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
""")(smoothed_loss)


# --- W2 ---------------------------------------------------------------------------
def epoch_means(spark, sf_dir):
    return RL.epoch_means(_log(spark, sf_dir))


register("epoch_means", SQL_EPOCHS)(epoch_means)


# --- W3 ---------------------------------------------------------------------------
def running_best(spark, sf_dir):
    return RL.running_best(RL.epoch_means(_log(spark, sf_dir))).select("run_id", "epoch", "mean_val", "is_best")


register("running_best", f"SELECT run_id, epoch, mean_val, is_best FROM ({SQL_BEST})")(running_best)


# --- W4 ---------------------------------------------------------------------------
def patience(spark, sf_dir):
    b = RL.running_best(RL.epoch_means(_log(spark, sf_dir)))
    return RL.patience(b, 5).select("run_id", "epoch", "counter", "stop", "trained")


register("patience", f"SELECT run_id, epoch, counter, stop, trained FROM ({_sql_patience(SQL_LOG)})")(patience)


# --- W5 ---------------------------------------------------------------------------
MAX_GRAD = 0.5


def explosions(spark, sf_dir):
    f = RL.flag_explosions(_log(spark, sf_dir), MAX_GRAD)
    return f.groupBy("run_id").agg(F.sum(F.col("exploded").cast("bigint")).alias("exploded"),
                                   F.count(F.lit(1)).alias("steps"))


register("explosions", f"""
SELECT run_id, sum(CASE WHEN grad_norm > 10 * {MAX_GRAD} THEN 1 ELSE 0 END)::BIGINT AS exploded, count(*) AS steps
FROM ({SQL_LOG}) GROUP BY run_id
""")(explosions)


# --- W6 ---------------------------------------------------------------------------
def quick_val(spark, sf_dir):
    return RL.quick_val(_log(spark, sf_dir), 10)


register("quick_val", f"""
SELECT run_id, {_sql_mean('val_loss')} AS quick_loss, count(*) AS batches FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rn FROM ({SQL_LOG})) WHERE rn <= 10
GROUP BY run_id
""")(quick_val)


# --- W1-W4, W6 over a log with diverged, huge and tiny amounts ---------------------------
ODD = {1: "nan", 2: "inf", 3: "-inf", 4: "1e17", 5: "1e-13", 6: None}   # by step % 61


def _odd_log(spark, sf_dir):
    log, spot = _log(spark, sf_dir), F.pmod("step", F.lit(61))

    def odd(c):
        out = F.col(c)
        for k, v in ODD.items():
            out = F.when((spot == k) & (F.col("run_id") % 3 == k % 3), F.lit(v).cast("double")).otherwise(out)
        return out.alias(c)
    return log.select("run_id", "epoch", "step", odd("loss"), odd("grad_norm"), odd("val_loss"))


def _sql_odd(c: str) -> str:
    cases = " ".join(f"WHEN step % 61 = {k} AND run_id % 3 = {k % 3} THEN {'NULL' if v is None else repr(v) + '::DOUBLE'}" for k, v in ODD.items())
    return f"CASE {cases} ELSE {c} END AS {c}"


SQL_ODD = f"SELECT run_id, epoch, step, {', '.join(map(_sql_odd, ('loss', 'grad_norm', 'val_loss')))} FROM ({SQL_LOG})"


def epochs_diverged(spark, sf_dir):
    """Means as text: NaN and infinities compare alike in every engine."""
    p = RL.patience(RL.running_best(RL.epoch_means(_odd_log(spark, sf_dir))), 5)
    return p.select("run_id", "epoch", *[_shown(F.col(c)).alias(c) for c in ("mean_loss", "mean_grad", "mean_val")], "is_best", "counter", "stop", "trained")


def quick_val_diverged(spark, sf_dir):
    return RL.quick_val(_odd_log(spark, sf_dir), 10).select("run_id", _shown(F.col("quick_loss")).alias("quick_loss"), "batches")


def smoothed_diverged(spark, sf_dir):
    return RL.smooth(_odd_log(spark, sf_dir), 50).select("run_id", "step", _shown(F.col("smoothed")).alias("smoothed"))


def _shown(c):
    return (F.when(c.isNull(), "null").when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
            .otherwise(F.format_string("%.9e", c)))


def _sql_shown(c: str, name: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'null' WHEN isnan({c}) THEN 'nan' WHEN {c} = 'inf'::DOUBLE THEN 'inf'"
            f" WHEN {c} = '-inf'::DOUBLE THEN '-inf' ELSE printf('%.9e', {c}) END AS {name}")


register("smoothed_diverged", f"""
SELECT run_id, step, {_sql_shown('m', 'smoothed')} FROM (SELECT run_id, step, {_sql_mean('loss', 'OVER w')} AS m
FROM ({SQL_ODD}) WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
""")(smoothed_diverged)
register("epochs_diverged", f"""
SELECT p.run_id, p.epoch, {_sql_shown('e.mean_loss', 'mean_loss')}, {_sql_shown('e.mean_grad', 'mean_grad')},
       {_sql_shown('p.mean_val', 'mean_val')}, is_best, counter, stop, trained
FROM ({_sql_patience(SQL_ODD)}) p JOIN ({_sql_epochs(SQL_ODD)}) e ON p.run_id = e.run_id AND p.epoch = e.epoch
""")(epochs_diverged)
register("quick_val_diverged", f"""
SELECT run_id, {_sql_shown('m', 'quick_loss')}, batches FROM (SELECT run_id, {_sql_mean('val_loss')} AS m, count(*) AS batches FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rn FROM ({SQL_ODD})) WHERE rn <= 10 GROUP BY run_id)
""")(quick_val_diverged)


# --- W7-W13: candidates from next-piece counts over documents -------------------------
SEED = 42


def _cands(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    hist = S.table(spark, sf_dir, "benchmark").select(F.explode(T.pieces(F.col("text"))).alias("token"))
    return CD.bigram_candidates(docs), hist


SQL_CANDS = f"""
p AS (SELECT {Q.pieces('text')} AS pc FROM documents),
b AS (SELECT unnest(list_slice(pc, 1, len(pc) - 1)) AS g, unnest(list_slice(pc, 2, len(pc))) AS token
      FROM p WHERE len(pc) > 1),
cand AS (SELECT g, token, count(*) AS n, ln(count(*)) AS score FROM b GROUP BY g, token),
hist AS (SELECT DISTINCT unnest({Q.pieces('text')}) AS h FROM benchmark)
"""


def _sql_preset(t, pen, k, p, tag=""):
    return f"""
pen{tag} AS (SELECT c.g, c.token, c.n, c.score,
                 (CASE WHEN h.h IS NOT NULL THEN c.score / {pen} ELSE c.score END) / {t} AS logit
          FROM cand c LEFT JOIN hist h ON c.token = h.h),
tk{tag} AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY g ORDER BY logit DESC) AS r FROM pen{tag}) WHERE r <= {k}),
e1{tag} AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY g)) AS e FROM tk{tag}),
s1{tag} AS (SELECT *, e / sum(e) OVER (PARTITION BY g) AS p0 FROM e1{tag}),
nu{tag} AS (SELECT g, token, n, score, logit FROM (
         SELECT *, coalesce(sum(p0) OVER (PARTITION BY g ORDER BY logit DESC, token
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before
         FROM s1{tag}) WHERE before <= {p}),
e2{tag} AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY g)) AS e FROM nu{tag}),
fin{tag} AS (SELECT g, token, n, score, logit, e / sum(e) OVER (PARTITION BY g) AS prob FROM e2{tag})
"""


BAL = CD.PRESETS["balanced"]


def softmax_topk(spark, sf_dir):
    c, h = _cands(spark, sf_dir)
    t, pen, k, _ = BAL
    s = CD.softmax(CD.top_k(CD.temperature(CD.penalize(c, h, pen), t), k))
    return s.select("g", "token", F.round("prob", 6).alias("prob"))


register("softmax_topk", f"""WITH {SQL_CANDS}, {_sql_preset(BAL[0], BAL[1], BAL[2], 1.0)}
SELECT g, token, round(p0, 6) AS prob FROM s1
""")(softmax_topk)


def nucleus(spark, sf_dir):
    c, h = _cands(spark, sf_dir)
    return CD.apply_preset(c, h, *BAL).select("g", "token", F.round("prob", 6).alias("prob"))


register("nucleus", f"""WITH {SQL_CANDS}, {_sql_preset(*BAL)}
SELECT g, token, round(prob, 6) AS prob FROM fin
""")(nucleus)


def top5_view(spark, sf_dir):
    c, h = _cands(spark, sf_dir)
    v = CD.top_n_view(CD.apply_preset(c, h, *BAL), 5)
    return v.select("g", F.col("rank").cast("bigint").alias("rank"), "token", F.round("score", 6).alias("score"),
                    F.round("logit", 6).alias("logit"), F.round("prob", 6).alias("prob"))


register("top5_view", f"""WITH {SQL_CANDS}, {_sql_preset(*BAL)}
SELECT g, rank, token, round(score, 6) AS score, round(logit, 6) AS logit, round(prob, 6) AS prob FROM (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY prob DESC, token)::BIGINT AS rank FROM fin) WHERE rank <= 5
""")(top5_view)


def seeded_draw(spark, sf_dir):
    c, h = _cands(spark, sf_dir)
    return CD.draw(CD.apply_preset(c, h, *BAL), SEED)


register("seeded_draw", f"""WITH {SQL_CANDS}, {_sql_preset(*BAL)},
cum AS (SELECT *, sum(prob) OVER (PARTITION BY g ORDER BY prob DESC, token ROWS UNBOUNDED PRECEDING) AS c,
               row_number() OVER (PARTITION BY g ORDER BY prob DESC, token) AS rn,
               count(*) OVER (PARTITION BY g) AS last,
               ('0x' || substr(md5('{SEED}:' || g), 1, 13))::BIGINT / 4503599627370496.0 AS u
        FROM fin)
SELECT g, arg_min(token, rn) AS token FROM cum WHERE c >= u OR rn = last GROUP BY g
""")(seeded_draw)


def preset_compare(spark, sf_dir):
    c, h = _cands(spark, sf_dir)
    a = CD.apply_presets(c, h)
    return a.groupBy("preset", "g").agg(F.count(F.lit(1)).alias("kept"))


_parts = []
for _i, (_name, _v) in enumerate(CD.PRESETS.items()):
    _parts.append(_sql_preset(*_v, tag=str(_i)))
register("preset_compare", "WITH " + SQL_CANDS + ", " + ", ".join(_parts) + " " + " UNION ALL ".join(
    f"SELECT '{_name}' AS preset, g, count(*) AS kept FROM fin{_i} GROUP BY g"
    for _i, _name in enumerate(CD.PRESETS)))(preset_compare)

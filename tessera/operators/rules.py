"""Validation and quality rules.

A rule is ``(name, keep_condition)``.  ``with_reject_reason`` labels each row
with the first rule it fails (null when it passes all), so that kept rows,
rejected rows (a quarantine table) and rejection counts come from one pass.
Null inputs never pass a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip, words

Rule = tuple[str, Column]


def _safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def min_turns(n: int = 2, data: str = "data") -> Rule:
    return (f"min_turns_{n}", _safe(F.size(F.col(data)) >= n))


def exact_turns(n: int = 2, data: str = "data") -> Rule:
    return (f"exact_turns_{n}", _safe(F.size(F.col(data)) == n))


def min_len(n: int = 10, *cols) -> Rule:
    cols = cols or ("prompt", "response")
    cond = F.lit(True)
    for c in cols:
        cond = cond & _safe(F.length(F.col(c)) >= n)
    return (f"min_len_{n}", cond)


def min_stripped_len(n: int = 10, *cols, strict: bool = True) -> Rule:
    cols = cols or ("prompt", "response")
    cond = F.lit(True)
    for c in cols:
        ln = F.length(strip(F.col(c)))
        cond = cond & _safe(ln > n if strict else ln >= n)
    return (f"min_stripped_len_{n}", cond)


def unique_ratio(threshold: float = 0.3, over: int = 3, col: str = "response") -> Rule:
    """Drop a text with more than ``over`` words whose distinct/total word
    ratio is below ``threshold``."""
    w = words(F.col(col))
    n = F.size(w)
    bad = (n > over) & ((F.size(F.array_distinct(w)) / n) < threshold)
    return ("repetitive", _safe(~bad))


def article_len(n: int = 100, inclusive: bool = False, col: str = "text") -> Rule:
    ln = F.length(strip(F.col(col)))
    ok = F.col(col).isNotNull() & (F.col(col) != "") & (ln >= n if inclusive else ln > n)
    return ("too_short", _safe(ok))


def min_tokens(n: int = 10, col: str = "ids") -> Rule:
    return (f"min_tokens_{n}", _safe(F.size(F.col(col)) > n))


def succeeded(success: str = "success", response: str = "response") -> Rule:
    return ("failed", _safe(F.col(success) & F.col(response).isNotNull() & (F.col(response) != "")))


def reason_expr(rules: list[Rule]) -> Column:
    expr = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        expr = F.when(~cond, F.lit(name)).otherwise(expr)
    return expr


def with_reject_reason(df: DataFrame, rules: list[Rule], out: str = "reject_reason") -> DataFrame:
    return df.withColumn(out, reason_expr(rules))


def keep(df: DataFrame, rules: list[Rule] | None = None, reason: str = "reject_reason") -> DataFrame:
    if rules is not None:
        cond = F.lit(True)
        for _, c in rules:
            cond = cond & c
        return df.where(cond)
    return df.where(F.col(reason).isNull()).drop(reason)


def rejected(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull())


def reject_counts(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """Rows per outcome; the kept rows are counted under ``'kept'``."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))

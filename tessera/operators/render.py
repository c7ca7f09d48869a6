"""Rendering sources into training text (R1-R6, R8) and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import rules as R

SEP = "\n\n"


def render_chat(df: DataFrame, data: str = "data", out: str = "text") -> DataFrame:
    """R1 (after V1): ``Human: m\\n\\n`` at even, ``Assistant: m\\n\\n`` at odd
    positions, then the end-of-conversation marker.  Narrow projection."""
    body = F.array_join(
        F.transform(F.col(data), lambda m, i: F.concat(
            F.when(i % 2 == 0, F.lit(T.HUMAN)).otherwise(F.lit(T.ASSISTANT)),
            F.coalesce(m, F.lit("None")), F.lit(SEP))), "")
    return R.keep(df, [R.min_turns(2, data)]).withColumn(
        out, F.concat(body, F.lit(T.END_OF_CONVERSATION + SEP)))


def pair_columns(df: DataFrame, data: str = "data") -> DataFrame:
    return df.withColumn("prompt", F.get(F.col(data), 0)).withColumn("response", F.get(F.col(data), 1))


def pair_rules(data: str = "data") -> list:
    """V2, V3, V5 in the order the pair path applies them."""
    return [R.exact_turns(2, data), R.min_len(10, "prompt", "response"),
            R.unique_ratio(0.3, 3, "response")]


def render_pair(df: DataFrame, data: str = "data", out: str = "text") -> DataFrame:
    """R2: ``prompt\\n\\nresponse\\n\\n<|endofconversation|>\\n\\n`` after V2, V3, V5."""
    p = pair_columns(df, data)
    return R.keep(p, pair_rules(data)).withColumn(
        out, F.concat(F.col("prompt"), F.lit(SEP), F.col("response"),
                      F.lit(SEP + T.END_OF_CONVERSATION + SEP)))


def render_article(df: DataFrame, text: str = "text", end_marker: bool = False,
                   min_chars: int = 100, inclusive: bool | None = None,
                   out: str = "text") -> DataFrame:
    """R3 (after V6).

    ``end_marker=False`` is the path the corpus plan uses: keep
    ``len(strip(text)) > 100`` and emit the stripped text.  ``end_marker=True``
    is the standard path: keep ``>= 100`` and emit the raw text followed by
    ``\\n\\n<|endofarticle|>\\n\\n``.
    """
    if inclusive is None:
        inclusive = end_marker
    kept = R.keep(df, [R.article_len(min_chars, inclusive, text)])
    if end_marker:
        rendered = F.concat(F.col(text), F.lit(SEP + T.END_OF_ARTICLE + SEP))
    else:
        rendered = T.strip(F.col(text))
    return kept.withColumn(out, rendered)


def render_finetune(df: DataFrame, data: str = "data", out: str = "text") -> DataFrame:
    """R4 after V2 and V4: ``Human: p\\n\\nAssistant: r`` (no end marker)."""
    p = pair_columns(df, data)
    kept = R.keep(p, [R.exact_turns(2, data), R.min_stripped_len(10, "prompt", "response")])
    return kept.withColumn(out, F.concat(F.lit(T.HUMAN), F.col("prompt"), F.lit(SEP),
                                         F.lit(T.ASSISTANT), F.col("response")))


def to_pair_records(results: DataFrame, source: str = "generated_training_data") -> DataFrame:
    """R8 / K1 rows: successful results as ``{data:[p, r], metadata:{...}}``."""
    ok = R.keep(results, [R.succeeded()])
    return ok.select(
        F.col("request_index"),
        F.array(F.col("prompt"), F.col("response")).alias("data"),
        F.struct(F.col("timestamp"), F.col("model"), F.lit(source).alias("source")).alias("metadata"))


def preview(df: DataFrame, text: str = "text", n: int = 10, width: int = 300,
            min_chars: int = 50, order: str | None = None, group: str | None = None,
            out: str = "preview") -> DataFrame:
    """First ``n`` rows (per ``group`` if given) whose text is longer
    than ``min_chars``, whitespace-collapsed and cut to ``width`` + '...'."""
    base = df.where(F.length(F.col(text)) > min_chars)
    shown = T.ellipsize(T.collapse_ws(F.col(text)), width)
    if group is None:
        base = base.orderBy(order).limit(n) if order else base.limit(n)
        return base.withColumn(out, shown)
    w = Window.partitionBy(group).orderBy(order)
    return (base.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
            .drop("_rn").withColumn(out, shown))


def preview_chunks(df: DataFrame, text: str = "text", n: int = 10, width: int = 300,
                   min_chars: int = 50, shown: int = 250, out: str = "chunk") -> DataFrame:
    """``width``-character slices over the first ``width * n * 3``
    characters of each text, stripped; slices of at most ``min_chars``
    characters are skipped, the first ``n`` are shown whitespace-collapsed
    and cut to ``shown`` + '...'.  Array expressions per row: no shuffle."""
    head_len = F.least(F.length(F.col(text)), F.lit(width * n * 3))
    starts = F.sequence(F.lit(0), F.greatest(head_len - 1, F.lit(0)), F.lit(width))
    starts = F.when(head_len > 0, starts).otherwise(F.array().cast("array<int>"))
    chunks = F.filter(F.transform(starts, lambda s: T.strip(F.substring(F.col(text), s + 1, width))),
                      lambda c: F.length(c) > min_chars)
    view = F.transform(F.slice(chunks, 1, n), lambda c: T.ellipsize(T.collapse_ws(c), shown))
    return df.select("*", F.posexplode(view).alias("chunk_no", out))

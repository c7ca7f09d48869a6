"""Corpus preparation over a user's own sources (S1-S6, V, R, L1-L2, U1-U2, L7, T9-T10, A1-A2,
A11, K6, K7): files or DataFrames in, committed outputs out.

    prepare(spark, [Source("book", path="/data/books"), Source("chat", rows=chats, sample=100_000),
                    Source("pair", path="/data/pairs.json", cap=5000), Source("article", rows=articles)], "/data/out")

1. Each source is read (an optional path that doesn't exist is an empty source with
   the reason in the report), sampled or capped before any rule, checked by its rules,
   and rendered.  ``observe`` counts what came in, what was kept and which rule rejected
   how many, in the job that writes the rendered documents: nothing is read twice for the report.
2. The documents of all sources, in the order of the list, become one stream, are
   split and packed (``corpus.counted``, ``corpus.runs_of``).
3. ``documents``, ``windows-train``, ``windows-val`` and ``report`` are published under ``out``
   (``sources.committed``): a run that stops in between leaves the parts it published whole.

Shapes: books ``path, text``; chats ``id, data`` (messages in turn); pairs ``id, data``; articles
``id, text``.  ``key`` names the order key if it is another column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators import render as RD
from tessera.operators import rules as R
from tessera.operators.cleaning import clean_book
from tessera.operators.packing import shifted
from tessera.operators.sampling import first_n, sample_exact
from tessera.operators.stats import mix
from tessera.plans import corpus as C
from tessera.session import cut_table
from tessera.sources import readers as RS
from tessera.sources.committed import publish, read_committed
from tessera.sources.json_array import read_array

KINDS = ("book", "chat", "pair", "article")
KEYS = {"book": "path", "chat": "id", "pair": "id", "article": "id"}
TEXT = {"book": "text", "article": "text", "chat": "data", "pair": "data"}


@dataclass
class Source:
    kind: str
    rows: DataFrame | None = None     # given rows, or
    path: str | None = None           # where they are
    name: str | None = None           # in the report; the kind if not given
    key: str | None = None
    sample: int | None = None         # so many rows, drawn by their keys (0 switches the source off)
    cap: int | None = None            # the first so many rows in the order of the key
    optional: bool = True
    options: dict = field(default_factory=dict)


def _read(spark: SparkSession, s: Source) -> tuple[DataFrame | None, str | None]:
    """``(rows, why there are none)``."""
    if s.sample == 0 or s.cap == 0:
        return None, "switched off"
    if s.rows is not None:
        return s.rows, None
    if s.path is None:
        return None, "not given"
    try:
        if s.kind == "book":
            return RS.read_books(spark, s.path, **s.options), None
        if not RS._exists(spark, s.path):
            raise RS.SourceMissing(f"no such path: {s.path}")
    except (RS.SourceMissing, FileNotFoundError) as e:
        if not s.optional:
            raise
        return None, str(e)
    if s.kind == "pair":
        rows = read_array(spark, s.path, RS.PAIR_SCHEMA, **s.options)
        place = F.format_string("%s:%020d", F.regexp_extract("_file", "([^/]+)$", 1), "_offset")
        return rows.select(place.alias(s.key or "id"), "data"), None
    return RS.read_table(spark, s.path, **s.options), None


def _rules(kind: str) -> list:
    return {"book": [("empty", F.coalesce(F.col("text") != "", F.lit(False)))], "chat": [R.min_turns(2)], "pair": RD.pair_rules(),
            "article": [R.article_len(100)]}[kind]


def _rendered(rows: DataFrame, kind: str) -> DataFrame:
    """``text`` of every row (whatever its rules say)."""
    if kind == "book":
        return rows
    if kind == "article":
        return rows.withColumn("text", X.strip(F.col("text")))
    if kind == "pair":
        return rows.withColumn("text", F.concat("prompt", F.lit(RD.SEP), "response", F.lit(RD.SEP + X.END_OF_CONVERSATION + RD.SEP)))
    turns = F.transform("data", lambda m, i: F.concat(F.when(i % 2 == 0, F.lit(X.HUMAN)).otherwise(F.lit(X.ASSISTANT)),
                                                      F.coalesce(m, F.lit("None")), F.lit(RD.SEP)))
    return rows.withColumn("text", F.concat(F.array_join(turns, ""), F.lit(X.END_OF_CONVERSATION + RD.SEP)))


def _documents(s: Source, rows: DataFrame, place: int, seed: int, seen: Observation) -> DataFrame:
    """The kept documents of one source, counted as they pass."""
    key = s.key or KEYS[s.kind]
    rows = rows.select(F.col(key).alias("key"), TEXT[s.kind])
    if s.sample is not None:
        rows = sample_exact(rows, s.sample, "key", seed)
    if s.cap is not None:
        rows = first_n(rows, s.cap, "key")
    if s.kind == "book":
        rows = clean_book(rows)
    elif s.kind == "pair":
        rows = RD.pair_columns(rows)
    rules = _rules(s.kind)
    tagged = R.with_reject_reason(rows, rules)
    counts = [F.count(F.lit(1)).alias("rows_in"), F.count(F.when(F.col("reject_reason").isNull(), 1)).alias("rows_kept")]
    counts += [F.count(F.when(F.col("reject_reason") == n, 1)).alias(f"reject_{k}") for k, (n, _) in enumerate(rules)]
    kept = R.keep(tagged.observe(seen, *counts))
    number = isinstance(kept.schema["key"].dataType, T.IntegralType)
    out = _rendered(kept, s.kind)
    return out.select(
        F.lit(s.name or s.kind).alias("source"), F.lit(place).alias("source_ord"),
        (F.lit("") if number else F.col("key").cast("string")).alias("okey"),
        (F.col("key").cast("long") if number else F.lit(0).cast("long")).alias("id"), F.lit(0).cast("long").alias("part_no"), "text",
        F.lit(s.kind != "book").alias("eos"))


DOCUMENTS = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_ord", T.IntegerType()), T.StructField("okey", T.StringType()),
                          T.StructField("id", T.LongType()), T.StructField("part_no", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("eos", T.BooleanType())])


def prepare(spark: SparkSession, sources: list[Source], out: str, seed: int = 42, length: int = C.WINDOW, frac: float = C.TRAIN_SPLIT) -> DataFrame:
    """Publish documents, windows and report under ``out``; returns the report, a row per
    source in order: ``source, rows_in, rows_kept, rejected, note, tokens, train_tokens, val_tokens, pct``."""
    parts, seen, notes = [], {}, {}
    for place, s in enumerate(sources):
        if s.kind not in KINDS:
            raise ValueError(f"{s.kind!r} is none of {KINDS}")
        rows, notes[place] = _read(spark, s)
        if rows is not None:
            seen[place] = Observation()
            parts.append(_documents(s, rows, place, seed, seen[place]))
    docs = spark.createDataFrame([], DOCUMENTS)
    for p in parts:
        docs = p if p is parts[0] else docs.unionByName(p)
    publish(docs, out, "documents")
    counts = []
    for place, s in enumerate(sources):
        got = seen[place].get if place in seen else {}
        rejected = {n: got[f"reject_{k}"] for k, (n, _) in enumerate(_rules(s.kind)) if got.get(f"reject_{k}")}
        counts.append((place, s.name or s.kind, got.get("rows_in", 0), got.get("rows_kept", 0),
                       ", ".join(f"{n}: {c}" for n, c in sorted(rejected.items())), notes[place]))
    counts = spark.createDataFrame(counts, "source_ord int, source string, rows_in long, rows_kept long, rejected string, note string")
    docs = read_committed(spark, out, ["documents"])
    end = F.when(F.col("eos"), F.lit("")).otherwise(F.lit("\n\n"))
    rows = C.counted(docs.select(*C.UNIT_ORDER, "source", F.concat("text", end).alias("part"), "eos"))
    runs, totals, _ = C.runs_of(rows, length, 1, frac)
    windows = cut_table(shifted(runs, length, tail=True))
    for split in totals:
        publish(windows.where(F.col("split") == split).drop("split"), out, f"windows-{split}")
    train = F.least(F.greatest(F.lit(totals["train"]) - F.col("offset"), F.lit(0)), F.col("n"))
    per = rows.groupBy("source_ord").agg(F.sum("n").alias("tokens"), F.sum(train).alias("train_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    report = counts.join(F.broadcast(per), "source_ord", "left").withColumn("tokens", zero(F.col("tokens"))).withColumn("train_tokens", zero(F.col("train_tokens")))
    report = mix(report.withColumn("val_tokens", F.col("tokens") - F.col("train_tokens")), "tokens", "pct")
    publish(report.orderBy("source_ord").drop("source_ord"), out, "report", "json")
    return read_committed(spark, out, ["report"])

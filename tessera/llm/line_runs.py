"""Line dedup: later copies of repeated line runs are deleted.

A run is a stretch of consecutive lines of one document with ``min_words``
words or more; lines are equal if their text is equal.  A line goes if it lies
in a run that occurs earlier as well, where "earlier" is by document id and
then by line number.  So the first copy of each maximal repeated run stays and
the later ones go.

Method: a suffix array over the line-id sequences by prefix doubling.

1. Per document the line digests and word counts are kept (no text).  Lines
   that occur once can be in no repeated run: what is left are islands of
   repeated lines, of which only those with ``min_words`` words matter.
2. Level 0 ranks suffixes by their first line.  Level ``k + 1`` ranks the
   pairs (rank of a position, rank of the position ``2**k`` further on) of
   level ``k``, i.e. suffixes by their first ``2**(k+1)`` lines: the distinct
   pairs are range-sorted and their place is the rank.  Positions whose rank
   is theirs alone leave (no longer run from there repeats).
3. All suffixes that share their first ``n`` lines form one interval of the
   suffix array with a longest common prefix of ``n`` or more; with ``2**k``
   the largest power up to ``n``, its key is (n, rank at the start, rank
   ``n - 2**k`` further on).  Each interval's smallest member is the first
   copy, the others are later copies.
4. A maximal repeated run is the union of the shortest runs of ``min_words``
   words that start or end at its lines, so only those lengths are looked up
   and their later copies are deleted, after a document's overlapping copies
   are merged into disjoint spans.

Every group is an aggregate with partial sums; one document's lines are the
largest thing that one task holds.

Defined results: null and empty texts stay as they are; rows equal in id and
text are one document (each gets its result); rows with equal ids and unequal
texts are documents ordered by a digest; null ids come first; blank lines have
no words but belong to runs; a document whose lines all go has an empty text;
an empty table gives an empty result; all columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, fresh, let

MIN_WORDS = 50
DOC = ["did", "dkey"]


def ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` of at least two rows with an order-preserving rank."""
    some = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    # after the checkpoint a row's partition and place are fixed: they are its rank
    return cut(some.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn(
        "rank", F.monotonically_increasing_id())


def islands(lines: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines in islands of ``min_words`` words, with the shortest run
    of that many words from each line (``fend``) and up to it (``bstart``)."""
    doc = Window.partitionBy(*DOC).orderBy("pos")
    isl = Window.partitionBy(*DOC, "isl")
    reach = min_words - 1
    ahead = isl.orderBy("u").rangeBetween(0, reach)
    back = isl.orderBy("c").rangeBetween(-reach, 0)
    return (lines.withColumn("isl", F.col("pos") - F.row_number().over(doc))
            .withColumn("c", F.sum("w").over(isl.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("u", F.col("c") - F.col("w"))
            .withColumn("total", F.sum("w").over(isl)).where(F.col("total") >= min_words)
            .withColumn("fend", F.when(F.max("c").over(ahead) - F.col("u") >= min_words, F.max("pos").over(ahead)))
            .withColumn("bstart", F.when(F.col("c") - F.min("u").over(back) >= min_words, F.min("pos").over(back)))
            .select(*DOC, "isl", "pos", "line", "fend", "bstart"))


def later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """``did, dkey, start, len`` of the runs that occur earlier as well.
    ``docs``: ``did, dkey, lines`` with ``lines`` an array of (h1, h2, w)."""
    lines = docs.select(*DOC, F.posexplode("lines").alias("pos", "l")).select(
        *DOC, "pos", F.col("l.h1").alias("h1"), F.col("l.h2").alias("h2"), F.col("l.w").cast("long").alias("w"))
    ids = ranked(lines, ["h1", "h2"]).withColumnRenamed("rank", "line")
    held = cut(islands(lines.join(ids, ["h1", "h2"]), min_words))
    runs = held.where("fend is not null").select(*DOC, "isl", F.col("pos").alias("start"), (F.col("fend") - F.col("pos") + 1).alias("len"))
    runs = runs.unionByName(held.where("bstart is not null").select(
        *DOC, "isl", F.col("bstart").alias("start"), (F.col("pos") - F.col("bstart") + 1).alias("len"))).distinct()
    runs = cut(runs.withColumn("level", F.floor(F.log2(F.col("len") + 0.5)).cast("int")))
    longest = runs.agg(F.max("level")).first()[0]
    level = held.select(*DOC, "isl", "pos", F.col("line").alias("r"))
    found = None
    for k in range(0 if longest is None else longest + 1):
        at = level.select(*DOC, F.col("pos").alias("start"), F.col("r").alias("ra"))
        to = level.select(*DOC, F.col("pos").alias("last"), F.col("r").alias("rb"))
        keyed = (runs.where(F.col("level") == k).withColumn("last", F.col("start") + F.col("len") - (1 << k))
                 .join(at, [*DOC, "start"]).join(to, [*DOC, "last"]).select(*DOC, "start", "len", "ra", "rb"))
        place = F.struct(*DOC, "start")
        first = keyed.groupBy("len", "ra", "rb").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
        copies = keyed.join(first, ["len", "ra", "rb"]).where(place != F.col("first")).select(*DOC, "start", "len")
        found = copies if found is None else found.unionByName(copies)
        if k < longest:
            step = Window.partitionBy(*DOC, "isl").orderBy("pos").rangeBetween(1 << k, 1 << k)
            pairs = level.withColumn("r2", F.max("r").over(step)).where("r2 is not null")
            names = ranked(pairs, ["r", "r2"])
            level = cut(pairs.join(names, ["r", "r2"]).select(*DOC, "isl", "pos", F.col("rank").alias("r")))
    if found is None:
        return held.select(*DOC, F.col("pos").alias("start"), F.col("pos").alias("len")).where("false")
    return found


def spans(runs: DataFrame) -> DataFrame:
    """``did, dkey, start, end`` of the disjoint stretches of lines that the
    runs cover: runs that overlap or touch are one."""
    longest = runs.groupBy(*DOC, "start").agg(F.max(F.col("start") + F.col("len") - 1).alias("end"))
    doc = Window.partitionBy(*DOC).orderBy("start")
    apart = F.col("start") > F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1)) + 1
    part = longest.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn(
        "span", F.sum("apart").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*DOC, "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("span")


def delete_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                         deleted_col: str | None = None) -> DataFrame:
    """``docs`` with the later copies of repeated line runs taken out of
    ``text_col``; ``deleted_col`` gets the number of deleted lines."""
    did, dkey, gone = fresh(docs, "_line_did", "_line_key", "_line_gone")
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumns({did: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))),
                              dkey: F.xxhash64(F.col(f"`{id_col}`"), text)})
    line = F.transform(F.split(text, "\n", -1), lambda l: F.struct(
        F.xxhash64(l).alias("h1"), F.xxhash64(l, F.lit("line")).alias("h2"),
        F.regexp_count(l, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")))
    narrow = cut(keyed.where(text.isNotNull()).select(F.col(did).alias("did"), F.col(dkey).alias("dkey"), line.alias("lines"))
                 .groupBy(*DOC).agg(F.any_value("lines").alias("lines")))
    # the spans share no line, so a document's list has at most its number of lines
    cut_out = F.flatten(F.transform(F.collect_list(F.struct("start", "end")), lambda r: F.sequence(r["start"], r["end"])))
    dead = spans(later_copies(narrow, min_words)).groupBy(*DOC).agg(cut_out.alias(gone)).select(
        F.col("did").alias(did), F.col("dkey").alias(dkey), gone)

    def rest(lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    out = keyed.join(dead, [did, dkey], "left")
    kept = F.when(F.col(gone).isNull(), text).otherwise(let(F.split(text, "\n", -1), rest))
    extra = [F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(deleted_col)] if deleted_col else []
    return out.select(*(kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *extra)

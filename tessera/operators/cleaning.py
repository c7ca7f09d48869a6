"""Book cleaning (C1-C11): as one chained projection over whole texts, or over
lines and parts for books and groups that must not become one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.ordering import broadcast_if_small, ranged, running_sum
from tessera.session import cut_table

# Start / end boundary words of the book rules.
START_WORDS = ("PREFACE", "CHAPTER")      # tested on the upper-cased line
END_WORDS = ("gutenberg", "copyright")    # tested on the lower-cased line


def _has_start(line: Column) -> Column:
    u = F.upper(line)
    return u.contains(START_WORDS[0]) | u.contains(START_WORDS[1])


def _has_end(line: Column) -> Column:
    lo = F.lower(line)
    return lo.contains(END_WORDS[0]) | lo.contains(END_WORDS[1])


def boundaries(text: Column, end_rule: str = "intended") -> tuple[Column, Column, Column]:
    """Return ``(lines, start, end)``: 0-based ``[start, end)`` of the kept lines.

    * start: first line that contains PREFACE or CHAPTER (case-insensitive),
      else 0.  A table-of-contents line counts.
    * end, ``intended``: the *last* line that contains "gutenberg" or
      "copyright" (case-insensitive) is the first dropped line; the scan runs
      from the end, so with a long licence only its last matching line and
      what follows is cut.
    * end, ``reference``: the rule the original loop really applies (it tests
      a stale variable): take the start-marker line if one was found, else the
      last line; if that line holds one of the end words, drop exactly the
      last line, else drop nothing.
    """
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    start_pos = F.array_position(F.transform(lines, _has_start), True)
    start = F.when(start_pos > 0, start_pos - 1).otherwise(F.lit(0)).cast("int")
    if end_rule == "intended":
        rev_pos = F.array_position(F.reverse(F.transform(lines, _has_end)), True)
        end = F.when(rev_pos > 0, n - rev_pos).otherwise(n)
    elif end_rule == "reference":
        probe = F.when(start_pos > 0, F.element_at(lines, start_pos.cast("int"))).otherwise(
            F.element_at(lines, -1))
        end = F.when(_has_end(probe), n - 1).otherwise(n)
    else:
        raise ValueError(f"unknown end_rule {end_rule!r}")
    return lines, start, end.cast("int")


def clean_text(text: Column, end_rule: str = "intended") -> Column:
    lines, start, end = boundaries(text, end_rule)
    kept = F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n")
    kept = T.normalize_blank_lines(kept)
    kept = T.collapse_blanks(kept)
    kept = T.drop_number_lines(kept)
    kept = T.drop_chapter_headers(kept)
    return T.strip(kept)


def clean_book(df: DataFrame, text: str = "text", end_rule: str = "intended",
               out: str | None = None) -> DataFrame:
    """Boundaries, blank-line and blank collapsing, page-number and
    chapter-header removal, strip — in that order, as native expressions."""
    return df.withColumn(out or text, clean_text(F.col(text), end_rule))


def concat_ordered(df: DataFrame, group: str, order: str, text: str = "text",
                   sep: str = "\n\n", out: str = "text") -> DataFrame:
    """C11: per group, the texts in ``order`` joined by ``sep``.

    Meant for groups that form one bounded document (e.g. the parts of one
    book).  A whole corpus is never concatenated into one value: the corpus
    plan keeps one row per book plus an order key instead.
    """
    return df.groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))),
                                 lambda x: x[text]), sep).alias(out))


def concat_parts(df: DataFrame, group: str, order: list[str] | str, text: str = "text", sep: str = "\n\n",
                 size: int = 65_536, part: str = "part_no", out: str = "text") -> DataFrame:
    """C11 for groups of any size: ``group, part_no, out``, the joined texts cut
    into parts of ``size`` characters (the last one shorter), never one value.

    A running sum over the rows in (group, order) gives every text its place in its group's
    whole; texts are cut at the parts' borders and meet part by part.  A group
    that holds a third of all rows is spread like any other rows: no task holds more than
    a part.  Null texts are left out (without a separator); a group of empty texts has one empty part;
    a null group is a group.  Rows equal in ``order`` follow each other in some order, frozen."""
    order = [order] if isinstance(order, str) else list(order)
    rows = df.where(F.col(text).isNotNull()).select(F.col(group).alias("_g"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)],
                                                    F.col(text).alias("_t"))
    lie = ranged(rows, ["_g", *(f"_o{k}" for k in range(len(order)))])
    summed = running_sum(lie.withColumn("_n", (F.length("_t") + len(sep)).cast("long")), "_n", "_off", row="_row", store=cut_table)
    base = summed.groupBy("_g").agg(F.min("_off").alias("_base"), F.min("_row").alias("_first"))
    placed = summed.alias("s").join(broadcast_if_small(base).alias("b"), F.col("s._g").eqNullSafe(F.col("b._g"))).select(
        F.col("s._g").alias("_g"), "_row", F.concat(F.lit(sep), "_t").alias("_s"), (F.col("_off") - F.col("_base") - len(sep)).alias("_at"),
        (F.col("_row") == F.col("_first")).alias("_head"))
    end = F.col("_at") + F.length("_s")
    placed = placed.withColumn("_end", end).where((F.col("_end") > F.greatest("_at", F.lit(0))) | F.col("_head"))
    first, last = F.floor(F.greatest("_at", F.lit(0)) / size), F.greatest(F.floor((F.col("_end") - 1) / size), F.lit(0))
    cut = placed.withColumn("_p", F.explode(F.sequence(first, F.greatest(last, first))))
    lo = F.greatest(F.col("_p") * size, "_at", F.lit(0))
    hi = F.least(F.col("_p") * size + size, "_end")
    cut = cut.select("_g", "_p", "_row", F.substring("_s", (lo - F.col("_at") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).alias("_f"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "_f"))), lambda x: x["_f"]), "")
    return cut.groupBy("_g", "_p").agg(whole.alias(out)).select(F.col("_g").alias(group), F.col("_p").cast("long").alias(part), out)


#: A line that the later steps may remove: blank, only a number, or an isolated chapter header.
SPECIAL = T.U + "^" + T.WSJ + r"*(\p{Nd}+|CHAPTER [IVXLC\p{Nd}]+)?" + T.WSJ + "*$"


def clean_book_lines(lines: DataFrame, path: str = "path", order: list[str] | None = None, line: str = "line") -> DataFrame:
    """C1-C10 over lines: ``path, place, text``, the cleaned book of every ``path`` in
    pieces, in the order of ``place``; put one behind the other they are what ``clean_book``
    gives for the whole text.  No book is ever one value or one task's.

    Boundaries are two-sided aggregates (first line with a start word, last one with an
    end word).  The rules that reach over line ends only ever match between two ordinary lines, so an
    ordinary line and the special ones behind it (blank, number, chapter header) make one piece:
    a running sum of ordinary lines numbers the pieces, and the rules run on each.  A run of
    blank lines is folded to one before it is collected.  Only the intended end rule
    (the other one looks at a stale line).  A book that is empty afterwards has no piece."""
    order = order or ["block", "at"]
    at = F.struct(*[F.col(c) for c in order])
    # written once: four jobs read the lines, and small files cost more to open than to read
    rows = cut_table(lines.select(F.col(path).alias("path"), at.alias("at"), F.coalesce(F.col(line), F.lit("")).alias("line")))
    edge = rows.groupBy("path").agg(F.min(F.when(_has_start(F.col("line")), F.col("at"))).alias("start"),
                                    F.max(F.when(_has_end(F.col("line")), F.col("at"))).alias("end"))
    kept = rows.join(broadcast_if_small(edge), "path").where((F.col("start").isNull() | (F.col("at") >= F.col("start")))
                                                             & (F.col("end").isNull() | (F.col("at") < F.col("end")))).select("path", "at", "line")
    blank, special = F.col("line").rlike(T.U + "^" + T.WSJ + "*$"), T.collapse_blanks(F.col("line")).rlike(SPECIAL)
    lie = ranged(kept, ["path", "at"]).withColumn("blank", blank).withColumn("full", (~blank).cast("long")).withColumn("own", (~special).cast("long"))
    summed = running_sum(lie, ["full", "own"], ["full_before", "own_before"], store=cut_table)
    folded = summed.groupBy("path", (F.col("own_before") + F.col("own")).alias("place"), "full_before", "blank").agg(
        F.min(F.struct("at", "line")).alias("l"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    pieces = cut_table(folded.groupBy("path", "place").agg(joined.alias("raw")))
    ends = pieces.groupBy("path").agg(F.min("place").alias("head"), F.max("place").alias("tail"))
    known = pieces.join(broadcast_if_small(ends), "path")
    text = F.concat("raw", F.when(F.col("place") == F.col("tail"), "").otherwise("\n"))
    for step in (T.normalize_blank_lines, T.collapse_blanks, T.drop_number_lines, T.drop_chapter_headers):
        text = step(text)
    known = cut_table(known.withColumn("text", text))
    # if nothing of the first piece is left, the second one is where the book begins
    heads = known.where(F.col("place") == F.col("head")).select("path", (T.strip(F.col("text")) == "").alias("none"))
    done = known.join(broadcast_if_small(heads), "path")
    begin = F.col("place") == F.col("head") + F.col("none").cast("long")
    text = F.when(begin, F.ltrim("text", F.lit(T.WHITESPACE))).otherwise(F.col("text"))
    text = F.when(F.col("place") == F.col("tail"), F.rtrim(text, F.lit(T.WHITESPACE))).otherwise(text)
    return done.where(~F.col("none") | (F.col("place") > F.col("head"))).select(F.col("path").alias(path), "place", text.alias("text")).where("text <> ''")

"""Conversation structure repair by secondary-sorted streaming.

The rows of a conversation are edited at least cost until their roles read
"an optional system turn, then user and assistant in turns".  Keeping a row
costs 0, giving it the role of a user or an assistant 1, deleting it 2, adding
an empty turn 5; a row that breaks off and stays costs 5 more; blank rows and
rows seen before have to go.  Of equally cheap edits the ASCII-least string of
initials (D, I, K, R) is taken.

One shuffle by conversation; Spark sorts (and spills) each partition, first to
mark repeated rows, then by turn.  ``mapInPandas`` streams the sorted rows: a
conversation may span any number of Arrow batches, what is carried is the
vector of least costs of the four places in the pattern and the order of their
edit strings, and one byte for each row and place says where the best way came
from.  Rows wait for the end of their conversation; beyond ``SPILL_ROWS`` or
``SPILL_CHARS`` they and their back pointers go to an unnamed scratch file of the task,
which is read backwards once for the edits and forwards once for the rows.
A task holds one block of rows, whatever the length of a conversation.

Defined cases: null roles and texts are one space, null turns come first, rows
of one turn follow each other by role and text; a null id is an id like any other;
an empty role has the initial of a null one; rows that are not ``present``
(and a conversation of only such rows) add nothing but the id.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPILL_ROWS = 65_536
SPILL_CHARS = 16_000_000
BATCH_ROWS = 4_096
BATCH_CHARS = 4_000_000

WHITE_CHARS = " \t\n\x0b\x0c\r"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
CUT_OFF = 5              # extra cost of a row that breaks off and stays
NEVER = 1 << 40
#: Places in the pattern: nothing yet, after system, after user, after assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = "DKR"
MUST_GO, SOUND, BREAKS_OFF = range(3)


def _add(place: int) -> int:
    """The place after the next user or assistant turn."""
    return ASSISTANT if place == USER else USER


def _keep(place: int, initial: str) -> int | None:
    """The place after a row of this initial, if it may follow."""
    if initial == "s" and place == NONE:
        return SYSTEM
    if initial == ("a" if place == USER else "u"):
        return _add(place)
    return None


def _moves(place: int, initial: str, kind: int):
    """``(edits, cost, next place, code)`` of every way to take one row."""
    at, added = place, 0
    while added < 3:
        ways = [("D", at, 0)]
        if kind != MUST_GO:
            extra = CUT_OFF if kind == BREAKS_OFF else 0
            ways.append(("R", _add(at), extra))
            kept = _keep(at, initial)
            if kept is not None:
                ways.append(("K", kept, extra))
        for letter, to, extra in ways:
            yield ("I" * added + letter, added * COST["I"] + COST[letter] + extra, to,
                   place | added << 2 | LETTERS.index(letter) << 4)
        at, added = _add(at), added + 1


def _step(costs, ranks, initial, kind):
    """Costs (from 0) and ranks of the four places after one more row, what the least
    cost grew by, and the four back pointers."""
    best: list = [None] * 4
    for place, cost in enumerate(costs):
        if cost < NEVER:
            for edits, more, to, code in _moves(place, initial, kind):
                found = (cost + more, ranks[place], edits, code)
                if best[to] is None or found < best[to]:
                    best[to] = found
    order = sorted((b[1], b[2], p) for p, b in enumerate(best) if b)
    new_ranks = [0] * 4
    for rank, (_, _, p) in enumerate(order):
        new_ranks[p] = rank
    least = min(b[0] for b in best if b)
    return (tuple(b[0] - least if b else NEVER for b in best), tuple(new_ranks), least,
            bytes(b[3] if b else 255 for b in best))


_SEEN: dict = {}


def _cached_step(costs, ranks, initial, kind):
    """Few vectors occur (differences of costs are small): each step is computed once."""
    key = (costs, ranks, initial, kind)
    if key not in _SEEN:
        _SEEN[key] = _step(*key)
    return _SEEN[key]


class _Conversation:
    """One conversation: rows in, repaired rows out."""

    def __init__(self, conv):
        self.conv = conv
        self.costs, self.ranks = (0, NEVER, NEVER, NEVER), (0, 0, 0, 0)
        self.rows, self.back, self.chars = [], bytearray(), 0
        self.file, self.blocks = None, []

    def add(self, row) -> None:
        """``row`` = (turn, fault, role, text)."""
        _, fault, role, text = row
        kind = MUST_GO if fault in (1, 2) else BREAKS_OFF if fault == 3 else SOUND
        initial = role[:1] if role[:1] in ("s", "u", "a") else " "
        self.costs, self.ranks, _, pointers = _cached_step(self.costs, self.ranks, initial, kind)
        self.rows.append(row)
        self.back += pointers
        self.chars += len(text)
        if len(self.rows) >= SPILL_ROWS or self.chars >= SPILL_CHARS:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        pickle.dump(self.rows, self.file, protocol=pickle.HIGHEST_PROTOCOL)
        middle = self.file.tell()
        self.file.write(self.back)
        self.blocks.append((at, middle, len(self.rows)))
        self.rows, self.back, self.chars = [], bytearray(), 0

    def repaired(self):
        """``(conv, turn, edit, fault, role before, role, text)`` in order."""
        if not self.rows and not self.blocks:
            yield (self.conv, None, None, 0, None, None, None)
            return
        _, place, tail = min((c + n * COST["I"], self.ranks[p], p, n) for p, (c, n) in enumerate(zip(self.costs, (0, 2, 1, 0)))
                             if c < NEVER)[1:]
        if self.file is not None:
            if self.rows:
                self._spill()
            for _, middle, n in reversed(self.blocks):
                self.file.seek(middle)
                codes, place = _read_back(self.file.read(4 * n), place)
                self.file.seek(middle)
                self.file.write(codes)
        else:
            self.back, place = _read_back(self.back, place)
        at = NONE
        for rows, codes in self._blocks():
            for (turn, fault, role, text), code in zip(rows, codes):
                for _ in range(code >> 2 & 3):
                    at = _add(at)
                    yield (self.conv, None, "I", 0, None, "user" if at == USER else "assistant", "")
                letter = LETTERS[code >> 4]
                if letter == "D":
                    yield (self.conv, turn, "D", fault, role, None, None)
                elif letter == "R":
                    at = _add(at)
                    yield (self.conv, turn, "R", fault, role, "user" if at == USER else "assistant", text)
                else:
                    at = _keep(at, role[:1])
                    yield (self.conv, turn, "K", fault, role, role, text)
        for _ in range(tail):
            at = _add(at)
            yield (self.conv, None, "I", 0, None, "user" if at == USER else "assistant", "")

    def _blocks(self):
        if self.file is None:
            yield self.rows, self.back
        for at, middle, n in self.blocks:
            self.file.seek(at)
            rows = pickle.load(self.file)
            self.file.seek(middle)
            yield rows, self.file.read(n)
        if self.file is not None:
            self.file.close()


def _read_back(pointers, place: int) -> tuple[bytes, int]:
    """The codes of a block's rows, in order, and the place before the block."""
    n = len(pointers) // 4
    codes = bytearray(n)
    for i in range(n - 1, -1, -1):
        codes[i] = pointers[4 * i + place]
        place = codes[i] & 3
    return bytes(codes), place


def _batched(rows, columns):
    """Rows as pandas frames of bounded length."""
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += len(row[-1] or "")
        if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pd.DataFrame(out, columns=columns, dtype=object)
            out, chars = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns, dtype=object)


REPAIRED = "conv string, turn long, edit string, fault int, was string, role string, text string"


def _stream(batches):
    def rows():
        current = None
        for frame in batches:
            for conv, present, turn, no_turn, fault, role, text in zip(*(frame[c].tolist() for c in frame.columns)):
                if current is None or conv != current.conv:
                    if current is not None:
                        yield from current.repaired()
                    current = _Conversation(conv)
                if present:
                    current.add((None if no_turn else turn, fault, role, text))
        if current is not None:
            yield from current.repaired()
    return _batched(rows(), ["conv", "turn", "edit", "fault", "was", "role", "text"])


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def repair(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: str | None = None) -> DataFrame:
    """``conv, turn, edit, fault, was, role, text``: every row of every
    conversation in order with its edit (K, R, D, I), its first fault (blank,
    duplicate, truncated or none), the role before and after, and the text that
    stays (none of a deleted row).  A conversation without rows gives one row without an edit.

    Rows of one conversation are in one partition, in order."""
    last = F.rtrim(F.col("text"), F.lit(WHITE_CHARS))
    rows = convs.select(
        F.col(conv).cast("string").alias("conv"),
        F.coalesce(F.col(present), F.lit(False)).alias("present") if present else F.lit(True).alias("present"),
        F.col(turn).cast("long").alias("turn"), _spaced(role).alias("role"), _spaced(text).alias("text"))
    rows = rows.withColumns({c: F.when(F.col("present"), F.col(c)) for c in ("turn", "role", "text")})
    seen = Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.repartition("conv").withColumn("nth", F.row_number().over(seen))
    fault = F.when(last == "", 1).when(F.col("nth") > 1, 2).when(~F.right(last, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    ordered = rows.withColumn("fault", fault).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "nth")
    done = ordered.select("conv", "present", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"),
                          F.coalesce("fault", F.lit(0)).alias("fault"), "role", "text").mapInPandas(_stream, REPAIRED)
    names = F.when(F.col("fault") == 1, "blank").when(F.col("fault") == 2, "duplicate").when(F.col("fault") == 3, "truncated")
    return done.select(F.col("conv").cast(convs.schema[conv].dataType).alias("conv"), "turn", "edit", names.alias("fault"),
                       "was", "role", "text")


REPORT = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
FAULTS = ("blank", "duplicate", "truncated")
LEGAL = frozenset(("su", "ua", "au"))


class _Report:
    """The figures of one conversation, from its repaired rows in order."""

    def __init__(self, conv):
        self.conv, self.edits, self.digest, self.any = conv, [], hashlib.sha256(), False
        self.faults = dict.fromkeys(FAULTS, 0)
        self.cost = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, edit, fault, no_turn, turn, was, role, text) -> None:
        if edit is None:
            return
        self.edits.append(edit)
        self.cost += COST[edit] + (CUT_OFF if fault == "truncated" and edit != "D" else 0)
        if fault is not None:
            self.faults[fault] += 1
        if was is not None:
            self.illegal += self.before is not None and self.before + (was[:1] or " ") not in LEGAL
            self.before = was[:1] or " "
            if not no_turn:
                self.first = turn if self.first is None else self.first
                self.turns += turn != self.last
                self.last = turn
        if role is not None:
            self.digest.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode())
            self.any = True

    def row(self):
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.edits), self.digest.hexdigest())


def _reports(batches):
    def rows():
        current = None
        for frame in batches:
            for conv, *row in zip(*(frame[c].tolist() for c in frame.columns)):
                if current is None or conv != current.conv:
                    if current is not None:
                        yield current.row()
                    current = _Report(conv)
                current.add(*row)
        if current is not None:
            yield current.row()
    return _batched(rows(), [c.split()[0] for c in REPORT.split(", ")])


def report(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s result, read in its order:
    missing turns, faults, illegal neighbours, cost, the edits' initials and the digest
    of the repaired ``role:text`` lines.  No shuffle.  Gaps of more than a long stop at the largest long."""
    kept = repaired.select(F.col("conv").cast("string").alias("conv"), "edit", "fault", F.col("turn").isNull().alias("no_turn"),
                           F.coalesce("turn", F.lit(0)).alias("turn"), "was", "role", "text")
    out = kept.mapInPandas(_reports, REPORT)
    return out.withColumn("conv", F.col("conv").cast(repaired.schema["conv"].dataType))


def damage(convs: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: every twentieth of the rows, by
    the checksum of its id and turn, is dropped (not ``present``), emptied, robbed of its
    sentence ends, repeated or given to the user."""
    spot = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    rows = convs.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), spot.alias("spot"))
    text = F.when(F.col("spot") == 1, "").when(F.col("spot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("spot") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("spot") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("spot") != 0).alias("present"), F.explode(copies)).drop("col")

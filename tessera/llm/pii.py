"""Personal data with offset-preserving deobfuscation.

A text is read twice by the same detectors: as it stands (the base spans) and
after a chain of transducers that undo disguises.  Every transducer maps a
string and, per character, the source offsets it stands for, so a span found
in the normalised text maps back to code points of the source:

* invisible characters go, homoglyphs and foreign digits become ASCII;
* spelled digits become digits, with what separates them removed;
* disguised ``at`` and ``dot`` become ``@`` and ``.``.

A span of the second reading is added if its source holds a disguise and no
base span of the same kind covers it; base spans always stay.

Defined results: null and empty texts have no span; a null id is carried;
repeated rows give equal rows; further columns are ignored.  All detectors
are linear in the text length.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_RUN = re.compile(r"[0-9]+")
_DIGIT = re.compile("[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# fixed values: letters of other scripts that look like an ASCII character
LOOKALIKES = dict(zip("аеорсухіјѕԁԛԝһӏвкмнтАВЕКМНОРСТУХІЈЅԌαεορτυχνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ·․‐‑‒–—−",
                      "aeopcyxijsdqwhlbkmhtABEKMHOPCTYXIJSGaeoptuxvikABEZHIKMNOPTYX..------"))
# fixed values: digit words of the corpus languages, accents as they are written
DIGIT_WORDS = {w: str(d) for words in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve") for d, w in enumerate(words.split())}
DIGIT_WORDS |= {"oh": "0", "nought": "0", "zwo": "2", "une": "1"}
INVISIBLE = "­​‌‍⁠﻿᠎"

_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DIGIT_WORD = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.IGNORECASE)
_PLUS = re.compile(r"(?<!\w)plus\s{0,2}(?=[0-9])", re.IGNORECASE)
_OPEN, _CLOSE = r"[\[({<]\s{0,2}", r"\s{0,2}[\])}>]"
_AT_MARK = rf"\s{{0,2}}{_OPEN}(?:at|@|arroba|arobase|ät|chez){_CLOSE}\s{{0,2}}"
_DOT_MARK = rf"\s{{0,2}}{_OPEN}(?:dot|\.|punkt|punto|point|period){_CLOSE}\s{{0,2}}"
_DOT_WORD = r"\s{1,2}(?:dot|punkt|punto)\s{1,2}|[_-](?:dot|DOT)[_-]|\s{1,2}\.\s{1,2}|\s{1,2}\.|(?<=\w)\s{0,2}\{dot\}\s{0,2}"
_AT_WORD = r"\s{1,2}(?:at|arroba)\s{1,2}|[_-](?:at|AT)[_-]|\s{1,2}@\s{0,2}|@\s{1,2}"
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{_WORD}|[0-9])(?:{_DOT_MARK}|{_DOT_WORD}|[\s,._-]{{1,2}}|(?=\s?\W))){{2,}}"
                      rf"(?:{_WORD}|[0-9])(?!\w)", re.IGNORECASE)
_LABEL = r"[A-Za-z0-9-]{1,63}"
#: What a disguised address may look like: a marked ``at`` allows any dot, a
#: spelled one needs a spelled or marked dot as well.
_ADDRESS = re.compile(
    rf"(?:(?P<a1>{_AT_MARK})|(?P<a2>{_AT_WORD})|(?P<a3>@))"
    rf"(?P<host>{_LABEL}(?:(?:{_DOT_MARK}|{_DOT_WORD}|\.){_LABEL})+)", re.IGNORECASE)
_DOTS = re.compile(rf"{_DOT_MARK}|{_DOT_WORD}", re.IGNORECASE)
#: French: "point" is an everyday word, so it is a dot only behind an "arobase".
_DOT_FRENCH = rf"{_DOT_MARK}|{_DOT_WORD}|\s{{1,2}}point\s{{1,2}}"
_ADDRESS_FRENCH = re.compile(
    rf"(?:(?P<a1>\s{{0,2}}{_OPEN}arobase{_CLOSE}\s{{0,2}})|(?P<a2>\s{{1,2}}arobase\s{{1,2}})|(?P<a3>(?!)))"
    rf"(?P<host>{_LABEL}(?:(?:{_DOT_FRENCH}|\.){_LABEL})+)", re.IGNORECASE)
_DOTS_FRENCH = re.compile(_DOT_FRENCH, re.IGNORECASE)
#: Spelled or marked dots inside what stands before an ``at``, within ``LOOK_BACK`` characters.
_NAME_DOT = rf"{_DOT_MARK}|\s{{1,2}}(?:dot|punkt|punto)\s{{1,2}}|[_-](?:dot|DOT)[_-]"
_NAME_DOTS = re.compile(_NAME_DOT, re.IGNORECASE)
LOOK_BACK = 200
_NUMBER_DOTS = re.compile(rf"(?<=[0-9])(?:{_DOT_MARK}|{_DOT_WORD})(?=[0-9])", re.IGNORECASE)
_FOREIGN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_MARKED = re.compile(r"[\[({<]\s{0,2}(?:at|@|arroba|arobase|ät|chez|dot|\.|punkt|punto|point|period)\s{0,2}[\])}>]"
                     r"|[_-](?:at|dot)[_-]|\s[@]|@\s", re.IGNORECASE)
_NEXT = str.maketrans(",.;:_-()[]{}<>@+", " " * 16)
_SPELLED_DOTS = frozenset(("dot", "punkt", "punto", "arobase"))


def hinted(text: str) -> bool:
    """Whether a text may hold a disguise at all: a foreign character, a
    marked or spaced sign, a spelled dot, or digit words next to digits."""
    if _FOREIGN.search(text) or _MARKED.search(text):
        return True
    words = text.lower().translate(_NEXT).split()
    if not _SPELLED_DOTS.isdisjoint(words):
        return True  # also "arobase"
    if DIGIT_WORDS.keys().isdisjoint(words):
        return False
    digits = [w in DIGIT_WORDS or w.isdigit() for w in words]
    return any(a and b for a, b in zip(digits, digits[1:]))


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > free and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append((i, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGIT_CHAIN.finditer(text):
        if text.count(".", m.start(), m.end()) < 3:
            continue
        runs = [r.span() for r in _RUN.finditer(text, m.start(), m.end())]
        for k in range(0, len(runs) - 3, 4):
            four = [text[a:b].lstrip("0") for a, b in runs[k:k + 4]]
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in four):
                out.append((runs[k][0], runs[k + 3][1]))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def detect(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the plain spans of a text."""
    return [(a, b, k) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text)]


class Mapped:
    """A text whose characters carry the source offsets that they stand for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]):
        """Replace ``(start, end, by)``; the edits are in order and don't overlap."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, by in edits:
            text += [self.text[at:a], by]
            start += self.start[at:a] + [self.start[a]] * len(by)
            end += self.end[at:a] + [self.end[b - 1]] * len(by)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end = start + self.start[at:], end + self.end[at:]


def plain_char(c: str) -> str:
    """The ASCII character that ``c`` stands for, or ``c``."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isspace():
        return " "
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


def homoglyphs(m: Mapped):
    m.rewrite([(x.start(), x.end(), by) for x in re.finditer(r"[^\x00-\x7f]", m.text)
               if (by := plain_char(x[0])) != x[0]])


def spelled_digits(m: Mapped):
    edits = []
    for run in _SPELLED.finditer(m.text):
        words = [w.span() for w in _DIGIT_WORD.finditer(m.text, run.start(), run.end())]
        if not words:
            continue
        units = sorted(words + [d.span() for d in _DIGIT.finditer(m.text, run.start(), run.end())])
        words = set(words)
        for k, (a, b) in enumerate(units):
            nxt = units[k + 1] if k + 1 < len(units) else None
            gap = m.text[b:nxt[0]] if nxt else ""
            join = b if not nxt or re.search(r"[.\w]", gap) or (a, b) not in words and nxt not in words else nxt[0]
            if (a, b) in words or join > b:
                edits.append((a, join, DIGIT_WORDS.get(m.text[a:b].lower(), m.text[a:b])))
    m.rewrite(edits)
    m.rewrite([(x.start(), x.end(), "+") for x in _PLUS.finditer(m.text)])


def name_dots(text: str, low: int, end: int) -> list[tuple[int, int]]:
    """The dots of the name that ends at ``end``: from there backwards, as long as
    only name characters stand between one and the next."""
    out = []
    for d in reversed(list(_NAME_DOTS.finditer(text, low, end))):
        between = text[d.end():out[-1][0] if out else end]
        if not between or not _LOCAL.issuperset(between) or d.start() == low or text[d.start() - 1] not in _LOCAL:
            break
        out.append(d.span())
    return out[::-1]


def at_and_dot(m: Mapped):
    for address, dot in ((_ADDRESS_FRENCH, _DOTS_FRENCH), (_ADDRESS, _DOTS)):
        edits, free = [], 0
        for x in address.finditer(m.text):
            if x.start() < free or not x.start() or m.text[x.start() - 1] not in _LOCAL:
                continue
            dots = list(dot.finditer(m.text, x.start("host"), x.end("host")))
            if x["a2"] and "@" not in x["a2"] and not dots or x["a3"] and not dots:
                continue
            at, low = x.span("a1" if x["a1"] else "a2" if x["a2"] else "a3"), max(free, x.start() - LOOK_BACK)
            edits += [*((a, b, ".") for a, b in name_dots(m.text, low, x.start())), (*at, "@"), *((d.start(), d.end(), ".") for d in dots)]
            free = x.end()
        m.rewrite(edits)
    m.rewrite([(x.start(), x.end(), ".") for x in _NUMBER_DOTS.finditer(m.text)])


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the normalised text shows, as source offsets."""
    if not hinted(text):
        return []
    m = Mapped(text)
    homoglyphs(m)
    spelled_digits(m)
    at_and_dot(m)
    spelled_digits(m)  # digits around what was a spelled dot
    if m.text == text:
        return []
    # base spans of a kind are in order and don't overlap: only the last one that begins before can cover
    spans = [[(a, b) for a, b, z in base if z == k] for k in range(len(KINDS))]
    out = []
    for a, b, k in detect(m.text):
        s, e = m.start[a], m.end[b - 1]
        if text[s:e] != m.text[a:b]:
            j = bisect.bisect_right(spans[k], (s, len(text))) - 1
            if j < 0 or spans[k][j][1] < e:
                out.append((s, e, k))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts and digest of the base spans, ``spans`` (all of them)
    and ``n_added``."""
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = detect(text) if text else []
                more = sorted(set(disguised(text, base))) if text else []
                rows.append((*(sum(s[2] == k for s in base) for k in range(4)),
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            cols = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds[1:]))], schema=schema)

    ddl = ", ".join(f"`{n}` {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, kinds))
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, ddl)

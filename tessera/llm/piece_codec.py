"""SentencePiece (merge type) encoding and decoding by a prefix table.

In a merge-type model the encoding of every prefix of a word ends in one
unique token.  An Aho-Corasick automaton over the vocabulary lists the pieces
that end at each position; a piece ``t`` is the last token of the prefix
exactly if the last token of the prefix before it and ``t`` are compatible
(their joint text is encoded as just those two tokens).  The table keeps that
token per position and the ids are read backwards from the end.

A word is a run of space marks and the characters up to the next one: no piece
of such a model has a space mark after another character (checked when the
model is loaded), so no merge crosses words.  Words repeat, so each worker
keeps a bounded table of encoded words.

Defined results: a null or empty text has only begin and end ids and decodes
to the empty text; characters outside the vocabulary become byte pieces;
repeated rows, null ids, empty tables and further columns are passed through.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
WORD_CACHE = 300_000
PAIR_CACHE = 400_000
#: Longer words are encoded without being kept.
KEPT_CHARS = 64
#: Rows of an output batch, so that a worker holds few ids and texts at a time.
OUT_ROWS = 256


class Codec:
    """Vocabulary, automaton and the bounded tables of one worker."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.piece_of = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_id, self.score, self.id_of = {}, {}, {}
        for i, p in enumerate(self.piece_of):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            elif not sp.is_control(i) and not sp.is_unknown(i):
                if re.search(f"[^{SPACE}]{SPACE}", p):
                    raise ValueError(f"piece {p!r} crosses words; the prefix table needs whole words")
                self.id_of[p] = i
                self.score[p] = sp.get_score(i)
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        # what an id adds to a decoded text; bytes from 128 up only count together
        self.text_of = [chr(self.byte_of[i]) if i in self.byte_of else "" if i in (self.bos, self.eos) else
                        " ⁇ " if i == self.unk else p.replace(SPACE, " ") for i, p in enumerate(self.piece_of)]
        high = [i for i, b in self.byte_of.items() if b > 127]
        self.high = (min(high), max(high)) if high else (1, 0)
        self.auto = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()
        self.pairs: dict = {}
        self.words: dict = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text, by score and then from the left."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[parts[k] + parts[k + 1]], -k) for k in range(len(parts) - 1)
                        if parts[k] + parts[k + 1] in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` and ``b`` is encoded as ``a, b`` (``a`` < 0: ``b`` alone)."""
        key = a * len(self.piece_of) + b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            want = [self.piece_of[b]] if a < 0 else [self.piece_of[a], self.piece_of[b]]
            ok = self.pairs[key] = self.merged("".join(want)) == want
        return ok

    def ids(self, word: str) -> list[int]:
        n = len(word)
        last, start = [-1] * (n + 1), [-1] * (n + 1)
        # a prefix table entry: last token (-1 after the start or an unknown character) and where it starts
        known = [False] * (n + 1)
        known[0] = True
        pairs, compatible, size_of = self.pairs, self.compatible, len(self.piece_of)
        at = 0
        for end, (size, tok) in self.auto.iter(word):
            end += 1
            while at + 1 < end:  # no piece ends at ``at + 1``: an unknown character
                at += 1
                if not known[at]:
                    known[at], start[at] = True, at - 1
            if known[end]:
                continue
            begin = end - size
            if known[begin]:
                ok = pairs.get(last[begin] * size_of + tok)
                if ok or (ok is None and compatible(last[begin], tok)):
                    known[end], last[end], start[end] = True, tok, begin
            if known[end]:
                at = end
        out = []
        i = n
        while i > 0:
            if start[i] < 0 or last[i] < 0:
                out += [self.byte_id.get(x, self.unk) for x in reversed(word[i - 1].encode())] \
                    if self.byte_id else [self.unk]
                i -= 1
            else:
                out.append(last[i])
                i = start[i]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text with begin and end ids."""
        parts = [array("I", [self.bos]).tobytes()]
        if text:
            words = self.words
            for w in WORDS.findall(SPACE + text.replace(" ", SPACE)):
                got = words.get(w)
                if got is None:
                    got = array("I", self.ids(w)).tobytes()
                    if len(w) <= KEPT_CHARS:
                        if len(words) >= WORD_CACHE:
                            words.clear()
                        words[w] = got
                parts.append(got)
        parts.append(array("I", [self.eos]).tobytes())
        return b"".join(parts)

    def decode(self, ids) -> str:
        """Text of ids: control ids are silent, runs of byte pieces are UTF-8,
        space marks are spaces and the one put before the text goes."""
        a = np.asarray(ids, np.uint32)
        if not ((a >= self.high[0]) & (a <= self.high[1])).any():
            text = "".join(map(self.text_of.__getitem__, ids))
            first = next((i for i in ids if i not in (self.bos, self.eos)), None)
            return text[1:] if first is not None and first not in self.byte_of and text[:1] == " " and first != self.unk else text
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(utf8(raw))
                raw = bytearray()
            if i != self.bos and i != self.eos:
                out.append(" ⁇ " if i == self.unk else self.piece_of[i])
        if raw:
            out.append(utf8(raw))
        text = "".join(out)
        first = next((i for i in ids if i not in (self.bos, self.eos)), None)
        if first is not None and first not in self.byte_of and text[:1] == SPACE:
            text = text[1:]
        return text.replace(SPACE, " ")


def utf8(raw: bytes) -> str:
    """Each byte that is no part of a valid character is one replacement mark."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[:e.start].decode() + "�" + utf8(raw[e.start + 1:])


_codecs: dict = {}


def codec(path: str) -> Codec:
    """The worker's codec: loaded once, its tables serve later tasks too."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Per row: id, ``n_tokens``, digests of the ids and of the decoded text,
    and on request ``ids`` and ``decoded`` themselves."""
    fields = [(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    if with_text:
        fields.append(("decoded", pa.string()))
    schema = pa.schema(fields)
    ddl = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}

    def run(batches):
        c = codec(model_path)
        parts = (b.slice(at, OUT_ROWS) for b in batches for at in range(0, b.num_rows, OUT_ROWS))
        for b in parts:
            rows = []
            for text in b.column(1):
                raw = c.encode(text.as_py() or "")
                ids = array("I", raw)
                back = c.decode(ids)
                row = [len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()]
                rows.append(row + [np.frombuffer(raw, np.int32)] * with_ids + [back] * with_text)
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(list(c_), f.type) for c_, f in zip(cols, list(schema)[1:]))],
                schema=schema)

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(
        run, ", ".join(f"`{n}` {ddl[t]}" for n, t in fields))

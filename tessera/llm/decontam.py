"""Benchmark decontamination: near copies of benchmark items in documents.

Texts are word sequences (lower case, ASCII punctuation taken out).  A
document holds an item if some stretch of it is within
``floor(MAX_EDITS * words)`` word edits of the whole item.

Search: windows sized by the items (the largest of ``SIZES`` up to half of the
item's words) are embedded by CGK random walks: at step ``j`` the walk writes
the word it stands on and moves on if bit ``j`` of that word's hash is set, so
walks over texts with few edits fall into step again and edit distance becomes
Hamming distance.  Up to four positions of that string, one out of each
stratum, are sampled as key (bit-sampling LSH); ``REPS`` independent walks and
samples give the target recall (0.93 or more of passages with up to a fifth of
their words replaced, deleted, inserted, or some of each).  Items are indexed at all their offsets and
documents at every ``stride`` words, so an aligned pair of windows always
exists and an exact copy is always found.  A window drops out at the first
sampled word that no item has, which leaves keys as they are and saves most
steps.  Each collision is verified by the exact edit distance.

The items are taken in blocks of ``BLOCK_WORDS`` words; a block is what is
shipped to the tasks, whatever the benchmark's size.  Documents are scanned
narrowly: no shuffle, whole texts.

Defined results: null and empty texts hold nothing; items without words match
nothing; repeated items each match; repeated rows are judged row by row; empty
tables give empty results (no benchmark: no leak); null ids are carried;
``drop_leaks`` keeps all columns of its input.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_EDITS = 0.2
SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48)
STRIDE = 8
REPS = 6
BLOCK_WORDS = 1_000_000
#: Words of documents that are searched together (one document at least).
CHUNK_WORDS = 200_000
#: Words whose digests a worker keeps.
KNOWN_WORDS = 100_000
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit digests of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) | 1  # 0 stands for "no word"
        return h


def symbols(text: str | None, known: Hashes) -> np.ndarray:
    words = text.lower().encode().translate(None, _PUNCTUATION).split() if text else []
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    z = (x ^ np.uint64(seed)) * _MIX
    return (z ^ (z >> np.uint64(31))) * _FOLD


def edits(pattern_bits: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of a pattern of ``n`` symbols to any stretch of
    ``text`` and the end of that stretch (bit-parallel columns)."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score, best, end = full, 0, n, n, 0
    for i, s in enumerate(text):
        eq = pattern_bits.get(s, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp, vn = (hn | ~(d0 | hp)) & full, d0 & hp
        if score < best:
            best, end = score, i + 1
    return best, end


class Index:
    """The LSH tables of one block of items."""

    def __init__(self, items: list[tuple]):
        known = Hashes()
        self.ids = [i for i, _ in items]
        self.words = [symbols(t, known) for _, t in items]
        self.bits = []
        for w in self.words:
            at: dict[int, int] = {}
            for k, s in enumerate(w.tolist()):
                at[s] = at.get(s, 0) | 1 << k
            self.bits.append(at)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                room = max(0.5 * len(w), min(len(w), 4))
                groups.setdefault(max(s for s in SIZES if s <= room), []).append(k)
        rng = np.random.default_rng(20240607)
        self.tables = []
        for size, members in sorted(groups.items()):
            stride = min(STRIDE, min(len(self.words[k]) - size + 1 for k in members))
            steps = min(64, max(1, 4 * size // 3))
            m = min(3 if size <= 4 else 4, steps)
            x, starts, owner, offset, at = [], [], [], [], 0
            for k in members:
                n = len(self.words[k])
                x += [self.words[k], np.zeros(64, np.uint64)]
                offs = np.arange(n - size + 1)
                starts.append(at + offs)
                owner.append(np.full(len(offs), k))
                offset.append(offs)
                at += n + 64
            x = np.concatenate(x)
            starts, owner, offset = map(np.concatenate, (starts, owner, offset))
            for _ in range(REPS if size > 1 else 1):
                cuts = np.linspace(0, steps, m + 1).astype(int)
                coords = [int(rng.integers(a, max(a + 1, b))) for a, b in zip(cuts, cuts[1:])]
                seed = int(rng.integers(1, 1 << 62))
                levels = []
                for q in range(m):
                    keys, _ = walk(x, mixed(x, seed), starts, coords[:q + 1], None)
                    levels.append(keys)
                order = np.argsort(levels[-1], kind="stable")
                seen = [np.packbits(np.bincount((v >> np.uint64(44)).astype(np.int64), minlength=1 << 20).astype(bool))
                        for v in levels]
                self.tables.append((size, stride, seed, coords, seen, levels[-1][order], owner[order], offset[order]))

    def candidates(self, x: np.ndarray, doc_of: np.ndarray, place: np.ndarray) -> set:
        """``(document, item, start)`` of colliding windows; ``x``: the words
        of several documents, each followed by padding (document -1)."""
        out = set()
        starts_at = {s: np.flatnonzero((doc_of >= 0) & (place % s == 0)) for s in {t[1] for t in self.tables}}
        for size, stride, seed, coords, seen, keys, owner, offset in self.tables:
            got, at = walk(x, mixed(x, seed), starts_at[stride], coords, seen)
            lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            for k in np.flatnonzero(hi > lo):
                d, p = int(doc_of[at[k]]), int(at[k])
                out.update((d, int(owner[j]), p - int(offset[j])) for j in range(lo[k], hi[k]))
        return out

    def hits(self, texts: Iterable, known: Hashes) -> list[tuple[int, int, int, int]]:
        """``(row, item, edits, first word)``: the best place of each held item."""
        found: dict = {}
        chunk, size = [], 0

        def search():
            x, doc_of, place, first = [], [], [], {}
            at = 0
            for row, w in chunk:
                first[row] = (at, len(w))
                x += [w, np.zeros(64, np.uint64)]
                doc_of += [np.full(len(w), row, np.int32), np.full(64, -1, np.int32)]
                place += [np.arange(len(w), dtype=np.int32), np.arange(64, dtype=np.int32)]
                at += len(w) + 64
            x = np.concatenate(x)
            for row, item, start in sorted(self.candidates(x, np.concatenate(doc_of), np.concatenate(place))):
                n = len(self.words[item])
                most = int(MAX_EDITS * n)
                base, length = first[row]
                lo, hi = max(base, start - 2 * most - 1), min(base + length, start + n + 2 * most + 1)
                best = found.get((row, item))
                if best and (best[0] == 0 or lo <= base + best[1] < hi):
                    continue
                d, end = edits(self.bits[item], n, x[lo:hi].tolist())
                if d <= most and (best is None or d < best[0]):
                    found[row, item] = (d, max(0, lo + end - n - base))
        for row, text in enumerate(texts):  # one text at a time leaves the batch
            w = symbols(text.as_py() if isinstance(text, pa.Scalar) else text, known)
            if len(w):
                chunk.append((row, w))
                size += len(w)
            if size >= CHUNK_WORDS:
                search()
                chunk, size = [], 0
        if chunk:
            search()
        return [(r, i, d, p) for (r, i), (d, p) in sorted(found.items())]


def walk(x, bits, starts, coords, seen):
    """Keys of the walks from ``starts``; with ``seen`` (a bitmap per sampled
    position) only of walks whose key so far some item has, and their starts."""
    last = len(x) - 1
    at, origin = starts.copy(), starts
    key, step = np.zeros(len(at), np.uint64), 0
    for q, c in enumerate(coords):
        while step < c:
            at += ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(at.dtype)
            np.minimum(at, last, out=at)
            step += 1
        key = (key * _FOLD + x[at]) * _MIX
        key ^= key >> np.uint64(32)
        key *= _FOLD
        if seen is not None:
            top = (key >> np.uint64(44)).astype(np.int64)
            alive = np.flatnonzero(seen[q][top >> 3] & (128 >> (top & 7)))
            at, origin, key = at[alive], origin[alive], key[alive]
    return key, origin


@functools.lru_cache(maxsize=1)
def _index(items: tuple) -> Index:
    return Index(list(items))


_known = Hashes()


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The items in blocks of bounded words."""
    block, words = [], 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        block.append((r["i"], r["t"]))
        words += len((r["t"] or "").split())
        if words >= BLOCK_WORDS:
            yield tuple(block)
            block, words = [], 0
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id, item, n_words, edits, first_word`` per document and held item."""
    spark = docs.sparkSession
    ddl = f"`{id_col}` long, `{item_col}` long, n_words long, edits long, first_word long"
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    out = None
    for block in blocks(benchmark, item_col, item_text_col):
        shipped = spark.sparkContext.broadcast(block)

        def scan(batches, shipped=shipped):
            index = _index(shipped.value)
            for b in batches:
                ids = b.column(0)
                hits = index.hits(b.column(1), _known)
                rows = [h[0] for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array([index.ids[h[1]] for h in hits], pa.int64()),
                     pa.array([len(index.words[h[1]]) for h in hits], pa.int64()),
                     pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int64())],
                    names=[id_col, item_col, "n_words", "edits", "first_word"])
        part = src.mapInArrow(scan, ddl)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], ddl) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text_col):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches, shipped=shipped):
            index = _index(shipped.value)
            for b in batches:
                held = {h[0] for h in index.hits(b.column(at), _known)}
                yield b.filter(pa.array([k not in held for k in range(b.num_rows)], pa.bool_()))
        docs = docs.mapInArrow(scan, docs.schema)
    return docs

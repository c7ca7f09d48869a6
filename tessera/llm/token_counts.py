"""Token counts: pieces are counted once per distinct pre-token.

1. Each scan task cuts its texts into pre-tokens and packs, per block of
   documents, one posting list ``(document row, frequency)`` per distinct
   pre-token.  A frequent pre-token is therefore one row per block, however
   many documents hold it, so no pre-token makes a hot key.
2. The posting lists are shuffled by pre-token; the tokenizer sees every
   distinct pre-token of a partition once, and the join of that count with the
   postings leaves one partial sum per document row.  Long posting lists are
   dealt by block as well, and short ones by stretches of scan tasks, so what
   one task gets of a pre-token doesn't grow with the corpus; the count of such a pre-token is repeated
   once per share.
3. The partial sums meet per block and are added up.  Token ids are never
   built for a document.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null id is
carried as null; repeated rows are counted row by row; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the byte-level pre-token pattern of the public 50k vocabulary
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters below this code point are classed alike by ``regex`` and by the
#: tokenizer library; texts with others are cut by the library itself.
PLAIN = re.compile("[ɐ-\U0010ffff\x1c-\x1f\x85]")
#: A block is closed once it holds this many (document, pre-token) pairs.
BLOCK_PAIRS = 2_000_000
#: Posting lists of this many entries are dealt by their block.
LONG_POSTINGS = 64
#: Shorter ones meet over this many scan tasks (a power of two as a shift).
TASKS_SHIFT = 8
FREQ_BITS = 11
MAX_DOCS = 1 << (31 - FREQ_BITS)


class PreTokens:
    """Cuts a text into pre-tokens; special strings are set apart first."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.pre = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def words(self, text: str) -> list[str]:
        if not PLAIN.search(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.pre(text)]

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        out = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.words(part)
        return out


def _postings(path: str):
    schema = pa.schema([("piece", pa.string()), ("block", pa.int64()), ("postings", pa.list_(pa.int32())),
                        ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    def none(n):  # empty lists: Spark writes null lists to Arrow in quadratic time
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int64()))

    def close(block, names, piece, post, ids, sizes):
        piece, post = np.frombuffer(piece, np.int32), np.frombuffer(post, np.int32)
        order = np.argsort(piece, kind="stable")
        ends = np.cumsum(np.bincount(piece, minlength=len(names)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                         pa.array(post[order]))
        n = len(names)
        empty = none(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(names), pa.string()), pa.array(np.full(n, block)), lists, empty, empty], schema=schema)
        yield pa.RecordBatch.from_arrays(  # the block's documents; its key only spreads such rows
            [pa.array([f"block {block}"]), pa.array([block], pa.int64()), pa.array([[]], pa.list_(pa.int32())),
             pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))], schema=schema)

    def run(batches):
        from array import array
        cut = PreTokens(path)
        block = TaskContext.get().partitionId() << 32
        names, piece, post, ids, sizes = {}, array("i"), array("i"), [], []
        top = (1 << FREQ_BITS) - 1
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                at = len(ids) << FREQ_BITS
                for word, n in Counter(cut(text)).items():
                    k = names.setdefault(word, len(names))
                    while n > top:  # a larger frequency takes several entries
                        piece.append(k)
                        post.append(at | top)
                        n -= top
                    piece.append(k)
                    post.append(at | n)
                ids.append(doc_id)
                sizes.append(len(text.encode()))
                if len(post) >= BLOCK_PAIRS or len(ids) >= MAX_DOCS - 1:
                    yield from close(block, names, piece, post, ids, sizes)
                    block += 1
                    names, piece, post, ids, sizes = {}, array("i"), array("i"), [], []
        if ids:
            yield from close(block, names, piece, post, ids, sizes)
    return run


def _count(path: str):
    schema = pa.schema([("block", pa.int64()), ("sums", pa.list_(pa.int32())),
                        ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    def rows(sums):
        for block, acc in sums.items():
            n = int(np.max(np.nonzero(acc)[0], initial=-1)) + 1
            one = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(acc[:n]))
            none = pa.array([[]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), one, none, none], schema=schema)

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        sums, held = {}, 0
        last, last_n = None, 0
        for b in batches:
            is_docs = pa.array(np.diff(b.column("ids").offsets.to_numpy()) > 0)
            docs = b.filter(is_docs)
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [docs.column("block"), pa.array([[]] * docs.num_rows, pa.list_(pa.int32())),
                     docs.column("ids"), docs.column("sizes")], schema=schema)
            b = b.filter(pc.invert(is_docs))
            if not b.num_rows:
                continue
            names = b.column("piece").to_pylist()  # sorted: equal pre-tokens are neighbours
            fresh = [i for i, x in enumerate(names) if x != (names[i - 1] if i else last)]
            got = [len(e.ids) for e in tok.encode_batch([names[i] for i in fresh], add_special_tokens=False)]
            each = np.repeat(np.array([last_n, *got]), np.diff([0, *fresh, len(names)]))
            last, last_n = names[-1], int(each[-1])
            lists = b.column("postings")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            add = np.repeat(each, sizes) * (flat & ((1 << FREQ_BITS) - 1))
            at = flat >> FREQ_BITS
            blocks = np.repeat(b.column("block").to_numpy(), sizes)
            order = np.argsort(blocks, kind="stable")
            edges = np.flatnonzero(np.diff(blocks[order])) + 1
            for part in np.split(order, edges):
                block = int(blocks[part[0]])
                part_sum = np.bincount(at[part], weights=add[part]).astype(np.int32)
                acc = sums.get(block)
                if acc is None or len(acc) < len(part_sum):
                    grown = np.zeros(max(len(part_sum), 1024, 2 * len(acc) if acc is not None else 0), np.int32)
                    if acc is not None:
                        grown[:len(acc)] = acc
                    held += len(grown) - (len(acc) if acc is not None else 0)
                    acc = sums[block] = grown
                acc[:len(part_sum)] += part_sum
            if held > 8_000_000:
                yield from rows(sums)
                sums, held = {}, 0
        yield from rows(sums)
    return run


def _total(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def row(acc, docs):
        ids, sizes = docs
        total = np.zeros(len(ids), np.int64)
        total[:len(acc)] = acc[:len(ids)]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sizes, pa.int64()),
                                           pa.array(total)], schema=schema)

    def run(batches):
        at, acc, docs = None, np.zeros(0, np.int64), None
        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                if at is not None and block != at:
                    yield row(acc, docs)
                    acc, docs = np.zeros(0, np.int64), None
                at = block
                if len(b.column("ids")[i]):
                    docs = b.column("ids")[i].as_py(), b.column("sizes")[i].as_py()
                else:
                    part = b.column("sums")[i].values.to_numpy()
                    if len(part) > len(acc):
                        acc = np.concatenate([acc, np.zeros(len(part) - len(acc), np.int64)])
                    acc[:len(part)] += part
        if at is not None:
            yield row(acc, docs)
    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` per row of ``docs``; ``id`` must be an
    integer column and keeps its name."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    posts = src.mapInArrow(
        _postings(tokenizer_path),
        "piece string, block long, postings array<int>, ids array<long>, sizes array<long>")
    share = F.when(F.size("postings") >= LONG_POSTINGS, F.col("block")).otherwise(
        -1 - F.shiftright(F.col("block"), 32 + TASKS_SHIFT))
    part = posts.repartition(F.col("piece"), share).sortWithinPartitions("piece").mapInArrow(
        _count(tokenizer_path), "block long, sums array<int>, ids array<long>, sizes array<long>")
    out = part.repartition("block").sortWithinPartitions("block").mapInArrow(
        _total(pa.int64()), "id long, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)

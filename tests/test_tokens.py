"""Encoding by row, merges, and windows straight from pieces."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.operators import merges as MG
from tessera.operators import packing as P
from tessera.operators import tokens as TK

TEXTS = ["a b", "c d", "a a a", "", None, "b a c"]


@pytest.fixture(scope="module")
def vocab(spark):
    return TK.build_vocab(spark.createDataFrame([(t,) for t in TEXTS], "text string"))


@pytest.fixture(params=["in place", "join"])
def way(request, monkeypatch):
    """Both plans: a small vocabulary in the tasks, a large one by a join."""
    if request.param == "join":
        monkeypatch.setattr(TK, "IN_PLACE_MAX_PIECES", 0)
    return request.param


def test_encode_keeps_rows_of_repeated_and_null_keys_apart(spark, vocab, way):
    rows = [(1, "a b"), (1, "c d"), (None, "a a a"), (None, "b a c"), (1, "a b"), (2, ""), (3, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    enc = TK.encode(df, vocab, "id", eos_id=99)
    assert enc.schema["ids"].dataType.simpleString() == "array<bigint>"
    piece = {r["id"]: r["piece"] for r in vocab.collect()}
    got = sorted(((r["id"], "".join(piece[i] for i in r["ids"][:-1]), r["ids"][-1]) for r in enc.collect()), key=repr)
    assert got == sorted(((k, t or "", 99) for k, t in rows), key=repr)
    back = TK.decode(TK.encode(df, vocab, "id"), vocab, "id")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((k, t or "") for k, t in rows), key=repr)


def test_encode_same_with_a_small_broadcast_bound(spark, vocab):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    whole = sorted(map(tuple, TK.encode(df, vocab, "id").collect()))
    assert sorted(map(tuple, TK.encode(df, vocab, "id", broadcast_max=2).collect())) == whole
    unseen = TK.encode(spark.createDataFrame([(1, "a zz")], "id long, text string"), vocab, "id").first()
    assert unseen["ids"][-1] == -1


def test_decode_keeps_unknown_ids_and_nulls(spark, vocab):
    size = vocab.count()
    first = vocab.where("id = 0").first()["piece"]
    df = spark.createDataFrame([(1, [0, 99, 0]), (1, [size]), (None, []), (2, None), (3, [-1, 2**40])], "id long, ids array<long>")
    got = sorted(map(tuple, TK.decode(df, vocab, "id").collect()), key=repr)
    assert got == sorted([(1, f"{first}�{first}"), (1, "<|endoftext|>"), (None, ""), (2, None), (3, "��")], key=repr)


@pytest.mark.parametrize("length", [3, 8, 64])
def test_windows_from_pieces_equal_slices(spark, length, way):
    r = random.Random(length)
    docs = [[r.choice("abcdefg") for _ in range(r.choice([0, 1, 2, 5, 40]))] + [None] for _ in range(30)]
    stream, rows = [], []
    for d in docs:
        rows.append((len(stream), d))
        stream += [6 if p is None else "abcdef".find(p) for p in d]
    voc = spark.createDataFrame([(p, i) for i, p in enumerate("abcdef")], "piece string, id long")
    counted = spark.createDataFrame(rows, "offset long, pcs array<string>")
    cut = int(len(stream) * 0.7)
    parts = P.split_stream(counted, 0.7, len(stream), ids="pcs")
    runs = TK.encode_fragments(P.fragments(parts, length, 1), voc, ["split", "seq"], "slot", "pcs", 6)
    for tail in (False, True):
        got = sorted((x["split"], x["seq"], list(x["inputs"]), list(x["targets"])) for x in P.shifted(runs, length, tail=tail).collect())
        want = []
        for name, s in (("train", stream[:cut]), ("val", stream[cut:])):
            full = (len(s) - 1) // length
            for k in range(full + (1 if tail and (len(s) - 1) % length else 0)):
                want.append((name, k, s[k * length:min(k * length + length, len(s) - 1)], s[k * length + 1:k * length + length + 1]))
        assert got == sorted(want)
    blocks = TK.encode_fragments(P.fragments(parts, length), voc, ["split", "seq"], "slot", "pcs", 6).collect()
    assert sorted((b["split"], b["seq"], list(b["ids"])) for b in blocks) == sorted(
        (name, k // length, s[k:k + length]) for name, s in (("train", stream[:cut]), ("val", stream[cut:])) for k in range(0, len(s), length))


def test_ids_cross_one_shuffle_to_their_window(spark, way):
    from tessera.plans import corpus as C
    windows, _, _ = C.packed(spark, SF_SMALL, length=64)
    plan = windows._jdf.queryExecution().executedPlan().toString()
    keys = [x.split("#")[0] for x in plan.split("Exchange hashpartitioning(")[1:]]
    assert sorted(keys) == ["_pid", "split"] and "rangepartitioning" not in plan  # _pid: one total per partition


@pytest.mark.parametrize("values", [1, 7, 1 << 20])
def test_blocks_of_rows_equal_rows_in_place(spark, vocab, monkeypatch, values):
    r = random.Random(values)
    rows = [(None if i % 3 == 0 else i % 4, None if i % 11 == 0 else [r.choice(["a", " b", "zz", " c", None]) for _ in range(r.choice([0, 1, 5, 30]))])
            for i in range(60)]
    df = spark.createDataFrame(rows, "id long, pcs array<string>")
    part = df.where("pcs is not null").select("id", F.monotonically_increasing_id().alias("slot"), "pcs").orderBy("slot")
    way = lambda: (sorted(map(repr, TK.encode(df, vocab, "id", eos_id=99, pieces_col="pcs").collect())),
                   sorted(map(repr, TK.encode_fragments(part, vocab, ["id"], "slot", "pcs", 99).collect())))
    want = way()
    for bound in ("IN_PLACE_MAX_PIECES", "EXPLODED_MAX_PIECES"):
        monkeypatch.setattr(TK, bound, 0)
    monkeypatch.setattr(TK, "BLOCK_VALUES", values)
    assert way() == want


def test_no_piece_or_id_becomes_a_row(spark, vocab, monkeypatch):
    """Above the bounds neither coding way explodes, collects or sorts what a row holds."""
    monkeypatch.setattr(TK, "IN_PLACE_MAX_PIECES", 0)
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "id long, text string")
    enc = TK.encode(df, vocab, "id")
    for d in (enc, TK.decode(enc, vocab, "id")):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan


# --- merges ---------------------------------------------------------------------
def test_merges_equal_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    ref = Tokenizer.from_file(path)
    ref.encode_special_tokens = True
    odd = ["", None, "  two  spaces \n\n tabs\t", "a" * 30_000, "日本語 é ß 🙂 \x00\x7f\xad", "<|endoftext|> it's we'll", "x" * 7 + " " + "ab" * 5000]
    texts = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()] + odd
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 7, t) for i, t in enumerate(texts)], "id long, text string")
    bpe = MG.read_bpe(spark, path)
    enc = MG.encode_bpe(df, bpe, "id")
    want = [ref.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = enc.collect()
    assert sorted((r["id"] is None, r["id"] or 0, list(r["ids"])) for r in got) == sorted(
        (i % 5 == 0, 0 if i % 5 == 0 else i % 7, w) for i, w in enumerate(want))
    back = MG.decode_bpe(enc, bpe, "id").collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["text"]) for r in back) == sorted(
        (i % 5 == 0, 0 if i % 5 == 0 else i % 7, t or "") for i, t in enumerate(texts))


def brute_merge(symbols, ranks):
    """The definition: while a pair has a rank, join the leftmost pair of least rank."""
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not found:
            return symbols
        i = min(found)[1]
        symbols = symbols[:i] + [symbols[i] + symbols[i + 1]] + symbols[i + 2:]


def test_merge_against_its_definition():
    r = random.Random(2)
    for _ in range(300):
        parts, ranks = list("abc"), {}
        for k in range(r.randint(0, 8)):
            p = (r.choice(parts), r.choice(parts))
            ranks.setdefault(p, k)
            parts.append("".join(p))
        s = [r.choice("abcd") for _ in range(r.randint(0, 25))]
        assert MG.merge(s, ranks) == brute_merge(s, ranks)


def test_merges_of_characters_and_unknown_symbols(spark):
    bpe = MG.Bpe(spark.createDataFrame([(0, "a", "b")], "rank long, left string, right string"),
                 spark.createDataFrame([("ab", 5), ("a", 6), (" ", 7)], "token string, id long"), byte_level=False)
    df = spark.createDataFrame([(1, "abа ab"), (2, "ba")], "id long, text string").select("id", F.col("text"))
    got = {r["id"]: list(r["ids"]) for r in MG.encode_bpe(df, bpe, "id").collect()}
    assert got == {1: [5, -1, 7, 5], 2: [-1, 6]}
    back = {r["id"]: r["text"] for r in MG.decode_bpe(MG.encode_bpe(df, bpe, "id"), bpe, "id").collect()}
    assert back == {1: "ab� ab", 2: "�a"}
    assert MG.encode_bpe(df.where("id > 5"), bpe, "id").count() == 0
    lines = MG.read_bpe(spark, _old_file(spark), byte_level=False)
    assert [tuple(r) for r in lines.merges.orderBy("rank").collect()] == [(0, "a", "b"), (1, "ab", "c d")]


@pytest.mark.parametrize("bound", [None, 0])
def test_merges_move_no_rows(spark, monkeypatch, bound):
    """Rows are encoded and decoded where they are, with little kept and in blocks of few pieces as well."""
    r = random.Random(9)
    rows = [(r.choice([1, None]), r.choice([None, "", "ab ab ba", "b" * r.randint(1, 9) + " a" * r.randint(0, 9)])) for _ in range(60)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    bpe = MG.Bpe(spark.createDataFrame([(0, "a", "b"), (1, "b", "b")], "rank long, left string, right string"),
                 spark.createDataFrame([("ab", 5), ("a", 6), (" ", 7), ("bb", 8), ("b", 9), ("c", 9), ("d", None)], "token string, id long"), byte_level=False)
    monkeypatch.setattr(MG, "KEPT_BYTES", 500)
    monkeypatch.setattr(MG, "BLOCK_VALUES", 4)
    enc = MG.encode_bpe(df, bpe, "id")
    spelled = {5: "ab", 6: "a", 7: " ", 8: "bb", 9: "b"}
    got = enc.collect()
    assert Counter((x["id"], "".join(spelled[i] for i in x["ids"])) for x in got) == Counter((k, t or "") for k, t in rows)
    if bound is not None:
        plain, bpe.tokens = bpe.tokens, bpe.tokens.where("token <> 'c'")
        monkeypatch.setattr(MG, "MAX_TABLE", bound)
        held = spark.createDataFrame([(x["id"], list(x["ids"])) for x in got], "id long, ids array<long>")
        back = MG.decode_bpe(held, bpe, "id")
        assert Counter(map(tuple, back.collect())) == Counter((k, t or "") for k, t in rows)
        odd = spark.createDataFrame([(1, [9, None, 4]), (2, None), (3, [])], "id long, ids array<long>")
        bpe.tokens = plain
        assert sorted(map(tuple, MG.decode_bpe(odd, bpe, "id").collect())) == [(1, "bc\ufffd\ufffd"), (2, None), (3, "")]
    else:
        odd = spark.createDataFrame([(1, [9, None, 4]), (2, None), (3, [])], "id long, ids array<long>")
        back = MG.decode_bpe(odd, bpe, "id")
        assert sorted(map(tuple, back.collect())) == [(1, "bc\ufffd\ufffd"), (2, None), (3, "")]
        for d in (MG.encode_bpe(df.coalesce(1), bpe, "id"), MG.decode_bpe(odd, bpe, "id")):
            plan = d._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and "collect_list" not in plan


def _old_file(spark):
    import json
    import tempfile
    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False) as f:
        json.dump({"model": {"merges": ["a b", "ab c d"], "vocab": {"a": 0}}}, f)
    return f.name

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling as SM
from tessera.operators.ordering import global_index, prefix_sum


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_prefix_sum_any_partitioning(spark, parts):
    data = [(i, (i * 7) % 5) for i in range(200)]
    df = spark.createDataFrame(data, "k long, v long")
    got = {r.k: r.offset for r in prefix_sum(df, ["k"], "v", "offset", partitions=parts).collect()}
    acc = 0
    for k, v in data:
        assert got[k] == acc
        acc += v


def test_global_index(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "k string")
    got = sorted((r.idx, r.k) for r in global_index(df, ["k"], partitions=4).collect())
    assert got == [(i + 1, f"k{i:03d}") for i in range(50)]


def _py_sample(ids, n, seed):
    return sorted(sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))[:n])


@pytest.mark.parametrize("top_k", [0, 10**6])
def test_sample_exact_both_paths(spark, top_k):
    ids = list(range(3000))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for n in (1, 700, 2999, 3000, 5000):
        got = sorted(r.id for r in SM.sample_exact(df, n, "id", 42, top_k_direct=top_k).collect())
        assert got == _py_sample(ids, n, 42)


def test_cap_before_filter(spark):
    # rejects placed before the cap still count against it
    for total in (4999, 5000, 5001):
        df = spark.createDataFrame([(i, i % 3 == 0) for i in range(total)], "id long, bad boolean")
        kept = SM.first_n(df, 5000, "id").where(~F.col("bad")).count()
        assert kept == sum(1 for i in range(min(total, 5000)) if i % 3 != 0)


def test_split_rows_exact(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "id long")
    s = SM.split_rows(df, 0.9, "id", 7)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": int(0.9 * 101), "val": 101 - int(0.9 * 101)}


def _ranked(keys, seed):
    """Keys by ``(md5(seed:key), key)``, as the rule says it."""
    return sorted(keys, key=lambda k: hashlib.md5((f"{seed}:{k}" if k is not None else str(seed)).encode()).hexdigest())


@pytest.mark.parametrize("frac", [0.0, 0.003, 0.2, 0.5, 0.9, 0.999, 1.0])
def test_split_rows_brute_force(spark, frac):
    # a hot key holds a third of the rows, null keys another part
    keys = [*range(300), *[7] * 200, *[None] * 100]
    rows = [(k, f"row {i}") for i, k in enumerate(keys)]
    for part in (keys, keys[:300]):
        df = spark.createDataFrame(rows[:len(part)], "id long, x string").repartition(5)
        got = SM.split_rows(df, frac, "id", 7).collect()
        assert sorted(r.x for r in got) == sorted(x for _, x in rows[:len(part)])
        train = [r.id for r in got if r.split == "train"]
        assert sorted(train, key=str) == sorted(_ranked(part, 7)[:int(frac * len(part))], key=str)


def test_split_rows_moves_no_rows(spark):
    df = spark.createDataFrame([(i, "payload") for i in range(50)], "id long, x string")
    plan = SM.split_rows(df, 0.5, "id", 7)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "MapInArrow" not in plan


def test_nth_hash_descends(spark):
    same = "ab" * 6  # twelve digits alike: only the whole hash tells the rows apart
    hashes = [same + f"{i:020x}" for i in range(40)] + ["00" * 16, "ff" * 16]
    df = spark.createDataFrame([(h,) for h in hashes], "_h string")
    for n in range(1, len(hashes) + 1):
        prefix, before = SM.nth_hash(df, n)
        assert sum(h[:len(prefix)] < prefix for h in hashes) == before
        assert sum(h[:len(prefix)] <= prefix for h in hashes) == n


def test_global_index_brute_force(spark):
    rows = [(i * 37 % 101 if i % 5 else None, f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x string")
    for parts in (1, 7):
        got = sorted(global_index(df, ["k", "x"], "n", parts).collect(), key=lambda r: r.n)
        assert [r.n for r in got] == list(range(1, 401))
        assert [(r.k, r.x) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert global_index(df.limit(0), ["k"], "n").count() == 0


def test_shuffle_and_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(20)], "id long")
    b = SM.with_batches(SM.shuffle_epoch(df, "id", 42, 1), 8)
    got = sorted((r.idx, r.batch_id) for r in b.collect())
    assert [x[0] for x in got] == list(range(1, 21))
    assert [x[1] for x in got] == [0] * 8 + [1] * 8 + [2] * 4
    e2 = {r.id: r.idx for r in SM.shuffle_epoch(df, "id", 42, 2).collect()}
    e1 = {r.id: r.idx for r in SM.shuffle_epoch(df, "id", 42, 1).collect()}
    assert e1 != e2


def test_encode_hot_cold_split_equals_broadcast(spark):
    from tessera.operators.tokens import build_vocab, decode, encode
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "a rare zebra, the end."), (3, "")],
                                 "id long, text string")
    voc = build_vocab(docs)
    a = {r.id: list(r.ids) for r in encode(docs, voc, "id", eos_id=voc.count()).collect()}
    b = {r.id: list(r.ids) for r in encode(docs, voc, "id", eos_id=voc.count(), broadcast_max=2).collect()}
    assert a == b and a[3] == [voc.count()]
    enc = encode(docs, voc, "id")
    d = {r.id: r.text for r in decode(enc, voc, "id", broadcast_max=2).collect()}
    assert d == {1: "the cat and the dog", 2: "a rare zebra, the end.", 3: ""}


def test_encode_unknown_piece_is_kept(spark):
    from tessera.operators.tokens import encode
    docs = spark.createDataFrame([(1, "the cat sat")], "id long, text string")
    voc = spark.createDataFrame([("the", 5, 0), (" sat", 3, 1)], "piece string, n long, id long")
    got = encode(docs, voc, "id").first()
    assert list(got.ids) == [0, -1, 1]


def test_null_and_repeated_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d")], "id long, x string")
    s = SM.split_rows(df, 0.5, "id", 7).collect()
    assert sorted(r.x for r in s) == ["a", "b", "c", "d"]
    assert sorted(r.split for r in s) == ["train", "train", "val", "val"]
    assert sorted(r.idx for r in SM.shuffle_epoch(df, "id", 1, 1).collect()) == [1, 2, 3, 4]


def test_first_n_of_texts_and_nulls(spark):
    df = spark.createDataFrame([(f"book{i}.txt",) for i in range(30)], "path string")
    assert sorted(r.path for r in SM.first_n(df, 3, "path").collect()) == ["book0.txt", "book1.txt", "book10.txt"]
    df = spark.createDataFrame([(None,), (None,), (3,), (4,), (5,)], "k long")
    got = [r.k for r in SM.first_n(df, 3, "k").collect()]
    assert sorted(got, key=str) == [3, None, None]
    assert SM.first_n(df, 9, "k").count() == 5

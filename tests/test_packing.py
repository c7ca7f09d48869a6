import pytest
from pyspark.sql import functions as F

from tessera.operators import packing as P


def _parts(spark, stream, doc_sizes):
    rows, pos = [], 0
    for k, n in enumerate(doc_sizes):
        rows.append(("train", k, pos, stream[pos:pos + n]))
        pos += n
    return spark.createDataFrame(rows, "split string, doc long, start long, ids array<int>")


@pytest.mark.parametrize("N", [0, 1, 8, 9, 16, 17, 40])
def test_windows_equal_slicing(spark, N):
    L = 8
    stream = [(i * 13) % 7 for i in range(N)]
    sizes = [3, 5, 1, 11, 2, 30][:]
    sizes_fit, left = [], N
    for s in sizes:
        if left <= 0:
            break
        sizes_fit.append(min(s, left))
        left -= sizes_fit[-1]
    if left > 0:
        sizes_fit.append(left)
    parts = _parts(spark, stream, sizes_fit) if N else spark.createDataFrame(
        [], "split string, doc long, start long, ids array<int>")
    w = P.pack_windows(parts, L, {"train": N}).orderBy("seq").collect()
    expect = [(stream[k * L:k * L + L], stream[k * L + 1:k * L + L + 1]) for k in range(max((N - 1) // L, 0))]
    assert [(list(r.inputs), list(r.targets)) for r in w] == expect


def test_split_stream_cut_inside_doc(spark):
    off = spark.createDataFrame([(0, 0, list(range(6))), (1, 6, list(range(6, 10)))],
                                "doc long, offset long, ids array<int>")
    parts = P.split_stream(off, 0.8, 10).orderBy("split", "start").collect()
    got = [(r.split, r.start, list(r.ids)) for r in parts]
    assert got == [("train", 0, [0, 1, 2, 3, 4, 5]), ("train", 6, [6, 7]), ("val", 0, [8, 9])]


def test_padding(spark):
    rows = [(0, 0, [5, 0, 7]), (0, 1, [1]), (1, 2, [0, 0])]
    df = spark.createDataFrame(rows, "batch_id long, id long, ids array<int>")
    inputs, targets = P.shift_pair("ids")
    b = P.pad_batches(df.withColumn("inputs", inputs).withColumn("targets", targets), "batch_id")
    got = {r.id: (list(r.inputs), list(r.targets), r.len) for r in b.collect()}
    assert got[0] == ([5, 0], [0, 7], 2)      # a real id 0 stays, len says 2
    assert got[1] == ([0, 0], [0, 0], 0)
    assert got[2] == ([0], [0], 1)            # one-row batch


def test_blocks_and_diagnostics(spark):
    from tessera.operators.stats import block_diagnostics
    stream = [1, 1, 2, 3, 3, 3, 9, 4, 5, 9]
    parts = _parts(spark, stream, [4, 6])
    b = P.blocks(parts, 4, {"train": 10}).orderBy("block").collect()
    assert [list(r.ids) for r in b] == [[1, 1, 2, 3], [3, 3, 9, 4]]
    d = block_diagnostics(P.blocks(parts, 4, {"train": 10}), 9).orderBy("block").collect()
    assert [(r.repetitions, r.eos, r.unique_ids) for r in d] == [(1, 0, 3), (1, 1, 3)]


def test_unique_sketches_roll_up(spark):
    """Estimates rolled up from block sketches against exact counts, overlapping blocks included."""
    from tessera.operators import stats as ST
    rows = [("train", 0, list(range(5000))), ("train", 1, list(range(4000, 9000)) * 2), ("val", 0, [7] * 100), ("val", 1, [])]
    df = spark.createDataFrame(rows, "split string, seq long, ids array<long>")
    got = {(r["split"], r["seq"]): (r["n"], r["unique_ids"]) for r in ST.roll_up_unique(ST.unique_sketches(df, ["split", "seq"]), ["split", "seq"]).collect()}
    want = {("train", 0): (5000, 5000), ("train", 1): (10000, 5000), ("train", None): (15000, 9000), ("val", 0): (100, 1), ("val", None): (100, 1),
            (None, None): (15100, 9000)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and abs(got[k][1] - u) <= 4 * 1.04 / 2 ** (ST.LG_K / 2) * u for k, (n, u) in want.items())


def test_exact_unique_per_level_without_a_copy_of_the_ids_per_level(spark):
    from tessera.operators import stats as ST
    rows = [("train", 0, [1, 1, 2]), ("train", 1, [2, 3]), ("val", 0, [3, 3, 9]), ("val", 1, [9])]
    df = spark.createDataFrame(rows, "split string, seq long, ids array<long>")
    got = ST.exact_unique(df, ["split", "seq"])
    assert {(r["split"], r["seq"]): r["exact"] for r in got.collect()} == {
        ("train", 0): 2, ("train", 1): 2, ("val", 0): 2, ("val", 1): 1, ("train", None): 3, ("val", None): 2, (None, None): 4}
    for d in (got, ST.unique_sketches(df, ["split", "seq"])):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and ("explode" not in plan or "array_distinct" in plan)
    assert {(r["split"], r["seq"]): r["n"] for r in ST.unique_sketches(df, ["split", "seq"]).collect()} == {(a, b): len(x) for a, b, x in rows}


def test_shift_check_joins_no_ids(spark):
    from tessera.operators.stats import shift_mismatches
    rows = [("a", 0, [1, 2, 3], [2, 3, 4]), ("a", 1, [4, 5, 6], [5, 7, 9]), ("a", 2, [8, 1], [1, 2]), ("b", 0, [1], [2])]
    df = spark.createDataFrame(rows, "split string, seq long, inputs array<long>, targets array<long>")
    got = shift_mismatches(df)
    # in a: 7 for 6 inside the second window, 9 for 8 at its edge
    assert sorted(map(tuple, got.collect())) == [("a", 3, 2), ("b", 1, 0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "inputs" not in plan and "targets" not in plan

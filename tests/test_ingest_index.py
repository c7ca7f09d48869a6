"""The key index of incremental ingestion."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.streaming import ingest as IG


def rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, dedup_key string, text string")


def stored(spark, out):
    return sorted((tuple(r) for r in spark.read.parquet(out).select("id", "dedup_key", "text").collect()), key=repr)


def test_first_row_of_a_key_and_null_keys(spark, tmp_path):
    out = str(tmp_path / "out")
    IG.store_batch(rows(spark, (5, "a", "x"), (2, "a", "y"), (7, None, "n7"), (6, None, "n6"), (3, "b", "z"), (3, "b", "z")), out, "r", 0, "dedup_key", "id")
    want = [(2, "a", "y"), (3, "b", "z"), (6, None, "n6")]
    assert stored(spark, out) == sorted(want, key=repr)
    IG.store_batch(rows(spark, (1, "a", "late"), (0, None, "n0"), (9, "c", "new"), (8, "-", "minus"), (4, "=", "sign")), out, "r", 1, "dedup_key", "id")
    want += [(9, "c", "new"), (8, "-", "minus"), (4, "=", "sign")]
    assert stored(spark, out) == sorted(want, key=repr)
    assert IG.read_keys(spark, out).count() == len(want)


@pytest.mark.parametrize("broken", ["output", "index"])
def test_replay_after_a_failure_at_each_point(spark, tmp_path, monkeypatch, broken):
    out = str(tmp_path / "out")
    IG.store_batch(rows(spark, (1, "a", "x")), out, "r", 0, "dedup_key", "id")
    batch = rows(spark, (2, "a", "y"), (3, "b", "z"))
    with monkeypatch.context() as m:
        if broken == "output":
            m.setattr(IG, "broadcast_if_small", lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
        else:
            m.setattr(IG, "_write_keys", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            IG.store_batch(batch, out, "r", 1, "dedup_key", "id")
    for _ in range(2):
        IG.store_batch(batch, out, "r", 1, "dedup_key", "id")
        assert stored(spark, out) == [(1, "a", "x"), (3, "b", "z")]
    IG.store_batch(rows(spark, (4, "b", "again")), out, "other", 1, "dedup_key", "id")
    assert stored(spark, out) == [(1, "a", "x"), (3, "b", "z")]


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    out = str(tmp_path / "out")
    many = spark.range(2000).select("id", F.concat(F.lit("k"), "id").alias("dedup_key"), F.lit("t").alias("text"))
    IG.store_batch(many, out, "r", 0, "dedup_key", "id", buckets=64)
    one = rows(spark, (5, "k77", "t")).select(IG.bucket_of(IG.key_digest(F.col("dedup_key")), 64)).first()[0]
    for b in range(64):  # the other buckets can't even be read
        if b != one:
            for folder, _, files in os.walk(f"{out}/{IG.KEYS}/bucket={b}"):
                for f in files:
                    with open(f"{folder}/{f}", "wb") as spoilt:
                        spoilt.write(b"spoilt")
    IG.store_batch(rows(spark, (5000, "k77", "t")), out, "r", 1, "dedup_key", "id", buckets=64)
    assert spark.read.parquet(out).count() == 2000


def test_index_is_built_for_an_old_output_and_compacted(spark, tmp_path):
    out = str(tmp_path / "out")
    rows(spark, (1, "a", "x"), (2, None, "y")).write.parquet(f"{out}/run_id=old/batch_id=0")
    for k in range(3):
        IG.store_batch(rows(spark, (3, "a", "x"), (4, None, "y"), (5 + k, f"n{k}", "z")), out, "r", k, "dedup_key", "id", buckets=2)
    want = stored(spark, out)
    assert [r[0] for r in sorted(want)] == [1, 2, 5, 6, 7]
    IG.compact_keys(spark, out)
    files = [f for _, _, fs in os.walk(f"{out}/{IG.KEYS}") for f in fs if f.endswith(".parquet")]
    assert len(files) <= 2 and IG.read_keys(spark, out).count() == 5
    IG.store_batch(rows(spark, (8, "n1", "z"), (9, "a", "x")), out, "r", 9, "dedup_key", "id", buckets=2)
    assert stored(spark, out) == want

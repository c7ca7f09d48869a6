"""Books by lines and groups in parts, against the whole-value forms."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.cleaning import clean_book, clean_book_lines, concat_parts
from tessera.sources import readers as RS

LINES = ["", "", " ", "\t ", "12", "  7 ", "٣", "CHAPTER IV", "CHAPTER\t 12 ", "chapter one", "Some text", "  indented  text", "tail  ", "x", " ", "12 a",
         "CHAPTER IV b", "\x0b", "PREFACE", "a copyright line", "99"]


def whole(spark, folder):
    df = clean_book(RS.read_books(spark, folder))
    return {r["path"]: r["text"] for r in df.collect() if r["text"]}


def by_lines(spark, folder):
    out = {}
    for r in sorted(clean_book_lines(RS.read_book_lines(spark, folder)).collect(), key=lambda r: (r["path"], r["place"])):
        out[r["path"]] = out.get(r["path"], "") + r["text"]
    return out


def test_lines_equal_whole_texts(spark, tmp_path):
    r = random.Random(4)
    for i in range(150):
        pool = LINES if i % 3 else LINES[:10] * 3 + LINES
        end = r.choice(["\n", "\r\n", "\r"])
        text = end.join(r.choice(pool) for _ in range(r.randint(0, 14))) + r.choice(["", end, end * 2])
        (tmp_path / f"book{i}.txt").write_bytes(text.encode())
    assert by_lines(spark, str(tmp_path)) == whole(spark, str(tmp_path))


def test_a_book_larger_than_a_split(spark, tmp_path):
    r = random.Random(5)
    text = "\n".join(r.choice(LINES[:-3] + ["word " * 20]) for _ in range(6000)) + "\n" * 30_000 + "end"
    (tmp_path / "book1.txt").write_text("junk\nPREFACE\n" + text + "\nCopyright\nlicence", newline="")
    want = whole(spark, str(tmp_path))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        assert RS.read_book_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
        assert by_lines(spark, str(tmp_path)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"book{i}.txt").write_text(f"text {i}\n")
    (tmp_path / "other.txt").write_text("none of the books")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
        lines, books = RS.read_book_lines(spark, str(tmp_path)), RS.read_books(spark, str(tmp_path))
        assert max(lines.rdd.getNumPartitions(), books.rdd.getNumPartitions()) <= 8 * spark.sparkContext.defaultParallelism < 400
        assert sorted((r["path"], r["line"]) for r in lines.collect()) == sorted((f"book{i}.txt", x) for i in range(400) for x in ("", f"text {i}"))
        assert {r["path"]: r["text"] for r in books.collect()} == {f"book{i}.txt": f"text {i}\n" for i in range(400)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_driver_lists_no_books(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"book{i} a%20b.txt").write_text(f"text {i}\r\rmore\r\n")
    (tmp_path / "_book1.txt").write_text("hidden")
    (tmp_path / "book1.md").write_text("another kind")
    (tmp_path / "bookdir.txt").mkdir()
    lines = RS.read_book_lines(spark, str(tmp_path), "{book,_book}*.txt")
    assert not [f for f in lines.inputFiles() if str(tmp_path) in f]
    got = {}
    for r in lines.orderBy("path", "block", "at").collect():
        got.setdefault(r["path"], []).append(r["line"])
    assert got == {f"book{i} a%20b.txt": [f"text {i}", "", "more", ""] for i in range(300)}
    with pytest.raises(RS.SourceMissing):
        RS.read_book_lines(spark, str(tmp_path), "chapter*.txt")
    with pytest.raises(RS.SourceMissing):
        RS.read_book_lines(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize("chunk", [1, 2, 3, 1000])
def test_ranges_of_a_file_share_no_line(monkeypatch, chunk):
    import io
    monkeypatch.setattr(RS, "CHUNK", chunk)
    r = random.Random(chunk)
    texts = [b"", b"\xef\xbb\xbf", b"\xef\xbb\xbf\n", b"\xef\xbb\xbfa\rb", b"\r\n\r\n", b"\r\r", b"a" * 9] + [
        b"".join(r.choice([b"\r", b"\n", b"\r\n", b"a", b"bc", b"\xc3\xa9"]) for _ in range(r.randint(0, 12))) for _ in range(150)]
    for text in texts:
        want = [x for x in text.removeprefix(RS.BOM).splitlines()]
        for step in (1, 2, 3, 5, 100):
            got, ended = [], False
            for start in range(0, max(len(text), 1), step):
                for lines, ended in RS._lines_from(io.BytesIO(text), start, start + step):
                    got += lines
            assert (got, ended) == (want, text[-1:] in (b"", b"\n", b"\r")), (text, step)


@pytest.mark.parametrize("sep, size", [("\n\n", 7), ("", 3), ("--", 1000)])
def test_parts_equal_the_joined_text(spark, sep, size):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), i, r.choice(["", "x", "some longer text", "é日🙂", None])) for i in range(120)]
    rows += [("hot", i, f"<{i}>") for i in range(400)] + [("empty", 0, ""), ("two", 0, ""), ("two", 1, ""), ("null", 0, None)]
    df = spark.createDataFrame(rows, "g string, o long, t string").repartition(5)
    got = {}
    for x in sorted(concat_parts(df, "g", "o", "t", sep, size).collect(), key=lambda x: x["part_no"]):
        parts = got.setdefault(x["g"], [])
        assert x["part_no"] == len(parts)
        parts.append(x["text"])
    for g in {x[0] for x in rows} - {"null"}:
        joined = sep.join(t for k, _, t in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]) if t is not None)
        assert got[g] == ([joined[i:i + size] for i in range(0, len(joined), size)] or [""])
    assert "null" not in got and concat_parts(df.where("o < 0"), "g", "o", "t", sep, size).count() == 0


def test_a_group_of_a_million_parts(spark):
    """Bounded by the part, not by the group."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), "id", F.concat(F.col("id") % 10, F.lit(",")).alias("t"))
    got = concat_parts(df, "g", "id", "t", "", 10_000).select("part_no", F.length("text").alias("n"), F.md5("text").alias("d"))
    assert got.agg(F.count("*"), F.sum("n"), F.max("n"), F.countDistinct("d")).first() == (200, 2_000_000, 10_000, 1)

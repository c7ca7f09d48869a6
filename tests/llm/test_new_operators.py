"""Hard negatives, conversation repair and WARC against brute force, and odd inputs."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conv_repair, decontam, hard_negatives, pii, queries, warc
from tessera.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
BLACK = re.compile(r"[^\x20\x09-\x0D]")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- hard negatives ------------------------------------------------------------
def brute_negatives(rows, is_anchor, positives=5, negatives=3):
    """``rows``: (id, integer vector, label), no null parts."""
    rows = sorted(rows, key=lambda r: r[0])
    out = []
    for a, (i, q, label) in enumerate(rows):
        if not is_anchor(i):
            continue
        score = [int(sum(x * y for x, y in zip(q, r[1]))) for r in rows]
        order = sorted(range(len(rows)), key=lambda k: (-score[k], rows[k][0]))
        for p in [k for k in order if k != a and rows[k][2] == label][:positives]:
            fit = [k for k in order if rows[k][2] != label and 50 * score[p] <= 100 * score[k] <= 95 * score[p]]
            out += [(i, rows[p][0], n + 1, rows[k][0], score[p], score[k]) for n, k in enumerate(fit[:negatives])]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, anchor boolean, q string, place int"


def vectors(n=260, dims=6, seed=4):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = [x + r.gauss(0, 0.3) for x in r.choice(base)] if i % 3 else [0.5, 0.25] + [0.125] * (dims - 2)  # a third are copies
        rows.append((i, [float(np.float32(x)) for x in v], r.randrange(3), True, "x", 1))
    return rows


@pytest.mark.parametrize("block", [1024, 8])
def test_hard_negatives_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", 4)
    monkeypatch.setattr(hard_negatives, "PAGE", 3)
    rows = vectors()
    odd = [(1000, None, 1), (1050, [0.1] * 6, None), (None, [0.1] * 6, 1), (1100, [0.1, None] + [0.1] * 4, 1), (1150, [float("nan")] * 6, 1),
           (1200, [float("inf")] * 6, 1), (1250, [0.5, 0.5], 2), (1300, [], 2), (1350, [0.3] * 6, 77)]
    df = spark.createDataFrame(rows + [(*o, None, None, None) for o in odd], VECTORS)
    whole = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label, *_ in rows]
    whole += [(1250, [128, 128, 0, 0, 0, 0], 2), (1300, [0] * 6, 2), (1350, [76] * 6, 77)]
    got = collected(hard_negatives.mine(df, F.col("vec_id") % 10 == 0))
    assert got == brute_negatives(whole, lambda i: i % 10 == 0)
    assert {r[0] for r in got} > {0, 10, 1250}


def test_hard_negatives_repeated_rows_and_empty(spark):
    rows = [(50, [1.0, 0.0], 0), (50, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.8, 0.0], 1), (2, [0.8, 0.0], 1), (3, [0.7, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = collected(hard_negatives.mine(df, F.col("vec_id") == 50))
    # either of the two equal anchors has the other (65,536) and row 1 (230 * 256) as positives
    one = [(50, 1, 1, 2, 58880, 52224), (50, 1, 2, 2, 58880, 52224), (50, 1, 3, 3, 58880, 45824),
           (50, 50, 1, 2, 65536, 52224), (50, 50, 2, 2, 65536, 52224), (50, 50, 3, 3, 65536, 45824)]
    assert got == sorted(one + one, key=repr)
    assert hard_negatives.mine(df.where("vec_id < 0"), F.col("vec_id") == 50).count() == 0
    huge = spark.createDataFrame([(50, [1e30], 0), (51, [1e30], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(huge, F.col("vec_id") == 50).collect()


def test_zone_maps_choose_blocks():
    """Far blocks are left out, and no block that could hold a result is."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (20, 8))
    blocks = [c + rng.integers(-5, 6, (30, 8)) for c in centres]
    q = centres + rng.integers(-5, 6, centres.shape)
    least, most = hard_negatives.bounds(q, np.array([b.min(0) for b in blocks]), np.array([b.max(0) for b in blocks]))
    for j, b in enumerate(blocks):
        s = q @ b.T
        assert (least[:, j] <= s.min(1)).all() and (s.max(1) <= most[:, j]).all()
    best = np.array([np.sort((q[i:i + 1] @ blocks[i].T)[0])[-5] for i in range(20)])
    assert (most >= best[:, None]).mean() < 0.3


def test_hilbert_curve_is_a_path():
    """Every cell once, and neighbours on the curve are neighbours in space."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = hard_negatives.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# --- conversations ---------------------------------------------------------------
def faults_of(rows):
    """Rows (turn, role, text) in order -> first fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        black = BLACK.findall(text)
        out.append("blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Every edit string with at most one added pair between two rows, cheapest and least first."""
    faults, options = faults_of(rows), []
    for (_, role, text), fault in zip(rows, faults):
        extra = 5 if fault == "truncated" else 0
        ways = [("D", 2, [])]
        if fault in (None, "truncated"):
            ways += [("K", extra, [f"{role}:{text}"]), ("R", 1 + extra, [f"user:{text}"]), ("R", 1 + extra, [f"assistant:{text}"])]
        options.append(ways)
    adds = [("", 0, [])] + [("I", 5, [f"{r}:"]) for r in ("user", "assistant")] + [("II", 10, ["user:", "assistant:"]), ("II", 10, ["assistant:", "user:"])]
    best = None
    for chosen in itertools.product(adds, *itertools.chain.from_iterable((o, adds) for o in options)):
        lines = [x for c in chosen for x in c[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines)):
            found = (sum(c[1] for c in chosen), "".join(c[0] for c in chosen), lines)
            best = min(best, found) if best else found
    return best, faults


def test_repair_against_all_edits(spark):
    r, rows, want = random.Random(8), [], {}
    texts = ["Yes.", "No!", "and then", " ", "Yes.", "Why?", "so"]
    for c in range(60):
        conv = [(t, r.choice(["user", "assistant", "system", "tool", "user", "assistant"]), r.choice(texts)) for t in range(r.randint(0, 3))]
        rows += [(f"c{c}", *x, "k") for x in conv]
        if conv:
            want[f"c{c}"] = brute_repair(conv)
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, fault string")
    repaired = conv_repair.repair(df)
    got = {x["conv"]: x for x in conv_repair.report(repaired).collect()}
    assert got.keys() == want.keys()
    for c, ((cost, edits, lines), faults) in want.items():
        assert (got[c]["cost"], got[c]["audit"]) == (cost, edits)
        assert got[c]["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert [got[c][f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]


def long_form(rows):
    """An independent forward search that keeps the edit strings themselves."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"0": (0, "", ())}

    def put(into, at, initial, found):
        to = step.get((at, initial)) if initial else at
        if to is not None and (to not in into or found[:2] < into[to][:2]):
            into[to] = found

    def added(into):
        for _ in range(2):
            for at, (cost, edits, lines) in list(into.items()):
                for role in ("user", "assistant"):
                    put(into, at, role[0], (cost + 5, edits + "I", (*lines, role + ":")))
        return into
    for (_, role, text), fault in zip(rows, faults_of(rows)):
        new = {}
        for at, (cost, edits, lines) in added(best).items():
            put(new, at, "", (cost + 2, edits + "D", lines))
            if fault not in ("blank", "duplicate"):
                cost += 5 if fault else 0
                put(new, at, role[:1], (cost, edits + "K", (*lines, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    put(new, at, other[0], (cost + 1, edits + "R", (*lines, f"{other}:{text}")))
        best = new
    cost, edits, lines = min((v for k, v in added(best).items() if k in "0a"), key=lambda v: v[:2])
    return cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair_query_over_the_table(spark):
    def shown(v):
        return " " if v is None else str(v)
    convs = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        spot = zlib.crc32(f"{shown(r['conv_id'])}:{shown(r['turn'])}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", shown(r["text"]))}.get(spot, shown(r["text"]))
        row = (r["turn"], "user" if spot == 4 else shown(r["role"]), text)
        convs.setdefault(r["conv_id"], []).extend([row] * (0 if spot == 0 else 2 if spot == 3 else 1))
    got = {x["conv_id"]: x for x in queries.op12_conversation_repair(spark, SF).collect()}
    assert got.keys() == convs.keys()
    for c, rows in convs.items():
        rows.sort()
        turns, initials = [t for t, _, _ in rows], [r[:1] for _, r, _ in rows]
        assert tuple(got[c])[1:5] == (max(turns) - min(turns) + 1 - len(set(turns)) if rows else 0,
                                      *(faults_of(rows).count(f) for f in ("blank", "duplicate", "truncated")))
        assert got[c]["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert (got[c]["cost"], got[c]["audit"], got[c]["repaired_sha256"]) == long_form(rows)


def test_repair_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, conv string, nth int, present boolean"
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (1, None, "user", "A?"), (1, None, "user", "A?"),
            (1, 5, "assistant", "B."), (1, 9, "", "C."), (2, 1, "user", None), (3, -2**63, "user", "x."), (3, 2**63 - 1, "assistant", "y.")]
    df = spark.createDataFrame([(*r, "z", 0, True) for r in rows] + [(4, 1, "user", "gone.", "z", 0, False), (4, 2, "user", "gone.", "z", 0, None)], schema)
    got = {x["conv"]: x for x in conv_repair.report(conv_repair.repair(df, present="present")).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[None]["audit"], got[None]["blank"], got[None]["gaps"]) == ("DKK", 1, 0)
    assert (got[1]["duplicate"], got[1]["gaps"], got[1]["audit"], got[1]["cost"]) == (1, 3, "KDKD", 4)
    assert (got[2]["audit"], got[2]["repaired_sha256"]) == ("D", empty)
    assert got[3]["gaps"] == 2**63 - 1
    assert tuple(got[4])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert conv_repair.report(conv_repair.repair(df.where("turn > 100 and turn < 50"))).count() == 0
    out = conv_repair.repair(df, present="present").where("conv = 1").collect()
    assert [(r["edit"], r["fault"], r["was"], r["role"], r["text"]) for r in out] == [
        ("K", None, "user", "user", "A?"), ("D", "duplicate", "user", None, None), ("K", None, "assistant", "assistant", "B."),
        ("D", None, "", None, None)]


@pytest.mark.parametrize("rows_held", [7, 65536])
def test_repair_giant_conversation_in_blocks(rows_held, monkeypatch):
    """Spilled blocks are read backwards for the edits and forwards for the rows."""
    monkeypatch.setattr(conv_repair, "SPILL_ROWS", rows_held)
    r = random.Random(3)
    rows = [(t, r.choice(["user", "assistant", "tool"]), r.choice(["Yes", "No"]) + f" {t}" + r.choice([".", ".", "!", ""])) for t in range(2000)]
    conv = conv_repair._Conversation("c")
    for t, role, text in rows:
        conv.add((t, 3 if text[-1] not in ".!?" else 0, role, text))
    assert bool(conv.blocks) == (rows_held < 2000) and len(conv.rows) <= rows_held
    out = list(conv.repaired())
    cost, edits, digest = long_form(rows)
    assert "".join(x[2] for x in out) == edits
    assert hashlib.sha256("\n".join(f"{x[5]}:{x[6]}" for x in out if x[5]).encode()).hexdigest() == digest


# --- archives ---------------------------------------------------------------------
PAGES = "page_id long, url string, html string, digest string, place int, first string"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_roundtrip_odd_pages(spark, tmp_path, monkeypatch):
    long = "<p>é日" * 200_000
    rows = [(5, "http://a", "<p>x</p>"), (3, "http://b\r\nEvil: 1", "<p>x</p>"), (9, None, "<p>x</p>"), (7, "u", None), (8, "u", ""), (1, "u", long),
            (2, "u", "WARC/1.1\r\nContent-Length: 9\r\n\r\n\r\n\r\nWARC/1.1\r\n\r\n"), (4, "u", "same"), (4, "u", "same"), (None, "u", "same"), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, "d", 1, "f") for r in rows], PAGES)
    monkeypatch.setattr(queries, "table", lambda *a: pages)
    got = queries.op13_warc_roundtrip(spark, SF).collect()
    want = []
    for i, _, html in rows:
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same, default=None)
        want.append((i, len((html or "").encode()), b32(html), "response" if i == first else "revisit", None if i == first else first))
    at = want.index((4, 4, b32("same"), "response", None))
    want[at] = (4, 4, b32("same"), "revisit", 4)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(queries, "table", lambda *a: pages.where("page_id < 0"))
    assert queries.op13_warc_roundtrip(spark, SF).count() == 0
    small = warc.page_records(pages, min_bytes=8)
    assert sorted(r["record_type"] for r in small.collect()).count("revisit") == 2


@pytest.fixture(scope="module")
def archive(spark):
    path = f"{ensure_checkpoint_dir(spark)}/warc-test"
    rows = [(f"<urn:x:{i}>", ["response", "revisit", "metadata"][i % 3], f"http://h{i % 2}/{i}", f"2024-01-{i + 1:02d}T00:00:00Z",
             bytes([i]) * (1 if i % 3 == 1 else 20_000), 20_000) for i in range(20)]
    df = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, record_date string, payload binary, payload_bytes long")
    warc.write(df.repartition(3), path, filebytes="300")
    return path, df


def test_warc_predicates_are_judged_on_headers(spark, archive):
    path, df = archive
    got = warc.read(spark, path, ["record_id", "payload"], types=["response"], headers={"WARC-Target-URI": "http://h0/6"}).collect()
    assert [(r["record_id"], bytes(r["payload"])) for r in got] == [("<urn:x:6>", bytes([6]) * 20_000)]
    pre = warc.read(spark, path, prefixes={"WARC-Target-URI": "http://h1/"}, payload_types=["response"])
    assert {r["record_id"]: r["payload"] is None for r in pre.collect()} == {f"<urn:x:{i}>": i % 3 != 0 for i in range(1, 20, 2)}
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        pushed = warc.read(spark, path, ["record_id", "record_type", "target_uri"]).where("record_type in ('response', 'metadata') and target_uri like 'http://h0%'")
        assert "Filter" not in pushed._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
        assert {r["record_id"] for r in pushed.collect()} == {f"<urn:x:{i}>" for i in range(0, 20, 2) if i % 3 != 1}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_warc_skips_payloads_without_inflating(spark, archive, monkeypatch):
    """Damage behind the headers of a record isn't noticed unless its payload is read."""
    record = warc.member(warc.record_bytes({"record_id": "<a>", "payload": random.Random(1).randbytes(50_000)}), 6)
    spoilt = record[:20_000] + bytes(25_000) + record[45_000:]
    import io
    wanted = warc.Wanted(body=False)
    found = list(warc._members(io.BytesIO(spoilt + record), "x", wanted))
    assert [at for at, _, _ in found] == [0, len(record)]
    with pytest.raises(zlib.error):
        list(warc._members(io.BytesIO(spoilt), "x", warc.Wanted()))
    with pytest.raises(warc.Damaged):
        list(warc._members(io.BytesIO(record[:-30_000]), "x", warc.Wanted()))


def test_warc_committed_files_only(spark, archive):
    path, df = archive
    import os
    local = path.removeprefix("file:")
    with open(f"{local}/part-lost.warc.gz", "wb") as f:
        f.write(warc.member(warc.record_bytes({"record_id": "<lost>"}), 3))
    assert warc.read(spark, path, ["record_id"]).count() == 20
    assert len([f for f in os.listdir(local) if f.endswith(".gz")]) > 3 + 1
    other = f"{path}-two"
    warc.write(df, other)
    warc.write(df.limit(3), other)
    assert warc.read(spark, other, ["record_id"]).count() == 23
    warc.write(df.limit(4), other, mode="overwrite")
    assert warc.read(spark, other, ["record_id"]).count() == 4
    assert warc.read(spark, other).agg(F.sum("payload_bytes")).first()[0] == 80_000


def test_warc_foreign_archives(spark, archive, tmp_path):
    """Plain files, one gzip stream, members without the length field; records without HTTP heads."""
    plain = warc.record_bytes({"record_id": "<h>", "payload": b"\r\n\r\nbody", "target_uri": "http://x"})
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(text + plain)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(text + plain))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(text) + gzip.compress(plain))
    (tmp_path / "note.txt").write_text("no archive")
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r["file"], r["record_type"], bytes(r["payload"])) for r in got) == sorted(
        (f, k, p) for f in ("a.warc", "b.warc.gz", "c.warc.gz") for k, p in (("warcinfo", b"hello"), ("response", b"\r\n\r\nbody")))
    only = warc.read(spark, str(tmp_path / "a.warc"), types=["response"], columns=["record_id", "offset"]).collect()
    assert [tuple(r) for r in only] == [("<h>", len(text))]
    (tmp_path / "d.warc").write_bytes(plain[:-30])
    with pytest.raises(Exception, match="ends early"):
        warc.read(spark, str(tmp_path)).collect()


# --- private data and leaks: long texts, languages, kinds of edits ----------------------
@pytest.mark.parametrize("text, span", [
    ("ok jean arobase exemple point fr ok", "jean arobase exemple point fr"), ("à jean [arobase] exemple [point] fr", "jean [arobase] exemple [point] fr"),
    ("mail john dot doe at example dot com now", "john dot doe at example dot com"), ("x j_dot_d[at]example[dot]org", "j_dot_d[at]example[dot]org"),
    ("an hans punkt meier at beispiel punkt de", "hans punkt meier at beispiel punkt de"), ("a juan arroba ejemplo punto es", "juan arroba ejemplo punto es")])
def test_disguised_addresses_by_language(text, span):
    assert [(text[a:b], k) for a, b, k in pii.disguised(text, [])] == [(span, 0)]


def test_everyday_words_are_no_addresses():
    for t in ["meet at this point in time", "un point important", "le point de vue dot", "arobase", "the dot. Call john at home", "at point fr"]:
        assert pii.disguised(t, []) == []


@pytest.mark.parametrize("unit", ["one ", "one two 3 ", "john at example dot com ", "a.b@c.de j[at]k[dot]l ", "x dot at ", "a@", " dot at", "one-",
                                  "x_dot_" * 20 + "y" * 70 + "[at]b[dot]c ", "é" + "_dot_" * 40 + "[at]b[dot]c ", "jean arobase exemple point fr "])
def test_private_data_in_linear_time(unit):
    """Twenty times the text takes no more than some forty times the time (a square would take 400 times)."""
    import time
    took = []
    for n in (20_000, 400_000):
        t = (unit * (n // len(unit) + 1))[:n]
        start = time.process_time()
        pii.disguised(t, pii.detect(t))
        took.append(time.process_time() - start)
    assert took[1] < 40 * took[0] + 1


def test_ten_megabytes_of_disguises(spark):
    rows = [(0, "one " * 2_500_000), (1, "john at example dot com " * 420_000), (2, "a.b@c.de j[at]k[dot]l " * 450_000)]
    got = {r["doc_id"]: r["n_added"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_added").collect()}
    assert got == {0: 0, 1: 420_000, 2: 450_000}


@pytest.mark.parametrize("kind", ["replace", "delete", "insert", "mixed"])
@pytest.mark.parametrize("rate", [0.05, 0.12, 0.199])
def test_leak_recall_by_kind_of_edit(kind, rate):
    r = random.Random(f"{kind}{rate}")
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(600)]

    def some(n):
        return [r.choice(vocabulary) for _ in range(n)]
    items = [some(r.randint(5, 70)) for _ in range(400)]
    index = decontam.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    texts = []
    for item in items:
        w = list(item)
        for _ in range(int(rate * len(w))):
            k, at = kind if kind != "mixed" else r.choice(["replace", "delete", "insert"]), r.randrange(len(w))
            w[at:at + (k != "insert")] = [] if k == "delete" else some(1)
        texts.append(" ".join(some(r.randint(0, 60)) + w + some(r.randint(0, 60))))
    truth = {k for k, t in enumerate(texts) if decontam.edits(index.bits[k], len(items[k]), decontam.symbols(t, decontam.Hashes()).tolist())[0]
             <= int(decontam.MAX_EDITS * len(items[k]))}
    found = {a for a, b, *_ in index.hits(texts, decontam.Hashes()) if a == b}
    assert len(truth) == len(items) and len(found) >= 0.9 * len(truth)

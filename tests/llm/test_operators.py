"""Corpus operators against brute force, the libraries, and odd inputs."""

import hashlib
import itertools
import os
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import (decontam, html_main, jaccard_join, kd_shards, line_runs, mcd_quality, pii, piece_codec, queries,
                         token_counts, toxicity)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, shard int"
rnd = random.Random(11)
VOCAB = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(600)]


def words(n, r=rnd):
    return " ".join(r.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls everywhere, empty and long texts, copies, near copies, repeated rows, clashing names."""
    base = words(120)
    near = base.split()
    near[7] = "changed"
    run = "\n".join(words(30) for _ in range(3))
    texts = [None, "", "  \n", base, base, " ".join(near), run + "\n" + words(60), words(60) + "\n" + run, words(3), words(3),
             "<|endoftext|> a'll  日本 \x1c b", words(20000), "\n".join([words(60)] * 3), "Mail a.b@c.de, 1.2.3.4"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "k", i, 0) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_html_blocks_and_boilerplate():
    page = ("<html><head><title>x</title><script>var a='<p>';</script></head><body><nav><a href=/>Home</a></nav>"
            "<div class='content'><h1>T &amp; U</h1><p>One  sentence,\nhere.<p>Two.</p><ul><li>point</li></ul></div>"
            "<div class='sidebar'><p>Side, bar.</p></div><div id='comments'><p>I agree, fully.</p></div><footer>f</footer>")
    assert html_main.main_text(page) == "T & U\n\nOne sentence, here.\n\nTwo.\n\npoint"
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<!-- open <p>x") == ""


def test_html_query_against_markup(spark):
    got = {r["page_id"]: r for r in queries.op1_html_main_text(spark, SF).collect()}
    import html
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*?)(</article>|<footer>|$)", r["html"])[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]]["text"] == "\n\n".join(p for p in parts if p)


def test_shards(spark, docs, empty):
    got = kd_shards.shard_documents(docs, 5).collect()
    assert len(got) == docs.count()
    for k in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert {r["text_crc32"] for r in got if r["doc_id"] == 0} == {0}
    assert kd_shards.shard_documents(empty, 5).count() == 0
    rows = queries.op2_kd_tree_shards(spark, SF).collect()
    text = texts_of(spark)
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    equal = spark.range(960).selectExpr("id doc_id", "'same text' text", "'en' lang", "'s' source", "9L n_chars")
    sizes = Counter(r["shard"] for r in kd_shards.shard_documents(equal, 24).collect())
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2


def brute_stats(t):
    w = WORD.findall(t or "")
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, empty):
    for table, got in ((docs, mcd_quality.judge(docs).collect()),
                       (spark.read.parquet(f"{SF}/documents.parquet"), queries.op3_mcd_quality(spark, SF).collect())):
        want = Counter(brute_stats(r["text"]) for r in table.collect())
        assert Counter(tuple(r)[1:6] for r in got) == want
    assert all(not (r["base_failed"] and r["kept"]) for r in got)
    junk = [r["doc_id"] for r in got if not r["base_failed"] and r["n_symbols"] > r["n_words"]]
    assert junk and not any(r["kept"] for r in got if r["doc_id"] in junk)
    plain = [r for r in got if not r["base_failed"] and not r["n_symbols"] and not r["n_dup_lines"]]
    assert sum(r["kept"] for r in plain) >= 0.99 * len(plain)
    assert mcd_quality.judge(empty).count() == 0


def test_quality_each_dimension_rejects(spark):
    r = random.Random(6)
    passage = words(96, r)
    odd = {"word_len": " ".join(w + w for w in words(400, r).split()), "symbols": words(300, r) + " #" * 100,
           "dup_lines": "\n".join([words(600, r) for _ in range(10)] + ["Read more"] * 90),
           "repeats": " ".join([words(104, r), passage, words(104, r), passage])}
    rows = [(n, t) for n, t in odd.items()] + [(f"plain{i}", "\n".join(words(40, r) for _ in range(10))) for i in range(150)]
    rows.append(("two lines", "\n".join([words(300, r), *["Read on"] * 2])))
    df = spark.createDataFrame([(*x, "en", "s") for x in rows], "doc_id string, text string, lang string, source string")
    got = {x["doc_id"]: x for x in mcd_quality.judge(df).collect()}
    assert not any(got[n]["base_failed"] or got[n]["kept"] for n in mcd_quality.DIMS)
    assert all(x["kept"] for n, x in got.items() if n not in odd)


def test_mahalanobis_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame([("=a", "=b", False, *map(float, r)) for r in x],
                               "lang string, source string, base_failed boolean, x0 double, x1 double, x2 double, x3 double")
    est = [r for r in mcd_quality.estimates(df).collect() if r["level"] == 0][0]
    w = np.array([[est[f"w{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    cov = np.linalg.inv(w.T @ w) - np.diag(np.square(mcd_quality.FLOOR))
    assert np.allclose([est[f"m{i}"] for i in range(4)], x.mean(0), atol=0.8)
    assert np.all(np.abs(np.log(np.linalg.eigvalsh(cov) / np.linalg.eigvalsh(np.cov(x.T)))) < 0.8)


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def near_group(n, size, edits, seed):
    r = random.Random(seed)
    base = words(size, r).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(size)] = r.choice(VOCAB)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limits", [None, (4, 2, 1), (4, 2, 3)])
def test_jaccard_join(spark, docs, empty, monkeypatch, limits):
    texts = near_group(40, 100, 5, 1) + near_group(30, 60, 4, 2) + [words(80) for _ in range(20)]
    passage = words(40)
    texts += [words(15) + " " + passage for _ in range(25)] + [words(100) + " " + passage for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r["doc_id"], r["text"]) for r in docs.collect()]
    if limits:  # small limits drive the same rows through regions, recursion and blocks
        monkeypatch.setattr(jaccard_join, "LEAF", limits[0])
        monkeypatch.setattr(jaccard_join, "OFTEN", 2)
        monkeypatch.setattr(jaccard_join, "PIVOTS", limits[1])
        monkeypatch.setattr(jaccard_join, "ROUNDS", limits[2])
        monkeypatch.setattr(jaccard_join, "BLOCK", 8)
        monkeypatch.setattr(jaccard_join, "DIRECT", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(jaccard_join.near_duplicates(df, 4, 85)) == brute_components(rows, 4, 85)
    if not limits:
        assert jaccard_join.near_duplicates(empty, 4, 85).count() == 0
        kept = jaccard_join.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert 4 not in ids and 5 not in ids and 3 in ids and {0, 1, 2, 8, 9} <= set(ids)


def test_jaccard_join_rare_shingle_behind_prefix(spark, monkeypatch):
    """A link whose last common shingle is rare and in one prefix only: its cell has one point."""
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    monkeypatch.setattr(jaccard_join, "OFTEN", 30)
    pool = sorted((f"w{i}" for i in range(12000)), key=lambda w: int(jaccard_join.shingles(w, 1)[0]))
    frequent, rare = pool[-92:], pool[:-92]
    large, last, own = rare[:11], rare[-1], iter(rare[11:-1])
    x = frequent[:85] + large + [last] + [next(own) for _ in range(3)]
    y = frequent + large + [last] + [next(own) for _ in range(6)]
    rows = [(0, " ".join(x)), (1, " ".join(y))]
    rows += [(2 + i, " ".join(frequent + large * (i < 10) + [next(own) for _ in range(200)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = collected(jaccard_join.near_duplicates(df, 1, 85))
    assert got == brute_components(rows, 1, 85) and (1, 110, 0) in got


def test_near_copies_by_row(spark):
    """Null ids, repeated ids and repeated rows: one row of each group stays, no other row goes."""
    def near(t):
        return t.replace(t.split()[50], "changed", 1)
    r = random.Random(5)
    one, two, nine, ten = (words(120, r) for _ in range(4))
    alone = [words(90, r) for _ in range(3)]
    rows = [(1, one), (2, two), (None, near(one)), (None, alone[0]), (None, alone[1]), (None, None), (None, ""),
            (7, alone[2]), (7, near(two)), (9, nine), (9, nine), (9, nine), (None, ten), (None, ten), (None, near(ten))]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, row int")
    got = Counter((x["doc_id"], x["text"]) for x in jaccard_join.drop_near_duplicates(df).collect())
    group = [got.pop((None, t), 0) for t in (ten, near(ten))]
    assert sorted(group) == [0, 1]
    assert got == Counter([(1, one), (2, two), (None, alone[0]), (None, alone[1]), (None, None), (None, ""), (7, alone[2]), (9, nine)])


def shuffled(spark):
    """Bytes of the shuffle files that are there."""
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f: os.path.getsize(os.path.join(d, f)) for t in top for d, _, names in os.walk(t) for f in names if f.startswith("shuffle_")}


@pytest.mark.parametrize("drops", [False, True])
def test_near_copies_shuffle_no_texts(spark, drops):
    """Sets and texts move only for points of candidate pairs; tables on the way don't stay."""
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choices(string.ascii_letters, k=4000)) for _ in range(10))) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ckpt, before = spark.sparkContext.getCheckpointDir().removeprefix("file:"), shuffled(spark)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were more rows than can be sent
        if drops:
            assert sorted(x["doc_id"] for x in jaccard_join.drop_near_duplicates(df).collect()) == list(range(300))
        else:
            got = jaccard_join.near_duplicates(df).collect()
            assert sorted((x["doc_id"], x["component_id"]) for x in got) == [(i, i % 1000) for i, _ in rows]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(n for f, n in shuffled(spark).items() if f not in before) < 0.2 * sum(len(t) for _, t in rows)
    assert not [x for x in os.listdir(ckpt) if x.startswith("shelf-")]


@pytest.mark.parametrize("words", [1, 1 << 10])
def test_near_copies_with_a_full_bitmap(spark, monkeypatch, words):
    """The bitmap steers work, not results: also where it lets every row through."""
    monkeypatch.setattr(jaccard_join, "MARK_WORDS", words)
    texts = near_group(20, 80, 3, 3) + [f"{i} " + " ".join(near_group(1, 50, 0, i)) for i in range(100)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, t) for i, t in enumerate(texts[::3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 4, 85)
    assert collected(jaccard_join.near_duplicates(df, 4, 85)) == want
    assert sorted(x["doc_id"] for x in jaccard_join.drop_near_duplicates(df, 4, 85).collect()) == sorted(d for d, _, c in want if d == c)


def brute_runs(rows, least=50):
    """Deletes each line inside a run of ``least`` words that occurs earlier."""
    order = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    lines = {k: k[1].split("\n") for k in order}
    first, gone = {}, {k: set() for k in order}
    for k in order:
        ls = lines[k]
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                if sum(len(WORD.findall(x)) for x in ls[i:j]) >= least:
                    run = tuple(ls[i:j])
                    if run in first:
                        gone[k] |= set(range(i, j))
                    else:
                        first[run] = (k, i)
    return {k: "\n".join(x for i, x in enumerate(lines[k]) if i not in gone[k]) for k in order}


def test_line_runs(spark, docs, empty):
    shared = [words(20) for _ in range(6)]
    texts = ["\n".join(shared), "\n".join([words(5), *shared[1:4], "", words(9)]), "\n".join(shared[2:] + shared[:3]),
             "\n".join([words(12)] * 12), "\n".join(shared[:2]), "\n".join(shared)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_runs(rows)
    got = line_runs.delete_repeated_runs(df, deleted_col="n").collect()
    assert {(r["doc_id"]): r["text"] for r in got} == {k[0]: v for k, v in want.items()}
    out = line_runs.delete_repeated_runs(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r["text"] for r in out.collect() if r["doc_id"] == 3} == {""} and {r["text"] for r in out.collect() if r["doc_id"] == 0} == {None}
    assert line_runs.delete_repeated_runs(empty).count() == 0


def test_line_runs_many_blank_lines(spark):
    """Every blank line before a copied text starts a run of its own to the same end."""
    blank, r = 70_000, random.Random(8)
    text = "\n" * blank + "\n".join(words(30, r) for _ in range(3))
    rows = [(0, text), (1, text), (2, text + "\n" + words(9, r))]
    got = line_runs.delete_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), deleted_col="n").collect()
    assert {x["doc_id"]: (x["n"], x["text"]) for x in got} == {
        0: (0, text), 1: (blank + 3, ""), 2: (blank + 3, rows[2][1].split("\n")[-1])}


def test_token_counts(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer
    path = public_tokenizers.path(queries.BYTE_BPE)
    tok = Tokenizer.from_file(path)
    monkeypatch.setattr(token_counts, "BLOCK_PAIRS", 500)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False).ids))
                   for r in docs.collect()), key=repr)
    assert collected(token_counts.count_tokens(docs, path)) == want
    monkeypatch.setattr(token_counts, "LONG_POSTINGS", 2)  # every repeated pre-token is dealt by block
    monkeypatch.setattr(token_counts, "TASKS_SHIFT", 0)
    assert collected(token_counts.count_tokens(docs, path)) == want
    assert token_counts.count_tokens(empty, path).count() == 0
    cut = token_counts.PreTokens(path)
    chars = "".join(map(chr, range(0x20, 0x250))) + " \t\n\x85\xa0\x1c" * 9 + "aB1'sé"
    for _ in range(1500):
        t = "".join(rnd.choice(chars) for _ in range(30))
        assert cut(t) == [t[a:b] for _, (a, b) in cut.pre(t)]


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_pii(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m[0])
            if k == 1 and max(map(int, m[0].split("."))) > 255 or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)) \
                    or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((*m.span(), k))
    return sorted(out)


def test_pii_base_and_disguises(docs, empty):
    for _ in range(4000):
        t = "".join(rnd.choice("ab1234567890@@..+- ()_%") for _ in range(60))
        assert sorted(pii.detect(t)) == brute_pii(t)
    for t, kind, span in [("mail john.doe at example dot com now", 0, "john.doe at example dot com"),
                          ("x john[at]example[dot]org", 0, "john[at]example[dot]org"), ("to john@exаmple.com", 0, "john@exаmple.com"),
                          ("call plus one five five five one two three four five six", 3, "plus one five five five one two three four five six"),
                          ("at 192[.]168[.]0[.]1", 1, "192[.]168[.]0[.]1"), ("４１１１ １１１１ １１１１ １１１１", 2, "４１１１ １１１１ １１１１ １１１１"),
                          ("ip one nine two dot one six eight dot zero dot one ok", 1, "one nine two dot one six eight dot zero dot one")]:
        assert (t.index(span), t.index(span) + len(span), kind) in pii.disguised(t, pii.detect(t)), t
    for t in ["meet at example.com today", "I was at home. Dot the i.", "one, two, three", "Café à la crème – été"]:
        assert pii.disguised(t, []) == []
    got = pii.find_pii(docs).collect()
    assert len(got) == docs.count() and pii.find_pii(empty).count() == 0
    assert [r["spans"] for r in got if r["doc_id"] == 13] == ["email:5:13,ip:15:22"]


def test_piece_codec(spark, docs, empty):
    import sentencepiece
    path = public_tokenizers.path(queries.PIECE_BPE)
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.codec(path)
    texts = ["".join(rnd.choice("ab é▁ \n\t,.日本\x00🙂the ing") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    for t in texts + [r["text"] or "" for r in docs.collect()]:
        ids = np.frombuffer(c.encode(t), np.uint32).tolist()
        assert ids == sp.encode(t, add_bos=True, add_eos=True) and c.decode(ids) == sp.decode(ids)
    got = piece_codec.encode_decode(docs, path, with_ids=True, with_text=True).collect()
    assert all(hashlib.sha256(np.array(r["ids"], np.uint32).tobytes()).hexdigest() == r["ids_sha256"] for r in got)
    assert piece_codec.encode_decode(empty, path).count() == 0


def planted(items, rate, r):
    out = []
    for t in items:
        w = t.split()
        for _ in range(int(rate * len(w))):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        out.append(words(r.randint(0, 60), r) + " " + " ".join(w) + " " + words(r.randint(0, 60), r))
    return out


def test_decontamination(spark, docs, empty):
    r = random.Random(4)
    items = [words(r.randint(4, 70), r) for _ in range(120)] + ["", None, "one"]
    index = decontam.Index(list(enumerate(items)))
    for rate in (0, 0.1, 0.18):
        texts = planted(items[:120], rate, r)
        truth = {(k, k) for k, t in enumerate(texts) if decontam.edits(index.bits[k], len(index.words[k]), decontam.symbols(
            t, decontam.Hashes()).tolist())[0] <= int(0.2 * len(index.words[k]))}
        found = {h[:2] for h in index.hits(texts, decontam.Hashes())}
        assert len(truth & found) >= (1 if rate == 0 else 0.9) * len(truth)
    assert not index.hits([words(200, r) for _ in range(100)], decontam.Hashes())
    bench = spark.createDataFrame([(1, docs.where("doc_id = 3").first()["text"][:300]), (2, None)], "item_id long, text string")
    hit = {row["doc_id"] for row in decontam.find_leaks(docs, bench).collect()}
    assert hit == {3, 4, 5, None}
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {0, 1, 2, 13} <= {x["doc_id"] for x in kept.collect()} and kept.where("doc_id = 3").count() == 0
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == docs.count()
    assert decontam.find_leaks(empty, bench).count() == decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_toxicity(spark, docs, empty):
    r = random.Random(9)
    rows = [(i, words(60, r) + (" you blatherskite " if i % 4 == 0 else " ") + words(20, r)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model).withColumn("held", toxicity.held_out("doc_id")).collect()
    held = [x for x in got if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert held and {x["doc_id"] for x in held} == {x["doc_id"] for x in got if x["held"]}
    assert sum((x["score"] >= 0.5) == (x["doc_id"] % 4 == 0) for x in held) >= 0.95 * len(held)
    scores = [x["score"] for x in toxicity.score(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    kept = toxicity.reject_toxic(df, labels)
    assert kept.columns == df.columns and 200 <= kept.count() <= 240
    assert toxicity.reject_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.score(empty, model).count() == 0


def test_pipeline_stages(spark, docs, empty):
    cols = spark.read.parquet(f"{SF}/documents.parquet").columns
    got = corpus_pipeline.run(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows, seen = table, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, rows, SF).collect(), table.schema)
        assert after.columns == cols and after.count() <= rows.count(), name
        if name == "line_dedup":
            want = brute_runs([(r["doc_id"], r["text"]) for r in rows.collect()])
            assert {r["doc_id"]: r["text"] for r in after.collect()} == {
                k[0]: t for k, t in want.items() if t == k[1] or WORD.search(t)}
        if name == "near_copies":
            pairs = [(r["doc_id"], r["text"]) for r in rows.collect()]
            assert {r["doc_id"] for r in after.collect()} == {d for d, n, c in brute_components(pairs, 5, 80) if d == c}
        rows = after
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows.collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 1 and stage(spark, empty, SF).count() == 0

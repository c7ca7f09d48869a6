import random
import re

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T

GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SAMPLES = [
    "", " ", "a", "  lead", "trail \n", " nbsp ", "　wide ", "it's a dog's life",
    "x\n\nAssistant: y", "tabs\tand\t\tmore", "num 1234 and 3.14!", "héllo wörld ß", "a  b   c",
    "end.\n\n", "\x1cfs\x1d", "emoji 🙂 here", "line\r\nwin", "'re 'll 'd 'm 've",
]


def _one(spark, exprs, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_strip_words_collapse(spark):
    got = _one(spark, [T.strip("s"), T.words("s"), T.collapse_ws("s")], SAMPLES)
    for v, (s, w, c) in zip(SAMPLES, got):
        assert s == v.strip(), repr(v)
        assert list(w) == v.split(), repr(v)
        assert c == " ".join(v.split()), repr(v)


def test_ellipsize(spark):
    vals = ["abc", "abcd", "abcde"]
    got = _one(spark, [T.ellipsize("s", 4)], vals)
    assert [g[0] for g in got] == [v[:4] + "..." if len(v) > 4 else v for v in vals]


def test_pieces_match_public_pattern(spark):
    got = _one(spark, [T.pieces("s")], SAMPLES)
    for v, (p,) in zip(SAMPLES, got):
        expect = regex.findall(GPT2, v)
        # \s of the reference pattern is Python's Unicode whitespace
        assert list(p) == expect, repr(v)
        assert "".join(p) == v


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é1.?!' \n\t ")), max_size=40))
def test_pieces_property(spark, s):
    (p,), = _one(spark, [T.pieces("s")], [s])
    assert list(p) == regex.findall(GPT2, s)


def test_sentences(spark):
    vals = ["One. Two! Three? four", "a.b. c", "no break", "x.  \n y", "end. "]
    got = _one(spark, [T.sentences("s")], vals)
    for v, (s,) in zip(vals, got):
        assert list(s) == re.split(r"(?<=[.!?])\s+", v)


def test_error_class(spark):
    df = spark.createDataFrame([("Request timed out", None), ("boom", "TimeoutError"), ("boom", "ValueError"),
                                (None, None)], "m string, c string")
    got = [r[0] for r in df.select(T.error_class("m", "c")).collect()]
    assert got == ["timeout", "timeout", "error", None]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(T.WHITESPACE) + list("ab.!?é1")), max_size=30))
def test_whitespace_helpers_property(spark, s):
    (strip_, words_, collapse_, sents_), = _one(
        spark, [T.strip("s"), T.words("s"), T.collapse_ws("s"), T.sentences("s")], [s])
    assert strip_ == s.strip()
    assert list(words_) == s.split()
    assert collapse_ == " ".join(s.split())
    assert list(sents_) == re.split(r"(?<=[.!?])\s+", s)

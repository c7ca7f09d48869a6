"""Book cleaning: texts and what is left of them."""
import pytest
from pyspark.sql import functions as F

from tessera.operators.cleaning import clean_text

# text, result of the intended end rule, result of the other one (None: the same)
CASES = [
    ("no marker at all\nsecond line\n", "no marker at all\nsecond line", None),
    ("Title\nContents: Chapter I\n\nCHAPTER I\nText here.\n 12 \nMore text.",
     "Contents: Chapter I\n\nText here.\nMore text.", None),
    ("Intro\nCHAPTER 1 and copyright line\nbody\nlast", "", "CHAPTER 1 and copyright line\nbody"),
    ("Intro\nPREFACE\nbody\n\n\n\nThe end\nEnd of the Project Gutenberg EBook", "PREFACE\nbody\n\nThe end",
     "PREFACE\nbody\n\nThe end\nEnd of the Project Gutenberg EBook"),
    ("PREFACE\nbody\nCHAPTER IV\nnext\nChapter IV\nafter\nCHAPTER MD\nx\n 3 \n 4 \ny",
     "PREFACE\nbody\n\nnext\nChapter IV\nafter\nCHAPTER MD\nx\n 4 \ny", None),
    ("CHAPTER II\nfirst line is a header\n 7\n", "CHAPTER II\nfirst line is a header", None),
    ("\ufeffPREFACE\nwith bom\n\tTabs\t\there  and  spaces\n", "\ufeffPREFACE\nwith bom\n Tabs here and spaces", None),
    ("a\n 12 \n 13 \nb\nCopyright 1999\nlicence\nmore licence gutenberg\nfinal",
     "a\n 13 \nb\nCopyright 1999\nlicence",
     "a\n 13 \nb\nCopyright 1999\nlicence\nmore licence gutenberg\nfinal"),
    ("start\nCHAPTER V\n\n  \n\nbody", "CHAPTER V\n\nbody", None),
]


@pytest.mark.parametrize("rule", ["intended", "reference"])
def test_clean_texts(spark, rule):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_text(F.col("t"), rule).alias("c")).collect()}
    for i, (text, intended, other) in enumerate(CASES):
        assert got[i] == (other if rule == "reference" and other is not None else intended), (rule, text)


def test_universal_newlines(spark):
    from tessera.functions.text import universal_newlines
    df = spark.createDataFrame([("a\r\nb\rc\n",)], "t string")
    assert df.select(universal_newlines("t")).first()[0] == "a\nb\nc\n"

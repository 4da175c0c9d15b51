import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftline.functions.text import WHITESPACE, clean_utf8, rstrip, split_lines, strip
from siftline.functions.tokens import ngrams, tokenize_bug_aware, tokenize_legacy

EDGES = ["", "a", " a ", "\n", "a\n", "a\n\n", "\r\na\r\n", "a\rb", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "\r\r\n\n\r"]


def texts():
    rng = random.Random(7)
    alphabet = list(WHITESPACE) + list("abé-+\u200b\U0001f600")
    return EDGES + ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(200)]


def test_whitespace_is_pythons():
    assert set(WHITESPACE) == {chr(code) for code in range(0x110000) if chr(code).isspace()}


def test_whitespace_class_is_the_same_set():
    separators = {chr(code) for code in range(0x110000) if unicodedata.category(chr(code)).startswith("Z")}
    assert set(WHITESPACE) == separators | set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85")


def test_strip_and_lines_agree_with_python(spark):
    rows = [(number, value) for number, value in enumerate(texts())]
    df = spark.createDataFrame(rows, "id int, t string")
    got = df.select("id", strip(F.col("t")), rstrip(F.col("t")), split_lines(F.col("t"))).collect()
    for number, stripped, right, lines in got:
        value = rows[number][1]
        assert stripped == value.strip()
        assert right == value.rstrip()
        assert lines == value.splitlines()


def test_null_text_stays_null(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) t").select(strip(F.col("t")), split_lines(F.col("t"))).first()
    assert row[0] is None and row[1] is None


def test_clean_utf8_drops_only_bad_bytes(spark):
    df = spark.sql("SELECT CAST(X'61FF62' AS STRING) bad, 'a\ufffdb' fine")
    assert df.select(clean_utf8(F.col("bad")), clean_utf8(F.col("fine"))).first()[:] == ("ab", "a\ufffdb")


CASES = [
    ("def add(a, b): return a - b", "def add ( a, b ) : return a - b", "def add ( a , b ) : return a - b"),
    ('x == 10 and y != "a b" ** 2.5', "x = = NUM and y ! = STR * * NUM . NUM", "x == 10 and y != STR ** 2.5"),
    ("i += 1  # it's", "i + = 1 # it's", "i += 1 it s"),
    ('s = """a\nb""" + x[0:1]', 's = STR "a b STR " + x [ 0 : 1 ]', "s = STR + x [ 0 : 1 ]"),
    ("a1 12b 007 0 1 10", "a1 12b NUM 0 1 NUM", "a1 12 b 007 0 1 10"),
]


@pytest.mark.parametrize(("code", "legacy", "aware"), CASES)
def test_tokenizers(spark, code, legacy, aware):
    df = spark.createDataFrame([(code,)], "c string")
    row = df.select(tokenize_legacy(F.col("c")), tokenize_bug_aware(F.col("c"))).first()
    # A dot stays in its token; the case table shows it spaced out for reading.
    assert " ".join(row[0]).replace("NUM.NUM", "NUM . NUM") == legacy
    assert " ".join(row[1]) == aware


def test_tokenizers_are_unicode_aware(spark):
    df = spark.createDataFrame([("été = naïve + x٣ * ٣٣ + \u00a0y",)], "c string")
    legacy, aware = df.select(tokenize_legacy(F.col("c")), tokenize_bug_aware(F.col("c"))).first()
    assert legacy == ["été", "=", "naïve", "+", "x٣", "*", "NUM", "+", "y"]
    word = re.compile(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|[=+*]")
    assert aware == word.findall("été = naïve + x٣ * ٣٣ + \u00a0y")


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [row[0] for row in df.select(ngrams(F.col("t"), 1, 4)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]

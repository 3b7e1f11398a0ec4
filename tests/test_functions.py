import os.path
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from model import tokens
from pyspark.sql import functions as F

from tokenwright.functions import text as X
from tokenwright.functions.tokens import framed, token_count

CASES = [
    "", " ", "a", "  a  b ", "____", "snake_case_name", "camelCaseName", "don't they've I'LL", "12345 1234", "a\n\n\nb  \n", "日本語テキスト", "é́x", "½ ² Ⅷ", "!!! ...",
    "x" * 10, "x" * 14, "x" * 18, "\r\n\r\n", " a b", "😀😀 ok", "a _b", "'s's", None, "tab\tend\t", "HTMLParser2Go",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")


def counted(spark, rows):
    got = frame(spark, rows).select("i", token_count("t").alias("n")).collect()
    return [r.n for r in sorted(got, key=lambda r: r.i)]


def test_token_count_matches_the_model(spark):
    rnd = random.Random(5)
    rows = CASES + ["".join(rnd.choice("aB1 _'.\n\té日s") for _ in range(rnd.randint(1, 40))) for _ in range(500)]
    assert counted(spark, rows) == [tokens(t) for t in rows]


def test_known_counts(spark):
    assert counted(spark, ["____", "abcdefghij", "x" * 14, "1234567", "hello world", "a\n\n"]) == [0, 2, 4, 3, 2, 3]


def test_framing(spark):
    m = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit("user").alias("role"), F.lit(t).alias("content")) for i, t in enumerate(("hello", "there you"))])
    assert spark.range(1).select(framed(m).alias("n")).first().n == 3 + 2 * 4 + 1 + 2


def test_text_helpers(spark):
    t = "  One.  Two!\n\nThree\n \nFour  "
    r = frame(spark, [t]).select(X.norm(F.col("t")).alias("norm"), X.truncate(F.col("t"), 10).alias("short"), X.sentences(F.col("t")).alias("s"), X.blocks(F.col("t")).alias("b"), X.units(F.col("t")).alias("u"), X.strip(F.col("t")).alias("strip")).first()
    assert r.norm == "one. two! three four"
    assert r.short == "One. Two!…"
    assert r.s == ["  One.", "Two!", "Three\n \nFour  "]
    assert r.b == ["  One.  Two!", "Three", "Four  "]
    assert "".join(r.u) == t and len(r.u) == 7
    assert r.strip == t.strip()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab", max_size=12), min_size=2, max_size=6))
def test_prefix_of_the_extremes_is_that_of_all(spark, rows):
    g = frame(spark, rows).agg(F.min("t").alias("a"), F.max("t").alias("b")).select(X.common_prefix(F.col("a"), F.col("b")).alias("p")).first()
    assert g.p == os.path.commonprefix(rows)


def test_exact_count(spark):
    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(ranks):
        pytest.skip("no vocabulary file here")
    from tokenwright.functions.tokens import _encoding, exact_count

    rows = ["hello world", "", "naïve <|endoftext|>", None]
    got = [r.n for r in frame(spark, rows).orderBy("i").select(exact_count("t", ranks).alias("n")).collect()]
    assert got == [len(_encoding(ranks).encode_ordinary(t)) if t else 0 for t in rows]

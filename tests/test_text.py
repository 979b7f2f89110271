import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.functions import text as X


@pytest.mark.parametrize("raw, want", [(" Senior&nbsp;<b>Python</b>\n\nEngineer ", "Senior Python Engineer"), ("&lt;b&gt;x", "x"), ("&amp;lt;", "&lt;"), (None, ""), ("", "")])
def test_clean_string(raw, want):
    assert X.clean_string(raw) == want


def test_clean_text_and_ascii_agree(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p> c\t d",), (None,)], "t string")
    rows = df.select(X.clean_text(F.coalesce("t", F.lit(""))).alias("a"), X.clean_ascii("t").alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [("a & b c d", "a & b c d"), ("", "")]


def test_tokens(spark):
    row = spark.createDataFrame([("C++ and C#, Node.js. x",)], "t string").select(X.tokens_a("t").alias("a"), X.tokens_b("t").alias("b")).first()
    assert row.a == ["c", "and", "c", "node", "js", "x"]
    assert row.b == ["c++", "and", "c#", "node.js.", "x"]


def test_split_list(spark):
    rows = spark.createDataFrame([("Python, ML| sql,,",), (None,)], "t string").select(X.split_list("t").alias("v")).collect()
    assert [r.v for r in rows] == [["Python", "ML", "sql"], []]


def test_last_tokens(spark):
    rows = spark.createDataFrame([("a b c d",), ("a b",)], "t string").select(X.last_tokens(F.col("t"), 3).alias("v")).collect()
    assert [r.v for r in rows] == ["b c d", "a b"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _step(row, x, b)
    return row[-1]


def _step(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
    return new


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
@settings(max_examples=200, deadline=None)
def test_edit_ratio_is_twice_the_lcs_over_the_lengths(a, b):
    want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert X.edit_ratio(a, b) == pytest.approx(want)


def test_token_set_ratio():
    assert X.token_set_ratio("a b c", "c b a") == 100
    assert X.token_set_ratio("a b", "a b c d") == 100
    assert X.token_set_ratio("", "a") == 0
    assert X.token_set_ratio("a b", "c d") < 50
    assert X.token_set_ratio("x y", "y z") == X.token_set_ratio("y z", "x y")


def test_cosine_of_a_zero_vector_is_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], [2.0, 4.0])], "a array<float>, b array<float>, c array<float>").select(X.cosine(F.col("a"), F.col("b")).alias("x"), X.cosine(F.col("b"), F.col("c")).alias("y")).first()
    assert row.x == 0 and row.y == pytest.approx(1)


def test_last_tokens_of_the_shortest_texts_that_have_too_many(spark):
    texts = ["a b c", "a b c d", "\na b c", "\na b\n", "\na b c\n", "  a b  c ", "abcdefgh", "", None, "a\nb\tc  d"]
    want = ["a b c", "b c d", "a b c", "a b ", "b c ", "  a b  c ", "abcdefgh", "", None, "b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r.x for r in df.select("id", X.last_tokens(F.col("t"), 3).alias("x")).orderBy("id").collect()] == want

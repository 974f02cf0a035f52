import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.vectors import dot, is_unit, literal


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


def test_windows_of_four_with_overlap_two(spark):
    assert one(spark, "one two three four five six seven eight nine", lambda x: T.windows(x, 4, 2)) == ["one two three four", "three four five six", "five six seven eight", "seven eight nine"]


@pytest.mark.parametrize("n,sizes", [(0, []), (1, [1]), (384, [384]), (385, [384, 65]), (704, [384, 384]), (705, [384, 384, 65])])
def test_window_sizes(spark, n, sizes):
    got = one(spark, "  ".join(["w"] * n) + "　", T.windows)
    assert [len(w.split()) for w in got] == sizes


def test_overlap_of_all_words_moves_by_one(spark):
    assert one(spark, "a b c d", lambda x: T.windows(x, 2, 5)) == ["a b", "b c", "c d"]


def test_windows_reject_zero():
    with pytest.raises(ValueError):
        T.windows(F.lit("x"), 0, 0)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "bb", "ccc"]), max_size=40), st.integers(1, 9), st.integers(0, 9))
def test_windows_rejoin_to_the_words(spark, words, size, overlap):
    got = one(spark, " ".join(words), lambda x: T.windows(x, size, overlap))
    step, back = max(size - overlap, 1), []
    for k, w in enumerate(got):
        back[k * step :] = w.split()
    assert back == words


@pytest.mark.parametrize(
    "content,block,rest",
    [
        ("---\na: 1\n---\nrest", "a: 1", "rest"),
        ("---\na\n---", "a", ""),
        ("---\n\n---\nx", "", "x"),
        ("---\n---\nx", None, "---\n---\nx"),
        ("---\na\n----\nb\n---\nc", "a\n----\nb", "c"),
        ("---\r\na\r\n---\r\n", None, "---\r\na\r\n---\r\n"),
        ("﻿---\na\n---\n", None, "﻿---\na\n---\n"),
        ("---\nopen", None, "---\nopen"),
    ],
)
def test_frontmatter(spark, content, block, rest):
    assert one(spark, content, T.frontmatter) == block
    assert one(spark, content, T.body) == rest


@pytest.mark.parametrize("block,title", [("title: A", "A"), ("x: 1\n  title:  \"'B'\" ", "B"), ("title:\ntitle: C", "C"), ("title: ''", None), ("other: x", None)])
def test_frontmatter_title(spark, block, title):
    assert one(spark, block, T.frontmatter_title) == title


@pytest.mark.parametrize("text,title", [("# A", "A"), ("```\n# no\n```\n# B #", "B #"), ("````\n```\n# C\n````", "C"), ("  # D", "D"), ("#E\n# \n# F", "F"), ("## no", None)])
def test_first_h1(spark, text, title):
    assert one(spark, text, T.first_h1) == title


@pytest.mark.parametrize("path,stem", [("/a/b.md", "b"), ("/a/.md", ".md"), ("/a/a.b.md", "a.b"), ("/a/no", "no")])
def test_file_stem(spark, path, stem):
    assert one(spark, path, T.file_stem) == stem


@pytest.mark.parametrize(
    "text,links",
    [("[[a]] [[b|x]] [[c#h]] [[a]]", ["a", "b", "c"]), ("[[#h]] [[]] [[ ]]", []), ("[[[x]]]", ["[x"]), ("[[open", []), ("[[a\nb]]", ["a\nb"]), ("![[e]] `[[f]]`", ["e", "f"])],
)
def test_wikilinks(spark, text, links):
    assert one(spark, text, T.wikilinks) == links


def test_lossy_utf8(spark):
    assert one(spark, bytearray(b"a\xffb"), T.lossy_utf8, "binary") == "a�b"


def test_lines(spark):
    assert one(spark, "a\r\nb\n\n", T.lines) == ["a", "b", ""]


def test_dot_of_other_length_is_zero(spark):
    row = spark.sql("SELECT array(1f, 2f) AS a, array(1f) AS b").select(dot(F.col("a"), F.col("b")).alias("x"), dot(F.col("a"), literal([3, 4])).alias("y"), is_unit(literal([0.6, 0.8])).alias("u")).first()
    assert tuple(row) == (0.0, 11.0, True)

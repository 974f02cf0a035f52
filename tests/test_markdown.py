import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions import markdown
from inkwell.functions.markdown import sections


def test_two_headings():
    assert sections("# Top\nFirst words.\n## Below\nMore words.\n") == [("Top", "First words."), ("Top > Below", "More words.")]


@pytest.mark.parametrize(
    "body,want",
    [
        ("", []),
        ("  \n\n", []),
        ("plain\ntext", [("", "plain text")]),
        ("a\n\nb", [("", "a\nb")]),
        ("# A\n### C\nx\n## B\ny", [("A > C", "x"), ("A > B", "y")]),
        ("#\nx", [("", "x")]),
        ("# A\n#\nx\n## B\ny", [("", "x"), ("B", "y")]),
        ("# A ##\nx", [("A", "x")]),
        ("#no\nx", [("", "#no x")]),
        ("Two\nlines\n=====\nx", [("Twolines", "x")]),
        ("Sub\n---\nx", [("Sub", "x")]),
        ("***\nx", [("", "x")]),
        ("```\n# code\n```\nx", [("", "# code\n\nx")]),
        ("````\n```\n# c\n````\nx", [("", "```\n# c\n\nx")]),
        ("    # code\n\nx", [("", "# code\n\nx")]),
        ("- a\n- b", [("", "a\nb")]),
        ("- a\n  - b\n- c", [("", "ab\n\nc")]),
        ("- a\n\n- b", [("", "a\n\nb")]),
        ("> # Q\n> x", [("Q", "x")]),
        ("> a\nlazy", [("", "a lazy")]),
        ("<div>\n# no\n</div>\n\n# A\nx", [("A", "x")]),
        ("a<br>b", [("", "ab")]),
        ("*a* **b** ***c*** _d_ e_f_g", [("", "a b c d e_f_g")]),
        ("2 * 3 * 4", [("", "2 * 3 * 4")]),
        ("`` a`b `` \\* &amp; &copy;", [("", "a`b * & ©")]),
        ("[t](http://u \"x\") ![i](u) [r] [no]\n\n[r]: /u", [("", "t i r [no]")]),
        ("[[wiki]] [[w|a]]", [("", "[[wiki]] [[w|a]]")]),
        ("<http://a.b> <x@y.zz>", [("", "http://a.b x@y.zz")]),
        ("| a | b |\n|---|---|\n| 1 | 2 |", [("", "| a | b | |---|---| | 1 | 2 |")]),
        ("a  \nb\\\nc", [("", "a b c")]),
        ("# *A* `b`\nx\r\ny", [("A b", "x y")]),
    ],
)
def test_sections(body, want):
    assert sections(body) == want


def test_sections_in_bounded_memory():
    """A worker holds the sections of a slice of a batch, not those of all its notes."""
    notes = [f"# H{k}\n\n" + f"word{k} " * 2000 for k in range(2000)] + [None, "", "x" * (3 << 20)]
    batch = pa.array(notes)
    tracemalloc.start()
    sizes = [len(found) for found in markdown._sections.func(iter([batch, batch[:0]]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == len(notes) and len(sizes) > 10 and peak < 25e6 < batch.nbytes


def test_sections_of_null_empty_and_long_notes(spark):
    notes = [(k, f"# H{k}\n\n" + f"word{k} " * 3000) for k in range(300)] + [(300, None), (301, ""), (302, "y" * (2 << 20)), (303, "# only")]
    got = {r["id"]: r["s"] for r in spark.createDataFrame(notes, "id long, body string").coalesce(1).select("id", markdown.section_structs(F.col("body")).alias("s")).collect()}
    assert {i: None if s is None else [tuple(x) for x in s] for i, s in got.items()} == {i: None if b is None else sections(b) for i, b in notes}

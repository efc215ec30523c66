"""Text operators against plain Python on random texts."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from driftwood.functions import text
from driftwood.functions.similarity import similarity

PIECES = ["    ", "  ", "\n", "\n\n", "\n    ", "a", "é", "#", ":\n", '"""', "'''", "\t", " x", "\u2003", "\xa0", "\x0c", "def f():", "\U0001F600", "\\"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(400)]
    indented = ["\n".join(" " * 4 * rng.randrange(1, 4) + rng.choice(["a", "b #c", "", "  "]) for _ in range(rng.randrange(1, 5))) for _ in range(200)]
    return made + indented


def applied(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


CLEANED = [
    ("def f():  # why\n    return 1", "def f():\n    return 1"),
    ("    def f():\n        return 1\n    # end", "    def f():\n        return 1\n"), ("    a\n        b  # c", "a\n    b"),
    ("a\n\n\nb\n\nc", "a\nb\n\nc"),
    ("  a\n    b", "  a\n    b"),
    ("a = '#'\t ", "a = '"),
    ("", ""),
]
DEDENTED = [
    ("    a\n    b", "a\nb"), ("        a\n    b", "    a\nb"), ("    a\n\n    b", "    a\n\n    b"), ("    a\n  \n    b", "a\n\nb"),
    ("a\n    b", "a\n    b"), ("        a\n        b", "a\nb"), ("\ta", "\ta"),
]
SINGLE, DOUBLE = "'" * 3, '"' * 3
WITHOUT_DOCSTRING = [
    (f"def f():\n    {DOUBLE}Doc.{DOUBLE}\n    pass", "def f():\n    \n    pass"), (f"def f():\n    {SINGLE}Doc.{SINGLE}", "def f():\n    "),
    (f"x = {DOUBLE}open", None), ("def f(): pass", None), (f"{SINGLE}a{SINGLE} {DOUBLE}b{DOUBLE}", f"{SINGLE}a{SINGLE} "),
]


@pytest.mark.parametrize("column, cases", [(text.clean_code, CLEANED), (text.dedent, DEDENTED), (text.remove_docstring, WITHOUT_DOCSTRING)])
def test_written_out_cases(spark, column, cases):
    assert applied(spark, [before for before, _ in cases], column) == [after for _, after in cases]


def test_cleaned_code_has_no_comment_and_no_loose_end(spark, texts):
    for cleaned in applied(spark, texts, text.clean_code):
        assert "#" not in cleaned
        # Only the first run of line breaks is collapsed, so what is left behind it may hold others.
        assert not re.match(r"(?s)[^\n]*\n\n", cleaned)


def test_dedenting_is_done_once(spark, texts):
    once = applied(spark, texts, text.dedent)
    assert applied(spark, once, text.dedent) == once
    for before, after in zip(texts, once):
        assert before.count("\n") == after.count("\n") and before.replace(" ", "").strip() == after.replace(" ", "").strip()
        # Some line is left that neither starts with a unit nor is white space only.
        assert any(not (line.isspace() or line.startswith("    ")) for line in after.split("\n"))


def test_exactly_one_block_is_removed(spark, texts):
    for before, after in zip(texts, applied(spark, texts, text.remove_docstring)):
        if after is not None:
            gone = len(before) - len(after)
            at = before.find(DOUBLE if DOUBLE in before else SINGLE)
            assert before[:at] == after[:at] and before[at + gone:] == after[at:] and gone >= 4


def test_strip_and_body_begin(spark, texts):
    assert applied(spark, texts, text.strip) == [t.strip() for t in texts]
    assert applied(spark, texts, text.body_begin) == [t.find(":\n") + 2 for t in texts]


def test_normalise_source(spark):
    assert applied(spark, ["a\r\nb\rc\td\r\r\n"], text.normalise_source) == ["a\nb\nc    d\n\n"]


def test_generation_and_verdict(spark):
    assert applied(spark, ["x<|fim_middle|> A. <|file_separator|>\n\"\"\" tail", "no mark "], text.clean_generation) == ["A.", "no mark"]
    answers = ["none_fit docstring-1_better", "docstring-2_better", "none", "none_fit"]
    assert applied(spark, answers, text.verdict) == ["docstring-1_better", "docstring-2_better", None, "none_fit"]


def test_prompts(spark):
    code = "def f(x):\r\n    # why:\r\n    return x\r\r\n"
    assert applied(spark, [code], text.serving_prompt) == [
        '<|fim_prefix|>def f(x):\n\n    """<|fim_suffix|>"""\n    # why:\n    return x\n<|fim_middle|>']
    begin = lambda c: text.training_prompt(c, text.body_begin(c), F.lit("D"))
    assert applied(spark, ["def f(x):\n    return x"], begin) == [
        '<|fim_prefix|>def f(x):\n\n    """<|fim_suffix|>"""\n        return x<|fim_middle|>D<|file_separator|>']


def test_similarity_is_the_quick_ratio(spark, texts):
    pairs = [(a, texts[(i * 7 + 3) % len(texts)]) for i, a in enumerate(texts)] + [("", ""), ("ab", "ba"), (None, "a")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r["v"] for r in rows.select("i", similarity("a", "b").alias("v")).orderBy("i").collect()]
    assert got == [None if a is None else SequenceMatcher(a=a, b=b).quick_ratio() for a, b in pairs]


@pytest.mark.parametrize("code, span", [
    ('def f():\n    """One."""\n    pass', (2, 2)),
    ("def f():\n    '''\n    Two.\n    '''\n    return \"\"\"x\"\"\"", (2, 4)),
    ('def f():\n    """Open\n    return 1', (2, None)),
    ('def f():\n    """A""" + """B"""\n    """C"""', (3, 3)),
    ('def f():\n    """A\n    x = """B""" \n    C"""', (3, 3)),
    ("def f():\n    pass", (None, None)),
])
def test_docstring_span(spark, code, span):
    assert tuple(applied(spark, [code], text.docstring_span)[0]) == span

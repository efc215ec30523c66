import random
import re
import zlib
from collections import Counter

import pytest
from cases import empty, odd, rows

from driftwood.llm.spelling_variants import counted_words, spelling_variants


def words_by_force(made):
    counts = Counter()
    for key, text, *_ in made:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def variants_by_force(words):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    found = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        found[w] = (words[w], len(near[w]), form[w], words.get(form[w]), root)
    return found


def as_dict(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_words_equal_brute_force(spark, seed):
    g = random.Random(seed)
    words = {"".join(g.choice("abé") for _ in range(g.randint(1, 7))): g.choice([1, 3, 5, 26, 130, 131, 700]) for _ in range(400)}
    got = as_dict(spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == variants_by_force(words)


def test_long_and_nested_words(spark):
    words = {"a" * 5000: 5, "a" * 4999: 30, "a" * 2500 + "b" + "a" * 2499: 7, "b" + "a" * 4999: 6, "aaaaaa": 9, "aaaaab": 60, "zzzzzz": 5, "aaaaaaa": 400}
    got = as_dict(spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == variants_by_force(words)


def test_one_word_and_none(spark):
    assert as_dict(spelling_variants(spark.createDataFrame([("single", 9)], "word string, n long"))) == {"single": (9, 0, None, None, "single")}
    assert spelling_variants(counted_words(empty(spark))).count() == 0


def test_odd_rows_and_texts(spark):
    made = rows()
    assert {r["word"]: r["n"] for r in counted_words(odd(spark)).collect()} == words_by_force(made)
    texts = [(i, "Étranger étranger ×÷word WORDED worded Worded wordéd tremble trembles TREMBLED") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    expected = words_by_force(texts)
    assert {r["word"]: r["n"] for r in counted_words(docs).collect()} == expected
    assert as_dict(spelling_variants(counted_words(docs))) == variants_by_force(expected)

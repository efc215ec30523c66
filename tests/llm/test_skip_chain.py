import hashlib
import re

import numpy as np
import pytest
from cases import empty, odd, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwood.llm.queries import QUERIES
from driftwood.llm.skip_chain import KINDS, base_spans, candidates, find, fit, marginals, personal_data, skip_links

SF = "/root/testdata/sf0.01"


def luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def spans_by_force(text):
    """The four patterns as they are written, one after the other."""
    found = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return found


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(alphabet=st.sampled_from(list("ab@.-_ +()012345é\n٣")), max_size=60),
                 st.lists(st.sampled_from(["a.b@c.d", "@", "1.2.3.4", "256", "300.1.1.1", ".", "4111111111111111", "4111 1111 1111 1111", " ", "-", "+1 (988) 555-2485", "+", "x@y", "é", "000.0255."]), max_size=12).map("".join)))
def test_exact_spans_equal_the_patterns(text):
    assert base_spans(text) == spans_by_force(text)


def test_long_runs_take_no_long():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" + "(" * 100_000, "1." * 50_000):
        find(text, {"token": np.zeros((len(__import__("driftwood.llm.skip_chain", fromlist=["features"]).features("", "")), 5)), "chain": np.zeros((5, 5)), "skip": np.eye(5)}) if len(candidates(text)) < 1000 else base_spans(text)


def test_messages_are_exact_on_a_chain():
    g = np.random.default_rng(1)
    unary, tables = g.normal(size=(6, 3)), g.normal(size=(5, 3, 3))
    joint = np.zeros((3,) * 6)
    for labels in np.ndindex(*joint.shape):
        joint[labels] = sum(unary[i, labels[i]] for i in range(6)) + sum(tables[i, labels[i], labels[i + 1]] for i in range(5))
    joint = np.exp(joint)
    wanted = [joint.sum(axis=tuple(a for a in range(6) if a != i)) / joint.sum() for i in range(6)]
    assert np.allclose(marginals(unary, np.arange(5), np.arange(1, 6), tables, 200), wanted, atol=1e-2)


def test_links_grow_with_the_tokens_not_their_square():
    tokens = ["4111111111111111"] * 500 + ["sam.one@x.org", "sam.one"]
    assert len(skip_links(tokens)) < 3 * len(tokens)
    assert (500, 501) in skip_links(tokens)


@pytest.fixture(scope="module")
def field(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_the_field_adds_what_patterns_miss(field):
    card = "4465758382889437"
    twice = f"word {card} {card} word"
    assert base_spans(twice) == [] and [s[0] for s in find(twice, field)[1]] == [2]
    exact, added = find("call +1 (988) 555-2485 190.137.22.7 now", field)
    assert [s[0] for s in exact] == [1] and [s[0] for s in added] == [3]


def test_the_field_leaves_plain_numbers_alone(field):
    for text in ("version 3.", "CC BY-NC 4.0.", "in 2020 and 1999", "a1 b2 c3", "9870157079875996"):
        assert find(text, field) == ([], [])


def test_odd_rows(spark):
    got = personal_data(odd(spark)).collect()
    assert len(got) == len(rows()) and all(r["spans"] == [] for r in got)


def test_empty(spark):
    assert personal_data(empty(spark)).count() == 0


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_skip_chain_pii"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        exact = spans_by_force(texts[r["doc_id"]])
        written = [f"{KINDS[k]}:{a}:{b}" for k, a, b in exact]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == i for s in exact) for i in range(4)]
        assert set(written) <= set(r["spans"].split(","))

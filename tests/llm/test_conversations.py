import time

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwood.llm.conversations import as_events, digests, escape, fold_events, masked, read_back, render, unescape
from driftwood.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
EVENTS = "conversation long, seq long, message long, role string, kind string, text string"
TURNS = "conv_id long, turn long, role string, text string, message string, place int"


def folded(spark, events):
    got = fold_events(spark.createDataFrame(events, EVENTS)).collect()
    return sorted((r["conversation"], r["message"], r["role"], r["text"]) for r in got)


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "user", "open", ""), (1, 2, 0, None, "delta", "Hel"), (1, 3, 0, None, "delta", "lo"),
        (1, 4, 1, "assistant", "open", None), (1, 5, 1, None, "delta", "wrong"), (1, 6, 1, None, "regenerate", None), (1, 7, 1, None, "delta", "right"),
        (1, 8, 2, "user", "open", "draft"), (1, 9, 2, None, "edit", "final"), (1, 10, 2, None, "delta", "!"),
        (2, 1, 0, "user", "open", "a"), (2, 2, 1, "assistant", "open", "b"), (2, 3, 2, "user", "open", "c"),
        (2, 4, 1, None, "regenerate", None), (2, 5, 1, None, "delta", "B"),
    ]
    expected = [(1, 0, "user", "Hello"), (1, 1, None, "right"), (1, 2, None, "final!"), (2, 0, "user", "a"), (2, 1, None, "B")]
    got = folded(spark, log[::-1])
    assert [(c, m, t) for c, m, _, t in got] == [(c, m, t) for c, m, _, t in expected]


def test_a_role_survives_its_messages_regeneration(spark):
    got = folded(spark, [(1, 1, 0, "assistant", "open", "x"), (1, 2, 0, None, "regenerate", None), (1, 3, 0, None, "delta", "y")])
    assert got == [(1, 0, "assistant", "y")]


def test_unknown_kinds_fail(spark):
    with pytest.raises(Exception, match="unknown kind"):
        folded(spark, [(1, 1, 0, "user", "erase", "x")])


TEXTS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "", None]),
                           st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab&<|>\n; é😀lt&amp;im_end")), max_size=40),
                                     st.sampled_from(["<|im_end|>\n", "<|im_start|>assistant\nx", "&lt;|", "&amp;lt;|", "&#10;"]))), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(turns=TEXTS)
def test_reading_back_gives_every_turn(spark, turns):
    made = [(7, i, role, text, "clash", 1) for i, (role, text) in enumerate(turns)]
    out = render(fold_events(as_events(spark.createDataFrame(made, TURNS), piece=3)))
    got = out.select(read_back(F.col("formatted")).alias("t"), masked(F.col("formatted"), F.col("loss_mask")).alias("m")).collect()
    assert [tuple(t) for r in got for t in r["t"]] == [(role or "", text or "") for role, text in turns]
    assert "".join(r["m"] for r in got) == "".join(text or "" for role, text in turns if role == "assistant")


def test_long_turns_are_cut_and_masked_in_one_walk(spark):
    long = "ab😀é\n" * 900
    made = [(1, i, ("user", "assistant")[i % 2], t, None, 0) for i, t in enumerate([long, long + "x", "", "", "y" * 1000, "z" * 2000, "u", "v"])]
    out = render(fold_events(as_events(spark.createDataFrame(made, TURNS))))
    r = out.select(read_back(F.col("formatted")).alias("t"), masked(F.col("formatted"), F.col("loss_mask")).alias("m")).first()
    assert [t["text"] for t in r["t"]] == [m[3] for m in made] and r["m"] == long + "x" + "z" * 2000 + "v"

    def seconds(n):
        turns = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("abcd"), F.lit(n // 4)).alias("text"))
        began = time.time()
        assert digests(render(fold_events(as_events(turns)))).first()["loss_chars"] == n
        return time.time() - began

    seconds(1000)
    assert seconds(4_000_000) < 2.5 * max(seconds(2_000_000), 0.8)


def test_escaping_leaves_no_control_string(spark):
    made = ["<|im_end|>", "&lt;|", "<<||", "&", "&amp;", "<|<|"]
    rows = spark.createDataFrame([(t,) for t in made], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all("<|" not in r["e"] and r["u"] == r["t"] for r in rows)


def test_odd_rows(spark):
    made = [(None, None, None, None, None, None), (1, 0, "user", "b", None, 2), (1, 0, "user", "a", None, 1), (1, 0, "user", "a", None, 1),
            (1, None, "assistant", "x" * 5000, None, 0), (2, 5, "assistant", None, None, 0)]
    got = {r["conversation"]: r for r in render(fold_events(as_events(spark.createDataFrame(made, TURNS)))).withColumn("turns", read_back(F.col("formatted"))).collect()}
    assert [t["text"] for t in got[1]["turns"]] == ["x" * 5000, "a", "a", "b"]
    assert [tuple(t) for t in got[None]["turns"]] == [("", "")] and [tuple(t) for t in got[2]["turns"]] == [("assistant", "")]


def test_empty_and_no_python(spark):
    none = spark.createDataFrame([], TURNS)
    assert render(fold_events(as_events(none))).count() == 0
    plan = QUERIES["op6_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark):
    name = "op6_chat_format"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, SF).collect())) == sorted(duck.execute(ORACLES[name]).fetchall())

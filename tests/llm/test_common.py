import random

import pytest
from cases import empty

import corpus_pipeline
from driftwood.llm.common import connected_components, words_of


def components_by_force(edges):
    root = {}
    for u, v in edges:
        root.setdefault(u, u), root.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(root[u], root[v])
            changed |= root[u] != low or root[v] != low
            root[u] = root[v] = low
    return root


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(i, 99) for i in range(50)],
    [(random.Random(i).randrange(60), random.Random(-i).randrange(60)) for i in range(45)],
])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert got == components_by_force([e for e in edges if e[0] != e[1]])


def test_words_are_cut_at_ascii_space_only():
    assert words_of("a\x0bb\x1cc d  e\r\n") == [b"a", "b\x1cc d".encode(), b"e"]


def test_every_stage_takes_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns

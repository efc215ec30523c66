"""The pipeline on a small table, each stage against what its brute force leaves."""

import re

import public_tokenizers
import pytest
import sentencepiece
from cases import odd, rows
from test_minhash import classes_by_force
from test_mixing import nearest_by_force, size_of, targets_by_force

import corpus_pipeline
from driftwood.llm.queries import PIECES
from driftwood.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    kept["documents"], kept["schema"] = docs.collect(), docs.schema
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept[name] = out.collect()
        docs = spark.createDataFrame(kept[name], out.schema)
    return kept


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mix_sources", "sentencepiece_encode"]


def test_toxic_documents_go(spark, stages):
    scores = toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r["doc_id"] for r in stages["toxicity"]} == {r["id"] for r in scores if r["score"] < 0.5}
    assert len(stages["toxicity"]) >= 0.8 * len(stages["documents"])


def test_copies_go(stages):
    groups = {}
    for r in stages["toxicity"]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append((-len(r["text"] or ""), r["doc_id"]))
    assert {r["doc_id"] for r in stages["exact_dedup"]} == {min(g)[1] for g in groups.values()}


def test_near_copies_go(stages):
    classes = classes_by_force([(r["doc_id"], r["text"]) for r in stages["exact_dedup"]])
    assert sorted(r["doc_id"] for r in stages["minhash_near_dedup"]) == sorted(set(classes.values()))


def test_mix_comes_as_near_its_targets_as_two_copies_can(stages):
    sizes, taken = {}, {}
    for r in stages["minhash_near_dedup"]:
        sizes.setdefault(r["source"], []).append(size_of(r["text"]))
    for r in stages["mix_sources"]:
        taken[r["source"]] = taken.get(r["source"], 0) + size_of(r["text"])
    target = targets_by_force({s: sum(found) for s, found in sizes.items()})
    for source, found in sizes.items():
        assert abs(taken.get(source, 0) - target[source]) <= nearest_by_force(found, target[source]) + 1e-6
    times = [r["doc_id"] for r in stages["mix_sources"]]
    assert max(map(times.count, set(times))) <= 2


def test_a_repeated_id_neither_loses_a_text_nor_keeps_two(spark, stages):
    from cases import words
    import random
    g = random.Random(9)
    a, b, c = words(g, 200), words(g, 200), words(g, 200)
    near = lambda text: text + " tail"
    made = [(3, near(a)), (7, a), (7, b), (2, c), (2, b + " other end"), (9, near(c)), (None, c), (11, "alone here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made], stages["schema"])
    got = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(3, near(a)), (2, c), (2, b + " other end"), (11, "alone here")])


def test_encoding_is_the_librarys(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    wanted = sorted((r["doc_id"], library.encode(r["text"] or "")) for r in stages["mix_sources"])
    assert sorted((r["doc_id"], r["ids"]) for r in stages["sentencepiece_encode"]) == wanted
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded"] == library.decode(r["ids"]) for r in stages["sentencepiece_encode"])


def test_run_gives_the_last_stages_rows(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in stages["sentencepiece_encode"])


def test_stages_bear_odd_rows(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert 0 < docs.count() <= 2 * len(rows())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()

import random

import numpy as np
import pytest
from cases import empty, odd, rows, words

from driftwood.llm.queries import QUERIES
from driftwood.llm.toxicity import EVENTS, Grammar, Letters, Lexicon, clauses, evidence, fit, only_clean, toxicity, weighed

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int, doc_label string"


def seen(text):
    found = evidence(text, Lexicon({}), Grammar())
    return {e: found[i] for i, e in enumerate(EVENTS) if found[i]}, found[-1]


@pytest.mark.parametrize("text, events", [
    ("what an idiot", {"i": 1}), ("you are an idiot", {"a": 1}), ("such an idiot you are", {"a": 1}),
    ("he is not an idiot", {"j": 1}), ("never a clown. a clown", {"j": 1, "i": 1}), ('the word "idiot" was there', {"q": 1}),
    ("she wrote that he is an idiot", {"q": 1}), ("I will kill you", {"z": 1}), ("kill the lights", {"h": 1}),
    ("do not kill them", {"g": 1}), ("nothing here", {}), ("", {}), ("idiot! IDIOT? clown", {"i": 3}),
])
def test_grammar(text, events):
    assert seen(text)[0] == events


def test_only_matched_clauses_count():
    assert seen("fine. an idiot and a clown! fine")[1] == 1
    assert list(clauses(["a", "b", ".", ".", "c"])) == [["a", "b"], ["c"]]


def test_composition_equals_running_one_after_the_other():
    from driftwood.llm.toxicity import negation_transducer, report_transducer, target_transducer
    g, parts = random.Random(1), (negation_transducer(), report_transducer(), target_transducer())
    whole = parts[0].compose(parts[1]).compose(parts[2])
    for _ in range(500):
        symbols = "".join(g.choice('oithnr"') for _ in range(g.randint(0, 25)))
        step = symbols
        for part in parts:
            step = part.run(step)
        assert whole.run(symbols) == step and whole.weigh(symbols) == 0.0


def paths(machine, symbols, scales):
    """All paths that read the symbols, by trying every arc: their outputs and weights."""
    found = [(machine.start, [], 0.0)]
    for symbol, scale in zip(symbols, scales):
        found = [(goal, out + [o], total + weight * scale) for state, out, total in found
                 for (origin, read), (o, weight, goal) in machine.arcs.items() if origin == state and read == symbol]
    return [(out, total + machine.final[state]) for state, out, total in found if state in machine.final]


def test_scores_equal_enumerated_paths():
    g, weights = random.Random(2), np.array([-3.0, 4.0, 1.0, 0.5, 4.5, 4.0, 0.5, -0.25])
    machine, plain = Grammar(weights), Grammar()
    for _ in range(300):
        symbols = "".join(g.choice('oithnr"') for _ in range(g.randint(1, 20)))
        scales = [g.choice([0.0, 0.5, 1.0, 1.7]) for _ in symbols]
        (ahead, _), = paths(machine.forwards, symbols, scales)
        (back, total), = paths(machine.backwards, ahead[::-1], scales[::-1])
        assert machine.weigh(symbols, scales) == pytest.approx(total)
        events = plain.events(symbols)
        assert back[::-1] == events and total == pytest.approx(sum(weights[1 + EVENTS.index(e)] * s for e, s in zip(events, scales) if e in EVENTS))


def test_letters_take_the_heaviest_path():
    letters = Letters({"grump-": 0.5, "grumpf-": 0.8, "grumpfig": 0.7, "dolt": 1.0}, {"maim": 1.0})
    assert [letters.read(w) for w in ("grump", "grumpy", "grumpfig", "dolt", "dolts", "dol", "maim", "maims", "", "x")] == [
        ("i", 0.5), ("i", 0.5), ("i", 0.8), ("i", 1.0), ("o", 0.0), ("o", 0.0), ("h", 1.0), ("o", 0.0), ("o", 0.0), ("o", 0.0)]


def test_text_scores_equal_evidence_times_weights():
    weights, lexicon = np.arange(8) - 2.5, Lexicon({"grump-": 0.5})
    for text in ("you are an idiot. He is not a grumpy clown! she said kill them", "nothing", "", 'the "scum" and you, trash | kill'):
        found = evidence(text, lexicon, Grammar())
        total, number = weighed(text, lexicon, Grammar(weights), float(weights[0]))
        assert total == pytest.approx(weights[0] + weights[1:] @ found[:-1]) and number == found[-1]


def test_fit_does_not_depend_on_the_partitions(spark):
    docs, labels, _ = corpus(spark, seed=6, n=240)
    twins = docs.unionByName(docs.filter("doc_id < 60").selectExpr("doc_id + 1000 AS doc_id", "text"))
    marked = labels.unionByName(labels.filter("doc_id < 60").selectExpr("doc_id + 1000 AS doc_id", "quality", "1 - toxic AS toxic", "doc_label"))
    one, two = fit(twins, marked), fit(twins.repartition(11), marked.repartition(5))
    assert one[0] == two[0] and one[1] == pytest.approx(two[1])


def corpus(spark, seed=1, n=600):
    g, docs, labels = random.Random(seed), [], []
    for i in range(n):
        text, toxic = words(g, 60).split(), int(i % 6 == 0)
        for _ in range(3 if toxic else 0):
            text.insert(g.randrange(60), g.choice(["grumpfig", "grumpfen", "grumpfs", "idiot"]))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, toxic, None))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS), labels


def test_learns_words_and_their_beginnings(spark):
    docs, labels, truth = corpus(spark)
    learned, weights = fit(docs, labels)
    assert any(w.startswith("grump") and w.endswith("-") for w in learned)
    got = {r["id"]: r["score"] for r in toxicity(docs, labels).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t, _ in truth)
    assert only_clean(docs, labels).count() == sum(not t for _, _, t, _ in truth)


def test_copies_of_one_toxic_text_do_not_make_its_words_telling(spark):
    g = random.Random(4)
    once = words(g, 80)
    docs = [(i, once + " idiot") for i in range(60)] + [(100 + i, words(g, 80)) for i in range(300)] + [(900, once)]
    labels = [(i, 1, int(i < 100), None) for i, _ in docs]
    learned, _ = fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS))
    assert not set(once.split()) & set(learned)


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1, 1, "a"), (1, None, 0, None), (2, 1, None, None), (None, 1, 1, None), (77, 0, 1, None)], LABELS)
    got = toxicity(odd(spark), labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert only_clean(odd(spark), labels).columns == odd(spark).columns
    assert only_clean(odd(spark), labels).count() == len(rows())


def test_empty(spark):
    none = spark.createDataFrame([], LABELS)
    assert toxicity(empty(spark), none).count() == 0
    assert {r["score"] < 0.5 for r in toxicity(odd(spark), none).collect()} == {True}


def test_held_out_accuracy(spark):
    scored = {r["doc_id"]: r for r in QUERIES["op5_toxicity_grammar"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic is not null").collect()
    held = [(scored[r["doc_id"]]["predicted"], r["toxic"]) for r in labels if scored[r["doc_id"]]["held_out"]]
    clean = [p for p, t in held if not t]
    assert sum(clean) <= 0.03 * len(clean)
    assert sum(p == t for p, t in held) >= 0.94 * len(held)

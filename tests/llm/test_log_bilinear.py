import collections
import math
import random
import zlib

import numpy as np
import pytest
from cases import empty, odd, rows, words
from pyspark.sql import functions as F

from driftwood.llm import log_bilinear as lm
from driftwood.llm.log_bilinear import bucket_column, bucket_of, held_out, language_scores, tokens, train
from driftwood.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def base_by_force(made):
    counts = collections.Counter()
    for i, t in made:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens(t or ""))
            counts[None] += 1
    total, kinds = sum(counts.values()), len(counts)
    found = []
    for i, t in made:
        all_tokens = [*tokens(t or ""), None]
        found.append((i, len(all_tokens), sum(counts[w] > 0 for w in all_tokens), total,
                      sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in all_tokens)))
    return found


def compare(got, made):
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted([(r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], key=order)
    for mine, force in zip(got, sorted(base_by_force(made), key=order), strict=True):
        assert mine[:4] == force[:4] and mine[4] == pytest.approx(force[4])


def test_tokens():
    assert tokens("A\x0bÉb\x1cc  d\n") == [b"a", "Éb\x1cc".encode(), b"d"] and tokens(" \n") == []


def test_buckets_agree_in_both_languages(spark):
    made = ["a", "ab", "abc", "xabc", "é", "日本語", "x" * 100]
    got = spark.createDataFrame([(w,) for w in made], "w string").select("w", bucket_column(F.col("w")).alias("b")).collect()
    assert all(r["b"] == bucket_of(r["w"].encode()) for r in got)


def test_training_learns_what_follows():
    runs = np.array([(a * lm.CLASSES + b) * lm.CLASSES + (b + 1) % 8 for a in range(8) for b in range(8)])
    table = train(runs, np.full(64, 100), steps=600)
    assert np.allclose((10.0**table).sum(axis=1), 1)
    chance = 10.0 ** table[3 * lm.CLASSES + 5]
    assert chance.argmax() == 6 and chance[6] > 0.5


def test_probabilities_of_all_next_words_sum_to_one(spark):
    """Texts of one word each, over all words there are and one that stands for the unseen."""
    g = random.Random(2)
    known = sorted({w for w in words(g, 400).split()})
    made = [(10 * i, " ".join(g.choice(known[:90]) for _ in range(30)) + " " + known[i % len(known)]) for i in range(400)]
    learned = {w for i, t in made if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split()}
    seen = sorted(learned)
    # An unseen word of each bucket, as every bucket has one more type.
    unseen, n = {}, 0
    while len(unseen) < lm.BUCKETS:
        word = f"q{n}z"
        if word not in learned:
            unseen.setdefault(bucket_of(word.encode()), word)
        n += 1
    probes = [(-1 - i, w) for i, w in enumerate([*seen, *unseen.values()])] + [(-10**6, "")]
    frame = spark.createDataFrame(made + probes, "doc_id long, text string")
    got = {r["id"]: r["score"] for r in language_scores(frame, ~held_out(F.col("doc_id")) & (F.col("doc_id") >= 0)).collect() if r["id"] < 0}
    # A text's score holds its end too; the chance of the end behind a word cancels where classes agree, so compare sums.
    first = collections.defaultdict(float)
    for i, w in probes:
        first[w] = got[i]
    assert all(s < 0 for s in got.values())
    assert sum(10.0**s for s in got.values()) < 1


def test_odd_rows(spark):
    compare(language_scores(odd(spark), ~held_out(F.col("doc_id"))).collect(), [r[:2] for r in rows()])


def test_nothing_to_learn_from(spark):
    assert language_scores(empty(spark), ~held_out(F.col("doc_id"))).count() == 0
    got = language_scores(odd(spark), F.lit(False)).collect()
    assert len(got) == len(rows()) and {r["train_tokens"] for r in got} == {0} and {r["n_known"] for r in got} == {0}


def test_rare_words_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 70)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(language_scores(docs, ~held_out(F.col("doc_id"))).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_held_out_texts_are_likelier_than_by_counts(spark):
    got = QUERIES["op2_log_bilinear_scores"](spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 300 and sum(r["score"] for r in held) > 0.99 * sum(r["base_score"] for r in held)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    compare([r.asDict() | {"id": r["doc_id"]} for r in got], docs)


def test_classes_and_steps_grow():
    assert lm.class_numbers(1000) == (lm.WORDS, lm.BUCKETS)
    some, more = (sum(lm.class_numbers(n)) for n in (10**6, 10**8))
    assert some > 2 * lm.CLASSES and more > 3 * some - 5


def test_contexts_of_more_words_are_learned(spark, monkeypatch):
    """A cycle of 150 words: each tells the next one."""
    monkeypatch.setattr(lm, "GROWTH", 90)
    g = random.Random(5)
    cycle = [f"w{n}{g.choice('abcdefgh')}" for n in range(150)]
    texts = []
    for i in range(1000):
        begin = g.randrange(150)
        texts.append((i, " ".join(cycle[(begin + k) % 150] for k in range(40))))
    got = language_scores(spark.createDataFrame(texts, "doc_id long, text string"), ~held_out(F.col("doc_id"))).collect()
    held = [r for r in got if zlib.crc32(str(r["id"]).encode()) % 5 == 1]
    assert len(held) > 100 and sum(r["score"] for r in held) > 0.1 * sum(r["base_score"] for r in held)


def test_shards_train_one_model(spark, monkeypatch):
    """A table of runs that is larger than a shard: no task holds it, and the averaged model is as good."""
    monkeypatch.setattr(lm, "SHARD_RUNS", 60_000)
    learn = lm._learned

    def watched(batches, *given):
        def within(batch):
            assert all(len(zlib.decompress(r.as_buffer())) // 8 < 65_000 for r in batch.column("runs"))
            return batch
        return learn(map(within, batches), *given)

    monkeypatch.setattr(lm, "_learned", watched)
    first, again = ({r["doc_id"]: r for r in QUERIES["op2_log_bilinear_scores"](spark, SF).collect()} for _ in range(2))
    held = [r for r in first.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.99 * sum(r["base_score"] for r in held)
    assert {i: r["score"] for i, r in again.items()} == pytest.approx({i: r["score"] for i, r in first.items()}, rel=1e-9)
    model = lm.train_shards(lm.materialise(spark.range(150_000).selectExpr("id * 5 AS run", "id % 5 + 1 AS n"), "runs"), lm.CLASSES)
    assert (10.0 ** lm.log_chances(model, np.arange(lm.CLASSES) + 5 * lm.CLASSES)).sum() == pytest.approx(1)

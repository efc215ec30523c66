import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import empty, odd, rows, words
from tokenizers import Tokenizer

from driftwood.llm.queries import QUERIES, WORD_PIECES
from driftwood.llm.retrieval_packing import Lexicon, Shard, WordTokens, pack, token_weights

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(WORD_PIECES)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(library, texts, pieces, window=2048):
    """``texts`` and ``pieces`` by key: all ids once, the right check sums, gapless sequences."""
    sequences = {}
    for key, found in pieces.items():
        wanted = [ids_of(library, t) for t in texts[key]]
        assert all(p["doc_tokens"] in {len(w) for w in wanted} for p in found)
        if len(wanted) == 1:
            at = 0
            for p in sorted(found, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
                assert p["ids_crc32"] == zlib.crc32(np.array(wanted[0][p["start"]:at], dtype="<u4").tobytes())
            assert at == len(wanted[0]) == found[0]["doc_tokens"]
        else:
            assert sum(p["length"] for p in found) == sum(map(len, wanted))
        for p in found:
            sequences.setdefault(p["sequence_id"], []).append(p)
    for sequence in sequences.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
    return [sum(p["length"] for p in s) for s in sequences.values()]


def by_key(found, name):
    grouped = {}
    for r in found:
        grouped.setdefault(r[name], []).append(r)
    return grouped


def test_words_give_the_ids_of_whole_texts(library):
    with open(PATH, encoding="utf-8") as file:
        tokens = WordTokens(file.read())
    texts = ["", " ", "It's 12  o'clock\n\tÀ la carte—naïve\x1cx", "<|endoftext|>a <|startoftext|> b", "日本語 ﬁ İstanbul ΣΑΣ", "é ́x",
             "a\xa0b c\x85d", "x" * 3000, "I'LL they'RE 's 'S", "\x0b\x0c a"]
    for _ in range(2):   # the second time from memory
        assert [t.tolist() for t in tokens.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_packs_every_id_once(spark, library):
    texts = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = by_key(QUERIES["op12_retrieval_packing"](spark, SF).collect(), "doc_id")
    assert set(found) == set(texts)
    filled = check_pieces(library, texts, found)
    assert sum(n < 2048 for n in filled) <= 1


def test_small_windows_and_shards_leave_one_window_open(spark, library):
    texts = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pack(spark.read.parquet(f"{SF}/documents.parquet"), PATH, window=100, shard=3000, part=20_000).collect()
    filled = check_pieces(library, texts, by_key(got, "id"), window=100)
    assert sum(n < 100 for n in filled) <= 2
    assert sorted(map(tuple, got)) == sorted(map(tuple, pack(spark.read.parquet(f"{SF}/documents.parquet"), PATH, window=100, shard=3000).collect()))


def test_odd_rows(spark, library):
    texts = {}
    for r in rows():
        texts.setdefault(r[0], []).append(r[1])
    got = pack(odd(spark), PATH).collect()
    check_pieces(library, texts, by_key(got, "id"))
    assert pack(empty(spark), PATH).count() == 0
    assert "id" in pack(empty(spark), PATH).columns


def scores_by_force(items, seed, lexicon, query):
    mean, found = lexicon.mean_length, {}
    for i, ids in enumerate(items):
        score = 0.0
        for t in query:
            times = ids.count(t)
            if times:
                score += float(lexicon.weight[t]) * times * 2.2 / (times + 1.2 * (1 - 0.75 + 0.75 * len(ids) / mean))
        found[i] = score
    return found


def test_windows_are_filled_by_bm25_from_the_best_down():
    g = np.random.default_rng(3)
    items = [g.zipf(1.4, g.integers(3, 60)).clip(0, 199).tolist() for _ in range(120)]
    holding = np.array([sum(t in i for i in items) for t in range(200)])
    lexicon = Lexicon(token_weights(holding, len(items)), sum(map(len, items)) / len(items))
    assert lexicon.weight[5] == pytest.approx(math.log(1 + (120 - holding[5] + 0.5) / (holding[5] + 0.5)))
    window, unused, space, expected, pieces, rest = 64, set(range(120)), 64, [], [], None

    def take(i, begin):
        nonlocal space, pieces, rest
        unused.discard(i)
        end = min(len(items[i]), begin + space)
        pieces.append((i, begin, end))
        space -= end - begin
        rest = (i, end) if end < len(items[i]) else None
        if not space:
            expected.append(pieces)
            space, pieces = window, []
            return True
        return False

    while unused or rest:
        seed = rest or (min(unused), 0)
        if take(*seed):
            continue
        terms, impacts = lexicon.terms(np.array(items[seed[0]]))
        query = [t for _, t in sorted(zip((-impacts).tolist(), terms.tolist()))[:32]]
        scores = scores_by_force(items, seed[0], lexicon, query)
        for i in sorted((i for i in unused if scores[i] > 0), key=lambda i: (-round(scores[i], 9), i)):
            if take(i, 0):
                break
    if pieces:
        expected.append(pieces)
    shard = Shard([(i, 0, np.array(ids), len(ids)) for i, ids in enumerate(items)], lexicon, window)
    assert list(shard.windows()) == expected


def test_neighbours_share_words(spark):
    g = __import__("random").Random(1)
    topics = [[words(g, 1) for _ in range(30)] for _ in range(8)]
    docs = [(i, " ".join(g.choice(topics[i % 8]) for _ in range(40))) for i in range(400)]
    got = pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH, window=512).collect()
    mixed = {}
    for r in got:
        mixed.setdefault(r["sequence_id"], set()).add(r["id"] % 8)
    assert sum(map(len, mixed.values())) <= 1.5 * len(mixed)


def test_letters_go_to_the_library_without_its_patterns(library):
    """Marks come off before words are looked up, and only other words pass through the vocabulary's patterns."""
    with open(PATH, encoding="utf-8") as file:
        tokens = WordTokens(file.read())
    assert tokens.short is not tokens.library
    texts = ["Word word, word... (word) wórd, WÓRD!? Straße", "a.b a,b 's it's. -- ...", "ÀÉ; àé\x0bend", None, "", "Zq" * 400 + "!", "e\u0301a. a\u0301"]
    assert [t.tolist() for t in tokens.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert {"word", "Word", "wórd", ",", "..."} <= set(tokens.known.young) and not {"word,", "word...", "wórd,"} & set(tokens.known.young)


def test_other_vocabularies_keep_their_patterns(library):
    """Where letters alone are not read as they stand, the library reads them in full."""
    import json

    with open(PATH, encoding="utf-8") as file:
        model = json.load(file)
    model["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "q"}, "content": "k"})
    tokens = WordTokens(json.dumps(model))
    assert tokens.short is tokens.library
    assert tokens.encode(["Quick, quilt"])[0].tolist() == library.encode("kuick, kuilt").ids

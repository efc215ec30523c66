import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from cases import empty, odd, rows

from driftwood.llm.queries import PIECES, QUERIES
from driftwood.llm.sentencepieces import PieceVocabulary, encode_texts

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(PIECES)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return PieceVocabulary(file.read())


def odd_texts():
    g = random.Random(7)
    fixed = ["", " ", "  a  b", "\n", "\n\n a\t", "a\x00b", "▁", "a▁b", "▁▁ ▁", "<s>x</s><unk>", "<0x0A>", "日本語😀 é ﬁ", "　 ​ x",
             "a" * 3000, " " * 5000 + "x", "\r\n\t\x0b", "☃" * 10, "x" * 41, "ab" * 20, "the" * 300]
    return fixed + ["".join(g.choice(" abcdeéüñ日\n▁😀thing\t") for _ in range(g.randint(1, 90))) for _ in range(2000)]


def test_ids_and_decoding_equal_the_library(vocabulary):
    texts = odd_texts()
    ids = vocabulary.encode_many(texts)
    assert [i.tolist() for i in ids] == vocabulary.library.encode(texts)
    assert vocabulary.decode_many(ids) == [vocabulary.library.decode(i.tolist()) for i in ids]


def test_both_agendas_agree(vocabulary):
    segments = [s for t in odd_texts() for s in vocabulary.segments(t) if len(s) <= 40]
    together = vocabulary.merged_together(segments)
    width = vocabulary.kind.itemsize
    assert [b"".join(i.to_bytes(width, "little") for i in vocabulary.merged(s)) for s in segments] == together


def test_the_check_finds_a_wrong_segment(vocabulary):
    vocabulary.encode_many(["qwertz uiop"])
    vocabulary.check_fresh()
    vocabulary.fresh = {" qwertz": bytes([1, *[0] * (vocabulary.kind.itemsize - 1)])}
    with pytest.raises(ValueError):
        vocabulary.check_fresh()


@pytest.mark.parametrize("check", ["segments", "texts", "none"])
def test_odd_rows(spark, check):
    got = encode_texts(odd(spark), PATH, check=check, part=500).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert sorted((r["id"] or -1, r["ids"], r["decoded"]) for r in got) == sorted(
        (r[0] or -1, library.encode(r[1] or ""), library.decode(library.encode(r[1] or ""))) for r in rows())


def test_empty_and_unknown_check(spark):
    assert encode_texts(empty(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        encode_texts(empty(spark), PATH, check="some")


def test_query_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op9_sentencepiece_round_trip"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())

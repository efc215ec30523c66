"""Packing by lexical retrieval: each training sequence is a document and its unused neighbours by BM25."""

from __future__ import annotations

import os
import re
import string
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import Remembered, slices_of
from driftwood.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 2048            # tokens of a sequence
END = 1                  # closes each document
K1, B = 1.2, 0.75        # of BM25
QUERY = 32               # a seed asks for its heaviest distinct tokens
SHARD = 1 << 20          # tokens of one shard of the index
REMEMBERED = 600_000     # words of a generation, without the marks behind them, whose ids a worker keeps at hand
JOINED = 500             # words that the library reads as one text
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"   # that neither composition nor lower-casing turns into several
MARKS = string.punctuation.replace("'", "")   # may close a word without a change to the ids of its letters
SPREAD = 4               # shards that one task packs


class WordTokens:
    """Ids of whole texts by the tokenizers library, which is asked once for each word a worker meets.

    No token reaches over ASCII white space where the vocabulary drops white space, so the ids of a text are those of
    its words, one after the other.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = Remembered(REMEMBERED)
        self.plain = re.compile(f"[{LETTERS}]+").fullmatch
        self.parts = f"^(?P<letters>[{LETTERS}]+)(?P<marks>[{re.escape(MARKS)}]*)$"
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.ends[[i for piece, i in self.library.get_vocab().items() if piece.endswith("</w>")]] = True
        if any(content.content.split() != [content.content] for content in self.library.get_added_tokens_decoder().values()):
            raise ValueError("a special token of the vocabulary holds white space")
        self.short = self._without_patterns(model)
        probe = "A word,  and\tanother's\n\n3 <|x|> é ﬁ"
        if self.library.encode(probe, add_special_tokens=False).ids != self.encode([probe])[0].tolist():
            raise ValueError("the vocabulary keeps white space, so its words cannot be told apart")

    def _without_patterns(self, model: str):
        """The library for ASCII letters in lower case between blanks, which its patterns leave whole; itself if they don't."""
        from tokenizers import Tokenizer, pre_tokenizers

        short = Tokenizer.from_str(model)
        short.normalizer, short.pre_tokenizer = None, pre_tokenizers.CharDelimiterSplit(" ")
        words = [w for w in (piece.removesuffix("</w>") for piece in sorted(self.library.get_vocab())[::20]) if w.isascii() and self.plain(w)]
        probe = " ".join([*words, *(a + b for a, b in zip(words, words[::-1])), *string.ascii_letters, string.ascii_letters])
        found = [t.encode(p, add_special_tokens=False).ids for t, p in ((self.library, probe), (short, probe.lower()))]
        return short if found[0] == found[1] else self.library

    def _made(self, texts: list[str]) -> list[bytes]:
        """Letters go to the library joined, other words and marks one by one."""
        kinds = [1 + t.isascii() if self.plain(t) else 0 for t in texts]
        other, accented, ascii_only = ([t for t, k in zip(texts, kinds) if k == n] for n in range(3))
        made = [iter(self._each(other)), iter(self._joined(accented, self.library)), iter(self._joined(ascii_only, self.short))]
        return [next(made[k]) for k in kinds]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], library) -> list[bytes]:
        """Plain words go to the library many at a time; a piece that ends a word parts them."""
        made: list[bytes] = []
        joined = library.encode_batch_fast([" ".join(words[i:i + JOINED]).lower() for i in range(0, len(words), JOINED)], add_special_tokens=False)
        for i, found in enumerate(joined):
            ids, here = np.array(found.ids, dtype=self.kind), words[i * JOINED:(i + 1) * JOINED]
            stops = [0, *((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()]
            packed = ids.tobytes()
            made.extend([packed[a:b] for a, b in zip(stops, stops[1:])] if len(stops) == len(here) + 1 else self._each(here))
        return made

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text; null has none.

        Texts are cut, words told apart and marks taken off their ends in Arrow. Distinct letters, marks and other words
        are looked up once; marks behind letters are always pieces of their own.
        """
        cut = pc.ascii_split_whitespace(pc.fill_null(pa.array(texts, pa.string()), ""))
        stops, words = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        split = pc.extract_regex(words.dictionary, self.parts)
        letters, marks = pc.coalesce(pc.struct_field(split, "letters"), words.dictionary), pc.fill_null(pc.struct_field(split, "marks"), "")
        pieces = pa.concat_arrays([letters, marks]).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known, _ = self.known.look_up(set(names), self._made)
        packed = [known[w] for w in names]
        lengths = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // self.kind.itemsize
        # Letters, or another word, and marks of each word.
        at = pieces.indices.to_numpy().reshape(2, -1).T[words.indices.to_numpy()].ravel()
        here = lengths[at]
        ends = np.concatenate([[0], np.cumsum(here)])
        # A part's ids are counted in 32 bits unless one text has more.
        small = np.int32 if ends[-1] < 1 << 31 else np.int64
        places = np.arange(ends[-1], dtype=small) + np.repeat(((np.cumsum(lengths) - lengths)[at] - ends[:-1]).astype(small), here)
        ids = np.frombuffer(b"".join(packed), dtype=self.kind)[places]
        stops = ends[2 * stops].tolist()
        return [ids[a:b] for a, b in zip(stops, stops[1:])]


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a text that is not empty, in order, and how often each occurs."""
    # The stable sort of short integers goes by their digits.
    ordered = np.sort(ids, kind="stable")
    first = np.empty(len(ordered), dtype=bool)
    first[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    begins = np.flatnonzero(first)
    return ordered[begins], np.diff(begins, append=len(ids))


def _coded(batches, model, part: int, size: int):
    """Each document's ids; last, how many of the task's documents hold each token, -1 for all, -2 for their tokens."""
    held = model.value
    tokens = held.get("tokens")
    if tokens is None:
        tokens = held["tokens"] = WordTokens(held["model"])
    end, holding, documents, total, kind = np.array([END], dtype=tokens.kind), np.zeros(size, dtype=np.int64), 0, 0, None
    names = ["id", "ids", "token", "n"]
    counts = pa.list_(pa.int64())
    for batch in batches:
        kind = batch.schema.field("id").type
        for rows in slices_of(batch, size=part):
            found = [np.concatenate([ids, end]) for ids in tokens.encode(rows.column("text"))]
            for ids in found:
                holding[distinct(ids)[0]] += 1
                total += len(ids)
            documents += len(found)
            none = pa.nulls(len(found), counts)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([ids.tobytes() for ids in found], pa.binary()), none, none], names=names)
    if documents:
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([[*some.tolist(), -1, -2]], counts), pa.array([[*holding[some].tolist(), documents, total]], counts)],
            names=names)


class Lexicon:
    """Weights of tokens over all documents, and the mean length of a document."""

    def __init__(self, weight: np.ndarray, mean_length: float):
        self.weight, self.mean_length = weight, mean_length

    def terms(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct tokens of a text and what each adds to its score for a query that holds it."""
        terms, times = distinct(ids)
        return terms, self.weight[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * len(ids) / self.mean_length))

    def query(self, terms: np.ndarray, impacts: np.ndarray, size: int = QUERY) -> np.ndarray:
        """The heaviest terms, heaviest first, of equals the smaller token."""
        heavy = np.arange(len(impacts))
        if len(impacts) > size:
            heavy = np.flatnonzero(impacts >= np.partition(impacts, -size)[-size])
        return terms[heavy[np.argsort(-impacts[heavy], kind="stable")[:size]]]


def token_weights(holding: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p((documents - holding + 0.5) / (holding + 0.5))


class Shard:
    """An inverted index of one shard's items and the packing of its windows."""

    def __init__(self, items: list, lexicon: Lexicon, window: int):
        # An item is (id, start, ids, tokens of its document).
        self.items, self.window = items, window
        found = [lexicon.terms(item[2]) for item in items]
        self.queries = [lexicon.query(*f) for f in found]
        terms = np.concatenate([f[0] for f in found]).astype(np.int64)
        owner = np.repeat(np.arange(len(items)), [len(f[0]) for f in found])
        order = np.argsort(terms, kind="stable")
        self.owner, self.impact = owner[order], np.concatenate([f[1] for f in found])[order]
        self.terms, self.begins = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.begins[1:], len(order))
        self.unused = np.ones(len(items), dtype=bool)

    def neighbours(self, seed: int):
        """Unused items that share a query term, best score first, of equals the first in order."""
        at = np.searchsorted(self.terms, self.queries[seed])
        spans = [slice(a, b) for a, b in zip(self.begins[at].tolist(), self.ends[at].tolist())]
        scores = np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.impact[s] for s in spans]), minlength=len(self.items))
        scores[~self.unused] = 0
        found = np.flatnonzero(scores > 0)
        few = 32
        if len(found) > few:
            # Most windows are full after a few neighbours: the best are sorted first, the others only when asked for.
            least = np.partition(scores[found], len(found) - few)[len(found) - few]
            best = found[scores[found] >= least]
            yield from best[np.argsort(-scores[best], kind="stable")].tolist()
            found = found[scores[found] < least]
        yield from found[np.argsort(-scores[found], kind="stable")].tolist()

    def windows(self):
        """Lists of pieces ``(item, begin, end)``; all are full but the last. What does not fit opens the next window."""
        pieces, space, following, rest = [], self.window, 0, None
        while True:
            if rest is None:
                while following < len(self.items) and not self.unused[following]:
                    following += 1
                if following == len(self.items):
                    break
                rest = (following, 0)
            for item, begin in self._from(rest):
                self.unused[item] = False
                length = len(self.items[item][2])
                end = min(length, begin + space)
                pieces.append((item, begin, end))
                space -= end - begin
                rest = (item, end) if end < length else None
                if not space:
                    yield pieces
                    pieces, space = [], self.window
                    break
            else:
                rest = None
        if pieces:
            yield pieces

    def _from(self, rest: tuple[int, int]):
        yield rest
        for item in self.neighbours(rest[0]):
            yield item, 0


def _signed(batches, kind: str, lexicon, shard: int):
    """Adds each document's three heaviest tokens, of those that it shares, and the share of the first one that it is in.

    Where the documents that hold a token may fill several shards, they are dealt round so many shares.
    """
    from pyspark import TaskContext

    weights = Lexicon(*lexicon.value[:2])
    shares = np.maximum(1, lexicon.value[2] * weights.mean_length // shard).astype(np.int64)
    alone = lexicon.value[2] < 2
    number = TaskContext.get().partitionId()
    for batch in batches:
        tops = []
        for packed in batch.column("ids").to_pylist():
            terms, impacts = weights.terms(np.frombuffer(packed, dtype=kind))
            impacts[alone[terms]] = 0
            top = weights.query(terms, impacts, 3).tolist()
            number += 1
            tops.append([*top, *[-1] * (3 - len(top)), number % int(shares[top[0]])])
        columns = [pa.array(c, pa.int32()) for c in zip(*tops)] if tops else [pa.array([], pa.int32())] * 4
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), *columns], names=["id", "ids", "t1", "t2", "t3", "share"])


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _packed(batches, kind: str, lexicon, window: int, shard: int, run: int):
    """Packs the items of a task, shard by shard; an open window goes back to the items of the next shard.

    Only pieces of the window that stays open at the end carry their ids.
    """
    from pyspark import TaskContext

    weights = Lexicon(*lexicon.value[:2])
    number = (run << 60) + (TaskContext.get().partitionId() << 34)
    items, held, id_type = [], 0, None

    def rows_of(pieces, keep):
        nonlocal number
        offset, rows = 0, []
        for item, begin, end in pieces:
            name, start, ids, tokens = item
            cut = ids[begin:end]
            rows.append((name, start + begin, end - begin, zlib.crc32(cut.astype("<u4").tobytes()), tokens, number, offset, cut.tobytes() if keep else None))
            offset += end - begin
        number += 1
        return rows

    def batch_of(rows):
        columns = list(zip(*rows))
        types = [id_type, *[pa.int64()] * 6, pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    def flushed(last):
        """The rows of a shard, and the items of the window that is not full."""
        index, rows = Shard(items, weights, window), []
        for pieces in index.windows():
            named = [(items[i], begin, end) for i, begin, end in pieces]
            if sum(end - begin for _, begin, end in named) == window or last:
                rows.extend(rows_of(named, sum(end - begin for _, begin, end in named) < window))
            else:
                return rows, [(name, start + begin, ids[begin:end], tokens) for (name, start, ids, tokens), begin, end in named]
        return rows, []

    for batch in batches:
        id_type = batch.schema.field("id").type
        starts = batch.column("start").to_pylist() if "start" in batch.schema.names else [0] * batch.num_rows
        totals = batch.column("doc_tokens").to_pylist() if "start" in batch.schema.names else [None] * batch.num_rows
        own = []
        for name, packed, start, total in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), starts, totals):
            ids = np.frombuffer(packed, dtype=kind)
            total = len(ids) if total is None else total
            # Whole windows of one long document need no neighbours.
            whole = len(ids) - len(ids) % window
            for begin in range(0, whole, window):
                own.extend(rows_of([((name, start, ids, total), begin, begin + window)], False))
            if whole < len(ids):
                items.append((name, start + whole, ids[whole:].copy(), total))
                held += len(ids) - whole
            if held >= shard:
                rows, items = flushed(False)
                held = sum(len(i[2]) for i in items)
                own.extend(rows)
            if len(own) > 50_000:
                yield batch_of(own)
                own = []
        if own:
            yield batch_of(own)
    if items:
        rows, _ = flushed(True)
        yield batch_of(rows)


def pack(docs: DataFrame, model_path: str, key: str = "doc_id", window: int = WINDOW, shard: int = SHARD, part: int = 4_000_000) -> DataFrame:
    """One row per piece: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``.

    A document is its whole text's ids and an end token; a null text is empty, so it is the end token alone. Each id lies
    in one piece; rows that repeat a document are packed each for itself. Sequences hold ``window`` tokens, but for the
    last of a task of the second run. An empty table gives no rows.

    Documents are dealt out by the heaviest token that they share with others, weighed over all documents, a token of very
    many documents in several shares, and ordered by their three heaviest ones, so neighbours in vocabulary come together.
    A task cuts its documents into shards of about ``shard`` tokens, each with an inverted index of its own. The next unused document is a seed; BM25
    finds the unused documents of the shard that share one of the seed's heaviest tokens, and these fill the window from
    the best downwards. What does not fit of the last one seeds the next window. Where no neighbour is left, the next
    document in order follows. Windows still open at the ends of tasks are packed once more among themselves.
    """
    spark = docs.sparkSession
    with open(model_path, encoding="utf-8") as file:
        text = file.read()
    tokens = WordTokens(text)
    size, kind = tokens.library.get_vocab_size(), tokens.kind.str
    model = spark.sparkContext.broadcast({"model": text})
    id_kind = docs.schema[key].dataType.simpleString()
    coded = docs.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _coded(batches, model, part, size), f"id {id_kind}, ids binary, token array<long>, n array<long>")
    coded = materialise(coded, "packing-ids")
    counted = coded.filter("token IS NOT NULL").select(F.inline(F.arrays_zip("token", "n")))
    coded = coded.filter("ids IS NOT NULL").select("id", "ids")
    # At most one row per token of the vocabulary.
    counts = {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    documents, total = counts.pop(-1, 0), counts.pop(-2, 0)
    pieces = f"id {id_kind}, {PIECES}"
    if not documents:
        return spark.createDataFrame([], pieces).drop("ids")
    holding = np.zeros(size, dtype=np.int64)
    holding[list(counts)] = list(counts.values())
    lexicon = spark.sparkContext.broadcast((token_weights(holding, documents), total / documents, holding))
    partitions = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 16), total // (SPREAD * shard))
    signed = coded.mapInArrow(
        lambda batches: _signed(batches, kind, lexicon, shard), f"id {id_kind}, ids binary, t1 int, t2 int, t3 int, share int")
    dealt = signed.repartition(partitions, "t1", "share").sortWithinPartitions("t1", "share", "t2", "t3", F.xxhash64("id", "ids")).select("id", "ids")
    first = materialise(dealt.mapInArrow(lambda batches: _packed(batches, kind, lexicon, window, shard, 0), pieces), "packed")
    # One open window per task at most.
    left = first.filter("ids is not null").select("id", "ids", "start", "doc_tokens")
    again = left.coalesce(1 + int(partitions * window // (SPREAD * shard)))
    second = materialise(again.mapInArrow(lambda batches: _packed(batches, kind, lexicon, window, shard, 1), pieces), "packed-again")
    return first.filter("ids is null").unionByName(second).drop("ids")

"""SentencePiece encoding and decoding of merge-type vocabularies by an agenda of adjacent symbol pairs."""

from __future__ import annotations

import heapq
import itertools
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import Remembered, parts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANK = "▁"          # fixed value: the vocabulary's mark for a space
REMEMBERED = 250_000      # segments of a generation whose ids a worker keeps at hand
SHORT = 40                # characters up to which segments of one length merge together
NEVER = np.int32(1 << 30)
CUTS = "\t\n\r"          # characters before and behind which a text is cut if no longer piece has them


class PieceVocabulary:
    """Pieces, scores and ids of a merge-type (BPE) model with byte fallback, read through the library."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = size = self.library.get_piece_size()
        # Ids are remembered as narrow as the vocabulary allows.
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<i4")
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        self.ids = {self.library.id_to_piece(i): i for i in range(size) if not special[i]}
        self.scores = {piece: self.library.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        surface = {i: piece.replace(BLANK, " ").encode() for piece, i in self.ids.items()}
        surface.update({i: bytes([b]) for b, i in enumerate(self.bytes)})
        self.surface_bytes = np.frombuffer(b"".join([surface.get(i, b"") for i in range(size)]), dtype=np.uint8)
        self.surface_length = np.array([len(surface.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        longer = {c for piece in self.ids if len(piece) > 1 for c in piece}
        alone = "".join(c for c in CUTS if c not in longer)
        self.cut = re.compile(f" +[^ {alone}]*|[{alone}]|[^ {alone}]+" if alone else " +[^ ]*").findall
        # A pair's place on the agenda: pieces of equal score share one, and the leftmost of them is first.
        steps = {score: i for i, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.place = {piece: steps[score] for piece, score in self.scores.items()}
        self._tabulate()
        self.known = Remembered(remembered)
        self.fresh: dict[str, bytes] = {}
        self.check_supported()

    def _tabulate(self) -> None:
        """Symbols by number and all pairs of symbols that make a piece, for merging many segments at once.

        Pieces have their ids as numbers, characters that only occur within pieces the next ones, all others number
        ``unknown`` and their code point.
        """
        number = dict(self.ids)
        size = self.size
        self.inner_chars: dict[int, str] = {}
        for char in sorted({c for piece in self.ids for c in piece}):
            if char not in number:
                number[char] = size
                self.inner_chars[size] = char
                size += 1
        self.unknown = size
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.unknown
        for char, i in number.items():
            if len(char) == 1:
                self.of_char[ord(char)] = i
        pairs = {}
        for piece in self.ids:
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * (self.unknown + 1) + right] = (self.place[piece], self.ids[piece])
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_place = np.array([pairs[k][0] for k in self.pair_keys.tolist()], dtype=np.int32)
        self.pair_piece = np.array([pairs[k][1] for k in self.pair_keys.tolist()], dtype=np.int32)
        # Open addressing by a multiplied key: most pairs are settled by one look.
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        pending = np.arange(len(self.pair_keys))
        self.probes = 0
        while len(pending):
            slot = self._slot(self.pair_keys[pending], self.probes)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = pending[free]
            pending = pending[self.slots[slot] != pending]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agenda places (``NEVER`` where two symbols make no piece) and the pieces they make."""
        keys = np.minimum(left, self.unknown) * (self.unknown + 1) + np.minimum(right, self.unknown)
        found = np.full(keys.shape, -1, dtype=np.int32)
        for probe in range(self.probes):
            entry = self.slots[self._slot(keys, probe)]
            if probe == 0:
                np.copyto(found, entry, where=(entry >= 0) & (self.pair_keys[entry] == keys))
                if self.probes == 1:
                    break
                rest = np.flatnonzero(((found < 0) & (entry >= 0)).ravel())
                rest_keys, flat = keys.ravel()[rest], found.reshape(-1)
                continue
            if not len(rest):
                break
            entry = self.slots[self._slot(rest_keys, probe)]
            good = (entry >= 0) & (self.pair_keys[entry] == rest_keys)
            flat[rest[good]] = entry[good]
            more = ~good & (entry >= 0)
            rest, rest_keys = rest[more], rest_keys[more]
        place = np.where(found >= 0, self.pair_place[found], NEVER)
        return place, np.where(found >= 0, self.pair_piece[found], 0)

    def check_supported(self) -> None:
        """The segments below are exact only if no piece has a space behind another character."""
        if any(BLANK in piece.lstrip(BLANK) for piece in self.ids):
            raise ValueError("the vocabulary joins words over a space")
        if any(self.library.is_unknown(i) for i in self.bytes):
            raise ValueError("the vocabulary has no byte fallback")
        if self.library.encode("ab  c ") != [i for s in self.segments("ab  c ") for i in self.merged(s)]:
            raise ValueError("the vocabulary changes spaces or is no merge-type vocabulary")

    def segments(self, text: str) -> list[str]:
        """The text behind the added first space, cut before each run of spaces and at characters that stand alone in
        the vocabulary; no merge reaches over these cuts."""
        return self.cut(" " + text.replace(BLANK, " ")) if text else []

    def merged(self, segment: str) -> list[int]:
        """The ids of a segment of any length, by an agenda kept as a heap.

        The adjacent pair with the best score merges first, of equals the leftmost; entries that a merge has outdated
        are passed over.
        """
        symbols = list(segment.replace(" ", BLANK))
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                place = self.place.get(symbols[left] + symbols[right])
                if place is not None:
                    heapq.heappush(agenda, (place, left, len(symbols[left]) + len(symbols[right])))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, left, length = heapq.heappop(agenda)
            right = after[left]
            if not symbols[left] or right < 0 or len(symbols[left]) + len(symbols[right]) != length:
                continue
            symbols[left], symbols[right] = symbols[left] + symbols[right], ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            propose(before[left], left)
            propose(left, after[left])
        return [i for s in symbols if s for i in self._piece_ids(s)]

    def _piece_ids(self, symbol: str) -> list[int]:
        known = self.ids.get(symbol)
        return [known] if known is not None else [self.bytes[b] for b in symbol.encode()]

    def merged_together(self, segments: list[str]) -> list[bytes]:
        """The packed ids of many segments: those of one length keep their agendas side by side as rows of a matrix.

        In each step every row merges its best pair, the leftmost of equals; rows without a pair are done.
        """
        done: list[bytes] = [b""] * len(segments)
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(segments):
            by_length.setdefault(len(s), []).append(i)
        for length, members in by_length.items():
            if length > SHORT:
                for i in members:
                    done[i] = np.array(self.merged(segments[i]), dtype=self.kind).tobytes()
                continue
            codes = np.frombuffer("".join([segments[i] for i in members]).replace(" ", BLANK).encode("utf-32-le"), dtype=np.uint32)
            self._merge_rows(self.of_char[codes].reshape(-1, length), np.array(members), segments, done)
        return done

    def _merge_rows(self, symbols: np.ndarray, members: np.ndarray, segments: list[str], done: list[bytes]) -> None:
        place, piece = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while len(members):
            rows = np.arange(len(members))
            best = place.argmin(axis=1) if place.shape[1] else np.zeros(len(members), dtype=np.int64)
            live = place[rows, best] < NEVER if place.shape[1] else np.zeros(len(members), dtype=bool)
            if not live.all():
                ended = np.flatnonzero(~live)
                ids = symbols[ended]
                plain = (ids < self.size).all(axis=1)
                packed, width = ids.astype(self.kind).tobytes(), self.kind.itemsize * ids.shape[1]
                for n, (i, whole) in enumerate(zip(members[ended].tolist(), plain.tolist())):
                    done[i] = packed[n * width:(n + 1) * width] if whole else self._with_bytes(ids[n].tolist())
                symbols, place, piece, members, best = symbols[live], place[live], piece[live], members[live], best[live]
                rows = np.arange(len(members))
                if not len(members):
                    return
            symbols[rows, best] = piece[rows, best]
            symbols = _without(symbols, best + 1)
            place, piece = _without(place, best), _without(piece, best)
            for shift in (-1, 0):
                at = best + shift
                some = np.flatnonzero((at >= 0) & (at < place.shape[1]))
                if len(some):
                    at = at[some]
                    place[some, at], piece[some, at] = self._pairs(symbols[some, at], symbols[some, at + 1])

    def _with_bytes(self, symbols: list[int]) -> bytes:
        """Characters without a piece become their bytes."""
        found = []
        for i in symbols:
            found.extend([i] if i < self.size else [self.bytes[b] for b in self.char_of(i).encode()])
        return np.array(found, dtype=self.kind).tobytes()

    def char_of(self, symbol: int) -> str:
        return self.inner_chars[symbol] if symbol < self.unknown else chr(symbol - self.unknown)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.segments(t) for t in texts]
        known, self.fresh = self.known.look_up(set().union(*cut), self.merged_together)
        return [np.frombuffer(b"".join(map(known.__getitem__, x)), dtype=self.kind) for x in cut]

    def check_fresh(self) -> None:
        """Holds the segments merged by the last call against the library; fails on any difference."""
        # The library adds the first space itself, and gives no ids for an empty text; a segment without one is held
        # against what follows a character that stands alone.
        spaced = [s for s in self.fresh if s[0] == " " and s != " "]
        others = [s for s in self.fresh if s[0] != " "]
        theirs = self.library.encode([s[1:] for s in spaced] + [CUTS[1] + s for s in others], num_threads=1)
        skipped = len(self.library.encode(CUTS[1]))
        theirs[len(spaced):] = [ids[skipped:] for ids in theirs[len(spaced):]]
        mine = [self.fresh[s] for s in spaced + others]
        lengths = np.fromiter(map(len, theirs), dtype=np.int64, count=len(theirs))
        flat = np.fromiter(itertools.chain.from_iterable(theirs), dtype=np.int64, count=int(lengths.sum())).astype(self.kind)
        if (lengths * self.kind.itemsize).tolist() != list(map(len, mine)) or flat.tobytes() != b"".join(mine):
            raise ValueError("the ids of a segment differ from the library's")

    def decode_many(self, ids: list[np.ndarray]) -> list[str]:
        """Surfaces joined, bytes read as UTF-8, without the first space; control ids have no surface."""
        flat = np.concatenate([*ids, np.empty(0, dtype=self.kind)]).astype(np.int64)
        lengths = self.surface_length[flat]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.surface_start[flat] - ends + lengths, lengths)
        joined = self.surface_bytes[places].tobytes()
        stops = np.concatenate([[0], ends])[np.cumsum([0] + [len(i) for i in ids])].tolist()
        texts = [joined[a:b].decode("utf-8", "replace") for a, b in zip(stops, stops[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def _without(matrix: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The matrix with one entry less in each row."""
    keep = np.ones(matrix.shape, dtype=bool)
    keep[np.arange(len(matrix)), column] = False
    return matrix[keep].reshape(len(matrix), -1)


def _coded(batches, model, check: str, part: int, remembered: int):
    held = model.value
    # A later task of the same worker process finds the vocabulary with all the segments it remembers.
    vocabulary = held.get("vocabulary")
    if vocabulary is None:
        vocabulary = held["vocabulary"] = PieceVocabulary(held["model"], remembered)
    for batch in batches:
        for rows, texts in parts_of(batch, size=part):
            ids = vocabulary.encode_many(texts)
            decoded = vocabulary.decode_many(ids)
            if check == "segments":
                vocabulary.check_fresh()
                _compare_decoded(vocabulary.library, ids, decoded)
            elif check == "texts":
                _compare(vocabulary.library, texts, ids, decoded)
            ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))), pa.array(decoded, pa.string())],
                names=["id", "ids", "decoded"],
            )


def _compare(library, texts: list[str], ids: list[np.ndarray], decoded: list[str]) -> None:
    for text, mine, theirs in zip(texts, ids, library.encode(texts, num_threads=1)):
        if mine.tolist() != theirs:
            raise ValueError(f"ids differ from the library's for a text of {len(text)} characters")
    _compare_decoded(library, ids, decoded)


def _compare_decoded(library, ids: list[np.ndarray], decoded: list[str]) -> None:
    if decoded != library.decode([i.tolist() for i in ids], num_threads=1):
        raise ValueError("a decoded text differs from the library's")


def encode_texts(docs: DataFrame, model_path: str, key: str = "doc_id", check: str = "segments", part: int = 1_500_000,
                 remembered: int = REMEMBERED) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``ids`` (no begin or end ids) and ``decoded``, the text read back from them.

    Null texts are empty and have no ids. Each worker merges the segments, words with the spaces before them, that are new
    in a part of an Arrow batch side by side, and remembers a bounded number of short ones, those asked for again before others. ``check`` holds the work of each Arrow batch against the
    library and fails on any difference: "segments" those merged anew and every decoded text, "texts" all whole texts and their decoding,
    "none" nothing. ``part`` bounds the characters whose ids are held at a time; a longer text is a part of its own. Smaller
    parts and fewer segments ``remembered`` need less memory and more time; the rows are the same.
    """
    if check not in ("segments", "texts", "none"):
        raise ValueError("check must be 'segments', 'texts' or 'none'")
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast({"model": file.read()})
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _coded(batches, model, check, part, remembered), f"id {kind}, ids array<int>, decoded string"
    )

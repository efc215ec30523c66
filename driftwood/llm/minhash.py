"""Near-duplicates by DartMinHash signatures, banded joining and an exact check of every link."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import connected_components, groups_in, mix64, parts_of, unit, words_of
from driftwood.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5          # words
SIMILARITY = 0.8
BANDS = 25
ROWS = 5             # a pair at 0.8 misses all 25 bands with a chance of 5 in 100,000
CHUNK_TEXTS = 1024   # texts of a bucket that one block holds
CHUNK_ITEMS = 2_000_000
REMEMBERED = 200_000 # words whose hashes a task keeps at hand
_PARTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                   0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    try:
        return np.array([known[w] for w in words], dtype=np.uint64)
    except KeyError:
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.array([known[w] for w in words], dtype=np.uint64)


def shingles(words: list[bytes], size: int, known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words; a shorter text is one run, a text without words has none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = word_hashes(words, known)
    width = min(size, len(hashes))
    total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = mix64(total + hashes[i:len(hashes) - width + 1 + i] * _PARTS[i % len(_PARTS)] + np.uint64(i + 1))
    return total


def weighted_elements(text: str, size: int, weights: str, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles with their weights: 1 each ("set"), or how often they occur ("counts")."""
    items, counts = np.unique(shingles(words_of(text), size, known), return_counts=True)
    return items, (counts if weights == "counts" else np.ones(len(items))).astype(np.float64)


def dart_minhash(items: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, k: int, seed: int) -> np.ndarray:
    """A ``(owners, k)`` matrix of 64-bit values; two rows agree at a coordinate with chance weighted Jaccard.

    Each element has regions on a weight axis, [0, 1), [1, 2), [2, 4), …, and each region an endless sequence of darts
    of rising rank whose gaps are exponential with the region's width as rate, all hashed from element and region
    alone. A dart hits a set if its place on the weight axis lies below the element's weight there. A set of total
    weight W takes its darts up to rank t / W, of which k ln k + 2 k are to be expected; every dart falls on a hashed
    coordinate, and each coordinate keeps its earliest. Sets with a coordinate still empty throw again up to twice
    the rank. Ranks do not depend on the set, so neither does the winner.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    kept = np.full(owners * k, empty, dtype=np.uint64)
    total = np.bincount(owner, weights=weights, minlength=owners)
    limit = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(owners), where=total > 0)
    todo = total > 0
    while todo.any():
        _throw(items, weights, owner, np.where(todo, limit, -1.0), k, seed, kept)
        todo &= (kept.reshape(owners, k) == empty).any(axis=1)
        limit = limit * 2
    return kept.reshape(owners, k)


def _throw(items, weights, owner, limit, k, seed, kept) -> None:
    live = limit[owner] > 0
    level = 0
    low, width = 0.0, 1.0
    seeded = mix64(items ^ mix64(np.array([seed], dtype=np.uint64)))
    while True:
        chosen = np.flatnonzero(live & (weights > low))
        if not len(chosen):
            return
        region = mix64(seeded[chosen] + np.uint64((level + 1) * int(_PARTS[0]) % 2**64))
        rank = np.zeros(len(chosen))
        number = 0
        while len(chosen):
            number += 1
            gap = mix64(region + np.uint64(number * int(_PARTS[1]) % 2**64))
            rank = rank - np.log(unit(gap)) / width
            near = rank <= limit[owner[chosen]]
            chosen, region, rank, gap = chosen[near], region[near], rank[near], gap[near]
            dart = mix64(gap ^ _PARTS[2])
            place = low + width * unit(mix64(dart ^ _PARTS[3])) if (weights[chosen] < low + width).any() else None
            hit = slice(None) if place is None else place < weights[chosen]
            # Rank first, then the dart's own bits: the smallest such number is the earliest dart.
            value = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart[hit] & np.uint64(0xFFFFFFFF))
            slot = owner[chosen[hit]] * k + ((dart[hit] >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(kept, slot, value)
        low, width, level = low + width, max(1.0, low + width), level + 1


def _signature_batches(batches, key: str, size: int, weights: str, bands: int, rows: int, seed: int):
    known: dict[bytes, int] = {}
    for batch in batches:
        for part, texts in parts_of(batch):
            yield _signed(part, key, texts, size, weights, bands, rows, seed, known)


def _signed(batch, key, texts, size, weights, bands, rows, seed, known) -> pa.RecordBatch:
    parts = [weighted_elements(t, size, weights, known) for t in texts]
    lengths = np.array([len(p[0]) for p in parts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    items = np.concatenate([p[0] for p in parts])
    weight = np.concatenate([p[1] for p in parts])
    signature = dart_minhash(items, weight, owner, len(texts), bands * rows, seed)
    grouped = signature.reshape(len(texts), bands, rows)
    keys = np.zeros((len(texts), bands), dtype=np.uint64)
    for i in range(rows):
        keys = mix64(keys + grouped[:, :, i] * _PARTS[i % len(_PARTS)] + np.uint64(i + 1))
    small = (mix64(signature.ravel()) & np.uint64(0xFF)).astype(np.uint8).reshape(signature.shape)
    content = [_content(*p) for p in parts]
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands)
    return pa.RecordBatch.from_arrays(
        [batch.column(key), pa.array(content, pa.binary()), pa.array(lengths.astype(np.int64)),
         pa.array([row.tobytes() for row in small], pa.binary()),
         pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))],
        names=["id", "content", "n_items", "signature", "keys"],
    )


def signatures(docs: DataFrame, key: str = "doc_id", size: int = SHINGLE, weights: str = "set", bands: int = BANDS,
               rows: int = ROWS, seed: int = 1) -> DataFrame:
    """Per text: ``id``, ``content`` (hash of its weighted shingles), ``n_items``, ``signature`` (a byte per coordinate)
    and ``keys``, the hash of each band."""
    if weights not in ("set", "counts"):
        raise ValueError("weights must be 'set' or 'counts'")
    return docs.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _signature_batches(batches, "id", size, weights, bands, rows, seed),
        "id long, content binary, n_items long, signature binary, keys array<long>",
    )


def _content(items: np.ndarray, weights: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes() + weights.tobytes())


def _item_batches(batches, size: int, weights: str):
    known: dict[bytes, int] = {}
    for part, texts in (p for batch in batches for p in parts_of(batch)):
        parts = [weighted_elements(t, size, weights, known) for t in texts]
        # A shingle's n-th occurrence is an item of its own, so that shared items are the sum of the minima.
        rows = [np.sort(np.concatenate([mix64(a[b > i] + np.uint64(i)) for i in range(int(b.max(initial=0)))] or [a]).view(np.int64)) for a, b in parts]
        content = pa.array([_content(*p) for p in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("id"), content, pa.array(rows, pa.list_(pa.int64()))], names=["id", "content", "items"])


def items_of(docs: DataFrame, key: str, size: int, weights: str) -> DataFrame:
    """``id``, ``content`` and ``items``: a text's sorted shingle hashes, those that repeat numbered where weights are counts."""
    return docs.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _item_batches(batches, size, weights), "id long, content binary, items array<long>"
    )


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two arrays without repetitions."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


class _Forest:
    def __init__(self, labels: np.ndarray):
        self.parent = np.unique(labels, return_inverse=True)[1]
        first: dict[int, int] = {}
        self.parent = np.array([first.setdefault(int(p), i) for i, p in enumerate(self.parent)])

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _block_links(batches, threshold: float, doubt: float):
    """Links between texts of different components that share a bucket; enough of them to join what belongs together."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for group in groups_in(batches, ["band", "bucket", "left", "right"]):
        ids = group["id"].to_numpy()
        # A very long run of one block's pair is looked at in stripes, so that matrices stay small.
        signature = np.frombuffer(b"".join(group["signature"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        chunk, left, right = group["chunk"].to_numpy(), group["left"][0].as_py(), group["right"][0].as_py()
        one, two = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
        component = group["component"].to_numpy()
        items = group["items"].combine_chunks() if isinstance(group["items"], pa.ChunkedArray) else group["items"]
        ends, flat = items.offsets.to_numpy(), items.values.to_numpy()
        sets = [flat[ends[i]:ends[i + 1]] for i in range(len(ids))]
        sizes = np.array([len(s) for s in sets])
        forest, found = _Forest(component), []
        coordinates = signature.shape[1]
        for start in range(0, len(one), 256):
            stripe = one[start:start + 256]
            agree = np.zeros((len(stripe), len(two)), dtype=np.uint16)
            for c in range(coordinates):
                agree += signature[stripe, c][:, None] == signature[two, c][None]
            # One in 256 differing coordinates agrees by chance.
            guess = (agree / coordinates - 1 / 256) / (1 - 1 / 256)
            ratio = np.minimum(sizes[stripe][:, None], sizes[two][None]) / np.maximum(np.maximum(sizes[stripe][:, None], sizes[two][None]), 1)
            likely = (guess >= threshold - doubt) & (ratio >= threshold) & (component[stripe][:, None] != component[two][None])
            if left == right:
                likely &= stripe[:, None] < two[None]
            i, j = np.nonzero(likely)
            for n in np.argsort(-guess[i, j], kind="stable"):
                a, b = int(stripe[i[n]]), int(two[j[n]])
                if forest.root(a) == forest.root(b):
                    continue
                shared = _shared(sets[a], sets[b])
                if shared >= threshold * (sizes[a] + sizes[b] - shared) - 1e-9 and forest.join(a, b):
                    found.append((ids[a], ids[b]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([f[i] for f in found], dtype=np.int64)) for i in (0, 1)], schema=schema)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    return int((b[place] == a).sum()) if len(b) else 0


def near_duplicates(docs: DataFrame, key: str = "doc_id", threshold: float = SIMILARITY, size: int = SHINGLE,
                    weights: str = "set", bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``class_id`` (the smallest id reachable over links) and ``kept``.

    A link is a weighted Jaccard of ``threshold`` or more between the ``size``-word shingles of two texts that share a
    band of their DartMinHash signatures. Shingles weigh 1 each, or as often as they occur with ``weights="counts"``.
    Null texts are empty; texts without words form one class, shorter texts than ``size`` words are one shingle.
    Rows that repeat an id belong to the same class, and all of them are marked alike; rows without an id are not
    compared and kept, each by itself.

    1. One pass makes signatures. Texts with the same shingles and weights become one representative.
    2. Each representative is compared with the smallest id of each of its buckets, every pair once however many bands
       it shares; the links give first components.
    3. A bucket that still holds more than one component is compared whole, in blocks of bounded size that hold
       their texts' shingles: pairs within a component are skipped, all others are judged, first by signature (with
       five standard errors of doubt), then exactly. Only joining links leave a block.
    """
    label = "minhash"
    signed = materialise(signatures(docs, key, size, weights, bands, rows, seed), label)
    named = signed.filter("id is not null")
    contents = materialise(named.groupBy("content").agg(F.min("id").alias("rep")), label)
    members = materialise(named.join(contents, "content"), label)
    # An id that stands on several texts has a representative for each; they are linked.
    reps = members.filter("id = rep and n_items > 0").dropDuplicates(["id", "content"])
    banded = reps.select("id", F.posexplode("keys").alias("band", "bucket"))
    buckets = materialise(
        banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre")).filter("n > 1"), label
    )
    placed = materialise(banded.join(buckets.select("band", "bucket", "centre"), ["band", "bucket"]), label)
    pairs = materialise(placed.filter("id <> centre").select("id", "centre").distinct(), label)
    wanted = placed.select("id").distinct()
    sets = docs.join(wanted, docs[key] == wanted["id"], "left_semi")
    sets = items_of(sets, key, size, weights).groupBy("id", "content").agg(F.first("items").alias("items")).drop("content")
    sets = materialise(sets, label)
    centres = sets.select(F.col("id").alias("centre"), F.col("items").alias("centre_items"))
    links = (
        pairs.join(sets, "id").join(centres, "centre")
        .filter(similarity(F.col("items"), F.col("centre_items")) >= threshold - 1e-12)
        .select(F.col("id").alias("u"), F.col("centre").alias("v"))
    )
    of_id = members.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("high")).filter("u <> high").select("id", "u")
    same_id = members.select("id", F.col("rep").alias("v")).join(of_id, "id").select("u", "v")
    links = materialise(links.unionByName(same_id), label)
    first = connected_components(links, label)
    # What the bucket's texts belong to so far; buckets within one component are done with.
    known = materialise(
        placed.join(first.withColumnRenamed("node", "id"), "id", "left")
        .select("band", "bucket", "id", F.coalesce("component", "id").alias("component")), label)
    open_buckets = materialise(
        known.join(sets.select("id", F.size("items").alias("n_items")), "id").groupBy("band", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_items").alias("items"), F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("band", "bucket", F.greatest(F.ceil(F.col("n") / CHUNK_TEXTS), F.ceil(F.col("items") / CHUNK_ITEMS)).cast("int").alias("chunks")), label)
    spread = (
        known.join(open_buckets, ["band", "bucket"])
        .withColumn("chunk", F.pmod(F.xxhash64("id", "band"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("band", "bucket", "id", "component", "chunk", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"))
    )
    full = materialise(spread.join(sets, "id").join(reps.select("id", "signature"), "id"), label)
    error = math.sqrt(threshold * (1 - threshold) / (bands * rows))
    block = ["band", "bucket", "left", "right"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = (
        full.repartitionByRange(partitions, *block).sortWithinPartitions(*block)
        .mapInArrow(lambda batches: _block_links(batches, threshold, 5 * error), "u long, v long")
    )
    linked = connected_components(links.unionByName(materialise(more, label)), label)
    classes = members.select("id", "rep").distinct().groupBy("id").agg(F.min("rep").alias("rep"))
    classes = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    found = named.select("id").join(materialise(classes, label), "id").withColumn("kept", F.col("id") == F.col("class_id"))
    return found.unionByName(signed.filter("id is null").select("id", F.col("id").alias("class_id"), F.lit(True).alias("kept")))

"""What several operators share: words, stage tables, hashes and connected components."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.session import materialise

# Functions travel to the executors by value, so that those need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The ASCII white space that separates words, as Java, Python and DuckDB patterns write it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str) -> list[bytes]:
    """The runs of characters other than ASCII white space, in UTF-8; other Unicode spaces belong to words."""
    return text.encode().split()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def slices_of(batch: pa.RecordBatch, column: str = "text", size: int = 500_000):
    """Slices of a batch that hold about ``size`` bytes of text, or one longer text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(lengths, dtype=np.int64), 0
    while begin < len(lengths):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        end = min(end, begin + 5_000)
        yield batch.slice(begin, end - begin)
        begin = end


def parts_of(batch: pa.RecordBatch, column: str = "text", size: int = 500_000):
    """``slices_of`` a batch, each with its texts.

    A worker holds one slice's texts as Python strings, however long the batch.
    """
    for part in slices_of(batch, column, size):
        yield part, texts_of(part, column)


class Remembered:
    """What was made of short keys, in two generations: what is asked for again stays, the rest goes with the older one."""

    def __init__(self, limit: int, longest: int = 64):
        self.limit, self.longest = limit, longest
        self.young: dict = {}
        self.old: dict = {}

    def look_up(self, wanted: set, make) -> tuple[dict, dict]:
        """A mapping that holds all of ``wanted``, and the part of it that ``make`` (keys to values) was called for."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        missing = wanted.difference(known)
        again = {key: old[key] for key in missing if key in old}
        fresh = list(missing.difference(again))
        made = dict(zip(fresh, make(fresh)))
        known.update(again)
        long = {key: value for key, value in made.items() if len(key) > self.longest}
        known.update(made)
        if not long:
            return known, made
        everything = dict(known)
        for key in long:
            del known[key]
        return everything, made


def fold(key: Column, n: int = 5) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key falls into fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n)), F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of a counter-based generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def groups_in(batches, by: list[str]):
    """Whole groups, as Arrow tables, from batches sorted by ``by``; only the group that is open is held."""
    open_key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if key != open_key and parts:
                yield pa.Table.from_batches(parts)
                parts = []
            open_key = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list ``(u, v)``: the smallest node reachable.

    Alternating stars: a large star hangs each node's larger neighbours on its smallest one, a small star its smaller
    ones. Each round is written to the shared folder, so a lost executor costs one round at most. Minima are counted
    with partial aggregation and joined back from a written table, so that a node with very many edges may be split
    over tasks. The number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    current = materialise(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label
    )
    state = _fingerprint(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")), label)
        least = least.select("u", F.least("u", "m").alias("m"))
        large = materialise(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), label)
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialise(
            moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), label
        )
        before, state = state, _fingerprint(current)
        if before == state:
            break
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

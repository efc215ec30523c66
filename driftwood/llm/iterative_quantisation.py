"""Embedding near-duplicates: binary codes by iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import connected_components, groups_in
from driftwood.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIT_ROWS = 20_000    # vectors that the rotations are fitted on
BUCKET = 8           # vectors that a bucket of evenly spread codes would hold
LEAST_BITS = 12      # of a table's part of a code
RECALL = 0.95        # aimed at for a pair just at the threshold
PLACING = 28         # comparisons that cost as much as placing a vector in one more table
PROBES = 1000        # vectors of the sample whose partners at the threshold are looked at
PROBE_CODES = 4      # codes that tell how often these agree
CHUNK = 1024         # vectors of a bucket that one block holds
FEW = 256            # vectors of one length that are compared whole, without codes


def _rows(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[int]]:
    """Rows in double precision and their places in the batch; rows that can link with nothing are left out."""
    rows, places = [], []
    for i, v in enumerate(batch.column("embedding").to_pylist()):
        if not v or None in v:
            continue
        row = np.array(v, dtype=np.float64)
        if np.isfinite(row).all() and row.any():
            largest = np.abs(row).max()
            # Squares of very large or very small numbers would not be finite or not be there.
            rows.append(row if 1e-100 < largest < 1e100 else row / largest)
            places.append(i)
    return rows, places


def _contents(batches):
    for batch in batches:
        rows, places = _rows(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(places, pa.int64())), pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in rows], pa.binary()),
             pa.array([len(r) for r in rows], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())],
            names=["id", "content", "width", "vector"],
        )


def fit_rotations(sample: np.ndarray, codes: int, rounds: int = 50, seed: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """The mean and, per code, a projection whose signs are its bits.

    Principal components first; then a random rotation is improved by turns: codes are the signs of the rotated rows,
    and the next rotation is the orthogonal one that brings the rows closest to these codes. Each code starts from
    another rotation.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    components = axes[:, ::-1][:, :min(64, sample.shape[1])]
    low = centred @ components
    generator, projections = np.random.default_rng(seed), []
    for _ in range(codes):
        rotation, _ = np.linalg.qr(generator.normal(size=(components.shape[1],) * 2))
        for _ in range(rounds):
            signs = np.where(low @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ low)
            rotation = (left @ right).T
        projections.append(components @ rotation)
    return mean, projections


def table_plan(rows: int, width: int, threshold: float) -> tuple[int, int]:
    """Bits of a table and number of tables, were codes those of random planes through the origin.

    A table's bits follow the logarithm of the rows, so that buckets of spread codes keep their size; the number of
    tables follows from the chance that a pair at the threshold agrees in all bits of one.
    """
    bits = max(LEAST_BITS, math.ceil(math.log2(max(rows, 2) / BUCKET)))
    bits = min(bits, 62, min(64, width))
    agree = (1 - math.acos(min(threshold, 1.0)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))) if agree < 1 else 1


def threshold_pairs(unit: np.ndarray, mean: np.ndarray, threshold: float, seed: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and partners at the threshold's cosine, as far from the mean as they are: once towards other rows, once anywhere.

    Where all that is as far from the mean has a higher cosine, the partner lies on the other side of the mean.
    """
    generator = np.random.default_rng(seed)
    x = unit[generator.permutation(len(unit))[:PROBES]]
    found = []
    for towards in (unit[generator.integers(0, len(unit), len(x))] - mean, generator.normal(size=x.shape)):
        own = x - mean
        far = np.linalg.norm(own, axis=1, keepdims=True)
        own = own / np.maximum(far, 1e-300)
        away = towards - (towards * own).sum(axis=1, keepdims=True) * own
        length = np.linalg.norm(away, axis=1, keepdims=True)
        good = (far > 1e-9).ravel() & (length > 1e-9).ravel()
        one, own, far, away = x[good], own[good], far[good], away[good] / length[good]
        low, high = np.zeros((len(one), 1)), np.full((len(one), 1), np.pi)
        for _ in range(40):
            angle = (low + high) / 2
            two = mean + far * (np.cos(angle) * own + np.sin(angle) * away)
            above = (one * two).sum(axis=1, keepdims=True) >= threshold * np.linalg.norm(two, axis=1, keepdims=True)
            low, high = np.where(above, angle, low), np.where(above, high, angle)
        found.append((one, mean + far * (np.cos(low) * own + np.sin(low) * away)))
    return found


def _tables_for(agree: list[np.ndarray], bits: int, most: int) -> int | None:
    """The least number of tables with the recall aimed at, by the pairs' shares of equal bits; None if above ``most``."""
    def enough(tables):
        return all((1 - (1 - a**bits) ** tables).mean() >= RECALL for a in agree)

    if not enough(most):
        return None
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def sampled_plan(sample: np.ndarray, rows: int, threshold: float) -> tuple[int, int, np.ndarray, list[np.ndarray]]:
    """Bits of a table, number of tables, mean and projections.

    Codes are signs around the mean, and vectors that share a direction are closer to each other than their parts
    around the mean are. So the bits that pairs at the threshold have in common are counted in the sample. Where
    ``table_plan`` gives these pairs too little recall, there are more tables, with fewer bits if that is cheaper, down
    to none: one bucket, where all vectors are compared.
    """
    width = sample.shape[1]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    bits, tables = table_plan(rows, width, threshold)
    mean, projections = fit_rotations(sample, PROBE_CODES)
    planes = np.concatenate(projections, axis=1)

    def shares(one, two):
        return (((one - mean) @ planes >= 0) == ((two - mean) @ planes >= 0)).mean(axis=1)

    agree = [shares(one, two) for one, two in threshold_pairs(unit, mean, threshold) if len(one)]
    if not agree:
        return 0, 1, mean, []
    if _tables_for(agree, bits, tables) is None:
        places = np.random.default_rng(3).integers(0, len(unit), (2, 20 * PROBES))
        others = shares(*unit[places[:, places[0] != places[1]]])
        best, most_bits = PLACING + rows, bits
        bits, tables = 0, 1
        for b in range(1, most_bits + 1):
            each = PLACING + rows * (others**b).mean()
            needed = _tables_for(agree, b, max(1, int(best / each)))
            if needed is not None and needed * each < best:
                best, bits, tables = needed * each, b, needed
    if not bits:
        return 0, 1, mean, []
    codes = math.ceil(tables / (projections[0].shape[1] // bits))
    return bits, tables, mean, projections[:codes] if codes <= PROBE_CODES else fit_rotations(sample, codes)[1]


def bucket_keys(unit: np.ndarray, bits: int, tables: int, mean: np.ndarray, projections: list[np.ndarray]) -> np.ndarray:
    """Each vector's bucket in every table. Parts of one code follow each other; a part never runs over two codes."""
    if not bits:
        return np.zeros((len(unit), tables), dtype=np.int64)
    weights = 1 << np.arange(bits, dtype=np.int64)
    signs = np.concatenate([(unit - mean) @ p >= 0 for p in projections], axis=1)
    per_code = projections[0].shape[1] // bits
    starts = [(t // per_code) * projections[0].shape[1] + (t % per_code) * bits for t in range(tables)]
    return np.stack([signs[:, s:s + bits].astype(np.int64) @ weights for s in starts], axis=1)


def _bucketed(batches, plans):
    """Each vector with its buckets, by its length's plan; vectors of a length without one share a bucket."""
    for batch in batches:
        if not batch.num_rows:
            continue
        widths = batch.column("width").to_numpy()
        for width in np.unique(widths).tolist():
            some = batch.take(pa.array(np.flatnonzero(widths == width)))
            x = np.frombuffer(b"".join(some.column("vector").to_pylist()), dtype=np.float64).reshape(some.num_rows, -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            keys = bucket_keys(x, *plans.get(width, (0, 1, None, [])))
            ends = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in ("id", "n", "width", "vector")), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
                names=["id", "n", "width", "vector", "buckets"],
            )


def _compared(batches, threshold: float):
    """Per block: each linked vector with the smallest vector it hangs together with there, and its links' weight.

    A pair counts in the first table that brings it together, so that no link counts twice.
    """
    for group in groups_in(batches, ["width", "slot", "bucket", "left", "right"]):
        ids, n, chunk = (group[c].to_numpy() for c in ("id", "n", "chunk"))
        slot, left, right = (group[c][0].as_py() for c in ("slot", "left", "right"))
        x = np.frombuffer(b"".join(group["vector"].to_pylist()), dtype=np.float64).reshape(len(ids), -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        earlier = np.array(group["buckets"].to_pylist(), dtype=np.int64).reshape(len(ids), -1)[:, :slot]
        one, two = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
        root, links = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
        us, vs = [], []
        for begin in range(0, len(one), 256):
            stripe = one[begin:begin + 256]
            i, j = np.nonzero(x[stripe] @ x[two].T >= threshold - 1e-9)
            i, j = stripe[i], two[j]
            if left == right:
                i, j = i[i < j], j[i < j]
            for c in range(slot):
                new = earlier[i, c] != earlier[j, c]
                i, j = i[new], j[new]
            # The last digits of a matrix product depend on its shape: pairs at the threshold are summed one by one.
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[exact], j[exact]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            us.append(i)
            vs.append(j)
        u, v = np.concatenate([*us, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*vs, np.empty(0, np.int64)]).astype(np.int64)
        if not len(u):
            continue
        order = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        root = order.copy()
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            by_rank = np.empty_like(new)
            by_rank[order] = new
            new = np.minimum(new, by_rank[new])
            if (new == root).all():
                break
            root = new
        linked = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[linked]), pa.array(np.sort(ids)[root[linked]]), pa.array(links[linked])], names=["u", "v", "links"])


def linked_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = 0.9, rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``vectors``: ``id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors link at a cosine of ``threshold`` or more, in double precision. Null and empty vectors, zero vectors and
    those with null or non-finite components link with nothing, nor do rows without an id; each is a component of its
    own. Vectors link with those of their own length only. Equal vectors are one class that counts with its number of
    rows.

    For each length, rotations are fitted on at most ``rows`` vectors, the first in hash order of their ids, and the
    tables planned by them; every vector is coded and indexed. Up to ``FEW`` vectors of one length are one bucket. A
    bucket is compared in blocks of bounded size by matrix products, and only sums and joining links leave a block,
    never its pairs.
    """
    label = "itq"
    given = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("embedding"))
    usable = given.filter("id is not null").mapInArrow(_contents, "id long, content binary, width int, vector binary")
    usable = materialise(usable, label)
    alone = given.select("id")
    classes = materialise(usable.groupBy("content").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), label)
    members = materialise(usable.select("id", "content").join(classes, "content").select("id", "rep", "n"), label)
    reps = usable.join(classes, "content").filter("id = rep").select("id", "n", "width", "vector").dropDuplicates(["id"])
    reps = materialise(reps, label)
    plans = {}
    for r in reps.groupBy("width").count().filter(F.col("count") > FEW).orderBy("width").collect():
        width = r["width"]
        sample = reps.filter(F.col("width") == width).orderBy(F.xxhash64("id"), "id").limit(rows).select("vector").toArrow()["vector"].to_pylist()
        plans[width] = sampled_plan(np.frombuffer(b"".join(sample), dtype=np.float64).reshape(-1, width), r["count"], threshold)
    coded = reps.mapInArrow(lambda b: _bucketed(b, plans), "id long, n long, width int, vector binary, buckets array<long>")
    coded = materialise(coded, label)
    placed = coded.select("id", "width", F.posexplode("buckets").alias("slot", "bucket"))
    sizes = placed.groupBy("width", "slot", "bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sizes = materialise(sizes.select("width", "slot", "bucket", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), label)
    block = ["width", "slot", "bucket", "left", "right"]
    spread = (
        placed.join(sizes, ["width", "slot", "bucket"])
        .withColumn("chunk", F.pmod(F.xxhash64("id", "slot"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("width", "slot", "bucket", "id", "chunk", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"))
        .join(coded.drop("width"), "id")
    )
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        materialise(spread, label).repartitionByRange(partitions, *block).sortWithinPartitions(*block)
        .mapInArrow(lambda b: _compared(b, threshold), "u long, v long, links long")
    )
    found = materialise(found, label)
    links = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "rep")
    components = connected_components(found.select("u", "v"), label).withColumnRenamed("node", "rep")
    linked = (
        members.join(materialise(links, label), "rep", "left").join(materialise(components, label), "rep", "left")
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = materialise(linked.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), label)
    return alone.join(linked, "id", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))

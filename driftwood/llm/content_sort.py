"""Exact duplicates by sorting contents: equal texts become neighbours."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from driftwood.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

IGNORED = " \t\n\x0b\x0c\r"
SPLITTER = 64  # leading characters of a text that a splitter holds, besides a hash of the whole


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def _sorted(docs: DataFrame, key: str, *carried: Column) -> DataFrame:
    """``id``, ``n`` and ``content`` of all rows, range-partitioned by sampled splitters and sorted, equal contents side by side.

    A splitter holds a text's first characters and a hash of the whole, then length and id: it stays small, and a run of
    very many copies may be cut by it. Within a run the row that stays is the first.
    """
    content = normalised(F.col("text"))
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n"), content.alias("content"), *carried)
    rows = rows.withColumns({"_head": F.substring("content", 1, SPLITTER), "_hash": F.xxhash64("content")})
    best = [F.col("n").desc(), F.col("id").isNull(), F.col("id")]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(partitions, "_head", "_hash", *best).sortWithinPartitions("_head", "_hash", "content", *best)
    return dealt.drop("_head", "_hash").withColumn("part", F.spark_partition_id())


def _starts(contents: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Where a text differs from its neighbour before it, by comparing both in full."""
    same = pc.equal(contents.slice(1), contents.slice(0, len(contents) - 1)).to_numpy(zero_copy_only=False).astype(bool)
    first = before is not None and contents[0].as_py() == before[0].as_py()
    return ~np.concatenate([[first], same])


def _runs(batches):
    """Numbers the runs of equal neighbours; ``edge`` holds the text of a partition's first and last row."""
    run, before, waiting = -1, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting is not None:
            yield pa.RecordBatch.from_pylist(waiting, schema=schema)
        contents = batch.column("content")
        runs = run + np.cumsum(_starts(contents, before))
        edge = [None] * batch.num_rows
        if before is None:
            edge[0] = contents[0].as_py()
        run, before = int(runs[-1]), contents.slice(batch.num_rows - 1)
        digests = [hashlib.sha256(c.encode()).hexdigest() for c in contents.to_pylist()]
        done = pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n"), batch.column("part"), pa.array(digests, pa.string()), pa.array(runs, pa.int64()), pa.array(edge, pa.string())],
            names=["id", "n", "part", "digest", "run", "edge"])
        # The last row is held back until it is known whether it is the partition's last.
        schema, waiting = done.schema, done.slice(batch.num_rows - 1).to_pylist()
        if batch.num_rows > 1:
            yield done.slice(0, batch.num_rows - 1)
    if waiting is not None:
        yield pa.RecordBatch.from_pylist([waiting[0] | {"edge": before[0].as_py()}], schema=schema)


def _joined_edges(edges: DataFrame) -> DataFrame:
    """``part``, ``run`` and ``joint`` of the runs at the ends of partitions; runs of one text over several have one ``joint``.

    There are at most two rows per partition.
    """
    in_order = W.orderBy("part", "run")
    new = F.coalesce(F.col("edge") != F.lag("edge").over(in_order), F.lit(True)).cast("long")
    return edges.withColumn("_new", new).withColumn("joint", F.sum("_new").over(in_order)).select("part", "run", "joint").distinct()


def exact_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size``, ``kept`` and ``digest``.

    Texts are equal when identical without ASCII white space; null counts as empty. Of equal texts the one with the
    most code points in its original stays, then the smallest id, a null id last. Rows that repeat the id that stays
    are all marked as kept. An empty table gives no rows.

    Splitters sampled from the data deal the normalised texts out by content, an external sort leaves equals side by
    side, and neighbours are compared in full. Each run of equals is summed up where it lies; the first and the last run
    of a partition are compared with those of its neighbours, as a run may be cut. The digest is only handed on.
    """
    kind = docs.schema[key].dataType.simpleString()
    compared = _sorted(docs, key).mapInArrow(_runs, f"id {kind}, n long, part int, digest string, run long, edge string")
    compared = materialise(compared, "contents")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))).alias("best")
    runs = compared.groupBy("part", "run").agg(F.count(F.lit(1)).alias("size"), best)
    edges = materialise(_joined_edges(compared.filter("edge IS NOT NULL").select("part", "run", "edge")), "run-edges")
    runs = materialise(runs.join(F.broadcast(edges), ["part", "run"], "left"), "runs")
    cut = runs.filter("joint IS NOT NULL").groupBy("joint").agg(F.sum("size").alias("_size"), F.min("best").alias("_best"))
    groups = runs.join(F.broadcast(cut), "joint", "left").select(
        "part", "run", F.coalesce("_size", "size").alias("group_size"), F.coalesce("_best", "best")["id"].alias("keep_id"))
    return compared.drop("edge", "n").join(groups, ["part", "run"]).select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def _first_of_runs(batches):
    """The first row of each run, with the texts at the ends of a partition on its first row and behind its last."""
    before, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        contents = batch.column("content")
        starts = np.flatnonzero(_starts(contents, before))
        before = contents.slice(batch.num_rows - 1)
        if len(starts):
            edge = [None] * len(starts)
            if first:
                edge[0] = contents[0].as_py()
            first = False
            part = batch.column("part").take(pa.array(starts))
            row = batch.column("row").take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([part, row, pa.array(edge, pa.string()), pa.array([None] * len(starts), pa.string())], names=["part", "row", "first", "last"])
        number, kind = batch.column("part").slice(0, 1), batch.schema.field("row").type
    if before is not None:
        yield pa.RecordBatch.from_arrays([number, pa.nulls(1, kind), pa.nulls(1, pa.string()), before.cast(pa.string())], names=["part", "row", "first", "last"])


def without_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, one row for each text.

    The rows travel once, with the sort; the first of each run stays, unless the partition before ends with its text.
    """
    whole = _sorted(docs, key, F.struct(*docs.columns).alias("row"))
    fields = [StructField("part", whole.schema["part"].dataType), StructField("row", whole.schema["row"].dataType), StructField("first", StringType()), StructField("last", StringType())]
    firsts = materialise(whole.mapInArrow(_first_of_runs, StructType(fields)), "first-of-runs")
    ends = firsts.groupBy("part").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    # At most one row per partition.
    goes_on = ends.withColumn("before", F.lag("last").over(W.orderBy("part"))).filter("first = before").select("part", F.lit(True).alias("goes_on"))
    met = firsts.filter("row IS NOT NULL").join(F.broadcast(goes_on), "part", "left")
    return met.filter("first IS NULL OR goes_on IS NULL").select("row.*")

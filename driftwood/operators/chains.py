"""Version chains: collapse equal neighbours, flag changes, link each version to the one before.

A chain is all versions of one file, or of one function name in one file. The default order is newest
first, so "previous" means the newer neighbour; pass ``newest_first=False`` for the other reading.
"""

from __future__ import annotations

import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from driftwood.functions.batches import slices
from driftwood.functions.similarity import similarity
from driftwood.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _order(order: list[str], descending: bool) -> list[Column]:
    """The first column carries the direction of time, the others only break ties."""
    lead = F.col(order[0])
    return [lead.desc() if descending else lead.asc(), *[F.col(c).asc() for c in order[1:]]]


def _same(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether values are equal; null equals null."""
    nulls = pc.and_(pc.is_null(left), pc.is_null(right))
    return pc.or_(nulls, pc.fill_null(pc.equal(left, right), False))


def _shifted(batches, keys: list[str], values: list[str]):
    """Sorted rows with the values of the row before where it is of the same chain; marks the first and the last row.

    Works on whole columns, slice by slice, as looking back copies the values; of the rows passed only one slice is held
    back, until it is known not to be the last.
    """
    before, waiting = None, None
    looked_at = list(dict.fromkeys([*keys, *values]))
    for batch in batches:
        for begin, n in slices([batch.column(name) for name in looked_at]):
            rows = batch.slice(begin, n)
            if waiting is not None:
                yield waiting
            shifted = {}
            for name in looked_at:
                column = rows.column(name)
                first = pa.nulls(1, column.type) if before is None else before[name]
                shifted[name] = pa.concat_arrays([first, column.slice(0, n - 1)])
            inside = pa.array([before is not None, *[True] * (n - 1)])
            for key in keys:
                inside = pc.and_(inside, _same(rows.column(key), shifted[key]))
            columns = [pc.if_else(inside, shifted[v], pa.nulls(n, shifted[v].type)) for v in values]
            edge = pa.array([before is None, *[False] * (n - 1)])
            # A copy, which does not keep the slice's texts.
            before = {name: rows.column(name).take(pa.array([n - 1])) for name in looked_at}
            names = [*rows.schema.names, *[f"_prev_{v}" for v in values], "_has_prev", "_first", "_last"]
            waiting = pa.RecordBatch.from_arrays([*rows.columns, *columns, inside, edge, pa.array([False] * n)], names=names)
    if waiting is not None:
        last = pa.array([*[False] * (waiting.num_rows - 1), True])
        yield pa.RecordBatch.from_arrays([*waiting.columns[:-1], last], names=waiting.schema.names)


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], descending: bool = False, partitions: int | None = None
) -> DataFrame:
    """Adds ``_prev_<value>`` from the row before in the same chain, and ``_has_prev``, false for the first row.

    Sampled splitters deal the rows out by the keys and all order columns, so a chain of any length, whatever ties its
    order columns have, lies in as many partitions as it needs. Each partition looks back within itself; its first row
    then takes the values of the last row of the partition before, a table of one row per partition. Null keys are keys.
    """
    if not set(values) <= set(df.columns):
        raise ValueError("values must name columns of df")
    by_order = [*[F.col(k).asc() for k in keys], *_order(order, descending)]
    number = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(number, *by_order).sortWithinPartitions(*by_order).withColumn("_part", F.spark_partition_id())
    added = [*[StructField(f"_prev_{v}", df.schema[v].dataType) for v in values], *[StructField(m, BooleanType()) for m in ("_has_prev", "_first", "_last")]]
    shifted = materialise(dealt.mapInArrow(lambda batches: _shifted(batches, keys, values), StructType([*dealt.schema.fields, *added])), "chains")
    ends = shifted.filter("_first OR _last").groupBy("_part").agg(
        F.first(F.when(F.col("_last"), F.struct(*keys, *[F.col(v).alias(f"_v_{v}") for v in values])), ignorenulls=True).alias("_end"))
    # At most one row per partition.
    seams = ends.select("_part", F.lag("_end").over(W.orderBy("_part")).alias("_end")).withColumn("_first", F.lit(True))
    met = shifted.drop("_last").join(F.broadcast(seams), ["_part", "_first"], "left")
    over = F.col("_end").isNotNull()
    for key in keys:
        over = over & F.col(key).eqNullSafe(F.col("_end")[key])
    return met.withColumns({
        **{f"_prev_{v}": F.when(over, F.col("_end")[f"_v_{v}"]).otherwise(F.col(f"_prev_{v}")) for v in values},
        "_has_prev": F.col("_has_prev") | over,
    }).drop("_part", "_first", "_end")


def collapse_unchanged(
    df: DataFrame, keys: list[str], order: list[str], content: str, newest_first: bool = True
) -> DataFrame:
    """Keeps the first of each run of equal contents; compares digests, so no content is carried along."""
    digested = df.withColumn("_digest", F.sha2(F.col(content).cast("binary"), 256))
    linked = with_previous(digested, keys, order, ["_digest"], descending=not newest_first)
    changed = ~F.col("_has_prev") | ~F.col("_prev__digest").eqNullSafe(F.col("_digest"))
    return linked.filter(changed).drop("_has_prev", "_prev__digest", "_digest")


def flag_changes(
    df: DataFrame, keys: list[str], order: list[str], code: str = "code", docstring: str = "docstring",
    newest_first: bool = True,
) -> DataFrame:
    """Drops versions equal to the one before, flags what changed in the rest, and measures by how much.

    A dropped row equals its predecessor, so comparing with the previous row is the same as comparing with
    the previous kept row. The first version of a chain has null flags and similarities.
    """
    linked = with_previous(df, keys, order, [code, docstring], descending=not newest_first)
    first = ~F.col("_has_prev")
    old_code, old_doc = F.col(f"_prev_{code}"), F.col(f"_prev_{docstring}")
    return (
        linked.withColumn("code_updated", F.when(~first, old_code != F.col(code)))
        .withColumn("docstring_updated", F.when(~first, old_doc != F.col(docstring)))
        .filter(first | F.col("code_updated") | F.col("docstring_updated"))
        .withColumn("code_similarity", similarity(old_code, F.col(code)))
        .withColumn("docstring_similarity", similarity(old_doc, F.col(docstring)))
        .drop("_has_prev", f"_prev_{code}", f"_prev_{docstring}")
    )


def link_versions(
    df: DataFrame, keys: list[str], order: list[str], id_column: str = "id", newest_first: bool = True
) -> DataFrame:
    """Adds ``last_version``, the id of the version before, null for the first."""
    linked = with_previous(df, keys, order, [id_column], descending=not newest_first)
    return linked.withColumnRenamed(f"_prev_{id_column}", "last_version").drop("_has_prev")


def with_last_version(df: DataFrame, id_column: str, columns: list[str], pointer: str = "last_version") -> DataFrame:
    """Follows the chain pointer by a self-join and adds the neighbour's columns as ``last_<column>``.

    First versions have no pointer and find no match; they are spread over tasks instead of all meeting
    under the null key.
    """
    spread = F.when(F.col(pointer).isNull(), F.pmod(F.xxhash64(id_column), F.lit(1024))).otherwise(F.lit(0))
    neighbours = df.select(
        F.col(id_column).alias(pointer), F.lit(0).cast("long").alias("_spread"), *[F.col(c).alias(f"last_{c}") for c in columns]
    )
    return df.withColumn("_spread", spread).join(neighbours, [pointer, "_spread"], "left").drop("_spread")

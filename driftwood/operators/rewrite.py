"""Replacing docstrings in source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwood.functions.text import let, lines_of


def rewrite_files(files: DataFrame, edits: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """Files with docstring line spans replaced, plus the number of edits done.

    ``edits`` has ``first_line``, ``last_line`` (1-based, not overlapping within a file) and ``block``. A file
    is one text, so its edits are gathered, and put together in one pass with the lines between them.
    """
    spans = edits.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("first_line", "last_line", "block"))).alias("_edits")
    )

    def edited(file: Column) -> Column:
        lines, changes = file["lines"], file["edits"]

        def piece(edit: Column, i: Column) -> Column:
            done = F.when(i > 0, F.get(changes, i - 1)["last_line"]).otherwise(F.lit(0))
            block = F.split(F.regexp_replace(edit["block"], r"\n\z", ""), "\n", -1)
            return F.concat(F.slice(lines, done + 1, edit["first_line"] - done - 1), block)

        end = F.element_at(changes, -1)["last_line"]
        below = F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))
        return F.array_join(F.concat(F.flatten(F.transform(changes, piece)), below), "\n")

    return (
        files.join(spans, key, "left")
        .withColumn(text, F.when(F.col("_edits").isNull(), F.col(text)).otherwise(
            let(F.struct(lines_of(F.col(text)).alias("lines"), F.col("_edits").alias("edits")), edited)))
        .withColumn("edits", F.coalesce(F.size("_edits"), F.lit(0)))
        .drop("_edits")
    )


# A function's lines, and whether an edit that ends on a line moves it.
MARKS = {"start_line": False, "docstring_start_line": False, "docstring_end_line": True, "end_line": True}


def renumber(functions: DataFrame, edits: DataFrame, key: str = "path") -> DataFrame:
    """Line numbers after the edits: each edit above a line moves it by the lines the edit adds.

    ``functions`` has start, end and docstring lines. A function's own edit moves its end and its
    docstring's end, an edit inside a nested function likewise moves the ends of those around it.

    The ends of edits and the lines of functions are swept in one order per file with a running sum, so the work grows
    with their number and not with their product.
    """
    ends = edits.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col("last_line").alias("_line"), F.lit(1).alias("_rank"),
        (F.size(F.split(F.regexp_replace("block", r"\n\z", ""), "\n", -1)) - (F.col("last_line") - F.col("first_line") + 1)).alias("_delta"),
    )
    # Lines that an edit ending on them does not move come before it, others behind it.
    marks = F.array(*[
        F.struct(F.col(name).alias("_line"), F.lit(2 if moves else 0).alias("_rank"), F.lit(name).alias("_name")) for name, moves in MARKS.items()])
    numbered = functions.withColumn("_id", F.monotonically_increasing_id())
    lines = numbered.select(F.col(key).alias("_key"), F.struct(*functions.columns).alias("_function"), "_id", F.explode(marks).alias("_m"))
    lines = lines.select("_key", "_m._line", "_m._rank", F.lit(0).alias("_delta"), "_m._name", "_function", "_id")
    above = W.partitionBy("_key").orderBy("_line", "_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = lines.unionByName(ends, allowMissingColumns=True).withColumn("_new", F.col("_line") + F.sum("_delta").over(above).cast("int"))
    moved = swept.filter(F.col("_name").isNotNull()).groupBy("_key", "_id").agg(
        F.first("_function").alias("_function"), *[F.max(F.when(F.col("_name") == name, F.col("_new"))).alias(f"new_{name}") for name in MARKS])
    return moved.select("_function.*", *[f"new_{name}" for name in MARKS])

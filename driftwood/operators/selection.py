"""Order statistics of groups of any size, without holding a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwood.session import materialise

STEP_BITS = 16         # a group's values are counted by so many further bits at a time
SMALL = 100_000        # rows of one prefix that a task sorts


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a long of the same order; NaN is above all, as Spark orders it."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def group_lower_medians(df: DataFrame, by: list[str], columns: list[str], small: int = SMALL) -> DataFrame:
    """One row per group: ``by`` and, for each column, the lower of the two middle values where their number is even.

    Nulls count nowhere; a group without a value has null. The values of a group are counted by prefixes of their bits,
    65,536 of them at most, and only the prefix that holds the middle is looked at further: by its next bits while it has more than
    ``small`` rows, then by sorting it. So a group may have any number of rows and lie in any number of tasks.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]))
    key = [*by, "_column"]
    values = df.select(*by, each.alias("_e")).select(*by, "_e._column", "_e._value")
    values = values.filter(F.col("_value").isNotNull()).withColumn("_bits", ordered_bits(F.col("_value")))
    wanted, taken = None, 0
    while True:
        taken += STEP_BITS
        prefix = F.shiftright("_bits", 64 - taken)
        rows = values if wanted is None else _of_groups(values, wanted, key, taken - STEP_BITS)
        counts = rows.groupBy(*key, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"), *([] if wanted is None else [F.first("_rank").alias("_rank")]))
        running = W.partitionBy(*key).orderBy("_prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
        whole = W.partitionBy(*key)
        # The rank of the lower middle among the rows looked at, from 1.
        rank = F.floor((F.sum("_n").over(whole) + 1) / 2) if wanted is None else F.col("_rank")
        placed = counts.withColumns({"_to": F.sum("_n").over(running), "_want": rank})
        held = placed.filter((F.col("_to") - F.col("_n") < F.col("_want")) & (F.col("_want") <= F.col("_to")))
        wanted = materialise(held.select(*key, "_prefix", "_n", (F.col("_want") - F.col("_to") + F.col("_n")).alias("_rank")), "median-prefixes")
        if taken == 64 or wanted.filter(F.col("_n") > small).isEmpty():
            break
    # Whole bits leave equal values only, any of which will do.
    rows = _of_groups(values, wanted, key, taken)
    if taken < 64:
        place = F.row_number().over(W.partitionBy(*key).orderBy("_bits"))
        rows = rows.withColumn("_place", place).filter("_place = _rank")
    found = rows.groupBy(*key).agg(F.min("_value").alias("_value"))
    medians = found.groupBy(*by).agg(*[F.max(F.when(F.col("_column") == c, F.col("_value"))).alias(c) for c in columns])
    named = df.select(*by).distinct()
    on = [named[c].eqNullSafe(medians[c]) for c in by]
    return named.join(medians, on, "left").select(*[named[c] for c in by], *columns)


def _of_groups(values: DataFrame, wanted: DataFrame, key: list[str], taken: int) -> DataFrame:
    """The rows of each group whose first ``taken`` bits are those wanted, with the rank that is looked for among them."""
    held = wanted.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.col("_prefix").alias("_k_prefix"), "_rank")
    on = [values[c].eqNullSafe(held[f"_k_{c}"]) for c in key]
    met = values.join(held, [*on, F.shiftright(values["_bits"], 64 - taken) == held["_k_prefix"]])
    return met.drop(*[f"_k_{c}" for c in key], "_k_prefix")

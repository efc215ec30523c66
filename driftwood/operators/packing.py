"""Packing token sequences into blocks of fixed length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.operators.hashorder import dense_index

# Block length and rows packed together.
BLOCK_SIZE = 512
BUCKET_ROWS = 1000


def split_long(df: DataFrame, tokens: str = "input_ids", block_size: int = BLOCK_SIZE, piece: str = "piece") -> DataFrame:
    """Sequences above the block size in pieces of it, numbered from 0; every token stays."""
    last = F.greatest(F.ceil(F.size(tokens) / block_size).cast("int") - 1, F.lit(0))
    return df.withColumn(piece, F.explode(F.sequence(F.lit(0), last))).withColumn(
        tokens, F.slice(tokens, F.col(piece) * block_size + 1, F.lit(block_size)))


def count_long(df: DataFrame, tokens: str = "input_ids", block_size: int = BLOCK_SIZE) -> DataFrame:
    """One row: how many sequences, and tokens in them, ``drop_long`` leaves out."""
    long = F.size(tokens) > block_size
    return df.agg(F.count_if(long).alias("sequences"), F.coalesce(F.sum(F.when(long, F.size(tokens))), F.lit(0)).alias("tokens"))


def drop_long(df: DataFrame, tokens: str = "input_ids", block_size: int = BLOCK_SIZE) -> DataFrame:
    return df.filter(F.size(tokens) <= block_size)


def _assign(rows: Column, block_size: int, overflow: str) -> Column:
    """Next-fit over the ordered rows of a bucket: each row with its block, -1 where it is dropped."""
    start = F.struct(
        F.lit(0).alias("block"), F.lit(0).alias("used"),
        F.array().cast("array<struct<slot:int,block:int>>").alias("placed"),
    )

    def step(state: Column, row: Column) -> Column:
        fits = state["used"] + row["len"] <= block_size
        spill = F.lit(-1) if overflow == "drop" else state["block"] + 1
        used = F.lit(0) if overflow == "drop" else row["len"]
        return F.struct(
            F.when(fits, state["block"]).otherwise(state["block"] + 1).alias("block"),
            F.when(fits, state["used"] + row["len"]).otherwise(used).alias("used"),
            F.concat(
                state["placed"],
                F.array(F.struct(row["slot"].alias("slot"), F.when(fits, state["block"]).otherwise(spill).alias("block"))),
            ).alias("placed"),
        )

    return F.aggregate(rows, start, step, lambda state: state["placed"])


def assign_blocks(
    df: DataFrame, key: list[str], tokens: str = "input_ids", block_size: int = BLOCK_SIZE,
    bucket_rows: int = BUCKET_ROWS, overflow: str = "carry", seed: int = 42, long: str = "split",
) -> DataFrame:
    """Rows with bucket, slot and block, next-fit within buckets of ``bucket_rows`` rows in hash order.

    ``overflow`` says what becomes of a row that does not fit into the open block: ``carry`` starts the
    next block with it, ``drop`` starts the next block without it. ``long`` says what becomes of a sequence longer
    than a block: ``split`` cuts it into pieces, told apart by ``piece``, ``drop`` leaves it out (see ``count_long``). Only lengths are gathered per bucket,
    a thousand small structs; the tokens stay where they are.
    """
    if overflow not in ("carry", "drop"):
        raise ValueError("overflow must be 'carry' or 'drop'")
    if long not in ("split", "drop"):
        raise ValueError("long must be 'split' or 'drop'")
    if long == "split":
        df, key = split_long(df, tokens, block_size), [*key, "piece"]
    else:
        df = drop_long(df, tokens, block_size)
    sized = df.withColumn("_len", F.size(tokens))
    indexed = (
        dense_index(sized, key, seed, "_idx")
        .withColumn("bucket", F.floor(F.col("_idx") / bucket_rows))
        .withColumn("slot", (F.col("_idx") % bucket_rows).cast("int"))
        .drop("_idx")
    )
    lengths = indexed.select("bucket", F.struct("slot", F.col("_len").alias("len")).alias("_row"))
    blocks = (
        lengths.groupBy("bucket").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
        .select("bucket", F.explode(_assign(F.col("_rows"), block_size, overflow)).alias("_p"))
        .select("bucket", "_p.slot", "_p.block")
    )
    return indexed.join(blocks, ["bucket", "slot"]).filter(F.col("block") >= 0).drop("_len")


def fill_blocks(assigned: DataFrame, tokens: str, eos: int, block_size: int = BLOCK_SIZE) -> DataFrame:
    """One row per block: its tokens padded with ``eos``, the labels equal to the ids.

    A block holds at most ``block_size`` tokens, so the gathered lists are short.
    """
    ordered = F.sort_array(F.collect_list(F.struct("slot", F.col(tokens).alias("_ids"))))
    ids = F.flatten(F.transform(ordered, lambda r: r["_ids"]))
    return (
        assigned.groupBy("bucket", "block").agg(ids.alias("_ids"))
        .withColumn("input_ids", F.concat("_ids", F.array_repeat(F.lit(eos), F.lit(block_size) - F.size("_ids"))))
        .withColumn("labels", F.col("input_ids"))
        .drop("_ids")
    )

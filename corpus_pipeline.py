"""The pipeline over ``documents``: its stages in order, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm.common import documents
from driftwood.llm.content_sort import without_duplicates
from driftwood.llm.minhash import near_duplicates
from driftwood.llm.mixing import mix
from driftwood.llm.queries import PIECES
from driftwood.llm.sentencepieces import encode_texts
from driftwood.llm.toxicity import only_clean
from driftwood.session import materialise


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    return only_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) one row stays, the one with the most code points, then the smallest ``doc_id``."""
    return without_duplicates(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest ``doc_id`` stays, a null one last.

    Rows are numbered, as a ``doc_id`` may stand on several texts; of rows with one ``doc_id`` in a group any may stay.
    """
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    classes = near_duplicates(numbered, "_row").select(F.col("id").alias("_row"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("first")
    kept = numbered.select("_row", "doc_id").join(classes, "_row").groupBy("class_id").agg(first).select("first._row")
    return numbered.join(kept, "_row", "left_semi").drop("_row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed = mix(docs)
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies")))).select(*docs.columns)


def sentencepiece_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the ids of the whole text, their number, and the text decoded from them.

    The workers hold what earlier stages left with them, so this one takes smaller parts than a query of its own.
    """
    coded = encode_texts(docs, public_tokenizers.path(PIECES), part=400_000, remembered=80_000)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece_encode", sentencepiece_encode),
]

# A learned grammar, hashed signatures and a vocabulary cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Repository metadata, entity shards and stage tables."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood import schemas
from driftwood.session import shared_dir


INGEST = "ingest"    # column that orders the writes of an entity


def read_repository_metadata(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Repository metadata: JSON arrays of nested objects, an array per file in any layout, or with ``lines`` per line.

    What does not parse is an error. Files with lines can be split over tasks.
    """
    reader = spark.read.schema(schemas.REPOSITORY_METADATA).option("mode", "FAILFAST")
    return reader.option("multiLine", not lines).json(path)


def pick_repositories(repositories: DataFrame, min_stars: int, language: str | None = None, cap: int | None = None,
                      stars: str = "stars", key: str = "id") -> DataFrame:
    """The repositories of a language with enough stars, the most starred first; only ``cap`` of them if asked for."""
    picked = repositories.filter(F.col(stars) >= min_stars)
    if language is not None:
        picked = picked.filter(F.lower("language") == language.lower())
    ordered = picked.orderBy(F.desc(stars), key)
    return ordered if cap is None else ordered.limit(cap)


def first_repositories(repositories: DataFrame, n: int, key: str = "full_name") -> DataFrame:
    return repositories.orderBy(key).limit(n)


def repositories_from_metadata(metadata: DataFrame) -> DataFrame:
    """One entity row per repository; contributors and their contributions are counted from the nested list."""
    people = F.coalesce(F.col("contributors"), F.array().cast("array<struct<contributions:bigint>>"))
    return metadata.select(
        F.md5("full_name").alias("id"), "full_name", "size", "open_issues", "watchers",
        F.size(people).cast("long").alias("contributors"), "forks",
        F.aggregate(people, F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p["contributions"], F.lit(0))).alias("contributions"),
        F.col("stargazers_count").alias("stars"),
    )


def write_entity(df: DataFrame, path: str, entity: str, file_format: str = "parquet", ingest: int = 0) -> None:
    """Writes an entity in its fixed number of shards, a row's shard following from its id.

    ``ingest`` numbers the writes and is stored with the rows; a number above 0 adds to what is there. With many rows per shard, ``maxRecordsPerFile`` keeps single files readable in parallel.
    """
    shards = schemas.SHARDS[entity]
    (
        df.withColumn(INGEST, F.lit(ingest)).withColumn("shard", F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(shards)).cast("int"))
        .repartition("shard", F.pmod(F.xxhash64("id"), F.lit(_spread(df))))
        .write.mode("append" if ingest else "errorifexists").option("maxRecordsPerFile", 5_000_000)
        .partitionBy("shard").format(file_format).save(path)
    )


def _spread(df: DataFrame) -> int:
    """Writers per shard: about as many tasks as the session shuffles into, over at least 8 shards."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)


def read_entity(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet") -> DataFrame:
    """All shards present below ``path``, of rows with one id the last ingested; a shard without rows is not there."""
    full = T.StructType([*schema.fields, T.StructField(INGEST, T.IntegerType()), T.StructField("shard", T.IntegerType())])
    return last_per_id(spark.read.schema(full).format(file_format).load(path).drop("shard"), INGEST).drop(INGEST)


def last_per_id(df: DataFrame, ingest_order: str, key: str = "id") -> DataFrame:
    """Of rows with one id the last ingested wins; an aggregate, so repeated ids shrink before the shuffle."""
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.col(ingest_order)).alias("_row")
    return df.groupBy(key).agg(newest).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def stage(spark: SparkSession, name: str, parameters: dict, build) -> DataFrame:
    """Computes a table once and reads it ever after; other parameters give another table.

    A table is complete in a folder of its own before a marker names that folder. The marker is created without
    overwriting, so of several writers one publishes and all read its table; the others' folders are left behind, and
    so is one whose writer was cut short. Nothing is renamed, which folders in object stores cannot be in one step.
    """
    digest = hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()
    folder = f"{shared_dir(spark)}/driftwood/stages"
    marker = f"{folder}/{name}-{digest}.complete"
    published = _read_marker(spark, marker)
    if published is None:
        fresh = f"{name}-{digest}-{uuid.uuid4().hex}"
        build().write.parquet(f"{folder}/{fresh}")
        published = fresh if _create_marker(spark, marker, fresh) else _read_marker(spark, marker)
    return spark.read.parquet(f"{folder}/{published}")


def _file(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _create_marker(spark: SparkSession, path: str, content: str) -> bool:
    """Whether this call created the file; False where it was there."""
    marker, files = _file(spark, path)
    try:
        out = files.create(marker, False)
    except Py4JJavaError:
        if files.exists(marker):
            return False
        raise
    out.writeBytes(content + "\n")
    out.close()
    return True


def _read_marker(spark: SparkSession, path: str, patience: float = 30.0) -> str | None:
    """What the marker says, None where there is none. One that was just created gets its line within moments."""
    marker, files = _file(spark, path)
    until = time.monotonic() + patience
    while files.exists(marker):
        java = spark.sparkContext._jvm.java.io
        reader = java.BufferedReader(java.InputStreamReader(files.open(marker)))
        line = reader.readLine()
        reader.close()
        if line:
            return line
        if time.monotonic() > until:
            raise RuntimeError(f"{path} is empty: its writer was cut short; delete it to build the table again")
        time.sleep(0.05)
    return None

"""Sample sets, prediction caches, judge ratings and scoring requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood import schemas
from driftwood.session import materialise


def write_samples(df: DataFrame, path: str, file_format: str = "json") -> None:
    df.select("e", "l", "c", "d").write.mode("errorifexists").format(file_format).save(path)


def read_samples(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    return spark.read.schema(schemas.SAMPLE).format(file_format).load(path)


def read_prediction_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cache files, each one JSON object ``{model: [sample][item] -> text}`` in any layout, as rows with a ``data`` map.

    A file that does not parse is an error. A file is one row, so one task reads it.
    """
    return spark.read.text(path, wholetext=True).select(_parsed("value", schemas.PREDICTION_CACHE).alias("data"))


def read_prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """Caches as lines ``{"first_item": n, "data": {model: [sample][item] -> text}}``; files can be split over tasks."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = _parsed("value", T.StructType([T.StructField("first_item", T.LongType()), T.StructField("data", schemas.PREDICTION_CACHE)]))
    return lines.select(parsed.alias("_c")).select("_c.first_item", "_c.data")


def _parsed(column: str, schema: T.DataType) -> Column:
    """The JSON value of a text; a text that has none is an error."""
    value = F.from_json(column, schema, {"mode": "FAILFAST"})
    broken = F.raise_error(F.concat(F.lit("this is not JSON of the expected form: "), F.substring(column, 1, 80)))
    return F.when(value.isNull(), broken).otherwise(value)


def explode_predictions(caches: DataFrame, data: str = "data", offset: str | None = None) -> DataFrame:
    """Nested cache to one row per model, sample and item; ``offset`` names the column with a file's first item."""
    keep = [] if offset is None else [F.col(offset).alias("_offset")]
    start = F.lit(0) if offset is None else F.col("_offset")
    kept = [] if offset is None else ["_offset"]
    return (
        caches.select(*keep, F.explode(data).alias("mid", "_samples"))
        .select(*kept, "mid", F.posexplode("_samples").alias("sample_idx", "_items"))
        .select(*kept, "mid", "sample_idx", F.posexplode("_items").alias("_pos", "text"))
        .select("mid", "sample_idx", (F.col("_pos") + start).cast("long").alias("item_idx"), "text")
    )


def predictions_by_item(generations: DataFrame) -> DataFrame:
    """Item-major form: the texts of one model and item, ordered by sample.

    A cache holds one text per model, item and sample, so a list is as long as the number of samples.
    """
    ordered = F.sort_array(F.collect_list(F.struct("sample_idx", "text")))
    return generations.groupBy("mid", "item_idx").agg(F.transform(ordered, lambda s: s["text"]).alias("texts"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Judge answers from JSON arrays of strings, indented or on one line; ``read_string_arrays`` splits long lines too.

    Each line is parsed by itself: an indented file holds one answer per line, so it can be split. Brackets and
    commas may stand at either end of a line; one that holds anything else but strings is an error. A null answer is
    left out. The outer form of ``explode`` keeps Spark from parsing twice.
    """
    inner = F.regexp_replace(F.regexp_replace("value", r"\A[\s,]*(\[[\s,]*)?", ""), r"[\s,]*(\][\s,]*)?\z", "")
    answers = F.from_json(F.concat(F.lit("["), F.col("_inner"), F.lit("]")), "array<string>")
    broken = F.raise_error(F.concat(F.lit("this line is no part of a JSON array of strings: "), F.substring("value", 1, 80)))
    checked = F.when((F.col("_inner") != "") & (answers.isNull() | (F.size(answers) == 0)), broken).otherwise(answers)
    lines = spark.read.text(path).withColumn("_inner", inner)
    return lines.select(F.explode_outer(checked).alias("answer")).filter(F.col("answer").isNotNull())


def read_string_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The strings of JSON arrays of strings, however many stand on a line: ``path``, ``place`` and ``text``.

    Files are read by their quotation marks, so one line of any length is split over tasks. A mark is escaped if an odd
    number of backslashes precedes it, wherever it stands; the others open and close strings in turn. They are counted
    per split, summed up over the splits of a file, and then numbered within each split. Pieces of a string, cut at
    escaped marks or at a split's border, meet by the string's number, which is its ``place``. Nulls are left out; what
    stands between strings and is no comma, bracket or null is an error, and so is a string without an end.
    """
    pieces = spark.read.option("lineSep", '"').text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    # A file's last piece counts too, though no mark is behind it: so an odd number leaves no string open.
    pieces = pieces.withColumn("_marks", (F.length(F.regexp_extract("value", r"(\\*)\z", 1)) % 2 == 0).cast("long"))
    splits = materialise(pieces.groupBy("path", "_split").agg(F.sum("_marks").alias("_n")), "marks-per-split")
    # As many rows as splits, of one file in one window.
    before = F.sum("_n").over(W.partitionBy("path").orderBy("_split").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("path", "_split", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy("path")).alias("_all"))
    earlier = W.partitionBy("path", "_split").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    numbered = pieces.withColumn("_here", F.coalesce(F.sum("_marks").over(earlier), F.lit(0))).join(splits, ["path", "_split"])
    numbered = numbered.withColumn("_number", F.col("_before") + F.col("_here"))
    inside = F.col("_number") % 2 == 1
    odd = F.raise_error(F.concat(F.lit("this is no part of a JSON array of strings: "), F.substring("value", 1, 80))).cast("boolean")
    between = F.regexp_like("value", F.lit(r"\A(?:[\s,\[\]]|null)*\z"))
    open_end = F.raise_error(F.concat(F.lit("a string does not end: "), F.col("path"))).cast("boolean")
    strings = numbered.filter(F.when(F.col("_all") % 2 == 0, open_end).when(inside, F.lit(True)).when(between, F.lit(False)).otherwise(odd))
    gathered = strings.groupBy("path", ((F.col("_number") - 1) / 2).cast("long").alias("place")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_split", "_at", "value"))), lambda p: p["value"]), '"').alias("_quoted"))
    text = F.get(F.from_json(F.concat(F.lit('["'), F.col("_quoted"), F.lit('"]')), "array<string>"), 0)
    broken = F.raise_error(F.concat(F.lit("this is no JSON string: "), F.substring("_quoted", 1, 80)))
    return gathered.select("path", "place", F.when(text.isNull(), broken).otherwise(text).alias("text"))


def unpack_requests(requests: DataFrame, keep: list[str]) -> DataFrame:
    """One row per code and docstring of a request; lists of unequal length are an error."""
    pairs = F.when(
        F.size("codes") == F.size("docstrings"), F.arrays_zip("codes", "docstrings")
    ).otherwise(F.raise_error(F.lit("a request needs one docstring for each code")))
    return requests.select(*keep, F.posexplode(pairs).alias("pos", "_pair")).select(
        *keep, "pos", F.col("_pair.codes").alias("code"), F.col("_pair.docstrings").alias("docstring")
    )

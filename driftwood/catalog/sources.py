"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftwood import schemas
from driftwood.catalog import views
from driftwood.catalog.python_sources import file_versions
from driftwood.catalog.registry import query, table
from driftwood.functions.hashing import entity_id
from driftwood.functions.text import training_prompt, body_begin
from driftwood.session import fresh_path
from driftwood.sources import entities, samples
from driftwood.sources.history import read_file_versions


@query("s1_repository_metadata", """
SELECT md5(c_name) AS id, c_name AS full_name, c_custkey % 1000 AS size, c_custkey % 7 AS open_issues, c_custkey % 11 AS watchers,
  c_custkey % 5 AS contributors, c_custkey % 3 AS forks,
  coalesce(list_sum(list_transform(range(1, c_custkey % 5 + 1), lambda i: i * (c_custkey % 10))), 0)::BIGINT AS contributions,
  c_custkey % 5000 AS stars
FROM customer
""")
def s1(spark, sf):
    """Customers as repositories, in pages of 100 as JSON arrays."""
    k = F.col("c_custkey")
    people = F.when(k % 5 == 0, F.array().cast("array<struct<contributions:bigint>>")).otherwise(
        F.transform(F.sequence(F.lit(1).cast("long"), k % 5), lambda i: F.struct((i * (k % 10)).alias("contributions"))))
    repository = F.struct(
        F.col("c_name").alias("full_name"), F.concat(F.lit("https://example.org/"), "c_name").alias("html_url"),
        (k % 1000).alias("size"), (k % 7).alias("open_issues"), (k % 11).alias("watchers"), (k % 3).alias("forks"),
        (k % 5000).alias("stargazers_count"), people.alias("contributors"),
    )
    path = fresh_path(spark, "metadata")
    (
        table(spark, sf, "customer").select(F.floor(k / 100).alias("page"), repository.alias("r"))
        .groupBy("page").agg(F.to_json(F.collect_list("r")).alias("value")).select("value")
        .write.text(path)
    )
    return entities.repositories_from_metadata(entities.read_repository_metadata(spark, path, lines=True))


FILES_SQL = """SELECT md5(source || '|' || doc_id) AS id, 'src/' || doc_id || '.py' AS path, md5(source) AS repo FROM documents"""


@query("s2_entity_shards", FILES_SQL)
def s2(spark, sf):
    path = fresh_path(spark, "files")
    files = table(spark, sf, "documents").select(
        entity_id(F.col("source"), F.col("doc_id")).alias("id"),
        F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.md5("source").alias("repo"),
    )
    entities.write_entity(files, path, "files", "json")
    return entities.read_entity(spark, path, schemas.FILE, "json")


@query("s3_last_row_per_id", """
SELECT md5(o_custkey || '|' || o_orderkey) AS id, o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN ' again' ELSE '' END AS name, md5(CAST(o_custkey AS VARCHAR)) AS file FROM orders
""")
def s3(spark, sf):
    """Orders as functions of their customers; a third is ingested again with another name."""
    orders = table(spark, sf, "orders")
    functions = orders.select(
        entity_id(F.col("o_custkey").cast("string"), F.col("o_orderkey")).alias("id"), F.col("o_orderstatus").alias("name"),
        F.md5(F.col("o_custkey").cast("string")).alias("file"), (F.col("o_orderkey") % 3 == 0).alias("_again"))
    path = fresh_path(spark, "functions")
    entities.write_entity(functions.drop("_again"), path, "functions")
    again = functions.filter("_again").drop("_again").withColumn("name", F.concat("name", F.lit(" again")))
    entities.write_entity(again, path, "functions", ingest=1)
    return entities.read_entity(spark, path, schemas.FUNCTION)


@query("s4_stage_table", "SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def s4(spark, sf):
    def build():
        return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))

    def never():
        raise AssertionError("the stage is computed once")

    parameters = {"sf": sf, "run": uuid.uuid4().hex}
    entities.stage(spark, "documents_by_source", parameters, build)
    return entities.stage(spark, "documents_by_source", parameters, never)


@query("s5_sample_set", f"""
WITH {views.LABELED}
SELECT E'<|fim_prefix|>def f_' || doc_id || E'(x):\\n\\n    \"\"\"<|fim_suffix|>\"\"\"\\n    ' || substr(c, length('def f_' || doc_id || '(x):') + 2) ||
  '<|fim_middle|>' || d || '<|file_separator|>' AS e, l, c, d
FROM b_labeled
""")
def s5(spark, sf):
    path = fresh_path(spark, "samples")
    rows = views.labeled(spark, sf)
    samples.write_samples(rows.select(training_prompt(F.col("c"), body_begin(F.col("c")), F.col("d")).alias("e"), "l", "c", "d"), path)
    return samples.read_samples(spark, path)


@query("s6_prediction_cache", f"""
WITH {views.GENERATIONS}
SELECT mid, item_idx, count(*) AS samples, string_agg(text, '|' ORDER BY sample_idx) AS texts FROM b_gen GROUP BY ALL
""")
def s6(spark, sf):
    """Caches of 32 items each, a line per cache, written sample-major and read back item-major."""
    rows = views.generations(spark, sf).withColumn("block", F.floor(F.col("item_idx") / 32)).withColumn("place", F.col("item_idx") % 32)
    texts = F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "sample_idx", "place"), "text")))
    per_model = rows.groupBy("block", "mid").agg(texts.alias("_t"), F.max("sample_idx").alias("last"))
    nested = F.transform(F.sequence(F.lit(0), F.col("last")), lambda s: F.transform(
        F.sequence(F.lit(0), F.lit(31)), lambda i: F.try_element_at(F.col("_t"), F.concat_ws(":", s, i))))
    caches = per_model.select("block", "mid", nested.alias("n")).groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("mid", "n"))).alias("data"))
    path = fresh_path(spark, "predictions")
    caches.select(F.to_json(F.struct((F.col("block") * 32).cast("long").alias("first_item"), "data")).alias("value")).write.text(path)
    read = samples.read_prediction_lines(spark, path)
    by_item = samples.predictions_by_item(samples.explode_predictions(read, "data", "first_item").filter(F.col("text").isNotNull()))
    return by_item.select("mid", "item_idx", F.size("texts").cast("long").alias("samples"), F.array_join("texts", "|").alias("texts"))


@query("s7_judge_ratings", f"WITH {views.RATINGS} SELECT judge, answer FROM b_ratings")
def s7(spark, sf):
    """Answers written as indented JSON arrays, one file per writing task, and read line by line."""
    path = fresh_path(spark, "ratings")
    rows = views.ratings(spark, sf)
    quoted = F.regexp_extract(F.to_json(F.array("answer")), r"(?s)\A\[(.*)\]\z", 1)
    lines = rows.select("judge", F.concat(F.lit("    "), quoted, F.lit(",")).alias("value"))
    lines.write.partitionBy("judge").text(path)
    firsts, seconds = (
        samples.read_ratings(spark, f"{path}/judge={judge}").select(F.lit(judge).alias("judge"), "answer") for judge in ("first", "second")
    )
    return firsts.unionByName(seconds)


@query("s7_ratings_on_one_line", f"WITH {views.RATINGS} SELECT judge, answer FROM b_ratings")
def s7_one_line(spark, sf):
    """All answers of a writing task on one line, as a dump without indentation has them, and read by more than one task."""
    path = fresh_path(spark, "rating-lines")
    rows = views.ratings(spark, sf)
    arrays = rows.groupBy("judge", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("_file")).agg(F.to_json(F.collect_list("answer")).alias("value"))
    arrays.select("judge", "value").write.partitionBy("judge").text(path)
    read = [samples.read_string_arrays(spark, f"{path}/judge={judge}").select(F.lit(judge).alias("judge"), F.col("text").alias("answer")) for judge in ("first", "second")]
    return read[0].unionByName(read[1])


@query("s8_file_versions", """
SELECT source AS repo, count(*) * 5 AS versions, count(DISTINCT doc_id) AS paths, 4::BIGINT AS oldest FROM documents GROUP BY source
""")
def s8(spark, sf):
    path = fresh_path(spark, "file-versions")
    file_versions(spark, sf).write.parquet(path)
    return read_file_versions(spark, path).groupBy("repo").agg(
        F.count(F.lit(1)).alias("versions"), F.countDistinct("path").alias("paths"), F.max("seq").alias("oldest"))


@query("s9_unpack_requests", f"WITH {views.REQUESTS} SELECT conv_id, part, pos, code, docstring FROM b_request_rows")
def s9(spark, sf):
    return samples.unpack_requests(views.requests(spark, sf), ["conv_id", "part"]).withColumn("pos", F.col("pos").cast("long"))

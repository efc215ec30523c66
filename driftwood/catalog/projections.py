"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.catalog import views
from driftwood.catalog.python_sources import EXPECTED, sources
from driftwood.catalog.registry import query, r6, table
from driftwood.functions.text import has_min_newlines
from driftwood.operators import extract
from driftwood.operators.chains import flag_changes, link_versions
from driftwood.operators.packing import drop_long
from driftwood.operators.relations import complete_rows
from driftwood.operators.tokens import words
from driftwood.plans.scoring import setting_ratios
from driftwood.sources.entities import first_repositories, pick_repositories
from driftwood.sources.history import decode_sources, python_files


@query("f1_python_files", "SELECT page_id, url || '.py' AS path FROM pages WHERE page_id % 3 = 0")
def f1(spark, sf):
    ending = F.when(F.col("page_id") % 3 == 0, ".py").otherwise(".pyc")
    return python_files(table(spark, sf, "pages").select("page_id", F.concat("url", ending).alias("path")))


@query("f2_min_newlines", r"SELECT doc_id, n_chars FROM documents WHERE length(text) - length(replace(text, E'\n', '')) >= 3")
def f2(spark, sf):
    return table(spark, sf, "documents").filter(has_min_newlines(F.col("text"))).select("doc_id", "n_chars")


@query("f3_decoded_sources", r"""
SELECT doc_id, replace(text, E'\n', E'\n    ') || CASE WHEN doc_id % 2 = 0 THEN E'\n' ELSE '' END || 'end' || E'\n\n\n' AS source
FROM documents WHERE doc_id % 7 <> 0
""")
def f3(spark, sf):
    """Line ends as CRLF or CR, indents as tabs; every seventh document with a byte that is not UTF-8."""
    k = F.col("doc_id")
    line_end = F.when(k % 3 == 0, "\r\n").when(k % 3 == 1, "\r").otherwise("\n")
    text = F.concat(F.replace(F.col("text"), F.lit("\n"), F.concat(line_end, F.lit("\t"))),
                    F.when(k % 2 == 0, line_end).otherwise(""), F.lit("end"), F.repeat(F.lit("\n"), 3))
    broken = F.when(k % 7 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    return decode_sources(table(spark, sf, "documents").select("doc_id", F.concat(text.cast("binary"), broken).alias("content")))


@query("f4_unparsable_sources", """
SELECT doc_id % 10 AS kind, count(*) AS sources, count(*) FILTER (doc_id % 10 = 9) AS rejected FROM documents GROUP BY ALL
""")
def f4(spark, sf):
    return extract.parsed(sources(spark, sf)).groupBy((F.col("doc_id") % 10).alias("kind")).agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("functions").isNull()).alias("rejected"))


@query("f5_trivial_functions", f"WITH {EXPECTED} SELECT doc_id, node, name, code FROM b_found WHERE NOT trivial")
def f5(spark, sf):
    return extract.extract_functions(sources(spark, sf)).filter(~F.col("trivial")).select("doc_id", "node", "name", "code")


@query("f6_documented", f"WITH {views.CODE} SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE d END AS doc FROM b_code) WHERE doc <> ''")
def f6(spark, sf):
    kind = F.col("doc_id") % 4
    doc = F.when(kind == 1, "").when(kind > 1, F.col("d"))
    return views.code(spark, sf).withColumn("doc", doc).filter(extract.has_docstring(F.col("doc"))).select("doc_id", "n_chars")


F7_SQL = f"""
WITH {views.HISTORY},
w AS (SELECT *, lag(code) OVER o AS pc, lag(docstring) OVER o AS pd FROM b_history WINDOW o AS (PARTITION BY conv_id ORDER BY seq)),
kept AS (SELECT * FROM w WHERE pc IS NULL OR pc <> code OR pd <> docstring),
linked AS (SELECT conv_id, seq, lag(seq) OVER (PARTITION BY conv_id ORDER BY seq) AS last_version, pc <> code AS code_updated, pd <> docstring AS docstring_updated FROM kept)
SELECT conv_id, seq, last_version, code_updated, docstring_updated,
  CASE WHEN seq % 4 > 0 THEN 'c' || seq END AS commit, CASE WHEN seq % 3 > 0 THEN DATE '2020-01-01' + CAST(seq AS INTEGER) END AS date
FROM linked WHERE last_version IS NOT NULL
"""


@query("f7_complete_rows", F7_SQL)
def f7(spark, sf):
    history, chain = views.history(spark, sf), ["conv_id"]
    flagged = flag_changes(history, chain, ["seq"]).select("conv_id", "seq", "code_updated", "docstring_updated")
    linked = link_versions(flagged, chain, ["seq"], "seq")
    dated = linked.withColumn("commit", F.when(F.col("seq") % 4 > 0, F.concat(F.lit("c"), F.col("seq").cast("string")))).withColumn(
        "date", F.when(F.col("seq") % 3 > 0, F.date_add(F.lit("2020-01-01").cast("date"), F.col("seq").cast("int"))))
    return complete_rows(dated.select("conv_id", "seq", "last_version", "code_updated", "docstring_updated", "commit", "date"))


@query("f8_stale_rows", f"WITH {views.LABELED} SELECT doc_id, source, d FROM b_labeled WHERE NOT l")
def f8(spark, sf):
    return views.labeled(spark, sf).filter(~F.col("l")).select("doc_id", "source", "d")


@query("f9_repository_pick", """
SELECT c_custkey AS id, c_mktsegment AS language, round(c_acctbal, 2) AS stars FROM customer
WHERE c_acctbal >= 1000 AND lower(c_mktsegment) = 'building' ORDER BY c_acctbal DESC, c_custkey
""")
def f9(spark, sf):
    repositories = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("language"), F.col("c_acctbal").alias("stars"))
    return pick_repositories(repositories, 1000, "building").withColumn("stars", F.round("stars", 2))


@query("f10_first_repositories", "SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 10")
def f10(spark, sf):
    return first_repositories(table(spark, sf, "customer").select("c_custkey", "c_name"), 10, "c_name")


@query("f11_column_projection", f"WITH {views.CODE} SELECT doc_id, c, d FROM b_code")
def f11(spark, sf):
    return views.code(spark, sf).drop("source", "lang", "n_chars", "text")


@query("f12_short_sequences", f"WITH {views.CODE} SELECT doc_id, len(regexp_extract_all(lower(d), '[a-z]+')) AS n FROM b_code WHERE len(regexp_extract_all(lower(d), '[a-z]+')) <= 512")
def f12(spark, sf):
    rows = views.code(spark, sf).select("doc_id", words(F.col("d")).alias("input_ids"))
    return drop_long(rows).select("doc_id", F.size("input_ids").cast("long").alias("n"))


@query("f13_scattered_results", f"""
WITH {views.CODE}
SELECT b.doc_id, b.source, coalesce(NOT (l.toxic = 1 OR l.quality = 0), false) AS up_to_date FROM b_code b LEFT JOIN labels l ON l.doc_id = b.doc_id
""")
def f13(spark, sf):
    scored = table(spark, sf, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("out_of_date"))
    return extract.scatter_results(views.code(spark, sf).select("doc_id", "source"), scored, ["doc_id"])


@query("f14_grid_cell", f"""
WITH {views.VECTORS}
SELECT item_idx, round(docstring_score, 6) AS docstring_score, round(updated_docstring_score, 6) AS updated_docstring_score FROM b_ratios
WHERE mid = 'tuned' AND distance_function = 'euclidean' AND NOT normalize AND sample_many
""")
def f14(spark, sf):
    return setting_ratios(views.embeddings(spark, sf)[0], [("euclidean", False, True)]).filter(F.col("mid") == "tuned").select(
        "item_idx", r6("docstring_score").alias("docstring_score"), r6("updated_docstring_score").alias("updated_docstring_score"))

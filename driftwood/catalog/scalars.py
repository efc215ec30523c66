"""Scalar column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.catalog import views
from driftwood.catalog.python_sources import EXPECTED, ratio_sql, sources
from driftwood.catalog.registry import query, r6, table
from driftwood.catalog.windows import KEPT_SQL, _kept
from driftwood.functions import metrics, text
from driftwood.functions.similarity import similarity
from driftwood.functions.vectors import cosine, euclidean, l2_normalise, norm, unit_euclidean
from driftwood.operators.chains import with_previous
from driftwood.operators.extract import extract_functions, located_functions
from driftwood.sources.history import iso_date

# The characters Python strips, for RE2.
SPACE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

CLEAN_SQL = f"""
b_stripped AS (SELECT doc_id, list_transform(string_split(c, E'\\n'), lambda l: regexp_replace(split_part(l, '#', 1), '{SPACE}+$', '')) AS ls FROM b_code),
b_depth AS (SELECT doc_id, ls, list_min(list_transform(ls, lambda l: (length(l) - length(ltrim(l, ' '))) // 4)) AS k FROM b_stripped),
b_clean AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(ls, lambda l: substr(l, 4 * k + 1)), E'\\n'), '\\n{{2,}}', E'\\n') AS code FROM b_depth)"""


@query("c1_clean_code", f"WITH {views.CODE}, {CLEAN_SQL} SELECT doc_id, code FROM b_clean")
def c1(spark, sf):
    return views.code(spark, sf).select("doc_id", text.clean_code(F.col("c")).alias("code"))


@query("c2_body_begin", f"WITH {views.CODE} SELECT doc_id, instr(c, E':\\n') + 1 AS in_code, instr(text, E':\\n') + 1 AS in_text FROM b_code")
def c2(spark, sf):
    return views.code(spark, sf).select(
        "doc_id", text.body_begin(F.col("c")).cast("long").alias("in_code"), text.body_begin(F.col("text")).cast("long").alias("in_text"))


@query("c3_lengths", f"WITH {views.CODE} SELECT doc_id, length(c) AS code_length, length(d) AS docstring_length FROM b_code")
def c3(spark, sf):
    return views.code(spark, sf).select("doc_id", F.length("c").cast("long").alias("code_length"), F.length("d").cast("long").alias("docstring_length"))


@query("c4_text_similarity", f"""
WITH {KEPT_SQL}
SELECT conv_id, seq, round(code_similarity, 6) AS code_similarity, round(docstring_similarity, 6) AS docstring_similarity FROM b_kept
""")
def c4(spark, sf):
    return _kept(spark, sf).select("conv_id", "seq", r6("code_similarity").alias("code_similarity"), r6("docstring_similarity").alias("docstring_similarity"))


@query("c4_document_similarity", f"""
WITH n AS (SELECT doc_id, text, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM documents)
SELECT doc_id, round({ratio_sql('text', 'other')}, 6) AS similarity FROM n WHERE other IS NOT NULL
""")
def c4_documents(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "text")
    linked = with_previous(rows, ["source"], ["doc_id"], ["text"], descending=True)
    return linked.filter("_has_prev").select("doc_id", r6(similarity("text", "_prev_text")).alias("similarity"))


# The header of b_code ends behind its first line.
HEADER = "length('def f_' || doc_id || '(x):') + 1"


@query("c5_training_prompt", f"""
WITH {views.CODE}
SELECT doc_id, '<|fim_prefix|>' || substr(c, 1, {HEADER}) || E'\\n    \"\"\"<|fim_suffix|>\"\"\"\\n    ' || substr(c, {HEADER} + 1) || '<|fim_middle|>' || d || '<|file_separator|>' AS prompt FROM b_code
""")
def c5(spark, sf):
    c = F.col("c")
    return views.code(spark, sf).select("doc_id", text.training_prompt(c, text.body_begin(c), F.col("d")).alias("prompt"))


@query("c6_serving_prompt", f"""
WITH {views.CODE}
SELECT doc_id, '<|fim_prefix|>' || substr(c, 1, {HEADER}) || E'\\n    \"\"\"<|fim_suffix|>\"\"\"\\n    ' || regexp_replace(substr(c, {HEADER} + 1), '^{SPACE}+', '') || '<|fim_middle|>' AS prompt FROM b_code
""")
def c6(spark, sf):
    """Line ends as CRLF, with the CR doubled in every second document."""
    line_end = F.when(F.col("doc_id") % 2 == 0, "\r\r\n").otherwise("\r\n")
    return views.code(spark, sf).select("doc_id", text.serving_prompt(F.replace(F.col("c"), F.lit("\n"), line_end)).alias("prompt"))


@query("c7_clean_generation", f"WITH {views.CODE} SELECT doc_id, d AS generated FROM b_code")
def c7(spark, sf):
    raw = F.concat("c", F.lit(text.MIDDLE + "x" + text.MIDDLE + " \n "), "d", F.lit(text.SEPARATOR + "\n\t"), F.lit('"""\nreturn """'), "c")
    return views.code(spark, sf).select("doc_id", text.clean_generation(raw).alias("generated"))


@query("c8_remove_docstring", f"""
WITH {views.CODE}
SELECT doc_id, E'def f(x):\\n    ' || E'\\n    # ' || regexp_replace(text, '["''\\n\\r]+', ' ', 'g') || E'\\n    return x' || CASE WHEN doc_id % 4 = 2 THEN ' + \"\"\"y\"\"\"' ELSE '' END AS code FROM b_code WHERE doc_id % 4 <> 3
""")
def c8(spark, sf):
    """Both delimiters, a second quoted text, and a docstring that never ends; the document's text follows it."""
    kind = F.col("doc_id") % 4
    mark = F.when(kind == 1, text.TRIPLE_SINGLE).otherwise(text.TRIPLE)
    code = F.concat(F.lit("def f(x):\n    "), mark, "d", F.when(kind == 3, "").otherwise(mark), F.lit("\n    # "),
                    F.regexp_replace("text", r"""["'\n\r]+""", " "), F.lit("\n    return x"),
                    F.when(kind == 2, ' + """y"""').otherwise(""))
    return views.code(spark, sf).select("doc_id", text.remove_docstring(code).alias("code")).filter(F.col("code").isNotNull())


@query("c9_dedent", f"""
WITH {views.CODE},
m AS (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN c ELSE '        ' || replace(c, E'\\n', E'\\n        ') || CASE WHEN doc_id % 3 = 2 THEN E'\\n  ' ELSE '' END END, E'\\n') AS ls FROM b_code),
k AS (SELECT doc_id, ls, list_min(list_transform(ls, lambda l: CASE WHEN l = '' THEN 0 WHEN regexp_full_match(l, '{SPACE}+') THEN (length(l) + 3) // 4 ELSE (length(l) - length(ltrim(l, ' '))) // 4 END)) AS k FROM m)
SELECT doc_id, array_to_string(list_transform(ls, lambda l: substr(l, 4 * k + 1)), E'\\n') AS code FROM k
""")
def c9(spark, sf):
    """As it stands, indented twice, and indented twice with a short blank line."""
    kind = F.col("doc_id") % 3
    deep = F.concat(F.lit(" " * 8), F.replace(F.col("c"), F.lit("\n"), F.lit("\n" + " " * 8)), F.when(kind == 2, "\n  ").otherwise(""))
    return views.code(spark, sf).select("doc_id", text.dedent(F.when(kind == 0, F.col("c")).otherwise(deep)).alias("code"))


@query("c10_docstring_span", f"WITH {EXPECTED} SELECT doc_id, name, start_line, first_line, last_line FROM b_found")
def c10(spark, sf):
    return located_functions(extract_functions(sources(spark, sf))).select(
        "doc_id", "name", "start_line", F.col("docstring_start_line").alias("first_line"), F.col("docstring_end_line").alias("last_line"))


@query("c11_docstring_block", f"WITH {views.CODE} SELECT doc_id, E'    \"\"\"\\n    ' || d || E'\\n    \"\"\"\\n' AS block FROM b_code")
def c11(spark, sf):
    return views.code(spark, sf).select("doc_id", text.docstring_block(F.col("d")).alias("block"))


@query("c12_vector_distances", f"""
WITH {views.VECTORS}
SELECT item_idx, round(list_cosine_similarity(code, doc), 6) AS cosine, round(list_distance(code, doc), 6) AS euclidean, round(list_distance(ucode, udoc), 6) AS euclidean_unit, round(sqrt(list_inner_product(ucode, ucode)), 6) AS unit_norm FROM b_unit
""")
def c12(spark, sf):
    rows = views.embeddings(spark, sf)[0]
    codes = rows.filter("role = 'code'").select("item_idx", F.col("embedding").alias("a"))
    pairs = codes.join(rows.filter("role = 'doc'").select("item_idx", F.col("embedding").alias("b")), "item_idx")
    a, b, norm_a, norm_b = (F.col(c) for c in ("a", "b", "norm_a", "norm_b"))
    measured = pairs.withColumn("norm_a", norm(a)).withColumn("norm_b", norm(b)).withColumn("unit_a", l2_normalise(a, norm_a))
    return measured.select(
        "item_idx", r6(cosine(a, b, norm_a, norm_b)).alias("cosine"), r6(euclidean(a, b)).alias("euclidean"),
        r6(unit_euclidean(a, b, norm_a, norm_b)).alias("euclidean_unit"), r6(norm(F.col("unit_a"))).alias("unit_norm"))


@query("c13_score_ratio", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_tax = 0 THEN CASE WHEN l_discount = 0 THEN 'nan' ELSE 'inf' END ELSE round(l_discount / l_tax, 6)::VARCHAR END AS ratio,
  l_tax <> 0 AND l_discount / nullif(l_tax, 0) <= 1 AS below
FROM lineitem
""")
def c13(spark, sf):
    ratio = metrics.ieee_ratio(F.col("l_discount"), F.col("l_tax"))
    shown = F.when(F.isnan(ratio), "nan").when(ratio == float("inf"), "inf").otherwise(r6(ratio).cast("string"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", shown.alias("ratio"), metrics.at_most(ratio, F.lit(1.0)).alias("below"))


@query("c14_threshold_grid", """
WITH g AS (SELECT i AS grid_idx, i * (3.0::DOUBLE / 199) AS t FROM range(200) r(i)),
o AS (SELECT o_orderkey, o_totalprice / 150000 AS ratio FROM orders)
SELECT o_orderkey, min(grid_idx) AS grid_idx, round(min(t), 6) AS threshold FROM o LEFT JOIN g ON t >= ratio GROUP BY o_orderkey
""")
def c14(spark, sf):
    index = metrics.grid_index(F.col("o_totalprice") / 150000)
    return table(spark, sf, "orders").select("o_orderkey", index.cast("long").alias("grid_idx"), r6(metrics.grid_value(index)).alias("threshold"))


@query("c15_iso_date", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date FROM events")
def c15(spark, sf):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", iso_date(seconds).alias("date"))


@query("c16_short_labels", "SELECT doc_id, split_part(text, ' ', 1) AS label, replace(source || '/' || lang, '/', '_') AS folder FROM documents")
def c16(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.short_label(F.col("text")).alias("label"), text.folder_name(F.concat_ws("/", "source", "lang")).alias("folder"))

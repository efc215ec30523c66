"""Composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.catalog import views
from driftwood.catalog.aggregates import A9_SQL, PAIR_BIN_SQL, WEIGHTED_SQL, density_sql
from driftwood.catalog.python_sources import (
    EXPECTED, PLAIN, SOURCES, VERSIONS, file_versions, filled, sources, values,
)
from driftwood.catalog.registry import query, r6, table
from driftwood.catalog.windows import packing_sql
from driftwood.functions import text
from driftwood.operators import extract
from driftwood.operators.tokens import words
from driftwood.plans import (
    comparison, corpus_check, corpus_profile, corpus_rewrite, dataset, scoring, training_blocks, tuning, version_history,
)
from driftwood.session import materialise

# --- extraction and history ---------------------------------------------------------------------------


@query("x1_function_extraction", f"WITH {EXPECTED} SELECT doc_id, node, name, start_line, end_line, docstring, trivial, code FROM b_found")
def x1(spark, sf):
    return extract.extract_functions(sources(spark, sf))


@query("x1_mined_functions", f"WITH {EXPECTED} SELECT doc_id, node, name, docstring, code FROM b_mined")
def x1_mined(spark, sf):
    return extract.documented_functions(extract.extract_functions(sources(spark, sf))).select("doc_id", "node", "name", "docstring", "code")


@query("x2_versions", f"""
WITH {VERSIONS}
SELECT id, commit, date, code, docstring, code_updated, docstring_updated, code_similarity, docstring_similarity, function, last_version FROM b_mined_versions
""")
def x2(spark, sf):
    versions = version_history.version_history(file_versions(spark, sf)).versions
    return (
        versions.withColumn("date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"))
        .withColumn("code_similarity", r6("code_similarity")).withColumn("docstring_similarity", r6("docstring_similarity"))
    )


@query("x2_files_and_functions", f"""
WITH {VERSIONS}
SELECT f.file, md5(p.repo) AS repo, 'src/' || p.doc_id || '.py' AS path, f.function, f.name FROM (SELECT DISTINCT file, function, name FROM b_linked) f JOIN b_keyed p ON p.file = f.file
""")
def x2_entities(spark, sf):
    entities = version_history.version_history(file_versions(spark, sf))
    functions = entities.functions.withColumnRenamed("id", "function")
    return functions.join(entities.files.withColumnRenamed("id", "file"), "file").select("file", "repo", "path", "function", "name")


# --- dataset ------------------------------------------------------------------------------------------

DATASET_SQL = f"""
WITH {views.CHAIN},
b_clean AS (SELECT id, repo_name, docstring, E'def f_' || split_part(id, '|', 1) || E'(x):\\n    return x + ' || split_part(id, '|', 2) AS c FROM b_wide WHERE last_version IS NOT NULL),
b_rest AS (SELECT * FROM b_clean WHERE repo_name <> (SELECT repo_name FROM b_clean ORDER BY md5('42|' || id) LIMIT 1)),
b_even AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY md5('43|' || id)) AS r FROM b_rest) ORDER BY r, repo_name LIMIT (SELECT count(*) // 3 FROM b_rest)),
b_parts AS (SELECT *, substr(md5('44|' || id), 1, 8) <= 'cccccccc' AS is_train FROM b_even),
b_test AS (SELECT *, row_number() OVER (ORDER BY md5('45|' || id)) - 1 AS i FROM b_parts WHERE NOT is_train),
b_samples AS (
  SELECT 'train' AS part, true AS l, c, docstring AS d FROM b_parts WHERE is_train
  UNION ALL SELECT 'test', true, c, docstring FROM b_test
  UNION ALL SELECT 'test', false, a.c, CASE WHEN a.docstring <> b.docstring THEN b.docstring WHEN a.docstring = lo THEN hi ELSE lo END
  FROM b_test a JOIN b_test b ON b.i = (a.i + 1) % (SELECT count(*) FROM b_test), (SELECT min(docstring) AS lo, max(docstring) AS hi FROM b_test) WHERE a.docstring <> b.docstring OR lo <> hi
)"""


@query("x3_dataset", DATASET_SQL + r"""
SELECT part, l, c, d, '<|fim_prefix|>' || split_part(c, E'\n', 1) || E'\n\n    \"\"\"<|fim_suffix|>\"\"\"\n    ' || split_part(c, E'\n', 2) || '<|fim_middle|>' || d || '<|file_separator|>' AS e FROM b_samples
""")
def x3(spark, sf):
    cut = dataset.cut_entities(*views.chain_tables(spark, sf), share=1 / 3)
    train = dataset.training_samples(cut.train).withColumn("part", F.lit("train"))
    return train.unionByName(dataset.test_samples(cut.test).withColumn("part", F.lit("test")))


@query("x3_held_out", DATASET_SQL + "SELECT repo_name, count(*) AS rows FROM b_clean WHERE id NOT IN (SELECT id FROM b_rest) GROUP BY repo_name")
def x3_held(spark, sf):
    cut = dataset.cut_entities(*views.chain_tables(spark, sf))
    return cut.held_out.groupBy("repo_name").agg(F.count(F.lit(1)).alias("rows"))


# --- profile ------------------------------------------------------------------------------------------

PROFILE_SQL = f"""
WITH {views.CHAIN},
b_profiled AS (SELECT * FROM b_wide),
rs AS (SELECT repo_name, min(stars) AS stars, min(watchers) AS watchers, min(forks) AS forks, min(contributors) AS contributors, min(open_issues) AS open_issues,
  min(contributions) AS contributions, min(size) AS sizes, count(DISTINCT function_name) AS functions, count(DISTINCT id) AS versions FROM b_profiled GROUP BY repo_name),
vs AS (SELECT id, length('def f_' || split_part(id, '|', 1) || E'(x):\\n    return x + ' || split_part(id, '|', 2)) AS code_lengths, length(docstring) AS docstring_lengths, code_similarity, docstring_similarity FROM b_profiled)"""
REPOSITORY_LONG = "rl AS (SELECT repo_name, metric, value::DOUBLE AS value FROM (UNPIVOT rs ON " + ", ".join(corpus_profile.REPOSITORY_METRICS) + " INTO NAME metric VALUE value))"
VERSION_LONG = "vl AS (SELECT id, metric, value::DOUBLE AS value FROM (UNPIVOT (SELECT id, code_lengths::DOUBLE AS code_lengths, docstring_lengths::DOUBLE AS docstring_lengths, code_similarity, docstring_similarity FROM vs) ON " + ", ".join(corpus_profile.VERSION_METRICS) + " INTO NAME metric VALUE value))"


@query("x4_corpus_profile", f"""
{PROFILE_SQL}, {REPOSITORY_LONG}, {VERSION_LONG}, {density_sql('rl', '_r')}, {density_sql('vl', '_v')}
SELECT 'repositories' AS level, metric, grid_idx, round(x, 4) AS x, round(density * 1000, 6) AS density, round(CASE WHEN x > 0 THEN log10(x) END, 4) AS log_x FROM density_r
UNION ALL SELECT 'versions', metric, grid_idx, round(x, 4), round(density * 1000, 6), round(CASE WHEN x > 0 THEN log10(x) END, 4) FROM density_v
""")
def x4(spark, sf):
    wide = corpus_profile.profiled_table(*views.chain_tables(spark, sf))
    return corpus_profile.densities(wide).select(
        "level", "metric", F.col("grid_idx").cast("long").alias("grid_idx"), F.round("x", 4).alias("x"),
        r6(F.col("density") * 1000).alias("density"), F.round("log_x", 4).alias("log_x"))


@query("x4_pair_densities", f"""
{PROFILE_SQL}, {REPOSITORY_LONG}, {VERSION_LONG},
long AS (SELECT 'repositories' AS level, repo_name AS k, metric, value FROM rl UNION ALL SELECT 'versions', id, metric, value FROM vl),
p AS (SELECT a.metric AS metric_x, b.metric AS metric_y, a.value AS x, b.value AS y FROM long a JOIN long b ON a.level = b.level AND a.k = b.k AND a.metric <> b.metric),
{PAIR_BIN_SQL}
SELECT CASE WHEN metric_x IN ('code_lengths', 'docstring_lengths', 'code_similarity', 'docstring_similarity') THEN 'versions' ELSE 'repositories' END AS level, * FROM pair_bins
""")
def x4_pairs(spark, sf):
    wide = corpus_profile.profiled_table(*views.chain_tables(spark, sf))
    bins = corpus_profile.pair_densities(wide)
    return bins.withColumn("x_bin", F.col("x_bin").cast("long")).withColumn("y_bin", F.col("y_bin").cast("long"))


# --- scoring ------------------------------------------------------------------------------------------


def vector_generations(spark, sf):
    """A generated text per model, item and sample, as a model would return it."""
    models = F.array(*[F.lit(m) for m in views.MODELS])
    raw = F.concat(F.lit(text.MIDDLE + " item "), F.col("item_idx").cast("string"), F.lit(" of "), "mid", F.lit(' """'))
    return (
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_idx"), F.explode(models).alias("mid"))
        .withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("text", raw)
    )


def result_columns(df, *extra):
    def bounded(name):
        return r6(name).alias(name)

    return df.select(*extra, "mid", "item_idx", "out_of_date", "updated_docstring", bounded("docstring_score"), bounded("updated_docstring_score"))


DISTANCE_RESULT = """
SELECT mid, item_idx, ratio <= 1.0 AS out_of_date, 'item ' || item_idx || ' of ' || mid AS updated_docstring,
  round(docstring_score, 6) AS docstring_score, round(updated_docstring_score, 6) AS updated_docstring_score
FROM b_ratio WHERE distance_function = 'euclidean' AND normalize AND sample_many"""
DISTANCE = scoring.DistanceParameters(1.0, "euclidean", True, True)


@query("x5_distance_scoring", f"WITH {views.VECTORS} {DISTANCE_RESULT}")
def x5(spark, sf):
    return result_columns(scoring.score_by_distance(views.embeddings(spark, sf)[0], vector_generations(spark, sf), DISTANCE))


PREDICTION_RESULT = f"""
WITH {WEIGHTED_SQL}
SELECT 'base' AS mid, a.item_idx, a.score / b.score <= 1.0 AS out_of_date, trim(split_part(text || '\"\"\"', '\"\"\"', 1), E' \\n') AS updated_docstring, round(a.score, 6) AS docstring_score, round(b.score, 6) AS updated_docstring_score
FROM b_scores a JOIN b_scores b ON b.item_idx = a.item_idx AND b.role = 'gen' JOIN documents ON doc_id = a.item_idx WHERE a.role = 'doc'
"""


def prediction_inputs(spark, sf):
    """The generated text is cut at the first three quotes: one that ends in a quote loses it to them."""
    generated = table(spark, sf, "documents").select(
        F.lit("base").alias("mid"), F.lit(0).alias("sample_idx"), F.col("doc_id").alias("item_idx"),
        F.concat(F.lit(text.MIDDLE), "text", F.lit('"""')).alias("text"))
    return *views.token_inputs(spark, sf), generated, scoring.PredictionParameters(1.0, 0.3, 0.7)


@query("x6_probability_scoring", PREDICTION_RESULT)
def x6(spark, sf):
    return result_columns(scoring.score_by_probability(*prediction_inputs(spark, sf)))


@query("x7_update_only", f"""
WITH {views.GENERATIONS}
SELECT mid, item_idx, NULL::BOOLEAN AS out_of_date, text AS updated_docstring, NULL::DOUBLE AS docstring_score, NULL::DOUBLE AS updated_docstring_score FROM b_gen WHERE sample_idx = 0
""")
def x7(spark, sf):
    return scoring.update_only(views.generations(spark, sf))


@query("e1_scorers", f"""
WITH {views.VECTORS}
SELECT 'distance' AS method, * FROM ({DISTANCE_RESULT})
UNION ALL SELECT 'prediction', * FROM ({PREDICTION_RESULT})
UNION ALL SELECT 'update', m.mid, vec_id, NULL, 'item ' || vec_id || ' of ' || m.mid, NULL, NULL FROM embeddings, (VALUES ('base'), ('tuned')) m(mid)
""")
def e1(spark, sf):
    """Three scorers chosen by name, one result schema."""
    generated = vector_generations(spark, sf)
    inputs = {"distance": (views.embeddings(spark, sf)[0], generated, DISTANCE), "prediction": prediction_inputs(spark, sf), "update": (generated,)}
    parts = [scoring.scorer(method)(*given).withColumn("method", F.lit(method)) for method, given in inputs.items()]
    return result_columns(parts[0].unionByName(parts[1]).unionByName(parts[2]), "method")


# --- the check ------------------------------------------------------------------------------------------

CHECK_SQL = """
WITH {expected}, b_scored_items AS ({scored})
SELECT f.doc_id, f.name, f.start_line, coalesce(NOT s.out_of_date, false) AS up_to_date
FROM b_found f LEFT JOIN b_scored_items s ON s.mid = 'base' AND s.item_idx = f.doc_id AND f.docstring <> ''
"""


def _check(spark, sf, method, *inputs):
    """The number of a function's item is that of its document."""
    files = sources(spark, sf)
    items = files.select("doc_id", F.col("doc_id").alias("item_idx"))
    checked = corpus_check.check_corpus(files, ["doc_id", "start_line"], items, ["doc_id"], method, "base", *inputs)
    return checked.select("doc_id", "name", "start_line", "up_to_date")


@query("x14_corpus_check", CHECK_SQL.format(expected=EXPECTED, scored=f"WITH {views.VECTORS} {DISTANCE_RESULT}"))
def x14(spark, sf):
    return _check(spark, sf, "distance", views.embeddings(spark, sf)[0], vector_generations(spark, sf), DISTANCE)


@query("x14_corpus_check_by_probability", CHECK_SQL.format(expected=EXPECTED, scored=PREDICTION_RESULT))
def x14_by_probability(spark, sf):
    return _check(spark, sf, "prediction", *prediction_inputs(spark, sf))


# --- tuning and comparison ------------------------------------------------------------------------------


@query("x8_threshold_tuning", f"""
WITH {views.VECTORS}
SELECT mid, distance_function, normalize, sample_many, grid_idx, tp, tn, fp, fn, round(p4, 6) AS p4, round(mcc, 6) AS mcc FROM b_scored
""")
def x8(spark, sf):
    tuned = tuning.tune(*views.embeddings(spark, sf))
    return tuned.select("mid", "distance_function", "normalize", "sample_many", F.col("grid_idx").cast("long").alias("grid_idx"),
                        "tp", "tn", "fp", "fn", r6("p4").alias("p4"), r6("mcc").alias("mcc"))


@query("x9_fixed_threshold", f"""
WITH {views.VECTORS},
d AS (SELECT item_idx FROM b_items ORDER BY md5('1337|' || item_idx) LIMIT 300),
c AS (SELECT mid, distance_function, normalize, sample_many, count(*) FILTER (l AND ratio <= 0.99) AS tp, count(*) FILTER (NOT l AND NOT ratio <= 0.99) AS tn,
  count(*) FILTER (NOT l AND ratio <= 0.99) AS fp, count(*) FILTER (l AND NOT ratio <= 0.99) AS fn
  FROM b_ratio JOIN d USING (item_idx) WHERE distance_function = 'euclidean' AND NOT normalize AND sample_many GROUP BY ALL)
SELECT *, round(4.0::DOUBLE * tp * tn / nullif(4.0::DOUBLE * tp * tn + (tp + tn) * (fp + fn), 0), 6) AS p4 FROM c
""")
def x9(spark, sf):
    confirmed = tuning.confirm(*views.embeddings(spark, sf), 0.99, "euclidean", False, True, 300, 1337)
    return confirmed.drop("mcc").withColumn("p4", r6("p4"))


@query("x10_model_comparison", f"""
WITH {views.LABELED}, {views.RATINGS},
s AS (SELECT doc_id FROM b_labeled WHERE NOT l ORDER BY md5('42|' || doc_id) LIMIT 100),
v AS (SELECT judge, verdict FROM b_votes WHERE doc_id IN (SELECT doc_id FROM s)),
n(verdict, sort) AS (VALUES ('docstring-0_better', 0), ('docstring-1_better', 1), ('docstring-2_better', 2), ('none_fit', 3), ('total', 4))
SELECT n.verdict, count(v.verdict) FILTER (judge = 'first') AS first, count(v.verdict) FILTER (judge = 'second') AS second
FROM n LEFT JOIN v ON n.verdict = v.verdict OR (n.verdict = 'total' AND v.verdict IS NOT NULL) GROUP BY n.verdict
""")
def x10(spark, sf):
    judged = comparison.stale_batches(views.labeled(spark, sf).select("doc_id", "c", "d", "l"), ["doc_id"], 100, 25)
    return comparison.compare(views.ratings(spark, sf), judged, ["doc_id"], ["first", "second"])


@query("x10_stale_batches", f"""
WITH {views.LABELED}, s AS (SELECT doc_id, c, d, row_number() OVER (ORDER BY md5('42|' || doc_id)) - 1 AS i FROM b_labeled WHERE NOT l ORDER BY i LIMIT 100)
SELECT doc_id, c, d, i // 25 AS batch, i % 25 AS slot FROM s
""")
def x10_batches(spark, sf):
    return comparison.stale_batches(views.labeled(spark, sf).select("doc_id", "c", "d", "l"), ["doc_id"], 100, 25).drop("l")


# --- tokens -------------------------------------------------------------------------------------------


@query("x11_token_weights", A9_SQL + """, g AS (SELECT * FROM f WHERE frequency > 0),
ids AS (SELECT token, frequency, row_number() OVER (ORDER BY md5('42|' || token), token) - 1 AS token_id FROM g)
SELECT token_id, token, frequency, round(1.0::DOUBLE - ln(frequency + 1 + 1e-16::DOUBLE) / (SELECT max(ln(frequency + 1 + 1e-16::DOUBLE)) FROM ids), 6) AS weight FROM ids
""")
def x11(spark, sf):
    """Weights from the good samples alone, the vocabulary being theirs."""
    weights = training_blocks.token_weight_table(views.labeled(spark, sf).filter("l").select("d"))
    return weights.withColumn("weight", r6("weight"))


def _blocks_sql(part: str, where: str) -> str:
    return f"""SELECT * FROM (WITH {packing_sql('carry', where, eos=True)},
      b_sums AS (SELECT bucket, block, coalesce(sum(list_sum(list_transform(w, lambda x: length(x) + 1000))), 0)::BIGINT AS ids FROM b_fold JOIN b_slot USING (bucket, slot) GROUP BY ALL)
      SELECT '{part}' AS part, bucket, block::BIGINT AS block, 512::BIGINT AS length, 512 - tokens + ended AS ends, ids + 512 - tokens + ended AS checksum
      FROM b_blocks JOIN b_sums USING (bucket, block))"""


@query("x12_training_blocks", f"""
{_blocks_sql('train', "substr(md5('421337|' || doc_id), 1, 8) > '19999999'")}
UNION ALL {_blocks_sql('test', "substr(md5('421337|' || doc_id), 1, 8) <= '19999999'")}
""")
def x12(spark, sf):
    """A word's id is its length plus 1000, the end mark is 1."""
    sequences = views.code(spark, sf).select("doc_id", F.transform(words(F.col("d")), lambda w: F.length(w) + 1000).alias("input_ids"))
    blocks = training_blocks.training_blocks(sequences, ["doc_id"], 1)
    total = F.aggregate("labels", F.lit(0).cast("long"), lambda s, x: s + x)
    return blocks.select("part", "bucket", F.col("block").cast("long").alias("block"), F.size("input_ids").cast("long").alias("length"),
                         F.size(F.filter("input_ids", lambda t: t == 1)).cast("long").alias("ends"), total.alias("checksum"))


# --- rewriting ----------------------------------------------------------------------------------------

NEW = '    """\n    New for line {line}\n    """\n'


def _rewritten() -> list[tuple[int, str]]:
    """Each kind of source after all its docstrings were replaced."""
    def block(line):
        return NEW.replace("{line}", str(line))

    one = '    """{d}"""\n'
    result = [source.replace(one, block(3), 1) if kind in (0, 2, 3, 4) else source for kind, source in enumerate(SOURCES)]
    result[1] = SOURCES[1].replace("    '''\n    {d}\n\n    Second line.\n    '''\n", block(4))
    result[6] = SOURCES[6].replace('    """Kept. {d}"""\n', block(7))
    result[7] = SOURCES[7].replace('        """{d}"""\n', block(4)).replace('        """Two. {d}"""\n', block(9))
    result[8] = SOURCES[8].replace(one, block(3), 1).replace('        """In. {d}"""\n', block(5))
    return list(enumerate(result))


# kind, name, start, docstring start and end, end after the rewriting
MOVED = [
    (0, "f_{id}", 3, 4, 6, 7), (1, "f_{id}", 4, 5, 7, 8), (2, "f_{id}", 3, 4, 6, 7), (3, "f_{id}", 3, 4, 6, 7), (4, "f_{id}", 3, 4, 6, 6),
    (5, "f_{id}", 3, None, None, 4), (6, "f_{id}", 7, 10, 12, 13), (7, "m_{id}", 4, 5, 7, 8), (7, "m_{id}", 11, 12, 14, 16),
    (8, "outer_{id}", 3, 4, 6, 12), (8, "inner_{id}", 7, 8, 10, 11),
]


def _rewrite(spark, sf):
    files = sources(spark, sf)
    located = materialise(extract.located_functions(extract.extract_functions(files)), "located")
    updated = located.select("doc_id", "start_line", F.concat(F.lit("New for line "), F.col("start_line").cast("string")).alias("updated_docstring"))
    return corpus_rewrite.rewrite_corpus(files, located, updated, ["doc_id", "start_line"], "doc_id")


@query("x13_rewritten_files", f"WITH {PLAIN} SELECT doc_id, {filled('source')} AS source FROM b_plain JOIN {values(_rewritten())} t(kind, source) ON kind = doc_id % 10")
def x13(spark, sf):
    return _rewrite(spark, sf)[0].select("doc_id", "source")


@query("x13_moved_lines", f"""
WITH {PLAIN}
SELECT doc_id, {filled('name')} AS name, start_line, doc_start, doc_end, end_line FROM b_plain JOIN {values(MOVED)} t(kind, name, start_line, doc_start, doc_end, end_line) ON kind = doc_id % 10
""")
def x13_lines(spark, sf):
    return _rewrite(spark, sf)[1].select(
        "doc_id", "name", F.col("new_start_line").alias("start_line"), F.col("new_docstring_start_line").alias("doc_start"),
        F.col("new_docstring_end_line").alias("doc_end"), F.col("new_end_line").alias("end_line"))



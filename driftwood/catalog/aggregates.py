"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.catalog import views
from driftwood.catalog.joins import ORDER_METRICS, ORDER_SQL, order_metrics
from driftwood.catalog.registry import query, r6, table
from driftwood.functions.text import VERDICT_MARKS
from driftwood.operators import profile
from driftwood.operators.confusion import threshold_curve, with_scores
from driftwood.operators.relations import stage_counts, sum_of_optional, wide_table
from driftwood.operators.tokens import count_tokens, geometric_means, token_weights, vocabulary
from driftwood.operators.votes import tally
from driftwood.operators.selection import group_lower_medians
from driftwood.plans.scoring import pair_similarities
from driftwood.plans.training_blocks import token_weight_table
from driftwood.session import materialise
from driftwood.plans.tuning import labelled_ratios


@query("a1_contributor_totals", """
SELECT c_custkey, count(o_orderkey) AS contributors, coalesce(sum(o_orderkey % 100), 0)::BIGINT AS contributions
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def a1(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    people = table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return profile.contributor_totals(people, "c_custkey", F.col("o_orderkey") % 100)


REPOSITORY_SQL = f"""
WITH {views.CHAIN}
SELECT repo_name, min(stars) AS stars, min(watchers) AS watchers, min(forks) AS forks, min(contributors) AS contributors,
  min(open_issues) AS open_issues, min(contributions) AS contributions, min(size) AS sizes,
  count(DISTINCT function_name) AS functions, count(DISTINCT id) AS versions
FROM b_wide GROUP BY repo_name
"""


@query("a2_repository_metrics", f"SELECT repo_name, stars, watchers, forks, contributors, open_issues, contributions, sizes FROM ({REPOSITORY_SQL})")
def a2(spark, sf):
    return profile.repository_statistics(wide_table(*views.chain_tables(spark, sf))).drop("functions", "versions")


@query("a3_distinct_per_repository", f"SELECT repo_name, functions, versions FROM ({REPOSITORY_SQL})")
def a3(spark, sf):
    return profile.repository_statistics(wide_table(*views.chain_tables(spark, sf))).select("repo_name", "functions", "versions")


@query("a3_distinct_sketches", f"SELECT repo_name, true AS functions_near, true AS versions_near FROM ({REPOSITORY_SQL})")
def a3_sketches(spark, sf):
    """Counts of sketches that were kept per shard and united, against the exact ones: within three standard errors."""
    wide = wide_table(*views.chain_tables(spark, sf))
    exact = profile.repository_statistics(wide).select("repo_name", "functions", "versions")
    shards = wide.withColumn("shard", F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(8)))
    kept = materialise(profile.distinct_sketches(shards, ["shard", "repo_name"], {"functions": "function_name", "versions": "id"}), "distinct-sketches")
    united = profile.united_sketches(kept, ["repo_name"], ["functions", "versions"])
    both = exact.join(united.select("repo_name", F.col("functions").alias("f"), F.col("versions").alias("v")), "repo_name")
    allowed = 3 * profile.sketch_error()

    def near(estimate, count):
        return F.abs(F.col(estimate) - F.col(count)) <= F.greatest(F.lit(0.5), F.col(count) * allowed)

    return both.select("repo_name", near("f", "functions").alias("functions_near"), near("v", "versions").alias("versions_near"))


@query("a4_distinct_groups", "SELECT count(DISTINCT source) AS distinct_values FROM documents")
def a4(spark, sf):
    return profile.distinct_values(table(spark, sf, "documents"), "source")


CURVE = "mid, distance_function, normalize, sample_many, grid_idx"


@query("a5_confusion_counts", f"WITH {views.VECTORS} SELECT {CURVE}, round(test_threshold, 6) AS test_threshold, tp, tn, fp, fn FROM b_curve")
def a5(spark, sf):
    curve = threshold_curve(labelled_ratios(*views.embeddings(spark, sf)))
    return curve.withColumn("grid_idx", F.col("grid_idx").cast("long")).withColumn("test_threshold", r6("test_threshold"))


@query("a6_p4_score", f"WITH {views.VECTORS} SELECT {CURVE}, round(p4, 6) AS p4 FROM b_scored")
def a6(spark, sf):
    scored = with_scores(threshold_curve(labelled_ratios(*views.embeddings(spark, sf))))
    return scored.select(*CURVE.split(", ")[:4], F.col("grid_idx").cast("long").alias("grid_idx"), r6("p4").alias("p4"))


@query("a7_matthews_correlation", f"WITH {views.VECTORS} SELECT {CURVE}, round(mcc, 6) AS mcc FROM b_scored")
def a7(spark, sf):
    scored = with_scores(threshold_curve(labelled_ratios(*views.embeddings(spark, sf))))
    return scored.select(*CURVE.split(", ")[:4], F.col("grid_idx").cast("long").alias("grid_idx"), r6("mcc").alias("mcc"))


@query("a8_lower_median", f"""
WITH {views.VECTORS}
SELECT mid, item_idx, round(quantile_disc(cg, 0.5), 6) AS cosine, round(quantile_disc(eg, 0.5), 6) AS euclidean FROM b_pairs GROUP BY mid, item_idx
""")
def a8(spark, sf):
    pairs = pair_similarities(views.embeddings(spark, sf)[0]).filter(F.col("role") == "gen")
    medians = group_lower_medians(pairs, ["mid", "item_idx"], ["cosine", "euclidean"])
    return medians.withColumn("cosine", r6("cosine")).withColumn("euclidean", r6("euclidean"))


# Frequencies in labelled documents over the vocabulary of all documents, so that some tokens have none.
A9_SQL = f"""
WITH {views.TOKENS},
f AS (SELECT v.token, v.token_id, count(t.token) AS frequency
      FROM b_vocab v LEFT JOIN (SELECT token FROM b_tok WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) t ON t.token = v.token GROUP BY ALL)
"""


def _labelled_weights(spark, sf):
    good = views.labeled(spark, sf).filter("l")
    return token_weight_table(good, vocabulary(count_tokens(views.tokens(spark, sf))))


@query("a9_token_frequencies", A9_SQL + "SELECT token_id, token, frequency FROM f")
def a9(spark, sf):
    return _labelled_weights(spark, sf).select("token_id", "token", "frequency")


@query("a10_inverse_log_frequency", A9_SQL + """
SELECT token_id, round(1.0::DOUBLE - ln(frequency + 1 + 1e-16::DOUBLE) / (SELECT max(ln(frequency + 1 + 1e-16::DOUBLE)) FROM f), 6) AS weight FROM f
""")
def a10(spark, sf):
    return _labelled_weights(spark, sf).select("token_id", r6("weight").alias("weight"))


# A weight decay of 0.3 and a frequency importance of 0.7 throughout.
WEIGHTED_SQL = views.TOKENS + """,
b_raw AS (
  SELECT *, 1 - pow(pos::DOUBLE / greatest(n_tokens - 1, 1), tan(0.7::DOUBLE * pi() / 2)) AS pw, 1 + 0.7::DOUBLE * (weight - 1) AS fw FROM b_probs
),
b_scores AS (
  SELECT item_idx, role, exp(sum(pw * fw * ln(prob)) / nullif(sum(pw * fw), 0)) AS score FROM b_raw GROUP BY item_idx, role
)"""


@query("a11_weighted_geometric_mean", f"WITH {WEIGHTED_SQL} SELECT item_idx, role, round(score, 6) AS score FROM b_scores")
def a11(spark, sf):
    weighted = token_weights(*views.token_inputs(spark, sf), ["mid", "item_idx", "role"], 0.3, 0.7)
    return geometric_means(weighted, ["item_idx", "role"]).withColumn("score", r6("score"))


@query("a12_judge_votes", f"""
WITH {views.RATINGS}, names(verdict) AS (VALUES {', '.join(f"('{m}')" for m in VERDICT_MARKS)})
SELECT j.judge, n.verdict, count(v.verdict) AS votes FROM (SELECT DISTINCT judge FROM b_ratings) j CROSS JOIN names n
  LEFT JOIN b_votes v ON v.judge = j.judge AND v.verdict = n.verdict GROUP BY ALL
UNION ALL SELECT judge, 'total', count(verdict) FROM b_votes GROUP BY judge
""")
def a12(spark, sf):
    return tally(views.ratings(spark, sf))


@query("a13_usage_sum", """
SELECT event_type, sum(k)::BIGINT AS total, count(k) AS counted
FROM (SELECT event_type, nullif(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5, 0) AS k FROM events) GROUP BY event_type
""")
def a13(spark, sf):
    counter = F.nullif(F.get_json_object("props", "$.k").cast("int") % 5, F.lit(0))
    return sum_of_optional(table(spark, sf, "events"), ["event_type"], counter)


def density_sql(source: str, tag: str = "") -> str:
    """Binned Gaussian density of a (metric, value) relation."""
    return f"""
rg{tag} AS (SELECT metric, count(value) AS n, min(value) AS low, max(value) AS high, stddev_samp(value) AS sd FROM {source} GROUP BY metric HAVING count(value) > 1 AND stddev_samp(value) > 0),
bn{tag} AS (SELECT metric, coalesce(least(floor((value - low) / nullif((high - low) / 200, 0)), 199), 0)::INT AS bin, count(*) AS rows FROM {source} JOIN rg{tag} USING (metric) WHERE value IS NOT NULL GROUP BY ALL),
sc{tag} AS (SELECT metric, g.i AS grid_idx, n, rows, sd * pow(n::DOUBLE, -0.2) AS bw, low + (bin + 0.5::DOUBLE) * ((high - low) / 200) AS centre,
  low - 3 * sd * pow(n::DOUBLE, -0.2) + g.i * ((high - low + 6 * sd * pow(n::DOUBLE, -0.2)) / 199) AS x FROM bn{tag} JOIN rg{tag} USING (metric), range(200) g(i)),
density{tag} AS (SELECT metric, grid_idx, min(x) AS x, max(bw) AS bw, sum(rows / (n * bw * sqrt(2.0::DOUBLE * pi())) * exp(-0.5::DOUBLE * ((x - centre) / bw) * ((x - centre) / bw))) AS density FROM sc{tag} GROUP BY ALL)"""


@query("a14_metric_density", f"""
WITH {ORDER_SQL}, {density_sql('long')}
SELECT metric, grid_idx, round(x, 4) AS x, round(density * 1000, 6) AS density, round(CASE WHEN x > 0 THEN log10(x) END, 6) AS log_x FROM density
""")
def a14(spark, sf):
    curve = profile.density(profile.long_metrics(order_metrics(spark, sf), ORDER_METRICS))
    return curve.select("metric", F.col("grid_idx").cast("long").alias("grid_idx"), F.round("x", 4).alias("x"),
                        r6(F.col("density") * 1000).alias("density"), r6("log_x").alias("log_x"))


PAIR_SQL = """
p AS (SELECT a.metric AS metric_x, b.metric AS metric_y, a.value AS x, b.value AS y FROM long a JOIN long b ON a.o_orderkey = b.o_orderkey AND a.metric <> b.metric)"""
PAIR_BIN_SQL = """
pr AS (SELECT metric_x, metric_y, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM p GROUP BY ALL),
pair_bins AS (SELECT metric_x, metric_y, coalesce(least(floor((x - xl) / nullif((xh - xl) / 50, 0)), 49), 0)::BIGINT AS x_bin,
  coalesce(least(floor((y - yl) / nullif((yh - yl) / 50, 0)), 49), 0)::BIGINT AS y_bin, count(*) AS rows FROM p JOIN pr USING (metric_x, metric_y) GROUP BY ALL)"""


@query("a15_pair_density", f"WITH {ORDER_SQL}, {PAIR_SQL}, {PAIR_BIN_SQL} SELECT * FROM pair_bins")
def a15(spark, sf):
    bins = profile.pair_density(order_metrics(spark, sf), ORDER_METRICS)
    return bins.withColumn("x_bin", F.col("x_bin").cast("long")).withColumn("y_bin", F.col("y_bin").cast("long"))


SMOOTH_SQL = """
ps AS (SELECT metric_x, metric_y, count(*) AS n, (max(x) - min(x)) / 50 / (stddev_samp(x) * pow(count(*)::DOUBLE, -1.0::DOUBLE / 6)) AS xs,
  (max(y) - min(y)) / 50 / (stddev_samp(y) * pow(count(*)::DOUBLE, -1.0::DOUBLE / 6)) AS ys FROM p GROUP BY ALL HAVING count(*) > 1 AND stddev_samp(x) > 0 AND stddev_samp(y) > 0),
sx AS (SELECT metric_x, metric_y, g.i AS x_bin, y_bin, ys, sum(rows::DOUBLE / n * xs / sqrt(2.0::DOUBLE * pi()) * exp(-0.5::DOUBLE * ((g.i - x_bin) * xs) * ((g.i - x_bin) * xs))) AS v
  FROM pair_bins JOIN ps USING (metric_x, metric_y), range(50) g(i) GROUP BY ALL),
smooth AS (SELECT metric_x, metric_y, x_bin, g.i AS y_bin, sum(v * ys / sqrt(2.0::DOUBLE * pi()) * exp(-0.5::DOUBLE * ((g.i - y_bin) * ys) * ((g.i - y_bin) * ys))) AS density
  FROM sx, range(50) g(i) GROUP BY ALL)"""


@query("a15_smoothed_pair_density", f"WITH {ORDER_SQL}, {PAIR_SQL}, {PAIR_BIN_SQL}, {SMOOTH_SQL} SELECT metric_x, metric_y, x_bin, y_bin, round(density, 8) AS density FROM smooth")
def a15_smooth(spark, sf):
    smooth = profile.smoothed_pair_density(order_metrics(spark, sf), ORDER_METRICS)
    return smooth.select("metric_x", "metric_y", F.col("x_bin").cast("long").alias("x_bin"), F.col("y_bin").cast("long").alias("y_bin"), F.round("density", 8).alias("density"))


@query("a15_pair_correlation", f"WITH {ORDER_SQL}, {PAIR_SQL} SELECT metric_x, metric_y, round(corr(x, y), 6) AS correlation FROM p GROUP BY ALL")
def a15_corr(spark, sf):
    return profile.pair_correlation(profile.metric_pairs(order_metrics(spark, sf), ORDER_METRICS)).withColumn("correlation", r6("correlation"))


@query("a16_stage_counts", """
SELECT 'documents' AS stage, count(*) AS rows FROM documents UNION ALL SELECT 'labels', count(*) FROM labels
UNION ALL SELECT 'labelled documents', count(*) FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'stale', count(*) FROM documents JOIN labels USING (doc_id) WHERE quality <> 1
""")
def a16(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return stage_counts({
        "documents": table(spark, sf, "documents"), "labels": table(spark, sf, "labels"),
        "labelled documents": labelled, "stale": labelled.filter("quality <> 1"),
    })

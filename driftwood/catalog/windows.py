"""Ordered operators: chains, thresholds, batches and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.catalog import views
from driftwood.catalog.aggregates import CURVE, WEIGHTED_SQL
from driftwood.catalog.python_sources import ratio_sql
from driftwood.catalog.registry import query, r6, table
from driftwood.operators import chains
from driftwood.operators.confusion import best_thresholds, marked_curve
from driftwood.operators.hashorder import batches
from driftwood.operators.packing import assign_blocks, fill_blocks
from driftwood.operators.tokens import normalised_weights, position_weight, texts_together, token_weights, words
from driftwood.plans.tuning import tune

CHAIN = ["conv_id"]


@query("w1_collapsed_versions", f"""
WITH {views.HISTORY}
SELECT conv_id, seq, code FROM (SELECT *, lag(code) OVER (PARTITION BY conv_id ORDER BY seq) AS p FROM b_history) WHERE p IS NULL OR p <> code
""")
def w1(spark, sf):
    history = views.history(spark, sf)
    return chains.collapse_unchanged(history, CHAIN, ["seq"], "code").select("conv_id", "seq", "code")


KEPT_SQL = views.HISTORY + f""",
b_lagged AS (SELECT *, lag(code) OVER o AS pc, lag(docstring) OVER o AS pd FROM b_history WINDOW o AS (PARTITION BY conv_id ORDER BY seq)),
b_kept AS (
  SELECT conv_id, seq, code, docstring, pc <> code AS code_updated, pd <> docstring AS docstring_updated,
    CASE WHEN pc IS NOT NULL THEN {ratio_sql('pc', 'code')} END AS code_similarity,
    CASE WHEN pd IS NOT NULL THEN {ratio_sql('pd', 'docstring')} END AS docstring_similarity
  FROM b_lagged WHERE pc IS NULL OR pc <> code OR pd <> docstring
)"""


def _kept(spark, sf):
    history = views.history(spark, sf)
    return chains.flag_changes(history, CHAIN, ["seq"])


@query("w2_flagged_changes", f"WITH {KEPT_SQL} SELECT conv_id, seq, code_updated, docstring_updated FROM b_kept")
def w2(spark, sf):
    return _kept(spark, sf).select("conv_id", "seq", "code_updated", "docstring_updated")


@query("w3_chain_pointer", f"WITH {KEPT_SQL} SELECT conv_id, seq, lag(seq) OVER (PARTITION BY conv_id ORDER BY seq) AS last_version FROM b_kept")
def w3(spark, sf):
    kept = _kept(spark, sf).select("conv_id", "seq")
    return chains.link_versions(kept, CHAIN, ["seq"], "seq").select("conv_id", "seq", "last_version")


@query("w4_first_versions", f"""
WITH {KEPT_SQL}
SELECT conv_id, seq, code_updated, code_similarity, docstring_similarity FROM b_kept WHERE code_updated IS NULL
""")
def w4(spark, sf):
    return _kept(spark, sf).filter(F.col("code_updated").isNull()).select("conv_id", "seq", "code_updated", "code_similarity", "docstring_similarity")


BEST_SQL = """
b_best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mid, distance_function, normalize, sample_many ORDER BY p4 DESC NULLS LAST, test_threshold) AS rn FROM b_scored) WHERE rn = 1
)"""
BEST_COLUMNS = f"{CURVE}, tp, tn, fp, fn, round(p4, 6) AS p4, round(test_threshold, 6) AS test_threshold"


def best_columns(df):
    return df.select(*CURVE.split(", ")[:4], F.col("grid_idx").cast("long").alias("grid_idx"), "tp", "tn", "fp", "fn",
                     r6("p4").alias("p4"), r6("test_threshold").alias("test_threshold"))


@query("w5_best_thresholds", f"WITH {views.VECTORS}, {BEST_SQL} SELECT {BEST_COLUMNS} FROM b_best")
def w5(spark, sf):
    return best_columns(best_thresholds(tune(*views.embeddings(spark, sf))))


@query("w6_position_weights", f"""
WITH {views.TOKENS}
SELECT doc_id, pos, token, round(1 - pow(pos::DOUBLE / greatest(n_tokens - 1, 1), tan(0.7::DOUBLE * pi() / 2)), 6) AS position_weight FROM b_tok
""")
def w6(spark, sf):
    weight = position_weight(F.col("pos"), F.col("n_tokens"), 0.3)
    return views.tokens(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), "token", r6(weight).alias("position_weight"))


@query("w7_normalised_weights", f"""
WITH {WEIGHTED_SQL}
SELECT item_idx, pos, token_id, round(pw * fw / nullif(sum(pw * fw) OVER (PARTITION BY item_idx), 0) * 100, 6) AS percent FROM b_raw WHERE role = 'doc'
""")
def w7(spark, sf):
    probabilities, weights = views.token_inputs(spark, sf, ("doc",))
    weighted = token_weights(texts_together(probabilities, ["item_idx"]), weights, ["item_idx"], 0.3, 0.7)
    return normalised_weights(weighted, ["item_idx"]).select(
        "item_idx", F.col("pos").cast("long").alias("pos"), "token_id", r6(F.col("norm_weight") * 100).alias("percent"))


@query("w8_marked_curve", f"""
WITH {views.VECTORS}, {BEST_SQL}
SELECT s.mid, s.distance_function, s.normalize, s.sample_many, s.grid_idx, round(s.p4, 6) AS p4, s.test_threshold = b.test_threshold AS is_local_best,
  s.test_threshold = b.test_threshold AND b.p4 = (SELECT max(p4) FROM b_best) AS is_global_best
FROM b_scored s JOIN b_best b ON s.mid = b.mid AND s.distance_function = b.distance_function AND s.normalize = b.normalize AND s.sample_many = b.sample_many
""")
def w8(spark, sf):
    marked = marked_curve(tune(*views.embeddings(spark, sf)))
    return marked.select(*CURVE.split(", ")[:4], F.col("grid_idx").cast("long").alias("grid_idx"), r6("p4").alias("p4"), "is_local_best", "is_global_best")


@query("w9_batches", """
SELECT doc_id, n_chars, i // 32 AS batch, i % 32 AS slot FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('42|' || doc_id)) - 1 AS i FROM documents)
""")
def w9(spark, sf):
    return batches(table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"], 32)


# Token ids of a text: its words as numbers from a hash, so that no dictionary is needed.
def packing_sql(overflow: str, where: str = "true", seed: int = 42, eos: bool = False) -> str:
    """Next-fit of the texts, in pieces of at most 512 tokens, a thousand per bucket, row by row."""
    spill = "f.block + 1" if overflow == "carry" else "-1"
    used = "s.len" if overflow == "carry" else "0"
    more = "+ 1" if eos else ""
    return views.CODE + f""",
b_seq AS (
  SELECT doc_id, piece, list_slice(w, piece * 512 + 1, piece * 512 + 512) AS w, least(len(w) {more} - piece * 512, 512) AS len,
    CASE WHEN len(w) {more} - piece * 512 <= 512 THEN 0 {more} ELSE 0 END AS ended
  FROM (SELECT doc_id, w, unnest(range(greatest((len(w) {more} + 511) // 512, 1))) AS piece FROM (SELECT doc_id, regexp_extract_all(lower(d), '[a-z]+') AS w FROM b_code WHERE {where}))
),
b_slot AS (
  SELECT doc_id, w, len, ended, i // 1000 AS bucket, i % 1000 AS slot FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || doc_id || '|' || piece)) - 1 AS i FROM b_seq)
),
b_fold AS (
  WITH RECURSIVE f(bucket, slot, block, used, placed) AS (
    SELECT bucket, slot, 0, len, 0 FROM b_slot WHERE slot = 0
    UNION ALL
    SELECT s.bucket, s.slot, CASE WHEN f.used + s.len <= 512 THEN f.block ELSE f.block + 1 END,
      CASE WHEN f.used + s.len <= 512 THEN f.used + s.len ELSE {used} END,
      CASE WHEN f.used + s.len <= 512 THEN f.block ELSE {spill} END
    FROM f JOIN b_slot s ON s.bucket = f.bucket AND s.slot = f.slot + 1
  ) SELECT bucket, slot, placed AS block FROM f WHERE placed >= 0
),
b_blocks AS (
  SELECT bucket, block, count(*) AS sequences, sum(len)::BIGINT AS tokens, sum(ended)::BIGINT AS ended, string_agg(doc_id, ',' ORDER BY slot) AS members
  FROM b_fold JOIN b_slot USING (bucket, slot) GROUP BY ALL
)"""


def sequences(spark, sf):
    return views.code(spark, sf).select("doc_id", F.transform(words(F.col("d")), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(50_000)).cast("int")).alias("input_ids"))


def _blocks(spark, sf, overflow):
    assigned = assign_blocks(sequences(spark, sf), ["doc_id"], overflow=overflow)
    members = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "doc_id"))), lambda r: r["doc_id"].cast("string")), ",")
    listed = assigned.groupBy("bucket", "block").agg(
        F.count(F.lit(1)).alias("sequences"), F.sum(F.size("input_ids")).alias("tokens"), members.alias("members"))
    # The padding has an id no word has, so the tokens of the full block can be counted.
    filled = fill_blocks(assigned, "input_ids", -1).select(
        "bucket", "block", F.size("input_ids").cast("long").alias("length"),
        F.size(F.filter("labels", lambda t: t >= 0)).cast("long").alias("filled"))
    return listed.join(filled, ["bucket", "block"]).withColumn("block", F.col("block").cast("long"))


PACKED_COLUMNS = "bucket, block::BIGINT AS block, sequences, tokens, members, 512::BIGINT AS length, tokens AS filled"


@query("w10_packed_blocks", f"WITH {packing_sql('carry')} SELECT {PACKED_COLUMNS} FROM b_blocks")
def w10(spark, sf):
    return _blocks(spark, sf, "carry")


@query("w10_packed_blocks_dropping", f"WITH {packing_sql('drop')} SELECT {PACKED_COLUMNS} FROM b_blocks")
def w10_drop(spark, sf):
    return _blocks(spark, sf, "drop")

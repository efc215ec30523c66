"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.catalog import views
from driftwood.catalog.registry import query, r6, table
from driftwood.operators import profile, relations
from driftwood.operators.chains import link_versions, with_last_version
from driftwood.operators.hashorder import sample_rows
from driftwood.operators.tokens import token_weights
from driftwood.plans.scoring import setting_ratios

WIDE = ["id", "code_updated", "last_version", "function_name", "filename", "repo_name", "size", "open_issues", "watchers",
        "contributors", "forks", "contributions", "stars"]


@query("j1_wide_table", f"WITH {views.CHAIN} SELECT {', '.join(WIDE)} FROM b_wide")
def j1(spark, sf):
    return relations.denormalise(*views.chain_tables(spark, sf)).select(*WIDE)


@query("j1_orphans", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def j1_orphans(spark, sf):
    orders = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P")
    return relations.orphans(table(spark, sf, "lineitem"), "l_orderkey", orders, "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("j2_previous_version", """
SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS last_version, lag(o_orderstatus) OVER w AS last_o_orderstatus, lag(o_totalprice) OVER w AS last_o_totalprice
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def j2(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    linked = link_versions(orders, ["o_custkey"], ["o_orderdate", "id"])
    return with_last_version(linked, "id", ["o_orderstatus", "o_totalprice"]).select(
        "id", "last_version", "last_o_orderstatus", "last_o_totalprice")


@query("j3_hold_out", """
WITH held AS (SELECT DISTINCT source FROM (SELECT source FROM documents ORDER BY md5('42|' || doc_id) LIMIT 3))
SELECT doc_id, source, source IN (SELECT source FROM held) AS held FROM documents
""")
def j3(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "source")
    held, rest = relations.hold_out(documents, "source", sample_rows(documents, ["doc_id"], 3))
    return held.withColumn("held", F.lit(True)).unionByName(rest.withColumn("held", F.lit(False))).select("doc_id", "source", "held")


@query("j4_items_with_generations", f"""
WITH {views.GENERATIONS}
SELECT c.conv_id AS item_idx, c.turn, c.text AS c, g.mid, g.sample_idx, g.text AS g FROM conversations c JOIN b_gen g ON g.item_idx = c.conv_id
""")
def j4(spark, sf):
    items = table(spark, sf, "conversations").select(F.col("conv_id").alias("item_idx"), "turn", F.col("text").alias("c"))
    return relations.attach_generations(items, views.generations(spark, sf).withColumnRenamed("text", "g"))


@query("j5_setting_grid", f"""
WITH {views.VECTORS}
SELECT mid, distance_function, normalize, sample_many, item_idx, round(ratio / (1 + abs(ratio)), 6) AS ratio FROM b_ratio
""")
def j5(spark, sf):
    ratios = setting_ratios(views.embeddings(spark, sf)[0])
    return ratios.select("mid", "distance_function", "normalize", "sample_many", "item_idx", r6(F.col("ratio") / (1 + F.abs("ratio"))).alias("ratio"))


@query("j6_generation_work_list", """
SELECT doc_id, m.mid, s.s AS sample_idx FROM documents, (VALUES ('base'), ('tuned')) m(mid), range(4) s(s)
""")
def j6(spark, sf):
    work = relations.fan_out(table(spark, sf, "documents").select("doc_id"), ["base", "tuned"], 4)
    return work.withColumn("sample_idx", F.col("sample_idx").cast("long"))


@query("j7_replicated_rows", f"WITH {views.CODE} SELECT doc_id, s.s AS sample_idx, d FROM b_code, range(4) s(s)")
def j7(spark, sf):
    return relations.replicate(views.code(spark, sf).select("doc_id", "d"), 4).withColumn("sample_idx", F.col("sample_idx").cast("long"))


@query("j8_token_weight_lookup", f"""
WITH {views.TOKENS}
SELECT item_idx, role, count(*) AS tokens, round(sum(weight), 6) AS weight FROM b_probs GROUP BY ALL
""")
def j8(spark, sf):
    looked_up = token_weights(*views.token_inputs(spark, sf, weighed=False), ["mid", "item_idx", "role"], 0.5, 1.0)
    return looked_up.groupBy("item_idx", "role").agg(F.count(F.lit(1)).alias("tokens"), r6(F.sum("weight")).alias("weight"))


ORDER_METRICS = ["price", "customer", "day", "number"]
ORDER_SQL = """
m AS (SELECT o_orderkey, o_totalprice AS price, o_custkey::DOUBLE AS customer, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)::DOUBLE AS day,
  (o_orderkey % 1009)::DOUBLE AS number FROM orders),
long AS (UNPIVOT m ON price, customer, day, number INTO NAME metric VALUE value)"""


def order_metrics(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"),
        F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("double").alias("day"), (F.col("o_orderkey") % 1009).cast("double").alias("number"))


@query("j9_metric_pairs", f"""
WITH {ORDER_SQL}
SELECT a.o_orderkey, a.metric AS metric_x, b.metric AS metric_y, round(a.value, 2) AS x, round(b.value, 2) AS y
FROM long a JOIN long b ON a.o_orderkey = b.o_orderkey AND a.metric <> b.metric
""")
def j9(spark, sf):
    pairs = profile.metric_pairs(order_metrics(spark, sf), ORDER_METRICS, ["o_orderkey"])
    return pairs.withColumn("x", F.round("x", 2)).withColumn("y", F.round("y", 2))

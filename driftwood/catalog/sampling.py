"""Sampling, splitting, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.catalog import views
from driftwood.catalog.registry import query, table
from driftwood.catalog.windows import BEST_COLUMNS, BEST_SQL, best_columns
from driftwood.operators import hashorder
from driftwood.operators.confusion import best_setting
from driftwood.plans.dataset import held_out_groups
from driftwood.plans.tuning import tune

DOC = ["doc_id"]


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "text")


@query("r0_dense_index", "SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id)) - 1 AS idx FROM documents")
def r0(spark, sf):
    return hashorder.dense_index(documents(spark, sf).select("doc_id"), DOC, 42)


@query("r1_random_sample", "SELECT doc_id, text FROM documents ORDER BY md5('1337|' || doc_id) LIMIT 512")
def r1(spark, sf):
    return hashorder.sample_rows(documents(spark, sf), DOC, 512, 1337).select("doc_id", "text")


@query("r2_balanced_sample", """
SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42|' || o_orderkey)) AS r FROM orders
) ORDER BY r, o_custkey LIMIT (SELECT count(*) * 3 // 5 FROM orders)
""")
def r2(spark, sf):
    orders = table(spark, sf, "orders")
    sample = hashorder.balanced_sample(orders, "o_custkey", ["o_orderkey"], orders.count() * 3 // 5)
    return sample.select("o_orderkey", "o_custkey", "o_totalprice")


@query("r2_draws_with_replacement", """
WITH n AS (SELECT count(*) AS n FROM orders),
placed AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1 AS idx FROM orders),
hits AS (SELECT ('0x' || substr(md5('43|' || i), 1, 15))::BIGINT % (SELECT n FROM n) AS idx FROM range((SELECT n // 2 FROM n)) r(i))
SELECT o_orderkey, o_custkey, 1 + count(hits.idx) AS copies FROM placed LEFT JOIN hits USING (idx) GROUP BY ALL
""")
def r2_replace(spark, sf):
    """Half as many rows again as there are: each once, the rest drawn with replacement."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n = orders.count()
    sample = hashorder.balanced_sample(orders, "o_custkey", ["o_orderkey"], n + n // 2, replace=True)
    return sample.groupBy("o_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("copies"))


@query("r3_held_out_groups", "SELECT DISTINCT source FROM (SELECT source FROM documents ORDER BY md5('42|' || doc_id) LIMIT 5)")
def r3(spark, sf):
    return held_out_groups(documents(spark, sf), "source", DOC, 5)


@query("r4_train_test_split", "SELECT doc_id, CASE WHEN substr(md5('42|' || doc_id), 1, 8) <= 'cccccccc' THEN 'train' ELSE 'test' END AS part FROM documents")
def r4(spark, sf):
    train, test = hashorder.split_by_hash(documents(spark, sf).select("doc_id"), DOC, 0.8)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("r4_exact_split", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('7|' || o_orderkey)) <= round(0.8 * (SELECT count(*) FROM orders)) THEN 'train' ELSE 'test' END AS part FROM orders
""")
def r4_exact(spark, sf):
    train, test = hashorder.split_by_hash(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.8, 7, exact=True)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("r5_negative_pairs", f"""
WITH {views.CODE}, i AS (SELECT doc_id, c, d, row_number() OVER (ORDER BY md5('42|' || doc_id)) - 1 AS idx FROM b_code),
e AS (SELECT min(d) AS lo, max(d) AS hi FROM b_code),
n AS (SELECT a.doc_id, a.c, CASE WHEN b.d <> a.d THEN b.d WHEN a.d = lo THEN hi ELSE lo END AS d FROM i a JOIN i b ON b.idx = (a.idx + 1) % (SELECT count(*) FROM i), e WHERE b.d <> a.d OR lo <> hi)
SELECT doc_id, c, d, true AS label FROM b_code UNION ALL SELECT doc_id, c, d, false FROM n
""")
def r5(spark, sf):
    return hashorder.with_negatives(views.code(spark, sf).select("doc_id", "c", "d"), DOC, "d")


@query("r6_best_setting", f"""
WITH {views.VECTORS}, {BEST_SQL}
SELECT {BEST_COLUMNS} FROM (SELECT * FROM b_best ORDER BY b_best.p4 DESC NULLS LAST, mid, distance_function, normalize, sample_many, b_best.test_threshold LIMIT 1)
""")
def r6(spark, sf):
    return best_columns(best_setting(tune(*views.embeddings(spark, sf))))


@query("r7_shuffled", "SELECT doc_id, source, text FROM documents ORDER BY md5('42|' || doc_id)")
def r7(spark, sf):
    return hashorder.shuffled(documents(spark, sf), DOC)


@query("u1_bag_union", """
SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id, text FROM conversations
""")
def u1(spark, sf):
    parts = [("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id")]
    rows = [table(spark, sf, name).select(F.col(key).alias("id"), "text") for name, key in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("u2_complement", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE substr(md5('42|' || doc_id), 1, 8) <= 'cccccccc')")
def u2(spark, sf):
    rows = documents(spark, sf).select("doc_id", "source")
    train, _ = hashorder.split_by_hash(rows, DOC, 0.8)
    return rows.join(train.select("doc_id"), "doc_id", "left_anti")

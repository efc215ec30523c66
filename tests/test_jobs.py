"""All jobs in a row: history, wide table, data set, samples, tokens, blocks."""

import os

from pyspark.sql import functions as F

from driftwood import session
from driftwood.catalog.python_sources import file_versions
from driftwood.operators.relations import orphans, wide_table
from driftwood.plans.dataset import cut_dataset, test_samples as make_test_samples, training_samples
from driftwood.plans.training_blocks import token_weight_table, training_blocks
from driftwood.plans.version_history import version_history
from driftwood.sources.entities import repositories_from_metadata

SF = "/root/testdata/sf0.001"


def test_history_to_samples(spark):
    versions = file_versions(spark, SF)
    made = version_history(versions)
    counts = ("size", "open_issues", "watchers", "forks", "stargazers_count")
    metadata = versions.select(F.col("repo").alias("full_name")).distinct().select(
        "full_name", *[F.lit(5).cast("long").alias(n) for n in counts],
        F.array(F.struct(F.lit(3).cast("long").alias("contributions"))).alias("contributors"))
    repositories = repositories_from_metadata(metadata)
    assert orphans(made.files, "repo", repositories).count() == 0

    wide = wide_table(made.versions, made.functions, made.files, repositories, complete_only=True)
    files = made.files.count()
    assert wide.count() == 2 * files
    cut = cut_dataset(wide, 100, held=1)
    held = {r["repo_name"] for r in cut.held_out.select("repo_name").distinct().collect()}
    train, test = cut.train.collect(), cut.test.collect()
    assert len(train) + len(test) == 100 and not {r["id"] for r in train} & {r["id"] for r in test}
    assert len(held) == 1 and not held & {r["repo_name"] for r in train + test}
    assert len(test) > 0

    samples = training_samples(cut.train)
    assert samples.columns == ["e", "l", "c", "d"]
    assert all(r["e"].startswith("<|fim_prefix|>def ") and r["l"] for r in samples.collect())
    labels = [r["l"] for r in make_test_samples(cut.test).collect()]
    assert labels.count(True) == len(test) and 0 < labels.count(False) <= len(test)

    weights = token_weight_table(samples)
    assert weights.agg(F.min("weight").alias("w")).first()["w"] == 0.0
    sequences = samples.select(F.monotonically_increasing_id().alias("id"), F.transform(F.split("d", " "), F.length).alias("input_ids"))
    assert training_blocks(session.materialise(sequences, "sequences"), ["id"], 0).filter(F.size("labels") != 512).count() == 0


def test_written_tables_are_dropped(spark):
    written = session.materialise(spark.range(3), "three")
    folder = os.path.dirname(session.fresh_path(spark, "x"))
    assert written.count() == 3 and os.listdir(folder)
    session.drop_written_tables(spark)
    assert not os.path.exists(folder)

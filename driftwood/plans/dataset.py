"""Dataset job: from entity tables to train and test samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.functions.hashing import hash_of
from driftwood.functions.text import training_prompt
from driftwood.operators.hashorder import balanced_cuts, balanced_sample, sample_rows, split_by_hash, with_negatives
from driftwood.operators.relations import complete_rows, hold_out, sample_keys, wide_table
from driftwood.session import materialise


@dataclass(frozen=True)
class Dataset:
    held_out: DataFrame
    train: DataFrame
    test: DataFrame


def samples(df: DataFrame) -> DataFrame:
    """Rows with a label as prompt, label, code and docstring."""
    prompt = training_prompt(F.col("code"), F.col("body_begin"), F.col("docstring"))
    return df.select(prompt.alias("e"), F.col("label").alias("l"), F.col("code").alias("c"), F.col("docstring").alias("d"))


def held_out_groups(df: DataFrame, group: str, key: list[str], k: int = 1, seed: int = 42) -> DataFrame:
    """Groups of ``k`` rows drawn at random, so that large groups are likelier."""
    return sample_rows(df, key, k, seed).select(group).distinct()


def cut_dataset(
    wide: DataFrame, n: int | None = None, share: float | None = None, train_fraction: float = 0.8, held: int = 1,
    seed: int = 42, group: str = "repo_name", key: list[str] | None = None,
) -> Dataset:
    """Held-out repositories, and a balanced sample of the others split into train and test.

    All rows unless a sample of ``n`` rows, or of a ``share`` of what is not held out, is asked for; more rows than
    there are is an error. Each step has a seed of its own: the sample takes the lowest hashes of a group, and a split by the same hashes would put them all in one part.
    """
    key = key or ["id"]
    # Stage tables, as several passes over single columns follow.
    clean = complete_rows(materialise(wide, "wide"))
    kept_out, rest = hold_out(clean, group, held_out_groups(clean, group, key, held, seed))
    if n is not None and share is not None:
        raise ValueError("give n or share, not both")
    if share is not None:
        n = int(rest.count() * share + 1e-9)
    if n is not None:
        rest = materialise(balanced_sample(rest, group, key, n, seed + 1), "sample")
    train, test = split_by_hash(rest, key, train_fraction, seed + 2)
    return Dataset(kept_out, train, test)


def cut_entities(
    versions: DataFrame, functions: DataFrame, files: DataFrame, repositories: DataFrame, n: int | None = None,
    share: float | None = None, train_fraction: float = 0.8, held: int = 1, seed: int = 42,
) -> Dataset:
    """What ``cut_dataset`` gives for the complete rows of the wide table, decided before that table is built.

    Groups, quotas and cuts come from the ids of complete versions and their repositories. Only the versions that are
    drawn meet their functions, so the cost of all but the pass over ids follows the sample; of the wide table only the
    sample is written.
    """
    if n is not None and share is not None:
        raise ValueError("give n or share, not both")
    keys = materialise(sample_keys(versions, functions, files, repositories), "sample-keys")
    kept_out, rest = hold_out(keys, "repo_name", held_out_groups(keys, "repo_name", ["id"], held, seed))
    if share is not None:
        n = int(rest.count() * share + 1e-9)

    def rows(ids: DataFrame) -> DataFrame:
        return wide_table(versions.join(ids.select("id"), "id", "left_semi"), functions, files, repositories)

    if n is None:
        wide = rows(rest)
    else:
        # One row per repository. No version above the last hash drawn can be in the sample; these go before any join, and the
        # others meet their repository's cut where they meet their repository: no version is shuffled to find its id.
        cuts = materialise(balanced_cuts(rest, "repo_name", ["id"], n, seed + 1), "cuts")
        digest = hash_of(seed + 1, F.col("id"))
        last = cuts.agg(F.max("_cut").alias("last"))
        drawn = versions.filter(digest <= F.coalesce(last.scalar(), F.lit("")))
        complete = wide_table(drawn, functions, files, repositories, complete_only=True)
        wide = complete.join(cuts, "repo_name").filter(digest <= F.col("_cut")).select(*complete.columns)
    # What is drawn is read several times by those who make samples of it.
    train, test = split_by_hash(wide if n is None else materialise(wide, "sample"), ["id"], train_fraction, seed + 2)
    return Dataset(rows(kept_out), train, test)


def training_samples(train: DataFrame) -> DataFrame:
    return samples(train.withColumn("label", F.lit(True)))


def test_samples(test: DataFrame, key: list[str] | None = None, seed: int = 45) -> DataFrame:
    return samples(with_negatives(test, key or ["id"], "docstring", seed))

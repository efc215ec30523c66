"""URL filtering: rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.functions.text import let

BUCKETS = 2048       # of hashed n-grams
SIZES = (3, 4, 5)    # characters of an n-gram
EPOCHS = 5
RATE = 0.5
SHRINK = 1e-4

# A small labelled table, made of these names, none of which any given table holds: each stands under three domains,
# with a scheme, a prefix and a path taken in turn, so that only the name tells the two kinds apart.
OTHERS = ("a1", "royal", "today", "online", "club", "world")


def _paired(words: tuple[str, ...]) -> tuple[str, ...]:
    """Each word before and behind each of ``OTHERS``, which so tell nothing."""
    return tuple(name for word in words for other in OTHERS for name in (f"{word}-{other}", f"{other}-{word}"))


BLOCKED = _paired(("casino", "bets", "pills", "spam", "ads", "adult"))
ALLOWED = _paired(("garden", "river", "school", "book", "music", "city")) + (
    "library", "weather", "museum", "university", "recipes", "gardens", "music", "health", "travel", "history", "science",
    "school", "theater", "city-news", "open-data", "book-shop", "web-design", "film-club", "sports-day", "kitchen", "mountain",
    "river-guide", "bicycle", "language", "painting", "chess", "birding", "railway", "astronomy", "poetry", "carpentry", "knitting")
DOMAINS = ("example.com", "example.net", "example.org")
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/en/14", "/fr/728/", "/de/61.html", "/es/99?page=2&ref=x", "/en/350#top", "/de/7?utm_source=feed", "")


def labelled_rows() -> list[tuple[str, int]]:
    """URLs and labels, 1 for those to be blocked."""
    rows = []
    for label, names in ((1, BLOCKED), (0, ALLOWED)):
        for name in names:
            for domain in DOMAINS:
                n = len(rows)
                rows.append((f"http{'s' * (n % 2)}://{PREFIXES[n % len(PREFIXES)]}{name}.{domain}{PATHS[n % len(PATHS)]}", label))
    return rows


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parse_rule(text: str) -> Rule:
    """``allow www.example.com/en/`` and the like: a verdict, a host, and the beginning of a path."""
    verdict, _, place = text.partition(" ")
    host, slash, path = place.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {text}")
    return Rule(verdict, host.lower(), slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A to Z in lower case, and path of a URL; both empty without ``://``."""
    rest = F.when(F.position(F.lit("://"), url) > 0, F.substring(url, F.position(F.lit("://"), url) + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, of equals the first; null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. The list of rules is part of the
    plan; it is meant for hundreds of rules.
    """
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        here = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        fits = F.when(here, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(fits)
    return fits


def n_grams(host: Column, path: Column) -> Column:
    """Buckets of the distinct character n-grams of host and path; hosts' and paths' n-grams differ."""
    def grams(text: Column, mark: str, size: int) -> Column:
        # Split once: a substring would be looked for from the text's beginning each time.
        return let(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda chars: F.transform(
            F.when(F.size(chars) >= size, F.sequence(F.lit(0), F.size(chars) - size)).otherwise(F.array().cast("array<int>")),
            lambda i: F.pmod(F.xxhash64(F.lit(mark), F.concat(*[F.get(chars, i + k) for k in range(size)])), F.lit(BUCKETS)).cast("int")))
    return F.array_distinct(F.concat(*[grams(text, mark, size) for text, mark in ((host, "h"), (path, "p")) for size in SIZES]))


def fit(spark: SparkSession, labelled: DataFrame) -> list[float]:
    """Weights of all buckets, then the intercept, from a small table of ``url`` and ``label``.

    Logistic regression by stochastic gradient descent: one expression folds the rows, in a fixed hash order, over and
    over again into the array of weights. The table must be small enough for one row to hold it.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("url is not null and label is not null").select(n_grams(host, path).alias("grams"), F.col("label").cast("double").alias("label"), F.xxhash64("url").alias("place"))
    gathered = rows.agg(F.array_sort(F.collect_list(F.struct("place", "label", "grams"))).alias("rows"))
    repeated = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(EPOCHS)), lambda _: F.col("rows")))

    def step(weights: Column, row: Column) -> Column:
        score = F.aggregate(row["grams"], F.element_at(weights, BUCKETS + 1), lambda total, g: total + F.element_at(weights, g + 1))
        error = row["label"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
        # The error once, and a row as its indicator over all buckets.
        pulls = F.transform(F.array(error * RATE / F.sqrt(F.size(row["grams"]).cast("double") + 1)), lambda pull: F.transform(
            weights, lambda w, i: w * (1 - SHRINK) + F.when((i == BUCKETS) | F.array_contains(row["grams"], i), pull).otherwise(0.0)))
        return F.element_at(pulls, 1)

    start = F.array_repeat(F.lit(0.0), BUCKETS + 1)
    return gathered.select(F.aggregate(repeated, start, step).alias("weights")).first()["weights"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for url, label in labelled_rows()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_verdicts(pages: DataFrame, rules: list[str], weights: list[float], key: str = "page_id", column: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score``.

    The longest rule that fits decides; where none does, the model blocks at a ``score`` of 0.5 or more, the chance
    that the URL is one to block. Null URLs and those without ``://`` have an empty host and path and the model's
    verdict on these.
    """
    host, path = host_and_path(F.col(column))
    parsed = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    table = F.lit([float(w) for w in weights])
    scored = parsed.withColumn("_grams", n_grams(F.col("host"), F.col("path"))).withColumn(
        "_sum", F.aggregate("_grams", F.lit(float(weights[-1])), lambda total, g: total + F.element_at(table, g + 1)))
    scored = scored.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_sum"))))
    ruled = scored.withColumn("_fits", longest_rule(F.col("host"), F.col("path"), [parse_rule(r) for r in rules]))
    return ruled.select("id", "host", "path", F.col("_fits.rule").alias("rule"), F.coalesce(
        F.col("_fits.verdict"), F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")

"""Repository and version statistics and their densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPOSITORY_METRICS = (
    "stars", "watchers", "forks", "contributors", "open_issues", "contributions", "sizes", "functions", "versions",
)
VERSION_METRICS = ("code_lengths", "docstring_lengths", "code_similarity", "docstring_similarity")

DENSITY_GRID = 200
HISTOGRAM_BINS = 200
PAIR_BINS = 50


def repository_statistics(wide: DataFrame) -> DataFrame:
    """Per repository its metrics, and the distinct function names and versions seen.

    A metric is constant within a repository, so the minimum is the value, in any row order.
    """
    constant = {"stars": "stars", "watchers": "watchers", "forks": "forks", "contributors": "contributors",
                "open_issues": "open_issues", "contributions": "contributions", "sizes": "size"}
    return wide.groupBy("repo_name").agg(
        *[F.min(source).alias(name) for name, source in constant.items()],
        F.countDistinct("function_name").alias("functions"),
        F.countDistinct("id").alias("versions"),
    )


def profiled_columns(wide: DataFrame) -> DataFrame:
    """What the statistics read of the wide table: of texts only their lengths."""
    constant = ["stars", "watchers", "forks", "contributors", "open_issues", "contributions", "size"]
    return wide.select(
        "id", "repo_name", "function_name", *constant, F.length("code").alias("code_lengths"),
        F.length("docstring").alias("docstring_lengths"), "code_similarity", "docstring_similarity",
    )


def version_statistics(profiled: DataFrame) -> DataFrame:
    return profiled.select("id", *VERSION_METRICS)


def distinct_values(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(column) if approximate else F.countDistinct(column)
    return df.agg(count.alias("distinct_values"))


SKETCH_BITS = 14   # a sketch has two to this power of registers


def distinct_sketches(df: DataFrame, by: list[str], columns: dict[str, str], bits: int = SKETCH_BITS) -> DataFrame:
    """Per group a sketch of the distinct values of each column, ``{name: column}``, to be kept in a stage table.

    Sketches of any parts unite to that of the whole, so a new shard costs a pass over itself. A column without values
    has an empty sketch.
    """
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(name) for name, c in columns.items()])


def united_sketches(sketches: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Estimated distinct values per group from kept sketches, within ``sketch_error`` in two of three cases."""
    united = sketches.groupBy(*by).agg(*[F.hll_union_agg(name).alias(name) for name in names])
    return united.select(*by, *[F.hll_sketch_estimate(name).alias(name) for name in names])


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """The relative standard error of a united sketch."""
    return 1.04 / 2 ** (bits / 2)


def contributor_totals(df: DataFrame, repository: str, contributions: Column) -> DataFrame:
    """Contributors and the sum of their contributions per repository, 0 where none counts."""
    return df.groupBy(repository).agg(
        F.count(contributions).alias("contributors"),
        F.coalesce(F.sum(contributions), F.lit(0)).alias("contributions"),
    )


def long_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric with a value; all metrics in a single pass."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.explode(pairs).alias("_m")).select("_m.metric", "_m.value").filter(F.col("value").isNotNull())


def metric_pairs(df: DataFrame, metrics: list[str], keep: list[str] | None = None) -> DataFrame:
    """All ordered pairs of different metrics of each row.

    The metrics of a row stand next to each other, so the pairs are spelled out in the row: no self-join.
    """
    pairs = F.array(*[
        F.struct(F.lit(a).alias("metric_x"), F.lit(b).alias("metric_y"),
                 F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a in metrics for b in metrics if a != b
    ])
    return (
        df.select(*(keep or []), F.explode(pairs).alias("_p")).select(*(keep or []), "_p.*")
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of a value, the upper end falling into the last bin."""
    width = F.nullif((high - low) / bins, F.lit(0.0))
    return F.coalesce(F.least(F.floor((value - low) / width), F.lit(bins - 1)), F.lit(0)).cast("int")


def metric_ranges(metrics: DataFrame) -> DataFrame:
    """One row per metric: count, range and spread."""
    return metrics.groupBy("metric").agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.stddev_samp("value").alias("deviation"),
    )


def density(metrics: DataFrame, grid: int = DENSITY_GRID, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Gaussian density of each metric on a grid, with the grid's logarithm for a log axis.

    The rows are counted into bins first; only the bins meet the grid, so the smoothing costs
    ``grid * bins`` per metric whatever the number of rows. Bandwidth by Scott's rule, the grid reaching
    three bandwidths beyond the data.
    """
    ranges = metric_ranges(metrics).filter((F.col("n") > 1) & (F.col("deviation") > 0))
    # One row per metric name.
    binned = (
        metrics.join(F.broadcast(ranges), "metric")
        .groupBy("metric", _bin(F.col("value"), F.col("low"), F.col("high"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    width = (F.col("high") - F.col("low")) / bins
    scaled = (
        binned.join(F.broadcast(ranges), "metric")
        .withColumn("bandwidth", F.col("deviation") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .withColumn("centre", F.col("low") + (F.col("bin") + 0.5) * width)
        .withColumn("grid_idx", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .withColumn("start", F.col("low") - 3 * F.col("bandwidth"))
        .withColumn("step", (F.col("high") - F.col("low") + 6 * F.col("bandwidth")) / (grid - 1))
        .withColumn("x", F.col("start") + F.col("grid_idx") * F.col("step"))
    )
    distance = (F.col("x") - F.col("centre")) / F.col("bandwidth")
    share = F.col("rows") / (F.col("n") * F.col("bandwidth") * F.sqrt(F.lit(2.0) * F.pi()))
    return (
        scaled.groupBy("metric", "grid_idx")
        .agg(F.min("x").alias("x"), F.sum(share * F.exp(distance * distance * -0.5)).alias("density"))
        .withColumn("log_x", F.when(F.col("x") > 0, F.log10(F.when(F.col("x") > 0, F.col("x")))))
    )


def pair_statistics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per pair of metrics, the first before the second in ``metrics``: rows that have both, and range and spread
    of either over these.

    One aggregate over the rows as they are, without spelling out a pair.
    """
    def of(value: str, other: str, name: str) -> list[Column]:
        both = F.when(F.col(other).isNotNull(), F.col(value).cast("double"))
        return [F.min(both).alias(f"{name}_low"), F.max(both).alias(f"{name}_high"), F.stddev_samp(both).alias(f"{name}_sd")]

    pairs = [
        F.struct(F.lit(a).alias("metric_x"), F.lit(b).alias("metric_y"), F.count(F.when(F.col(b).isNotNull(), F.col(a))).alias("n"), *of(a, b, "x"), *of(b, a, "y"))
        for n, a in enumerate(metrics) for b in metrics[n + 1:]
    ]
    return df.agg(F.array(*pairs).alias("_p")).select(F.inline("_p")).filter("n > 0")


def pair_density(df: DataFrame, metrics: list[str], bins: int = PAIR_BINS, statistics: DataFrame | None = None) -> DataFrame:
    """Two-dimensional histogram of every ordered pair of metrics, on equal-width bins over the ranges of rows that have both.

    Each unordered pair is counted once, in the row it stands in, and mirrored when only bins are left.
    """
    by_pair = ["metric_x", "metric_y"]
    ranges = pair_statistics(df, metrics) if statistics is None else statistics
    values = [
        F.struct(F.lit(a).alias("metric_x"), F.lit(b).alias("metric_y"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for n, a in enumerate(metrics) for b in metrics[n + 1:]
    ]
    pairs = df.select(F.explode(F.array(*values)).alias("_p")).select("_p.*").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    # One row per pair of metric names.
    counted = (
        pairs.join(F.broadcast(ranges.select(*by_pair, "x_low", "x_high", "y_low", "y_high")), by_pair)
        .groupBy(
            *by_pair, _bin(F.col("x"), F.col("x_low"), F.col("x_high"), bins).alias("x_bin"),
            _bin(F.col("y"), F.col("y_low"), F.col("y_high"), bins).alias("y_bin"),
        )
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return _mirrored(counted, ["metric", "bin"], "rows")


def _mirrored(df: DataFrame, both: list[str], *kept: str) -> DataFrame:
    """Rows of unordered pairs in either order; ``both`` are read as ``metric_x`` and ``metric_y``, or ``x_bin`` and ``y_bin``."""
    def sides(x: str, y: str) -> Column:
        named = [(f"{both[0]}_x", f"{both[0]}_{x}"), (f"{both[0]}_y", f"{both[0]}_{y}")]
        named += [pair for c in both[1:] for pair in ((f"x_{c}", f"{x}_{c}"), (f"y_{c}", f"{y}_{c}"))]
        return F.struct(*[F.col(source).alias(name) for name, source in named])

    return df.select(F.explode(F.array(sides("x", "y"), sides("y", "x"))).alias("_s"), *kept).select("_s.*", *kept)


def smoothed_pair_density(df: DataFrame, metrics: list[str], bins: int = PAIR_BINS) -> DataFrame:
    """Gaussian density of every ordered pair of metrics at the centres of a grid of bins, as the share in a cell.

    The rows are counted into bins once; the counts are then smoothed axis by axis, so the cost is ``bins`` to the
    power of three per pair whatever the number of rows. Bandwidths by Scott's rule for two dimensions. A pair with a
    constant metric has no density.
    """
    by_pair = ["metric_x", "metric_y"]
    statistics = pair_statistics(df, metrics)
    spread = _mirrored(statistics.filter((F.col("n") > 1) & (F.col("x_sd") > 0) & (F.col("y_sd") > 0)), ["metric", "low", "high", "sd"], "n")
    steps = {c: (F.col(f"{c}_high") - F.col(f"{c}_low")) / bins / (F.col(f"{c}_sd") * F.pow(F.col("n").cast("double"), F.lit(-1.0 / 6))) for c in ("x", "y")}
    # One row per pair of metric names.
    ranges = F.broadcast(spread.select(*by_pair, "n", *[step.alias(f"{c}_step") for c, step in steps.items()]))
    smoothed = pair_density(df, metrics, bins, statistics).join(ranges, by_pair).withColumn("share", F.col("rows") / F.col("n"))
    for axis, other in (("x", "y"), ("y", "x")):
        cell, step = F.col(f"{axis}_cell"), F.col(f"{axis}_step")
        distance = (cell - F.col(f"{axis}_bin")) * step
        kernel = step / F.sqrt(F.lit(2.0) * F.pi()) * F.exp(distance * distance * -0.5)
        smoothed = (
            smoothed.withColumn(f"{axis}_cell", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("share", F.col("share") * kernel)
            .groupBy(*by_pair, f"{axis}_cell", f"{other}_bin", "x_step", "y_step").agg(F.sum("share").alias("share"))
            .withColumnRenamed(f"{axis}_cell", f"{axis}_bin")
        )
    return smoothed.select(*by_pair, "x_bin", "y_bin", F.col("share").alias("density"))


def pair_correlation(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("metric_x", "metric_y").agg(F.corr("x", "y").alias("correlation"))

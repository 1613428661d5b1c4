"""Describing data: histograms, quantiles, curves and rolling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import by_dimension
from .order import positions, quantiles, running


def fixed_bin(x: Column, low: float = -1.0, high: float = 1.0, bins: int = 512) -> Column:
    """Bin of equal width; values outside fall in the first or the last."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - low) / (high - low) * bins))).cast("int")


def histogram(df: DataFrame, x: Column, *keys: str, **bins) -> DataFrame:
    return df.groupBy(*keys, fixed_bin(x, **bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def exponential_bin(x: Column, start: float, base: float, bins: int) -> Column:
    """The first bucket whose bound ``start * base ** k`` is not below ``x``; ``bins`` beyond the last."""
    bounds = F.array(*[F.lit(start * base**k) for k in range(bins)])
    return F.size(F.filter(bounds, lambda b: b < x))


def exponential_histogram(df: DataFrame, x: Column, key: str, start: float, base: float, bins: int) -> DataFrame:
    """Counts per bucket and cumulative counts, as an exposition format wants them."""
    counts = df.groupBy(key, exponential_bin(x, start, base, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("cumulative", F.sum("n").over(Window.partitionBy(key).orderBy("bin")))


def quantile_levels(n: int = 255) -> list[float]:
    """``n`` evenly spaced levels from 0 to 1."""
    return [k / (n - 1) for k in range(n)]


def cdf(df: DataFrame, x: str, *keys: str, levels: list[float] | None = None, exact: bool = True) -> DataFrame:
    """``cdf``: the quantiles of a channel, by range-partitioned ranks; ``exact=False`` uses a mergeable sketch."""
    levels = levels or quantile_levels()
    if exact:
        return quantiles(df, x, levels, list(keys), "cdf")
    return df.groupBy(*keys).agg(F.percentile_approx(x, levels, 100_000).alias("cdf"))


def descriptor_code(x: Column, quantiles: Column) -> Column:
    """How many quantiles are below the value: 0 to 255."""
    return F.size(F.filter(quantiles, lambda q: q < x))


def dimension_bounds(vectors: DataFrame, low: float = 0.0005, high: float = 0.9995, vector: str = "embedding") -> DataFrame:
    """Exact quantile bounds of each dimension: ``pos, low, high``; no task holds a dimension's values."""
    q = quantiles(by_dimension(vectors, vector=vector), "x", [low, high], ["pos"], "q")
    return q.select("pos", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def standardised_histogram(vectors: DataFrame, vector: str = "embedding", bins: int = 64, reach: float = 4.0) -> DataFrame:
    """Histogram per dimension of values in standard deviations from its mean, with log counts."""
    dims = by_dimension(vectors, vector=vector)
    norms = dims.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"))
    z = dims.join(norms, "pos").withColumn("z", F.when(F.col("dev") > 0, (F.col("x") - F.col("mean")) / F.col("dev")).otherwise(0.0))
    return histogram(z, F.col("z"), "pos", low=-reach, high=reach, bins=bins).withColumn("log_n", F.log1p("n"))


def rolling_mean(df: DataFrame, x: str, order: str, rows: int = 50, *keys: str, block: int = 20_000) -> DataFrame:
    """Mean over the last ``rows`` rows, where there are that many.

    A key's rows are cut into blocks by place; a block gets the last rows of the one before as guests.
    """
    p = positions(df, [F.col(order)], list(keys))
    own = F.floor(F.col("place") / block)
    homes = F.when(F.col("place") % block >= block - rows + 1, F.array(own, own + 1)).otherwise(F.array(own))
    p = p.withColumns({"_own": own, "_block": F.explode(homes)})
    w = Window.partitionBy(*keys, "_block").orderBy("place").rowsBetween(1 - rows, 0)
    out = p.withColumn("rolling", F.avg(x).over(w)).filter((F.col("_own") == F.col("_block")) & (F.col("place") >= rows - 1))
    return out.drop("_own", "_block", "place", "total")


def inter_arrival(df: DataFrame, at: str, order: str, *keys: str) -> DataFrame:
    """Mean seconds between one row and the next: the span over the number of gaps, as gaps add up to it.

    Rows without a time are left out; null for a single row.
    """
    known = df.filter(F.col(at).isNotNull())
    span = F.max_by(at, order) - F.min_by(at, order)
    gaps = F.count(F.lit(1)) - 1
    return known.groupBy(*keys).agg((span / F.nullif(gaps, F.lit(0))).alias("mean_gap"), gaps.alias("gaps"))


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """``score, p, n, tp, fp`` at every distinct threshold, from the highest down; ``p`` and ``n`` have that score."""
    steps = df.groupBy(score).agg(F.sum(F.when(F.col(label), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label), 0).otherwise(1)).alias("n"))
    return running(steps, {"tp": F.col("p"), "fp": F.col("n")}, [F.col(score).desc()])


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by trapezoids; null without both labels."""
    c = roc(df, score, label)
    # a step is as wide as its n; its sides are tp before and after
    area = F.sum(F.col("n") * (2 * F.col("tp") - F.col("p")) / 2)
    return c.agg((area / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auroc"))


def rank_summary(df: DataFrame, rank: str) -> DataFrame:
    """Of ranks from 0: mean, upper median, harmonic mean (all plus 1), least and greatest."""
    placed = positions(df.select(F.col(rank).alias("r")), [F.col("r")])
    return placed.agg(
        (F.avg("r") + 1).alias("mean"), (F.max(F.when(F.col("place") == F.floor(F.col("total") / 2), F.col("r"))) + 1).alias("median"),
        F.min("r").alias("least"), F.max("r").alias("greatest"), (F.count(F.lit(1)) / F.sum(1 / (F.col("r") + 1))).alias("harmonic"),
    )


def recall(truth: DataFrame, found: DataFrame, k: int, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """Share of the true ``k`` nearest that were found, over all queries."""
    hits = truth.select(query, key).join(found.select(query, key).distinct().withColumn("hit", F.lit(1)), [query, key], "left")
    return hits.agg(F.count("hit").alias("hits"), F.countDistinct(query).alias("queries"), (F.count("hit") / (F.countDistinct(query) * k)).alias("recall"))


def percentile_slice(df: DataFrame, order: list[Column], levels: list[float], n: int = 25) -> DataFrame:
    """``n`` ranked rows from each level on, with ``level``."""
    placed = positions(df, order).withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    base = F.round(F.col("level") * F.col("total"))
    return placed.filter((F.col("place") >= base) & (F.col("place") < base + n)).drop("total")


def top_fraction(df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """The first ``1 / parts`` of the rows in the given order."""
    return positions(df, order).filter(F.col("place") < F.floor(F.col("total") / parts)).drop("place", "total")


def ensemble(df: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """Mean, lower median and sample variance over an ensemble's members."""
    return df.groupBy(*keys).agg(
        F.avg(score).alias("mean"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {score})").alias("median"),
        F.var_samp(score).alias("variance"),
    )

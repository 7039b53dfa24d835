"""Exploratory aggregates over cohort tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.functions import stats
from agewise.functions.lineage import settle


def filter_cohort(df: DataFrame, age: str, low: float, high: float, **members: Sequence) -> DataFrame:
    """Ages from low to high; columns among the given values, compared as strings; an empty list doesn't filter."""
    out = df.where(F.col(age).between(low, high))
    for c, values in members.items():
        if values:
            out = out.where(F.col(c).cast("string").isin(*map(str, values)))
    return out


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, nulls, mean, std, min, quartiles and max, a row for each column."""
    long = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]).unpivot([], list(columns), "column", "x")
    one = long.groupBy("column").agg(
        F.count("x").alias("count"), F.count_if(F.col("x").isNull()).alias("nulls"), F.avg("x").alias("mean"), F.stddev("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    quartiles = stats.exact_quantiles(long, "x", QUARTILES, ["column"])
    return one.join(quartiles, "column", "left").select("column", "count", "nulls", "mean", "std", "min", "q1", "median", "q3", "max")


#: Columns of a block of a correlation matrix.
BLOCK = 128


def _numbers(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A batch's values, 0 where one is missing, and which are there."""
    x = part.to_numpy(dtype=float)
    there = ~np.isnan(x)
    return np.where(there, x, 0.0), there.astype(float)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r): pairwise-complete Pearson r of all ordered pairs of ``columns``; null where fewer than two rows have both, or one of
    the two doesn't vary in these. NaN counts as missing. An empty table gives null for every pair.

    Each task multiplies its rows' matrix of values and of what is there by blocks of ``BLOCK`` columns, and the blocks' products are summed
    over tasks, so a task holds six numbers for each pair of columns whatever the number of rows. Values are taken from their column's least, of
    which one number a column is brought to the driver. The sums are written while the plan is made.
    """
    spark, p = df.sparkSession, len(columns)
    values = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])

    def least(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = np.full(p, np.inf)
        for part in parts:
            x, there = _numbers(part)
            low = np.minimum(low, np.where(there > 0, x, np.inf).min(axis=0, initial=np.inf))
        yield pd.DataFrame({"k": range(p), "low": low})

    low = np.zeros(p)
    for r in values.mapInPandas(least, "k int, low double").groupBy("k").agg(F.min("low").alias("low")).collect():  # one row a column
        low[r["k"]] = r["low"] if np.isfinite(r["low"]) else 0.0
    cuts = [(k, min(k + BLOCK, p)) for k in range(0, p, BLOCK)]

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for part in parts:
            x, there = _numbers(part)
            x = (x - low) * there
            sides = [(there[:, a:b], x[:, a:b], x[:, a:b] ** 2) for a, b in cuts]
            for i, (n, v, w) in enumerate(sides):
                for j, (m, u, z) in enumerate(sides[i:], i):
                    sums[i, j] = sums.get((i, j), 0) + np.stack([n.T @ m, v.T @ m, n.T @ u, w.T @ m, n.T @ z, v.T @ u])
        for (i, j), held in sums.items():
            yield pd.DataFrame({"i": [i], "j": [j], "s": [held.tobytes()]})

    def correlated(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for part in parts:
            for i, j, s in zip(part["i"], part["j"], part["s"], strict=True):
                sums[i, j] = sums.get((i, j), 0) + np.frombuffer(s)
        for (i, j), held in sums.items():
            (a, b), (c, d) = cuts[i], cuts[j]
            n, x, y, xx, yy, xy = held.reshape(6, b - a, d - c)
            spread = (n * xx - x * x) * (n * yy - y * y)
            with np.errstate(invalid="ignore", divide="ignore"):
                r = np.where((n > 1) & (spread > 0), (n * xy - x * y) / np.sqrt(spread), np.nan)
            left, right = (g.ravel() for g in np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij"))
            yield pd.DataFrame({"x": left, "y": right, "r": r.ravel()})
            if i < j:
                yield pd.DataFrame({"x": right, "y": left, "r": r.ravel()})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), max(16, 4_000_000 // max(p, 1))))
    try:
        blocks = settle(values.mapInPandas(products, "i int, j int, s binary"), "products")
        spark.conf.set(key, 16)
        found = settle(blocks.repartition("i", "j").mapInPandas(correlated, "x int, y int, r double"), "correlations")
    finally:
        spark.conf.set(key, before)
    names = spark.createDataFrame(list(enumerate(columns)), "k int, name string")
    pairs = names.select(F.col("k").alias("x"), F.col("name").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("y"))
    pairs = pairs.join(names.select(F.col("k").alias("y"), F.col("name").alias("b")), "y")
    return pairs.join(found, ["x", "y"], "left").select("a", "b", F.nanvl("r", F.lit(None)).alias("r"))


def stacked_histogram(df: DataFrame, value: str, group: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins from the least to the largest value, by group; the largest value is in the last bin."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    return placed.groupBy(b.cast("long").alias("bin"), group).agg(F.count("*").alias("n"))


def genotype_boxplot(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 interquartile ranges) and outliers of each group."""
    x = F.col(value)
    counts = df.where(x.isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    boxes = counts.join(stats.exact_quantiles(df, value, QUARTILES, [group]), group).select(group, "n", *QUARTILES)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    whiskers = df.where(x.isNotNull()).join(boxes, group).groupBy(group).agg(
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"), F.count_if(~inside).alias("n_outliers")
    )
    return boxes.join(whiskers, group)


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction over groups of two rows or more. Ranks come from running counts of equal values, so no window spans
    the table."""
    big = df.where(F.col(value).isNotNull()).join(df.groupBy(group).agg(F.count(value).alias("__n")).where(F.col("__n") >= 2).select(group), group)
    ranks = stats.cumulative_counts(big, value).select(value, "t", (F.col("cum") - (F.col("t") - 1) / 2).alias("rank"))
    sums = big.join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    whole = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("k"))
    tied = ranks.agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return whole.crossJoin(tied).select(h.alias("h"), (F.col("k") - 1).alias("df"), F.col("n").cast("long").alias("n"))


def ols_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept and the mean absolute error about the fitted line."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    line = both.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return both.crossJoin(F.broadcast(line)).groupBy("slope", "intercept").agg(
        F.avg(F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))).alias("mae"), F.count("*").alias("n")
    )

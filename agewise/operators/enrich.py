"""Gene-set overlap and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.functions import stats


def enrichment_table(sets: DataFrame, targets: DataFrame, universe: DataFrame, gene: str = "gene") -> DataFrame:
    """One row for each set (column set_name) and target set (column target) within the universe: sizes, overlap, expected,
    fold, odds, tail p and its Benjamini-Hochberg value over the whole grid. Sizes and overlaps are counted by equi joins;
    only the grid of names is crossed."""
    u = universe.select(gene).distinct()
    a, b = sets.select("set_name", gene).distinct().join(u, gene), targets.select("target", gene).distinct().join(u, gene)
    sizes_a, sizes_b = a.groupBy("set_name").agg(F.count("*").alias("a")), b.groupBy("target").agg(F.count("*").alias("b"))
    overlap = a.join(b, gene).groupBy("set_name", "target").agg(F.count("*").alias("k"))
    grid = sizes_a.crossJoin(sizes_b).crossJoin(u.agg(F.count("*").alias("n"))).join(overlap, ["set_name", "target"], "left").na.fill(0, ["k"])
    k, x, y, n = (F.col(c) for c in ("k", "a", "b", "n"))
    d = n - x - y + k
    grid = grid.withColumns(
        {
            "expected": x * y / n,
            "fold": k / (x * y / n),
            "odds": F.when((x - k == 0) | (y - k == 0), float("inf")).otherwise(k * d / ((x - k) * (y - k))),
            "p_value": stats.hypergeom_tail(k, x, y, n),
        }
    )
    return stats.benjamini_hochberg(grid, "p_value", "q_value", "set_name", "target")


def overlap_check(left: DataFrame, right: DataFrame, expected: int, gene: str = "gene") -> DataFrame:
    """Size of the intersection against what is expected, and of both differences."""
    a, b = left.select(gene).distinct().withColumn("l", F.lit(1)), right.select(gene).distinct().withColumn("r", F.lit(1))
    found = a.join(b, gene, "full_outer").agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("overlap"),
        F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"),
    )
    return found.withColumn("status", F.when(F.col("overlap") == expected, "MATCH").otherwise("MISMATCH"))

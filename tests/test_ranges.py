"""Operators over sampled ranges and levelled bins: equal to plain versions, and spread over tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agewise.functions import ranges, stats
from agewise.operators import clock, cohort, quality, tables


def test_numbers_of_rows_and_their_ranges(spark):
    df = spark.range(20_000).select((1 - F.xxhash64("id") % 1_000_000 / 1e9).alias("v"), "id")
    got = tables.running_total_order(df, [F.desc("v"), F.col("id")]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(1, 20_001))
    assert [(-r["v"], r["id"]) for r in got] == sorted((-r["v"], r["id"]) for r in got)
    sizes = [r["n"] for r in ranges.in_ranges(df, ["v", "id"]).groupBy("__range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 20_000 / 4
    assert tables.running_total_order(df.where("id < 0"), ["id"]).count() == 0
    assert {r["ordinal"] for r in tables.running_total_order(df.withColumn("g", F.col("id") % 2), ["id"], ["g"]).groupBy("ordinal").count().collect()} == set(range(1, 10_001))


def test_counts_of_values_in_a_narrow_range(spark):
    rng = random.Random(1)
    rows = [(g, 0.999 + rng.randrange(3000) / 3e6) for g in "ab" for _ in range(4000)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["v"]): (r["t"], r["cum"], r["total"]) for r in stats.cumulative_counts(df, "v", ["g"]).collect()}
    for g in "ab":
        own = sorted(v for h, v in rows if h == g and v is not None)
        for v in set(own):
            assert got[g, v] == (own.count(v), np.searchsorted(own, v, "right"), len(own))


def test_adjusted_p_run_down_once(spark):
    df = spark.range(20_000).select("id", (1 - F.pmod(F.xxhash64("id"), F.lit(9000)) / 1e9).alias("p"))
    found = stats.benjamini_hochberg(df, "p", "q")
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()  # such a frame takes the square of a range's rows
    rows = found.collect()
    ps = np.array([r["p"] for r in rows])
    values, counts = np.unique(ps, return_counts=True)
    low = np.minimum.accumulate((values * len(ps) / counts.cumsum())[::-1])[::-1]
    assert len(rows) == 20_000 and [r["q"] for r in rows] == pytest.approx(np.minimum(low, 1)[np.searchsorted(values, ps)].tolist(), rel=1e-12)


def test_intervals_of_all_lengths(spark):
    rng = random.Random(2)

    def some(n):
        out = []
        for k in range(n):
            size = 10 ** rng.randrange(1, 9)
            start = rng.randrange(-1000, 2 * 10**8)
            out.append((k, rng.choice("12"), start, start + rng.randrange(size)))
        return [*out, (n, "1", None, 5), (n + 1, None, 1, 5), (n + 2, "1", 0, 10**8)]

    a, b = some(300), some(200)
    schema = "k int, chrom string, start long, end long"
    regions, genes = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = sorted((r["k"], r["gene_k"]) for r in quality.annotate_intervals(regions, genes).collect())
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] is not None and None not in (x[2], y[2]) and x[2] <= y[3] and y[2] <= x[3])
    assert got == want and len(want) > 100
    long = quality._levelled(regions, "start", "end").withColumn("__level", F.col("__own"))
    assert quality._in_bins(long, "start", "end").groupBy("k").count().agg(F.max("count")).first()[0] <= 2
    assert quality.annotate_intervals(regions.where("k < 0"), genes).count() == 0


def test_regions_over_borders_of_ranges(spark):
    rng = random.Random(3)
    rows = [(g, p, rng.choice([0.001, 0.01, 0.2])) for g in ("1", "2") for p in rng.sample(range(40_000), 4000)]
    rows += [("1", p, 0.001) for p in range(100_000, 112_000, 3)]  # one run over many ranges
    df = spark.createDataFrame(rows, "g string, pos long, p double")

    def plain():
        for g in ("1", "2"):
            held = sorted((pos, p) for h, pos, p in rows if h == g and p < 0.05)
            run = [held[0]]
            for site in [*held[1:], (10**9, 1.0)]:
                if site[0] - run[-1][0] <= 15:
                    run.append(site)
                    continue
                if len(run) >= 3:
                    yield (g, run[0][0], run[-1][0], len(run), min(p for _, p in run))
                run = [site]

    want = sorted(plain())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = quality.call_regions(df, "g", "pos", "p", 15, 0.05, 3).select("g", "start", "end", "n_sites", "min_p").collect()
            assert sorted(tuple(r) for r in got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert any(r[3] == 4000 for r in want)


def test_paths_meet_the_conditions_of_the_elastic_net(spark):
    """The chosen model of more features than samples, by its conditions: no better coefficients exist."""
    rng = np.random.default_rng(5)
    n, p = 40, 120
    x = rng.uniform(size=(n, p))
    y = 30 + 20 * x[:, 0] - 15 * x[:, 7] + rng.normal(size=n)
    cells = [(f"s{i}", f"cg{j}", float(x[i, j])) for i in range(n) for j in range(p)] + [("s0", "cg3", None), ("other", "cg0", 0.5)]
    matrix = spark.createDataFrame(cells, "sample_id string, cpg string, beta double")
    target = spark.createDataFrame([(f"s{i}", float(y[i])) for i in range(n)] + [("late", None)], "sample_id string, age double")
    coefs, found = clock.train_elastic_net_cv(matrix, target, l1_ratios=(0.5, 0.9), n_alphas=6, folds=4, tol=1e-10)
    got = {r["cpg"]: r["coef"] for r in coefs.collect()}
    sd = x.std(0)
    z, b = (x - x.mean(0)) / sd, np.array([got[f"cg{j}"] for j in range(p)]) * sd
    left = y - y.mean() - z @ b
    slope = z.T @ left / n - found["alpha"] * (1 - found["l1_ratio"]) * b
    cut = found["alpha"] * found["l1_ratio"]
    assert np.abs(slope[b == 0]).max() <= cut * 1.002 and slope[b != 0] == pytest.approx(cut * np.sign(b[b != 0]), abs=cut * 1e-3)
    assert found["intercept"] == pytest.approx(y.mean() - x.mean(0) @ (b / sd), abs=1e-6) and 2 <= (b != 0).sum() < 40
    none, _ = clock.train_elastic_net_cv(matrix.where("cpg = 'none'"), target, l1_ratios=(1.0,), n_alphas=2, folds=2)
    assert none.count() == 0


def test_correlations_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(cohort, "BLOCK", 4)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 11)) + 1e6
    x[:, 3] += 2 * x[:, 1]
    x[:, 5] = 7.25
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 9] = np.nan
    x[1:, 10] = np.nan
    names = [f"v {k}" for k in range(11)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"`{n}` double" for n in names))
    df = df.withColumnsRenamed({n: n.replace(" ", "_") for n in names}).repartition(5)
    names = [n.replace(" ", "_") for n in names]
    got = {(r["a"], r["b"]): r["r"] for r in cohort.correlation_matrix(df, names).collect()}
    assert len(got) == 121
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            u, v = x[both, i], x[both, j]
            if both.sum() < 2 or np.ptp(u) == 0 or np.ptp(v) == 0:
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-9)
    assert {r["r"] for r in cohort.correlation_matrix(df.where("v_0 < 0"), names[:3]).collect()} == {None}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096, 70_001])
def test_keyed_permutations(n):
    seen = [stats.permuted(np.arange(n), n, seed) for seed in range(30)]
    assert all(sorted(p) == list(range(n)) for p in seen)
    assert n < 17 or len({tuple(p) for p in seen}) == 30
    if n == 1000:  # places spread as by chance
        assert abs(np.mean([p[:500].mean() for p in seen]) - 499.5) < 25 and abs(np.mean([np.corrcoef(p, np.arange(n))[0, 1] for p in seen])) < 0.05


def test_permutations_of_odd_tables(spark):
    none = stats.permutation_test(spark.createDataFrame([], "k int, x double, y double"), "k", "x", "y", rounds=5).first()
    assert (none["r"], none["n"], none["as_extreme"]) == (None, 0, 0)
    flat = stats.permutation_test(spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (None, 1.0, None)], "k int, x double, y double"), "k", "x", "y", rounds=5).first()
    assert (flat["r"], flat["n"], flat["as_extreme"]) == (None, 2, 0)

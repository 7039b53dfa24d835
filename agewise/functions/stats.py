"""Test statistics as native expressions; distribution tails of aggregated rows by one vectorised UDF."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agewise.functions.lineage import settle
from agewise.functions.ranges import in_ranges, number_rows, totals_before


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _masses(n: int, a: int, b: int, start: int, step: int) -> Iterator[float]:
    """Hypergeometric masses from ``start`` on in one direction, each from the last by their ratio."""
    low, high = max(0, a + b - n), min(a, b)
    k = start
    if not low <= k <= high:
        return
    m = math.exp(_log_choose(a, k) + _log_choose(n - a, b - k) - _log_choose(n, b))
    while True:
        yield m
        if step > 0:
            if k >= high:
                return
            m *= (a - k) * (b - k) / ((k + 1) * (n - a - b + k + 1))
        else:
            if k <= low:
                return
            m *= k * (n - a - b + k) / ((a - k + 1) * (b - k + 1))
        k += step


def _upper_tail(k: int, a: int, b: int, n: int) -> float:
    """P(X >= k): the shorter way of the tail, ended where its masses no longer count."""
    mode = (a + 1) * (b + 1) // (n + 2)
    low = max(0, a + b - n)
    if k <= low:
        return 1.0
    if k > min(a, b):
        return 0.0
    total = 0.0
    if k > mode:
        for m in _masses(n, a, b, k, 1):
            total += m
            if m < total * 1e-17:
                break
        return min(1.0, total)
    for m in _masses(n, a, b, k - 1, -1):
        total += m
        if m < total * 1e-17:
            break
    return max(0.0, 1.0 - total)


def _two_sided(a: int, b: int, c: int, d: int) -> float:
    """Both ends' masses of at most the observed one; walks outward from it and from the mode's other side, so the steps are of the
    distribution's spread, not of its support."""
    n, rows, cols = a + b + c + d, a + b, a + c
    if not n:
        return 1.0
    seen = math.exp(_log_choose(rows, a) + _log_choose(n - rows, cols - a) - _log_choose(n, cols))
    most = seen * (1 + 1e-7)
    mode = (rows + 1) * (cols + 1) // (n + 2)
    side = 1 if a >= mode else -1
    total = 0.0
    for m in _masses(n, rows, cols, a, side):
        if m <= most:
            total += m
        if m < total * 1e-17:
            break
    for m in _masses(n, rows, cols, a - side, -side):
        if m <= most:
            total += m
            if m < total * 1e-17:
                break
    return min(1.0, total)


def _counts(f: Callable[..., float]) -> Callable[..., pd.Series]:
    def each(*columns: pd.Series) -> pd.Series:
        found: dict[tuple, float | None] = {}
        for x in set(zip(*columns, strict=True)):
            found[x] = None if any(pd.isna(v) for v in x) else f(*map(int, x))
        return pd.Series([found[x] for x in zip(*columns, strict=True)], dtype="float64")

    return each


def hypergeom_tail(overlap: Column, size_a: Column, size_b: Column, universe: Column) -> Column:
    """P(X >= overlap) of the overlap of sets of the given sizes, for aggregated rows; null where a count is."""

    def tails(k: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return _counts(_upper_tail)(k, a, b, n)

    return F.pandas_udf(tails, "double")(*(x.cast("double") for x in (overlap, size_a, size_b, universe)))


def fisher_exact_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided p of a 2x2 table: that of as many or more in the first cell."""
    return hypergeom_tail(a, a + b, a + c, a + b + c + d)


def fisher_exact_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Sum of the masses that are at most the observed one (relative tolerance 1e-7), for aggregated rows."""

    def tails(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return _counts(_two_sided)(a, b, c, d)

    return F.pandas_udf(tails, "double")(*(x.cast("double") for x in (a, b, c, d)))


def dominant_odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of carriers (a cases, c controls) against non-carriers (b, d); 0.5 is added to all cells if one is 0."""
    zero = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    h = F.when(zero, 0.5).otherwise(0.0)
    return (a + h) * (d + h) / ((b + h) * (c + h))


def woolf_ci(a: Column, b: Column, c: Column, d: Column, z: float = 1.959964) -> Column:
    h = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    center = F.log((a + h) * (d + h) / ((b + h) * (c + h)))
    se = F.sqrt(1 / (a + h) + 1 / (b + h) + 1 / (c + h) + 1 / (d + h))
    return F.struct(F.exp(center - z * se).alias("low"), F.exp(center + z * se).alias("high"))


def chi2_2x2_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    n = (a + b + c + d).cast("double")
    off = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return n * off * off / ((a + b) * (c + d) * (a + c) * (b + d))


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, t, cum, total, __range): for each different value, its rows, the rows up to it, and all rows, within each group of the
    columns ``by``; nulls are left out.

    Equal values are one row from the first shuffle on. These are dealt by sampled ranges, so that each task runs its totals over about
    as many values as any other, wherever the values lie; totals of ranges come before. Counts are written while the plan is
    made, so ``df`` is read once."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value)).agg(F.count("*").alias("t"))
    counts = in_ranges(counts, [*map(F.col, by), F.col(value)], "counts")
    before = totals_before(counts, F.col("t"), "before", by)
    totals = counts.groupBy(*by).agg(F.sum("t").alias("total"))
    before = before.join(totals, list(by)) if by else before.crossJoin(F.broadcast(totals))
    run = F.sum("t").over(Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.join(before, [*by, "__range"]).select(*by, value, "t", (F.col("before") + run).alias("cum"), "total", "__range")


def exact_quantiles(df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by, a column for each of ``shares``): quantiles between the two nearest values, as a sort of the whole group would give them,
    but from running counts: no task holds a group's values."""
    ranks = cumulative_counts(df, value, by)
    first, last = F.col("cum") - F.col("t"), F.col("cum") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col(value).cast("double")))

    cells = []
    for name, q in shares.items():
        place = q * (F.col("total") - 1)
        cells += [at(F.floor(place)).alias(f"{name}__low"), at(F.ceil(place)).alias(f"{name}__high"), F.max(place - F.floor(place)).alias(f"{name}__part")]
    found = ranks.groupBy(*by).agg(*cells)
    return found.select(*by, *[(F.col(f"{n}__low") + (F.col(f"{n}__high") - F.col(f"{n}__low")) * F.col(f"{n}__part")).alias(n) for n in shares])


def benjamini_hochberg(df: DataFrame, p: str, q: str, *keys: str) -> DataFrame:
    """``q``: adjusted over all rows with a p, null for the others. Equal p get one q, so no order of ties (``keys``) counts. The
    rows, which hold results of tests, are written once, so that no test is worked out twice. The join back has one row for each
    different p, so tasks of a p that very many rows share can be split. Minima run down from the largest p: over a frame that ends at
    the last row, Spark goes through all the rest anew for each row."""
    df = settle(df, "tests")
    ranked = cumulative_counts(df.select(p), p).withColumn("raw", F.col(p) * F.col("total") / F.col("cum"))
    ranked = settle(ranked, "ranked")
    lows = ranked.groupBy("__range").agg(F.min("raw").alias("low"))
    later = lows.select("__range", F.min("low").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    rest = Window.partitionBy("__range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    done = ranked.withColumn("own", F.min("raw").over(rest)).join(later, "__range")
    return df.join(done.select(p, F.least(F.lit(1.0), "own", "later").alias(q)), p, "left").select(*df.columns, q)


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-15:
                break
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-square; for the few rows that hold results of tests."""

    def tails(v: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else _gamma_q(b / 2, a / 2) for a, b in zip(v, k, strict=True)], dtype="float64")

    return F.pandas_udf(tails, "double")(x.cast("double"), df.cast("double"))


def _t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta by its continued fraction."""
    if df <= 0 or math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x or 1e-300) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or 1e-300)
            c = (1 + k / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h if flip else front * h


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t, for aggregated rows."""

    def tails(v: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else _t_tail(a, b) for a, b in zip(v, k, strict=True)], dtype="float64")

    return F.pandas_udf(tails, "double")(t.cast("double"), df.cast("double"))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, for aggregated rows."""

    def tails(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if pd.isna(a) else math.erfc(abs(a) / math.sqrt(2))).astype("float64")

    return F.pandas_udf(tails, "double")(z.cast("double"))


def pearson_r(x: str, y: str) -> Column:
    """Pearson r as an aggregate; null without rows or where one of the two doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (r, p, n) over the rows that have both."""
    one = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(pearson_r(x, y).alias("r"), F.count("*").alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return one.select("r", t_tail(F.when(F.col("n") > 2, t), F.col("n") - 2).alias("p"), "n")


def contingency_table_rows(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Array of the three rows (row, hit, miss, total) of a 2x2 table with its totals."""

    def row(name: str, x: Column, y: Column) -> Column:
        return F.struct(F.lit(name).alias("row"), x.alias("hit"), y.alias("miss"), (x + y).alias("total"))

    return F.array(row("in", a, b), row("out", c, d), row("total", a + c, b + d))


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places to which a permutation of 0..n-1, picked by ``seed``, takes ``i``: a four-round Feistel network over as many bits as ``n`` needs,
    walked on from places that are not below ``n`` until one is. Nothing is sorted or held."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = i.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        for k in range(4):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F) % (1 << 64))
            h = (right ^ key) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (h ^ h >> np.uint64(31)) & mask
        out[open_] = left << half | right
        open_ = open_[out[open_] >= n]
    return out.astype(np.int64)


def permutation_test(df: DataFrame, key: str, x: str, y: str, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """One row (r, n, rounds, as_extreme, p): two-sided, p = (as_extreme + 1) / (rounds + 1). ``key`` orders the rows, which are numbered once.

    In each round a keyed permutation of the numbers tells each row the place whose ``y`` it takes. All rounds meet these by one join on
    the place, and are summed by round in each task first: no round is sorted, and none is one task's. Rows without a value are left
    out; an empty table, or one that doesn't vary, gives no r and no extreme round. The numbered rows are written while the plan is made."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = settle(number_rows(rows, ["k", "x", "y"], "i").select("i", "x", "y"), "numbered")
    n = rows.count()

    def drawn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = part["i"].to_numpy() - 1
            for k in range(1, rounds + 1):
                yield pd.DataFrame({"round": k, "i": permuted(own, n, seed * 1_000_003 + k) + 1, "x": part["x"]})

    tried = rows.select("i", "x").mapInPandas(drawn, "round int, i long, x double").join(rows.select("i", "y"), "i")
    tried = tried.groupBy("round").agg(pearson_r("x", "y").alias("rr"))
    seen = rows.agg(pearson_r("x", "y").alias("r"), F.count("*").alias("n"))
    hits = seen.crossJoin(tried.agg(F.collect_list("rr").alias("rr")))  # a number for each round
    extreme = F.size(F.filter("rr", lambda v: F.abs(v) >= F.abs(F.col("r")) - 1e-12)).cast("long")
    hits = hits.select("r", "n", extreme.alias("as_extreme"))
    return hits.select("r", "n", F.lit(rounds).alias("rounds"), "as_extreme", ((F.col("as_extreme") + 1) / (rounds + 1)).alias("p"))


def pairwise_diff_test(sites: DataFrame, keys: Sequence[str], group: str, methylated: str, coverage: str, groups: tuple[str, str]) -> DataFrame:
    """For each site, pooled shares of two groups, their difference, and the two-sided Fisher p of the pooled counts."""
    cells = [F.sum(F.when(F.col(group) == g, F.col(c))).alias(f"{n}{i}") for i, g in enumerate(groups) for n, c in (("m", methylated), ("c", coverage))]
    t = sites.where(F.col(group).isin(*groups)).groupBy(*keys).agg(*cells).dropna(subset=["c0", "c1"])
    m0, m1, c0, c1 = (F.col(c) for c in ("m0", "m1", "c0", "c1"))
    p = fisher_exact_two_sided(m0, c0 - m0, m1, c1 - m1)
    return t.select(*keys, (m0 / c0).alias("share_a"), (m1 / c1).alias("share_b"), (m0 / c0 - m1 / c1).alias("meth_diff"), p.alias("p_value"))

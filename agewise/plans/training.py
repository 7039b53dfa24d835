"""Registered queries of clock training and of operators over ordered ranges, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agewise.functions import stats
from agewise.operators import clock, tables
from agewise.plans.bindings import query, t

_RATIOS, _STEPS, _FOLDS = (0.5, 1.0), 4, 5


@query(f"""
WITH raw AS (SELECT c_custkey % {_FOLDS} AS fold, c_acctbal / 1000.0 AS x, c_acctbal / 500.0 + c_custkey % 17 + c_nationkey AS y FROM customer),
s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM raw),
v AS (SELECT fold, (x - m) / sd AS z, y FROM raw, s),
most AS (SELECT abs(covar_pop(z, y)) AS c FROM v),
grid AS (SELECT k, q, c * pow(0.001, k / {_STEPS - 1}.0) AS step FROM most, range({_STEPS}) g(k), (SELECT unnest({list(_RATIOS)}) AS q)),
part AS (SELECT f, avg(z) AS zc, avg(y) AS yc, covar_pop(z, y) AS cov, var_pop(z) AS vz FROM v, range({_FOLDS}) h(f) WHERE fold <> f GROUP BY f),
every AS (SELECT avg(z) AS zc, avg(y) AS yc, covar_pop(z, y) AS cov, var_pop(z) AS vz FROM v),
fits AS (SELECT f, k, q, step, zc, yc, sign(cov) * greatest(abs(cov) - step, 0) / (vz + step / q * (1 - q)) AS b FROM part, grid),
errors AS (SELECT k, q, step, f, avg(pow(v.y - yc - b * (v.z - zc), 2)) AS e FROM fits JOIN v ON v.fold = fits.f GROUP BY ALL),
best AS (SELECT k, q, step, avg(e) AS mse FROM errors GROUP BY ALL ORDER BY mse, k, q LIMIT 1),
full_fit AS (SELECT q, step, mse, zc, yc, sign(cov) * greatest(abs(cov) - step, 0) / (vz + step / q * (1 - q)) AS b FROM every, best)
SELECT 'balance' AS cpg, round(b / sd, 4) AS coef, round(m, 6) AS fill, round(yc - b * zc - b / sd * m, 3) AS intercept, round(step / q, 5) AS alpha, q::DOUBLE AS l1_ratio, round(mse, 3) AS cv_mse FROM full_fit, s
""")
def train_elastic_net_cv(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(
        F.col("c_custkey").alias("sample_id"), (F.col("c_acctbal").cast("double") / 1000).alias("beta"), (F.col("c_custkey") % _FOLDS).cast("int").alias("fold"),
        (F.col("c_acctbal").cast("double") / 500 + F.col("c_custkey") % 17 + F.col("c_nationkey")).alias("age"),
    )
    matrix = c.select("sample_id", F.lit("balance").alias("cpg"), "beta")
    coefs, found = clock.train_elastic_net_cv(matrix, c.select("sample_id", "age", "fold"), l1_ratios=_RATIOS, n_alphas=_STEPS, folds=_FOLDS, tol=1e-9)
    told = {"intercept": 3, "alpha": 5, "l1_ratio": 6, "cv_mse": 3}
    return coefs.select("cpg", F.round("coef", 4).alias("coef"), F.round("fill", 6).alias("fill"), *[F.round(F.lit(float(found[k])), n).alias(k) for k, n in told.items()])


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS ordinal FROM lineitem")
def running_total_order(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return tables.running_total_order(rows, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_extendedprice")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, 1 - l_extendedprice::DOUBLE / 1e9 AS p FROM lineitem),
r AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p DESC) AS unused, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS cum, count(*) OVER () AS total FROM p)
SELECT l_orderkey, l_linenumber, round(least(1.0, min(p * total / cum) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 9) AS q FROM r
""")
def benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    """Many different values in a narrow range."""
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (1 - F.col("l_extendedprice").cast("double") / 1e9).alias("p"))
    return stats.benjamini_hochberg(rows, "p", "q").select("l_orderkey", "l_linenumber", F.round("q", 9).alias("q"))


@query("SELECT round(corr(c_acctbal::DOUBLE, (c_custkey % 97)::DOUBLE), 6) AS r, count(*) AS n, 200 AS rounds, true AS p_fits FROM customer")
def permutation_test(spark: SparkSession, d: str) -> DataFrame:
    """The rounds' draws are beyond SQL; their count and p go together."""
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 97).alias("y"))
    found = stats.permutation_test(c, "c_custkey", "c_acctbal", "y", rounds=200)
    fits = F.col("as_extreme").between(0, 200) & (F.col("p") == (F.col("as_extreme") + 1) / 201)
    return found.select(F.round("r", 6).alias("r"), "n", "rounds", fits.alias("p_fits"))

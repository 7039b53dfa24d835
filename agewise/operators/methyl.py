"""Methylation matrices in long form (sample, feature, value) and linear clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.functions.normalize import age_decade, age_stratum
from agewise.functions.stats import exact_quantiles, pearson_r


def apply_missing_policy(matrix: DataFrame, policy: str, feature: str = "cpg", value: str = "beta") -> DataFrame:
    """report: as it is; fail: raises if a value is missing (a job); impute_column_mean; drop_sites with a missing value."""
    missing = F.nanvl(F.col(value).cast("double"), F.lit(None))
    m = matrix.withColumn(value, missing)
    if policy == "report":
        return m
    if policy == "fail":
        if not m.where(F.col(value).isNull()).isEmpty():
            raise ValueError("the matrix has missing values")
        return m
    if policy == "impute_column_mean":
        means = m.groupBy(feature).agg(F.avg(value).alias("__m"))
        return m.join(means, feature).withColumn(value, F.coalesce(value, "__m")).drop("__m")
    if policy == "drop_sites":
        return m.join(m.where(F.col(value).isNull()).select(feature).distinct(), feature, "left_anti")
    raise ValueError(f"no policy {policy}")


def validate_matrix(matrix: DataFrame, expected: DataFrame, sample: str = "sample_id", feature: str = "cpg", value: str = "beta", low: float = 0.0, high: float = 1.0, samples: DataFrame | None = None, examples: int = 0) -> DataFrame:
    """(check, n, passed): duplicates, missing and extra features, missing cells, values not strictly inside the range; with ``samples``
    (their metadata) also samples that only the matrix or only the metadata has. ``examples`` adds the least so many of the keys found."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    held, want = matrix.select(feature).distinct(), expected.select(feature).distinct()
    cell = F.concat(F.col(sample).cast("string"), F.lit("/"), F.col(feature).cast("string"))
    twice = matrix.groupBy(sample, feature).agg((F.count("*") - 1).alias("n")).where(F.col("n") > 0)
    found = {
        "duplicate_cells": twice.select(cell.alias("key"), "n"),
        "missing_features": want.join(held, feature, "left_anti").select(F.col(feature).alias("key")),
        "extra_features": held.join(want, feature, "left_anti").select(F.col(feature).alias("key")),
        "missing_cells": matrix.where(x.isNull()).select(cell.alias("key")),
        "out_of_range": matrix.where((x <= low) | (x >= high)).select(cell.alias("key")),
    }
    if samples is not None:
        own, known = matrix.select(sample).distinct(), samples.select(sample).distinct()
        found["matrix_only_samples"] = own.join(known, sample, "left_anti").select(F.col(sample).alias("key"))
        found["metadata_only_samples"] = known.join(own, sample, "left_anti").select(F.col(sample).alias("key"))
    out = None
    for name, keys in found.items():
        n = F.coalesce(F.sum("n"), F.lit(0)) if "n" in keys.columns else F.count("*")
        row = keys.agg(F.lit(name).alias("check"), n.cast("long").alias("n"))
        if examples:
            some = keys.select(F.col("key").cast("string").alias("key")).orderBy("key").limit(examples)
            row = row.crossJoin(some.agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("examples")))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passed", F.col("n") == 0)


def missing_profile(matrix: DataFrame, n: int = 12, feature: str = "cpg", value: str = "beta") -> DataFrame:
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    return matrix.groupBy(feature).agg(F.count_if(x.isNull()).alias("n_missing")).orderBy(F.desc("n_missing"), feature).limit(n)


def align_features(matrix: DataFrame, model: DataFrame, sample: str = "sample_id", feature: str = "cpg", value: str = "beta", default: float = 0.5) -> DataFrame:
    """The model's features of every sample: coef and fill of ``model``, x (the value, else the fill, else the default) and imputed.

    Every sample's values are met by an equi join with the model. What a sample lacks comes from the model's list of features less
    the sample's own, one array a sample, so samples and features are never crossed."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    have = matrix.select(sample, feature, x.alias("__x")).join(model.select(feature, "coef", "fill"), feature)
    held = have.select(sample, feature, "coef", "fill", F.coalesce("__x", "fill", F.lit(default)).alias("x"), F.col("__x").isNull().alias("imputed"))
    names = model.agg(F.collect_list(feature).alias("__names"))
    own = matrix.select(sample).distinct().join(have.groupBy(sample).agg(F.collect_set(feature).alias("__own")), sample, "left")
    lacking = own.crossJoin(F.broadcast(names)).select(sample, F.explode(F.array_except("__names", F.coalesce("__own", F.array()))).alias(feature))
    filled = lacking.join(model.select(feature, "coef", "fill"), feature).select(
        sample, feature, "coef", "fill", F.coalesce("fill", F.lit(default)).alias("x"), F.lit(True).alias("imputed")
    )
    return held.unionByName(filled)


def dmr_summary(sites: DataFrame, region: list[str], pos: str, diff: str, p: str) -> DataFrame:
    """Sites, ends, width, mean difference and least p of each region."""
    return sites.groupBy(*region).agg(
        F.count("*").alias("n_cpg"), F.min(pos).alias("start"), F.max(pos).alias("end"), (F.max(pos) - F.min(pos) + 1).alias("width"),
        F.avg(diff).alias("mean_meth_diff"), F.min(p).alias("p_value"),
    )


def score_clock(matrix: DataFrame, model: DataFrame, intercept: float, sample: str = "sample_id", feature: str = "cpg", value: str = "beta", default: float = 0.5) -> DataFrame:
    """intercept + sum of coef * value, without expanding samples by features: what the model gives a sample that has none of
    its features is a constant, and each value that a sample has corrects it."""
    fill = F.coalesce("fill", F.lit(default))
    base = model.agg(F.coalesce(F.sum(F.col("coef") * fill), F.lit(0.0)).alias("base"))
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    have = matrix.join(model.select(feature, "coef", fill.alias("fill")), feature, "left")
    part = have.groupBy(sample).agg(F.sum(F.coalesce(F.col("coef") * (x - F.col("fill")), F.lit(0.0))).alias("part"))
    return part.crossJoin(base).select(sample, (F.lit(intercept) + F.col("base") + F.col("part")).alias("predicted_age"))


def score_horvath(matrix: DataFrame, model: DataFrame, intercept: float, **names: str) -> DataFrame:
    """The raw linear sum, missing values 0.5, cut to 0..120."""
    scored = score_clock(matrix, model.withColumn("fill", F.lit(None).cast("double")), intercept, **names)
    return scored.withColumn("predicted_age", F.least(F.greatest("predicted_age", F.lit(0.0)), F.lit(120.0)))


def clock_metrics(df: DataFrame, y: str = "age", p: str = "predicted_age") -> DataFrame:
    """One row (n, mae, median_ae, rmse, pearson_r, r2) over the samples that have both."""
    err = F.col(p) - F.col(y)
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("__e", F.abs(err))
    m = rows.agg(
        F.count("*").alias("n"), F.avg("__e").alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), pearson_r(y, p).alias("pearson_r"),
        F.sum(err * err).alias("sse"), F.var_pop(y).alias("v"),
    )
    m = m.crossJoin(F.broadcast(exact_quantiles(rows, "__e", {"median_ae": 0.5})))
    r2 = F.when(F.col("v") > 0, 1 - F.col("sse") / (F.col("v") * F.col("n")))
    return m.select("n", "mae", "median_ae", "rmse", "pearson_r", r2.alias("r2"))


def mae_by_decade(df: DataFrame, y: str = "age", p: str = "predicted_age") -> DataFrame:
    return df.groupBy(age_decade(F.col(y)).alias("decade")).agg(F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"), F.count("*").alias("n"))


def mae_by_stratum(df: DataFrame, y: str = "age", p: str = "predicted_age") -> DataFrame:
    """Also strata without samples: null and 0."""
    strata = df.sparkSession.createDataFrame([("<30",), ("30-60",), (">60",)], "stratum string")
    found = df.groupBy(age_stratum(F.col(y)).alias("stratum")).agg(F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"), F.count("*").alias("n"))
    return strata.join(found, "stratum", "left").na.fill(0, ["n"])

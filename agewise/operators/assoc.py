"""Phenotype by genotype: audited join, contingency, association; allele frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.functions import stats


def join_audit(left: DataFrame, right: DataFrame, left_id: str, right_id: str, max_drop_rate: float = 0.01) -> DataFrame:
    """One row: distinct ids of either side, matched, orphans, drop rate over their union, whether that halts the join, and whether the
    ids' types differ."""
    mismatch = left.schema[left_id].dataType != right.schema[right_id].dataType
    a = left.select(F.trim(F.col(left_id).cast("string")).alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("l", F.lit(1))
    b = right.select(F.trim(F.col(right_id).cast("string")).alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("r", F.lit(1))
    both = a.join(b, "id", "full_outer")
    counts = both.agg(
        F.count("l").alias("left_n"), F.count("r").alias("right_n"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"),
        F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"),
        F.count("*").alias("n"),
    )
    rate = F.when(F.col("n") == 0, 1.0).otherwise((F.col("left_only") + F.col("right_only")) / F.col("n"))
    return counts.withColumn("drop_rate", rate).withColumn("halted", F.col("drop_rate") > max_drop_rate).withColumn("type_mismatch", F.lit(mismatch)).drop("n")


def audited_inner_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, max_drop_rate: float = 0.01) -> DataFrame:
    """Inner join on trimmed ids as strings, in column id; raises if the audit halts it. The audit runs a job."""
    audit = join_audit(left, right, left_id, right_id, max_drop_rate).first()
    if audit["halted"]:
        raise ValueError(f"drop rate {audit['drop_rate']:.4f} is over {max_drop_rate}")
    a = left.withColumn("id", F.trim(F.col(left_id).cast("string")))
    b = right.withColumn("id", F.trim(F.col(right_id).cast("string"))).drop(right_id)
    return a.join(b, "id")


def genotype_contingency(df: DataFrame, key: str, dosage: str, outcome: str) -> DataFrame:
    """Counts n<outcome><dosage> for each key; fractions of a dosage are cut off, pairs without a dosage of
    0 to 2 or an outcome of exactly 0 or 1 are dropped, text that is no number among them."""
    g, y = F.col(dosage).try_cast("double"), F.col(outcome).try_cast("double")
    valid = df.where(g.between(0, 2) & y.isin(0, 1))
    g = F.floor(g)
    return valid.groupBy(key).agg(*[F.count_if((y == o) & (g == d)).alias(f"n{o}{d}") for o in (0, 1) for d in (0, 1, 2)])


def association_scan(df: DataFrame, key: str, dosage: str, outcome: str) -> DataFrame:
    """Dominant odds ratio, Woolf interval, two-sided Fisher p and n for each key. Keys without cases or controls, where
    there is no test, are flagged degenerate: inf, 0 or NaN by the reference counts, p 0 or 1."""
    t = genotype_contingency(df, key, dosage, outcome)
    a, b = F.col("n11") + F.col("n12"), F.col("n10")
    c, d = F.col("n01") + F.col("n02"), F.col("n00")
    no_controls, no_cases = c + d == 0, a + b == 0
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    odds = F.when(no_controls, F.when(b > 0, inf).otherwise(nan)).when(no_cases, F.when(c > 0, 0.0).otherwise(nan)).otherwise(stats.dominant_odds_ratio(a, b, c, d))
    p = F.when(no_controls, F.when(b > 0, 0.0).otherwise(1.0)).when(no_cases, F.when(c > 0, 0.0).otherwise(1.0)).otherwise(stats.fisher_exact_two_sided(a, b, c, d))
    ci = stats.woolf_ci(a, b, c, d)
    return t.select(
        key, odds.alias("odds_ratio"), F.when(~(no_controls | no_cases), ci["low"]).alias("ci_low"),
        F.when(~(no_controls | no_cases), ci["high"]).alias("ci_high"), p.alias("p_value"), (a + b + c + d).alias("n"), (no_controls | no_cases).alias("degenerate"),
    )


def allele_frequency(df: DataFrame, key: str, genotype: str) -> DataFrame:
    """(AF, N_called) over wholly called diploid genotypes such as 0/1 or 1|2; every allele but the reference counts."""
    alleles = F.split(F.split(F.col(genotype), ":")[0], r"[/|]")
    called = (F.size(alleles) == 2) & (F.size(F.filter(alleles, lambda a: (a == ".") | (a == ""))) == 0)
    alts = F.when(called, F.size(F.filter(alleles, lambda a: a != "0")))
    n = F.count(alts)
    return df.groupBy(key).agg(F.when(n > 0, F.sum(alts) / (2 * n)).alias("AF"), n.alias("N_called"))


def allele_counts(df: DataFrame, key: str, dosage: str) -> DataFrame:
    """AC, AN and AF over called diploids, and how many were called."""
    called = F.col(dosage).isNotNull()
    return df.groupBy(key).agg(
        F.coalesce(F.sum(dosage), F.lit(0)).cast("long").alias("ac"), (2 * F.count_if(called)).alias("an"), F.count_if(called).alias("n_called")
    ).withColumn("af", F.when(F.col("an") > 0, F.col("ac") / F.col("an")))


def compare_af(left: DataFrame, right: DataFrame, key: str, a: str, b: str, threshold: float = 0.05) -> DataFrame:
    """``left`` with the frequency of ``right``, their absolute difference and whether it is at or over the threshold."""
    joined = left.select(key, a).join(right.select(key, b), key, "left")
    return joined.withColumn("abs_diff", F.abs(F.col(a) - F.col(b))).withColumn("large_diff", F.coalesce(F.col("abs_diff") >= threshold, F.lit(False)))


def af_concordance_summary(cmp: DataFrame, a: str, b: str, threshold: float = 0.05) -> DataFrame:
    """One row of counts, and the mean and median difference of the pairs under the threshold; the median comes from running counts, whose
    table is written while the plan is made."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    near = both & (F.col("abs_diff") < threshold)
    one = cmp.agg(
        F.count("*").alias("total"), F.count_if(both).alias("both_present"), F.count_if(F.col(a).isNull()).alias("missing_a"),
        F.count_if(F.col(b).isNull()).alias("missing_b"), F.count_if(near).alias("concordant"), F.count_if(both & ~near).alias("discordant"),
        F.avg(F.when(near, F.col("abs_diff"))).alias("mean_diff"),
    )
    return one.crossJoin(F.broadcast(stats.exact_quantiles(cmp.where(near), "abs_diff", {"median_diff": 0.5})))


def top_discordant(cmp: DataFrame, key: str, n: int = 5) -> DataFrame:
    return cmp.where(F.col("abs_diff").isNotNull()).orderBy(F.desc("abs_diff"), key).limit(n)

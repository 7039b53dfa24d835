"""Tissue eQTL summaries and the joins of annotated variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_target_tissues(eqtls: DataFrame, tissues: Sequence[str], tissue: str = "tissue") -> DataFrame:
    return eqtls.where(F.col(tissue).isin(*tissues))


def best_hit_per_key(df: DataFrame, key: str, p: str, *ties: str) -> DataFrame:
    """The row of least p for each key; nulls last, then ``ties``."""
    order = Window.partitionBy(key).orderBy(F.col(p).asc_nulls_last(), *ties)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == 1).drop("__n")


def dedup_keep_first(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__n") == 1).drop("__n")


def summarize_eqtls(eqtls: DataFrame, key: str = "rsid", tissue: str = "tissue", gene: str = "gene_symbol", slope: str = "nes", p: str = "p_value", ties: Sequence[str] = ()) -> DataFrame:
    """Hits, best tissue, gene, slope and p (least p) and the sorted tissues of each variant; one grouped aggregate."""
    known = F.nanvl(F.col(p).cast("double"), F.lit(None))
    best = F.min(F.struct(known.isNull().alias("none"), known.alias("p"), F.col(tissue).alias("t"), F.col(gene).alias("g"), *ties, F.col(slope).alias("s")))
    return (
        eqtls.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("gtex_n_eqtls"), best.alias("b"), F.array_join(F.array_sort(F.collect_set(tissue)), ";").alias("gtex_tissues"))
        .select(
            key, "gtex_n_eqtls", F.col("b.t").alias("gtex_best_tissue"), F.col("b.g").alias("gtex_best_gene"),
            F.col("b.s").alias("gtex_best_slope"), F.col("b.p").alias("gtex_best_p_value"), "gtex_tissues",
        )
    )


def join_eqtl_summary(variants: DataFrame, summary: DataFrame, on: str = "rsid") -> DataFrame:
    return variants.join(summary, on, "left")


def join_scores(variants: DataFrame, scores: DataFrame, on: str, prefix: str, *order: str) -> DataFrame:
    """Left join of one score row for each key, its prefixed columns only."""
    first = dedup_keep_first(scores.where(F.col(on).isNotNull()), [on], *(order or [on]))
    return variants.join(first.select(on, *[c for c in scores.columns if c.startswith(prefix)]), on, "left")


def link_variant_probes(variants: DataFrame, probes: DataFrame, gene: str = "gene_symbol", probe: str = "IlmnID", genes: str = "UCSC_RefGene_Name") -> DataFrame:
    """Variants and probes whose gene list, split at semicolons, holds the variant's gene."""
    each = probes.select(probe, F.explode(F.split(genes, ";")).alias("__g"))
    each = each.select(probe, F.trim("__g").alias(gene)).where(F.col(gene) != "").distinct()
    return variants.join(each, gene)


def filter_high_impact(df: DataFrame, missense: str = "alphamissense_score", impact: str = "vep_impact", threshold: float = 0.5) -> DataFrame:
    """Rows over the threshold or of HIGH or MODERATE impact; columns that are absent drop out, none present: no rows."""
    tests = []
    if missense in df.columns:
        tests.append(F.nanvl(F.col(missense).cast("double"), F.lit(None)) > threshold)
    if impact in df.columns:
        tests.append(F.upper(impact).isin("HIGH", "MODERATE"))
    kept = F.lit(False)
    for t in tests:
        kept = kept | F.coalesce(t, F.lit(False))
    return df.where(kept)


def sample_risk(genotypes: DataFrame, risks: DataFrame, sample: str = "sample_id", variant: str = "rsid", dosage: str = "alt_dosage", risk: str = "risk") -> DataFrame:
    """Dosage-weighted mean risk of each sample. A variant without a risk adds 0 but its dosage counts."""
    joined = genotypes.join(risks.select(variant, risk), variant, "left")
    d = F.coalesce(F.col(dosage).cast("double"), F.lit(0.0))
    whole = F.sum(d)
    mean = F.when(whole > 0, F.sum(d * F.coalesce(risk, F.lit(0.0))) / whole).otherwise(0.0)
    return joined.groupBy(sample).agg(mean.alias("sample_risk"), F.count_distinct(variant).alias("n_variants"))

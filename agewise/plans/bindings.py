"""Registered queries: each operator bound to the shared test tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agewise.functions import normalize as nz
from agewise.functions import scores, stats
from agewise.operators import assoc, cohort, enrich, eqtl, methyl, quality, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


# ---- scalars -------------------------------------------------------------------------------------------------------

CHROM = "(CASE p_partkey % 5 WHEN 0 THEN ' chr' || p_size WHEN 1 THEN 'Chr0' || p_size WHEN 2 THEN 'X' WHEN 3 THEN 'chrM' ELSE p_size || '.0' END)"


@query(f"""
WITH c AS (SELECT p_partkey, regexp_replace(trim({CHROM}), '^chr', '', 'i') AS s FROM part),
l AS (SELECT p_partkey, s, CASE WHEN try_cast(s AS DOUBLE) = floor(try_cast(s AS DOUBLE)) THEN cast(cast(try_cast(s AS DOUBLE) AS BIGINT) AS VARCHAR)
      WHEN upper(s) = 'M' THEN 'MT' ELSE upper(s) END AS label FROM c)
SELECT p_partkey, s AS chrom, label, 'chr' || s AS prefixed,
       CASE WHEN try_cast(label AS INTEGER) BETWEEN 1 AND 22 THEN try_cast(label AS INTEGER) WHEN label = 'X' THEN 23 WHEN label = 'Y' THEN 24 WHEN label = 'MT' THEN 25 ELSE 99 END AS sort_key,
       s || ':' || p_partkey || ':' || 'A' || ':' || CASE WHEN p_partkey % 2 = 0 THEN 'T' ELSE 'G' END AS variant_key,
       label || '-' || p_partkey || '-A-' || CASE WHEN p_partkey % 2 = 0 THEN 'T' ELSE 'G' END AS gnomad_id,
       'F22418_imputed_chr' || label || '_GRCh38_' || p_partkey AS chunk
FROM l
""")
def prepare_variants(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumn("raw", F.expr(CHROM)).withColumn("ref", F.lit(" a ")).withColumn("alt", F.when(F.col("p_partkey") % 2 == 0, "t,g").otherwise("g"))
    c, pos = F.col("raw"), F.col("p_partkey")
    return p.select(
        pos, nz.normalize_chrom(c).alias("chrom"), nz.normalize_chrom_label(c).alias("label"), nz.chrom_prefixed(c).alias("prefixed"),
        nz.chrom_sort_key(c).alias("sort_key"), nz.variant_key(c, pos, F.col("ref"), F.col("alt")).alias("variant_key"),
        nz.gnomad_variant_id(c, pos, F.lit("A"), nz.first_allele(F.col("alt"))).alias("gnomad_id"), nz.extraction_chunk_label(c, pos).alias("chunk"),
    )


RSID = "(CASE p_partkey % 4 WHEN 0 THEN ' RS' || p_partkey WHEN 1 THEN cast(p_partkey AS VARCHAR(20)) WHEN 2 THEN 'nan' ELSE 'rs' || p_partkey END)"


@query(f"""
WITH x AS (SELECT p_partkey, trim({RSID}) AS s FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(s, '[rR][sS][0-9]+') THEN s END AS strict,
       CASE WHEN s = '' OR lower(s) LIKE 'rs%' THEN s ELSE 'rs' || s END AS lenient,
       CASE WHEN regexp_full_match(s, '[rR][sS][0-9]+') THEN lower(s) ELSE '' END AS low FROM x
""")
def normalize_rsids(spark: SparkSession, d: str) -> DataFrame:
    c = F.expr(RSID)
    return t(spark, d, "part").select("p_partkey", nz.normalize_rsid_strict(c).alias("strict"), nz.normalize_rsid_lenient(c).alias("lenient"), nz.normalize_rsid_lower(c).alias("low"))


@query("""
SELECT c_custkey, CASE WHEN a < 20 THEN '<20' WHEN a >= 90 THEN '90+' ELSE (floor(a / 10) * 10)::INT || '-' || ((floor(a / 10) * 10)::INT + 9) END AS decade,
       CASE WHEN a < 30 THEN '<30' WHEN a <= 60 THEN '30-60' ELSE '>60' END AS stratum,
       CASE c_custkey % 4 WHEN 3 THEN 'Missing' WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END AS genotype,
       CASE WHEN c_mktsegment LIKE 'B%' THEN 1 ELSE 0 END AS coded
FROM (SELECT *, c_acctbal / 100.0 AS a FROM customer)
""")
def cohort_labels(spark: SparkSession, d: str) -> DataFrame:
    a, g = F.col("c_acctbal") / 100.0, F.when(F.col("c_custkey") % 4 < 3, F.col("c_custkey") % 4)
    code = F.when(F.col("c_mktsegment").startswith("B"), F.col("c_mktsegment")).otherwise("  ")
    return t(spark, d, "customer").select("c_custkey", nz.age_decade(a).alias("decade"), nz.age_stratum(a).alias("stratum"), nz.genotype_label(g).alias("genotype"), nz.binary_from_code(code).alias("coded"))


@query("""
SELECT l_orderkey, l_linenumber, round(l_tax - l_discount, 6) AS diff,
       round(CASE WHEN l_discount = 0 THEN 0 ELSE (l_tax - l_discount) / l_discount * 100 END, 6) AS perc_change,
       round(abs(CASE WHEN l_discount = 0 THEN 0 ELSE (l_tax - l_discount) / l_discount * 100 END), 6) AS abs_perc_change,
       round(l_discount * power(10.0, -l_linenumber), 12) AS p_value
FROM lineitem
""")
def percent_change(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem").withColumn("x", nz.percent_change(F.col("l_discount"), F.col("l_tax")))
    p = nz.pvalue_from_parts(F.col("l_discount"), -F.col("l_linenumber"))
    return x.select("l_orderkey", "l_linenumber", *[F.round(f"x.{c}", 6).alias(c) for c in ("diff", "perc_change", "abs_perc_change")], F.round(p, 12).alias("p_value"))


# ---- risk and eQTL ---------------------------------------------------------------------------------------------------

TISSUES = [f"NATION_{k}" for k in range(0, 25, 2)]
TISSUE_SQL = ", ".join(f"'{n}'" for n in TISSUES)
EQTL = f"""(SELECT l_partkey AS rsid, n_name AS tissue, l_returnflag AS gene_symbol, l_discount AS nes, l_extendedprice / 1e6 AS p_value, l_orderkey, l_linenumber
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ({TISSUE_SQL}))"""


def _eqtls(spark: SparkSession, d: str) -> DataFrame:
    li, s, n = t(spark, d, "lineitem"), t(spark, d, "supplier"), t(spark, d, "nation")
    long = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    long = long.select(F.col("l_partkey").alias("rsid"), F.col("n_name").alias("tissue"), F.col("l_returnflag").alias("gene_symbol"), F.col("l_discount").alias("nes"), (F.col("l_extendedprice") / 1e6).alias("p_value"), "l_orderkey", "l_linenumber")
    return eqtl.filter_target_tissues(long, TISSUES)


SUMMARY = f"""(SELECT rsid, count(*) AS gtex_n_eqtls, arg_min(tissue, k) AS gtex_best_tissue, arg_min(gene_symbol, k) AS gtex_best_gene, arg_min(nes, k) AS gtex_best_slope,
  min(p_value) AS gtex_best_p_value, string_agg(DISTINCT tissue, ';' ORDER BY tissue) AS gtex_tissues
  FROM (SELECT *, row(p_value, tissue, gene_symbol, l_orderkey, l_linenumber) AS k FROM {EQTL}) GROUP BY rsid)"""


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return eqtl.summarize_eqtls(_eqtls(spark, d), ties=["l_orderkey", "l_linenumber"])


@query(f"SELECT rsid, gtex_n_eqtls, gtex_best_tissue, gtex_best_gene, round(gtex_best_slope, 6) AS gtex_best_slope, round(gtex_best_p_value, 9) AS gtex_best_p_value, gtex_tissues FROM {SUMMARY}")
def summarize_eqtls(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).withColumn("gtex_best_slope", F.round("gtex_best_slope", 6)).withColumn("gtex_best_p_value", F.round("gtex_best_p_value", 9))


@query(f"SELECT rsid, tissue, l_orderkey, l_linenumber FROM {EQTL} QUALIFY row_number() OVER (PARTITION BY rsid ORDER BY p_value, tissue, l_orderkey, l_linenumber) = 1")
def best_hit_per_key(spark: SparkSession, d: str) -> DataFrame:
    return eqtl.best_hit_per_key(_eqtls(spark, d), "rsid", "p_value", "tissue", "l_orderkey", "l_linenumber").select("rsid", "tissue", "l_orderkey", "l_linenumber")


IMPACT = "(CASE p_partkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' WHEN 3 THEN 'MODIFIER' END)"
RISK = f"""(SELECT p_partkey, 0.25 * coalesce(CASE upper({IMPACT}) WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN .7 WHEN 'LOW' THEN .3 WHEN 'MODIFIER' THEN .1 END, 0)
  + 0.25 * least(abs(p_retailprice % 100) / 50, 1) + 0.25 * least(p_size / 50.0, 1)
  + 0.15 * (coalesce(gtex_n_eqtls, 0) / (coalesce(gtex_n_eqtls, 0) + 5.0) + coalesce(least(greatest(-log10(least(greatest(gtex_best_p_value, 1e-300), 1)) / 10, 0), 1), 0)) / 2
  + 0.10 * least(abs(p_size - 25) / 10.0, 1) AS risk
  FROM part LEFT JOIN {SUMMARY} s ON rsid = p_partkey)"""


def _risks(spark: SparkSession, d: str) -> DataFrame:
    v = t(spark, d, "part").withColumnRenamed("p_partkey", "rsid")
    v = v.withColumns({"vep_impact": F.expr(IMPACT.replace("p_partkey", "rsid")), "alphagenome_abs_perc_change": F.col("p_retailprice") % 100, "am": F.col("p_size") / 50.0, "accel": (F.col("p_size") - 25).cast("double")})
    v = eqtl.join_eqtl_summary(v, _summary(spark, d))
    channels = {
        "vep": scores.score_vep_impact(F.col("vep_impact")), "alphagenome": scores.score_alphagenome(v), "alphamissense": scores.score_alphamissense(F.col("am")),
        "gtex": scores.score_gtex_eqtl(F.col("gtex_n_eqtls"), F.col("gtex_best_p_value")), "epigenetic": scores.score_epigenetic(F.col("accel")),
    }
    return v.select("rsid", "vep_impact", "am", *[c.alias(f"{k}_channel") for k, c in channels.items()], scores.composite_risk(channels).alias("risk"))


@query(f"""SELECT p_partkey AS rsid, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 WHEN 3 THEN 0.1 ELSE 0 END::DOUBLE AS vep_channel, round(least(abs(p_retailprice % 100) / 50, 1), 6) AS alphagenome_channel,
 round(least(p_size / 50.0, 1)::DOUBLE, 6) AS alphamissense_channel, round(least(abs(p_size - 25) / 10.0, 1)::DOUBLE, 6) AS epigenetic_channel, round(risk, 6) AS risk FROM {RISK} r JOIN (SELECT p_partkey AS k, p_retailprice, p_size FROM part) ON k = p_partkey""")
def composite_risk(spark: SparkSession, d: str) -> DataFrame:
    return _risks(spark, d).select("rsid", *[r6(f"{k}_channel") for k in ("vep", "alphagenome", "alphamissense", "epigenetic")], r6("risk"))


@query(f"SELECT p_partkey AS rsid, upper({IMPACT}) AS impact FROM part WHERE p_size / 50.0 > 0.5 OR upper({IMPACT}) IN ('HIGH', 'MODERATE')")
def filter_high_impact(spark: SparkSession, d: str) -> DataFrame:
    v = t(spark, d, "part").select(F.col("p_partkey").alias("rsid"), F.expr(IMPACT).alias("vep_impact"), (F.col("p_size") / 50.0).alias("alphamissense_score"))
    return eqtl.filter_high_impact(v).select("rsid", F.upper("vep_impact").alias("impact"))


@query(f"""
SELECT l_suppkey AS sample_id, round(CASE WHEN sum(g) > 0 THEN sum(g * risk) / sum(g) ELSE 0 END, 6) AS sample_risk, count(DISTINCT l_partkey) AS n_variants
FROM (SELECT l_suppkey, l_partkey, cast(floor(l_quantity) AS INTEGER) % 3 AS g FROM lineitem) JOIN {RISK} r ON l_partkey = p_partkey GROUP BY l_suppkey
""")
def sample_risk(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("rsid"), (F.col("l_quantity").cast("int") % 3).alias("alt_dosage"))
    return eqtl.sample_risk(g, _risks(spark, d)).withColumn("sample_risk", F.round("sample_risk", 6))


@query("""
SELECT p_type, p_brand AS probe, g AS gene_symbol FROM (SELECT DISTINCT p_type, upper(string_split(p_name, ' ')[1]) AS gene FROM part) v
JOIN (SELECT DISTINCT p_brand, upper(trim(unnest(string_split(p_name, ' ')))) AS g FROM part) p ON g = gene WHERE g <> ''
""")
def link_variant_probes(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    v = p.select("p_type", F.upper(F.split("p_name", " ")[0]).alias("gene_symbol")).distinct()
    probes = p.select(F.col("p_brand").alias("IlmnID"), F.translate(F.upper("p_name"), " ", ";").alias("UCSC_RefGene_Name"))
    return eqtl.link_variant_probes(v, probes).select("p_type", F.col("IlmnID").alias("probe"), "gene_symbol")


# ---- association and frequencies --------------------------------------------------------------------------------------

@query("""
WITH a AS (SELECT DISTINCT cast(c_custkey AS VARCHAR) AS id FROM customer), b AS (SELECT DISTINCT cast(o_custkey AS VARCHAR) AS id FROM orders),
j AS (SELECT a.id AS l, b.id AS r FROM a FULL JOIN b ON a.id = b.id)
SELECT count(l) AS left_n, count(r) AS right_n, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS matched, count(*) FILTER (WHERE r IS NULL) AS left_only,
       count(*) FILTER (WHERE l IS NULL) AS right_only, round(count(*) FILTER (WHERE l IS NULL OR r IS NULL) / count(*), 6) AS drop_rate,
       count(*) FILTER (WHERE l IS NULL OR r IS NULL) / count(*) > 0.01 AS halted, false AS type_mismatch FROM j
""")
def join_audit(spark: SparkSession, d: str) -> DataFrame:
    return assoc.join_audit(t(spark, d, "customer"), t(spark, d, "orders"), "c_custkey", "o_custkey").withColumn("drop_rate", F.round("drop_rate", 6))


@query("SELECT trim(cast(o_orderkey AS VARCHAR)) AS id, o_custkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def audited_inner_join(spark: SparkSession, d: str) -> DataFrame:
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return assoc.audited_inner_join(o, li, "o_orderkey", "l_orderkey", max_drop_rate=1.0).select("id", "o_custkey", "l_linenumber")


GENO = "(SELECT o_orderpriority AS rsid, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 3 END AS g, (o_orderstatus = 'F')::INT AS y FROM orders)"


def _geno(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("rsid"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 3).alias("g"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


COUNTS = ", ".join(f"count(*) FILTER (WHERE y = {o} AND g = {k}) AS n{o}{k}" for o in (0, 1) for k in (0, 1, 2))


@query(f"SELECT rsid, {COUNTS} FROM {GENO} WHERE g IS NOT NULL GROUP BY rsid")
def genotype_contingency(spark: SparkSession, d: str) -> DataFrame:
    return assoc.genotype_contingency(_geno(spark, d), "rsid", "g", "y")


@query(f"""
WITH c AS (SELECT rsid, (n11 + n12)::DOUBLE AS a, n10::DOUBLE AS b, (n01 + n02)::DOUBLE AS c, n00::DOUBLE AS d FROM (SELECT rsid, {COUNTS} FROM {GENO} WHERE g IS NOT NULL GROUP BY rsid))
SELECT rsid, round(a * d / (b * c), 6) AS odds_ratio, round(exp(ln(a * d / (b * c)) - 1.959964 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS ci_low,
       round(exp(ln(a * d / (b * c)) + 1.959964 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS ci_high, (a + b + c + d)::BIGINT AS n, false AS degenerate,
       round((SELECT sum(m) FROM (SELECT exp(lgamma(a+b+1) - lgamma(k+1) - lgamma(a+b-k+1) + lgamma(c+d+1) - lgamma(a+c-k+1) - lgamma(c+d-a-c+k+1) - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1)) AS m,
            exp(lgamma(a+b+1) - lgamma(a+1) - lgamma(b+1) + lgamma(c+d+1) - lgamma(c+1) - lgamma(d+1) - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1)) AS seen
            FROM (SELECT unnest(range(greatest(0, a - d)::BIGINT, least(a + b, a + c)::BIGINT + 1))::DOUBLE AS k)) WHERE m <= seen * (1 + 1e-7)), 6) AS p_value
FROM c
""")
def association_scan(spark: SparkSession, d: str) -> DataFrame:
    return assoc.association_scan(_geno(spark, d), "rsid", "g", "y").select("rsid", r6("odds_ratio"), r6("ci_low"), r6("ci_high"), r6("p_value"), "n", "degenerate")


@query(f"SELECT rsid, coalesce(sum(g), 0)::BIGINT AS ac, 2 * count(g) AS an, count(g) AS n_called, round(sum(g) / (2.0 * count(g)), 6) AS af FROM {GENO} GROUP BY rsid")
def allele_counts(spark: SparkSession, d: str) -> DataFrame:
    return assoc.allele_counts(_geno(spark, d), "rsid", "g").withColumn("af", F.round("af", 6))


@query("""SELECT l_partkey, round(sum(alts) / (2.0 * count(alts)), 6) AS "AF", count(alts) AS "N_called" FROM (SELECT l_partkey, CASE l_linenumber % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS alts FROM lineitem) GROUP BY 1""")
def allele_frequency(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber") % 5
    calls = t(spark, d, "lineitem").withColumn("gt", F.when(k == 0, "0/0:9").when(k == 1, "0|1").when(k == 2, "1/2").when(k == 3, "./1").otherwise("1"))
    return assoc.allele_frequency(calls, "l_partkey", "gt").withColumn("AF", F.round("AF", 6))


AF = """(SELECT a.k, x, y, abs(x - y) AS abs_diff, coalesce(abs(x - y) >= 0.03, false) AS large_diff FROM
  (SELECT l_partkey AS k, round(avg(l_discount), 9) AS x FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1) a LEFT JOIN (SELECT l_partkey AS k, round(avg(l_discount), 9) AS y FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1) b ON a.k = b.k)"""


def _af(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    a = li.where(F.col("l_orderkey") % 2 == 0).groupBy(F.col("l_partkey").alias("k")).agg(F.round(F.avg("l_discount"), 9).alias("x"))
    b = li.where(F.col("l_orderkey") % 2 == 1).groupBy(F.col("l_partkey").alias("k")).agg(F.round(F.avg("l_discount"), 9).alias("y"))
    return assoc.compare_af(a, b, "k", "x", "y", 0.03)


@query(f"SELECT k, x, y, round(abs_diff, 9) AS abs_diff FROM {AF}")
def compare_af(spark: SparkSession, d: str) -> DataFrame:
    return _af(spark, d).select("k", "x", "y", F.round("abs_diff", 9).alias("abs_diff"))


@query(f"""SELECT count(*) AS total, count(y) AS both_present, count(*) FILTER (WHERE x IS NULL) AS missing_a, count(*) FILTER (WHERE y IS NULL) AS missing_b,
  count(*) FILTER (WHERE abs_diff < 0.0300000001) AS concordant, count(*) FILTER (WHERE abs_diff >= 0.0300000001) AS discordant,
  round(avg(abs_diff) FILTER (WHERE abs_diff < 0.0300000001), 6) AS mean_diff, round(median(abs_diff) FILTER (WHERE abs_diff < 0.0300000001), 6) AS median_diff FROM {AF}""")
def af_concordance_summary(spark: SparkSession, d: str) -> DataFrame:
    # just over a decimal fraction, so that the last bit of a mean decides nothing
    return assoc.af_concordance_summary(_af(spark, d), "x", "y", 0.0300000001).withColumn("mean_diff", F.round("mean_diff", 6)).withColumn("median_diff", F.round("median_diff", 6))


@query(f"SELECT k, round(abs_diff, 6) AS abs_diff FROM {AF} WHERE abs_diff IS NOT NULL ORDER BY round(abs_diff, 8) DESC, k LIMIT 5")
def top_discordant(spark: SparkSession, d: str) -> DataFrame:
    rounded = _af(spark, d).withColumn("abs_diff", F.round("abs_diff", 8))
    return assoc.top_discordant(rounded, "k").select("k", r6("abs_diff"))


# ---- sets ---------------------------------------------------------------------------------------------------------------

@query("""
WITH u AS (SELECT DISTINCT p_partkey AS gene FROM part WHERE p_size > 5), a AS (SELECT DISTINCT p_brand AS set_name, p_partkey AS gene FROM part JOIN u ON gene = p_partkey),
b AS (SELECT DISTINCT cast(p_size % 4 AS VARCHAR) AS target, p_partkey AS gene FROM part JOIN u ON gene = p_partkey),
g AS (SELECT set_name, target, x.a, y.b, (SELECT count(*) FROM u) AS n, (SELECT count(*) FROM a JOIN b USING (gene) WHERE a.set_name = x.set_name AND b.target = y.target) AS k
      FROM (SELECT set_name, count(*) AS a FROM a GROUP BY 1) x, (SELECT target, count(*) AS b FROM b GROUP BY 1) y),
p AS (SELECT *, least(1, (SELECT sum(exp(lgamma(a+1) - lgamma(i+1) - lgamma(a-i+1) + lgamma(n-a+1) - lgamma(b-i+1) - lgamma(n-a-b+i+1) - lgamma(n+1) + lgamma(b+1) + lgamma(n-b+1)))
      FROM (SELECT unnest(range(greatest(k, a + b - n), least(a, b) + 1)) AS i))) AS p_value FROM g),
r AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, set_name, target) AS raw FROM p)
SELECT set_name, target, k, a, b, n, round(a * b / n, 6) AS expected, round(k / (a * b / n), 6) AS fold, round(p_value, 6) AS p_value,
       round(least(1, min(raw) OVER (ORDER BY p_value, set_name, target ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM r
""")
def enrichment_table(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    sets, targets = p.select(F.col("p_brand").alias("set_name"), F.col("p_partkey").alias("gene")), p.select((F.col("p_size") % 4).cast("string").alias("target"), F.col("p_partkey").alias("gene"))
    out = enrich.enrichment_table(sets, targets, p.where(F.col("p_size") > 5).select(F.col("p_partkey").alias("gene")))
    return out.select("set_name", "target", "k", "a", "b", "n", r6("expected"), r6("fold"), r6("p_value"), r6("q_value"))


@query("""SELECT count(*) FILTER (WHERE a.g IS NOT NULL AND b.g IS NOT NULL) AS overlap, count(*) FILTER (WHERE b.g IS NULL) AS left_only, count(*) FILTER (WHERE a.g IS NULL) AS right_only,
 CASE WHEN count(*) FILTER (WHERE a.g IS NOT NULL AND b.g IS NOT NULL) = 41 THEN 'MATCH' ELSE 'MISMATCH' END AS status
 FROM (SELECT DISTINCT c_custkey AS g FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS g FROM orders) b ON a.g = b.g""")
def overlap_check(spark: SparkSession, d: str) -> DataFrame:
    return enrich.overlap_check(t(spark, d, "customer").select(F.col("c_custkey").alias("gene")), t(spark, d, "orders").select(F.col("o_custkey").alias("gene")), 41)


# ---- methylation and clocks ------------------------------------------------------------------------------------------------

MODEL = [(k, (k % 7 - 3) / 10.0, 0.5 if k % 2 else None) for k in range(0, 66, 3)]
MODEL_SQL = "(VALUES " + ", ".join(f"({c}, {w}::DOUBLE, {'NULL' if f is None else f}::DOUBLE)" for c, w, f in MODEL) + ") m(cpg, coef, fill)"
BETA = "(SELECT vec_id AS sample_id, unnest(range(len(embedding))) AS cpg, unnest(embedding)::DOUBLE AS beta FROM embeddings)"
AGE_SQL = f"""(SELECT vec_id, label * 10.0 AS age, 40 + sum(coef * coalesce(beta, fill, 0.5)) AS predicted_age FROM embeddings CROSS JOIN {MODEL_SQL} LEFT JOIN {BETA} x ON x.sample_id = vec_id AND x.cpg = m.cpg GROUP BY vec_id, label)"""


def _betas(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("cpg", "beta")).withColumn("beta", F.col("beta").cast("double"))


def _ages(spark: SparkSession, d: str) -> DataFrame:
    model = spark.createDataFrame(MODEL, "cpg int, coef double, fill double")
    ages = t(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") * 10.0).alias("age"))
    return methyl.score_clock(_betas(spark, d), model, 40.0).join(ages, "sample_id")


@query(f"SELECT vec_id AS sample_id, round(predicted_age, 6) AS predicted_age FROM {AGE_SQL}")
def score_clock(spark: SparkSession, d: str) -> DataFrame:
    return _ages(spark, d).select("sample_id", r6("predicted_age"))


@query(f"""SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(median(abs(e)), 6) AS median_ae, round(sqrt(avg(e * e)), 6) AS rmse, round(corr(age, predicted_age), 6) AS pearson_r,
 round(1 - sum(e * e) / (var_pop(age) * count(*)), 6) AS r2 FROM (SELECT *, predicted_age - age AS e FROM {AGE_SQL})""")
def clock_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = methyl.clock_metrics(_ages(spark, d))
    return m.select("n", *[r6(c) for c in ("mae", "median_ae", "rmse", "pearson_r", "r2")])


@query(f"SELECT s AS stratum, round(avg(abs(predicted_age - age)), 6) AS mae, count(age) AS n FROM (VALUES ('<30'), ('30-60'), ('>60')) v(s) LEFT JOIN {AGE_SQL} a ON s = CASE WHEN age < 30 THEN '<30' WHEN age <= 60 THEN '30-60' ELSE '>60' END GROUP BY s")
def mae_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return methyl.mae_by_stratum(_ages(spark, d)).withColumn("mae", F.round("mae", 6))


@query(f"SELECT CASE WHEN age < 20 THEN '<20' WHEN age >= 90 THEN '90+' ELSE age::INT || '-' || (age::INT + 9) END AS decade, round(avg(abs(predicted_age - age)), 6) AS mae, count(*) AS n FROM {AGE_SQL} GROUP BY 1")
def mae_by_decade(spark: SparkSession, d: str) -> DataFrame:
    return methyl.mae_by_decade(_ages(spark, d)).withColumn("mae", F.round("mae", 6))


@query(f"""WITH b AS (SELECT * FROM {BETA}) SELECT * FROM (
 SELECT 'duplicate_cells' AS "check", count(*) - count(DISTINCT (sample_id, cpg)) AS n FROM b UNION ALL SELECT 'missing_features', (SELECT count(*) FROM range(66) r(i) WHERE i NOT IN (SELECT cpg FROM b))
 UNION ALL SELECT 'extra_features', (SELECT count(DISTINCT cpg) FROM b WHERE cpg >= 66) UNION ALL SELECT 'missing_cells', count(*) FROM b WHERE beta IS NULL OR isnan(beta) UNION ALL SELECT 'out_of_range', count(*) FROM b WHERE NOT isnan(beta) AND (beta <= 0 OR beta >= 1)
), LATERAL (SELECT n = 0 AS passed)""")
def validate_matrix(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.range(66).select(F.col("id").cast("int").alias("cpg"))
    return methyl.validate_matrix(_betas(spark, d), expected)


@query(f"SELECT sample_id, cpg, round(coalesce(CASE WHEN cpg % 5 <> 0 OR sample_id % 3 <> 0 THEN beta END, avg(CASE WHEN cpg % 5 <> 0 OR sample_id % 3 <> 0 THEN beta END) OVER (PARTITION BY cpg)), 6) AS beta FROM {BETA}")
def impute_column_mean(spark: SparkSession, d: str) -> DataFrame:
    gaps = _betas(spark, d).withColumn("beta", F.when((F.col("cpg") % 5 != 0) | (F.col("sample_id") % 3 != 0), F.col("beta")))
    return methyl.apply_missing_policy(gaps, "impute_column_mean").select("sample_id", "cpg", r6("beta"))


# ---- cohort ------------------------------------------------------------------------------------------------------------------

@query("""SELECT "column", count(v) AS count, count(*) - count(v) AS nulls, round(avg(v), 6) AS mean, round(stddev(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, max(v) AS max
 FROM (SELECT 'p_size' AS "column", p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY 1""")
def describe_table(spark: SparkSession, d: str) -> DataFrame:
    out = cohort.describe_table(t(spark, d, "part"), ["p_size", "p_retailprice"])
    return out.select("column", "count", "nulls", *[r6(c) for c in ("mean", "std")], "min", *[r6(c) for c in ("q1", "median", "q3")], "max")


_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _COLS for b in _COLS))
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return cohort.correlation_matrix(t(spark, d, "lineitem"), _COLS).withColumn("r", F.round("r", 6))


@query("""SELECT least(floor((value - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, event_type, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) WHERE value IS NOT NULL GROUP BY 1, 2""")
def stacked_histogram(spark: SparkSession, d: str) -> DataFrame:
    return cohort.stacked_histogram(t(spark, d, "events"), "value", "event_type")


@query("""WITH b AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL GROUP BY 1)
 SELECT event_type, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
 round(max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, count(*) FILTER (WHERE value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
 FROM events JOIN b USING (event_type) WHERE value IS NOT NULL GROUP BY ALL""")
def genotype_boxplot(spark: SparkSession, d: str) -> DataFrame:
    out = cohort.genotype_boxplot(t(spark, d, "events"), "event_type", "value")
    return out.select("event_type", "n", *[r6(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "n_outliers")


@query("""WITH r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY value) AS tie FROM events WHERE value IS NOT NULL),
 s AS (SELECT sum(rs * rs / n) AS s, sum(n)::DOUBLE AS n, count(*) AS k FROM (SELECT sum(rk) AS rs, count(*) AS n FROM r GROUP BY event_type))
 SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - (SELECT sum(tie::DOUBLE * tie - 1) FROM r) / (n * n * n - n)), 4) AS h, k - 1 AS df, n::BIGINT AS n FROM s""")
def kruskal_wallis(spark: SparkSession, d: str) -> DataFrame:
    return cohort.kruskal_wallis(t(spark, d, "events"), "event_type", "value").withColumn("h", F.round("h", 4))


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
 SELECT round(s, 4) AS slope, round(i, 4) AS intercept, round(avg(abs(l_extendedprice - s * l_quantity - i)), 4) AS mae, count(*) AS n FROM lineitem, f GROUP BY s, i""")
def ols_fit(spark: SparkSession, d: str) -> DataFrame:
    return cohort.ols_fit(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(*[F.round(c, 4).alias(c) for c in ("slope", "intercept", "mae")], "n")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_cohort(spark: SparkSession, d: str) -> DataFrame:
    return cohort.filter_cohort(t(spark, d, "customer"), "c_acctbal", 1000, 5000, c_mktsegment=["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@query("""WITH x AS (SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F' AND l_tax > 0.04)::DOUBLE AS a, count(*) FILTER (WHERE l_linestatus = 'F' AND l_tax <= 0.04)::DOUBLE AS b,
 count(*) FILTER (WHERE l_linestatus <> 'F' AND l_tax > 0.04)::DOUBLE AS c, count(*) FILTER (WHERE l_linestatus <> 'F' AND l_tax <= 0.04)::DOUBLE AS d FROM lineitem GROUP BY 1)
 SELECT l_returnflag, round((a+b+c+d) * power(greatest(abs(a*d - b*c) - (a+b+c+d) / 2, 0), 2) / nullif((a+b)*(c+d)*(a+c)*(b+d), 0), 6) AS chi2 FROM x""")
def chi2_2x2_yates(spark: SparkSession, d: str) -> DataFrame:
    f, high = F.col("l_linestatus") == "F", F.col("l_tax") > 0.04
    cells = t(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("a", f & high), ("b", f & ~high), ("c", ~f & high), ("d", ~f & ~high))])
    empty = (F.col("a") + F.col("b")) * (F.col("c") + F.col("d")) * (F.col("a") + F.col("c")) * (F.col("b") + F.col("d")) == 0
    return cells.select("l_returnflag", F.round(F.when(~empty, stats.chi2_2x2_yates(*(F.col(c) for c in "abcd"))), 6).alias("chi2"))


# ---- quality, graph, regions, text ----------------------------------------------------------------------------------------------

@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS c FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'Z' ELSE o_orderstatus END AS s, o_custkey AS c FROM orders WHERE o_totalprice < 400000)
 SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'mismatch' END AS kind, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 's' END AS "column",
 CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN a.s END AS "left", CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN b.s END AS "right" FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s""")
def reconcile_tables(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"), "o_totalprice")
    other = o.where(F.col("o_totalprice") < 400000).withColumn("s", F.when(F.col("k") % 17 == 0, "Z").otherwise(F.col("s")))
    return quality.reconcile_tables(o.where(F.col("s") != "P"), other, "k", ["s", "c"])


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    urgent = t(spark, d, "orders").where(F.col("o_orderpriority").startswith("1"))
    return quality.missing_keys(t(spark, d, "customer"), urgent, "c_custkey", "o_custkey")


@query("""WITH m AS (SELECT 'raw_rows' AS metric, count(*) AS computed FROM part UNION ALL SELECT 'distinct_pairs', count(DISTINCT (p_brand, p_type)) FROM part UNION ALL SELECT 'canonical_pairs', count(DISTINCT (p_brand, p_size)) FILTER (WHERE p_size % 3 <> 0) FROM part)
 SELECT metric, computed, stated::BIGINT AS stated, CASE WHEN stated IS NULL OR computed IS NULL THEN 'NEEDS REVIEW' WHEN stated = computed THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM m FULL JOIN (VALUES ('raw_rows', 2000), ('unstated', 41)) s(metric, stated) USING (metric)""")
def stated_vs_computed(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumn("canon", F.when(F.col("p_size") % 3 != 0, F.col("p_size")))
    return quality.stated_vs_computed(quality.snp_count_definitions(p, "p_brand", "p_type", "canon"), {"raw_rows": 2000, "unstated": 41})


@query("""SELECT count(*) FILTER (WHERE s) AS significant, count(*) FILTER (WHERE o) AS non_significant, count(*) FILTER (WHERE s AND o) AS in_both FROM (SELECT l_partkey, bool_or(l_returnflag = 'R') AS s, bool_or(l_returnflag <> 'R') AS o FROM lineitem GROUP BY 1)""")
def association_gene_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.association_gene_counts(t(spark, d, "lineitem"), "l_partkey", F.col("l_returnflag") == "R")


@query("SELECT p_type, count(*) FILTER (WHERE p_size % 2 = 0) AS coding, count(*) FILTER (WHERE p_size % 2 = 1) AS noncoding, count(*) AS total FROM part GROUP BY 1")
def consequence_crosstab(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumn("c", F.when(F.col("p_size") % 2 == 0, "coding").otherwise("noncoding"))
    return quality.consequence_crosstab(p, "p_type", "c", ["coding", "noncoding"])


@query("""SELECT g AS p_type, string_agg(p_brand || ' (' || n || ')', ', ' ORDER BY n DESC, p_brand) AS genes, count(*) AS n_genes FROM (SELECT p_type AS g, p_brand, count(DISTINCT p_size) AS n FROM part GROUP BY 1, 2) GROUP BY 1""")
def group_to_pathway(spark: SparkSession, d: str) -> DataFrame:
    return quality.genes_by_group(t(spark, d, "part"), "p_type", "p_brand", "p_size")


@query("""SELECT c_custkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'recent' WHEN b.v IS NOT NULL THEN 'all' ELSE 'none' END AS method FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS v FROM orders GROUP BY 1) b ON b.o_custkey = c_custkey""")
def lookup_cascade(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    one, two = (x.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("v")) for x in (o.where(F.col("o_orderstatus") == "F"), o))
    return quality.lookup_cascade(t(spark, d, "customer").select("c_custkey"), [("recent", one, "c_custkey"), ("all", two, "c_custkey")], "v")


@query("""SELECT p_partkey, CASE WHEN a IS NULL THEN 'NA' WHEN p_size BETWEEN a AND b THEN 'yes' ELSE 'no' END AS in_span FROM part LEFT JOIN (SELECT p_brand, min(p_size) + 5 AS a, max(p_size) - 5 AS b FROM part WHERE p_brand <> 'Brand#1' AND p_brand <> 'Brand#11' GROUP BY 1) s USING (p_brand)""")
def position_in_span(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    spans = p.where(~F.col("p_brand").isin("Brand#1", "Brand#11")).groupBy("p_brand").agg((F.max("p_size") - 5).alias("e"), (F.min("p_size") + 5).alias("s"))
    return quality.position_in_span(p, spans, "p_brand", "p_size", "e", "s").select("p_partkey", "in_span")


@query("""SELECT a.l_orderkey AS region, a.l_linenumber, b.gene FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey AS s, l_partkey + 3 AS e FROM lineitem) a JOIN (SELECT l_suppkey, l_returnflag AS gene, min(l_partkey) AS s, min(l_partkey) + 250 AS e FROM lineitem GROUP BY 1, 2) b ON a.l_suppkey = b.l_suppkey AND a.s <= b.e AND b.s <= a.e""")
def annotate_intervals(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("chrom"), "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_partkey").alias("start"))
    spans = li.groupBy("chrom", F.col("l_returnflag").alias("name")).agg(F.min("start").alias("start")).withColumn("end", F.col("start") + 250)
    found = quality.annotate_intervals(li.withColumn("end", F.col("start") + 3), spans)
    return found.select(F.col("l_orderkey").alias("region"), "l_linenumber", F.col("gene_name").alias("gene"))


@query("""WITH s AS (SELECT user_id, floor(epoch(ts) / 60)::BIGINT AS pos, value / 1000 AS p FROM events WHERE value / 1000 < 0.05), g AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 600 THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
 i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(pos) AS start, max(pos) AS "end", count(*) AS n_sites, round(min(p), 6) AS min_p FROM i GROUP BY user_id, i HAVING count(*) >= 2""")
def call_regions(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("pos"), (F.col("value") / 1000).alias("p"))
    return quality.call_regions(e, "user_id", "pos", "p", 600, 0.05, 2).select("user_id", "start", "end", "n_sites", r6("min_p"))


EDGES = """(SELECT least(x, y) AS a, greatest(x, y) AS b, max(CASE WHEN s > 1 THEN s / 1000 ELSE s END) AS weight FROM (SELECT c_nationkey AS x, s_nationkey AS y, count(*) / 10.0 AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) WHERE s >= 0.15 AND x <> y GROUP BY 1, 2)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    j = o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    raw = j.groupBy(F.col("c_nationkey").alias("x"), F.col("s_nationkey").alias("y")).agg((F.count("*") / 10.0).alias("s"))
    return quality.merge_undirected_edges(raw, "x", "y", "s")


@query(f"SELECT a, b, round(weight, 6) AS weight FROM {EDGES}")
def build_gene_network(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).withColumn("weight", F.round("weight", 6))


_NET = EDGES.replace("c_nationkey AS x, s_nationkey AS y", "'N' || c_nationkey AS x, 'N' || s_nationkey AS y")


@query(f"""WITH g AS (SELECT 'N' || n_nationkey AS gene, CASE WHEN n_regionkey = 0 THEN 'Unassigned' ELSE r_name END AS cluster FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT a, b, round(weight, 6) AS weight, p.cluster AS cluster_a, q.cluster AS cluster_b FROM {_NET} JOIN g p ON p.gene = a JOIN g q ON q.gene = b""")
def gene_network(spark: SparkSession, d: str) -> DataFrame:
    """Nations as genes whose clusters are regions (one is blank), linked by their orders; nodes and edges of the network in one table."""
    o = t(spark, d, "orders")
    j = o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))

    def name(c: str) -> F.Column:
        return F.concat(F.lit("N"), F.col(c).cast("string"))

    raw = j.groupBy(name("c_nationkey").alias("source"), name("s_nationkey").alias("target")).agg((F.count("*") / 10.0).alias("combined_score"))
    of = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    genes = of.select(name("n_nationkey").alias("Gene"), F.when(F.col("n_regionkey") == 0, " ").otherwise(F.col("r_name")).alias("Functional_Cluster"))
    nodes, edges = tables.build_gene_network(raw, genes)
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col("gene").alias(end), F.col("functional_cluster").alias(f"cluster_{end}")), end)
    return edges.select("a", "b", F.round("weight", 6).alias("weight"), "cluster_a", "cluster_b")


@query(f"SELECT n_nationkey, coalesce(k, 0) AS degree, round(coalesce(k, 0) / ((SELECT count(*) FROM nation) - 1), 6) AS centrality FROM nation LEFT JOIN (SELECT v, count(*) AS k FROM (SELECT a AS v FROM {EDGES} UNION ALL SELECT b FROM {EDGES}) GROUP BY 1) ON v = n_nationkey")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return quality.degree_centrality(_edges(spark, d), t(spark, d, "nation"), "n_nationkey").withColumn("centrality", F.round("centrality", 6))


@query(r"""SELECT * FROM (SELECT doc_id, line, pattern, regexp_extract_all(x, rx)[1] AS match FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), (VALUES ('seven_digits', '\b[0-9]{7}\b'), ('email', '[a-z0-9.]+@[a-z0-9.]+')) p(pattern, rx)) WHERE match IS NOT NULL""")
def scan_restricted_patterns(spark: SparkSession, d: str) -> DataFrame:
    return quality.scan_restricted_patterns(t(spark, d, "documents"), "doc_id", "text", {"seven_digits": r"\b[0-9]{7}\b", "email": r"[a-z0-9.]+@[a-z0-9.]+"})

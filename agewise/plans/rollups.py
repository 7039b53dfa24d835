"""Registered queries of the gene, variant and manifest tables' operators, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agewise.functions import normalize as nz
from agewise.functions import stats
from agewise.operators import eqtl, methyl, tables, texts
from agewise.plans import bindings as b
from agewise.plans.bindings import query, r6, t


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_significant(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").withColumn("label", F.when(F.col("c_mktsegment") == "BUILDING", " Significant").otherwise("non-significant"))
    return tables.filter_significant(c, "label").select("c_custkey", "c_mktsegment")


@query("SELECT event_id, value AS age FROM events WHERE event_type <> 'error' AND value IS NOT NULL")
def filter_valid_age(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("age", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")))
    ok = e.withColumn("status", F.when(F.col("event_type") == "none", "failed").otherwise("Success"))
    return tables.filter_success(tables.filter_valid_age(ok, "age")).select("event_id", "age")


@query("SELECT l_partkey, a AS coverage_R, b AS coverage_N FROM (SELECT l_partkey, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS a, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS b FROM lineitem GROUP BY 1) WHERE a >= 100 AND b >= 100")
def filter_min_coverage(spark: SparkSession, d: str) -> DataFrame:
    return tables.filter_min_coverage(t(spark, d, "lineitem"), ["l_partkey"], "l_returnflag", "l_quantity", ["R", "N"], 100)


@query("SELECT l_suppkey AS a, l_partkey AS b, l_discount AS s FROM lineitem WHERE l_discount >= 0.05 AND l_suppkey <> l_partkey AND l_partkey IN (SELECT s_suppkey FROM supplier)")
def filter_edges(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_discount").alias("s"))
    return tables.filter_edges(e, "a", "b", "s", t(spark, d, "supplier"), "s_suppkey", floor=0.05)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'F' AND l_partkey BETWEEN l_suppkey AND l_suppkey + 500")
def filter_snv_in_window(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").withColumns({"id": F.when(F.col("l_returnflag") == "R", "c7").otherwise("rs7"), "ref": F.lit("A"), "alt": F.when(F.col("l_linestatus") == "F", "g").otherwise("GT")})
    return tables.filter_snv_in_window(li, "id", "l_partkey", "ref", "alt", F.col("l_suppkey"), F.col("l_suppkey") + 500).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 OR p_type = 'ECONOMY'")
def drop_blank_rows(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumns({"gene": F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("  "), "snp": F.when(F.col("p_type") == "ECONOMY", F.col("p_type"))})
    return tables.drop_blank_rows(p, ["gene", "snp"]).select("p_partkey", "p_size")


# ---- joins -----------------------------------------------------------------------------------------------------------

@query(f"SELECT p_partkey, p_size, gtex_n_eqtls, gtex_best_tissue FROM part LEFT JOIN {b.SUMMARY} ON p_partkey = rsid")
def build_master_table(spark: SparkSession, d: str) -> DataFrame:
    summary = b._summary(spark, d).withColumnRenamed("rsid", "p_partkey")
    return tables.build_master_table(t(spark, d, "part"), summary, "p_partkey", check=False).select("p_partkey", "p_size", "gtex_n_eqtls", "gtex_best_tissue")


@query(f"""SELECT p_partkey AS rsid, gtex_n_eqtls, round(alphagenome_score, 6) AS alphagenome_score FROM part LEFT JOIN {b.SUMMARY} ON p_partkey = rsid
 LEFT JOIN (SELECT l_partkey, min(l_discount) AS alphagenome_score FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def map_variants_to_tissues(spark: SparkSession, d: str) -> DataFrame:
    variants = t(spark, d, "part").select(F.col("p_partkey").alias("rsid"))
    scores = t(spark, d, "lineitem").select(F.col("l_partkey").alias("rsid"), F.col("l_discount").alias("alphagenome_score"))
    ranked = scores.groupBy("rsid").agg(F.min("alphagenome_score").alias("alphagenome_score"))
    found = tables.map_variants_to_tissues(variants, b._eqtls(spark, d), b.TISSUES, scores=ranked)["annotated"]
    return found.select("rsid", "gtex_n_eqtls", r6("alphagenome_score"))


@query("SELECT p_partkey AS rsid, am_score FROM part LEFT JOIN (SELECT l_partkey, l_discount AS am_score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1) ON l_partkey = p_partkey")
def join_scores(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "lineitem").select(F.col("l_partkey").alias("rsid"), F.col("l_discount").alias("am_score"), "l_orderkey", "l_linenumber")
    return eqtl.join_scores(t(spark, d, "part").select(F.col("p_partkey").alias("rsid")), s, "rsid", "am_", "l_orderkey", "l_linenumber")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return eqtl.dedup_keep_first(t(spark, d, "lineitem"), ["l_partkey", "l_returnflag"], F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select("l_partkey", "l_orderkey", "l_linenumber")


@query(f"SELECT sample_id, cpg, round(beta, 6) AS beta, label FROM {b.BETA} x JOIN embeddings ON vec_id = sample_id WHERE label <> 3")
def join_beta_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = t(spark, d, "embeddings").where(F.col("label") != 3).select(F.col("vec_id").alias("Sample_ID"), "label")
    return tables.join_beta_metadata(b._betas(spark, d), meta).select(F.col("sample_id").cast("long").alias("sample_id"), "cpg", r6("beta"), "label")


@query(f"SELECT 'G' || sample_id AS sample_id, chronological_age, cpg, round(beta, 6) AS beta FROM {b.BETA} x JOIN (SELECT vec_id, label * 10::DOUBLE AS chronological_age FROM embeddings WHERE label <> 2) ON vec_id = sample_id WHERE cpg < 8")
def build_cohort_matrix(spark: SparkSession, d: str) -> DataFrame:
    e, gsm = t(spark, d, "embeddings"), F.concat(F.lit("G"), F.col("vec_id").cast("string")).alias("gsm")
    labels, ages = e.select(F.col("vec_id").alias("label"), gsm), e.select(gsm, F.when(F.col("label") != 2, F.col("label") * 10.0).alias("age"))
    out = tables.build_cohort_matrix(b._betas(spark, d), labels, ages, spark.range(8).select(F.col("id").cast("int").alias("cpg")))
    return out.select("sample_id", "chronological_age", "cpg", r6("beta"))


@query("""SELECT p_partkey, a.ref, a.alt, round(a.AF, 6) AS "AF" FROM part LEFT JOIN (SELECT l_suppkey AS pos, min(l_returnflag) AS ref, arg_min(l_linestatus, (l_returnflag, l_linestatus, l_discount, l_linenumber)) AS alt, arg_min(l_discount, (l_returnflag, l_linestatus, l_discount, l_linenumber)) AS AF FROM lineitem GROUP BY 1) a ON a.pos = p_partkey""")
def join_locus_frequency(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "part").select("p_partkey", F.lit(" rs1 ").alias("rsid"), F.lit("chr07").alias("chrom"), F.col("p_partkey").alias("pos"))
    f = t(spark, d, "lineitem").select(F.lit("7.0").alias("chrom"), F.col("l_suppkey").alias("pos"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"), F.col("l_discount").alias("AF"), F.col("l_linenumber").alias("N_called"))
    return tables.join_locus_frequency(m, f).select("p_partkey", "ref", "alt", r6("AF"))


@query("SELECT o_orderkey, o_custkey, c_name FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey")
def join_coordinates_1to1(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey")
    return tables.join_coordinates_1to1(o, t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_orderkey", "o_custkey", "c_name")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN p_type ELSE (SELECT min(r_name) FROM region WHERE r_regionkey = p_partkey % 7) END AS gene FROM part")
def coalesce_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 7).cast("int").alias("k"), F.when(F.col("p_size") > 20, F.col("p_type")).otherwise(" ").alias("gene"))
    return tables.coalesce_lookup(p, t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("gene")), "k", "gene").select("p_partkey", "gene")


@query("SELECT p_partkey, coalesce(r_name, 'NA') AS symbol FROM part LEFT JOIN region ON r_regionkey = p_partkey % 7")
def map_ids_to_symbols(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 7).cast("int").alias("entrez"))
    return tables.map_ids_to_symbols(p, t(spark, d, "region").select(F.col("r_regionkey").alias("entrez"), F.col("r_name").alias("symbol")), "entrez").select("p_partkey", "symbol")


MANIFEST = """(SELECT gene, rsid, coalesce(c, '') AS chrom, p AS pos, CASE WHEN p IS NULL THEN '' ELSE 'F22418_imputed_chr' || c || '_GRCh38_' || p END AS chunk FROM (SELECT DISTINCT p_brand AS gene, 'rs' || (p_partkey % 500) AS rsid FROM part)
 LEFT JOIN (SELECT 'rs' || s_suppkey AS rsid, (s_nationkey + 1)::VARCHAR AS c, s_suppkey * 1000 AS p FROM supplier) USING (rsid))"""


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").select(F.concat(F.lit(" "), "p_brand").alias("gene"), F.concat(F.lit("rs"), (F.col("p_partkey") % 500).cast("string")).alias("rsid"))
    loci = t(spark, d, "supplier").select(F.concat(F.lit("rs"), F.col("s_suppkey").cast("string")).alias("rsid"), (F.col("s_nationkey") + 1).cast("string").alias("chrom"), (F.col("s_suppkey") * 1000).alias("pos"))
    return tables.build_manifest(rows, loci)


@query(f"SELECT * FROM {MANIFEST}")
def build_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d)


@query(f"SELECT count(*) AS total, count(pos) AS resolved, count(*) - count(pos) AS missing FROM {MANIFEST}")
def manifest_coverage(spark: SparkSession, d: str) -> DataFrame:
    return tables.manifest_coverage(_manifest(spark, d))


@query(f"SELECT chrom, count(*) AS n, CASE WHEN try_cast(chrom AS INT) BETWEEN 1 AND 22 THEN chrom::INT ELSE 99 END AS sort_key FROM {MANIFEST} GROUP BY 1")
def snps_per_chromosome(spark: SparkSession, d: str) -> DataFrame:
    return tables.snps_per_chromosome(_manifest(spark, d))


@query(f"SELECT gene, count(DISTINCT rsid) AS n_snps, string_agg(DISTINCT chrom, ',' ORDER BY chrom) AS chromosomes FROM {MANIFEST} GROUP BY 1")
def gene_manifest_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tables.gene_manifest_rollup(_manifest(spark, d))


@query(f"SELECT chrom, min(pos) AS first, max(pos) AS last, max(pos) - min(pos) AS span FROM {MANIFEST} GROUP BY 1")
def span_per_chromosome(spark: SparkSession, d: str) -> DataFrame:
    return tables.span_per_chromosome(_manifest(spark, d))


@query("""SELECT p_partkey, CASE WHEN c_custkey IS NOT NULL THEN 'cached' WHEN p_size > 30 THEN 'variant_id' WHEN p_type <> 'ECONOMY' THEN 'region_rsid' ELSE 'unresolved' END AS route
 FROM part LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ON c_custkey = p_partkey""")
def plan_lookups(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 30, F.col("p_brand")).alias("vid"), F.when(F.col("p_type") != "ECONOMY", F.lit("1")).alias("chrom"), F.col("p_size").alias("pos"))
    cache = t(spark, d, "customer").where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("p_partkey"))
    return tables.plan_lookups(p, cache, "p_partkey", "vid", "chrom", "pos").select("p_partkey", "route")


RESOLVED = """(SELECT DISTINCT gene, alias, CASE k WHEN 0 THEN lower(alias) WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'rs' || p_size WHEN p_size % 3 = 0 THEN 'rs' || (1000 + p_size) ELSE 'NA' END ELSE 'NA' END AS canonical_rsid,
  CASE k WHEN 0 THEN 'direct' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'hgvs' WHEN p_size % 3 = 0 THEN 'dbsnp' ELSE 'NA' END ELSE 'NA' END AS source, CASE k WHEN 2 THEN 'non_snp_excluded' WHEN 3 THEN 'gene_name_placeholder' ELSE '' END AS notes
 FROM (SELECT p_brand AS gene, p_size, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN 'RS' || p_size WHEN 1 THEN 'I' || p_size || 'V' WHEN 2 THEN '(GT)n' ELSE 'CETP' END AS alias FROM part))"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    alias = F.when(k == 0, F.concat(F.lit("RS"), "p_size")).when(k == 1, F.concat(F.lit("I"), "p_size", F.lit("V"))).when(k == 2, "(GT)n").otherwise("CETP")
    p = t(spark, d, "part").select(F.col("p_brand").alias("gene"), alias.alias("alias"), "p_size")
    by_name = p.where(F.col("p_size") % 2 == 0).select(F.concat("gene", F.lit(":p.Ile"), "p_size", F.lit("Val")).alias("hgvs"), F.concat(F.lit("RS"), "p_size").alias("rsid")).distinct()
    by_alias = p.where(F.col("p_size") % 3 == 0).select("gene", "alias", F.concat(F.lit("rs"), F.col("p_size") + 1000).alias("rsid")).distinct()
    return tables.resolve_alias_cascade(p, [("hgvs", by_name), ("dbsnp", by_alias)])


@query(f"SELECT * FROM {RESOLVED}")
def resolve_alias_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)


@query(f"SELECT p_partkey, canonical_rsid, source FROM (SELECT p_partkey, p_brand AS gene, CASE p_partkey % 4 WHEN 0 THEN 'RS' || p_size WHEN 1 THEN 'I' || p_size || 'V' WHEN 2 THEN '(GT)n' ELSE 'CETP' END AS alias FROM part) JOIN {RESOLVED} USING (gene, alias)")
def canonicalize_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    alias = F.when(k == 0, F.concat(F.lit("RS"), "p_size")).when(k == 1, F.concat(F.lit("I"), "p_size", F.lit("V"))).when(k == 2, "(GT)n").otherwise("CETP")
    rows = t(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(" ")).alias("gene"), alias.alias("alias"))
    return tables.canonicalize_ids(rows, _resolved(spark, d)).select("p_partkey", "canonical_rsid", "source")


@query(f"SELECT gene, canonical_rsid, string_agg(DISTINCT alias, ';' ORDER BY alias) AS aliases FROM {RESOLVED} WHERE canonical_rsid <> 'NA' GROUP BY 1, 2 HAVING count(DISTINCT alias) > 1")
def check_duplicate_aliases(spark: SparkSession, d: str) -> DataFrame:
    return tables.check_duplicate_aliases(_resolved(spark, d)).withColumn("aliases", F.array_join("aliases", ";"))


@query("SELECT key, 'missing' AS side FROM (SELECT DISTINCT o_custkey AS key FROM orders) WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT c_custkey, 'found' FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def split_found_missing(spark: SparkSession, d: str) -> DataFrame:
    ids = t(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    known = t(spark, d, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("key"))
    found, missing = tables.split_found_missing(ids, known, "key")
    return missing.withColumn("side", F.lit("missing")).unionByName(found.withColumn("side", F.lit("found")))


# ---- roll-ups --------------------------------------------------------------------------------------------------------

@query("SELECT p_partkey AS rsid, round(p_size / 50.0 - x, 6) + 0.0 AS delta, coalesce(abs(p_size / 50.0 - x) >= 0.4000001, false) AS outlier, 'own' AS source FROM part LEFT JOIN (SELECT l_partkey, avg(l_discount) AS x FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey")
def af_table(spark: SparkSession, d: str) -> DataFrame:
    other = t(spark, d, "lineitem").where(F.col("l_quantity") > 45).groupBy("l_partkey").agg(F.avg("l_discount").alias("gnomAD_AF"))
    rows = t(spark, d, "part").join(other, F.col("l_partkey") == F.col("p_partkey"), "left").select(F.col("p_partkey").alias("rsID"), (F.col("p_size") / 50.0).alias("AF_1kg"), "gnomAD_AF")
    return tables.af_table(rows, 0.4000001, "own").select("rsid", (F.round("delta", 6) + 0.0).alias("delta"), "outlier", "source")


@query("SELECT p_brand, count(DISTINCT p_type) AS raw_ids, count(DISTINCT p_size) AS canonical_ids, string_agg(DISTINCT p_size::VARCHAR, ';' ORDER BY p_size::VARCHAR) AS ids FROM part GROUP BY 1")
def per_gene_id_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.per_gene_id_counts(t(spark, d, "part").withColumn("s", F.col("p_size").cast("string")), "p_brand", "p_type", "s")


@query("SELECT p_brand, count(DISTINCT p_size) AS n FROM part GROUP BY 1")
def unique_per_group(spark: SparkSession, d: str) -> DataFrame:
    return tables.unique_per_group(t(spark, d, "part"), "p_brand", "p_size")


@query("SELECT p_type AS pathway_src, p_brand AS dst, count(DISTINCT p_size) AS weight FROM part GROUP BY 1, 2")
def hub_spoke_edges(spark: SparkSession, d: str) -> DataFrame:
    counts = t(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count_distinct("p_size").alias("n"))
    return tables.hub_spoke_edges(counts, "p_type", "p_brand", "n").withColumnRenamed("src", "pathway_src")


@query("SELECT p_size % 2 AS cls, p_brand, " + ", ".join(f"count(*) FILTER (WHERE p_type = '{x}') AS {x.lower()}" for x in ("ECONOMY", "SMALL", "LARGE")) + " FROM part GROUP BY 1, 2")
def gene_consequence_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumns({"cls": F.col("p_size") % 2, "kind": F.lower("p_type")})
    return tables.gene_consequence_matrix(p, "p_brand", "cls", "kind", ["economy", "small", "large"])


@query("""SELECT o_orderstatus AS class, CASE WHEN count(*) > 1 THEN o_custkey || ' (' || count(*) || ')' ELSE o_custkey::VARCHAR END AS gene, string_agg(lpad(o_orderkey::VARCHAR, 9, '0'), ', ' ORDER BY o_orderkey) AS rsids,
 CASE WHEN count(*) = 1 THEN min(o_orderpriority) WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) || ' (×' || count(*) || ')' ELSE string_agg(lpad(o_orderkey::VARCHAR, 9, '0') || ': ' || o_orderpriority, chr(10) ORDER BY o_orderkey) END AS consequence FROM orders GROUP BY o_orderstatus, o_custkey""")
def rollup_by_gene(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").select(F.col("o_orderstatus").alias("class"), F.col("o_custkey").cast("string").alias("gene"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("rsid"), F.col("o_orderpriority").alias("consequence"))
    return tables.rollup_by_gene(rows)


@query("SELECT l_partkey, string_agg(l_shipmode, ';' ORDER BY o, l_shipmode) AS genes FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def genes_per_rsid(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").withColumn("g", F.concat(F.lit(" "), "l_returnflag", "l_linestatus"))
    return tables.genes_per_rsid(li, "l_partkey", "g", "l_orderkey")


@query("""SELECT region, n_cpg, "start", "end", width, round(mean_meth_diff, 6) AS mean_meth_diff, round(min_p, 6) AS p_value FROM (SELECT l_suppkey AS region, count(*) AS n_cpg, min(l_partkey) AS "start", max(l_partkey) AS "end", max(l_partkey) - min(l_partkey) + 1 AS width, avg(l_discount - l_tax) AS mean_meth_diff, min(l_discount) AS min_p FROM lineitem GROUP BY 1)""")
def dmr_summary(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").withColumns({"diff": F.col("l_discount") - F.col("l_tax"), "region": F.col("l_suppkey")})
    return methyl.dmr_summary(li, ["region"], "l_partkey", "diff", "l_discount").select("region", "n_cpg", "start", "end", "width", r6("mean_meth_diff"), r6("p_value"))


@query("SELECT l_partkey, tissue, p_value, nes FROM (SELECT l_partkey, l_shipmode AS tissue, l_extendedprice AS p_value, l_discount AS nes FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem))")
def eqtl_hit_row(spark: SparkSession, d: str) -> DataFrame:
    hit = F.struct(F.col("l_returnflag").alias("tissueSiteDetailId"), F.lit("g").alias("geneSymbol"), F.col("l_extendedprice").alias("pValue"), F.col("l_discount").alias("nes"), F.lit("v").alias("variantId"))
    rows = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_list(hit).alias("hits"))
    return tables.eqtl_hit_row(rows, "l_partkey", "hits").select("l_partkey", "tissue", "p_value", "nes")


# ---- top rows and sets -----------------------------------------------------------------------------------------------

@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def top_impact(spark: SparkSession, d: str) -> DataFrame:
    return tables.top_impact(t(spark, d, "lineitem"), "l_extendedprice", 20, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT c_custkey AS cpg, c_acctbal AS coef FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 25")
def top_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return tables.top_coefficients(t(spark, d, "customer").select(F.col("c_custkey").alias("cpg"), F.col("c_acctbal").alias("coef")))


@query(f"SELECT p_partkey, round(risk, 6) AS composite_risk FROM {b.RISK}")
def rank_variants(spark: SparkSession, d: str) -> DataFrame:
    risks = b._risks(spark, d).select(F.col("rsid").alias("p_partkey"), F.round("risk", 6).alias("composite_risk"))
    return tables.rank_variants(risks, "composite_risk", "p_partkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus <> 'P', o_orderkey LIMIT 70")
def prioritize_then_limit(spark: SparkSession, d: str) -> DataFrame:
    return tables.prioritize_then_limit(t(spark, d, "orders"), F.col("o_orderstatus") == "P", 70, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT l_suppkey, count(*) AS n_items, string_agg(x, ',' ORDER BY x) FILTER (WHERE n <= 8) AS examples FROM (SELECT l_suppkey, lpad(l_partkey::VARCHAR, 9, '0') AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY lpad(l_partkey::VARCHAR, 9, '0')) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY 1")
def capped_examples(spark: SparkSession, d: str) -> DataFrame:
    return tables.capped_examples(t(spark, d, "lineitem").withColumn("x", F.lpad(F.col("l_partkey").cast("string"), 9, "0")), "l_suppkey", "x")


@query("""SELECT 'union' AS kind, p_size FROM (SELECT DISTINCT p_size FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')) UNION ALL SELECT 'both', p_size FROM (SELECT p_size FROM part WHERE p_brand = 'Brand#1' INTERSECT SELECT p_size FROM part WHERE p_brand = 'Brand#2')
 UNION ALL SELECT 'except', p_size FROM (SELECT p_size FROM part WHERE p_brand = 'Brand#1' EXCEPT SELECT p_size FROM part WHERE p_brand = 'Brand#2')""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    one, two = (p.where(F.col("p_brand") == f"Brand#{k}") for k in (1, 2))
    out = tables.union_sets(p, "p_brand", "p_size", "union", ["Brand#1", "Brand#2"]).select(F.col("p_brand").alias("kind"), "p_size")
    out = out.unionByName(tables.intersect_sets(one, two, "p_size").select(F.lit("both").alias("kind"), "p_size"))
    return out.unionByName(tables.except_sets(one, two, "p_size").select(F.lit("except").alias("kind"), "p_size"))


@query("""WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 6000), b AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500), j AS (SELECT a.k AS x, b.k AS y, coalesce(a.k, b.k) AS k FROM a FULL JOIN b ON a.k = b.k)
 SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_both, 41::BIGINT AS expected, CASE WHEN count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) = 41 THEN 'MATCH' ELSE 'MISMATCH' END AS status,
 coalesce(string_agg(k::VARCHAR, ',' ORDER BY k::VARCHAR) FILTER (WHERE y IS NULL), '') AS missing, coalesce(string_agg(k::VARCHAR, ',' ORDER BY k::VARCHAR) FILTER (WHERE x IS NULL), '') AS extra FROM j""")
def overlap_lists(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "supplier").where(F.col("s_acctbal") > 6000).select(F.col("s_nationkey").alias("gene"))
    c = t(spark, d, "customer").where(F.col("c_acctbal") > 9500).select(F.col("c_nationkey").alias("gene"))
    return tables.overlap_check(a, c, "gene", 41)


# ---- checks and statistics -------------------------------------------------------------------------------------------

@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS bad_association, 0::BIGINT AS bad_coordinates, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) = 0 AS passed FROM orders")
def assert_overlap_schema(spark: SparkSession, d: str) -> DataFrame:
    return tables.assert_overlap_schema(t(spark, d, "orders"), "o_orderstatus", ["f", "O"], ["o_custkey", "o_totalprice"])


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def validate_allowed_values(spark: SparkSession, d: str) -> DataFrame:
    return tables.validate_allowed_values(t(spark, d, "events"), "event_type", ["view", "click"])


@query("""SELECT p_partkey, least(s, e) AS "start", greatest(s, e) AS "end", CASE WHEN p_retailprice <> floor(p_retailprice) THEN 'end' ELSE '' END AS integer_findings, p_size || 'p11' AS place_band
 FROM (SELECT *, p_size::BIGINT AS s, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT END AS e0 FROM part) x, LATERAL (SELECT e0 AS e), LATERAL (SELECT CASE WHEN e0 IS NULL THEN NULL ELSE s END AS s2) WHERE e0 IS NOT NULL
 UNION ALL SELECT p_partkey, NULL, NULL, 'end', p_size || 'p11' FROM part WHERE p_retailprice <> floor(p_retailprice)""")
def clean_overlap_table(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("gene"), F.lit(None).cast("string").alias("snp"), F.col("p_size").alias("start"), F.col("p_retailprice").alias("end"), F.concat(F.lit("Location: "), "p_size", F.lit("p11")).alias("place"))
    return tables.clean_overlap_table(rows, "gene", "snp", "start", "end", ["place"]).select("p_partkey", "start", "end", "integer_findings", "place_band")


@query("SELECT count(DISTINCT CASE WHEN p_size < 5 THEN p_partkey END) AS n_missing, count(DISTINCT CASE WHEN p_size < 5 THEN p_partkey END) = 0 AS passed FROM part")
def missing_consequence_gate(spark: SparkSession, d: str) -> DataFrame:
    return tables.missing_consequence_gate(t(spark, d, "part").withColumn("c", F.when(F.col("p_size") >= 5, F.col("p_type")).otherwise(" ")), "p_partkey", "c")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def af_missing_report(spark: SparkSession, d: str) -> DataFrame:
    known = t(spark, d, "lineitem").where(F.col("l_quantity") > 45).groupBy("l_partkey").agg(F.avg("l_discount").alias("af"))
    return tables.af_missing_report(t(spark, d, "part").join(known, F.col("l_partkey") == F.col("p_partkey"), "left"), "p_partkey", "af")


@query(f"SELECT cpg, count(*) FILTER (WHERE beta < 0) AS n_missing FROM {b.BETA} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def missing_profile(spark: SparkSession, d: str) -> DataFrame:
    return methyl.missing_profile(b._betas(spark, d).withColumn("beta", F.when(F.col("beta") >= 0, F.col("beta"))))


@query(f"SELECT vec_id AS sample_id, m.cpg, round(coalesce(beta, fill, 0.5), 6) AS x, beta IS NULL AS imputed FROM embeddings CROSS JOIN {b.MODEL_SQL} LEFT JOIN {b.BETA} x ON x.sample_id = vec_id AND x.cpg = m.cpg")
def align_features(spark: SparkSession, d: str) -> DataFrame:
    model = spark.createDataFrame(b.MODEL, "cpg int, coef double, fill double")
    return methyl.align_features(b._betas(spark, d), model).select("sample_id", "cpg", r6("x"), "imputed")


@query(f"SELECT vec_id AS sample_id, round(least(greatest(40 + sum(coef * coalesce(beta, 0.5)), 0), 120), 6) AS predicted_age FROM embeddings CROSS JOIN {b.MODEL_SQL} LEFT JOIN {b.BETA} x ON x.sample_id = vec_id AND x.cpg = m.cpg GROUP BY vec_id")
def score_horvath(spark: SparkSession, d: str) -> DataFrame:
    model = spark.createDataFrame(b.MODEL, "cpg int, coef double, fill double")
    return methyl.score_horvath(b._betas(spark, d), model, 40.0).select("sample_id", r6("predicted_age"))


@query("SELECT l_returnflag, row, hit, miss, total FROM (SELECT l_returnflag, unnest([{'row': 'in', 'hit': a, 'miss': b, 'total': a + b}, {'row': 'out', 'hit': c, 'miss': d, 'total': c + d}, {'row': 'total', 'hit': a + c, 'miss': b + d, 'total': a + b + c + d}], recursive := true) FROM (SELECT l_returnflag, count(*) FILTER (WHERE l_tax > 0.04 AND l_discount > 0.05) AS a, count(*) FILTER (WHERE l_tax <= 0.04 AND l_discount > 0.05) AS b, count(*) FILTER (WHERE l_tax > 0.04 AND l_discount <= 0.05) AS c, count(*) FILTER (WHERE l_tax <= 0.04 AND l_discount <= 0.05) AS d FROM lineitem GROUP BY 1))")
def contingency_table_rows(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_tax") > 0.04, F.col("l_discount") > 0.05
    cells = t(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.count_if(c).alias(n) for n, c in (("a", x & y), ("b", ~x & y), ("c", x & ~y), ("d", ~x & ~y))])
    return cells.select("l_returnflag", F.explode(stats.contingency_table_rows(*(F.col(c) for c in "abcd"))).alias("r")).select("l_returnflag", "r.*")


@query("""SELECT l_partkey, round(m0 / c0, 6) AS share_a, round(m1 / c1, 6) AS share_b, round(m0 / c0 - m1 / c1, 6) AS meth_diff FROM (SELECT l_partkey, sum(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS m0, sum(l_linenumber) FILTER (WHERE l_returnflag = 'N') AS m1,
 sum(l_quantity + 7) FILTER (WHERE l_returnflag = 'R') AS c0, sum(l_quantity + 7) FILTER (WHERE l_returnflag = 'N') AS c1 FROM lineitem GROUP BY 1) WHERE c0 IS NOT NULL AND c1 IS NOT NULL""")
def pairwise_diff_test(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").withColumn("c", (F.col("l_quantity") + 7).cast("long"))
    return stats.pairwise_diff_test(li, ["l_partkey"], "l_returnflag", "l_linenumber", "c", ("R", "N")).select("l_partkey", r6("share_a"), r6("share_b"), r6("meth_diff"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem")
def pearson_test(spark: SparkSession, d: str) -> DataFrame:
    return stats.pearson_test(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(r6("r"), "n")


# ---- texts -----------------------------------------------------------------------------------------------------------

@query(r"""SELECT page_id, path, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '["''](/[A-Za-z0-9_.][^"''\s<>]*)["'']', 1)) AS path FROM pages) WHERE NOT starts_with(path, '/dev/') AND NOT starts_with(path, '/tmp/') AND NOT starts_with(path, '/usr/bin/env') AND NOT starts_with(path, '/bin/') GROUP BY 1, 2""")
def scan_absolute_paths(spark: SparkSession, d: str) -> DataFrame:
    return texts.scan_absolute_paths(t(spark, d, "pages"), "page_id", "html")

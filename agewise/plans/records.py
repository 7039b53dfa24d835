"""Registered queries over nested records, which are built from the shared tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agewise.functions import annotate as an
from agewise.functions import normalize as nz
from agewise.plans.bindings import query, t

# the lines of each part as its transcripts, in the order of their keys
TX = """(SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag = 'R' AS canonical,
  CASE l_linenumber % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' WHEN 3 THEN 'MODIFIER' END AS impact,
  CASE l_linenumber % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rank,
  l_orderkey || '.' || l_linenumber AS transcript_id, 'G' || (l_suppkey % 7) AS gene_symbol,
  CASE l_linenumber WHEN 1 THEN 'missense_variant' WHEN 2 THEN 'intron_variant' WHEN 3 THEN 'synonymous_variant' WHEN 4 THEN 'upstream_gene_variant' ELSE 'other_variant' END AS term,
  CASE WHEN l_quantity > 40 THEN 'deleterious' END AS sift_prediction, CASE WHEN l_quantity > 35 THEN l_discount END AS sift_score,
  CASE WHEN l_quantity < 10 THEN 'benign' ELSE '' END AS polyphen_prediction, CASE WHEN l_tax > 0.06 THEN 'g.' || l_orderkey END AS hgvsg FROM lineitem)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """(l_partkey, variant) with a VARIANT record of each part."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    none = F.lit(None).cast("string")
    impact = F.when(n % 5 == 0, "HIGH").when(n % 5 == 1, "MODERATE").when(n % 5 == 2, "LOW").when(n % 5 == 3, "MODIFIER")
    term = F.when(n == 1, "missense_variant").when(n == 2, "intron_variant").when(n == 3, "synonymous_variant").when(n == 4, "upstream_gene_variant").otherwise("other_variant")
    fields = {
        "canonical": F.when(F.col("l_returnflag") == "R", "1").otherwise("0"), "impact": impact, "transcript_id": F.concat(F.col("l_orderkey").cast("string"), F.lit("."), n.cast("string")),
        "gene_symbol": F.concat(F.lit("G"), (F.col("l_suppkey") % 7).cast("string")), "consequence_terms": F.array(term),
        "sift_prediction": F.when(q > 40, "deleterious"), "sift_score": F.when(q > 35, F.col("l_discount")), "polyphen_prediction": F.when(q < 10, "benign").otherwise(""),
        "polyphen_score": F.lit(None).cast("double"), "hgvsg": F.when(F.col("l_tax") > 0.06, F.concat(F.lit("g."), F.col("l_orderkey").cast("string"))), "hgvsc": none, "hgvsp": none, "cadd_phred": none,
    }
    row = F.struct("l_orderkey", "l_linenumber", F.struct(*[v.alias(k) for k, v in fields.items()]).alias("t"))
    each = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    key = F.col("l_partkey").cast("string")
    variant = F.struct(
        F.concat(F.lit("rs"), key).alias("id"), none.alias("input"), F.lit("7").alias("seq_region_name"), F.col("l_partkey").alias("start"), F.lit("A/G/T").alias("allele_string"),
        F.lit("missense_variant").alias("most_severe_consequence"), none.alias("hgvsg"), F.transform("rows", lambda r: r["t"]).alias("transcript_consequences"),
    )
    return each.select("l_partkey", variant.cast(an.VARIANT).alias("variant"))


@query(f"SELECT l_partkey, transcript_id, impact FROM {TX} QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY canonical DESC, rank, l_orderkey, l_linenumber) = 1")
def pick_primary_transcript(spark: SparkSession, d: str) -> DataFrame:
    best = an.pick_primary_transcript(F.col("variant.transcript_consequences"))
    return _records(spark, d).select("l_partkey", best["transcript_id"].alias("transcript_id"), best["impact"].alias("impact"))


@query(f"SELECT l_partkey, transcript_id FROM {TX} QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY gene_symbol NOT IN ('G1', 'G3'), rank, term <> 'missense_variant', transcript_id) = 1")
def pick_validated_transcript(spark: SparkSession, d: str) -> DataFrame:
    best = an.pick_validated_transcript(F.col("variant.transcript_consequences"), F.array(F.lit("g1"), F.lit("G3")))
    return _records(spark, d).select("l_partkey", best["transcript_id"].alias("transcript_id"))


SIFT = f"""(SELECT * FROM {TX} WHERE sift_prediction IS NOT NULL OR polyphen_prediction <> '' OR sift_score IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY rank, l_orderkey, l_linenumber) = 1)"""


@query(f"SELECT l_partkey, s.sift_prediction, s.sift_score, nullif(s.polyphen_prediction, '') AS polyphen_prediction FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN {SIFT} s USING (l_partkey)")
def pick_sift_polyphen(spark: SparkSession, d: str) -> DataFrame:
    best = an.pick_sift_polyphen(F.col("variant.transcript_consequences"))
    return _records(spark, d).select("l_partkey", *[best[c].alias(c) for c in ("sift_prediction", "sift_score", "polyphen_prediction")])


@query(f"""
WITH p AS (SELECT * FROM {TX} QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY canonical DESC, rank, l_orderkey, l_linenumber) = 1),
h AS (SELECT l_partkey, hgvsg FROM {TX} WHERE hgvsg IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1),
g AS (SELECT l_partkey, impact FROM {TX} WHERE impact IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY rank, l_orderkey, l_linenumber) = 1)
SELECT l_partkey, coalesce(p.impact, g.impact) AS vep_impact, p.transcript_id AS vep_transcript_id, p.gene_symbol AS vep_gene_symbol, p.term AS vep_consequence_terms, s.sift_score, h.hgvsg
FROM p LEFT JOIN h USING (l_partkey) LEFT JOIN g USING (l_partkey) LEFT JOIN {SIFT} s USING (l_partkey)
""")
def extract_vep_fields(spark: SparkSession, d: str) -> DataFrame:
    flat = _records(spark, d).select("l_partkey", an.extract_vep_fields(F.col("variant")).alias("f"))
    return flat.select("l_partkey", *[f"f.{c}" for c in ("vep_impact", "vep_transcript_id", "vep_gene_symbol", "vep_consequence_terms", "sift_score", "hgvsg")])


@query(f"SELECT l_partkey, string_agg(DISTINCT gene_symbol, ';' ORDER BY gene_symbol) AS genes FROM {TX} GROUP BY 1")
def gene_symbol_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("l_partkey", F.array_join(an.gene_symbol_rollup(F.col("variant.transcript_consequences")), ";").alias("genes"))


POPS = """(SELECT l_partkey, l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS source, CASE WHEN l_linenumber % 2 = 0 THEN 'nfe' ELSE 'afr' END AS id,
  CASE WHEN l_quantity >= 5 THEN l_linenumber END AS ac, l_quantity::BIGINT - 10 AS an FROM lineitem)"""


@query(f"""SELECT l_partkey, round(ac / an, 6) AS af FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN (SELECT * FROM {POPS} WHERE id = 'nfe' AND an > 0 AND ac IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY source, l_orderkey, l_linenumber) = 1) USING (l_partkey)""")
def extract_population_af(spark: SparkSession, d: str) -> DataFrame:
    pop = F.struct(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "nfe").otherwise("afr").alias("id"),
        F.when(F.col("l_quantity") >= 5, F.col("l_linenumber")).cast("long").alias("ac"), (F.col("l_quantity").cast("long") - 10).alias("an"),
    )

    def block(flag: str) -> F.Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == flag, pop)))
        return F.struct(F.transform(rows, lambda r: F.struct(r["id"].alias("id"), r["ac"].alias("ac"), r["an"].alias("an"))).alias("populations"))

    record = F.struct(F.lit("v").alias("variant_id"), *[block(f).alias(n) for n, f in (("joint", "R"), ("exome", "A"), ("genome", "N"))])
    each = t(spark, d, "lineitem").groupBy("l_partkey").agg(record.cast(an.FREQUENCIES).alias("r"))
    return each.select("l_partkey", F.round(an.extract_population_af(F.col("r")), 6).alias("af"))


@query("""SELECT l_partkey, region FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN (SELECT l_partkey, CASE WHEN l_suppkey % 5 = 0 THEN l_suppkey || '_PATCH' ELSE l_suppkey::VARCHAR END AS region FROM lineitem
 WHERE l_returnflag <> 'N' AND l_suppkey % 5 <> 0 AND l_linenumber <> 7 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY length(region), region) = 1) USING (l_partkey)""")
def pick_grch38_mapping(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.col("l_suppkey").cast("string"), F.lit("_PATCH"))).otherwise(F.col("l_suppkey").cast("string"))
    m = F.struct(
        F.when(F.col("l_returnflag") == "N", "GRCh37").otherwise("GRCh38").alias("assembly_name"), F.when(F.col("l_linenumber") == 7, "scaffold").otherwise("chromosome").alias("coord_system"),
        name.alias("seq_region_name"), F.col("l_orderkey").alias("start"),
    )
    each = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_list(m).alias("ms"))
    return each.select("l_partkey", an.pick_grch38_mapping(F.col("ms"))["seq_region_name"].alias("region"))


TRAITS = "(SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'LDL cholesterol' WHEN 'O' THEN 'Alzheimer disease' ELSE 'Parkinson disease' END AS trait, o_orderpriority AS other FROM orders)"


@query(f"""SELECT o_custkey, string_agg(DISTINCT x, '; ' ORDER BY x) AS gwas_all_traits, coalesce(string_agg(DISTINCT x, '; ' ORDER BY x) FILTER (WHERE x LIKE 'Alz%'), '') AS gwas_ad_traits,
 coalesce(string_agg(DISTINCT x, '; ' ORDER BY x) FILTER (WHERE x LIKE 'Park%'), '') AS gwas_pd_traits, coalesce(string_agg(DISTINCT x, '; ' ORDER BY x) FILTER (WHERE x LIKE 'LDL%'), '') AS gwas_lipid_traits,
 (count(*) / 2)::BIGINT AS gwas_association_count FROM (SELECT o_custkey, trait AS x FROM {TRAITS} UNION ALL SELECT o_custkey, other FROM {TRAITS}) GROUP BY 1""")
def gwas_trait_rollup(spark: SparkSession, d: str) -> DataFrame:
    trait = F.when(F.col("o_orderstatus") == "F", "LDL cholesterol").when(F.col("o_orderstatus") == "O", "Alzheimer disease").otherwise("Parkinson disease")
    a = F.struct(
        F.array(trait, F.col("o_orderpriority")).alias("traits"), F.lit(2.0).alias("mantissa"), F.lit(-8).alias("exponent"), F.lit("+").alias("direction"),
        F.array(F.lit("B"), F.lit("A"), F.lit("B")).alias("genes"), F.concat(F.lit("https://x/associations/"), F.col("o_orderkey").cast("string"), F.lit("{?p}")).alias("href"),
    )
    each = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(a.cast(an.ASSOCIATION)).alias("a"))
    return each.select("o_custkey", an.gwas_trait_rollup(F.col("a")).alias("g")).select("o_custkey", "g.*")


@query("SELECT o_orderkey, o_orderpriority AS trait, round(o_totalprice * 1e-6, 12) AS pvalue, 'A,B' AS genes, o_orderkey::VARCHAR AS association_id FROM orders")
def flatten_gwas(spark: SparkSession, d: str) -> DataFrame:
    a = F.struct(
        F.array(F.col("o_orderpriority")).alias("traits"), F.col("o_totalprice").alias("mantissa"), F.lit(-6).alias("exponent"), F.lit("+").alias("direction"),
        F.array(F.lit("B"), F.lit("A"), F.lit("B")).alias("genes"), F.concat(F.lit("https://x/associations/"), F.col("o_orderkey").cast("string"), F.lit("{?p}")).alias("href"),
    )
    flat = t(spark, d, "orders").select("o_orderkey", F.explode(an.flatten_gwas(F.array(a.cast(an.ASSOCIATION)))).alias("x"))
    return flat.select("o_orderkey", F.col("x.traits")[0].alias("trait"), F.round("x.pvalue", 12).alias("pvalue"), F.array_join("x.reported_genes", ",").alias("genes"), "x.association_id")


AM = "(SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'chr7:g.1A>G' ELSE 'chr7:g.1A>C' END AS id, CASE WHEN l_returnflag <> 'N' THEN l_discount END AS score, CASE l_linestatus WHEN 'F' THEN 'p' ELSE 'B' END AS pred FROM lineitem)"


@query(f"""SELECT l_partkey, l_orderkey || '.' || l_linenumber AS record, CASE WHEN score IS NOT NULL AND l_partkey % 2 = 0 THEN printf('%.4f', score) END AS score,
 CASE WHEN score IS NOT NULL AND l_partkey % 2 = 0 THEN CASE pred WHEN 'p' THEN 'pathogenic' ELSE 'benign' END END AS cls
 FROM {AM} QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY id NOT LIKE '%A>G%', CASE WHEN id NOT LIKE '%A>G%' AND score IS NULL THEN 1 ELSE 0 END, l_orderkey, l_linenumber) = 1""")
def pick_allele_record(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, "chr7:g.1A>G").otherwise("chr7:g.1A>C").alias("_id"),
        F.when(F.col("l_returnflag") != "N", F.array("l_discount")).alias("am_score"), F.array(F.when(F.col("l_linestatus") == "F", "p").otherwise("B")).alias("am_pred"),
    )
    each = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_list(row)).alias("rs"))
    each = each.withColumn("r", an.pick_allele_record(F.col("rs"), F.lit("A"), F.lit("G,T")))
    found = an.extract_alphamissense(F.col("r"), F.col("l_partkey") % 2 == 0)
    return each.select("l_partkey", F.concat(F.col("r.l_orderkey").cast("string"), F.lit("."), F.col("r.l_linenumber").cast("string")).alias("record"), found["score"].alias("score"), found["cls"].alias("cls"))


@query("""SELECT l_partkey, snpId, pos, alt FROM (SELECT l_partkey, l_orderkey, l_linenumber, 'rs' || (l_suppkey % 10) AS snpId, l_orderkey AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'G' ELSE 'C' END AS alt FROM lineitem)
 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY snpId <> 'rs4', CASE WHEN snpId <> 'rs4' THEN alt <> 'G' END, l_orderkey, l_linenumber) = 1""")
def parse_gtex_variant(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct(
        "l_orderkey", "l_linenumber", F.lit(None).cast("string").alias("variantId"), F.concat(F.lit("rs"), (F.col("l_suppkey") % 10).cast("string")).alias("snpId"), F.lit("chr7").alias("chromosome"),
        F.col("l_orderkey").alias("pos"), F.lit("A").alias("ref"), F.when(F.col("l_linenumber") % 2 == 0, "G").otherwise("C").alias("alt"),
    )
    each = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_list(row)).alias("rs"))
    found = an.parse_gtex_variant(an.pick_gtex_variant(F.col("rs"), F.lit("RS4"), F.lit("a"), F.lit("g")))
    return each.select("l_partkey", *[found[c].alias(c) for c in ("snpId", "pos", "alt")])


@query(f"""
WITH v AS (SELECT l_partkey, transcript_id, gene_symbol, term, sift_prediction, polyphen_prediction FROM {TX} QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY gene_symbol <> 'G1', rank, term <> 'missense_variant', transcript_id) = 1)
SELECT 'rs' || p_partkey AS "rsID", v.transcript_id IS NULL AS no_vep_record, coalesce(v.gene_symbol, 'NA') AS canonical_gene,
 CASE WHEN v.transcript_id IS NULL THEN 'NA' ELSE CASE v.term WHEN 'missense_variant' THEN 'coding-missense' WHEN 'intron_variant' THEN 'intronic' WHEN 'synonymous_variant' THEN 'coding-synonymous' WHEN 'upstream_gene_variant' THEN 'upstream-downstream-regulatory' ELSE 'other' END END AS functional_class,
 v.transcript_id IS NOT NULL AND v.term NOT IN ('missense_variant', 'synonymous_variant') AS alphagenome_eligible, coalesce(v.sift_prediction, 'NA') AS "SIFT", coalesce(nullif(v.polyphen_prediction, ''), 'NA') AS "PolyPhen",
 CASE WHEN v.term = 'missense_variant' THEN '0.1250' ELSE 'NA' END AS "AlphaMissense_score", CASE WHEN v.transcript_id IS NULL THEN 'NA' ELSE 'G,T' END AS alt_allele
FROM part LEFT JOIN v ON l_partkey = p_partkey AND p_size > 10
""")
def annotate_functional(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").join(_records(spark, d), (F.col("l_partkey") == F.col("p_partkey")) & (F.col("p_size") > 10), "left")
    effects = F.array(F.struct(F.lit("x").alias("_id"), F.array(F.lit(0.125)).alias("am_score"), F.array(F.lit("A")).alias("am_pred"), F.lit("12.5").alias("cadd_phred")))
    none = F.array().cast(f"array<{an.ASSOCIATION}>")
    row = an.annotate_functional(F.col("variant"), F.array(F.lit("G1")), effects, none, F.concat(F.lit("rs"), F.col("p_partkey").cast("string")))
    flat = rows.select(row.alias("r")).select("r.*")
    return flat.select("rsID", "no_vep_record", "canonical_gene", "functional_class", "alphagenome_eligible", "SIFT", "PolyPhen", "AlphaMissense_score", "alt_allele")


@query("""SELECT p_partkey, 'T' AS ref, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'A' END AS alt, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'A' ELSE 'A,C' END AS alts,
 CASE WHEN p_size % 2 = 0 THEN '8q24.3' ELSE 'NA' END AS band, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT END AS whole, least(p_size, 25) AS low, greatest(p_size, 25) AS high,
 CASE p_partkey % 4 WHEN 0 THEN '16' WHEN 1 THEN 'X' WHEN 2 THEN '7' ELSE 'M' END AS contig, string_agg_genes AS genes
 FROM (SELECT *, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ';') || '/' || p_brand || ',', ';'), lambda x: x), lambda x: x <> ''), ';') AS raw, upper(replace(p_name, ' ', ';')) || ';' || upper(p_brand) AS string_agg_genes FROM part)""")
def scalar_labels(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    allele = nz.parse_alleles(F.when(size % 3 == 0, "T").when(size % 3 == 1, "T/A").otherwise("T/A/C"))
    span = nz.ordered_span(size, F.lit(25))
    contig = F.when(key % 4 == 0, "NC_000016.10").when(key % 4 == 1, "chrx").when(key % 4 == 2, "chr7").otherwise("M")
    genes = nz.gene_tokens(F.concat(F.translate("p_name", " ", ";"), F.lit("/ "), "p_brand", F.lit(",")))
    return t(spark, d, "part").select(
        "p_partkey", allele["ref"].alias("ref"), allele["alt"].alias("alt"), allele["alts"].alias("alts"), nz.extract_cytoband(F.when(size % 2 == 0, "Location:8q24.3").otherwise("Location: 5")).alias("band"),
        nz.coerce_integer(F.col("p_retailprice")).alias("whole"), span["low"].alias("low"), span["high"].alias("high"), nz.normalize_chrom_accession(contig).alias("contig"), F.array_join(genes, ";").alias("genes"),
    )


@query("""SELECT l_orderkey, l_linenumber, round_even(l_quantity * l_discount, 0)::BIGINT AS methylated, (l_quantity - round_even(l_quantity * l_discount, 0))::BIGINT AS unmethylated, l_suppkey || ':' || l_partkey || '-' || (l_partkey + 1) AS label,
 CASE WHEN l_linenumber BETWEEN 2 AND 5 THEN left('ACGT', l_linenumber - 2) || 'N' || substr('ACGT', l_linenumber) END AS sequence, round(greatest(l_tax, 0.01), 6) AS floored, round(-log10(greatest(l_tax, 1e-300)), 6) AS shown,
 CASE l_returnflag WHEN 'R' THEN 'rs' || l_partkey ELSE 'rs' || l_partkey || ' (' || l_shipmode || ')' END AS locus FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem)""")
def site_labels(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    place = [F.col("l_suppkey").cast("string"), F.col("l_partkey"), F.col("l_partkey") + 1]
    m = nz.methylated_counts(F.col("l_quantity"), F.col("l_discount") * 100, *place)
    sequence = nz.snv_alt_sequence(F.lit("ACGT"), F.lit(2), F.col("l_linenumber"), F.lit("A"), F.lit("N"))
    gene = F.when(F.col("l_returnflag") != "R", F.col("l_linestatus"))
    return li.select(
        "l_orderkey", "l_linenumber", m["methylated"].alias("methylated"), m["unmethylated"].alias("unmethylated"), m["label"].alias("label"), sequence.alias("sequence"),
        F.round(nz.floor_for_log(F.col("l_tax"), 0.01), 6).alias("floored"), F.round(nz.minus_log10(F.col("l_tax")), 6).alias("shown"),
        nz.format_locus_label(F.concat(F.lit("rs"), F.col("l_partkey").cast("string")), gene).alias("locus"),
    )


ALIAS = "(CASE p_partkey % 6 WHEN 0 THEN '-' || p_size || 'A>C' WHEN 1 THEN 'A' || p_size || 'G' WHEN 2 THEN 'I' || p_size || 'V' WHEN 3 THEN 'Val' || p_size || 'Met' WHEN 4 THEN 'DQB1*0' || (p_size % 9) ELSE 'cetp' END)"


@query(f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand || ':c.-' || p_size || 'A>C' WHEN 1 THEN p_brand || ':c.' || p_size || 'A>G;' || p_brand || ':p.Ala' || p_size || 'Gly' WHEN 2 THEN p_brand || ':p.Ile' || p_size || 'Val'
  WHEN 3 THEN p_brand || ':p.Val' || p_size || 'Met' ELSE '' END AS candidates, p_partkey % 6 = 4 AS non_snp, p_partkey % 6 = 5 AS gene_placeholder,
  CASE WHEN p_partkey % 6 = 5 THEN 'CETP' WHEN a IN ('DQB1*03', 'DQB1*05') THEN 'HLA-DQB1' ELSE a END AS symbol FROM (SELECT *, {ALIAS} AS a FROM part)""")
def hgvs_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumn("a", F.expr(ALIAS))
    odd, mapped = nz.classify_non_snp(F.col("a")), nz.map_legacy_symbol(F.col("a"))
    return p.select("p_partkey", F.array_join(nz.hgvs_candidates(F.col("p_brand"), F.col("a")), ";").alias("candidates"), odd["non_snp"].alias("non_snp"), odd["gene_placeholder"].alias("gene_placeholder"), mapped["symbol"].alias("symbol"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'Oxford Nanopore' WHEN 'click' THEN 'PacBio' WHEN 'error' THEN 'unknown' ELSE event_type END AS platform, CASE WHEN event_type = 'view' THEN 'Missense' ELSE upper(left(event_type, 1)) || substr(event_type, 2) || ' Thing' END AS label,
 round(1 + (value - lo) / (hi - lo) * 9, 6) AS size, CASE WHEN event_type = 'purchase' THEN '3' WHEN event_type = 'error' THEN '' ELSE '1' END AS n_samples, json_extract_string(props, '$.k')::INT AS k
 FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)""")
def record_labels(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    e = nz.minmax_scale(t(spark, d, "events"), "value", "size", 1, 10)
    count = nz.infer_sample_count(F.when(kind == "purchase", " 3 ").otherwise("many"), F.array().cast("array<string>"), F.when(kind == "error", "").otherwise("SRX1"))
    return e.select(
        "event_id", nz.normalize_platform(F.when(kind == "view", "MinION run").when(kind == "click", " Pac Bio ").when(kind == "error", "  ").otherwise(kind)).alias("platform"),
        nz.format_consequence_label(F.when(kind == "view", "missense_variant").otherwise(F.concat(kind, F.lit("_thing_variant")))).alias("label"), F.round("size", 6).alias("size"), count.alias("n_samples"),
        F.from_json("props", "k int")["k"].alias("k"),
    )


@query("""SELECT doc_id, (doc_id % 80)::DOUBLE AS predicted_age, CASE WHEN doc_id % 9 <> 0 THEN (n_chars % 90)::DOUBLE + 0.5 END AS chronological_age,
 CASE WHEN doc_id % 9 <> 0 THEN doc_id % 80 - (n_chars % 90 + 0.5) END::DOUBLE AS age_acceleration FROM (SELECT doc_id, length(text) AS n_chars FROM documents WHERE text IS NOT NULL)""")
def age_acceleration(spark: SparkSession, d: str) -> DataFrame:
    """Ages that come as text under another name, some of them no number."""
    n = F.char_length("text") % 90
    age = F.when(F.col("doc_id") % 9 == 0, "unknown").otherwise(F.concat(F.lit(" "), n.cast("string"), F.lit(".5 ")))
    rows = t(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", (F.col("doc_id") % 80).cast("double").alias("predicted_age"), age.alias("Age"))
    return nz.age_acceleration(nz.normalize_age(rows))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 0 ELSE l_quantity::DOUBLE END AS ref_score, CASE WHEN l_linenumber <= 5 THEN -l_discount::DOUBLE ELSE 0 END::DOUBLE AS alt_score FROM lineitem")
def parse_track_scores(spark: SparkSession, d: str) -> DataFrame:
    """Dumps with a mean, with values only, and without either."""
    n, q, x = F.col("l_linenumber"), F.col("l_quantity").cast("double").cast("string"), (-F.col("l_discount").cast("double")).cast("string")
    ref = F.when(n == 1, "reference=none ").when(n % 2 == 0, F.concat(F.lit("nonzero_mean: "), q, F.lit(" "))).otherwise(F.concat(F.lit("values=array([[ "), q, F.lit(", 9]]) ")))
    alt = F.when(n <= 3, F.concat(F.lit("alternate='nonzero_mean' = "), x)).when(n <= 5, F.concat(F.lit("alternate=values=array([["), x, F.lit("]])"))).otherwise("")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", nz.parse_track_scores(F.concat(ref, alt)).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query("""SELECT doc_id, CASE WHEN length(s) > 2000 THEN substr(s, 1, 2000) || '...' ELSE s END AS description,
 CASE doc_id % 3 WHEN 0 THEN 'https://www.ncbi.nlm.nih.gov/sra/SRX' || doc_id WHEN 1 THEN 'https://www.ncbi.nlm.nih.gov/sra/?term=' || doc_id ELSE '' END AS link
FROM (SELECT doc_id, trim(coalesce(nullif(text, ''), lang, ''), ' ') AS s FROM documents)""")
def record_link(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records: the text as abstract, the language as title, ids as accessions or uids."""
    key, r = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    accession = F.when(r == 0, F.concat(F.lit(" SRX"), key)).when(r == 1, key)
    none = F.lit(None).cast("string")
    described = nz.coalesce_description(F.lit(""), F.col("text"), none, F.col("lang"))
    return t(spark, d, "documents").select("doc_id", described.alias("description"), nz.record_link(accession, F.when(r == 1, key)).alias("link"))

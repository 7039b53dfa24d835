"""Registered queries of scans and sinks: each writes a file format from a given table into the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agewise.functions.lineage import shared_path
from agewise.plans.bindings import query, t
from agewise.sources import readers, sinks, vcf

_SAMPLES = 4
_CALLS = ("0/0", "0|1", "1/1", "./1")


def _vcf(spark: SparkSession, d: str) -> str:
    """``part`` as VCF: a file for each chromosome, with its header."""
    calls = F.array(*map(F.lit, _CALLS))
    p = t(spark, d, "part").select((F.col("p_partkey") % 22 + 1).cast("string").alias("chrom"), F.col("p_partkey").alias("pos"))
    cells = [F.get(calls, (F.col("pos") * k % 4).cast("int")) for k in range(1, _SAMPLES + 1)]
    name = F.when(F.col("pos") % 3 == 0, ".").otherwise(F.concat(F.lit("rs"), "pos"))
    lines = p.select("chrom", "pos", F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), "pos", name, F.lit("A"), F.lit("G"), *[F.lit(".")] * 3, F.lit("GT"), *cells).alias("value"))
    names = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"S{k}" for k in range(1, _SAMPLES + 1)]])
    heads = p.select("chrom").distinct().select("chrom", F.lit(-1).cast("long").alias("pos"), F.lit(names).alias("value"))
    path = shared_path(spark, "vcf")
    lines.unionByName(heads).repartition("chrom").sortWithinPartitions("chrom", "pos").select("chrom", "value").write.partitionBy("chrom").text(path)
    return path


_CELLS = f"""(SELECT 'S' || k AS eid, CASE WHEN p_partkey % 3 = 0 THEN %s || ':' || p_partkey ELSE 'rs' || p_partkey END AS rsid, %s AS chrom, p_partkey AS pos, 'A' AS ref, 'G' AS alt,
 CASE p_partkey * k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS alt_dosage FROM part, range(1, {_SAMPLES + 1}) r(k))"""
_LONG, _SHORT = "('chr' || (p_partkey % 22 + 1))", "((p_partkey % 22 + 1)::VARCHAR)"


@query("SELECT * FROM " + _CELLS.replace("%s", _LONG))
def scan_vcf_genotypes(spark: SparkSession, d: str) -> DataFrame:
    return readers.scan_vcf_genotypes(spark, _vcf(spark, d) + "/*")


@query("SELECT * FROM " + _CELLS.replace("%s", _SHORT) + " WHERE chrom IN ('7', '22')")
def scan_vcf_by_chromosome(spark: SparkSession, d: str) -> DataFrame:
    return readers.scan_vcf_by_chromosome(spark, _vcf(spark, d) + "/*", ["7", "22"])


@query("""
SELECT 'S' || k AS eid, l_orderkey || '.' || l_linenumber AS rsid, 'chr' || (l_suppkey % 22 + 1) AS chrom, l_orderkey AS pos, 'A' AS ref, 'T' AS alt,
  CASE (l_partkey + k) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS alt_dosage
FROM lineitem, range(1, 4) r(k) WHERE l_suppkey % 22 + 1 IN (7, 21)
""")
def scan_vcf_blocks(spark: SparkSession, d: str) -> DataFrame:
    """``lineitem`` as block-compressed VCF in chromosome order, of which two chromosomes are read."""
    calls = F.array(*map(F.lit, _CALLS))
    rows = t(spark, d, "lineitem").withColumn("chrom", F.format_string("chr%d", F.col("l_suppkey") % 22 + 1))
    cells = [F.concat(F.get(calls, ((F.col("l_partkey") + k) % 4).cast("int")), F.lit(":"), F.col("l_quantity").cast("int").cast("string")) for k in range(1, 4)]
    name = F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    text = F.concat_ws("\t", "chrom", F.col("l_orderkey").cast("string"), name, *map(F.lit, ("A", "T", ".", "PASS", ".", "GT:DP")), *cells)
    lines = rows.select("chrom", "l_orderkey", text.alias("value")).repartitionByRange("chrom", "l_orderkey").sortWithinPartitions("chrom", "l_orderkey")
    names = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "S1", "S2", "S3"])
    path = shared_path(spark, "vcf")
    vcf.sink_vcf_blocks(lines, "##fileformat=VCFv4.2\n" + names, path)
    return vcf.scan_vcf_blocks(spark, path, ["7", "21"], grouped=True)


@query("SELECT c_custkey::VARCHAR AS eid, c_name AS name, c_acctbal::DOUBLE AS balance FROM customer")
def scan_table(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "table") + ".csv"
    sinks.sink_csv(t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    found = readers.scan_table(spark, path, {"c_custkey": "eid", "c_name": "name", "c_acctbal": "balance"})
    return found.select("eid", "name", F.col("balance").cast("double").alias("balance"))


@query("SELECT 'chr' || (p_partkey % 22 + 1) AS chrom, p_partkey AS start, p_partkey + 1 AS \"end\", 'm' AS name, p_size::DOUBLE AS score, '+' AS strand, p_size::BIGINT AS coverage, 50.0::DOUBLE AS percent, (p_size // 2)::BIGINT AS methylated, (p_size - p_size // 2)::BIGINT AS unmethylated FROM part")
def scan_bedmethyl(spark: SparkSession, d: str) -> DataFrame:
    p, half = F.col("p_partkey"), F.floor(F.col("p_size") / 2).cast("long")
    rows = t(spark, d, "part").select(
        F.concat(F.lit("chr"), (p % 22 + 1).cast("string")), p, p + 1, F.lit("m"), F.col("p_size"), F.lit("+"), F.col("p_size"), F.lit(50), half, F.col("p_size") - half
    )
    path = shared_path(spark, "bed")
    rows.write.option("sep", "\t").csv(path)
    return readers.scan_bedmethyl(spark, path)


@query("SELECT DISTINCT upper('g' || (p_partkey % 997)) AS gene FROM part WHERE p_size % 2 = 0")
def scan_gtf_protein_coding(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 2 == 0, "protein_coding").otherwise("lncRNA")
    notes = F.format_string('gene_id "x"; gene_type "%s"; gene_name "g%d";', kind, F.col("p_partkey") % 997)
    path = shared_path(spark, "gtf")
    t(spark, d, "part").select(F.concat_ws("\t", *map(F.lit, ("chr1", "HAVANA", "gene", "1", "2", ".", "+", ".")), notes)).write.text(path)
    return readers.scan_gtf_protein_coding(spark, path)


@query("SELECT DISTINCT 'cg' || (o_custkey % 1009) AS id FROM orders")
def scan_id_list(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "ids")
    rows = t(spark, d, "orders").select(F.format_string('"cg%d",x', F.col("o_custkey") % 1009).alias("value"))
    rows.unionByName(spark.sql("SELECT explode(array('probe', '# note', '')) AS value")).write.text(path)
    return readers.scan_id_list(spark, path)


@query("SELECT 'rs' || (o_custkey % 499) AS key, max(o_orderkey)::VARCHAR AS id FROM orders GROUP BY 1 UNION ALL SELECT o_orderkey::VARCHAR, o_orderkey::VARCHAR FROM orders")
def scan_local_vep_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """The last line of a key, where a file is read by many tasks."""
    path = shared_path(spark, "vep")
    lines = t(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.format_string("rs%d", F.col("o_custkey") % 499).alias("rsid"), F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"))).alias("payload"))).alias("value"))
    lines.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return readers.scan_local_vep_jsonl(spark, path).select("key", "variant.id")


@query("SELECT 'A' AS label, n_name AS note, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2")
def sink_commented_csv(spark: SparkSession, d: str) -> DataFrame:
    names = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("note"))
    counts = t(spark, d, "customer").join(names, "c_nationkey").groupBy("note").agg(F.count("*").alias("n"))
    path = shared_path(spark, "report")
    sinks.sink_commented_csv(counts.select(F.lit("A").alias("label"), "note", "n"), path, "counts of customers")
    return readers.scan_commented_csv(spark, path, "label string, note string, n long")


_PARTS = "part, range(1, 5) r(k)"


@query(f"SELECT 'cg' || p_partkey AS probe, (k - 1)::INTEGER AS sample_no, CASE WHEN p_partkey % 7 <> 0 OR k <> 2 THEN (p_size * k)::DOUBLE / 1000 END AS beta FROM {_PARTS}")
def scan_geo_series_matrix(spark: SparkSession, d: str) -> DataFrame:
    """``part`` as the table of a series matrix, with quoted ids and a value that is no number."""
    key = F.col("p_partkey")
    cells = [F.when((key % 7 == 0) & F.lit(k == 2), "null").otherwise(F.concat((F.col("p_size") * k).cast("string"), F.lit("e-3"))) for k in range(1, 5)]
    rows = t(spark, d, "part").select(F.concat_ws("\t", F.format_string('"cg%d"', key), *cells).alias("value"))
    heads = ("!Series_title\t\"x\"", "!Sample_geo_accession\t\"GSM1\"", "!series_matrix_table_begin", '"ID_REF"\t"GSM1"', "!series_matrix_table_end")
    path = shared_path(spark, "matrix")
    rows.unionByName(spark.createDataFrame([(h,) for h in heads], "value string")).write.text(path)
    return readers.scan_geo_series_matrix(spark, path).drop("file")


@query("SELECT 'GSM' || c_custkey AS gsm, (CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 50 WHEN c_custkey % 3 <> 0 THEN c_custkey % 90 END)::DOUBLE AS age FROM customer")
def geo_sample_ages(spark: SparkSession, d: str) -> DataFrame:
    """A thousand customers a file as its samples; the second line of characteristics overrules the first."""
    key = F.col("c_custkey")
    first = F.when(key % 3 != 0, F.concat(F.lit("age: "), (key % 90).cast("string"))).otherwise("tissue: blood")
    second = F.when(key % 5 == 0, F.concat(F.lit("Age (y)="), (key % 50).cast("string"))).otherwise("sex: f")
    fields = (("!Sample_geo_accession", F.format_string("GSM%d", key)), ("!Sample_characteristics_ch1", first), ("!Sample_characteristics_ch1", second))
    each = t(spark, d, "customer").select(F.floor(key / 1000).alias("series"), F.posexplode(F.array(*[F.struct(F.lit(f).alias("f"), key.alias("k"), F.concat(F.lit('"'), v, F.lit('"')).alias("v")) for f, v in fields])).alias("n", "c"))
    line = F.concat_ws("\t", F.min("c.f"), F.transform(F.sort_array(F.collect_list(F.struct("c.k", "c.v"))), lambda x: x["v"]))
    path = shared_path(spark, "series")
    lines = each.groupBy("series", "n").agg(line.alias("value")).repartition("series").sortWithinPartitions("series", "n")
    lines.select("series", "value").write.partitionBy("series").text(path)
    return readers.geo_sample_ages(readers.scan_geo_sample_rows(spark, path + "/*")).select("gsm", "age")


@query("SELECT 'cg' || p_partkey AS cpg, (p_size - 25)::DOUBLE / 8 AS coef FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT NULL, 0.5")
def scan_clock_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """``part`` as a clock with a note, a header and an intercept; one in eleven weights is blank, and the reader leaves those out."""
    key = F.col("p_partkey")
    weight = F.when(key % 11 != 0, ((F.col("p_size") - 25) / 8).cast("string")).otherwise("")
    rows = t(spark, d, "part").select(F.format_string('"cg%d",x,%s', key, weight).alias("value"))
    path = shared_path(spark, "clock")
    rows.unionByName(spark.sql("SELECT explode(array('# a clock', 'CpGmarker,Note,CoefficientTraining', '(Intercept),x,0.5')) AS value")).write.text(path)
    return readers.scan_clock_coefficients(spark, path)

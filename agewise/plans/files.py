"""Registered queries of lists, manifests, sinks, text trees and the steps of a clock, beside their SQL.

Tables that the operators take from files are written from the given tables into the shared folder first and read back by the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agewise.functions import annotate as an
from agewise.functions import stats
from agewise.functions.lineage import shared_path
from agewise.operators import clock, texts
from agewise.plans.bindings import query, r6, t
from agewise.sources import readers, sinks


def _key() -> Column:
    return F.col("p_partkey")


def _size() -> Column:
    return F.col("p_size")


def _csv(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = shared_path(spark, name) + ".csv"
    sinks.sink_csv(df, path)
    return readers.scan_table(spark, path)


# ---- gene and probe lists --------------------------------------------------------------------------------------------


@query("""
SELECT 'cg' || p_partkey AS cpg, s AS sample_id, CASE s WHEN 'S1' THEN p_size / 100.0::DOUBLE WHEN 'S3' THEN p_size / 64.0::DOUBLE ELSE CASE WHEN p_partkey % 5 <> 0 THEN p_size / 50.0::DOUBLE END END AS beta
FROM part, (SELECT unnest(['S1', 'S2', 'S3']) AS s) WHERE p_partkey % 2 = 0 AND (s <> 'S3' OR p_partkey % 3 <> 0)
""")
def scan_split_beta_matrix(spark: SparkSession, d: str) -> DataFrame:
    """``part`` as two wide matrices, the second without a third of the probes; every second probe is kept."""
    p, name = t(spark, d, "part"), F.format_string("cg%d", _key())
    path = shared_path(spark, "betas")
    second = F.when(_key() % 5 != 0, (_size() / 50).cast("string")).otherwise("n/a")
    sinks.sink_csv(p.select(name.alias("ID_REF"), (_size() / 100).alias("S1"), second.alias("S2")), f"{path}/a.csv")
    sinks.sink_csv(p.where(_key() % 3 != 0).select(name.alias("id_ref"), (_size() / 64).alias("S3")), f"{path}/b.csv")
    return readers.scan_split_beta_matrix(spark, [f"{path}/a.csv", f"{path}/b.csv"], p.where(_key() % 2 == 0).select(name.alias("cpg")))


@query("SELECT 'G' || (p_partkey % 97) AS gene FROM part WHERE p_partkey % 10 <> 0 UNION SELECT 'H' || (p_partkey % 89) FROM part WHERE p_partkey % 10 <> 0")
def scan_platform_genes(spark: SparkSession, d: str) -> DataFrame:
    cell = F.when(_key() % 10 != 0, F.format_string("g%d /// H%d, NA", _key() % 97, _key() % 89)).otherwise("")
    return readers.scan_platform_genes(_csv(spark, t(spark, d, "part").select(_key(), cell.alias("Gene Symbol")), "platform"))


@query("SELECT 'G' || (o_custkey % 211) AS gene, bool_or(o_orderstatus = 'F') AS significant FROM orders WHERE o_custkey % 211 <> 0 GROUP BY 1")
def scan_longevity_genes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_custkey") % 211
    told = F.when(F.col("o_orderstatus") == "F", "Significant").otherwise("non-significant")
    rows = t(spark, d, "orders").select(told.alias("Association"), F.when(n != 0, F.format_string("g%d/other", n)).otherwise("NA").alias("Gene(s)"))
    return readers.scan_longevity_genes(_csv(spark, rows, "longevity"))


@query("SELECT DISTINCT 'up' AS cluster, upper(n_name) AS gene FROM customer JOIN nation ON c_custkey % 300 = n_nationkey UNION SELECT 'down', 'G' || s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0")
def scan_cluster_sets(spark: SparkSession, d: str) -> DataFrame:
    """One sheet by ids, most of which have no symbol, and one by symbols; both through Parquet."""
    path = shared_path(spark, "clusters")
    up = t(spark, d, "customer").select((F.col("c_custkey") % 300).cast("double").alias("ENTREZ"))
    down = t(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 4 != 0, F.format_string(" g%d", F.col("s_nationkey"))).otherwise("NA").alias("Gene symbol"))
    sinks.sink_parquet({"up": up, "down": down}, path)
    symbols = t(spark, d, "nation").select(F.col("n_nationkey").alias("entrez"), F.lower("n_name").alias("symbol"))
    return readers.scan_cluster_sets({k: readers.scan_table(spark, f"{path}/{k}") for k in ("up", "down")}, symbols)


@query("SELECT 'cg' || (p_partkey % 500) AS probe, min('G' || (p_partkey % 31)) AS gene FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1")
def scan_probe_gene_map(spark: SparkSession, d: str) -> DataFrame:
    """A table whose genes are all blank, then one that has some."""
    p, probe = t(spark, d, "part"), F.format_string("cg%d", _key() % 500)
    blank = _csv(spark, p.select(probe.alias("ID"), F.lit(".").alias("gene")), "probes")
    full = p.select(probe.alias("IlmnID"), F.when(_key() % 7 != 0, F.format_string("G%d;H", _key() % 31)).otherwise("nan").alias("UCSC_RefGene_Name"))
    return readers.scan_probe_gene_map([blank, _csv(spark, full, "probes")])


@query("""
SELECT p_brand AS gene, 'rs' || p_partkey AS rsid, CASE p_partkey % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'MT' ELSE (p_partkey % 22 + 1)::VARCHAR END AS chrom, p_partkey * 10 AS pos
FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0
""")
def load_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Some rows lack an id, and some a whole position."""
    chrom = F.when(_key() % 4 == 0, "chrX").when(_key() % 4 == 1, "M").otherwise((_key() % 22 + 1).cast("double").cast("string"))
    pos = F.when(_key() % 13 == 0, "unknown").otherwise(F.format_string("%d.0", _key() * 10))
    name = F.when(_key() % 11 != 0, F.format_string("rs%d", _key()))
    rows = t(spark, d, "part").select(F.col("p_brand").alias("Gene"), name.alias("SNP_rsID"), chrom.alias("Chromosome"), pos.alias("Position_GRCh38"))
    return readers.load_manifest(_csv(spark, rows, "manifest"))


@query("""
SELECT p_partkey::VARCHAR AS key, CASE p_partkey % 3 WHEN 0 THEN 'HLA-DQB1' WHEN 1 THEN 'CETP' ELSE 'G' || (p_partkey % 50) END AS "Gene_Symbol",
  CASE p_partkey % 3 WHEN 0 THEN 'dqb1*03' WHEN 1 THEN 'Cetp locus' ELSE 'G' || (p_partkey % 50) END AS "Gene_Symbol_Raw", p_partkey % 3 <> 2 AS "Mapped_From_Legacy",
  CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS "Variant_Count", p_brand AS "Functional_Cluster" FROM part
""")
def load_candidate_table(spark: SparkSession, d: str) -> DataFrame:
    symbol = F.when(_key() % 3 == 0, "dqb1*03").when(_key() % 3 == 1, "Cetp locus").otherwise(F.format_string("G%d", _key() % 50))
    count = F.when(_key() % 5 != 0, _size().cast("string")).otherwise("some")
    rows = t(spark, d, "part").select(_key().alias("key"), symbol.alias("Gene Symbol"), count.alias("n_variants"), F.concat(F.lit(" "), "p_brand").alias("Pathway"))
    return readers.load_candidate_table(_csv(spark, rows, "candidates"))


@query("SELECT 'X' || c_custkey AS label, 'GSM' || c_custkey AS gsm FROM customer WHERE c_custkey % 4 <> 0")
def geo_sample_labels(spark: SparkSession, d: str) -> DataFrame:
    """A thousand customers a file as its samples, a quarter of them without a number in their title."""
    key = F.col("c_custkey")
    title = F.when(key % 4 != 0, F.format_string("blood, sample X%d", key)).otherwise("pool")
    each = t(spark, d, "customer").select(F.floor(key / 1000).alias("series"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), key.alias("k"), F.concat(F.lit('"'), v, F.lit('"')).alias("v")) for f, v in (("!Sample_title", title), ("!Sample_geo_accession", F.format_string("GSM%d", key)))])).alias("c"))
    line = F.concat_ws("\t", F.col("f"), F.transform(F.sort_array(F.collect_list(F.struct("c.k", "c.v"))), lambda x: x["v"]))
    path = shared_path(spark, "series")
    each.groupBy("series", F.col("c.f").alias("f")).agg(line.alias("value")).select("series", "value").repartition("series").write.partitionBy("series").text(path)
    return readers.geo_sample_labels(readers.scan_geo_sample_rows(spark, path + "/*")).select("label", "gsm")


# ---- texts and records -----------------------------------------------------------------------------------------------


@query("SELECT c_nationkey::VARCHAR AS n, string_agg(c_name || ' is ' || c_custkey, ' ' ORDER BY c_custkey) AS text FROM customer GROUP BY 1")
def scan_text_documents(spark: SparkSession, d: str) -> DataFrame:
    """A text file of each nation's customers, a line for each."""
    line = F.concat(F.lit("  "), "c_name", F.lit("\tis  "), F.col("c_custkey").cast("string"))
    rows = t(spark, d, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey", line.alias("value")).repartition("n").sortWithinPartitions("n", "c_custkey")
    path = shared_path(spark, "texts")
    rows.select("n", "value").write.partitionBy("n").text(path)
    return readers.scan_text_documents(spark, path).select(F.regexp_extract("path", "/n=([0-9]+)/", 1).alias("n"), "text")


@query("""
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_custkey::VARCHAR ELSE 'SRX' || c_custkey END AS accession FROM customer)
SELECT k::VARCHAR AS uid, accession, 'Run of ' || k AS title, CASE k % 3 WHEN 0 THEN 'Oxford Nanopore' WHEN 1 THEN 'Illumina' ELSE 'Custom <1>' END AS platform,
  CASE WHEN k % 2 = 0 THEN 'abstract ' || k ELSE 'Run of ' || k END AS description, CASE k % 5 WHEN 0 THEN '7' WHEN 1 THEN '2' ELSE '1' END AS n_samples,
  'https://www.ncbi.nlm.nih.gov/sra/' || CASE WHEN k % 4 = 0 THEN '?term=' || k ELSE accession END AS link FROM c
""")
def parse_sra_docsum(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")

    def item(name: str, value: Column, kind: str = "String") -> Column:
        return F.concat(F.lit(f'<Item Name="{name}" Type="{kind}">'), value, F.lit("</Item>"))

    none = F.lit("")
    runs = F.when(key % 5 == 0, item("RunCount", F.lit(" 7 "))).when(key % 5 == 1, item("Runs", F.concat(item("Run", F.lit("a")), item("Run", F.lit("b"))), "List")).otherwise(none)
    named = F.when(key % 3 == 0, "MinION Mk1B").when(key % 3 == 1, "Illumina NovaSeq").otherwise(" Custom &lt;1&gt; ")
    parts = [
        F.format_string("<DocSum><Id>%d</Id>", key), item("Title", F.format_string("Run of %d", key)), item("Accession", F.when(key % 4 == 0, key.cast("string")).otherwise(F.format_string("SRX%d", key))),
        item("Platform", named), F.when(key % 2 == 0, item("Abstract", F.format_string("abstract %d", key))).otherwise(none), runs, F.lit("</DocSum>"),
    ]
    return readers.parse_sra_docsum(t(spark, d, "customer").select(F.concat(*parts).alias("xml")))


_OLD = "(SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN [{'found': 'cholesteryl ester transfer protein', 'symbol': 'CETP', 'n': 1}, {'found': 'hsp70-1a', 'symbol': 'HSPA1A', 'n': 2}] WHEN 1 THEN [{'found': 'HLA-DQB1*05', 'symbol': 'HLA-DQB1', 'n': 1}] ELSE [] END) AS r FROM part)"


@query(f"SELECT p_partkey, r.found AS found, r.symbol AS symbol, r.n::BIGINT AS n FROM {_OLD}")
def scan_legacy_terms(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(_key() % 3 == 0, " by the cholesteryl ester\n  transfer protein; hsp70-1a, hsp70-1a").when(_key() % 3 == 1, ", HLA-DQB1*05 and CETP").otherwise(" HLA-DQB1")
    return texts.scan_legacy_terms(t(spark, d, "part").select(_key(), F.concat("p_name", said).alias("text")), "p_partkey", "text")


_LISTED = "(SELECT '/data/' || page_id || CASE page_id % 5 WHEN 0 THEN '.CSV' WHEN 1 THEN '.ped' WHEN 2 THEN '.bam.md' WHEN 3 THEN '.pod5' ELSE '.csv.txt' END AS path, strlen(html) * 1000 AS bytes, page_id FROM pages)"


@query(f"SELECT path, bytes, CASE WHEN page_id % 5 IN (0, 3) THEN 'restricted type' ELSE 'large table' END AS reason FROM {_LISTED} WHERE page_id % 5 IN (0, 3) OR page_id % 5 = 1 AND bytes >= 1048576")
def scan_restricted_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a listing of files of these names and sizes."""
    k = F.col("page_id") % 5
    ends = F.when(k == 0, ".CSV").when(k == 1, ".ped").when(k == 2, ".bam.md").when(k == 3, ".pod5").otherwise(".csv.txt")
    return texts.scan_restricted_files(t(spark, d, "pages").select(F.concat(F.lit("/data/"), F.col("page_id").cast("string"), ends).alias("path"), (F.octet_length("html") * F.lit(1000).cast("long")).alias("bytes")))


@query("""
SELECT p_partkey, round(CASE WHEN p_partkey % 3 <> 0 THEN p_size / 100.0 WHEN p_partkey % 2 = 0 THEN p_size / 250.0 END, 6) AS af_gnomad_nfe, '1-' || p_partkey || '-A-G' AS variant_id,
  CASE WHEN p_partkey % 2 = 0 THEN 'rsid' ELSE 'variant_id' END AS lookup_method, '2024-01-02' AS fetched_at FROM part
""")
def cache_entry_row(spark: SparkSession, d: str) -> DataFrame:
    def block(total: Column) -> Column:
        return F.struct(F.array(F.struct(F.lit("nfe").alias("id"), _size().cast("long").alias("ac"), total.cast("long").alias("an"))).alias("populations"))

    none = F.lit(None).cast("struct<populations:array<struct<id:string,ac:bigint,an:bigint>>>")
    record = F.struct(F.format_string("1-%d-A-G", _key()).alias("variant_id"), block(F.when(_key() % 3 != 0, 100).otherwise(0)).alias("joint"), none.alias("exome"), block(F.when(_key() % 2 == 0, 250)).alias("genome"))
    entry = an.cache_entry_row(F.col("r"), F.when(_key() % 2 == 0, "rsid").otherwise("variant_id"), F.lit("2024-01-02"))
    return t(spark, d, "part").select(_key(), record.cast(an.FREQUENCIES).alias("r")).select(_key(), entry.alias("e")).select("p_partkey", r6("e.af_gnomad_nfe").alias("af_gnomad_nfe"), "e.variant_id", "e.lookup_method", "e.fetched_at")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR WHEN p_partkey % 3 = 0 THEN p_brand END AS cadd FROM part")
def extract_cadd(spark: SparkSession, d: str) -> DataFrame:
    transcript = F.struct(F.when(_size() % 2 == 0, _size().cast("string")).alias("cadd_phred"))
    record = F.struct(F.when(_key() % 3 == 0, F.col("p_brand")).alias("cadd_phred"))
    return t(spark, d, "part").select(_key(), transcript.alias("t"), record.alias("r")).select("p_partkey", an.extract_cadd(F.col("t"), F.col("r")).alias("cadd"))


# ---- sinks -----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS sample_id, l_linenumber AS line, l_partkey AS cpg, l_discount AS beta, (l_suppkey % 22 + 1)::INTEGER AS chrom FROM lineitem")
def save_long_matrix(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "long")
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("cpg"), F.col("l_discount").alias("beta"), (F.col("l_suppkey") % 22 + 1).cast("int").alias("chrom"))
    sinks.save_long_matrix(rows, path, ["chrom"])
    return spark.read.parquet(path)


@query("SELECT o_orderpriority AS priority, count(*) AS n, max(o_totalprice) AS most, max(CASE WHEN o_custkey % 50 = 0 AND o_orderstatus = 'P' THEN o_orderkey END) AS some FROM orders GROUP BY 1")
def sink_json_metrics(spark: SparkSession, d: str) -> DataFrame:
    some = F.max(F.when((F.col("o_custkey") % 50 == 0) & (F.col("o_orderstatus") == "P"), F.col("o_orderkey"))).alias("some")
    rows = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"), some)
    path = shared_path(spark, "metrics")
    sinks.sink_json_metrics(rows, path)
    return spark.read.schema("priority string, n long, most double, some long").json(path)


@query("SELECT 'first' AS run, c_custkey AS key, c_mktsegment AS note FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'second', c_custkey, NULL FROM customer WHERE c_acctbal > 5000")
def sink_audit_table(spark: SparkSession, d: str) -> DataFrame:
    c, path = t(spark, d, "customer"), shared_path(spark, "audit")
    for run, rows, note in (("first", c.where("c_acctbal < 0"), F.col("c_mktsegment")), ("second", c.where("c_acctbal > 5000"), F.lit(None).cast("string"))):
        sinks.sink_audit_table(rows.select(F.col("c_custkey").alias("key"), note.alias("note")), path, run)
    return spark.read.schema("run string, key long, note string").json(path)


# ---- steps of a clock ------------------------------------------------------------------------------------------------

_LINES = "(SELECT l_orderkey, l_linenumber, 'f' || (l_suppkey % 7) AS cpg, CASE WHEN l_quantity <= 40 THEN l_quantity END AS x, l_returnflag <> 'N' AS train FROM lineitem)"
_STATS = f"(SELECT cpg, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM {_LINES} WHERE train GROUP BY 1)"


def _values(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(long matrix of lines with missing values, statistics of its training rows)."""
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("f%d", F.col("l_suppkey") % 7).alias("cpg"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("beta"), F.col("l_returnflag").alias("flag"))
    return rows.drop("flag"), clock.feature_statistics(rows.where("flag <> 'N'"))


@query(f"SELECT l_orderkey, l_linenumber, cpg, round(coalesce(x, m, 0.5), 6) AS beta FROM {_LINES} LEFT JOIN {_STATS} USING (cpg)")
def impute_mean(spark: SparkSession, d: str) -> DataFrame:
    return clock.impute_mean(*_values(spark, d)).withColumn("beta", F.round("beta", 6))


@query(f"SELECT l_orderkey, l_linenumber, cpg, round(coalesce((x - m) / s, 0), 6) AS beta FROM {_LINES} JOIN {_STATS} USING (cpg)")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    return clock.standard_scale(*_values(spark, d)).withColumn("beta", F.round("beta", 6))


@query("SELECT c_custkey AS sample_id, unnest(['cg1', 'cg2']) AS cpg, unnest([c_acctbal, c_nationkey::DOUBLE]) AS beta, (c_custkey % 90)::DOUBLE AS age FROM customer")
def split_features_target(spark: SparkSession, d: str) -> DataFrame:
    wide = t(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("cg1"), F.col("c_nationkey").alias("cg2"), F.lit(1).alias("other"), (F.col("c_custkey") % 90).alias("years"))
    matrix, samples = clock.split_features_target(wide, "years")
    return matrix.join(samples, "sample_id")


@query("SELECT count(*) AS n, 0::BIGINT AS in_both, true AS share_fits FROM orders")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    """Each row is on one side, a fifth of them, but for chance, on the test side."""
    train, test = clock.train_test_split(t(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id")))
    sides = train.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(test.withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    each = sides.groupBy("sample_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return each.agg(F.sum(F.col("a") + F.col("b")).alias("n"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("in_both"), (F.avg((F.col("b") > 0).cast("double")).between(0.16, 0.24)).alias("share_fits"))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.format_string("cg%d", _key()).alias("cpg"), ((_size() - 25) / 8).alias("coef"))


@query("SELECT 'cg' || p_partkey AS cpg, (p_size - 25) / 8.0::DOUBLE AS coef FROM part WHERE p_size <> 25")
def selected_features(spark: SparkSession, d: str) -> DataFrame:
    return clock.selected_features(_weights(spark, d))


@query("""
SELECT 'cg' || p_partkey AS cpg, (p_size - 25) / 8.0::DOUBLE AS coef, CASE WHEN p_size > 25 THEN 'older' WHEN p_size < 25 THEN 'younger' ELSE 'none' END AS direction,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' (cg' || p_partkey || ')' ELSE 'cg' || p_partkey END AS label FROM part UNION ALL SELECT '(Intercept)', 0.5, 'older', '(Intercept)'
""")
def extract_coefficients(spark: SparkSession, d: str) -> DataFrame:
    genes = t(spark, d, "part").where(_key() % 2 == 0).select(F.format_string("cg%d", _key()).alias("probe"), F.col("p_brand").alias("gene"))
    return clock.extract_coefficients(_weights(spark, d), 0.5, genes)


_AGED = "(SELECT c_custkey AS sample_id, (c_custkey % 90)::DOUBLE AS age, 3 + 0.004 * c_acctbal + 0.5 * CASE WHEN c_custkey % 4 = 0 THEN 12 ELSE c_nationkey END AS predicted_age FROM customer WHERE c_custkey % 11 <> 0)"


def _clock(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, float, DataFrame]:
    """(matrix, coefficients, intercept, ages): customers as samples of two features; some ages are no numbers, some values are missing."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("cg1"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey").cast("double")).alias("cg2"))
    matrix = c.unpivot("sample_id", ["cg1", "cg2"], "cpg", "beta")
    coefs = spark.createDataFrame([("cg1", 0.004, 100.0), ("cg2", 0.5, 12.0), ("cg3", 0.0, 1.0)], "cpg string, coef double, fill double")
    ages = c.select("sample_id", F.when(F.col("sample_id") % 11 != 0, (F.col("sample_id") % 90).cast("string")).otherwise("unknown").alias("age"))
    return matrix, coefs, 3.0, ages


@query(f"SELECT sample_id, age, round(predicted_age, 6) AS predicted_age FROM {_AGED}")
def per_sample_predictions(spark: SparkSession, d: str) -> DataFrame:
    matrix, coefs, intercept, ages = _clock(spark, d)
    found = clock.per_sample_predictions(matrix, coefs, intercept, clock.filter_valid_age(ages, "age"))
    return found.select("sample_id", "age", F.round("predicted_age", 6).alias("predicted_age"))


@query(f"""
WITH e AS (SELECT *, abs(predicted_age - age) AS e FROM {_AGED}), s AS (SELECT unnest(['<30', '30-60', '>60']) AS part)
SELECT 'all' AS part, round(avg(e), 6) AS mae, count(*) AS n FROM e
UNION ALL SELECT part, round(avg(e), 6), count(e) FROM s LEFT JOIN e ON part = CASE WHEN age < 30 THEN '<30' WHEN age <= 60 THEN '30-60' ELSE '>60' END GROUP BY 1
""")
def evaluate_clock(spark: SparkSession, d: str) -> DataFrame:
    found = clock.evaluate_clock(*_clock(spark, d))
    rows = found["metrics"].select(F.lit("all").alias("part"), "mae", "n").unionByName(found["by_stratum"].select(F.col("stratum").alias("part"), "mae", "n"))
    return rows.select("part", F.round("mae", 6).alias("mae"), "n")


@query(f"SELECT c_nationkey % 5 AS fold, round(avg(abs(predicted_age - age)), 6) AS mae, CASE WHEN avg(abs(predicted_age - age)) < 27.5 THEN 'PASS' ELSE 'FAIL' END AS gate FROM {_AGED} JOIN customer ON sample_id = c_custkey GROUP BY 1")
def clock_precision_gate(spark: SparkSession, d: str) -> DataFrame:
    matrix, coefs, intercept, ages = _clock(spark, d)
    rows = clock.per_sample_predictions(matrix, coefs, intercept, clock.filter_valid_age(ages, "age"))
    folds = t(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), (F.col("c_nationkey") % 5).alias("fold"))
    mae = rows.join(folds, "sample_id").groupBy("fold").agg(F.avg(F.abs(F.col("predicted_age") - F.col("age"))).alias("mae"))
    return clock.clock_precision_gate(mae, 27.5).select("fold", F.round("mae", 6).alias("mae"), "gate")


# ---- p values --------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT l_partkey, sum(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS a, sum(l_linenumber) FILTER (WHERE l_returnflag = 'N') AS c,
  sum((l_quantity + 7)::BIGINT) FILTER (WHERE l_returnflag = 'R') AS m, sum((l_quantity + 7)::BIGINT) FILTER (WHERE l_returnflag = 'N') AS n FROM lineitem GROUP BY 1),
u AS (SELECT l_partkey, a, c, m, n, a + c AS k, unnest(range(greatest(0, a + c - n)::BIGINT, least(m, a + c)::BIGINT + 1)) AS i FROM s WHERE m IS NOT NULL AND n IS NOT NULL),
w AS (SELECT l_partkey, i = a AS own, lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n + 1) - lgamma(k - i + 1) - lgamma(n - k + i + 1) - lgamma(m + n + 1) + lgamma(k + 1) + lgamma(m + n - k + 1) AS g FROM u),
o AS (SELECT l_partkey, max(g) AS g0 FROM w WHERE own GROUP BY 1)
SELECT l_partkey, round(least(1.0, sum(exp(g)) FILTER (WHERE g <= g0 + 1e-7)), 5) AS p_value FROM w JOIN o USING (l_partkey) GROUP BY 1
""")
def pairwise_diff_p(spark: SparkSession, d: str) -> DataFrame:
    """The exact two-sided p of each site, as sums of masses from log factorials."""
    li = t(spark, d, "lineitem").withColumn("c", (F.col("l_quantity") + 7).cast("long"))
    return stats.pairwise_diff_test(li, ["l_partkey"], "l_returnflag", "l_linenumber", "c", ("R", "N")).select("l_partkey", F.round("p_value", 5).alias("p_value"))


@query("""
WITH s AS (SELECT corr(l_quantity, l_discount) AS r, count(*) AS n FROM lineitem), q AS (SELECT r, n, n - 2 AS v, atan(abs(r) / sqrt(1 - r * r)) AS top FROM s),
i AS (SELECT r, n, v, top / 3 / 4000 * sum(pow(cos(top * k / 4000), v - 1) * CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) AS area FROM q, range(4001) g(k) GROUP BY r, n, v, top)
SELECT round(r, 6) AS r, n, round(1 - 2 * area * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(pi()), 4) AS p FROM i
""")
def pearson_p(spark: SparkSession, d: str) -> DataFrame:
    """Two columns that don't go together; the SQL integrates the density of t by Simpson's rule."""
    return stats.pearson_test(t(spark, d, "lineitem"), "l_quantity", "l_discount").select(r6("r"), F.round("p", 4).alias("p"), "n")

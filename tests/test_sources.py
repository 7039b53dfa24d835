import json

import pytest
from pyspark.sql import functions as F

from agewise.sources import readers, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3\tS4\tS5\n"


def test_tables_and_aliases(spark, tmp_path):
    path = put(tmp_path / "a.csv", "snp,gene\nrs1,APOE\n")
    assert rows(readers.scan_table(spark, path, {"snp": "rsid", "gene": "gene_symbol", "other": "rsid"})) == [("rs1", "APOE")]
    path = put(tmp_path / "b.tsv", "k\tv\n1\tx\n")
    assert readers.scan_table(spark, path, schema="k long, v string").schema.simpleString() == "struct<k:bigint,v:string>"
    path = put(tmp_path / "c.csv", "# synthetic, not for release\neid,age\n1001,50\n")
    assert rows(readers.scan_commented_csv(spark, path)) == [("1001", "50")]
    assert readers.scan_table(spark, put(tmp_path / "d.csv", "a,b\n")).count() == 0


def test_vcf(spark, tmp_path):
    calls = "1\t100\trsTEST\tA\tG\t.\t.\t.\tGT:DP\t0/0:9\t0|1:9\t1/1:9\t./.:0\t./1\n1\t200\t.\tC\tT,G\t.\t.\t.\tGT\t1/2\t2/0\t0\t1\t.\n"
    path = put(tmp_path / "x.vcf", VCF + calls)
    got = {(r["eid"], r["rsid"]): r["alt_dosage"] for r in readers.scan_vcf_genotypes(spark, path).collect()}
    assert [got[f"S{k}", "rsTEST"] for k in range(1, 6)] == [0, 1, 2, None, None]
    assert [got[f"S{k}", "1:200"] for k in range(1, 6)] == [2, 1, 0, 2, None]
    assert readers.scan_vcf_genotypes(spark, put(tmp_path / "empty.vcf", VCF)).count() == 0


def test_vcf_by_chromosome(spark, tmp_path):
    line = "%s\t%d\trs%d\tA\tG\t.\t.\t.\tGT\t0/1\t0/0\t0/0\t0/0\t0/0\n"
    put(tmp_path / "v/set_chr7.vcf", VCF + line % ("chr7", 1, 1) + line % ("8", 2, 2))
    put(tmp_path / "v/set.chrX.vcf", VCF + line % ("X", 3, 3))
    put(tmp_path / "v/rest.vcf", VCF + line % ("7", 4, 4) + line % ("9", 5, 5))
    found = readers.scan_vcf_by_chromosome(spark, str(tmp_path / "v/*.vcf"))
    assert rows(found.select("chrom", "rsid").distinct()) == [("7", "rs1"), ("9", "rs5"), ("X", "rs3")]
    only = readers.scan_vcf_by_chromosome(spark, str(tmp_path / "v/*.vcf"), ["9"])
    assert rows(only.where("alt_dosage = 1"), "eid", "chrom", "pos") == [("S1", "9", 5)]


def test_geo_series_matrix(spark, tmp_path):
    text = (
        '!Series_title\t"x"\n!Sample_title\t"sample X101"\t"sample X102"\t"other"\n!Sample_geo_accession\t"GSM1"\t"GSM2"\t"GSM3"\n'
        '!Sample_characteristics_ch1\t"gender: M"\t"gender: F"\t"age: 7"\n!Sample_characteristics_ch1\t"age: 45"\t"age (y)=50.5"\t"tissue: x"\n'
        '!series_matrix_table_begin\n"ID_REF"\t"GSM1"\t"GSM2"\t"GSM3"\n"cg1"\t0.5\tNA\t0.25\n"cg2"\t0.1\t0.2\t\n!series_matrix_table_end\n'
    )
    path = put(tmp_path / "m.txt", text)
    head = readers.scan_geo_sample_rows(spark, path)
    assert rows(readers.geo_sample_labels(head), "label", "gsm") == [("X101", "GSM1"), ("X102", "GSM2")]
    assert rows(readers.geo_sample_ages(head), "gsm", "age") == [("GSM1", 45.0), ("GSM2", 50.5), ("GSM3", 7.0)]
    assert rows(readers.scan_geo_series_matrix(spark, path), "probe", "sample_no", "beta") == [
        ("cg1", 0, 0.5), ("cg1", 1, None), ("cg1", 2, 0.25), ("cg2", 0, 0.1), ("cg2", 1, 0.2), ("cg2", 2, None),
    ]
    halves = [put(tmp_path / "h1.csv", "ID_REF,A\ncg1,0.5\ncg2,x\n"), put(tmp_path / "h2.csv", "ID_REF,B\ncg1,0.25\n")]
    keep = spark.createDataFrame([("cg1",)], "cpg string")
    assert rows(readers.scan_split_beta_matrix(spark, halves, keep)) == [("cg1", "A", 0.5), ("cg1", "B", 0.25)]
    assert readers.scan_split_beta_matrix(spark, halves).count() == 3


def test_gene_lists(spark, tmp_path):
    gtf = 'chr1\tx\tgene\t1\t2\t.\t+\t.\tgene_id "1"; gene_type "protein_coding"; gene_name "Foxo3";\nchr1\tx\tgene\t1\t2\t.\t+\t.\tgene_type "lncRNA"; gene_name "Z";\nchr1\tx\texon\t1\t2\t.\t+\t.\tgene_type "protein_coding"; gene_name "E";\n'
    assert rows(readers.scan_gtf_protein_coding(spark, put(tmp_path / "a.gtf", "##x\n" + gtf))) == [("FOXO3",)]
    platform = spark.createDataFrame([("A /// b",), ("C,na",), (None,)], "`Gene Symbol` string")
    assert rows(readers.scan_platform_genes(platform)) == [("A",), ("B",), ("C",)]
    flat = spark.createDataFrame([("Significant", "apoe/tomm40"), ("non", "APOE"), ("non", "X"), ("significant", "")], "Association string, `Gene(s)` string")
    assert rows(readers.scan_longevity_genes(flat)) == [("APOE", True), ("X", False)]
    variants, genes = spark.createDataFrame([(1, "significant"), (2, None)], "gene_id int, association string"), spark.createDataFrame([(1, "a"), (2, "b")], "id int, symbol string")
    assert rows(readers.scan_longevity_genes(variants, genes)) == [("A", True), ("B", False)]
    sheets = {"up": spark.createDataFrame([(1.0,), (9.0,)], "ENTREZ double"), "down": spark.createDataFrame([("c",), ("NA",)], "`Gene symbol` string")}
    symbols = spark.createDataFrame([("1", "a")], "entrez string, symbol string")
    assert rows(readers.scan_cluster_sets(sheets, symbols)) == [("down", "C"), ("up", "A")]


def test_vep_jsonl(spark, tmp_path):
    lines = [
        {"rsid": "rs1", "variant_key": "1:1:A:G", "payload": [{"id": "rs1", "most_severe_consequence": "old"}]}, {"rsid": "rs1", "vep": {"most_severe_consequence": "new", "transcript_consequences": [{"impact": "HIGH", "sift_score": 0.5}]}},
        {"id": "rs3", "most_severe_consequence": "bare"},
    ]
    got = {r["key"]: r["variant"] for r in readers.scan_local_vep_jsonl(spark, put(tmp_path / "v.jsonl", "\n".join(map(json.dumps, lines)) + "\n\n")).collect()}
    assert {k: v["most_severe_consequence"] for k, v in got.items()} == {"rs1": "new", "1:1:A:G": "old", "rs3": "bare"}
    assert got["rs1"]["transcript_consequences"][0]["sift_score"] == 0.5


def test_coefficients_probes_and_ids(spark, tmp_path):
    text = "# from a paper\n\nCpGmarker,CoefficientTraining,x\n(Intercept),0.7,\ncg1,-1.5,\n\"cg2\",2,\ncg3,n/a,\n"
    assert rows(readers.scan_clock_coefficients(spark, put(tmp_path / "c.csv", text))) == sorted([(None, 0.7), ("cg1", -1.5), ("cg2", 2.0)], key=str)
    assert rows(readers.scan_clock_coefficients(spark, put(tmp_path / "d.csv", "probe,coef\ncg1,1\n"))) == [("cg1", 1.0)]
    empty = spark.createDataFrame([("cg1", ".")], "IlmnID string, UCSC_RefGene_Name string")
    full = spark.createDataFrame([("cg1", "TP53;MDM2"), ("cg2", None), ("cg3", "nan")], "IlmnID string, UCSC_RefGene_Name string")
    assert rows(readers.scan_probe_gene_map([empty, full])) == [("cg1", "TP53")]
    with pytest.raises(ValueError):
        readers.scan_probe_gene_map([empty])
    assert rows(readers.scan_id_list(spark, put(tmp_path / "i.txt", "cpg\n# x\n cg1 \ncg1\n\ncg2,more\n"))) == [("cg1",), ("cg2",)]


def test_manifest_and_candidates(spark):
    m = spark.createDataFrame([("G", "rs2", "chrX", "5"), ("G", "rs1", "2", "7.0"), ("G", "rs3", "10", "1"), ("G", "", "1", "1"), ("G", "rs4", "1", None)], "Gene string, SNP_rsID string, Chromosome string, Position_GRCh38 string")
    assert [(r["rsid"], r["chrom"], r["pos"]) for r in readers.load_manifest(m).collect()] == [("rs1", "2", 7), ("rs3", "10", 1), ("rs2", "X", 5)]
    with pytest.raises(ValueError):
        readers.load_manifest(m.drop("Chromosome"))
    c = spark.createDataFrame([(" dqb1*03", "3", " immune "), ("APOE", "x", "lipid")], "`Gene Symbol` string, n_variants string, Pathway string")
    got = rows(readers.load_candidate_table(c), "Gene_Symbol", "Gene_Symbol_Raw", "Mapped_From_Legacy", "Variant_Count", "Functional_Cluster")
    assert got == [("APOE", "APOE", False, None, "lipid"), ("HLA-DQB1", "dqb1*03", True, 3.0, "immune")]


def test_bedmethyl_texts_and_docsums(spark, tmp_path):
    path = put(tmp_path / "b.bed", "chr1\t10\t11\tm\t9\t+\t20\t25.0\t5\t15\n")
    assert rows(readers.scan_bedmethyl(spark, path), "chrom", "coverage", "percent", "methylated") == [("chr1", 20, 25.0, 5)]
    put(tmp_path / "t/x/a.md", "one\n\n two")
    put(tmp_path / "t/b.csv", "no")
    assert [r["text"] for r in readers.scan_text_documents(spark, str(tmp_path / "t")).collect()] == ["one two"]
    xml = '<DocSum><Id>7</Id><Item Name="Title" Type="String">T</Item><Item Name="Accession" Type="String">SRX1</Item><Item Name="Platform" Type="String">MinION</Item><Item Name="Runs" Type="List"><Item Name="Run">a</Item><Item Name="Run">b</Item></Item></DocSum>'
    got = readers.parse_sra_docsum(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (got["uid"], got["platform"], got["description"], got["n_samples"]) == ("7", "Oxford Nanopore", "T", "2") and got["link"].endswith("/SRX1")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1), (None, 2)], "s string, n int")
    sinks.sink_parquet({"x": df}, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/x")).count() == 2
    sinks.sink_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.sink_json_metrics(df.where("n = 2"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"s":null,"n":2}'
    sinks.sink_commented_csv(df, str(tmp_path / "k"), "made up\nrows")
    got = [r[0] for r in spark.read.text(str(tmp_path / "k")).collect()]
    assert got[:2] == ["# made up rows", "s,n"] and sorted(got[2:]) == ['"",2', '"a,b",1']
    for run in ("one", "two"):
        sinks.sink_audit_table(df, str(tmp_path / "a"), run)
    assert spark.read.json(str(tmp_path / "a")).count() == 4
    sinks.save_long_matrix(df.withColumn("chrom", F.lit("7")), str(tmp_path / "m"), ["chrom"])
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_order_of_lines_over_splits(spark, tmp_path):
    lines = "".join(json.dumps({"rsid": "rs1", "n": k, "payload": json.dumps({"id": f"v{k}"})}) + "\n" for k in range(3000))
    path = put(tmp_path / "v.jsonl", lines)
    soft = put(tmp_path / "m.txt", "".join(f"!Sample_characteristics_ch1\t\"age: {k}\"\n" for k in range(2000)) + "!series_matrix_table_begin\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "4096")
        got = {r["key"]: r["variant"]["id"] for r in readers.scan_local_vep_jsonl(spark, path).collect()}
        rows_ = readers.scan_geo_sample_rows(spark, soft).orderBy("row").collect()
        assert spark.read.text(path).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set(key, before)
    assert got["rs1"] == "v2999" and [r["value"] for r in rows_] == [f"age: {k}" for k in range(2000)]

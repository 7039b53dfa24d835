"""Scans of the file formats of variant, methylation and gene-set work, as DataFrames.

Every scan is a Spark read of a path or glob; nothing is opened on the driver. Parsing is done by column expressions. Only
headers (one line a file) ever reach the driver, where a schema depends on them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agewise.functions import normalize as nz
from agewise.functions.annotate import VARIANT, filled
from agewise.sources.vcf import scan_vcf_blocks

BEDMETHYL = "chrom string, start long, end long, name string, score double, strand string, coverage long, percent double, methylated long, unmethylated long"


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def scan_table(spark: SparkSession, path: str, aliases: Mapping[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """Parquet, or text with a header by its suffix (.csv, .tsv, .txt, also compressed), its columns renamed by ``aliases``."""
    name = path.rstrip("/").lower().removesuffix(".gz").removesuffix(".bz2")
    if name.endswith((".csv", ".tsv", ".txt")):
        read = spark.read.option("header", True).option("sep", "," if name.endswith(".csv") else "\t")
        df = (read.schema(schema) if schema else read).csv(path)
    elif name.endswith((".json", ".jsonl")):
        df = (spark.read.schema(schema) if schema else spark.read).json(path)
    else:
        df = spark.read.parquet(path)
    return nz.rename_aliases(df, aliases or {})


def scan_commented_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, lines that begin with # left out."""
    read = spark.read.option("header", True).option("comment", "#")
    return (read.schema(schema) if schema else read).csv(path)


def _dosage(genotype: Column) -> Column:
    """0 without, 1 with one and 2 with only alternative alleles; null where an allele isn't called."""
    alleles = F.split(F.split(genotype, ":")[0], r"[/|]")
    called = F.size(F.filter(alleles, lambda a: (a == ".") | (a == ""))) == 0
    alts = F.size(F.filter(alleles, lambda a: a != "0"))
    return F.when(called, F.when(alts == 0, 0).when(alts == F.size(alleles), 2).otherwise(1))


def _ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): lines of text with what orders those of a file: where their split of it begins, then their order in the split,
    which one task reads from its beginning on."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), "value")


def _calls(lines: DataFrame, body: DataFrame, chrom: Column) -> DataFrame:
    """Samples' rows of the lines ``body`` (file, value, ...). A line meets the header of its own file whole, by a join that Spark picks by the
    headers' size; what is exploded is a sample's place and dosage only."""
    heads = lines.where(F.col("value").startswith("#CHROM")).select("file", F.split("value", "\t").alias("names"))
    cells = body.select("file", chrom.alias("chrom"), F.split("value", "\t").alias("f")).where(F.size("f") > 9)
    fixed = {name: F.get("f", F.lit(k)) for k, name in enumerate(("", "pos", "id", "ref", "alt")) if name}
    dosages = F.transform(F.slice("f", F.lit(10), F.size("f") - 9), _dosage)
    rows = cells.select("file", "chrom", *[c.alias(n) for n, c in fixed.items()], dosages.alias("d")).join(heads, "file")
    named = F.transform("d", lambda d, i: F.struct(F.get("names", i + 9).alias("eid"), d.alias("alt_dosage")))
    each = rows.select("chrom", *fixed, F.explode(named).alias("c"))
    rsid = F.when(F.col("id").isin(".", ""), F.concat("chrom", F.lit(":"), "pos")).otherwise(F.col("id"))
    return each.select("c.eid", rsid.alias("rsid"), "chrom", F.col("pos").cast("long").alias("pos"), "ref", "alt", "c.alt_dosage")


def _body(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))


def scan_vcf_genotypes(spark: SparkSession, path: str, chromosomes: Sequence[str] | None = None) -> DataFrame:
    """(eid, rsid, chrom, pos, ref, alt, alt_dosage): a row for each sample and variant of VCF text files.

    A missing id becomes chrom:pos. Calls are read from the first field of a sample: 0/0 is 0, 0/1 and 1/0 are 1, 1/1 and
    1/2 are 2, one with an uncalled allele (./1) is null. Files may have different samples: each line takes the header of its
    own file. ``chromosomes`` keeps lines of these labels only, told by their first field before a line is split. Compressed files (.gz, .bgz)
    are read by :func:`agewise.sources.vcf.scan_vcf_blocks`.
    """
    if path.lower().endswith((".gz", ".bgz")):
        return scan_vcf_blocks(spark, path, chromosomes)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    contig = F.substring_index("value", "\t", 1)
    body = _body(lines)
    if chromosomes is not None:
        body = body.where(nz.normalize_chrom_label(contig).isin(*chromosomes))
    return _calls(lines, body, contig)


def chromosome_of_file(path: Column) -> Column:
    """The chromosome that a file's name tells (chr7, chrX), null without one."""
    name = F.element_at(F.split(path, "/"), -1)
    return filled(F.upper(F.regexp_extract(name, r"(?i)(?:^|[^a-z0-9])chr(?:om)?_?(\d{1,2}|X|Y|MT?)(?:[^a-z0-9]|$)", 1)))


def scan_vcf_by_chromosome(spark: SparkSession, path: str, chromosomes: Sequence[str] | None = None) -> DataFrame:
    """As :func:`scan_vcf_genotypes`, of the files of a glob; lines of a file whose name tells another chromosome than theirs are
    left out. A file that tells none serves all chromosomes that no file tells. ``chromosomes`` keeps these only."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")).withColumn("own", chromosome_of_file(F.col("file")))
    own = files.agg(F.array_compact(F.collect_set("own")).alias("told"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    contig = nz.normalize_chrom_label(F.substring_index("value", "\t", 1))
    body = _body(lines).withColumn("contig", contig)
    if chromosomes is not None:
        body = body.where(F.col("contig").isin(*chromosomes))
    body = body.withColumn("own", nz.normalize_chrom_label(chromosome_of_file(F.col("file")))).crossJoin(F.broadcast(own))
    told = F.transform("told", nz.normalize_chrom_label)
    body = body.where(F.coalesce(F.col("own") == F.col("contig"), ~F.array_contains(told, F.col("contig"))))
    return _calls(lines, body, F.col("contig"))


def _soft_cells(line: Column) -> Column:
    return F.transform(F.split(line, "\t"), lambda c: F.btrim(F.trim(c), F.lit('"')))


def scan_geo_sample_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, field, row, sample_no, value) of the lines of a SOFT series matrix that describe samples; ``row`` tells lines of one
    field apart, in their order. Files are read by lines, in as many tasks as they have splits, and only these lines go on."""
    lines = _ordered_lines(spark, path).where(F.col("value").startswith("!Sample_"))
    row = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    cells = lines.select("file", row.alias("row"), _soft_cells(F.col("value")).alias("c"))
    return cells.select("file", F.col("c")[0].alias("field"), "row", F.posexplode(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0)))).alias("sample_no", "value"))


def scan_geo_series_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(file, probe, sample_no, beta) of the table of SOFT series matrices; values that are no numbers are null."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    body = lines.where(~F.col("value").startswith("!") & (F.trim("value") != "")).select("file", _soft_cells(F.col("value")).alias("c"))
    body = body.where(F.upper(F.col("c")[0]) != "ID_REF")
    each = body.select("file", F.col("c")[0].alias("probe"), F.posexplode(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0)))).alias("sample_no", "v"))
    return each.select("file", "probe", "sample_no", F.nanvl(F.col("v").try_cast("double"), F.lit(None)).alias("beta"))


def geo_sample_labels(rows: DataFrame) -> DataFrame:
    """(file, label, gsm): the X-label in each sample's title and its accession, from :func:`scan_geo_sample_rows`."""
    titles = rows.where(F.col("field") == "!Sample_title").select("file", "sample_no", F.regexp_extract("value", r"(?i)(?:^|\W)X?(\d+)", 1).alias("n"))
    gsms = rows.where(F.col("field") == "!Sample_geo_accession").select("file", "sample_no", F.col("value").alias("gsm"))
    return titles.where(F.col("n") != "").join(gsms, ["file", "sample_no"]).select("file", F.concat(F.lit("X"), "n").alias("label"), "gsm")


def geo_sample_ages(rows: DataFrame) -> DataFrame:
    """(file, gsm, age): the age in each sample's characteristics (age: 45, age (y)=45), of the last line that has one; null without."""
    found = F.regexp_extract("value", r"(?i)\bage\b[^:=]*[:=]\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    ages = rows.where(F.col("field") == "!Sample_characteristics_ch1").select("file", "sample_no", "row", found.alias("age"))
    last = ages.where(F.col("age").isNotNull()).groupBy("file", "sample_no").agg(F.max_by("age", "row").alias("age"))
    gsms = rows.where(F.col("field") == "!Sample_geo_accession").select("file", "sample_no", F.col("value").alias("gsm"))
    return gsms.join(last, ["file", "sample_no"], "left").select("file", "gsm", "age")


def scan_split_beta_matrix(spark: SparkSession, paths: Sequence[str], keep: DataFrame | None = None, id_col: str = "ID_REF") -> DataFrame:
    """(cpg, sample_id, beta) of wide matrices that hold different samples, in long form. ``keep`` (a column cpg) is met before a
    matrix is unpivoted. A probe that one file lacks has no row for that file's samples."""
    out = None
    for path in paths:
        wide = scan_table(spark, path)
        wide = wide.withColumnRenamed(next(c for c in wide.columns if c.upper() == id_col.upper()), "cpg")
        if keep is not None:
            wide = wide.join(keep.select("cpg").distinct(), "cpg", "left_semi")
        values = [c for c in wide.columns if c != "cpg"]
        long = wide.select("cpg", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in values]).unpivot("cpg", [f"`{c}`" for c in values], "sample_id", "beta")
        out = long if out is None else out.unionByName(long)
    return out


def scan_gtf_protein_coding(spark: SparkSession, path: str) -> DataFrame:
    """(gene): distinct upper-case names of the protein-coding genes of GTF text."""
    fields = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    coding = fields.where((F.get("f", F.lit(2)) == "gene") & F.get("f", F.lit(8)).rlike('gene_(?:bio)?type "protein_coding"'))
    return coding.select(F.upper(F.trim(F.regexp_extract(F.get("f", F.lit(8)), 'gene_name "([^"]+)"', 1))).alias("gene")).where(F.col("gene") != "").distinct()


def scan_platform_genes(platforms: DataFrame, column: str = "Gene Symbol") -> DataFrame:
    """(gene): distinct symbols of array platforms; a cell holds several, between /// or commas."""
    each = platforms.select(F.explode(F.split(F.col(f"`{column}`"), "///|,")).alias("g")).select(F.upper(F.trim("g")).alias("gene"))
    return each.where(~F.col("gene").isin("", "NA")).distinct()


def scan_longevity_genes(variants: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """(gene, significant): distinct genes of an association table, and whether an association of theirs is significant.

    With ``genes`` (id, symbol), variants (gene_id, association) are joined to them. Else variants are (Association, Gene(s)), of
    which only the first gene counts.
    """
    if genes is not None:
        rows = variants.join(genes.select(F.col("id").alias("gene_id"), "symbol"), "gene_id").select("association", F.upper(F.trim("symbol")).alias("gene"))
    else:
        rows = variants.select(F.col("Association").alias("association"), F.get(nz.gene_tokens(F.col("`Gene(s)`")), F.lit(0)).alias("gene"))
    found = rows.where(~F.col("gene").isin("", "NA"))
    return found.groupBy("gene").agg(F.coalesce(F.bool_or(F.lower(F.trim("association")) == "significant"), F.lit(False)).alias("significant"))


def scan_cluster_sets(sheets: Mapping[str, DataFrame], symbols: DataFrame) -> DataFrame:
    """(cluster, gene): distinct genes of labelled tables, that have a column ENTREZ, mapped by ``symbols`` (entrez, symbol), or a column
    named like symbol or gene. Ids without a symbol and NA are left out."""
    out = None
    for label, sheet in sheets.items():
        by_name = {c.lower(): c for c in sheet.columns}
        if "entrez" in by_name:
            rows = sheet.select(F.col(by_name["entrez"]).cast("long").cast("string").alias("entrez")).join(
                symbols.select(F.col("entrez").cast("string").alias("entrez"), "symbol"), "entrez"
            )
            rows = rows.select(F.upper(F.trim("symbol")).alias("gene"))
        else:
            name = next(c for low, c in by_name.items() if "symbol" in low or "gene" in low)
            rows = sheet.select(F.upper(F.trim(F.col(f"`{name}`"))).alias("gene"))
        rows = rows.where(F.col("gene").isNotNull() & ~F.col("gene").isin("", "NA")).select(F.lit(label).alias("cluster"), "gene")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def scan_local_vep_jsonl(spark: SparkSession, path: str, line: str | None = None) -> DataFrame:
    """(key, variant): annotation records of JSON lines under each of their names: rsid, id, variant_key, input, and the record's own id.

    The record is in payload or vep, or is the line itself; of an array the first element counts. A key's last line wins, by file
    and place in it, however many tasks read the file (or by ``line``, a column of line numbers in the JSON).
    """
    rows = _ordered_lines(spark, path).select("value", F.col("file").alias("f"), F.col("at").alias("n")).where(F.trim("value") != "")
    raw = F.coalesce(filled(F.get_json_object("value", "$.payload")), filled(F.get_json_object("value", "$.vep")), F.col("value"))
    one = F.when(F.trim(raw).startswith("["), F.get(F.from_json(raw, f"array<{VARIANT}>"), F.lit(0))).otherwise(F.from_json(raw, VARIANT))
    names = [F.get_json_object("value", f"$.{k}") for k in ("rsid", "id", "variant_key", "input")]
    order = F.col("n") if line is None else F.get_json_object("value", f"$.{line}").cast("long")
    rows = rows.select("f", order.alias("n"), one.alias("variant"), *[k.alias(f"k{i}") for i, k in enumerate(names)])
    keys = F.array_distinct(F.array_compact(F.array(*[filled(F.col(f"k{i}")) for i in range(len(names))], filled(F.col("variant.id")))))
    each = rows.where(F.col("variant").isNotNull()).select(F.explode(keys).alias("key"), "variant", F.struct("f", "n").alias("o"))
    return each.groupBy("key").agg(F.max_by("variant", "o").alias("variant"))


def scan_clock_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """(cpg, coef) of a clock in CSV; the row of the intercept has cpg null. Lines before the header, and rows without a probe or a
    number, are left out. The probe is the column named like probe, CpG or marker, the weight that like coef or weight, else the first two."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("f"))
    cells = F.transform("f", lambda c: F.btrim(F.trim(c), F.lit('"')))
    rows = lines.select(cells.alias("f"))
    low = F.transform("f", F.lower)
    probe = F.exists(low, lambda c: c.contains("probe") | c.contains("cpg") | c.contains("marker"))
    weight = F.exists(low, lambda c: c.contains("coef") | c.contains("weight"))
    head = rows.where(probe & weight).limit(1).collect()  # one line
    names = [c.lower() for c in head[0]["f"]] if head else ["probe", "coef"]
    at = next((k for k, c in enumerate(names) if "probe" in c or "cpg" in c or "marker" in c), 0)
    to = next((k for k, c in enumerate(names) if "coef" in c or "weight" in c), 1)
    rows = rows.select(F.get("f", F.lit(at)).alias("cpg"), F.get("f", F.lit(to)).try_cast("double").alias("coef"))
    rows = rows.where((F.col("cpg") != "") & ~F.col("cpg").startswith("#") & F.col("coef").isNotNull())
    return rows.select(F.when(F.btrim(F.lower("cpg"), F.lit("()")) != "intercept", F.col("cpg")).alias("cpg"), "coef")


def primary_gene(c: Column) -> Column:
    """The first name of a gene list; null for blanks, points and nan."""
    first = F.trim(F.split(c, "[;,]")[0])
    return F.when(~F.lower(first).isin("", ".", "nan", "none"), first)


def scan_probe_gene_map(tables: Sequence[DataFrame], probes: Sequence[str] = ("IlmnID", "probe", "cpg", "ID", "Name"), genes: Sequence[str] = ("UCSC_RefGene_Name", "gene", "gene_symbol", "Gene Symbol")) -> DataFrame:
    """(probe, gene): a gene for each probe, of the first table that has rows with both; of a probe's genes the least."""
    for table in tables:
        low = {c.lower(): c for c in table.columns}
        probe, gene = (next((low[n.lower()] for n in names if n.lower() in low), None) for names in (probes, genes))
        if probe is None or gene is None:
            continue
        rows = table.select(F.trim(F.col(f"`{probe}`")).alias("probe"), primary_gene(F.col(f"`{gene}`")).alias("gene")).dropna()
        if not rows.isEmpty():
            return rows.groupBy("probe").agg(F.min("gene").alias("gene"))
    raise ValueError("no table has probes and genes")


def scan_id_list(spark: SparkSession, path: str, headers: Sequence[str] = ("id", "cpg", "rsid", "snp", "probe")) -> DataFrame:
    """(id): distinct ids of text with one in a line; comments, headers and blanks are left out."""
    ids = spark.read.text(path).select(F.btrim(F.trim(F.split("value", "[,\t]")[0]), F.lit('"')).alias("id"))
    return ids.where((F.col("id") != "") & ~F.col("id").startswith("#") & ~F.lower("id").isin(*headers)).distinct()


# Names under which the columns of a variant list come.
MANIFEST_NAMES = {"Gene": "gene", "SNP_rsID": "rsid", "rsID": "rsid", "Chromosome": "chrom", "Position_GRCh38": "pos", "position": "pos"}


def load_manifest(df: DataFrame, aliases: Mapping[str, str] = MANIFEST_NAMES) -> DataFrame:
    """(gene, rsid, chrom, pos, ...) of the rows with an id, a chromosome and a whole position, in genome order."""
    df = required(nz.rename_aliases(df, aliases), ["rsid", "chrom", "pos"])
    held = df.withColumns({"chrom": nz.normalize_chrom_label(F.col("chrom")), "pos": F.col("pos").try_cast("double").try_cast("long"), "rsid": F.trim("rsid")})
    usable = held.where((F.col("rsid") != "") & (F.col("chrom") != "") & F.col("pos").isNotNull())
    return usable.orderBy(nz.chrom_sort_key(F.col("chrom")), "pos", "rsid")


# Names under which the columns of a candidate table come.
CANDIDATE_NAMES = {
    "Gene Symbol": "Gene_Symbol", "gene_symbol": "Gene_Symbol", "Gene": "Gene_Symbol", "Variant Count": "Variant_Count",
    "variant_count": "Variant_Count", "n_variants": "Variant_Count", "Functional Cluster": "Functional_Cluster",
    "functional_cluster": "Functional_Cluster", "Pathway": "Functional_Cluster", "Longevity Class": "Longevity_Class",
    "longevity_class": "Longevity_Class", "Direction": "Longevity_Class",
}


def load_candidate_table(df: DataFrame, aliases: Mapping[str, str] = CANDIDATE_NAMES) -> DataFrame:
    """A gene table with its usual names, old symbols replaced (Gene_Symbol_Raw keeps them, Mapped_From_Legacy tells), counts as numbers."""
    df = required(nz.rename_aliases(df, aliases), ["Gene_Symbol", "Variant_Count", "Functional_Cluster"])
    mapped = nz.map_legacy_symbol(F.col("Gene_Symbol"))
    out = df.withColumns({"Gene_Symbol_Raw": F.trim("Gene_Symbol"), "Gene_Symbol": mapped["symbol"], "Mapped_From_Legacy": mapped["changed"]})
    texts = [c for c in ("Functional_Cluster", "Longevity_Class") if c in out.columns]
    return out.withColumns({"Variant_Count": F.col("Variant_Count").cast("string").try_cast("double"), **{c: F.trim(c) for c in texts}})


def scan_bedmethyl(spark: SparkSession, path: str) -> DataFrame:
    """Methylation calls in tab-separated BED: place, strand, coverage, percent and both counts."""
    return spark.read.schema(BEDMETHYL).option("sep", "\t").option("comment", "#").csv(path)


def scan_text_documents(spark: SparkSession, path: str, suffixes: Sequence[str] = ("md", "txt")) -> DataFrame:
    """(path, text) of the text files of a tree, white space collapsed."""
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(suffixes) + "}")
    return lines.select(F.col("_metadata.file_path").alias("path"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"))


def parse_sra_docsum(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """(uid, accession, title, platform, description, n_samples, link) of document summaries, one XML record a row."""
    doc = F.from_xml(xml, "Id string, Item array<struct<_Name:string,_Type:string,_VALUE:string,Item:array<struct<_Name:string,_VALUE:string>>>>")
    rows = docs.select(doc.alias("d"))

    def one(name: str) -> Column:
        return F.get(F.filter("d.Item", lambda x: x["_Name"] == name), F.lit(0))["_VALUE"]

    def item(*names: str) -> Column:
        return F.coalesce(*map(one, names))

    runs = F.flatten(F.transform(F.filter("d.Item", lambda x: F.lower(x["_Name"]).isin("runs", "run") & (x["_Type"] == "List")), lambda x: x["Item"]))
    title, accession = F.coalesce(item("Title", "title"), F.lit("")), F.coalesce(item("Accession", "accession"), F.lit(""))
    return rows.select(
        F.col("d.Id").alias("uid"),
        accession.alias("accession"),
        title.alias("title"),
        nz.normalize_platform(item("Platform", "platform")).alias("platform"),
        nz.coalesce_description(item("Summary"), item("Abstract"), item("Design"), title).alias("description"),
        nz.infer_sample_count(item("RunCount", "total_runs", "n_runs"), runs, accession).alias("n_samples"),
        nz.record_link(accession, F.col("d.Id")).alias("link"),
    )

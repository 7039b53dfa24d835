"""Scalar normalisers and labels as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.trim(c.cast("string")), "(?i)^chr", "")


def normalize_chrom(c: Column) -> Column:
    """Trimmed, without a leading chr in any case."""
    return _stripped(c)


def normalize_chrom_label(c: Column) -> Column:
    """As :func:`normalize_chrom`, whole numbers as integers, M as MT, upper case."""
    s = F.upper(_stripped(c))
    number = s.try_cast("double")
    return F.when(number == F.floor(number), number.cast("long").cast("string")).when(s == "M", "MT").otherwise(s)


def normalize_chrom_accession(c: Column) -> Column:
    """NC_000016.10 gives 16; other labels lose a leading CHR."""
    number = F.regexp_extract(c, r"NC_0*(\d+)", 1)
    return F.when(number != "", number).otherwise(F.upper(_stripped(c)))


def chrom_prefixed(c: Column) -> Column:
    return F.concat(F.lit("chr"), _stripped(c))


def chrom_sort_key(c: Column) -> Column:
    """1 to 22, X 23, Y 24, MT 25, anything else 99."""
    s = normalize_chrom_label(c)
    number = s.try_cast("int")
    return F.when(number.between(1, 22), number).when(s == "X", 23).when(s == "Y", 24).when(s == "MT", 25).otherwise(99)


def normalize_rsid_strict(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(r"(?i)^rs\d+$"), s)


def normalize_rsid_lenient(c: Column) -> Column:
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when((s == "") | F.lower(s).startswith("rs"), s).otherwise(F.concat(F.lit("rs"), s))


def normalize_rsid_lower(c: Column) -> Column:
    return F.coalesce(F.lower(normalize_rsid_strict(c)), F.lit(""))


def first_allele(alt: Column) -> Column:
    return F.upper(F.trim(F.split(alt, ",")[0]))


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """chrom:pos:REF:ALT of the first alternative; null if any part is."""
    parts = [normalize_chrom(chrom), pos.cast("string"), F.upper(F.trim(ref)), first_allele(alt)]
    return F.concat(parts[0], *(x for p in parts[1:] for x in (F.lit(":"), p)))


def prepare_variants(df: DataFrame, chrom: str = "chrom", pos: str = "pos", ref: str = "ref", alt: str = "alt", rsid: str = "rsid") -> DataFrame:
    """Coordinates trimmed and in one form, the first alternative allele, variant_key, and the rs id or null; other columns stay."""
    c, p = F.col(chrom), F.col(pos).cast("string").try_cast("double").try_cast("long")
    keyed = df.withColumn("variant_key", variant_key(c, p, F.col(ref), F.col(alt)))
    cleaned = {chrom: normalize_chrom(c), pos: p, ref: F.upper(F.trim(ref)), alt: first_allele(F.col(alt))}
    return keyed.withColumns(cleaned | ({rsid: normalize_rsid_strict(F.col(rsid))} if rsid in df.columns else {}))


def gnomad_variant_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat(normalize_chrom_label(chrom), F.lit("-"), pos.cast("string"), F.lit("-"), F.upper(ref), F.lit("-"), F.upper(alt))


def extraction_chunk_label(chrom: Column, pos: Column) -> Column:
    return F.concat(F.lit("F22418_imputed_chr"), normalize_chrom_label(chrom), F.lit("_GRCh38_"), pos.cast("string"))


def gene_tokens(c: Column) -> Column:
    """Tokens between commas, semicolons and slashes, trimmed, upper case, blanks out."""
    parts = F.transform(F.split(c, "[,;/]"), lambda x: F.upper(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def parse_alleles(c: Column) -> Column:
    """Struct (ref, alt, alts) of T/A/C: alt is the first alternative, alts all of them with commas."""
    parts = F.split(c, "/")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.struct(parts[0].alias("ref"), F.get(parts, F.lit(1)).alias("alt"), F.array_join(rest, ",").alias("alts"))


def extract_cytoband(c: Column) -> Column:
    """The first band of a location, whose label is removed before; NA without any."""
    # fixed pattern of a band
    band = F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit("Location:"), F.lit("")), r"(?i)(\d+[pq](?:\d+(?:\.\d+)?)?|[XYpqter]+)", 1)
    return F.when(band == "", "NA").otherwise(band)


def coerce_integer(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(F.abs(x - F.round(x)) <= 1e-6, F.round(x).cast("long"))


def ordered_span(start: Column, end: Column) -> Column:
    both = start.isNotNull() & end.isNotNull()
    return F.struct(F.when(both, F.least(start, end)).alias("low"), F.when(both, F.greatest(start, end)).alias("high"))


def binary_from_code(c: Column) -> Column:
    return F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) != "", 1).otherwise(0)


def genotype_label(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), "Missing").when(c == 0, "0/0").when(c == 1, "0/1").when(c == 2, "1/1").otherwise(s)


def age_decade(c: Column) -> Column:
    """Right-open decades from <20 to 90+."""
    ladder = F.when(c.isNull(), F.lit(None).cast("string")).when(c < 20, "<20")
    for low in range(20, 90, 10):
        ladder = ladder.when(c < low + 10, f"{low}-{low + 9}")
    return ladder.otherwise("90+")


def age_stratum(c: Column) -> Column:
    return F.when(c < 30, "<30").when(c <= 60, "30-60").when(c > 60, ">60")


# Consequence terms by class, in order of precedence.
CONSEQUENCE_CLASSES = {
    "coding-missense": ["missense_variant"],
    "coding-synonymous": ["synonymous_variant"],
    "UTR": ["5_prime_UTR_variant", "3_prime_UTR_variant", "5_prime_UTR_truncation", "3_prime_UTR_truncation"],
    "intronic": ["intron_variant"],
    "upstream-downstream-regulatory": [
        "upstream_gene_variant",
        "downstream_gene_variant",
        "regulatory_region_variant",
        "regulatory_region_ablation",
        "TF_binding_site_variant",
        "TFBS_ablation",
        "enhancer_ablation",
        "enhancer_variant",
        "promoter_variant",
        "miRNA",
        "NMD_transcript_variant",
        "non_coding_transcript_exon_variant",
        "intergenic_variant",
    ],
}


def classify_functional(terms: Column) -> Column:
    """Class of an array of consequence terms, by precedence; other where none is known."""
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, known in CONSEQUENCE_CLASSES.items():
        ladder = ladder.when(F.arrays_overlap(terms, F.array(*map(F.lit, known))), name)
    return ladder.otherwise("other")


def alphagenome_eligible(cls: Column) -> Column:
    """Classes that don't change a coding sequence."""
    return ~cls.startswith("coding-")


def percent_change(ref: Column, alt: Column) -> Column:
    """Struct (diff, perc_change, abs_perc_change); no change where ref is 0."""
    pct = F.when(ref == 0, 0.0).otherwise((alt - ref) / ref * 100)
    return F.struct((alt - ref).alias("diff"), pct.alias("perc_change"), F.abs(pct).alias("abs_perc_change"))


def methylated_counts(coverage: Column, percent: Column, chrom: Column | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """Struct (methylated, unmethylated), with a place also its label chrom:start-end; halves round to even."""
    m = F.bround(coverage * percent / 100).cast("long")
    place = [] if chrom is None else [F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")).alias("label")]
    return F.struct(m.alias("methylated"), (coverage - m).cast("long").alias("unmethylated"), *place)


def pvalue_from_parts(mantissa: Column, exponent: Column) -> Column:
    return mantissa * F.pow(F.lit(10.0), exponent)


def snv_alt_sequence(sequence: Column, start: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """The window with the base at ``pos`` replaced, where it lies inside and both alleles are one base."""
    inside = (pos >= start) & (pos < start + F.char_length(sequence)) & (F.char_length(ref) == 1) & (F.char_length(alt) == 1)
    return F.when(inside, F.overlay(sequence, alt, (pos - start + 1).cast("int"), F.lit(1)))


# Words in a platform's name, and the label that the first of them that fits gives.
PLATFORM_WORDS = {
    "nanopore": "Oxford Nanopore", "minion": "Oxford Nanopore", "promethion": "Oxford Nanopore",
    "gridion": "Oxford Nanopore", "flongle": "Oxford Nanopore", "illumina": "Illumina", "pacbio": "PacBio", "pac bio": "PacBio",
    "ion torrent": "Ion Torrent", "bgiseq": "MGI/BGI", "mgi": "MGI/BGI",
}


def normalize_platform(c: Column) -> Column:
    """A sequencing platform's label; the trimmed text where no word is known, unknown where it is blank."""
    s = F.trim(F.coalesce(c, F.lit("")))
    ladder = F.when(s == "", "unknown")
    for word, name in PLATFORM_WORDS.items():
        ladder = ladder.when(F.lower(s).contains(word), name)
    return ladder.otherwise(s)


def format_locus_label(rsid: Column, gene: Column, form: str = "rsid") -> Column:
    """rsid: rs1 (GENE), the id alone without a gene. probe: GENE (cg1), likewise. name: GENE (rs1), a lack of either left blank."""
    held = F.trim(F.coalesce(gene, F.lit("")))
    if form == "name":
        return F.concat(held, F.lit(" ("), F.coalesce(rsid, F.lit("")), F.lit(")"))
    a, b = (rsid, gene) if form == "rsid" else (gene, rsid)
    return F.when(held == "", rsid).otherwise(F.concat(a, F.lit(" ("), b, F.lit(")")))


def floor_for_log(c: Column, floor: float = 1e-4) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))


def minus_log10(p: Column, least: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(least)))


# Names under which ages come.
AGE_NAMES = ("chronological_age", "age", "age_years")


def normalize_age(df: DataFrame, names: Sequence[str] = AGE_NAMES, to: str = "chronological_age") -> DataFrame:
    """The first column of these names (in any case) as a number in ``to``, null where it is none; an error without any."""
    low = {c.lower(): c for c in df.columns}
    held = next((low[n.lower()] for n in names if n.lower() in low), None)
    if held is None:
        raise ValueError(f"none of the columns {list(names)}")
    age = F.nanvl(F.trim(F.col(f"`{held}`").cast("string")).try_cast("double"), F.lit(None))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (to, held)], age.alias(to))


def rename_aliases(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns renamed by ``names`` (alias: name), where the alias is there and the name isn't; the first alias of a name counts."""
    taken, chosen = set(df.columns), {}
    for alias, name in names.items():
        if alias in df.columns and name not in taken:
            chosen[alias] = name
            taken.add(name)
    return df.withColumnsRenamed(chosen)


# Old names of genes, in lower case, and the symbols in use.
LEGACY_SYMBOLS = {
    "cetp": "CETP", "cholesteryl ester transfer protein": "CETP", "cholesteryl ester transfer protein (cetp)": "CETP", "cetp gene": "CETP",
    "cetp locus": "CETP", "dqb1": "HLA-DQB1", "dqb103": "HLA-DQB1", "dqb105": "HLA-DQB1", "dqb1*03": "HLA-DQB1", "dqb1*05": "HLA-DQB1",
    "hla-dqb1*03": "HLA-DQB1", "hla-dqb1*05": "HLA-DQB1", "hla-dq": "HLA-DQB1", "hla class ii dq beta": "HLA-DQB1",
    "hla class ii dq beta chain": "HLA-DQB1", "hsp70-1": "HSPA1A", "hsp70-1a": "HSPA1A", "hsp70-1b": "HSPA1B", "hsp70-2": "HSPA1B",
    "hsp70-hom": "HSPA1L",
}


def map_legacy_symbol(c: Column, names: Mapping[str, str] = LEGACY_SYMBOLS) -> Column:
    """Struct (symbol, changed): the trimmed name, replaced if it is an old one in any case."""
    held = F.trim(c)
    known = F.element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), F.lower(held))
    symbol = F.coalesce(known, held)
    return F.struct(symbol.alias("symbol"), F.coalesce(symbol != held, F.lit(False)).alias("changed"))


# Identifiers that name no single base, and genes written where an identifier should be.
HLA_ALLELES = ("DQB103", "DQB105", "DQB1*03", "DQB1*05", "HLA-DQB1")
REPEATS = ("(GT)n repeat", "(GT)n", "GT repeat")
GENE_PLACEHOLDERS = ("APOC1", "CETP", "PRR5L", "SGK1", "VEGFA", "YWHAG", "CNDP1", "IL8", "HLA-DQB1")


def classify_non_snp(c: Column) -> Column:
    """Struct of booleans (hla_allele, repeat, non_snp, gene_placeholder) of an identifier; all false for null."""
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    big = F.upper(s)
    hla = big.isin(*HLA_ALLELES) | big.startswith("DQB1*") | big.startswith("HLA-DQB")
    repeat = s.isin(*REPEATS) | big.contains("(GT)")
    return F.struct(hla.alias("hla_allele"), repeat.alias("repeat"), (hla | repeat).alias("non_snp"), big.isin(*GENE_PLACEHOLDERS).alias("gene_placeholder"))


# Amino acids by their one-letter codes.
AMINO_ACIDS = {
    "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu", "M": "Met",
    "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr",
}


def hgvs_candidates(gene: Column, alias: Column) -> Column:
    """Distinct HGVS names that an old name of a variant may mean: -110A>C, A1267G, I405V and Val158Met, in this order."""
    s = F.trim(alias)
    acids = F.create_map(*[F.lit(x) for item in AMINO_ACIDS.items() for x in item])

    def parts(text: Column, pattern: str, order: tuple[int, int, int]) -> tuple[Column, list[Column]]:
        return text.rlike(pattern), [F.regexp_extract(text, pattern, k) for k in order]

    change, (pos, ref, alt) = parts(F.replace(s, F.lit(" "), F.lit("")), r"(?i)^(-?\d+)([ACGT])[/>(]+([ACGT])$", (1, 2, 3))
    lead, (lead_ref, lead_pos, lead_alt) = parts(s, r"(?i)^([ACGT])(\d+)([ACGT])$", (1, 2, 3))
    long, (long_a, long_n, long_b) = parts(s, r"^([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2})$", (1, 2, 3))
    short, (a, n, b) = parts(s, r"^([A-Z])(\d+)([A-Z])$", (1, 2, 3))
    coding, protein = F.concat(gene, F.lit(":c.")), F.concat(gene, F.lit(":p."))
    named = F.when(short & F.map_contains_key(acids, a) & F.map_contains_key(acids, b), F.concat(protein, F.element_at(acids, a), n, F.element_at(acids, b)))
    found = F.array(
        F.when(change, F.concat(coding, pos, F.upper(ref), F.lit(">"), F.upper(alt))),
        F.when(lead, F.concat(coding, lead_pos, F.upper(lead_ref), F.lit(">"), F.upper(lead_alt))),
        F.when(long, F.concat(protein, long_a, long_n, long_b)),
        named,
    )
    return F.array_distinct(F.array_compact(found))


def age_acceleration(df: DataFrame, predicted: str = "predicted_age", age: str = "chronological_age", to: str = "age_acceleration") -> DataFrame:
    """Predicted less chronological age, unless the column is there."""
    return df if to in df.columns else df.withColumn(to, F.col(predicted) - F.col(age))


def parse_track_scores(dump: Column) -> Column:
    """Struct (ref_score, alt_score) from a text dump of two tracks: each half's nonzero_mean, else its first value, else 0."""
    number = r"(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)"
    halves = F.split(F.coalesce(dump, F.lit("")), "alternate=", 2)

    def score(half: Column) -> Column:
        mean = F.regexp_extract(half, r"nonzero_mean['\"]?\s*[:=]\s*" + number, 1)
        value = F.regexp_extract(half, r"values=array\(\[\[\s*" + number, 1)
        return F.coalesce(mean.try_cast("double"), value.try_cast("double"), F.lit(0.0))

    return F.struct(score(halves[0]).alias("ref_score"), score(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("alt_score"))


def coalesce_description(summary: Column, abstract: Column, design: Column, title: Column, most: int = 2000) -> Column:
    """The first that isn't empty, trimmed; what is longer than ``most`` characters ends in three points."""
    s = F.trim(F.coalesce(*[F.when(c != "", c) for c in (summary, abstract, design, title)], F.lit("")))
    return F.when(F.char_length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def infer_sample_count(stated: Column, runs: Column, accession: Column) -> Column:
    """A stated count in digits, else the number of ``runs`` (an array), else 1 with an accession; text, as counts come."""
    digits = F.when(F.trim(stated).rlike(r"^\d+$"), F.trim(stated).cast("long").cast("string"))
    listed = F.when(F.size(runs) > 0, F.size(runs).cast("string"))
    return F.coalesce(digits, listed, F.when(F.trim(accession) != "", "1"), F.lit(""))


def record_link(accession: Column, uid: Column, base: str = "https://www.ncbi.nlm.nih.gov/sra/") -> Column:
    """Address of a record by its accession, by its uid if that lacks or is only digits, else empty."""
    a = F.trim(F.coalesce(accession, F.lit("")))
    by_uid = F.when(F.coalesce(uid, F.lit("")) != "", F.concat(F.lit(base + "?term="), uid)).otherwise("")
    return F.when((a != "") & ~a.rlike(r"^\d+$"), F.concat(F.lit(base), a)).otherwise(by_uid)


# Short names of consequences.
CONSEQUENCE_LABELS = {
    "missense_variant": "Missense", "synonymous_variant": "Synonymous", "intron_variant": "Intron", "3_prime_utr_variant": "3′ UTR",
    "5_prime_utr_variant": "5′ UTR", "upstream_gene_variant": "Upstream", "downstream_gene_variant": "Downstream",
    "intergenic_variant": "Intergenic", "regulatory_region_variant": "Regulatory",
}


def format_consequence_label(c: Column) -> Column:
    """Short name of a consequence; one that has none without _variant, in words with capitals."""
    known = F.element_at(F.create_map(*[F.lit(x) for item in CONSEQUENCE_LABELS.items() for x in item]), c)
    return F.coalesce(known, F.initcap(F.replace(F.replace(c, F.lit("_variant"), F.lit("")), F.lit("_"), F.lit(" "))))


def minmax_scale(df: DataFrame, column: str, to: str, low: float, high: float) -> DataFrame:
    """``column`` rescaled to [low, high] over the whole table; their middle where all values are equal."""
    ends = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    span = F.col("__high") - F.col("__low")
    scaled = F.when(span == 0, (low + high) / 2).otherwise(low + (F.col(column) - F.col("__low")) / span * (high - low))
    return df.crossJoin(F.broadcast(ends)).withColumn(to, F.when(F.col(column).isNotNull(), scaled)).drop("__low", "__high")

"""Fields of nested annotation records: transcripts, population frequencies, effect predictors and trait associations.

Records are struct and array columns (``from_json`` with the schemas below turns text into them); every function is a column
expression, so rows are never exploded only to pick one element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from agewise.functions.normalize import alphagenome_eligible, classify_functional, parse_alleles

TRANSCRIPT = (
    "struct<canonical:string,impact:string,transcript_id:string,gene_symbol:string,consequence_terms:array<string>,"
    "sift_prediction:string,sift_score:double,polyphen_prediction:string,polyphen_score:double,hgvsg:string,hgvsc:string,"
    "hgvsp:string,cadd_phred:string>"
)
VARIANT = (
    "struct<id:string,input:string,seq_region_name:string,start:long,allele_string:string,most_severe_consequence:string,"
    f"hgvsg:string,transcript_consequences:array<{TRANSCRIPT}>>"
)
POPULATIONS = "struct<populations:array<struct<id:string,ac:long,an:long>>>"
FREQUENCIES = f"struct<variant_id:string,joint:{POPULATIONS},exome:{POPULATIONS},genome:{POPULATIONS}>"
EFFECTS = "struct<_id:string,am_score:array<double>,am_pred:array<string>,cadd_phred:string>"
ASSOCIATION = "struct<traits:array<string>,mantissa:double,exponent:int,direction:string,genes:array<string>,href:string>"

# Impacts from the gravest on.
IMPACTS = ("HIGH", "MODERATE", "LOW", "MODIFIER")
# Classes of a missense predictor.
MISSENSE_CLASSES = {"B": "benign", "A": "ambiguous", "P": "pathogenic"}
# Words by which traits are grouped.
TRAIT_WORDS = {
    "ad": ("alzheimer", "dementia", "cognitive", "amyloid", "tau ", "neurodegener"),
    "pd": ("parkinson",),
    "lipid": (
        "cholesterol", "ldl", "hdl", "triglyceride", "lipid", "apolipoprotein", "hyperlipidemia", "atherosclerosis", "coronary",
        "cetp", "statin",
    ),
}
# Fixed value: the population whose frequency is taken.
POPULATION = "nfe"


def filled(c: Column) -> Column:
    """Null where the text is empty."""
    return F.when(c != "", c)


def impact_rank(impact: Column) -> Column:
    """Place in IMPACTS, 3 for null, 99 for anything else."""
    ladder = F.when(impact.isNull(), IMPACTS.index("MODIFIER"))
    for k, name in enumerate(IMPACTS):
        ladder = ladder.when(impact == name, k)
    return ladder.otherwise(99)


def first_by(items: Column, key: Callable[[Column], Sequence[Column]]) -> Column:
    """The element with the least key, the earlier of equal ones; null for an empty or null array."""
    ranked = F.transform(items, lambda x, i: F.struct(*[k.alias(f"k{n}") for n, k in enumerate(key(x))], i.alias("i")))
    return F.get(items, F.array_min(ranked)["i"])


def pick_primary_transcript(transcripts: Column) -> Column:
    """The canonical one of gravest impact; without a canonical one, the gravest."""
    return first_by(
        transcripts,
        lambda t: [F.when(F.lower(t["canonical"]).isin("1", "true"), 0).otherwise(1), impact_rank(t["impact"])],
    )


def pick_validated_transcript(transcripts: Column, genes: Column) -> Column:
    """First by gene among ``genes`` (an array), impact, a missense term, and id."""
    wanted = F.transform(genes, F.upper)
    return first_by(
        transcripts,
        lambda t: [
            F.when(F.array_contains(wanted, F.upper(t["gene_symbol"])), 0).otherwise(1),
            impact_rank(t["impact"]),
            F.when(F.array_contains(t["consequence_terms"], "missense_variant"), 0).otherwise(1),
            F.coalesce(t["transcript_id"], F.lit("")),
        ],
    )


def pick_sift_polyphen(transcripts: Column) -> Column:
    """Of the transcripts with a prediction or a score, the gravest: struct of the four."""

    def held(t: Column) -> Column:
        texts = F.coalesce(filled(t["sift_prediction"]), filled(t["polyphen_prediction"])).isNotNull()
        return texts | F.coalesce(t["sift_score"], t["polyphen_score"]).isNotNull()

    best = first_by(F.filter(transcripts, held), lambda t: [impact_rank(t["impact"])])
    return F.struct(
        filled(best["sift_prediction"]).alias("sift_prediction"),
        best["sift_score"].alias("sift_score"),
        filled(best["polyphen_prediction"]).alias("polyphen_prediction"),
        best["polyphen_score"].alias("polyphen_score"),
    )


def extract_vep_fields(variant: Column) -> Column:
    """Struct of twelve flat fields of a VARIANT record; all null for a null record."""
    each = variant["transcript_consequences"]
    primary, scores = pick_primary_transcript(each), pick_sift_polyphen(each)
    named = F.filter(each, lambda t: filled(t["hgvsg"]).isNotNull())
    known = F.filter(each, lambda t: filled(t["impact"]).isNotNull())
    gravest = first_by(known, lambda t: [impact_rank(t["impact"])])
    terms = primary["consequence_terms"]
    return F.struct(
        variant["most_severe_consequence"].alias("vep_most_severe_consequence"),
        F.coalesce(primary["impact"], gravest["impact"]).alias("vep_impact"),
        primary["transcript_id"].alias("vep_transcript_id"),
        primary["gene_symbol"].alias("vep_gene_symbol"),
        F.when(F.size(terms) > 0, F.array_join(terms, ";")).alias("vep_consequence_terms"),
        *(scores[c].alias(c) for c in ("sift_prediction", "sift_score", "polyphen_prediction", "polyphen_score")),
        F.coalesce(filled(variant["hgvsg"]), F.get(named, F.lit(0))["hgvsg"]).alias("hgvsg"),
        primary["hgvsc"].alias("hgvsc"),
        primary["hgvsp"].alias("hgvsp"),
    )


def extract_population_af(record: Column, population: str = POPULATION) -> Column:
    """Allele count / number of the population in the first of joint, exome and genome that has both."""
    none = F.array().cast("array<struct<id:string,ac:long,an:long>>")
    every = F.concat(*[F.coalesce(record[s]["populations"], none) for s in ("joint", "exome", "genome")])
    usable = F.filter(every, lambda p: (p["id"] == population) & (p["an"] > 0) & p["ac"].isNotNull())
    found = F.get(usable, F.lit(0))
    return found["ac"] / found["an"]


def cache_entry_row(record: Column, method: Column, fetched_at: Column | None = None) -> Column:
    """Struct (af_gnomad_nfe, variant_id, lookup_method, fetched_at)."""
    return F.struct(
        extract_population_af(record).alias("af_gnomad_nfe"),
        record["variant_id"].alias("variant_id"),
        method.alias("lookup_method"),
        (F.current_timestamp() if fetched_at is None else fetched_at).alias("fetched_at"),
    )


def pick_allele_record(records: Column, ref: Column, alt: Column) -> Column:
    """The first EFFECTS record whose id names ref>alt (the first alternative), else the first with a missense score, else the first."""
    first_alt = F.trim(F.split(alt, ",")[0])
    needle = F.when((ref != "") & (first_alt != ""), F.concat(ref, F.lit(">"), first_alt))
    named = F.filter(records, lambda r: F.coalesce(r["_id"].contains(needle), F.lit(False)))
    scored = F.filter(records, lambda r: F.size(r["am_score"]) > 0)
    return F.coalesce(*[F.get(a, F.lit(0)) for a in (named, scored, records)])


def extract_alphamissense(record: Column, missense: Column) -> Column:
    """Struct (score with four decimals, class); both null unless ``missense``."""
    value, label = F.get(record["am_score"], F.lit(0)), F.get(record["am_pred"], F.lit(0))
    named = label
    for short, long in MISSENSE_CLASSES.items():
        named = F.when(F.upper(label) == short, long).otherwise(named)
    on = missense & value.isNotNull()
    return F.struct(F.when(on, F.format_string("%.4f", value)).alias("score"), F.when(on, filled(named)).alias("cls"))


def extract_cadd(transcript: Column, record: Column) -> Column:
    return F.coalesce(transcript["cadd_phred"], record["cadd_phred"])


def flatten_gwas(associations: Column) -> Column:
    """Array of (traits, pvalue, beta_direction, reported_genes, association_id) of ASSOCIATION records."""
    return F.transform(
        associations,
        lambda a: F.struct(
            a["traits"].alias("traits"),
            (a["mantissa"] * F.pow(F.lit(10.0), a["exponent"])).alias("pvalue"),
            a["direction"].alias("beta_direction"),
            F.array_sort(F.array_distinct(F.filter(a["genes"], lambda g: filled(g).isNotNull()))).alias("reported_genes"),
            F.regexp_extract(F.coalesce(a["href"], F.lit("")), r"([^/{]*)(?:\{[^/]*)?/*$", 1).alias("association_id"),
        ),
    )


def gwas_trait_rollup(associations: Column) -> Column:
    """Struct of the sorted distinct traits, all and by TRAIT_WORDS, joined by semicolons, and the number of associations."""
    empty = F.array().cast("array<string>")
    traits = F.flatten(F.transform(associations, lambda a: F.coalesce(a["traits"], empty)))
    traits = F.coalesce(F.array_sort(F.array_distinct(F.filter(traits, lambda x: filled(x).isNotNull()))), empty)

    def about(words: Sequence[str]) -> Column:
        return F.array_join(F.filter(traits, lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(x), w))), "; ")

    return F.struct(
        F.array_join(traits, "; ").alias("gwas_all_traits"),
        *(about(words).alias(f"gwas_{k}_traits") for k, words in TRAIT_WORDS.items()),
        F.coalesce(F.size(F.coalesce(associations, F.array())), F.lit(0)).cast("long").alias("gwas_association_count"),
    )


def gene_symbol_rollup(transcripts: Column) -> Column:
    """Sorted distinct gene symbols of the transcripts."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(transcripts, lambda t: t["gene_symbol"]), lambda g: filled(g).isNotNull())))


def parse_gtex_variant(record: Column) -> Column:
    """Struct of a variant's identity, with empty texts and position 0 for what is missing."""
    return F.struct(
        *(F.coalesce(record[c].cast("string"), F.lit("")).alias(c) for c in ("variantId", "snpId", "chromosome")),
        F.coalesce(record["pos"].cast("long"), F.lit(0)).alias("pos"),
        *(F.coalesce(record[c].cast("string"), F.lit("")).alias(c) for c in ("ref", "alt")),
    )


def pick_gtex_variant(records: Column, rsid: Column, ref: Column, alt: Column) -> Column:
    """The first record of the rsid, else of exactly these alleles, else the first."""
    same = F.filter(records, lambda r: F.lower(r["snpId"]) == F.lower(rsid))
    exact = F.filter(records, lambda r: (F.upper(r["ref"]) == F.upper(ref)) & (F.upper(r["alt"]) == F.upper(alt)))
    return F.coalesce(*[F.get(a, F.lit(0)) for a in (same, exact, records)])


def pick_grch38_mapping(mappings: Column) -> Column:
    """Of the GRCh38 mappings to a chromosome, no patches, the one with the shortest, then least region name."""
    usable = F.filter(
        mappings,
        lambda m: (m["assembly_name"] == "GRCh38")
        & F.coalesce(m["coord_system"] == "chromosome", F.lit(True))
        & ~F.coalesce(F.upper(m["seq_region_name"]).contains("_PATCH"), F.lit(False)),
    )
    return first_by(usable, lambda m: [F.char_length(m["seq_region_name"]), m["seq_region_name"]])


def annotate_functional(variant: Column, genes: Column, effects: Column, associations: Column, rsid: Column, build: str = "GRCh38") -> Column:
    """Struct of the 24 columns of a variant's functional annotation; texts that are missing are NA.

    Without a record (``variant`` null), no_vep_record is true and only the id, the genes and the traits are known.
    """
    alleles = parse_alleles(variant["allele_string"])
    ref, alts = alleles["ref"], alleles["alts"]
    chosen = pick_validated_transcript(variant["transcript_consequences"], genes)
    terms = chosen["consequence_terms"]
    cls = F.when(F.size(terms) > 0, classify_functional(terms)).otherwise("other")
    record = pick_allele_record(effects, ref, alts)
    missense = extract_alphamissense(record, cls == "coding-missense")
    traits = gwas_trait_rollup(associations)
    none = variant.isNull()

    def text(c: Column) -> Column:
        return F.coalesce(filled(c), F.lit("NA"))

    def own(c: Column) -> Column:
        return F.when(none, "NA").otherwise(F.coalesce(c.cast("string"), F.lit("")))

    return F.struct(
        rsid.alias("rsID"),
        F.lit(build).alias("genome_build"),
        F.array_join(genes, ";").alias("validated_gene_symbols"),
        own(variant["seq_region_name"]).alias("chromosome_GRCh38"),
        own(variant["start"]).alias("position_GRCh38"),
        own(ref).alias("ref_allele"),
        own(alts).alias("alt_allele"),
        own(variant["most_severe_consequence"]).alias("most_severe_consequence"),
        own(chosen["gene_symbol"]).alias("canonical_gene"),
        own(chosen["transcript_id"]).alias("canonical_transcript"),
        own(F.array_join(terms, ",")).alias("canonical_consequence_terms"),
        F.when(none, "NA").otherwise(cls).alias("functional_class"),
        (~none & alphagenome_eligible(cls)).alias("alphagenome_eligible"),
        text(chosen["sift_prediction"]).alias("SIFT"),
        text(chosen["polyphen_prediction"]).alias("PolyPhen"),
        F.when(none, "NA").otherwise(text(extract_cadd(chosen, record))).alias("CADD_phred"),
        F.when(none, "NA").otherwise(text(missense["score"])).alias("AlphaMissense_score"),
        F.when(none, "NA").otherwise(text(missense["cls"])).alias("AlphaMissense_class"),
        none.alias("no_vep_record"),
        *(text(traits[c]).alias(c) for c in ("gwas_all_traits", "gwas_ad_traits", "gwas_pd_traits", "gwas_lipid_traits")),
        traits["gwas_association_count"].alias("gwas_association_count"),
    )

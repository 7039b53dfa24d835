"""Filters, joins, roll-ups, set operations and checks over gene, variant and manifest tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agewise.functions import normalize as nz
from agewise.functions.ranges import number_rows
from agewise.operators.eqtl import dedup_keep_first, filter_target_tissues, join_eqtl_summary, join_scores, link_variant_probes, summarize_eqtls
from agewise.operators.quality import merge_undirected_edges


# ---- filters ---------------------------------------------------------------------------------------------------------


def filter_significant(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.lower(F.trim(column)) == "significant")


def filter_success(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(F.lower(F.trim(status)) == "success")


def filter_valid_age(df: DataFrame, age: str, demand: bool = False) -> DataFrame:
    """Rows whose age is a number. ``demand`` raises where none is (a job)."""
    kept = df.withColumn(age, F.nanvl(F.col(age).cast("string").try_cast("double"), F.lit(None))).where(F.col(age).isNotNull())
    if demand and kept.isEmpty():
        raise ValueError(f"no row has a number in {age}")
    return kept


def filter_min_coverage(sites: DataFrame, keys: Sequence[str], group: str, coverage: str, groups: Sequence[str], least: int) -> DataFrame:
    """Keys whose coverage is at least ``least`` in every one of ``groups``, with the coverages; one grouped aggregate."""
    wide = sites.where(F.col(group).isin(*groups)).groupBy(*keys).agg(*[F.sum(F.when(F.col(group) == g, F.col(coverage))).alias(f"coverage_{g}") for g in groups])
    return wide.where(reduce(Column.__and__, [F.col(f"coverage_{g}") >= least for g in groups]))


def filter_edges(edges: DataFrame, a: str, b: str, score: str, nodes: DataFrame | None = None, node: str = "node", floor: float = 0.15) -> DataFrame:
    """Edges at the floor or above, without loops; with ``nodes``, only between known ones."""
    kept = edges.where((F.col(score) >= floor) & (F.col(a) != F.col(b)))
    if nodes is not None:
        known = nodes.select(F.col(node)).distinct()
        for end in (a, b):
            kept = kept.join(known.withColumnRenamed(node, end), end, "left_semi")
    return kept


def filter_snv_in_window(df: DataFrame, rsid: str, pos: str, ref: str, alt: str, start: Column, end: Column) -> DataFrame:
    """Rows with an rs id and one base for another, placed within the window."""
    bases = F.col(ref).rlike("(?i)^[ACGT]$") & F.col(alt).rlike("(?i)^[ACGT]$")
    return df.where(F.lower(F.col(rsid)).startswith("rs") & bases & F.col(pos).between(start, end))


def drop_blank_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows where at least one of ``keys`` is neither null nor blank."""
    held = [F.coalesce(F.trim(F.col(k).cast("string")) != "", F.lit(False)) for k in keys]
    return df.dropna("all").where(reduce(Column.__or__, held))


def pick_numeric_features(df: DataFrame, leave: Sequence[str] = (), least: int = 3) -> list[str]:
    """Names of the numeric columns, not of ids or SNPs, with ``least`` values and some spread; one aggregate."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint")
    named = [c for c, k in df.dtypes if (k in kinds or k.startswith("decimal")) and c not in leave]
    named = [c for c in named if not c.lower().startswith("rs") and not c.lower().endswith("id") and not c.lower().endswith("key")]
    if not named:
        return []
    cells = [x for c in named for x in (F.count(f"`{c}`").alias(f"n_{c}"), F.stddev(F.col(f"`{c}`").cast("double")).alias(f"s_{c}"))]
    one = df.agg(*cells).first()
    return [c for c in named if one[f"n_{c}"] >= least and (one[f"s_{c}"] or 0) > 0]


# ---- joins -----------------------------------------------------------------------------------------------------------


def build_master_table(scores: DataFrame, annotations: DataFrame, on: str = "rsid", check: bool = True) -> DataFrame:
    """Scores with their annotation, one row of each key; an error if the number of rows changes (a job, unless ``check`` is false)."""
    own = [c for c in annotations.columns if c == on or c not in scores.columns]
    out = scores.join(dedup_keep_first(annotations.select(*own), [on], *own), on, "left")
    if check and (a := scores.count()) != (b := out.count()):
        raise ValueError(f"{a} rows became {b}")
    return out


def map_variants_to_tissues(variants: DataFrame, eqtls: DataFrame, tissues: Sequence[str], scores: DataFrame | None = None, probes: DataFrame | None = None, on: str = "rsid") -> dict[str, DataFrame]:
    """annotated: the variants with the summary of their hits in target tissues and their scores; eqtl_summary; methylation_links."""
    summary = summarize_eqtls(filter_target_tissues(eqtls, tissues), key=on)
    annotated = join_eqtl_summary(variants, summary, on)
    if scores is not None:
        annotated = join_scores(annotated, scores, on, "alphagenome_")
    out = {"annotated": annotated, "eqtl_summary": summary}
    return out if probes is None else out | {"methylation_links": link_variant_probes(annotated, probes)}


def join_beta_metadata(matrix: DataFrame, meta: DataFrame, sample: str = "sample_id", names: Sequence[str] = ("sample_id", "Sample_ID", "gsm", "geo_accession", "eid")) -> DataFrame:
    """A long matrix with its samples' metadata, whose id column is the first of ``names`` there."""
    own = next((n for n in names if n in meta.columns), None)
    if own is None:
        raise ValueError(f"none of the columns {list(names)}")
    key = F.trim(F.col(own).cast("string")).alias(sample)
    return matrix.withColumn(sample, F.trim(F.col(sample).cast("string"))).join(meta.select(key, *[c for c in meta.columns if c != own]), sample)


def build_cohort_matrix(matrix: DataFrame, labels: DataFrame, ages: DataFrame, cpgs: DataFrame | None = None) -> DataFrame:
    """(sample_id, chronological_age, cpg, beta): samples renamed from label to gsm, those with an age; with ``cpgs``, these only, and an
    error if the matrix lacks one (a job)."""
    named = matrix.join(labels.select(F.col("label").alias("sample_id"), "gsm"), "sample_id").select(F.col("gsm").alias("sample_id"), "cpg", "beta")
    out = named.join(ages.where(F.col("age").isNotNull()).select(F.col("gsm").alias("sample_id"), F.col("age").alias("chronological_age")), "sample_id")
    if cpgs is None:
        return out
    out = out.join(cpgs.select("cpg").distinct(), "cpg", "left_semi")
    lacking = cpgs.select("cpg").distinct().join(out.select("cpg").distinct(), "cpg", "left_anti").limit(5).collect()
    if lacking:
        raise ValueError(f"the matrix lacks {[r['cpg'] for r in lacking]}")
    return out


def join_locus_frequency(manifest: DataFrame, frequencies: DataFrame, rsid: str = "rsid", chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """The manifest's rows with an id, with ref, alt, AF and N_called of the variant at their place; null where there is none. Of several
    variants at a place the least (ref, alt) counts."""
    place = [nz.normalize_chrom_label(F.col(chrom)).alias("__c"), F.col(pos).cast("long").alias("__p")]
    best = F.min(F.struct("ref", "alt", "AF", "N_called")).alias("v")
    known = frequencies.select(*place, "ref", "alt", "AF", "N_called").groupBy("__c", "__p").agg(best)
    rows = manifest.where(F.trim(rsid) != "").withColumns({"__c": place[0], "__p": place[1]})
    return rows.join(known, ["__c", "__p"], "left").select(*manifest.columns, "v.*")


def join_coordinates_1to1(snps: DataFrame, places: DataFrame, key: str = "rsid") -> DataFrame:
    """One row an id on both sides, joined; an error if an id has no place (a job)."""
    left = dedup_keep_first(snps, [key], *snps.columns)
    right = dedup_keep_first(places, [key], *places.columns)
    if lacking := left.join(right, key, "left_anti").select(key).limit(5).collect():
        raise ValueError(f"no place for {[r[0] for r in lacking]}")
    return left.join(right, key)


def coalesce_lookup(df: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` filled from the lookup where it is null or blank."""
    one = lookup.groupBy(key).agg(F.min(value).alias("__v"))
    held = F.when(F.trim(F.col(value).cast("string")) != "", F.col(value))
    return df.join(one, key, "left").withColumn(value, F.coalesce(held, "__v")).drop("__v").select(*df.columns)


def map_ids_to_symbols(df: DataFrame, symbols: DataFrame, key: str, symbol: str = "symbol") -> DataFrame:
    """A symbol for every id, NA for those that have none."""
    one = symbols.groupBy(key).agg(F.min(symbol).alias(symbol))
    return df.join(one, key, "left").withColumn(symbol, F.coalesce(symbol, F.lit("NA")))


def build_manifest(rows: DataFrame, loci: DataFrame, gene: str = "gene", rsid: str = "rsid") -> DataFrame:
    """(gene, rsid, chrom, pos, chunk) of the distinct trimmed pairs; ids without a locus have blanks and a null position."""
    pairs = rows.select(F.trim(gene).alias(gene), F.trim(rsid).alias(rsid)).where(F.col(rsid) != "").distinct()
    places = loci.groupBy(rsid).agg(F.min(F.struct(F.col("chrom").alias("chrom"), F.col("pos").alias("pos"))).alias("p"))
    found = pairs.join(places, rsid, "left").select(gene, rsid, F.col("p.chrom").alias("chrom"), F.col("p.pos").alias("pos"))
    chunk = F.coalesce(nz.extraction_chunk_label(F.col("chrom"), F.col("pos")), F.lit(""))
    return found.withColumn("chunk", chunk).withColumn("chrom", F.coalesce("chrom", F.lit("")))


def plan_lookups(rows: DataFrame, cache: DataFrame, key: str, variant_id: str, chrom: str, pos: str) -> DataFrame:
    """The distinct rows with a route: cached, by variant id, by region, or unresolved."""
    known = cache.select(key).distinct().withColumn("__c", F.lit(True))
    route = F.when(F.col("__c"), "cached").when(F.col(variant_id).isNotNull(), "variant_id").when(F.col(chrom).isNotNull() & F.col(pos).isNotNull(), "region_rsid")
    return rows.distinct().join(known, key, "left").withColumn("route", route.otherwise("unresolved")).drop("__c")


def resolve_alias_cascade(aliases: DataFrame, lookups: Sequence[tuple[str, DataFrame]], gene: str = "gene", alias: str = "alias") -> DataFrame:
    """(gene, alias, canonical_rsid, source, notes) of the distinct pairs.

    An rs id is its own; what names no single base and what is a gene's name is NA with a note. Else the first of the
    ``lookups`` (source, table) that knows it: tables have either (hgvs, rsid), met by the alias' candidates in their order, or
    (gene, alias, rsid). All are joined once; a row is never looped over.
    """
    pairs = aliases.select(F.trim(gene).alias("gene"), F.trim(alias).alias("alias")).distinct()
    odd = nz.classify_non_snp(F.col("alias"))
    out = pairs.withColumn("c", nz.hgvs_candidates(F.col("gene"), F.col("alias")))
    found = []
    for k, (source, table) in enumerate(lookups):
        if "hgvs" in table.columns:
            one = table.groupBy("hgvs").agg(F.min(F.lower("rsid")).alias("r"))
            each = out.select("gene", "alias", F.posexplode("c").alias("i", "hgvs")).join(one, "hgvs")
            best = each.groupBy("gene", "alias").agg(F.min(F.struct("i", "r")).alias("b")).select("gene", "alias", F.col("b.r").alias(f"r{k}"))
        else:
            best = table.groupBy("gene", "alias").agg(F.min(F.lower("rsid")).alias(f"r{k}"))
        out = out.join(best, ["gene", "alias"], "left")
        found.append((source, F.col(f"r{k}")))
    direct = nz.normalize_rsid_strict(F.col("alias"))
    note = F.when(direct.isNotNull(), "").when(odd["non_snp"], "non_snp_excluded").when(odd["gene_placeholder"], "gene_name_placeholder").otherwise("")
    rsid = F.when(note != "", "NA").otherwise(F.coalesce(F.lower(direct), *[r for _, r in found], F.lit("NA")))
    source = F.when(direct.isNotNull(), "direct")
    for name, r in found:
        source = source.when((note == "") & r.isNotNull(), name)
    return out.select("gene", "alias", rsid.alias("canonical_rsid"), source.otherwise("NA").alias("source"), note.alias("notes"))


def canonicalize_ids(aliases: DataFrame, resolved: DataFrame, gene: str = "gene", alias: str = "alias") -> DataFrame:
    """``aliases`` with canonical_rsid, source and notes of a table of :func:`resolve_alias_cascade`."""
    known = resolved.withColumnsRenamed({"gene": "__g", "alias": "__a"})
    return aliases.join(known, (F.trim(gene) == F.col("__g")) & (F.trim(alias) == F.col("__a")), "left").drop("__g", "__a")


def check_duplicate_aliases(resolved: DataFrame) -> DataFrame:
    """(gene, canonical_rsid, aliases): ids that several aliases of a gene share."""
    known = resolved.where(F.col("canonical_rsid") != "NA")
    shared = known.groupBy("gene", "canonical_rsid").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return shared.where(F.size("aliases") > 1)


def split_found_missing(ids: DataFrame, annotations: DataFrame, key: str = "rsid") -> tuple[DataFrame, DataFrame]:
    """The annotation rows of the ids, and the ids without any."""
    wanted = ids.select(key).distinct()
    return annotations.join(wanted, key, "left_semi"), wanted.join(annotations.select(key).distinct(), key, "left_anti")


# ---- roll-ups --------------------------------------------------------------------------------------------------------


# Names under which the columns of a frequency table come.
FREQUENCY_NAMES = {"rsID": "rsid", "ROGEN_AF": "af_cohort", "AF_1kg": "af_cohort", "gnomAD_AF": "af_reference", "AF_gnomad_nfe": "af_reference", "Gene": "gene"}


def af_table(df: DataFrame, threshold: float = 0.05, source: str = "", aliases: Mapping[str, str] = FREQUENCY_NAMES) -> DataFrame:
    """A frequency table with its usual names, delta, abs_diff, outlier and source."""
    out = nz.rename_aliases(df, aliases)
    a, b = (F.col(c).cast("double") for c in ("af_cohort", "af_reference"))
    return out.withColumns({"af_cohort": a, "af_reference": b}).withColumns(
        {"delta": a - b, "abs_diff": F.abs(a - b), "outlier": F.coalesce(F.abs(a - b) >= threshold, F.lit(False)), "source": F.lit(source)}
    )


def per_gene_id_counts(df: DataFrame, gene: str, alias: str, canonical: str) -> DataFrame:
    """Distinct aliases, distinct canonical ids and their sorted list, for each gene."""
    ids = F.array_sort(F.collect_set(canonical))
    return df.groupBy(gene).agg(F.count_distinct(alias).alias("raw_ids"), F.size(ids).cast("long").alias("canonical_ids"), F.array_join(ids, ";").alias("ids"))


def unique_per_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """Distinct items of each group, the most first, then by name."""
    return df.groupBy(group).agg(F.count_distinct(item).alias("n")).orderBy(F.desc("n"), group)


# Consequences in the order of columns.
CONSEQUENCE_ORDER = ("missense_variant", "synonymous_variant", "intron_variant", "3_prime_utr_variant", "5_prime_utr_variant", "upstream_gene_variant", "downstream_gene_variant")


def gene_consequence_matrix(df: DataFrame, gene: str, cls: str, consequence: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts of (class, gene) rows by consequence, zero where there is none. Columns: those given, else the known consequences that
    occur, in their order, then others by name (a job)."""
    if columns is None:
        held = {r[0] for r in df.select(consequence).distinct().dropna().limit(10_001).collect()}
        if len(held) > 10_000:
            raise ValueError("more than 10,000 consequences; name the columns")
        columns = [c for c in CONSEQUENCE_ORDER if c in held] + sorted(held - set(CONSEQUENCE_ORDER))
    return df.groupBy(cls, gene).agg(*[F.count_if(F.col(consequence) == c).alias(c) for c in columns])


def rollup_by_gene(df: DataFrame, gene: str = "gene", rsid: str = "rsid", consequence: str = "consequence", cls: str = "class") -> DataFrame:
    """A row for each class and gene: the gene with its number of variants, their ids, and the consequence: one, x (×n) where all are
    alike, else a line for each id."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(rsid).alias("r"), F.col(consequence).alias("c"))))
    held = df.groupBy(cls, gene).agg(rows.alias("v"))
    n, kinds = F.size("v"), F.array_distinct(F.transform("v", lambda x: x["c"]))
    lines = F.array_join(F.transform("v", lambda x: F.concat(x["r"], F.lit(": "), x["c"])), "\n")
    text = F.when(n == 1, kinds[0]).when(F.size(kinds) == 1, F.concat(kinds[0], F.lit(" (×"), n.cast("string"), F.lit(")"))).otherwise(lines)
    label = F.when(n > 1, F.concat(gene, F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col(gene))
    return held.select(cls, label.alias(gene), F.array_join(F.transform("v", lambda x: x["r"]), ", ").alias("rsids"), text.alias("consequence"))


def genes_per_rsid(df: DataFrame, rsid: str, gene: str, ordinal: str) -> DataFrame:
    """The genes of each id in the order in which they first come, joined by semicolons."""
    first = df.where(F.trim(gene) != "").groupBy(rsid, F.trim(gene).alias("g")).agg(F.min(ordinal).alias("o"))
    listed = F.array_sort(F.collect_list(F.struct("o", "g")))
    return first.groupBy(rsid).agg(F.array_join(F.transform(listed, lambda x: x["g"]), ";").alias("genes"))


def manifest_coverage(manifest: DataFrame, pos: str = "pos") -> DataFrame:
    return manifest.agg(F.count("*").alias("total"), F.count(pos).alias("resolved"), F.count_if(F.col(pos).isNull()).alias("missing"))


def snps_per_chromosome(manifest: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Counts in genome order; the key's column tells it."""
    return manifest.groupBy(chrom).agg(F.count("*").alias("n")).withColumn("sort_key", nz.chrom_sort_key(F.col(chrom))).orderBy("sort_key", chrom)


def gene_manifest_rollup(manifest: DataFrame, gene: str = "gene", rsid: str = "rsid", chrom: str = "chrom") -> DataFrame:
    chroms = F.array_join(F.array_sort(F.collect_set(chrom)), ",")
    return manifest.groupBy(gene).agg(F.count_distinct(rsid).alias("n_snps"), chroms.alias("chromosomes"))


def span_per_chromosome(manifest: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    return manifest.groupBy(chrom).agg(F.min(pos).alias("first"), F.max(pos).alias("last"), (F.max(pos) - F.min(pos)).alias("span"))


def running_total_order(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (), to: str = "ordinal") -> DataFrame:
    """A running number in ``order``, within each group; without a group over sampled ranges, so that no task orders all rows (this writes
    a table)."""
    if group:
        return df.withColumn(to, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return number_rows(df, order, to)


def eqtl_hit_row(df: DataFrame, rsid: str, hits: str) -> DataFrame:
    """(rsid, tissue, gene_symbol, p_value, nes, gtex_variant_id): a row for each hit of an array of records."""
    return df.select(rsid, F.explode(hits).alias("h")).select(
        rsid, F.col("h.tissueSiteDetailId").alias("tissue"), F.col("h.geneSymbol").alias("gene_symbol"), F.col("h.pValue").cast("double").alias("p_value"),
        F.col("h.nes").cast("double").alias("nes"), F.col("h.variantId").alias("gtex_variant_id"),
    )


# ---- top rows and sets -----------------------------------------------------------------------------------------------


def top_impact(df: DataFrame, value: str = "abs_perc_change", n: int = 10, *ties: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(value), *ties).limit(n)


def top_coefficients(coefs: DataFrame, n: int = 25, cpg: str = "cpg", coef: str = "coef") -> DataFrame:
    """The ``n`` largest by size, those that aren't zero first, given in signed order."""
    return coefs.where(F.col(cpg).isNotNull()).orderBy(F.abs(coef).desc(), cpg).limit(n).orderBy(F.desc(coef), cpg)


def rank_variants(df: DataFrame, risk: str = "composite_risk", key: str = "rsid") -> DataFrame:
    return df.orderBy(F.col(risk).desc_nulls_last(), key)


def prioritize_then_limit(df: DataFrame, first: Column, n: int, *order: str) -> DataFrame:
    """At most ``n`` rows: those where ``first`` holds before the others."""
    return df.withColumn("__f", F.when(first, 0).otherwise(1)).orderBy("__f", *order).limit(n).drop("__f")


def capped_examples(df: DataFrame, group: str, item: str, n: int = 8) -> DataFrame:
    """Number of distinct items of each group, and its ``n`` least as examples; no group is collected."""
    ranked = df.select(group, item).distinct().withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(item)))
    shown = F.array_sort(F.collect_list(F.when(F.col("__n") <= n, F.col(item).cast("string"))))
    return ranked.groupBy(group).agg(F.count("*").alias("n_items"), F.array_join(shown, ",").alias("examples"))


def union_sets(sets: DataFrame, label: str, item: str, name: str, of: Sequence[str]) -> DataFrame:
    """(label, item) of the union of the sets ``of``, named ``name``."""
    return sets.where(F.col(label).isin(*of)).select(F.lit(name).alias(label), item).distinct()


def intersect_sets(left: DataFrame, right: DataFrame, item: str) -> DataFrame:
    return left.select(item).intersect(right.select(item))


def except_sets(left: DataFrame, right: DataFrame, item: str) -> DataFrame:
    return left.select(item).subtract(right.select(item))


def overlap_check(left: DataFrame, right: DataFrame, item: str, expected: int) -> DataFrame:
    """One row (n_both, expected, status, missing, extra): what only the left and only the right side has, sorted."""
    a, b = left.select(item, F.lit(1).alias("l")).distinct(), right.select(item, F.lit(1).alias("r")).distinct()
    sides = a.join(b, item, "full_outer")

    def only(c: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col(c).isNull(), F.col(item).cast("string")))), ",")

    one = sides.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), only("r").alias("missing"), only("l").alias("extra"))
    return one.select("n_both", F.lit(expected).cast("long").alias("expected"), F.when(F.col("n_both") == expected, "MATCH").otherwise("MISMATCH").alias("status"), "missing", "extra")


# ---- checks ----------------------------------------------------------------------------------------------------------


def assert_overlap_schema(df: DataFrame, association: str, allowed: Sequence[str], coordinates: Sequence[str]) -> DataFrame:
    """One row (n, bad_association, bad_coordinates, passed): labels that aren't allowed, negative coordinates; an empty table fails."""
    label = F.coalesce(F.lower(F.trim(association)).isin(*[a.lower() for a in allowed]), F.lit(False))
    low = reduce(Column.__or__, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in coordinates])
    one = df.agg(F.count("*").alias("n"), F.count_if(~label).alias("bad_association"), F.count_if(low).alias("bad_coordinates"))
    return one.withColumn("passed", (F.col("n") > 0) & (F.col("bad_association") == 0) & (F.col("bad_coordinates") == 0))


def validate_allowed_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """(value, n) of the values that aren't allowed."""
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def clean_overlap_table(df: DataFrame, gene: str, snp: str, start: str, end: str, locations: Sequence[str]) -> DataFrame:
    """Blank rows out, coordinates as whole numbers in order, bands of the locations beside them, integer_findings where a number isn't whole."""
    rows = drop_blank_rows(df, [gene, snp])
    a, b = (nz.coerce_integer(F.col(c)) for c in (start, end))
    span = nz.ordered_span(a, b)
    odd = [F.when(F.col(c).isNotNull() & x.isNull(), c) for c, x in ((start, a), (end, b))]
    findings = F.array_join(F.array_compact(F.array(*odd)), ",")
    bands = {f"{c}_band": nz.extract_cytoband(F.col(c)) for c in locations}
    return rows.withColumns({"__s": span, "integer_findings": findings, **bands}).withColumns({start: F.col("__s.low"), end: F.col("__s.high")}).drop("__s")


def missing_consequence_gate(df: DataFrame, key: str, consequence: str) -> DataFrame:
    """One row (n_missing, passed)."""
    none = F.coalesce(F.trim(consequence), F.lit("")) == ""
    return df.agg(F.count_distinct(F.when(none, F.col(key))).alias("n_missing")).withColumn("passed", F.col("n_missing") == 0)


def af_missing_report(df: DataFrame, key: str, af: str) -> DataFrame:
    return df.where(F.col(af).isNull()).select(key).distinct()


def hub_spoke_edges(counts: DataFrame, pathway: str, gene: str, n: str) -> DataFrame:
    """(src, dst, weight) from each pathway to its genes; genes without one hang on Unassigned."""
    return counts.select(F.coalesce(pathway, F.lit("Unassigned")).alias("src"), F.col(gene).alias("dst"), F.col(n).alias("weight"))


# Names under which the columns of an edge and a node table come.
EDGE_NAMES = {"gene_a": "a", "source": "a", "node1": "a", "gene_b": "b", "target": "b", "node2": "b", "string_score": "score", "combined_score": "score", "weight": "score"}
NODE_NAMES = {"Gene_Symbol": "gene", "Gene": "gene", "node": "gene", "Functional_Cluster": "functional_cluster", "Longevity_Class": "longevity_class"}


def build_gene_network(edges: DataFrame, nodes: DataFrame, floor: float = 0.15, cluster: str = "Unassigned", cls: str = "context-dependent") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): genes with their usual symbols, cluster and class (defaults where they lack), and the merged undirected edges
    at the floor or above between known genes. Columns may come under the names above."""
    named = nz.rename_aliases(nodes, NODE_NAMES)
    lacking = {c: F.lit(None).cast("string") for c in ("functional_cluster", "longevity_class") if c not in named.columns}
    named = named.withColumns(lacking).withColumn("gene", nz.map_legacy_symbol(F.col("gene"))["symbol"])
    known = named.where(F.col("gene") != "").groupBy("gene").agg(
        F.coalesce(F.min(F.when(F.trim("functional_cluster") != "", F.trim("functional_cluster"))), F.lit(cluster)).alias("functional_cluster"),
        F.coalesce(F.min(F.when(F.trim("longevity_class") != "", F.trim("longevity_class"))), F.lit(cls)).alias("longevity_class"),
    )
    drawn = nz.rename_aliases(edges, EDGE_NAMES)
    drawn = drawn.withColumns({c: nz.map_legacy_symbol(F.col(c))["symbol"] for c in ("a", "b")}).withColumn("score", F.col("score").cast("string").try_cast("double"))
    return known, merge_undirected_edges(filter_edges(drawn, "a", "b", "score", known, "gene", floor), "a", "b", "score", floor)

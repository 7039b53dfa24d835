"""Findings, reconciliation, consequence tables, lookups, graphs, regions and text scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agewise.functions.lineage import settle
from agewise.functions.ranges import in_ranges


def reconcile_tables(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(kind, key, column, left, right): keys of one side only and unequal cells (null-safe)."""
    a = left.select(key, F.struct(*columns).alias("l"))
    b = right.select(key, F.struct(*columns).alias("r"))
    both = a.join(b, key, "full_outer")
    none = F.lit(None).cast("string")
    alone = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only")

    def row(kind: Column, column: Column, x: Column, y: Column) -> Column:
        return F.struct(kind.alias("kind"), column.alias("column"), x.alias("left"), y.alias("right"))

    cells = [F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), row(F.lit("mismatch"), F.lit(c), F.col(f"l.{c}").cast("string"), F.col(f"r.{c}").cast("string"))) for c in columns]
    found = F.when(alone.isNotNull(), F.array(row(alone, none, none, none))).otherwise(F.array_compact(F.array(*cells)))
    return both.select(key, F.explode(found).alias("f")).select(key, "f.*")


def missing_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.select(F.col(left_key).alias("key")).distinct().join(right.select(F.col(right_key).alias("key")).distinct(), "key", "left_anti")


def stated_vs_computed(metrics: DataFrame, stated: dict[str, int]) -> DataFrame:
    """``metrics`` (metric, computed) beside the stated figures: MATCH, MISMATCH, or NEEDS REVIEW where one is lacking."""
    known = metrics.sparkSession.createDataFrame(list(stated.items()), "metric string, stated long")
    status = F.when(F.col("stated").isNull() | F.col("computed").isNull(), "NEEDS REVIEW").when(F.col("stated") == F.col("computed"), "MATCH").otherwise("MISMATCH")
    return metrics.join(known, "metric", "full_outer").withColumn("status", status)


def snp_count_definitions(df: DataFrame, gene: str, alias: str, canonical: str) -> DataFrame:
    """Rows, distinct (gene, alias) and distinct (gene, canonical id) without nulls, as (metric, computed)."""
    pair = F.when(F.col(canonical).isNotNull(), F.struct(gene, canonical))
    one = df.agg(F.count("*").alias("raw_rows"), F.count_distinct(F.struct(gene, alias)).alias("distinct_pairs"), F.count_distinct(pair).alias("canonical_pairs"))
    return one.unpivot([], ["raw_rows", "distinct_pairs", "canonical_pairs"], "metric", "computed")


def association_gene_counts(df: DataFrame, gene: str, significant: Column) -> DataFrame:
    per = df.groupBy(gene).agg(F.bool_or(significant).alias("s"), F.bool_or(~significant).alias("o"))
    return per.agg(F.count_if("s").alias("significant"), F.count_if("o").alias("non_significant"), F.count_if(F.col("s") & F.col("o")).alias("in_both"))


def consequence_crosstab(df: DataFrame, consequence: str, cls: str, classes: Sequence[str]) -> DataFrame:
    wide = df.groupBy(consequence).agg(*[F.count_if(F.col(cls) == c).alias(c) for c in classes], F.count("*").alias("total"))
    return wide.orderBy(F.desc("total"), consequence)


def genes_by_group(df: DataFrame, group: str, gene: str, item: str) -> DataFrame:
    """Genes of each group in order of falling counts of distinct items, then name."""
    counts = df.groupBy(F.coalesce(group, F.lit("Unassigned")).alias(group), gene).agg(F.count_distinct(item).alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(gene).alias("g"), "n")))
    return counts.groupBy(group).agg(order.alias("o")).select(
        group, F.array_join(F.transform("o", lambda x: F.format_string("%s (%d)", x["g"], x["n"])), ", ").alias("genes"), F.size("o").cast("long").alias("n_genes")
    )


def lookup_cascade(keys: DataFrame, tables: Sequence[tuple[str, DataFrame, str]], value: str) -> DataFrame:
    """The first value that the tables (method, table, key column) give, and the method; null and none without any. Of a table's
    values for a key the least counts."""
    out = keys
    found, method = [], F.lit("none")
    for k, (name, table, key) in enumerate(tables):
        one = table.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(f"__v{k}"))
        out = out.join(one, key, "left")
        found.append((name, F.col(f"__v{k}")))
    for name, v in reversed(found):
        method = F.when(v.isNotNull(), name).otherwise(method)
    return out.select(*keys.columns, F.coalesce(*[v for _, v in found]).alias(value), method.alias("method"))


def position_in_span(points: DataFrame, spans: DataFrame, key: str, pos: str, start: str, end: str) -> DataFrame:
    """yes, no, or NA where the key has no span or a part is missing; spans may be reversed."""
    joined = points.join(spans.select(key, start, end), key, "left")
    inside = F.col(pos).between(F.least(start, end), F.greatest(start, end))
    whole = F.col(pos).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()
    return joined.withColumn("in_span", F.when(~whole, "NA").when(inside, "yes").otherwise("no"))


#: Sizes of bins: the least, and how many times the last each next one is.
LEAST_BIN, BIN_STEP, BIN_LEVELS = 16, 8, 12


def _bin_size(level: Column) -> Column:
    return F.lit(LEAST_BIN).cast("long") * F.pow(F.lit(float(BIN_STEP)), level).cast("long")


def _levelled(rows: DataFrame, start: str, end: str) -> DataFrame:
    """``rows`` with the level of the least bins as long as the interval, which thus lies in two of them at most."""
    length = F.abs(F.col(end) - F.col(start)) + 1
    level = F.lit(0)
    for k in range(BIN_LEVELS - 1):
        level = level + F.when(length > LEAST_BIN * BIN_STEP**k, 1).otherwise(0)
    return rows.withColumn("__own", level)


def _in_bins(rows: DataFrame, start: str, end: str) -> DataFrame:
    low, high = (F.floor(f(start, end) / _bin_size(F.col("__level"))) for f in (F.least, F.greatest))
    return rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__b", F.explode(F.sequence(low, high)))


def annotate_intervals(regions: DataFrame, genes: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of overlapping closed intervals on a chromosome. Columns of ``genes`` get the prefix gene_.

    Bins come in levels, each eight times as large as the last. An interval is at home in the bins of its own length, two at most. A pair
    meets at the level of its longer one: that one is at home there, and the shorter goes up to it, to two bins at most; so an interval has
    two copies for each level at which the other table has homes, whatever its length, and long and short ones may be mixed. A
    pair counts in the first bin that it shares. Intervals without an end, or on no chromosome, overlap nothing.
    """
    genes = genes.select(F.col(chrom), *[F.col(c).alias(f"gene_{c}") for c in genes.columns if c != chrom])
    sides = [(_levelled(regions, start, end), start, end), (_levelled(genes, f"gene_{start}", f"gene_{end}"), f"gene_{start}", f"gene_{end}")]
    levels = [sorted(r[0] for r in rows.select("__own").distinct().collect() if r[0] is not None) for rows, _, _ in sides]  # BIN_LEVELS numbers at most

    def home(k: int) -> DataFrame:
        rows, a, b = sides[k]
        return _in_bins(rows.withColumn("__level", F.col("__own")), a, b).drop("__own")

    def gone_up(k: int, own_too: bool) -> DataFrame:
        rows, a, b = sides[k]
        there = F.array(*[F.lit(n) for n in levels[1 - k]]).cast("array<int>")
        up = F.filter(there, lambda n: (n > F.col("__own")) | (F.lit(own_too) & (n == F.col("__own"))))
        return _in_bins(rows.withColumn("__level", F.explode(up)), a, b).drop("__own")

    keys = [chrom, "__level", "__b"]
    met = home(0).join(gone_up(1, True), keys).unionByName(gone_up(0, False).join(home(1), keys))
    overlap = (F.col(start) <= F.col(f"gene_{end}")) & (F.col(f"gene_{start}") <= F.col(end))
    once = F.col("__b") == F.floor(F.greatest(F.col(start), F.col(f"gene_{start}")) / _bin_size(F.col("__level")))
    return met.where(overlap & once).drop("__b", "__level")


def call_regions(sites: DataFrame, group: str, pos: str, p: str, max_gap: int, max_p: float, min_sites: int) -> DataFrame:
    """Runs of significant sites no further than ``max_gap`` apart, with at least ``min_sites``.

    Sites are dealt by sampled ranges of group and place and joined to runs within each, so that no task needs a whole group; only the first
    and the last run of a range can go on in its neighbours, and these alone are joined across ranges. Writes a table. A site
    without a place is a run of its own.
    """
    ranged = in_ranges(sites.where(F.col(p) < max_p).select(group, pos, p), [group, pos], "sites")
    inside = Window.partitionBy(group, "__range")
    gap = F.col(pos) - F.lag(pos).over(inside.orderBy(pos))
    run = F.sum(F.when(gap <= max_gap, 0).otherwise(1)).over(inside.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    of_run = [F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n_sites"), F.min(p).alias("min_p")]
    runs = ranged.withColumn("__i", run).groupBy(group, "__range", "__i").agg(*of_run)
    runs = settle(runs.withColumn("__border", (F.col("__i") == 1) | (F.col("__i") == F.max("__i").over(inside))), "runs")
    order = Window.partitionBy(group).orderBy("start")
    across = runs.where("__border").withColumn("__new", F.when(F.col("start") - F.lag("end").over(order) <= max_gap, 0).otherwise(1))
    across = across.withColumn("__j", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    across = across.groupBy(group, "__j").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_sites").alias("n_sites"), F.min("min_p").alias("min_p")).drop("__j")
    return runs.where(~F.col("__border")).select(*across.columns).unionByName(across).where(F.col("n_sites") >= min_sites)


def merge_undirected_edges(edges: DataFrame, a: str, b: str, score: str, floor: float = 0.15) -> DataFrame:
    """(a, b, weight) with a < b and the largest score; scores over 1 are thousandths. The floor comes before that."""
    kept = edges.where((F.col(score) >= floor) & (F.col(a) != F.col(b)))
    s = F.when(F.col(score) > 1, F.col(score) / 1000).otherwise(F.col(score))
    return kept.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(s).alias("weight"))


def degree_centrality(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Degree and degree / (n - 1) of every node, 0 for those alone."""
    ends = edges.select(F.col("a").alias(node)).unionByName(edges.select(F.col("b").alias(node)))
    degrees = ends.groupBy(node).agg(F.count("*").alias("degree"))
    n = nodes.agg(F.count("*").alias("__n"))
    out = nodes.select(node).join(degrees, node, "left").na.fill(0, ["degree"]).crossJoin(F.broadcast(n))
    return out.select(node, "degree", F.when(F.col("__n") > 1, F.col("degree") / (F.col("__n") - 1)).otherwise(0.0).alias("centrality"))


def scan_restricted_patterns(docs: DataFrame, id_col: str, text_col: str, patterns: dict[str, str], ignore: Sequence[str] = ("0000000",)) -> DataFrame:
    """(id, line, pattern, match): the first match of each pattern in each line, line numbers from 1."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "__t"))
    hits = F.array(*[F.struct(F.lit(name).alias("pattern"), F.get(F.filter(F.regexp_extract_all("__t", F.lit(rx), 0), lambda m: ~m.isin(*ignore)), F.lit(0)).alias("match")) for name, rx in patterns.items()])
    return lines.select(id_col, (F.col("line") + 1).cast("long").alias("line"), F.explode(F.filter(hits, lambda h: h["match"].isNotNull())).alias("h")).select(id_col, "line", "h.*")

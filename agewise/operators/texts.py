"""Scans of documents and file listings for terms, files and paths that shouldn't be there."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns of old gene names in text, and the symbols in use.
LEGACY_TERMS = {
    r"cholesteryl ester transfer protein\s*\(CETP\)": "CETP",
    r"cholesteryl ester transfer protein": "CETP",
    r"HLA class II DQ beta chain": "HLA-DQB1",
    r"HLA class II DQ beta": "HLA-DQB1",
    r"(?<!HLA-)(?<![\w-])DQB1(?![\w*])": "HLA-DQB1",
    r"\bDQB103\b": "HLA-DQB1",
    r"\bDQB105\b": "HLA-DQB1",
    r"DQB1\*03": "HLA-DQB1",
    r"DQB1\*05": "HLA-DQB1",
    r"HLA-DQB1\*03": "HLA-DQB1",
    r"HLA-DQB1\*05": "HLA-DQB1",
    r"\bHLA-DQ\b": "HLA-DQB1",
    r"\bCETP\b": "CETP",
    r"\bHSP70-1A\b": "HSPA1A",
    r"\bHSP70-1B\b": "HSPA1B",
    r"\bHSP70-Hom\b": "HSPA1L",
    r"\bHSP70-1\b": "HSPA1A",
    r"\bHSP70-2\b": "HSPA1B",
}
# File types that may hold restricted data, and those that may above a size.
RESTRICTED_SUFFIXES = ("csv", "tsv", "xlsx", "sqlite", "bam", "pod5")
LARGE_SUFFIXES = ("ped",)


def scan_legacy_terms(docs: DataFrame, id_col: str, text_col: str, terms: Mapping[str, str] = LEGACY_TERMS) -> DataFrame:
    """(id, found, symbol, n): old names in each text with the symbol in use, once for each spelling. The longest pattern that fits a
    place counts, and places don't overlap; names that are the symbol itself are left out."""
    ordered = sorted(terms, key=lambda p: (-len(p), p))
    text = F.regexp_replace(text_col, r"\s+", " ")
    hits = F.regexp_extract_all(text, F.lit("(?i)" + "|".join(f"(?:{p})" for p in ordered)), F.lit(0))
    each = docs.select(id_col, F.explode(hits).alias("found")).groupBy(id_col, "found").agg(F.count("*").alias("n"))
    symbol = F.coalesce(*[F.when(F.col("found").rlike(f"(?i)^(?:{p.replace(chr(92) + 'b', '')})$"), terms[p]) for p in ordered])
    return each.withColumn("symbol", symbol).where(F.upper("found") != F.upper("symbol")).select(id_col, "found", "symbol", "n")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of all files of a tree; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))


def scan_restricted_files(files: DataFrame, suffixes: Sequence[str] = RESTRICTED_SUFFIXES, large: Sequence[str] = LARGE_SUFFIXES, most: int = 1 << 20) -> DataFrame:
    """(path, bytes, reason) of the files (path, bytes) of a restricted type, and of tables of ``most`` bytes or more."""
    low = F.lower("path")
    typed, table = (F.exists(F.array(*[F.lit("." + s) for s in names]), lambda s: F.endswith(low, s)) for names in (suffixes, large))
    reason = F.when(typed, "restricted type").when(table & (F.col("bytes") >= most), "large table")
    return files.select("path", "bytes", reason.alias("reason")).where(F.col("reason").isNotNull())


def scan_absolute_paths(docs: DataFrame, id_col: str, text_col: str, allowed: Sequence[str] = ("/dev/", "/tmp/", "/usr/bin/env", "/bin/")) -> DataFrame:
    """(id, path, n): absolute paths in quotes that don't begin like an allowed one."""
    found = F.regexp_extract_all(text_col, F.lit(r"""["'](/[A-Za-z0-9_.][^"'\s<>]*)["']"""), F.lit(1))
    each = docs.select(id_col, F.explode(found).alias("path"))
    for prefix in allowed:
        each = each.where(~F.col("path").startswith(prefix))
    return each.groupBy(id_col, "path").agg(F.count("*").alias("n"))

"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Python's ``bytes.split()`` splits at exactly these, as do the contracts' words ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset (tests), below a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/agewise/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def need(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Alternates the large-star and small-star steps: every round is two grouped minima with map-side
    combining and two equi joins, and the number of edges never grows. Each round is written to the
    shared folder, so a lost executor costs one round at most. Loops and null ends are ignored.
    """
    a, b = F.col("a"), F.col("b")

    def written(pairs: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        """The pairs, and their number and the sum of their hashes, taken while they are written."""
        seen = Observation()
        out = materialise(pairs.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64(a, b).cast("decimal(38,0)")).alias("h")), name)
        return out, (seen.get["n"], seen.get["h"])

    start = edges.dropna(subset=[src, dst]).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    now, mark = written(start.where(a != b).distinct(), "edges")
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where(a != F.col("m")).select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        before = mark
        now, mark = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(b.alias("node"), b.alias("component")).distinct()
    return now.select(a.alias("node"), b.alias("component")).unionByName(roots)

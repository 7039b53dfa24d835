"""Line dedup with levelled sorted runs of line hashes; DataFrame functions only."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agewise.llm.common import WHITE, ascii_lower, materialise, need, shared_dir

#: The columns of a line's hash.
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


class LineRuns:
    """Sorted runs of (k1, k2, n): a line hash and the number of documents that hold it, in levels.

    Runs are tables in the shared folder, bucketed and sorted by key into as many buckets as the session has shuffle
    partitions, so that runs meet each other and a new batch by merge joins without any exchange. A new batch
    merge-anti-joins the settled runs, whose keys are never counted again, and meets the runs of all levels: keys that
    thereby reach ``min_docs`` are settled at once, and the others become a run of level 0. When a level has ``fanout`` runs,
    they are merged into one run of the next level, without the keys settled since. The driver holds only their relations.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []
        self.root = shared_dir(spark, "runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"agewise_run_{uuid.uuid4().hex}"
        write = run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}")
        write.saveAsTable(name)
        held = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files and the relation stay
        return held

    def _merged(self, runs: Sequence[DataFrame]) -> DataFrame:
        """All keys of the runs with their totals; two runs at a time, as only these merge without an exchange."""
        out = runs[0]
        for k, run in enumerate(runs[1:]):
            both = (self._write(out) if k else out).join(run.withColumnRenamed("n", "m"), KEY, "full_outer")
            out = both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def _unsettled(self, run: DataFrame, settled: Sequence[DataFrame]) -> DataFrame:
        for known in settled:
            run = run.join(known, KEY, "left_anti")
        return run

    def add(self, keys: DataFrame) -> None:
        """``keys``: one row (k1, k2) for each document and distinct key in it."""
        batch = self._unsettled(keys.groupBy(*KEY).agg(F.count("*").alias("n")), self.settled)
        total = F.col("n")
        for k, run in enumerate(r for level in self.levels for r in level):
            batch = batch.join(run.withColumnRenamed("n", f"m{k}"), KEY, "left")
            total = total + F.coalesce(f"m{k}", F.lit(0))
        batch = self._write(batch.select(*KEY, "n", total.alias("total")))
        enough = F.col("total") >= self.min_docs
        self.settled.append(self._write(batch.where(enough).select(*KEY)))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(batch.where(~enough).select(*KEY, "n"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self._write(self._unsettled(self._merged(self.levels[level]), self.settled)))
        self.levels[level] = []

    def frequent_keys(self) -> DataFrame:
        """(k1, k2) of every key in at least ``min_docs`` documents so far: a key is settled with the batch that brings its total there."""
        return reduce(DataFrame.unionByName, self.settled) if self.settled else self.spark.createDataFrame([], "k1 long, k2 long")


def dedup_lines(
    docs: DataFrame,
    *,
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """``docs`` with the columns n_lines, n_dropped and kept_text after its own.

    A text is split at newlines; a line's key is the line without white space at its ends, A-Z lower-cased.
    Every line whose key has at least ``min_chars`` code points and is found in at least ``min_docs`` rows is
    dropped everywhere; the others stay in order, joined by newlines. The rows are dealt into
    ``batches`` batches, each added to a :class:`LineRuns` in turn.

    Every row counts as a document of its own, also one that repeats another or has a null id. A null or empty
    text is one empty line, which is never dropped, and kept_text is then empty; a text that loses all its
    lines is empty too. Own columns named n_lines, n_dropped or kept_text are replaced. Keys are compared by two
    64-bit hashes.
    """
    need(docs, [text_col])
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(*own, text.alias("__text"))
    row = [F.xxhash64("__text"), F.xxhash64(F.lit(7), "__text")]
    lines = F.split(F.col("__text"), "\n", -1)
    hashed = docs.select(
        F.monotonically_increasing_id().alias("__w"),
        row[0].alias("d1"),
        row[1].alias("d2"),
        F.transform(lines, line_key).alias("ks"),
    )
    each = F.transform(
        F.col("ks"),
        lambda k: F.when(F.char_length(k) >= max(1, min_chars), F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit(11), k).alias("k2"))),
    )
    path = shared_dir(spark, "lines")
    (
        hashed.select(F.pmod("__w", F.lit(batches)).cast("int").alias("batch"), "d1", "d2", each.alias("ks"))
        .write.partitionBy("batch")
        .parquet(path)
    )
    schema = "d1 long, d2 long, ks array<struct<k1: long, k2: long>>, batch int"
    stored = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        one = stored.where(F.col("batch") == b)
        runs.add(one.select(F.explode(F.array_distinct(F.filter("ks", lambda k: k.isNotNull()))).alias("k")).select("k.*"))
    frequent = runs.frequent_keys()
    # rows with one text lose the same lines, so the positions are found once for each text
    placed = stored.select("d1", "d2", F.posexplode("ks").alias("pos", "k")).where(F.col("k").isNotNull())
    lost = (
        placed.select("d1", "d2", "pos", "k.*")
        .join(frequent, ["k1", "k2"], "left_semi")
        .groupBy("d1", "d2")
        .agg(F.collect_set("pos").alias("lost"))
    )
    # written first, so that the join reads two plain shuffles and a text with very many copies can be split among tasks
    lost = materialise(lost, "lost")
    joined = docs.withColumns({"d1": row[0], "d2": row[1]}).join(lost, ["d1", "d2"], "left")
    n = F.size(lines).cast("long")
    kept = F.transform(
        F.array(F.struct(lines.alias("l"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost")).alias("at"))),
        lambda x: F.array_join(F.transform(x["at"], lambda i: F.get(x["l"], i)), "\n"),
    )[0]
    return joined.select(
        *own,
        n.alias("n_lines"),
        F.when(F.col("lost").isNull(), F.lit(0)).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("__text")).otherwise(kept).alias("kept_text"),
    )

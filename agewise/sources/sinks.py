"""Writers of result tables; each writes from the executors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sink_parquet(tables: Mapping[str, DataFrame], directory: str, mode: str = "errorifexists") -> None:
    """Each table to a folder of its name."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{directory.rstrip('/')}/{name}")


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def sink_json_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON object for each row, such as the one row of a clock's metrics; nulls are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def sink_commented_csv(df: DataFrame, path: str, note: str, mode: str = "errorifexists") -> None:
    """CSV under a line of comment and a header. Rows are one file, as only its first lines may be these: for result tables, not
    for corpora."""
    first = df.sparkSession.createDataFrame([(0, "# " + note.replace("\n", " ")), (1, ",".join(df.columns))], "o long, value string")
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    rows = df.select(F.lit(2).cast("long").alias("o"), F.to_csv(F.struct(*cells)).alias("value"))
    first.unionByName(rows).coalesce(1).sortWithinPartitions("o").select("value").write.mode(mode).text(path)


def sink_audit_table(findings: DataFrame, path: str, run: str) -> None:
    """Append the findings of a run, as JSON, in a folder for each run."""
    findings.withColumn("run", F.lit(run)).write.mode("append").option("ignoreNullFields", False).partitionBy("run").json(path)


def save_long_matrix(matrix: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """A long matrix as Parquet, in folders by the columns ``by`` (such as the chromosome)."""
    write = matrix.write.mode(mode)
    (write.partitionBy(*by) if by else write).parquet(path)

"""Writing DataFrames: stages, records and text files.

Text writers give lines in order: rows are range-partitioned by their order, so the parts of the output, read by name,
are in order. A write fails loudly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx


def save_stage(df: DataFrame, path: str, *, level: int = 10) -> None:
    """Parquet with zstd of the given level."""
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)


def save_version(df: DataFrame, root: str) -> str:
    """Writes a new version of a table next to the old ones, then points to it; readers of the old version are not disturbed. Returns its folder."""
    spark = df.sparkSession
    where = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    spark.createDataFrame([(where,)], "path string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/_current")
    return where


def current_version(spark: SparkSession, root: str) -> DataFrame:
    where = spark.read.text(f"{root.rstrip('/')}/_current").first()
    if where is None:
        raise FileNotFoundError(root)
    return spark.read.parquet(where[0])


def write_lines(df: DataFrame, path: str, line: Column, *order: str) -> None:
    """One line a row, in order."""
    rows = df.select(line.alias("value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    if order:
        by = [f"_o{i}" for i in range(len(order))]
        rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    rows.select("value").write.mode("overwrite").text(path)


def _cell(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def matrix_line(row: str = "row") -> Column:
    """A row's values between tabs."""
    return F.array_join(F.transform(F.col(row), _cell), "\t")


def matrix_lines(df: DataFrame, blank: int = 1) -> DataFrame:
    """m, i, line of matrices (m, i, row): rows between tabs, matrices separated by blank lines."""
    rows = df.select("m", F.col("i").cast("int").alias("i"), matrix_line().alias("line"))
    gaps = df.select("m").distinct().join(df.agg(F.min("m").alias("least")), how="cross").where("m > least").select("m", F.explode(F.sequence(F.lit(-blank), F.lit(-1))).alias("i"), F.lit("").alias("line"))
    return rows.unionByName(gaps) if blank else rows


def table_lines(df: DataFrame) -> Column:
    """All columns of a row between tabs."""
    return F.concat_ws("\t", *[_cell(F.col(f"`{c}`")) for c in df.columns])


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated with a header, without index."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def json_lines(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def qa_line(question: Column, context: Column, answer: Column) -> Column:
    """One entry of the question log, its context in ASCII."""
    return F.concat(F.lit("Q: "), question, F.lit("\n"), tx.ascii_only(F.coalesce(context, F.lit(""))), F.lit("\nA: "), F.coalesce(answer, F.lit("")))

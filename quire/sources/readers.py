"""Reading files into DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as tx


def documents(spark: SparkSession, path: str, *, pattern: str = "*") -> DataFrame:
    """document_id, path, text, encoding of every file. UTF-8 files: spaces and tabs squeezed, cleaned, line breaks kept; others are read as Latin-1 and put on one line. A missing path raises."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))


def decoded(files: DataFrame) -> DataFrame:
    """documents() of rows with path and content."""
    raw = files.select("path", "content")
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    # line ends as text files have them
    newline = lambda c: F.regexp_replace(c, "\\r\\n?", "\n")
    text = F.when(utf8, tx.clean(tx.squeeze(newline(F.col("content").cast("string"))))).otherwise(tx.one_line(F.decode("content", "ISO-8859-1")))
    return raw.select(tx.document_id("path").alias("document_id"), "path", text.alias("text"), F.when(utf8, "utf-8").otherwise("latin-1").alias("encoding"))


def library_files(spark: SparkSession, path: str, *, pdf_text: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """document_id, path, text, success by file extension, in either case: .txt and .md as UTF-8; .pdf by the extractor given, pages joined by line breaks; others, files that cannot be read, and .pdf without extractor have success false."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind = p.rsplit(".", 1)[-1].lower()
                try:
                    out.append(content.decode("utf-8") if kind in ("txt", "md") else "\n".join(pdf_text(content)) if kind == "pdf" and pdf_text else None)
                except Exception:  # a file that cannot be read is an outcome
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "text"])

    rows = raw.mapInArrow(run, "path string, text string")
    return rows.select(tx.document_id("path").alias("document_id"), "path", "text", F.col("text").isNotNull().alias("success"))


def series(spark: SparkSession, path: str, *, live: bool = False) -> DataFrame:
    """A CSV file with a header: Date as a date of its first ten characters, every other column as a number (a bad value raises). live: the file of the same name with _Live."""
    where = path[: -len(".csv")] + "_Live.csv" if live and path.endswith(".csv") else path
    raw = spark.read.option("header", True).csv(where)
    return raw.select(F.to_date(F.substring("Date", 1, 10), "yyyy-MM-dd").alias("Date"), *[F.col(f"`{c}`").cast("double").alias(c) for c in raw.columns if c != "Date"])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, i, line of text files, in order within each file. A file is one row while it is split, as its lines have no number of their own."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\\r\\n?", "\n").alias("v"))
    each = rows.select("file", F.posexplode(F.split(F.regexp_replace("v", "\\n\\z", ""), "\n", -1)).alias("i", "line"))
    return each


def matrix(spark: SparkSession, path: str, *, separator: str = "\\s+", numbers: bool = True) -> DataFrame:
    """i, row of a file of rows: numbers between white space, or (numbers=False) stripped strings between a separator."""
    rows = lines(spark, path).where(F.length(F.trim("line")) > 0)
    order = F.row_number().over(Window.partitionBy("file").orderBy("i")) - 1
    parts = F.split(tx.strip("line"), separator, -1)
    cells = F.transform(parts, lambda x: x.cast("double")) if numbers else F.transform(parts, tx.strip)
    return rows.select("file", order.alias("i"), cells.alias("row"))


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """m, i, row: matrices separated by blank lines."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\\r\\n?", "\n").alias("v"))
    each = rows.select(F.posexplode(F.filter(F.split("v", "\\n[ \\t]*\\n\\s*", -1), lambda x: F.length(tx.strip(x)) > 0)).alias("m", "body"))
    inner = each.select("m", F.posexplode(F.filter(F.split("body", "\n", -1), lambda x: F.length(tx.strip(x)) > 0)).alias("i", "line"))
    return inner.select("m", "i", F.transform(F.split(tx.strip("line"), "\\s+", -1), lambda x: x.cast("double")).alias("row"))


def flat_numbers(spark: SparkSession, path: str) -> DataFrame:
    """i, value: one number a line."""
    return lines(spark, path).where(F.length(F.trim("line")) > 0).select("i", F.trim("line").cast("double").alias("value"))


def json_object(spark: SparkSession, path: str) -> DataFrame:
    """value: a JSON file as one value of any shape."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("value"))

"""The text tables, as the operators of this subpackage take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.session import table


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_id, text of chunks and large_blocks."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "row_id", "text") for t in ("chunks", "large_blocks")]
    return parts[0].unionByName(parts[1])

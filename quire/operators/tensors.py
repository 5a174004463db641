"""Matrices and tensors in long form: one row an element, its place in columns i, j, k. Row-major."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reshape(df: DataFrame, index: str, value: str, shape: Sequence[int]) -> DataFrame:
    """Elements at their place in a tensor of the shape given, from their number."""
    names = ("i", "j", "k", "l")[: len(shape)]
    rest, out = F.col(index), []
    for size in reversed(shape[1:]):
        out.append(rest % size)
        rest = F.floor(rest / size)
    places = [rest, *reversed(out)]
    return df.where((F.col(index) >= 0) & (F.col(index) < reduce(lambda a, b: a * b, shape))).select(*[p.cast("int").alias(n) for p, n in zip(places, names, strict=True)], F.col(value).alias("value"))


def flatten(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    """index, value from places."""
    names = ("i", "j", "k", "l")[: len(shape)]
    index = reduce(lambda a, p: a * p[1] + F.col(p[0]), zip(names[1:], shape[1:], strict=True), F.col(names[0]).cast("bigint"))
    return df.select(index.alias("index"), "value")


def merged(parts: Sequence[DataFrame], sizes: Sequence[int], width: int) -> DataFrame:
    """i, j, value of flat parts (index, value), one after another, in rows of a width; the last row is filled with zeros."""
    offsets = [sum(sizes[:n]) for n in range(len(sizes))]
    total = sum(sizes)
    whole = reduce(DataFrame.unionByName, [p.select((F.col("index") + o).alias("index"), F.col("value").cast("double").alias("value")) for p, o in zip(parts, offsets, strict=True)])
    missing = -total % width
    if missing:
        pad = whole.sparkSession.range(total, total + missing).select(F.col("id").alias("index"), F.lit(0.0).alias("value"))
        whole = whole.unionByName(pad)
    return reshape(whole, "index", "value", (-(-total // width), width))


def equal(a: DataFrame, b: DataFrame, keys: Sequence[str], *, value: str = "value", tolerance: float = 0.0, relative: float = 0.0) -> DataFrame:
    """One row: equal, and the number of places that differ or stand on one side only. |a - b| <= tolerance + relative |b|; nulls equal each other."""
    x, y = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l")), b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    both = x.join(y, list(keys), "full_outer")
    if dict(a.dtypes)[value] in ("boolean", "string"):
        near = F.col("_a").eqNullSafe(F.col("_b"))
    else:
        near = F.col("_a").eqNullSafe(F.col("_b")) | F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance + relative * F.abs(F.col("_b")), F.lit(False))
    wrong = F.count_if(~near | F.col("_l").isNull() | F.col("_r").isNull())
    return both.agg(wrong.alias("different")).select((F.col("different") == 0).alias("equal"), "different")


def sampled(df: DataFrame, key: str, share: float, seed: int = 23) -> DataFrame:
    """int(n share) rows without replacement, the same for a seed: a sampling operator."""
    n = int(df.count() * share)
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def distinct_numbers(df_or_spark, n: int, most: int, seed: int = 23) -> DataFrame:
    """value: n different numbers from 0 to most - 1, in random order, the same for a seed."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return spark.range(most).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select(F.col("id").alias("value"))


def block_starts(spark, length: int, block: int, n: int, seed: int = 23) -> DataFrame:
    """value: n starts of non-overlapping blocks within a length, in random order, the same for a seed: the free room is divided at n random places, so every arrangement can come up."""
    if n * block > length:
        raise ValueError("blocks do not fit")
    room = length - n * block
    cuts = spark.range(n).select(F.col("id").alias("b"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(room + 1)).alias("gap"))
    order = F.row_number().over(Window.orderBy("gap", "b")) - 1
    placed = cuts.select("b", (F.col("gap") + order * block).cast("bigint").alias("value"))
    return placed.orderBy(F.xxhash64("b", F.lit(seed + 1))).select("value")

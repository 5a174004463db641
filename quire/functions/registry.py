"""Functions of this package for use in SQL text."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.operators import nested_values as nv


def _value(text):
    try:
        return json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return None


class _Outline:
    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        value = _value(text)
        if value is not None:
            for i, (level, line) in enumerate(nv.outline(value)):
                yield i, level, line


def register(spark: SparkSession) -> list[str]:
    """Registers quire_outline(json) as a table function and quire_nested_size, quire_nested_kind (json) and quire_find (json, text) as vectorised functions. Returns their names."""

    @F.pandas_udf("bigint")
    def nested_size(s: pd.Series) -> pd.Series:
        return pd.Series([None if (v := _value(x)) is None else nv.size(v) for x in s], dtype="Int64")

    @F.pandas_udf("string")
    def nested_kind(s: pd.Series) -> pd.Series:
        return pd.Series([None if (v := _value(x)) is None else nv.kind(v) for x in s], dtype=object)

    @F.pandas_udf("string")
    def find(s: pd.Series, sought: pd.Series) -> pd.Series:
        return pd.Series([None if (v := _value(x)) is None or y is None else nv.find(v, y) for x, y in zip(s, sought, strict=True)], dtype=object)

    spark.udtf.register("quire_outline", F.udtf(_Outline, returnType="ord int, level int, line string"))
    for name, f in (("quire_nested_size", nested_size), ("quire_nested_kind", nested_kind), ("quire_find", find)):
        spark.udf.register(name, f)
    return ["quire_outline", "quire_nested_size", "quire_nested_kind", "quire_find"]


def measure(action: Callable[[], object], times: int = 3) -> float:
    """Mean seconds of an action."""
    began = time.perf_counter()
    for _ in range(times):
        action()
    return (time.perf_counter() - began) / times

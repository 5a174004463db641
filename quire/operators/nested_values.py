"""Walks over nested JSON values: outlines, searches, sizes, types.

A walk is one pass over a row's own value, in Arrow batches. Unreadable and null texts give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import CLEANING


def outline(value, level: int = 1, *, own_lines: bool = False) -> Iterator[tuple[int, str]]:
    """(level, line) in pre-order. Children of the root stand at level 1. ``key: value`` on one line and list items as key[i] from 0; with own_lines the key on a line of its own, list items as item_i from 1."""
    if isinstance(value, dict):
        pairs = list(value.items())
    elif isinstance(value, list):
        pairs = [(f"item_{i + 1}" if own_lines else f"[{i}]", x) for i, x in enumerate(value)]
    else:
        yield level, _plain(value)
        return
    for key, x in pairs:
        key = _plain(key)
        if isinstance(x, dict):
            yield level, key
            yield from outline(x, level + 1, own_lines=own_lines)
        elif isinstance(x, list):
            yield level, key
            for i, item in enumerate(x):
                name = f"item_{i + 1}" if own_lines else f"{key}[{i}]"
                if isinstance(item, (dict, list)):
                    yield level + 1, name
                    yield from outline(item, level + 2, own_lines=own_lines)
                elif own_lines:
                    yield level + 1, name
                    yield level + 2, _plain(item)
                else:
                    yield level + 1, f"{name}: {_plain(item)}"
        elif own_lines:
            yield level, key
            yield level + 1, _plain(x)
        else:
            yield level, f"{key}: {_plain(x)}"


def _plain(x) -> str:
    s = x if isinstance(x, str) else json.dumps(x) if isinstance(x, (dict, list, bool)) or x is None else str(x)
    for bad, good in CLEANING:
        s = s.replace(bad, good)
    return s.strip().encode("ascii", "ignore").decode()


def find(value, sought: str, path: tuple[str, ...] = ()) -> str | None:
    """Comma-joined path of the first value, depth first, that holds a string. Keys are not searched, null never holds it."""
    if isinstance(value, dict):
        items = value.items()
    elif isinstance(value, list):
        items = ((str(i), x) for i, x in enumerate(value))
    else:
        return ",".join(path) if value is not None and sought in str(value) else None
    return next((hit for k, x in items if (hit := find(x, sought, (*path, str(k)))) is not None), None)


def size(value) -> int:
    """Estimated characters of a nested value: keys with 3 signs and their commas, list items with 2 and theirs, leaves as text."""
    if isinstance(value, dict):
        return sum(len(str(k)) + 3 + len(value) - 1 + size(x) for k, x in value.items())
    if isinstance(value, list):
        return sum(size(x) + 2 + len(value) - 1 for x in value)
    return len(str(value))


def kind(value) -> str:
    """Type and dimensions: list 2x3, dict 4, str."""
    dims, at = [], value
    while isinstance(at, list):
        dims.append(len(at))
        at = at[0] if at else None
    name = type(value).__name__
    if isinstance(value, dict):
        return f"{name} {len(value)}"
    return f"{name} {'x'.join(map(str, dims))}" if dims else name


def _walk(df: DataFrame, key: str, text: str, rows_of: Callable, schema: str, types: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(types) + 1)]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(t)
                except (ValueError, RecursionError):
                    continue
                for row in rows_of(value):
                    for column, x in zip(columns, (k, *row), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *types), strict=True)], names=[n.split()[0] for n in schema.split(", ")])

    return df.select(F.col(key).cast("string"), F.col(text).cast("string")).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def outlines(df: DataFrame, key: str, text: str, *, own_lines: bool = False) -> DataFrame:
    """key, ord, level, line: every value as an outline, tabs for levels, ASCII only."""
    rows = _walk(df, key, text, lambda v: [(i, level, "\t" * level + s) for i, (level, s) in enumerate(outline(v, own_lines=own_lines))], "key string, ord int, level int, line string", [pa.int32(), pa.int32(), pa.string()])
    return rows


def searches(df: DataFrame, key: str, text: str, sought: str) -> DataFrame:
    """key, found, path."""
    return _walk(df, key, text, lambda v: [((hit := find(v, sought)) is not None, hit)], "key string, found boolean, path string", [pa.bool_(), pa.string()])


def sizes(df: DataFrame, key: str, text: str) -> DataFrame:
    return _walk(df, key, text, lambda v: [(size(v),)], "key string, chars bigint", [pa.int64()])


def kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    return _walk(df, key, text, lambda v: [(kind(v),)], "key string, kind string", [pa.string()])

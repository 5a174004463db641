"""Deeply nested records as flat tables, by interval labels.

A depth-first walk numbers every node of a record: ``pre`` on entering, ``post`` on leaving, both from one counter.
A node is an ancestor of another exactly if its interval (pre, post) contains the other's, so the tables of any two
node types can be linked later by containment, without a foreign key for each level:

    parent.record_key = child.record_key and parent.pre < child.pre and child.post < parent.post

The direct parent is also given (``parent_pre``), with the child's position in its array (``position``).

Defined results: a null, empty or unreadable text has no nodes; null, "" and {} elements are no nodes but keep their
position; a single value where the schema has an array is an array of one; repeated rows give their nodes again, under
their own key; other members of a record are no nodes; further columns of the input are not read. Depth is bounded by
the JSON decoder only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import analysis_json as aj

NODE_SCHEMA = "record_key bigint, node_type string, node_path string, pre int, post int, parent_pre int, depth int, position int, name string, attributes string"

#: Arrays of an analysis: member path, node type, type of the array that each element holds.
ANALYSIS_ARRAYS = (
    (("entities", "characters"), "character"),
    (("entities", "locations"), "location"),
    (("entities", "organizations"), "organization"),
    (("relationships_interactions",), "interaction"),
    (("events",), "event"),
    (("keywords_topics",), "topic"),
)

_ARROW = pa.schema([
    ("record_key", pa.int64()), ("node_type", pa.string()), ("node_path", pa.string()), ("pre", pa.int32()), ("post", pa.int32()),
    ("parent_pre", pa.int32()), ("depth", pa.int32()), ("position", pa.int32()), ("name", pa.string()), ("attributes", pa.string()),
])


class _Rows:
    """Columns of node rows; numbers intervals within one record at a time."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in _ARROW]
        self.clock = 0

    def record(self, key: int, walk, value) -> None:
        self.key, self.clock = key, 1  # the record itself enters at 0
        walk(self, value)

    def open(self, kind: str, path: str, parent: int, depth: int, position: int, value) -> int:
        pre, self.clock = self.clock, self.clock + 1
        own = {k: v for k, v in value.items() if k not in ("participants", "subsections")} if isinstance(value, dict) else value
        name = aj.name_of(value)
        if name is None and isinstance(value, dict):
            name = next((value[k] for k in ("title", "summary") if isinstance(value.get(k), str)), None)
        row = (self.key, kind, path, pre, -1, parent, depth, position, name, aj.json.dumps(own, ensure_ascii=False))
        for column, x in zip(self.columns, row, strict=True):
            column.append(x)
        return len(self.columns[0]) - 1

    def close(self, row: int) -> None:
        self.columns[4][row], self.clock = self.clock, self.clock + 1

    def flush(self) -> pa.RecordBatch:
        # a text may hold half of a surrogate pair as an escape, which no UTF-8 column can
        arrays = [pa.array([x.encode("utf-8", "replace").decode() if isinstance(x, str) and not x.isascii() else x for x in c] if pa.types.is_string(f.type) else c, f.type) for c, f in zip(self.columns, _ARROW, strict=True)]
        self.columns = [[] for _ in _ARROW]
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _walk_analysis(rows: _Rows, value) -> None:
    root = aj.as_object(value)
    if root is None:
        return
    for path, kind in ANALYSIS_ARRAYS:
        holder = root
        for step in path[:-1]:
            holder = aj.as_object(holder.get(step)) or {}
        for i, x in enumerate(aj.elements(holder.get(path[-1]))):
            if aj.is_nothing(x):
                continue
            at = f"{'.'.join(path)}[{i}]"
            row = rows.open(kind, at, 0, 1, i, x)
            if kind == "interaction":
                pre = rows.columns[3][row]
                for k, p in enumerate(aj.member(x, "participants")):
                    if not aj.is_nothing(p):
                        rows.close(rows.open("participant", f"{at}.participants[{k}]", pre, 2, k, p))
            rows.close(row)


def _walk_structure(rows: _Rows, value) -> None:
    # an explicit stack, as depth is the data's; entries: units still to come of one array
    stack = [(iter(enumerate(aj.structure_units(value))), "structure", 0, 0, -1)]
    while stack:
        units, at, parent, depth, row = stack[-1]
        for i, x in units:
            if aj.is_nothing(x):
                continue
            own = rows.open("structure_unit" if depth == 0 else "subsection", f"{at}[{i}]", parent, depth + 1, i, x)
            stack.append((iter(enumerate(aj.member(x, "subsections"))), f"{at}[{i}].subsections", rows.columns[3][own], depth + 1, own))
            break
        else:
            stack.pop()
            if row >= 0:
                rows.close(row)


def _nodes(df: DataFrame, key: str, text: str, walk, flush_at: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k is not None and (value := aj.load(t)) is not None:
                    rows.record(k, walk, value)
                    if len(rows.columns[0]) >= flush_at:
                        yield rows.flush()
        yield rows.flush()

    source = df.select(F.col(key).cast("bigint"), F.col(text).cast("string")).where(F.col(text).isNotNull())
    return source.mapInArrow(run, NODE_SCHEMA)


def analysis_nodes(df: DataFrame, key: str = "row_id", text: str = "analysis", *, flush_at: int = 20_000) -> DataFrame:
    """Node rows of chunk analyses. One task reads each row once; there is no shuffle."""
    return _nodes(df, key, text, _walk_analysis, flush_at)


def structure_nodes(df: DataFrame, key: str = "row_id", text: str = "structure", *, flush_at: int = 20_000) -> DataFrame:
    """Node rows of document structures, to any depth."""
    return _nodes(df, key, text, _walk_structure, flush_at)


def node_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The flat table of one node type."""
    return nodes.where(F.col("node_type") == kind).drop("node_type")


def link(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Ancestor-descendant pairs of two node tables, by interval containment within a record: an equi-join on the record, whose nodes are few."""
    p, c = parents.alias("p"), children.alias("c")
    inside = (F.col("p.record_key") == F.col("c.record_key")) & (F.col("p.pre") < F.col("c.pre")) & (F.col("c.post") < F.col("p.post"))
    return p.join(c, inside).select(F.col("p.record_key").alias("record_key"), F.col("p.node_path").alias("ancestor_path"), F.col("c.node_path").alias("node_path"), (F.col("c.parent_pre") == F.col("p.pre")).alias("is_parent"))

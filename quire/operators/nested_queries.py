"""Queries of nested.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import json_sql as js
from quire.operators import nested
from quire.plans.session import table


def p7_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All node rows of both tables, with their interval labels."""
    chunks = nested.analysis_nodes(table(spark, sf_dir, "chunks_with_analysis")).withColumn("table_name", F.lit("chunks_with_analysis"))
    docs = nested.structure_nodes(table(spark, sf_dir, "doc_analysis")).withColumn("table_name", F.lit("doc_analysis"))
    return chunks.unionByName(docs)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_nodes(spark, sf_dir).select("table_name", F.col("record_key").alias("row_id"), "node_path")


def p7_structure_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structure unit with the subsections inside it, at any depth."""
    nodes = nested.structure_nodes(table(spark, sf_dir, "doc_analysis"))
    return nested.link(nodes, nested.node_table(nodes, "subsection"))


QUERIES = {"p7_found": p7_found, "p7_nodes": p7_nodes, "p7_structure_links": p7_structure_links}
_ARRAYS = (("entities", "characters"), ("entities", "locations"), ("entities", "organizations"), ("", "relationships_interactions"), ("", "events"), ("", "keywords_topics"))


def _held(holder: str, name: str) -> str:
    inside = js.inner("json_extract(v, '$.entities')") if holder else "v"
    return f"SELECT row_id, '{holder + '.' if holder else ''}{name}' AS path, {js.elements(js.member(inside, name))} AS held FROM object"


def _each(source: str) -> str:
    return f"SELECT row_id, path || '[' || i || ']' AS node_path, x FROM (SELECT row_id, path, unnest(held) AS x, unnest(range(len(held))) AS i FROM {source})"


#: Nodes of both tables: table_name, row_id, node_path.
NODES_SQL = f"""
    WITH RECURSIVE {js.readable("(SELECT row_id, analysis AS text FROM chunks_with_analysis WHERE analysis IS NOT NULL)")},
    {js.objects("root")},
    held AS ({" UNION ALL ".join(_held(*a) for a in _ARRAYS)}),
    outer_nodes AS (SELECT * FROM ({_each("held")}) WHERE NOT {js.is_nothing("x")}),
    people AS (SELECT row_id, node_path || '.participants' AS path, {js.elements(js.member("x", "participants"))} AS held FROM outer_nodes WHERE node_path LIKE 'relationships_interactions%'),
    inner_nodes AS (SELECT * FROM ({_each("people")}) WHERE NOT {js.is_nothing("x")}),
    {js.readable("(SELECT row_id, structure AS text FROM doc_analysis WHERE structure IS NOT NULL)", "tree")},
    unwrapped AS (SELECT row_id, CASE WHEN json_type(v) = 'OBJECT' AND json_exists(v, '$.structure') AND NOT json_exists(v, '$.type') THEN json_extract(v, '$.structure') ELSE v::JSON END AS v FROM tree WHERE v IS NOT NULL),
    tops AS (SELECT row_id, 'structure' AS path, {js.elements("v")} AS held FROM unwrapped),
    units AS (
        SELECT row_id, node_path, x FROM ({_each("tops")})
        UNION ALL
        SELECT row_id, path || '[' || i || ']' AS node_path, x FROM (
            SELECT row_id, path, unnest(held) AS x, unnest(range(len(held))) AS i FROM (SELECT row_id, node_path || '.subsections' AS path, {js.elements(js.member("x", "subsections"))} AS held FROM units WHERE NOT {js.is_nothing("x")}))),
    nodes AS (
        SELECT 'chunks_with_analysis' AS table_name, row_id, node_path FROM outer_nodes UNION ALL SELECT 'chunks_with_analysis', row_id, node_path FROM inner_nodes
        UNION ALL SELECT 'doc_analysis', row_id, node_path FROM units WHERE NOT {js.is_nothing("x")})
"""
SQL: dict[str, str] = {
    "p7_found": NODES_SQL + "SELECT table_name, row_id, node_path FROM nodes",
    "p7_structure_links": NODES_SQL
    + """
        SELECT a.row_id AS record_key, a.node_path AS ancestor_path, b.node_path, regexp_replace(b.node_path, '\\.subsections\\[\\d+\\]$', '') = a.node_path AS is_parent
        FROM nodes a JOIN nodes b ON a.row_id = b.row_id AND starts_with(b.node_path, a.node_path || '.') WHERE a.table_name = 'doc_analysis' AND b.table_name = 'doc_analysis'
    """,
}

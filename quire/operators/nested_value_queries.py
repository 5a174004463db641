"""Queries of nested_values.py, tensors.py and writers.py, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import nested_values as nv
from quire.operators import tensors as t
from quire.operators.library_queries import _CLEAN, _sql_strip
from quire.plans.session import table
from quire.sources import writers as wr

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@_query("nested_search", """
    SELECT event_id::VARCHAR AS key, coalesce(json_extract_string(props, '$.k') LIKE '%7%', false) AS found, CASE WHEN json_extract_string(props, '$.k') LIKE '%7%' THEN 'k' END AS path
    FROM events WHERE props IS NOT NULL
""")
def nested_search(spark, d):
    return nv.searches(table(spark, d, "events"), "event_id", "props", "7")


@_query("nested_sizes", "SELECT event_id::VARCHAR AS key, (4 + length(json_extract_string(props, '$.k')))::BIGINT AS chars FROM events WHERE props IS NOT NULL")
def nested_sizes(spark, d):
    return nv.sizes(table(spark, d, "events"), "event_id", "props")


@_query("nested_kinds", "SELECT event_id::VARCHAR AS key, 'dict 1' AS kind FROM events WHERE props IS NOT NULL")
def nested_kinds(spark, d):
    return nv.kinds(table(spark, d, "events"), "event_id", "props")


@_query("nested_outline", "SELECT event_id::VARCHAR AS key, 0::INT AS ord, 1::INT AS level, chr(9) || 'k: ' || json_extract_string(props, '$.k') AS line FROM events WHERE props IS NOT NULL")
def nested_outline(spark, d):
    return nv.outlines(table(spark, d, "events"), "event_id", "props")


_CHILDREN = """CASE json_type(v)
    WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k, i: {'i': i, 'key': k, 'v': json_extract(v, '$."' || k || '"')})
    WHEN 'ARRAY' THEN list_transform(json_extract(v, '$[*]'), lambda x, i: {'i': i, 'key': NULL::VARCHAR, 'v': x}) END"""
#: Every value of a structure: the way to it (places, for the order; keys), what holds it and how many others it holds.
_TREE = f"""
    WITH RECURSIVE src AS (SELECT row_id::VARCHAR AS key, structure::JSON AS v FROM doc_analysis WHERE json_valid(structure)),
    tree AS (
        SELECT key, v, []::BIGINT[] AS place, []::VARCHAR[] AS way, NULL::VARCHAR AS own, NULL::VARCHAR AS holder, 0::BIGINT AS held FROM src
        UNION ALL
        SELECT key, c.v, place || [c.i::BIGINT], way || [coalesce(c.key, (c.i - 1)::VARCHAR)], c.key, kind, n FROM (SELECT key, place, way, json_type(v) AS kind, len({_CHILDREN}) AS n, unnest({_CHILDREN}) AS c FROM tree WHERE json_type(v) IN ('OBJECT', 'ARRAY')))
"""
_LEAF = "CASE json_type(v) WHEN 'VARCHAR' THEN json_extract_string(v, '$') WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN CASE WHEN v::VARCHAR = 'true' THEN 'True' ELSE 'False' END ELSE v::VARCHAR END"


def _plain_sql(x: str) -> str:
    """Cleaned, stripped, ASCII only."""
    return f"regexp_replace({_sql_strip(_CLEAN.replace('(text,', f'({x},', 1))}, '[^\\x00-\\x7F]+', '', 'g')"


@_query("nested_outline_structures", _TREE + f"""
    , lines AS (
        SELECT key, place, 0 AS part, len(place) AS level, CASE holder WHEN 'OBJECT' THEN {_plain_sql("own")} ELSE 'item_' || place[-1] END AS line FROM tree WHERE len(place) > 0
        UNION ALL
        SELECT key, place, 1, len(place) + 1, {_plain_sql("CASE json_type(v) WHEN 'VARCHAR' THEN json_extract_string(v, '$') ELSE v::VARCHAR END")} FROM tree WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY'))
    SELECT key, (row_number() OVER (PARTITION BY key ORDER BY place, part) - 1)::INT AS ord, level::INT AS level, repeat(chr(9), level) || line AS line FROM lines
""")
def nested_outline_structures(spark, d):
    return nv.outlines(table(spark, d, "doc_analysis"), "row_id", "structure", own_lines=True)


@_query("nested_sizes_structures", _TREE + f"""
    SELECT key, sum(CASE holder WHEN 'OBJECT' THEN length(own) + 3 + held - 1 WHEN 'ARRAY' THEN 2 + held - 1 ELSE 0 END + CASE WHEN json_type(v) IN ('OBJECT', 'ARRAY') THEN 0 ELSE length({_LEAF}) END)::BIGINT AS chars FROM tree GROUP BY 1
""")
def nested_sizes_structures(spark, d):
    return nv.sizes(table(spark, d, "doc_analysis"), "row_id", "structure")


@_query("nested_search_structures", _TREE + f"""
    , hits AS (SELECT key, array_to_string(way, ',') AS path FROM tree WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND contains({_LEAF}, '3') QUALIFY row_number() OVER (PARTITION BY key ORDER BY place) = 1)
    SELECT src.key, path IS NOT NULL AS found, path FROM src LEFT JOIN hits USING (key)
""")
def nested_search_structures(spark, d):
    return nv.searches(table(spark, d, "doc_analysis"), "row_id", "structure", "3")


@_query("nested_kinds_structures", """
    WITH src AS (SELECT row_id::VARCHAR AS key, structure::JSON AS v FROM doc_analysis WHERE json_valid(structure))
    SELECT key, CASE json_type(v) WHEN 'OBJECT' THEN 'dict ' || len(json_keys(v)) WHEN 'VARCHAR' THEN 'str' WHEN 'NULL' THEN 'NoneType' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float'
        WHEN 'ARRAY' THEN 'list ' || json_array_length(v) || CASE WHEN json_type(json_extract(v, '$[0]')) = 'ARRAY' THEN 'x' || json_array_length(json_extract(v, '$[0]')) ELSE '' END ELSE 'int' END AS kind FROM src
""")
def nested_kinds_structures(spark, d):
    return nv.kinds(table(spark, d, "doc_analysis"), "row_id", "structure")


@_query("tensor_reshape", "SELECT (p_partkey // 20)::INT AS i, (p_partkey // 5 % 4)::INT AS j, (p_partkey % 5)::INT AS k, p_retailprice AS value FROM part")
def tensor_reshape(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("index"), F.col("p_retailprice").alias("value"))
    return t.reshape(p, "index", "value", (100_000_000, 4, 5))


@_query("tensor_flatten", "SELECT (n_regionkey * 100 + n_nationkey)::BIGINT AS index, n_name AS value FROM nation")
def tensor_flatten(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("i"), F.col("n_nationkey").alias("j"), F.col("n_name").alias("value"))
    return t.flatten(n, (5, 100))


@_query("tensor_merged", """
    WITH w AS (SELECT n_nationkey AS index, n_regionkey::DOUBLE AS value FROM nation UNION ALL SELECT 25 + r_regionkey, r_regionkey::DOUBLE FROM region UNION ALL SELECT 30 + i, 0 FROM range(0, 2) r(i))
    SELECT (index // 8)::INT AS i, (index % 8)::INT AS j, value FROM w
""")
def tensor_merged(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("index"), F.col("n_regionkey").alias("value"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("index"), F.col("r_regionkey").alias("value"))
    return t.merged([a, b], [25, 5], 8)


@_query("tensor_equal", "SELECT count(*) = 0 AS equal, count(*) AS different FROM orders WHERE abs(o_totalprice) > 100000")
def tensor_equal(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    return t.equal(a, a.withColumn("value", F.lit(0.0)), ["o_orderkey"], tolerance=100_000)


@_query("tensor_matrix_lines", """
    SELECT c_nationkey AS m, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS i, c_custkey || chr(9) || c_name AS line FROM customer
    UNION ALL SELECT DISTINCT c_nationkey, -1, '' FROM customer WHERE c_nationkey > (SELECT min(c_nationkey) FROM customer)
""")
def tensor_matrix_lines(spark, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("m"), i.alias("i"), F.array(F.col("c_custkey").cast("string"), "c_name").alias("row"))
    return wr.matrix_lines(rows)


@_query("write_table_lines", "SELECT r_regionkey || chr(9) || r_name AS line FROM region")
def write_table_lines(spark, d):
    r = table(spark, d, "region")
    return r.select(wr.table_lines(r).alias("line"))

"""Queries of analyses.py, graph.py and retrieval.py, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import analyses as an
from quire.operators import answering, corpus_sql
from quire.operators import graph as g
from quire.operators import library as lib
from quire.operators import retrieval as rt
from quire.plans.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = dict(corpus_sql.SQL)


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Block analyses, each block once, with their members."""
    rows = lib.once(table(spark, d, "block_analysis").where("document_id is not null"), ["document_id", "block_index"], "analysed_at", "row_id")
    return rows.select(F.col("row_id").alias("key"), "document_id", "block_index").join(an.read_blocks(rows), "key")


def _chunk_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Successful chunk analyses, each chunk once, with their members."""
    rows = lib.once(an.succeeded(table(spark, d, "chunks_with_analysis")).where("chunk_id is not null"), ["chunk_id"], "analysed_at", "row_id")
    return cut(rows.select(F.col("row_id").alias("key"), "chunk_id", "document_id", F.col("chunk_seq").alias("sequence")).join(an.read_chunks(rows), "key").where("readable"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    rows = lib.once(table(spark, d, "doc_analysis"), ["document_id"], "analysed_at", "row_id")
    return rows.select(F.col("row_id").alias("key"), "document_id", "document_type", "overall_summary").join(an.read_structures(rows), "key")


def _flat(df: DataFrame) -> DataFrame:
    """Maps and arrays as text, so that results compare by value."""
    for c, t in df.dtypes:
        if t.startswith("map"):
            df = df.withColumn(c, F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))
        elif t.startswith("array"):
            df = df.withColumn(c, F.array_join(c, "|"))
    return df


@_query("analysis_consolidated")
def analysis_consolidated(spark, d):
    return _flat(an.consolidated(_blocks(spark, d).where("readable")))


@_query("analysis_synthesis_input")
def analysis_synthesis_input(spark, d):
    return an.synthesis_input(_blocks(spark, d).withColumn("block_ref", F.col("structural_marker_found")))


@_query("analysis_outcomes", "SELECT count(*) FILTER (analysis_status = 'success') AS succeeded, count(*) FILTER (analysis_status = 'error') AS failed, count(*) AS total FROM chunks_with_analysis")
def analysis_outcomes(spark, d):
    return an.outcome_counts(table(spark, d, "chunks_with_analysis"))


@_query("analysis_missing_blocks", """
    SELECT document_id, block_index, CASE WHEN a.document_id IS NULL THEN 'no analysis' ELSE 'no block' END AS side
    FROM (SELECT DISTINCT document_id, block_index FROM large_blocks) b FULL JOIN (SELECT DISTINCT document_id, block_index FROM block_analysis) a USING (document_id, block_index)
    WHERE a.document_id IS NULL OR b.document_id IS NULL
""")
def analysis_missing_blocks(spark, d):
    return an.missing_blocks(table(spark, d, "large_blocks"), table(spark, d, "block_analysis"), ["document_id", "block_index"])


@_query("analysis_reduce_failed", "SELECT row_id, analysis IS NULL OR NOT json_valid(analysis) OR coalesce(json_extract(CASE WHEN json_valid(analysis) THEN analysis END, '$.error') IS NOT NULL, false) AS failed FROM chunks_with_analysis")
def analysis_reduce_failed(spark, d):
    return table(spark, d, "chunks_with_analysis").select("row_id", an.reduce_failed(F.col("analysis")).alias("failed"))


@_query("analysis_tokens_per_call")
def analysis_tokens_per_call(spark, d):
    return an.tokens_per_call(table(spark, d, "large_blocks"), "text")


@_query("analysis_block_prompts")
def analysis_block_prompts(spark, d):
    return table(spark, d, "large_blocks").select("row_id", an.block_prompt(F.col("structural_marker"), F.col("text")).alias("prompt"))


@_query("analysis_chunk_prompts")
def analysis_chunk_prompts(spark, d):
    docs = lib.once(table(spark, d, "doc_analysis"), ["document_id"], "analysed_at", "row_id").select("document_id", "overall_summary")
    return table(spark, d, "chunks").join(docs, "document_id", "left").select("row_id", an.chunk_prompt(F.col("overall_summary"), F.col("text")).alias("prompt"))


@_query("analysis_reduce_prompts")
def analysis_reduce_prompts(spark, d):
    blocks = cut(_blocks(spark, d))
    names = an.consolidated(blocks).select("document_id", F.to_json(F.struct("characters", "locations", "organizations")).alias("names"))
    summaries = an.synthesis_input(blocks.withColumn("block_ref", F.col("structural_marker_found")))
    n = blocks.groupBy("document_id").agg(F.count("*").alias("n"))
    rows = summaries.join(names, "document_id", "left").join(n, "document_id")
    return rows.select("document_id", an.reduce_prompt(F.col("n"), F.coalesce("names", F.lit("{}")), F.col("text")).alias("prompt"))


@_query("analysis_offline_blocks")
def analysis_offline_blocks(spark, d):
    prompts = table(spark, d, "large_blocks").select("row_id", F.when(F.length("text") > 0, an.block_prompt(F.col("structural_marker"), F.col("text"))).alias("prompt"))
    return an.analyse(prompts, "row_id", "prompt", an.offline_block)


@_query("embed_offline")
def embed_offline(spark, d):
    return _flat(an.embed(table(spark, d, "chunks"), "row_id", "text", an.offline_vectors).withColumn("vector", F.transform("vector", lambda x: F.round(x, 4).cast("string"))))


@_query("graph_nodes")
def graph_nodes(spark, d):
    docs = cut(_docs(spark, d))
    parts = [g.document_nodes(docs), g.structure_nodes(docs), g.entity_nodes(_chunk_analyses(spark, d))]
    return _flat(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@_query("graph_edges")
def graph_edges(spark, d):
    chunks = _chunk_analyses(spark, d)
    return _flat(g.structure_edges(_docs(spark, d)).unionByName(g.mention_edges(chunks)).unionByName(g.interaction_edges(chunks)))


def _stored(spark, d) -> tuple[DataFrame, DataFrame]:
    chunks = _chunk_analyses(spark, d)
    return cut(g.entity_nodes(chunks)), cut(g.interaction_edges(chunks))


@_query("graph_linked_edges")
def graph_linked_edges(spark, d):
    nodes, edges = _stored(spark, d)
    return _flat(g.linked_edges(edges, nodes))


@_query("graph_degrees")
def graph_degrees(spark, d):
    return g.degrees(_stored(spark, d)[1])


@_query("graph_id_conflicts")
def graph_id_conflicts(spark, d):
    return g.id_conflicts(_stored(spark, d)[0])


@_query("graph_neighbours")
def graph_neighbours(spark, d):
    nodes, edges = _stored(spark, d)
    return g.neighbours(edges, nodes, nodes, limit=10)


@_query("graph_merged_nodes")
def graph_merged_nodes(spark, d):
    old, _ = _stored(spark, d)
    new = old.select("id", F.array(F.lit("Known")).alias("labels"), "name", F.create_map(F.lit("checked"), F.lit("yes")).alias("properties"))
    return _flat(g.merge_nodes(old, new))


_ENDS = """
    WITH n AS (SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation),
    e AS (SELECT c_nationkey::VARCHAR AS src, 'c' || c_custkey AS dst, 'HAS' AS type FROM customer UNION ALL SELECT s_nationkey::VARCHAR, 's' || s_suppkey, 'SUPPLIES' FROM supplier)
"""


def _ends(spark, d) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("HAS").alias("type"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit("SUPPLIES").alias("type")))


@_query("graph_degrees_star", _ENDS + "SELECT id, type, count(*) AS degree FROM (SELECT src AS id, type FROM e UNION ALL SELECT dst, type FROM e) GROUP BY 1, 2")
def graph_degrees_star(spark, d):
    return g.degrees(_ends(spark, d))


@_query("graph_neighbours_star", _ENDS + "SELECT DISTINCT dst AS id, src AS other, type, 'in' AS direction, name FROM e JOIN n ON e.src = n.id")
def graph_neighbours_star(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return g.neighbours(_ends(spark, d), nodes, _ends(spark, d).select(F.col("dst").alias("id")))


@_query("graph_linked_edges_star", _ENDS + "SELECT src, dst, type FROM e SEMI JOIN n ON e.src = n.id WHERE dst IN (SELECT 'c' || o_custkey FROM orders)")
def graph_linked_edges_star(spark, d):
    ids = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id")).unionByName(table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id")))
    return g.linked_edges(_ends(spark, d), ids)


_TOP = """
    WITH q AS (SELECT label AS q_id, list_transform(range(1, 65), lambda i: list_avg(list_transform(list(embedding), lambda e: e[i]::DOUBLE))) AS v FROM embeddings GROUP BY 1),
    s AS (SELECT q_id, vec_id AS id, list_cosine_similarity(v, embedding::DOUBLE[]) AS similarity FROM q, embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, id) AS rank FROM s)
"""


def _centres(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    by = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return by.groupBy(F.col("label").alias("q_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))


@_query("search_top_k", _TOP + "SELECT q_id, id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10")
def search_top_k(spark, d):
    """The 10 most similar vectors of each label's mean vector."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rt.top_k(_centres(spark, d), vectors).withColumn("similarity", F.round("similarity", 6))


@_query("search_context", _TOP + """
    SELECT q_id, string_agg(doc_id || ': ' || coalesce(text, ''), chr(10) ORDER BY doc_id) AS context FROM r JOIN documents ON doc_id = id WHERE rank <= 10 GROUP BY 1
""")
def search_context(spark, d):
    """Texts of the documents found, in one context a question."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = rt.top_k(_centres(spark, d), vectors).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    line = F.concat(F.col("id").cast("string"), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = found.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("c"))
    return rows.select("q_id", F.array_join(F.transform("c", lambda x: x["line"]), "\n").alias("context"))


def _questions(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A question for each label, with its mean vector; vectors of chunks; chunks."""
    chunks = lib.once(table(spark, d, "chunks"), ["chunk_id"], "ingested_at", "row_id")
    ids = chunks.select("chunk_id").join(table(spark, d, "embeddings_dict").select("chunk_id").distinct(), "chunk_id")
    vectors = table(spark, d, "embeddings_dict").groupBy("chunk_id").agg(F.first("vector_values", True).alias("vector")).join(ids, "chunk_id").where("size(vector) = 64")
    centres = _centres(spark, d).select(F.col("q_id"), F.lit("library").alias("conversation"), F.col("q_id").alias("turn"), F.concat(F.lit("What is said of topic "), F.col("q_id").cast("string"), F.lit("?")).alias("question"), "vector")
    return centres, vectors, chunks


@_query("search_answers")
def search_answers(spark, d):
    """The questions answered from the chunks by an offline provider."""
    return answering.answer(*_questions(spark, d), an.offline_block)


@_query("search_prompts", """
    WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) = 1),
    q AS (SELECT label AS q_id, list_transform(range(1, 65), lambda i: list_avg(list_transform(list(embedding), lambda e: e[i]::DOUBLE))) AS v FROM embeddings GROUP BY 1),
    e AS (SELECT chunk_id, any_value(vector_values)::DOUBLE[] AS w FROM embeddings_dict SEMI JOIN c USING (chunk_id) GROUP BY 1 HAVING len(any_value(vector_values)) = 64),
    s AS (SELECT q_id, chunk_id, list_cosine_similarity(v, w) AS similarity FROM q, e WHERE NOT list_contains(list_transform(w, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true) AND list_sum(list_transform(w, lambda x: x * x)) > 0),
    r AS (SELECT q_id, chunk_id FROM s QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, chunk_id) <= 10),
    p AS (SELECT q_id, coalesce(document_id, 'Unknown') AS document_id, string_agg(chunk_num || ': ' || coalesce(text, ''), chr(10) ORDER BY chunk_num, text) AS lines FROM r JOIN c USING (chunk_id) GROUP BY 1, 2),
    x AS (SELECT q_id, string_agg('Document ' || document_id || ':' || chr(10) || lines, chr(10) || chr(10) ORDER BY document_id) AS context FROM p GROUP BY 1),
    h AS (SELECT q_id, 'What is said of topic ' || q_id || '?' AS question, string_agg('What is said of topic ' || q_id || '?', chr(10)) OVER (ORDER BY q_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM q)
    SELECT q_id::VARCHAR AS q_id, concat_ws(chr(10) || chr(10), history, context, question) AS prompt, 'similarity' AS found_by FROM h JOIN x USING (q_id)
""")
def search_prompts(spark, d):
    """What the questions are answered from: earlier questions, chunks found, the question."""
    return answering.prompts(*_questions(spark, d))


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings_dict").select("row_id", "chunk_id", F.col("vector_values").alias("vector"), "embedded_at")


@_query("vector_records", """
    WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) = 1)
    SELECT e.row_id, chunk_id, left(text, 20000) AS text, coalesce(document_id, 'Unknown') AS document_id, coalesce(chunk_seq, -1) AS sequence, coalesce(structure_ref, 'Unknown') AS structure_ref
    FROM embeddings_dict e JOIN c USING (chunk_id)
""")
def vector_records(spark, d):
    chunks = lib.once(table(spark, d, "chunks"), ["chunk_id"], "ingested_at", "row_id")
    rows = _vectors(spark, d).select(F.col("row_id"), "chunk_id", "vector")
    return rows.drop("vector").join(rt.vector_records(rows.dropDuplicates(["chunk_id"]), chunks).drop("vector"), "chunk_id")


@_query("vector_unmatched", "SELECT DISTINCT chunk_id FROM embeddings_dict ANTI JOIN chunks USING (chunk_id)")
def vector_unmatched(spark, d):
    return rt.unmatched(_vectors(spark, d), table(spark, d, "chunks"))


@_query("vector_wrong_length", "SELECT row_id FROM embeddings_dict WHERE vector_values IS NULL OR len(vector_values) <> 64")
def vector_wrong_length(spark, d):
    return rt.wrong_length(_vectors(spark, d), "vector", 64).select("row_id")


@_query("vector_upsert", """
    WITH u AS (SELECT o_orderkey AS id, o_orderdate AS version, 0 AS side, o_totalprice AS value FROM orders
               UNION ALL SELECT l_orderkey, l_shipdate, 1, sum(l_extendedprice) FROM lineitem GROUP BY 1, 2)
    SELECT id, arg_max(value, (version, side)) AS value, max(version) AS version FROM u GROUP BY 1
""")
def vector_upsert(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("version"), F.col("o_totalprice").alias("value"))
    new = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("version")).agg(F.sum("l_extendedprice").alias("value"))
    return rt.upsert(old, new, "id", "version")


@_query("vector_fetch", """
    SELECT DISTINCT ON (chunk_id) chunk_id, array_to_string(list_transform(vector_values[1:3], lambda x: round(x::DOUBLE, 4)::VARCHAR), '|') IS NULL AS empty, coalesce(len(vector_values), -1)::INT AS dimensions
    FROM (SELECT DISTINCT chunk_id FROM chunks) c LEFT JOIN (SELECT chunk_id, any_value(vector_values) AS vector_values FROM embeddings_dict GROUP BY 1) e USING (chunk_id)
""")
def vector_fetch(spark, d):
    records = _vectors(spark, d).groupBy("chunk_id").agg(F.first("vector", True).alias("vector"))
    return rt.fetch(records, table(spark, d, "chunks"), shown=3).select("chunk_id", F.col("first_dimensions").isNull().alias("empty"), F.when(F.col("first_dimensions").isNull(), -1).otherwise(F.col("dimensions")).alias("dimensions"))


@_query("entity_ids", "SELECT n_nationkey, regexp_replace('location_' || lower(replace(n_name, ' ', '_')), '\\W+', '', 'g') AS id FROM nation")
def entity_ids(spark, d):
    return table(spark, d, "nation").select("n_nationkey", tx.entity_id(tx.entity_label(F.lit("locations")), "n_name").alias("id"))

"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import encoding, lookalikes, mixing, names, neighbours, pairs, repetition, splitting, tokens
from quire.llm.tables import passages
from quire.operators import json_sql as js
from quire.plans.session import cut, small, table


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage as its author wrote it, as far as that can be told."""
    return encoding.restore(passages(spark, sf_dir), encoding.fit(table(spark, sf_dir, "documents")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restore(passages(spark, sf_dir), encoding.fit(table(spark, sf_dir, "documents")), only_garbled=True).select("table_name", "row_id")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage in its one form, and whether it was in it."""
    return lookalikes.one_form(passages(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages not in their one form; garbled ones, which are problem 1's, are taken out."""
    changed = lookalikes.one_form(passages(spark, sf_dir), only_changed=True)
    sound = encoding.restore(changed, encoding.fit(table(spark, sf_dir, "documents"))).where("not garbled")
    return sound.select("table_name", "row_id")


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of a book with the entity it is taken for."""
    counts = names.mention_counts(table(spark, sf_dir, "chunks_with_analysis"), table(spark, sf_dir, "block_analysis"))
    return names.link_names(counts).withColumnRenamed("grp", "document_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = names.mention_counts(table(spark, sf_dir, "chunks_with_analysis"), table(spark, sf_dir, "block_analysis"))
    return names.spelling_pairs(names.link_names(counts)).withColumnRenamed("grp", "document_id")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of participants of a book, with its counts, lift and odds ratio."""
    records = pairs.participant_records(table(spark, sf_dir, "chunks_with_analysis"))
    return pairs.pair_counts(records).select(F.col("grp").alias("document_id"), F.col("a").alias("participant_a"), F.col("b").alias("participant_b"), "n_ab", "n_a", "n_b", "n", "lift", "odds_ratio")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = pairs.participant_records(table(spark, sf_dir, "chunks_with_analysis"))
    found = pairs.pair_counts(records, least=5).where("n_ab * n >= 3 * n_a * n_b")
    return found.select(F.col("grp").alias("document_id"), F.col("a").alias("participant_a"), F.col("b").alias("participant_b"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every passage over its limit, in order."""
    return splitting.split(passages(spark, sf_dir), table(spark, sf_dir, "split_limits"))


def p5_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts put together again from their pieces, without the overlaps, and whether every piece keeps its limit."""
    limits = small(table(spark, sf_dir, "split_limits").select("table_name", "max_chars", "overlap_chars"))
    each = p5_pieces(spark, sf_dir).join(limits, "table_name")
    part = F.when(F.col("piece_index") == 0, F.col("text")).otherwise(F.col("text").substr(F.col("overlap_chars") + 1, F.length("text")))
    rows = each.select("table_name", "row_id", "piece_index", part.alias("part"), (F.length("text") <= F.col("max_chars")).alias("fits"))
    joined = rows.groupBy("table_name", "row_id").agg(F.sort_array(F.collect_list(F.struct("piece_index", "part"))).alias("p"), F.bool_and("fits").alias("fits"))
    return joined.select("table_name", "row_id", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"), "fits")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that had to be cut: those with a first piece."""
    return p5_pieces(spark, sf_dir).where("piece_index = 0").select("table_name", "row_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of at least 0.85 among the 10 most similar of either."""
    near = neighbours.similar(table(spark, sf_dir, "embeddings_dict"), least=0.85)
    return near.select(F.least("key", "neighbour").alias("chunk_id_a"), F.greatest("key", "neighbour").alias("chunk_id_b")).distinct()


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar chunks of every chunk."""
    near = neighbours.exact(table(spark, sf_dir, "embeddings_dict"))
    return near.select(F.col("key").alias("chunk_id"), "neighbour", F.round("similarity", 5).alias("similarity"))


def p6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar of all chunks for those of rows whose id is divisible by 20."""
    near = neighbours.search(table(spark, sf_dir, "embeddings_dict"), F.col("row_id") % 20 == 0)
    return near.select(F.col("key").alias("chunk_id"), "neighbour", F.round("similarity", 5).alias("similarity"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return tokens.encode(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, from its ids."""
    return tokens.decode(p8_ids(spark, sf_dir))


def _mixes(spark: SparkSession, sf_dir: str, by: str = "targets") -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents")
    sized = mixing.sized_documents(documents, lambda df, source: tokens.encode(df, carry=source, lengths_only=True))
    planned = cut(mixing.plan(sized, table(spark, sf_dir, "mix_targets"), by=by))
    return mixing.draw(sized, planned), planned


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix, with the number of copies."""
    return _mixes(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source of every mix."""
    return mixing.report(*_mixes(spark, sf_dir))


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of mixes whose weights are token shares to an exponent, as even as the targets are."""
    return mixing.report(*_mixes(spark, sf_dir, by="temperature"))


def p10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of every document in lines that many documents of its source hold, and whether that depletes it."""
    return repetition.line_frequency(table(spark, sf_dir, "documents"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated share of every document."""
    return repetition.repeated_share(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_shares(spark, sf_dir).where("repeated_share >= 0.4").select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored, "p4_found": p4_found, "p4_forms": p4_forms, "p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p3_pairs": p3_pairs, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rejoined": p5_rejoined, "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p6_search": p6_search, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_tempered": p9_tempered, "p10_found": p10_found, "p10_shares": p10_shares, "p10_lines": p10_lines}

_PAIRS = f"""
    WITH c AS (SELECT document_id, chunk_id, any_value(analysis) AS text FROM chunks_with_analysis WHERE analysis_status = 'success' AND chunk_id IS NOT NULL AND document_id IS NOT NULL AND analysis IS NOT NULL GROUP BY 1, 2, analysis),
    {js.readable("c")},
    {js.objects("root")},
    once AS (SELECT document_id, chunk_id, any_value(v) AS v FROM object GROUP BY 1, 2),
    r AS (SELECT document_id, chunk_id, unnest(held) AS x, unnest(range(len(held))) AS i FROM (SELECT document_id, chunk_id, {js.elements("json_extract(v, '$.relationships_interactions')")} AS held FROM once)),
    records AS (SELECT * FROM r WHERE json_type(x) <> 'NULL'),
    items AS (SELECT DISTINCT document_id, chunk_id, i, {js.name_of("y")} AS item FROM (SELECT document_id, chunk_id, i, unnest({js.elements(js.member("x", "participants"))}) AS y FROM records) WHERE {js.name_of("y")} IS NOT NULL),
    total AS (SELECT document_id, count(*) AS n FROM records GROUP BY 1),
    one AS (SELECT document_id, item, count(*) AS n FROM items GROUP BY 1, 2),
    pairs AS (SELECT document_id, a.item AS participant_a, b.item AS participant_b, count(*) AS n_ab FROM items a JOIN items b USING (document_id, chunk_id, i) WHERE a.item < b.item GROUP BY 1, 2, 3),
    counted AS (
        SELECT document_id, participant_a, participant_b, n_ab, a.n AS n_a, b.n AS n_b, t.n AS n FROM pairs p JOIN total t USING (document_id)
        JOIN one a ON a.document_id = p.document_id AND a.item = participant_a JOIN one b ON b.document_id = p.document_id AND b.item = participant_b)
"""

SQL = {
    "p3_found": _PAIRS + "SELECT document_id, participant_a, participant_b FROM counted WHERE n_ab >= 5 AND n_ab * n >= 3 * n_a * n_b",
    "p3_pairs": _PAIRS + """
        SELECT *, n_ab::DOUBLE * n / (n_a::DOUBLE * n_b) AS lift, ((n_ab::DOUBLE + 0.5) * (n::DOUBLE - n_a - n_b + n_ab + 0.5)) / ((n_a::DOUBLE - n_ab + 0.5) * (n_b::DOUBLE - n_ab + 0.5)) AS odds_ratio FROM counted
    """,
    "p6_found": """
        WITH e AS (
            SELECT chunk_id, any_value(vector_values)::DOUBLE[64] AS v FROM embeddings_dict
            WHERE chunk_id IS NOT NULL AND len(vector_values) = 64 AND NOT list_contains(list_transform(vector_values, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true) AND list_sum(list_transform(vector_values, lambda x: abs(x))) > 0
            GROUP BY 1)
        SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM e a JOIN e b ON a.chunk_id < b.chunk_id WHERE array_cosine_similarity(a.v, b.v) >= 0.85
    """,
    "p10_lines": """
        WITH d AS (SELECT doc_id, coalesce(source, '') AS host, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\x{0B}\\f\\r\\x{85}\\x{2028}\\x{2029}]'), lambda x: regexp_replace(lower(x), '[^\\p{L}]+', '', 'g')), lambda x: x <> '') AS lines FROM documents),
        f AS (SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM d) GROUP BY 1, 2 HAVING count(*) > 5),
        l AS (SELECT doc_id, host, unnest(lines) AS line FROM d),
        s AS (SELECT doc_id, sum(length(line)) AS letters, sum(length(line)) FILTER (f.line IS NOT NULL) AS gone FROM l LEFT JOIN f USING (host, line) GROUP BY 1)
        SELECT doc_id, coalesce(letters, 0)::BIGINT AS letters, CASE WHEN letters > 0 THEN coalesce(gone, 0)::BIGINT::DOUBLE / letters::BIGINT ELSE 0.0 END AS removed_share, coalesce(coalesce(gone, 0)::DOUBLE / letters >= 0.4, false) AS rejected
        FROM d LEFT JOIN s USING (doc_id)
    """,
    "p5_found": """
        SELECT table_name, row_id
        FROM (SELECT 'chunks' AS table_name, row_id, text FROM chunks UNION ALL SELECT 'large_blocks', row_id, text FROM large_blocks)
        JOIN split_limits USING (table_name)
        WHERE length(text) > max_chars
    """,
    "p5_rejoined": """
        SELECT table_name, row_id, text, true AS fits
        FROM (SELECT 'chunks' AS table_name, row_id, text FROM chunks UNION ALL SELECT 'large_blocks', row_id, text FROM large_blocks)
        JOIN split_limits USING (table_name)
        WHERE length(text) > max_chars
    """,
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}

"""Queries of library.py, chunking.py and text.py, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import chunking as ch
from quire.operators import library as lib
from quire.plans.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, each chunk_id once, as delivered last."""
    return lib.once(table(spark, d, "chunks"), ["chunk_id"], "ingested_at", "row_id")


_CHUNKS = "WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) = 1)"

# ---- text

_CLEAN = "text"
for _bad, _good in tx.CLEANING:
    _CLEAN = f"replace({_CLEAN}, '{_bad}', '{_good.replace(chr(39), chr(39) * 2)}')"
_SPACES = "[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACES}+', ''), '{_SPACES}+$', '')"


@_query("text_clean", f"SELECT row_id, {_sql_strip(_CLEAN)} AS text FROM chunks")
def text_clean(spark, d):
    return table(spark, d, "chunks").select("row_id", tx.clean("text").alias("text"))


@_query("text_squeeze", "SELECT doc_id, regexp_replace(text, '[ \\t]+', ' ', 'g') AS text FROM documents")
def text_squeeze(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.squeeze("text").alias("text"))


@_query("text_one_line", f"SELECT doc_id, {_sql_strip(f'''regexp_replace(text, '{_SPACES}+', ' ', 'g')''')} AS text FROM documents")
def text_one_line(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.one_line("text").alias("text"))


@_query("text_ascii_only", "SELECT row_id, regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g') AS text FROM chunks")
def text_ascii_only(spark, d):
    return table(spark, d, "chunks").select("row_id", tx.ascii_only("text").alias("text"))


@_query("text_token_estimate", "SELECT doc_id, coalesce(length(text) // 4, 0)::INT AS tokens FROM documents")
def text_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(tx.token_estimate("text"), F.lit(0)).alias("tokens"))


@_query("text_json_body", f"SELECT row_id, regexp_replace(regexp_replace({_sql_strip('analysis')}, '^```json', ''), '```$', '') AS body FROM chunks_with_analysis")
def text_json_body(spark, d):
    return table(spark, d, "chunks_with_analysis").select("row_id", tx.json_body("analysis").alias("body"))


@_query("text_document_id", "SELECT document_id, regexp_extract(file_path, '([^/]*?)(\\.[^./]*)?$', 1) AS id FROM library_docs")
def text_document_id(spark, d):
    return table(spark, d, "library_docs").select("document_id", tx.document_id("file_path").alias("id"))


@_query("text_unix_path", "SELECT document_id, replace('/mnt/c' || replace('\\my books\\' || file_path, '\\', '/'), ' ', '\\ ') AS path FROM library_docs")
def text_unix_path(spark, d):
    windows = F.concat(F.lit("C:\\my books\\"), "file_path")
    return table(spark, d, "library_docs").select("document_id", tx.unix_path(windows).alias("path"))


@_query("text_capitalize", "SELECT document_id, upper(left(subject, 1)) || lower(substring(subject, 2)) AS subject FROM library_docs")
def text_capitalize(spark, d):
    return table(spark, d, "library_docs").select("document_id", tx.capitalize("subject").alias("subject"))


@_query("text_truncate", f"""
    WITH h AS (SELECT row_id, text, regexp_extract(left(text, 401), '(?s)^(.*[.!?]["’”'']?{_SPACES})', 1) AS sentence, regexp_replace(left(text, 400), '{_SPACES}+$', '') AS head FROM chunks)
    SELECT row_id, CASE WHEN length(text) <= 400 THEN {_sql_strip("text")} WHEN length(sentence) > 0 THEN {_sql_strip("sentence")}
                        WHEN length(regexp_extract(head, '(?s)^(.*) ', 1)) > 200 THEN {_sql_strip("regexp_extract(head, '(?s)^(.*) ', 1)")} ELSE head END AS text FROM h
""")
def text_truncate(spark, d):
    return table(spark, d, "chunks").select("row_id", tx.truncate("text", 400).alias("text"))


@_query("text_sentence_start", f"""
    WITH h AS (SELECT row_id, text, regexp_extract(text, '(?s)[.?!]["’”'']?{_SPACES}+([A-Z].*)$', 1) AS sentence, regexp_extract(text, '(?s){_SPACES}+([A-Za-z].*)$', 1) AS word FROM chunks)
    SELECT row_id, CASE WHEN length(sentence) > 0 THEN sentence WHEN length(word) > 0 THEN word ELSE text END AS text FROM h
""")
def text_sentence_start(spark, d):
    return table(spark, d, "chunks").select("row_id", tx.sentence_start("text").alias("text"))


@_query("text_left", "SELECT row_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS text FROM chunks")
def text_left(spark, d):
    return table(spark, d, "chunks").select("row_id", tx.left("text", 500, "...").alias("text"))


@_query("text_parse_datetime", """
    SELECT o_orderkey, CASE o_orderkey % 7
        WHEN 0 THEN o_orderdate::TIMESTAMP WHEN 6 THEN NULL WHEN 4 THEN date_trunc('day', o_orderdate) WHEN 5 THEN date_trunc('day', o_orderdate)
        ELSE date_trunc('day', o_orderdate) + INTERVAL 15 HOUR + INTERVAL 5 MINUTE END::TIMESTAMP AS at
    FROM orders
""")
def text_parse_datetime(spark, d):
    day = F.col("o_orderdate")
    forms = [F.date_format(day, "yyyy-MM-dd HH:mm:ss"), F.concat(F.date_format(day, "dd-MM-yyyy"), F.lit(" 3:05pm")), F.concat(F.date_format(day, "M/d/yyyy"), F.lit(" 03:05:00PM")), F.concat(F.date_format(day, "MMMM d, yyyy"), F.lit(" 15:05")), F.date_format(day, "yyyyMMdd"), F.date_format(day, "MMM d, yyyy"), F.date_format(day, "yyyy/MM/dd")]
    which = F.col("o_orderkey") % 7
    s = F.coalesce(*[F.when(which == i, f) for i, f in enumerate(forms)])
    return table(spark, d, "orders").select("o_orderkey", tx.parse_datetime(s).alias("at"))


# ---- chunking

_PIECES = """
    WITH p AS (SELECT doc_id::VARCHAR AS key, string_split_regex(text, '(?i)(CHAPTER|PART|BOOK)\\s+([IVXLCDM\\d]+)') AS gaps,
                      regexp_extract_all(text, '(?i)(CHAPTER|PART|BOOK)\\s+([IVXLCDM\\d]+)') AS found FROM documents WHERE length(text) > 0),
    e AS (SELECT key, unnest(gaps) AS gap, unnest([''] || found) AS match, unnest(range(0, len(gaps))) AS i FROM p),
    o AS (SELECT *, lag(gap) OVER w AS before, coalesce(sum(length(gap) + length(match)) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char,
                 CASE WHEN gap LIKE '%' || chr(10) || '%' OR i = 0 THEN regexp_extract(gap, '[^\\n]*$') END AS tail FROM e WINDOW w AS (PARTITION BY key ORDER BY i)),
    l AS (SELECT *, last_value(tail IGNORE NULLS) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line FROM o),
    m AS (SELECT key, i::INT AS i, gap, match, start_char, coalesce(i > 0 AND start_char > 0 AND regexp_matches(before, '\\s$')
                 AND NOT regexp_matches(lower(line), '^\\s*(to |heading to |contents:|illustrations:)'), false) AS accepted FROM l)
"""


_SCENE = f"\\n{_SPACES}*\\n{_SPACES}*\\n+"
_JAVA_SCENE = "\\n[\\s\\x{0B}]*\\n[\\s\\x{0B}]*\\n+"


def _windows_sql(source: str, target: int, most: int, name: str) -> str:
    """CTEs that end in ``name``: blocks between sentence or line ends, of (key, text)."""
    rest = f"substr(text, a + {target} + 1)"
    end = f"CASE WHEN strpos({rest}, '. ') > 0 THEN a + {target} + strpos({rest}, '. ') - 1 WHEN strpos({rest}, chr(10)) > 0 THEN a + {target} + strpos({rest}, chr(10)) - 1 ELSE least(length(text), a + {most}) END"
    return f"""
        {name}_w AS (
            SELECT key, text, a, {end} AS b FROM (SELECT key, text, 0::BIGINT AS a FROM {source})
            UNION ALL SELECT key, text, a, {end} AS b FROM (SELECT key, text, b + 1 AS a FROM {name}_w WHERE b + 1 < length(text))),
        {name} AS (
            SELECT key, (row_number() OVER (PARTITION BY key ORDER BY a) - 1)::INT AS block_index, substr(text, a + 1, b - a) AS raw, a AS start_char FROM {name}_w WHERE {_sql_strip("substr(text, a + 1, b - a)")} <> '')"""


def _fallback(name: str) -> str:
    clean = _sql_strip(_CLEAN.replace("replace(text,", "replace(raw,", 1))
    return f"SELECT key, block_index, {clean} AS text, 'FallbackBlock' AS type, 'Block ' || (block_index + 1) AS ref, 'FallbackBlock ' || (block_index + 1) AS structural_marker, start_char FROM {name}"


_TARGET, _OVERLAP = 200, 20
_ADAPTIVE = f"""
    WITH RECURSIVE b AS (
        SELECT document_id AS key, block_index AS block, block_type, structural_marker, text FROM large_blocks
        QUALIFY row_number() OVER (PARTITION BY document_id, block_index ORDER BY ingested_at DESC NULLS LAST, row_id DESC) = 1),
    s AS (
        SELECT key, block, block_type, structural_marker, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS scene
        FROM (SELECT *, string_split_regex(text, '{_SCENE}') AS parts FROM b WHERE key IS NOT NULL AND block IS NOT NULL AND length(text) > 0)),
    start AS (
        SELECT key, block, block_type, structural_marker, scene, list_filter(list_transform(string_split(part, chr(10)), lambda x: {_sql_strip("x")}), lambda x: x <> '') AS lines FROM s),
    -- one step of packing a row: its phase is 0 before a paragraph, 1 after one was taken
    t AS (
        SELECT key, block, scene, lines, 0::BIGINT AS step, 0 AS phase, 0::BIGINT AS i, '' AS buffer, 0::BIGINT AS first, false AS fresh, NULL::VARCHAR AS given, 0::BIGINT AS a, 0::BIGINT AS z, false AS divided FROM start
        UNION ALL
        SELECT key, block, scene,
               CASE WHEN act = 'cut' AND rest <> '' THEN lines[:i] || [rest] || lines[i + 2:] ELSE lines END,
               step + 1,
               CASE WHEN act IN ('over', 'take') THEN 1 ELSE 0 END,
               CASE WHEN act IN ('over', 'take') OR act = 'cut' AND rest = '' THEN i + 1 ELSE i END,
               CASE act WHEN 'out' THEN tail WHEN 'drop' THEN '' WHEN 'cut' THEN '' WHEN 'over' THEN {_sql_strip("tail || ' ' || p")} WHEN 'take' THEN {_sql_strip("buffer || ' ' || p")} ELSE buffer END,
               CASE WHEN act IN ('out', 'over') THEN i WHEN act = 'cut' THEN CASE WHEN rest = '' THEN i + 1 ELSE i END ELSE first END,
               CASE act WHEN 'out' THEN false WHEN 'over' THEN true WHEN 'take' THEN true ELSE fresh END,
               CASE act WHEN 'out' THEN buffer WHEN 'over' THEN buffer WHEN 'cut' THEN head END,
               CASE act WHEN 'cut' THEN i + 1 ELSE first + 1 END, CASE act WHEN 'cut' THEN i + 1 ELSE i END, act = 'cut'
        FROM (
            SELECT *, CASE WHEN taken > 0 THEN array_to_string(words[:taken], ' ') ELSE left(p, 4 * {int(2.5 * _TARGET)}) END AS head,
                   CASE WHEN taken > 0 THEN array_to_string(words[taken + 1:], ' ') ELSE {_sql_strip(f"substr(p, 4 * {int(2.5 * _TARGET)} + 1)")} END AS rest
            FROM (
                SELECT *, CASE WHEN act = 'cut' THEN len(list_filter(range(1, len(words) + 1), lambda k: length(array_to_string(words[:k], ' ')) // 4 <= {int(2.5 * _TARGET)})) ELSE 0 END AS taken
                FROM (
                    SELECT *, CASE WHEN phase = 1 THEN CASE WHEN length(buffer) // 4 >= {_TARGET} THEN 'out' ELSE 'on' END
                                   WHEN length(buffer) // 4 + length(p) // 4 > {int(2.5 * _TARGET)} THEN CASE WHEN buffer <> '' AND fresh THEN 'out' WHEN buffer <> '' THEN 'drop' ELSE 'cut' END
                                   WHEN fresh AND length(buffer) // 4 + length(p) // 4 > 1.2 * {_TARGET} THEN 'over' ELSE 'take' END AS act,
                           array_to_string(kept[greatest(1, len(kept) - {_OVERLAP - 1}):], ' ') AS tail
                    FROM (SELECT *, coalesce(lines[i + 1], '') AS p, string_split_regex({_sql_strip("coalesce(lines[i + 1], '')")}, '{_SPACES}+') AS words, string_split_regex({_sql_strip("buffer")}, '{_SPACES}+') AS kept FROM t WHERE i < len(lines) OR phase = 1))))),
    out AS (
        SELECT key, block, scene, step, given, a, z, divided FROM t WHERE given IS NOT NULL
        UNION ALL
        SELECT key, block, scene, step + 1, buffer, least(first + 1, greatest(len(lines), 1)), len(lines), false FROM t WHERE phase = 0 AND i >= len(lines) AND length({_sql_strip("buffer")}) > 100)
    SELECT sha256(key || '|' || sequence) AS chunk_id, key, sequence, structure_type, structure_ref, text FROM (
        SELECT key, row_number() OVER (PARTITION BY key ORDER BY block, scene, step) - 1 AS sequence, coalesce(nullif(block_type, ''), 'UnknownType') AS structure_type,
               coalesce(nullif(structural_marker, ''), 'Unknown') || ' / Scene ' || scene || ' / Paras ' || a || '-' || z || CASE WHEN divided THEN ' (split)' ELSE '' END AS structure_ref, given AS text
        FROM out JOIN b USING (key, block))
"""


@_query("chunk_markers", _PIECES + "SELECT * FROM m")
def chunk_markers(spark, d):
    return ch.markers(table(spark, d, "documents"), "doc_id", "text")


_STRUCTURAL = _PIECES + f"""
    , u AS (SELECT *, sum(accepted::INT) OVER (PARTITION BY key ORDER BY i) AS unit, max(accepted) OVER (PARTITION BY key) AS has FROM m),
    g AS (SELECT key, unit, string_agg(match || gap, '' ORDER BY i) AS text, any_value(match) FILTER (accepted) AS match, min(start_char) AS start_char FROM u WHERE has GROUP BY 1, 2),
    k AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY unit) - 1)::INT AS block_index,
                 coalesce(upper(match[1]) || lower(regexp_extract(match, '^[A-Za-z]+')[2:]), 'DetectedStructure') AS type, coalesce(regexp_extract(match, '\\s+(.*)$', 1), 'Unit ' || (unit + 1)::BIGINT) AS ref
          FROM g WHERE length({_sql_strip('text')}) > 0),
    st AS (SELECT key, block_index, {_sql_strip(_CLEAN)} AS text, type, ref, type || ' ' || ref AS structural_marker, start_char FROM k)
"""


@_query("chunk_structural_blocks", _STRUCTURAL + "SELECT * FROM st")
def chunk_structural_blocks(spark, d):
    return ch.structural_blocks(table(spark, d, "documents"), "doc_id", "text")


@_query("chunk_coarse_blocks", _STRUCTURAL.replace("WITH p AS", "WITH RECURSIVE p AS", 1) + f"""
    , plain AS (SELECT doc_id::VARCHAR AS key, text FROM documents WHERE length(text) > 0 AND doc_id::VARCHAR NOT IN (SELECT key FROM st)), {_windows_sql("plain", 200_000, 250_000, "fb")}
    SELECT * FROM st UNION ALL {_fallback("fb")}
""")
def chunk_coarse_blocks(spark, d):
    return ch.coarse_blocks(table(spark, d, "documents"), "doc_id", "text")


@_query("chunk_fallback_blocks", f"""
    WITH RECURSIVE plain AS (SELECT doc_id::VARCHAR AS key, text FROM documents WHERE length(text) > 0), {_windows_sql("plain", 2000, 2500, "fb")}
    {_fallback("fb")}
""")
def chunk_fallback_blocks(spark, d):
    return ch.fallback_blocks(table(spark, d, "documents"), "doc_id", "text", tokens=500, least=100)


@_query("chunk_scenes", f"""
    WITH p AS (SELECT row_id::VARCHAR AS key, start_char AS first, string_split_regex(text, '{_JAVA_SCENE}') AS parts, regexp_extract_all(text, '{_JAVA_SCENE}') AS breaks FROM large_blocks WHERE length(text) > 0),
    e AS (SELECT key, first, unnest(parts) AS part, unnest([''] || breaks) AS gap, unnest(range(len(parts))) AS i FROM p),
    o AS (SELECT *, first + length(gap) + coalesce(sum(length(part) + length(gap)) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM e)
    SELECT key, (row_number() OVER (PARTITION BY key ORDER BY i) - 1)::INT AS piece_index, {_sql_strip("part")} AS text, pos + lead AS start_char, pos + lead + length({_sql_strip("part")}) AS end_char
    FROM (SELECT *, length(part) - length(regexp_replace(part, '^{_SPACES}+', '')) AS lead FROM o) WHERE length({_sql_strip("part")}) > 0
""")
def chunk_scenes(spark, d):
    return ch.scene_pieces(table(spark, d, "large_blocks"), "row_id", "text", "start_char")


@_query("chunk_paragraphs", f"""
    WITH l AS (SELECT row_id::VARCHAR AS key, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10)))))::INT AS paragraph_index FROM large_blocks WHERE length(text) > 0)
    SELECT key, paragraph_index, {_sql_strip('raw')} AS text FROM l WHERE length({_sql_strip('raw')}) > 0
""")
def chunk_paragraphs(spark, d):
    return ch.paragraphs(table(spark, d, "large_blocks"), "row_id", "text")


@_query("chunk_adaptive", _ADAPTIVE)
def chunk_adaptive(spark, d):
    blocks = lib.once(table(spark, d, "large_blocks"), ["document_id", "block_index"], "ingested_at", "row_id")
    return ch.adaptive_chunks(blocks, key="document_id", kind="block_type", target=_TARGET, overlap=_OVERLAP)


@_query("chunk_token_windows", f"""
    WITH w AS (SELECT doc_id::VARCHAR AS key, list_filter(string_split({_sql_strip(f'''regexp_replace(text, '{_SPACES}+', ' ', 'g')''')}, ' '), lambda x: x <> '') AS words FROM documents WHERE length(text) > 0),
    s AS (SELECT key, words, unnest(range(0, greatest(0, len(words) - 61) + 1, 340)) AS start FROM w WHERE len(words) > 0)
    SELECT key, (start // 340)::INT AS chunk_index, array_to_string(words[start + 1 : start + 400], ' ') AS text FROM s
""")
def chunk_token_windows(spark, d):
    return ch.token_windows(table(spark, d, "documents"), "doc_id", "text")


@_query("chunk_recursive")
def chunk_recursive(spark, d):
    return ch.recursive_chunks(table(spark, d, "documents"), "doc_id", "text")


# ---- library


@_query("library_reconstruct", _CHUNKS + """
    , r AS (SELECT c.document_id, c.chunk_num, text, coalesce(chunk_overlap, 0) AS lap, min(chunk_num) OVER (PARTITION BY c.document_id) AS first FROM c JOIN library_docs d ON c.document_id = d.document_id)
    SELECT document_id AS key, coalesce(string_agg(CASE WHEN chunk_num > first THEN substring(text, lap + 1) ELSE text END, '' ORDER BY chunk_num), '') AS text FROM r WHERE text IS NOT NULL GROUP BY 1
""")
def library_reconstruct(spark, d):
    overlaps = table(spark, d, "library_docs").select("document_id", "chunk_overlap")
    return ch.reconstruct(_chunks(spark, d).join(overlaps, "document_id"), "document_id", "chunk_num", "text", "chunk_overlap")


@_query("library_listing", "SELECT document_id, concat(coalesce(doc_name, 'None'), ' - ', coalesce(subject, 'None'), ' - ', coalesce(strftime(date_added, '%Y-%m-%d %H:%M:%S'), 'None')) AS line FROM library_docs")
def library_listing(spark, d):
    return lib.listing(table(spark, d, "library_docs"))


@_query("library_chunk_lines", _CHUNKS + """
    SELECT document_id, chunk_num, 'Chunk ' || (row_number() OVER (PARTITION BY document_id ORDER BY chunk_num) - 1) || ':' || chr(10) || coalesce(text, '') AS line
    FROM c SEMI JOIN library_docs USING (document_id) WHERE chunk_num IS NOT NULL
""")
def library_chunk_lines(spark, d):
    return lib.chunks_of(table(spark, d, "library_docs"), _chunks(spark, d))


@_query("library_chunk_bounds", _CHUNKS + "SELECT document_id, min(chunk_num) AS start_chunk_id, max(chunk_num) AS end_chunk_id, count(*) AS n_chunks FROM c WHERE document_id IS NOT NULL GROUP BY 1")
def library_chunk_bounds(spark, d):
    return lib.chunk_bounds(_chunks(spark, d))


@_query("library_next_number", "SELECT coalesce(max(end_chunk_id) FILTER (document_id = (SELECT document_id FROM library_docs WHERE end_chunk_id IS NOT NULL ORDER BY date_added DESC NULLS LAST, document_id DESC LIMIT 1)) + 1, 0)::BIGINT AS next_number FROM library_docs")
def library_next_number(spark, d):
    return lib.next_chunk_number(table(spark, d, "library_docs").where("end_chunk_id is not null"), "date_added")


@_query("library_duplicate_names", "SELECT doc_name, count(*) AS n FROM (SELECT lower(subject) AS doc_name FROM library_docs) WHERE doc_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def library_duplicate_names(spark, d):
    return lib.duplicate_names(table(spark, d, "library_docs").select(F.lower("subject").alias("doc_name")))


@_query("library_orphans", "SELECT row_id, chunk_id FROM chunks_with_analysis ANTI JOIN chunks USING (chunk_id)")
def library_orphans(spark, d):
    known = table(spark, d, "chunks").select(F.col("chunk_id").alias("document_id"))
    rows = table(spark, d, "chunks_with_analysis").select("row_id", F.col("chunk_id").alias("document_id"))
    return lib.orphans(rows, known).select("row_id", F.col("document_id").alias("chunk_id"))


@_query("library_like", "SELECT row_id, chunk_id FROM chunks WHERE text ILIKE '%velvet _urned%'")
def library_like(spark, d):
    return lib.like(table(spark, d, "chunks"), "velvet _urned").select("row_id", "chunk_id")


@_query("library_by_ids", "SELECT row_id, chunk_id FROM chunks SEMI JOIN (SELECT chunk_id FROM chunks_with_analysis WHERE analysis_status = 'error') USING (chunk_id)")
def library_by_ids(spark, d):
    failed = table(spark, d, "chunks_with_analysis").where("analysis_status = 'error'")
    return lib.by_ids(table(spark, d, "chunks"), failed).select("row_id", "chunk_id")


@_query("library_chunk_range", "SELECT row_id, chunk_num FROM chunks JOIN library_docs USING (document_id) WHERE chunk_num BETWEEN start_chunk_id AND end_chunk_id")
def library_chunk_range(spark, d):
    docs = table(spark, d, "library_docs").select("document_id", "start_chunk_id", "end_chunk_id")
    return table(spark, d, "chunks").join(docs, "document_id").where(F.col("chunk_num").between(F.col("start_chunk_id"), F.col("end_chunk_id"))).select("row_id", "chunk_num")


@_query("library_history", """
    SELECT user_id, event_id, coalesce(string_agg(event_type, chr(10)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM events
""")
def library_history(spark, d):
    return lib.history(table(spark, d, "events"), "user_id", "event_id", "event_type")


@_query("library_number_chunks", "SELECT row_id, (row_number() OVER (ORDER BY start_chunk_id, row_id) - 1)::BIGINT AS chunk_num FROM large_blocks JOIN library_docs USING (document_id) WHERE start_chunk_id IS NOT NULL")
def library_number_chunks(spark, d):
    docs = table(spark, d, "library_docs").where("start_chunk_id is not null").select("document_id", "start_chunk_id")
    rows = table(spark, d, "large_blocks").select("document_id", "row_id").join(docs, "document_id")
    return lib.number_chunks(rows, "start_chunk_id", "row_id").select("row_id", "chunk_num")


@_query("library_latest_rows", _CHUNKS + "SELECT chunk_id, row_id, chunk_num FROM c")
def library_latest_rows(spark, d):
    return _chunks(spark, d).select("chunk_id", "row_id", "chunk_num")

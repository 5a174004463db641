"""SQL of the queries in corpus_queries.py that read analyses."""

from __future__ import annotations

from quire.operators import analyses as an
from quire.operators import json_sql as js
from quire.operators.library_queries import _sql_strip as strip


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _latest(source: str, keys: str, where: str = "true") -> str:
    return f"(SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY analysed_at DESC NULLS LAST, row_id DESC) = 1)"


# ---- blocks

_BLOCKS = f"""
    WITH b AS {_latest("block_analysis", "document_id, block_index", "document_id IS NOT NULL")},
    {js.readable("(SELECT row_id, document_id, block_index, analysis AS text FROM b)")},
    {js.objects("root")},
    names AS (
        SELECT DISTINCT document_id, kind, {strip("name")} AS name FROM (
            SELECT document_id, kind, {js.name_of("x")} AS name FROM (
                SELECT document_id, kind, unnest(held) AS x FROM ({" UNION ALL ".join(f"SELECT document_id, '{k}' AS kind, {js.elements(js.member(js.inner('''json_extract(v, '$.key_entities_in_block')'''), k))} AS held FROM object" for k in ("characters", "locations", "organizations"))})))
        WHERE {strip("name")} <> ''),
    summaries AS (
        SELECT document_id, coalesce(string_agg('Block ' || block_index || ' Summary (Ref: ' || coalesce({js.text("json_extract(v, '$.structural_marker_found')")}, 'Unknown') || '): ' || coalesce({js.text("json_extract(v, '$.block_summary')")}, 'Summary Unavailable') || chr(10), '' ORDER BY block_index), '') AS text
        FROM (SELECT b.document_id, b.block_index, o.v FROM b LEFT JOIN object o USING (row_id)) GROUP BY 1)
"""

# ---- chunks

_ID = "regexp_replace(lower({label}) || '_' || lower(replace(name, ' ', '_')), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}]+', '', 'g')".format(label="label")
_KINDS = (("characters", "Character"), ("locations", "Location"), ("organizations", "Organization"))
_CHUNKS = f"""
    WITH c AS {_latest("chunks_with_analysis", "chunk_id", "analysis_status = 'success' AND chunk_id IS NOT NULL")},
    {js.readable("(SELECT row_id, document_id, chunk_id, chunk_seq, analysis AS text FROM c)")},
    {js.objects("root")},
    e AS ({" UNION ALL ".join(f"SELECT document_id, chunk_id, '{label}' AS label, unnest({js.elements(js.member(js.inner('''json_extract(v, '$.entities')'''), field))}) AS x FROM object" for field, label in _KINDS)}),
    raw_names AS (SELECT document_id, chunk_id, label, {js.name_of("x")} AS raw, label = 'Character' AND coalesce(CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.mentioned_or_present') END = 'present', false) AS present FROM e),
    mentions AS (SELECT *, {_ID} AS id FROM (SELECT document_id, chunk_id, label, {strip("raw")} AS name, present FROM raw_names) WHERE name <> ''),
    nodes AS (
        SELECT id, min(label) AS labels, list(name ORDER BY name) AS names FROM (SELECT DISTINCT id, label, name FROM mentions) GROUP BY 1),
    entity_nodes AS (SELECT id, labels, names[1] AS name, CASE WHEN len(names) > 1 THEN 'aliases=' || array_to_string(names[2:], '|') END AS aliases FROM nodes),
    known AS (SELECT DISTINCT document_id, label, name, id FROM mentions WHERE document_id IS NOT NULL),
    i AS (SELECT document_id, chunk_id, chunk_seq, unnest(held) AS x, unnest(range(len(held))) AS pos FROM (SELECT document_id, chunk_id, chunk_seq, {js.elements("json_extract(v, '$.relationships_interactions')")} AS held FROM object)),
    p AS (SELECT document_id, chunk_id, pos, unnest(held) AS y, unnest(range(len(held))) AS k FROM (SELECT document_id, chunk_id, pos, {js.elements(js.member("x", "participants"))} AS held FROM i)),
    named AS (SELECT document_id, chunk_id, pos, k, {strip(f"coalesce(CASE WHEN json_type(y) = 'OBJECT' THEN {js.name_of('y')} ELSE {js.text('y')} END, '')")} AS name FROM p),
    met AS (SELECT n.document_id, chunk_id, pos, list(id ORDER BY k) AS ids FROM named n LEFT JOIN (FROM known WHERE label = 'Character') USING (document_id, name) GROUP BY 1, 2, 3 HAVING bool_and(id IS NOT NULL) AND count(*) >= 2),
    placed AS (SELECT i.*, {strip(js.text(js.member("x", "location")))} AS place FROM i),
    ends AS (
        SELECT m.chunk_id, m.pos, m.ids, chunk_seq, x, k.id AS location_id, least(ids[1], ids[2]) AS src, greatest(ids[1], ids[2]) AS dst, coalesce({js.text(js.member("x", "summary"))}, '') AS summary
        FROM met m JOIN placed ON m.chunk_id = placed.chunk_id AND m.pos = placed.pos LEFT JOIN (FROM known WHERE label = 'Location') k ON k.document_id = m.document_id AND k.name = placed.place),
    firsts AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY src, dst, chunk_id, summary ORDER BY pos) = 1),
    interactions AS (
        SELECT src, dst, 'INTERACTED_WITH' AS type, concat_ws(';', 'interaction_type=' || coalesce({js.text(js.member("x", "type"))}, 'interaction'), 'location_id=' || location_id, 'sequence_marker=' || chunk_seq, 'source_chunk_id=' || chunk_id, 'summary=' || summary, 'topic=' || {js.text(js.member("x", "topic"))}) AS properties FROM firsts
        UNION ALL
        SELECT unnest(ids), location_id, 'PRESENT_AT_INTERACTION', concat_ws(';', 'sequence_marker=' || chunk_seq, 'source_chunk_id=' || chunk_id) FROM firsts WHERE location_id IS NOT NULL),
    present_edges AS (SELECT id AS src, chunk_id AS dst, CASE WHEN bool_or(present) THEN 'PRESENT_IN' ELSE 'MENTIONED_IN' END AS type, 'source_chunk_id=' || chunk_id AS properties FROM mentions GROUP BY id, chunk_id)
"""
_DOCS = f"""
    , d AS {_latest("doc_analysis", "document_id")},
    {js.readable("(SELECT document_id, structure AS text FROM d WHERE document_id IS NOT NULL)", "tree")},
    tops AS (SELECT document_id, CASE WHEN json_type(v) = 'OBJECT' AND json_exists(v, '$.structure') AND NOT json_exists(v, '$.type') THEN json_extract(v, '$.structure') ELSE v::JSON END AS v FROM tree WHERE v IS NOT NULL),
    held AS (SELECT document_id, list_filter({js.elements("v")}, lambda u: json_type(u) = 'OBJECT' AND u::VARCHAR <> '{{}}') AS held FROM tops),
    units AS (
        SELECT document_id, i, document_id || '_struct_' || (i + 1) AS id, replace(coalesce({js.text(js.member("u", "type"))}, 'Structure'), '/', '_or_') AS label, {js.text(js.member("u", "number"))} AS number, {js.text(js.member("u", "title"))} AS title
        FROM (SELECT document_id, unnest(held) AS u, unnest(range(len(held))) AS i FROM held)),
    structures AS (SELECT id, label, coalesce(title, 'Unit ' || coalesce(number, (i + 1)::VARCHAR)) AS title, number, document_id, i FROM units)
"""

SQL: dict[str, str] = {
    "analysis_consolidated": _BLOCKS
    + "SELECT document_id, " + ", ".join(f"coalesce(string_agg(name, '|' ORDER BY name) FILTER (kind = '{k}'), '') AS {k}" for k in ("characters", "locations", "organizations")) + " FROM names GROUP BY 1",
    "analysis_synthesis_input": _BLOCKS + "SELECT document_id, text FROM summaries",
    "analysis_reduce_prompts": _BLOCKS
    + ", lists AS (SELECT document_id, to_json({" + ", ".join(f"'{k}': coalesce(list(name ORDER BY name) FILTER (kind = '{k}'), [])" for k in ("characters", "locations", "organizations")) + "})::VARCHAR AS names FROM names GROUP BY 1), n AS (SELECT document_id, count(*) AS n FROM b GROUP BY 1)"
    + f" SELECT document_id, 'Bring together the summaries of ' || n || ' parts. {an.GUIDES['Novel']} Answer in JSON of the shape ' || {_q(an.DOC_SHAPE)} || '.' || chr(10) || chr(10) || 'Names:' || chr(10) || coalesce(names, '{{}}') || chr(10) || chr(10) || 'Summaries:' || chr(10) || text AS prompt"
    + " FROM summaries JOIN n USING (document_id) LEFT JOIN lists USING (document_id)",
    "analysis_block_prompts": f"SELECT row_id, 'Describe this part of a document (' || coalesce(structural_marker, 'unknown place') || '). Answer in JSON of the shape ' || {_q(an.BLOCK_SHAPE)} || '.' || chr(10) || chr(10) || CASE WHEN length(text) > 80000 THEN left(text, 80000) || chr(10) || '[shortened]' ELSE text END AS prompt FROM large_blocks",
    "analysis_chunk_prompts": f"WITH d AS {_latest('doc_analysis', 'document_id')} SELECT c.row_id, 'Context: ' || coalesce(CASE WHEN length(overall_summary) > 500 THEN left(overall_summary, 500) || '...' ELSE overall_summary END, 'none') || chr(10) || 'List what this passage holds. Answer in JSON of the shape ' || {_q(an.CHUNK_SHAPE)} || '.' || chr(10) || chr(10) || text AS prompt FROM chunks c LEFT JOIN d ON c.document_id = d.document_id",
    "graph_nodes": _CHUNKS + _DOCS
    + """
        SELECT document_id AS id, 'Document' AS labels, document_id AS name, 'document_id=' || document_id || ';summary=' || coalesce(overall_summary, '') || ';title=' || document_id || ';type=' || coalesce(document_type, 'Unknown') AS properties FROM d WHERE document_id IS NOT NULL
        UNION ALL SELECT id, label, title, concat_ws(';', 'number=' || number, 'structure_id=' || id, 'title=' || title) FROM structures
        UNION ALL SELECT id, labels, name, concat_ws(';', aliases, 'name=' || name) FROM entity_nodes
    """,
    "graph_edges": _CHUNKS + _DOCS
    + """
        SELECT document_id AS src, id AS dst, 'HAS_STRUCTURE' AS type, 'order=' || i AS properties FROM structures
        UNION ALL SELECT * FROM present_edges UNION ALL SELECT * FROM interactions
    """,
    "graph_linked_edges": _CHUNKS + "SELECT src, dst, type, properties FROM interactions SEMI JOIN entity_nodes n ON src = n.id WHERE dst IN (SELECT id FROM entity_nodes)",
    "graph_degrees": _CHUNKS + "SELECT id, type, count(*) AS degree FROM (SELECT src AS id, type FROM interactions UNION ALL SELECT dst, type FROM interactions) GROUP BY 1, 2",
    "graph_id_conflicts": _CHUNKS + "SELECT id, count(*) AS n FROM entity_nodes GROUP BY 1 HAVING count(*) > 1",
    "graph_neighbours": _CHUNKS
    + """
        , steps AS (
            SELECT DISTINCT s.id, s.other, s.type, s.direction, n.name
            FROM (SELECT src AS id, dst AS other, type, 'out' AS direction FROM interactions UNION ALL SELECT dst, src, type, 'in' FROM interactions) s
            JOIN entity_nodes n ON s.other = n.id WHERE s.id IN (SELECT id FROM entity_nodes))
        SELECT id, other, type, direction, name FROM steps QUALIFY row_number() OVER (PARTITION BY id ORDER BY type, other, direction, name) <= 10
    """,
    "graph_merged_nodes": _CHUNKS + "SELECT id, CASE WHEN labels < 'Known' THEN labels || '|Known' ELSE 'Known|' || labels END AS labels, name, concat_ws(';', aliases, 'checked=yes', 'name=' || name) AS properties FROM entity_nodes",
}

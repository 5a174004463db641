"""SQL text that reads analyses whose JSON drifts, for the SQL of queries that read them by functions.analysis_json."""

from __future__ import annotations


def _value(t: str) -> str:
    """The JSON value in a text: the text itself, or what stands between its first and last bracket."""
    inner = f"regexp_extract({t}, '(?s)[\\{{\\[].*[\\}}\\]]')"
    return f"CASE WHEN json_valid({t}) THEN {t} WHEN json_valid({inner}) THEN {inner} END"


def readable(source: str, name: str = "root") -> str:
    """CTEs that end in ``name``: the rows of ``source`` (a table or a query in brackets, with ``text``) and v, the value of the text, null where there is none. JSON encoded as a JSON string is decoded again."""
    steps = [f"{name}_0 AS (SELECT *, {_value('text')} AS v FROM {source})"]
    for i in range(1, 4):
        again = f"CASE WHEN json_type(v) = 'VARCHAR' THEN {_value('json_extract_string(v, chr(36))')} ELSE v END"
        steps.append(f"{name}_{i} AS (SELECT * REPLACE ({again} AS v) FROM {name}_{i - 1})")
    steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN json_type(v) <> 'VARCHAR' THEN v END AS v) FROM {name}_3)")
    return ",\n".join(steps)


def objects(source: str, name: str = "object") -> str:
    """CTEs that end in ``name``: rows of ``source`` whose v is an object, also one that stands alone in an array."""
    out = "CASE WHEN json_type(v) = 'ARRAY' AND json_array_length(v) = 1 THEN json_extract(v, '$[0]')::VARCHAR ELSE v END"
    return ",\n".join([
        f"{name}_0 AS (SELECT * REPLACE ({out} AS v) FROM {source})", f"{name}_1 AS (SELECT * REPLACE ({out} AS v) FROM {name}_0)",
        f"{name} AS (SELECT * FROM {name}_1 WHERE json_type(v) = 'OBJECT')",
    ])


def elements(x: str) -> str:
    """A list of the JSON values of a member that the schema has as an array: none of null, the value itself of a single one."""
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN []::JSON[] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


def member(x: str, key: str) -> str:
    """The member of an object, null of other values; an object that stands alone in an array is taken out of it where ``x`` was made by inner()."""
    return f"CASE WHEN json_type({x}) = 'OBJECT' THEN json_extract({x}, '$.{key}') END"


def inner(x: str) -> str:
    """A value, or what stands alone in an array."""
    return f"CASE WHEN json_type({x}) = 'ARRAY' AND json_array_length({x}) = 1 THEN json_extract({x}, '$[0]') ELSE {x} END"


def text(x: str) -> str:
    """A member that the schema has as a string, as text; null of null."""
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN NULL WHEN json_type({x}) = 'VARCHAR' THEN json_extract_string({x}, '$') ELSE {x}::VARCHAR END"


def name_of(x: str) -> str:
    """The name of an element that is a name or an object with one, null of others and of blanks."""
    own = f"CASE json_type({x}) WHEN 'VARCHAR' THEN json_extract_string({x}, '$') WHEN 'OBJECT' THEN CASE WHEN json_type(json_extract({x}, '$.name')) = 'VARCHAR' THEN json_extract_string({x}, '$.name') END END"
    return f"CASE WHEN regexp_matches({own}, '[^\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]') THEN {own} END"


def is_nothing(x: str) -> str:
    """Whether an element is null, "" or {}."""
    return f"({x} IS NULL OR json_type({x}) = 'NULL' OR {x}::VARCHAR IN ('\"\"', '{{}}'))"

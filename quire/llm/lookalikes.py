"""One form for text that looks the same, as SQL that DuckDB runs inside each Arrow partition.

Invisible signs go; spaces of any width become the plain one; compatibility letters (full-width, mathematical,
ligatures, long s, Roman numeral signs inside words) become the plain ones; letters and separate accents are composed (NFC); a letter of
another script inside a word becomes the one of the word's script that looks like it. Full-width punctuation stays in
texts of scripts that use it. Precomposed accents, typographic quotes and dashes, ordinary signs, line breaks and
whole words of another script stay.

Defined results: null stays null and empty empty, and neither is counted as changed; every row gives one row, repeated
rows too; applying the form twice changes nothing more.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cyrillic and Greek letters that look like Latin ones, and those.
CYRILLIC = "АВЕЅІЈКМНОРСТУХԚԜаеѕіјорсухԁһԛԝѵӏк"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXQWaesijopcyxdhqwvlk"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανοριυκτγχϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXavopiuktyxcj"
# Latin letters that look like letters of the other scripts, and those.
LATIN_C, TO_C = "ABEKMHOPCTYXaeopcyxkSIJsij", "АВЕКМНОРСТУХаеорсухкЅІЈѕіј"
LATIN_G, TO_G = "ABEZHIKMNOPTYXavopiuktyx", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανοριυκτγχ"
# Letters and hyphens that look like plainer ones and have no compatibility form.
PLAINER, PLAIN = "ɡıȷɑ‐‑", "gija--"
INVISIBLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0)))
SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
FULL_PUNCTUATION = "".join(c for c in map(chr, range(0xFF01, 0xFF5F)) if not unicodedata.normalize("NFKC", c).isalnum())


@lru_cache(maxsize=1)
def compatibility() -> tuple[str, str, dict[str, str]]:
    """Compatibility letters of one plain sign and their plain signs; those of several, by letter."""
    blocks = (range(0x17F, 0x180), range(0xFF10, 0xFF5B), range(0xFF61, 0xFFA0), range(0x1D400, 0x1D800), range(0x210A, 0x2116), range(0x2119, 0x211E), range(0x2124, 0x2139), range(0xFB00, 0xFB07))
    one: dict[str, str] = {}
    more: dict[str, str] = {}
    for c in (chr(i) for b in blocks for i in b):
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and c not in FULL_PUNCTUATION:
            (one if len(plain) == 1 else more)[c] = plain
    return "".join(one), "".join(one.values()), more


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_words(expr: str) -> str:
    """Roman numeral signs that touch a letter, as letters; a numeral that stands alone is an ordinary sign."""
    for i in range(0x2160, 0x2180):
        c, p = chr(i), unicodedata.normalize("NFKC", chr(i))
        expr = f"regexp_replace({expr}, '(^|[^{c}]){c}(\\p{{L}})', '\\1{p}\\2', 'g')"
        expr = f"regexp_replace({expr}, '(\\p{{L}}){c}', '\\1{p}', 'g')"
    return expr


WIDE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
OTHER = r"\p{Cyrillic}\p{Greek}"


@lru_cache(maxsize=1)
def form_sql(source: str = "passages") -> str:
    """SELECT of table_name, row_id, text, form and changed from a table of table_name, row_id, text."""
    one, plain, more = compatibility()
    expr = f"translate(translate(text, {_q(SPACES)}, {_q(' ' * len(SPACES))}), {_q(INVISIBLE)}, '')"
    expr = f"CASE WHEN regexp_matches(text, '[Ⅰ-ⅿ]') THEN {_in_words(expr)} ELSE {expr} END"
    expr = f"translate({expr}, {_q(one + PLAINER)}, {_q(plain + PLAIN)})"
    many = expr
    for c, p in more.items():
        many = f"replace({many}, {_q(c)}, {_q(p)})"
    greek_as_cyrillic = f"translate(translate(w, {_q(GREEK)}, {_q(GREEK_LATIN)}), {_q(LATIN_C)}, {_q(TO_C)})"
    cyrillic_as_greek = f"translate(translate(w, {_q(CYRILLIC)}, {_q(CYRILLIC_LATIN)}), {_q(LATIN_G)}, {_q(TO_G)})"
    word = f"""CASE
        WHEN regexp_matches(w, '\\p{{Cyrillic}}') AND regexp_matches(w, '\\p{{Greek}}') AND NOT regexp_matches(w, '\\p{{Latin}}')
            THEN CASE WHEN NOT regexp_matches({greek_as_cyrillic}, '[\\p{{Greek}}\\p{{Latin}}]') THEN {greek_as_cyrillic} WHEN NOT regexp_matches({cyrillic_as_greek}, '[\\p{{Cyrillic}}\\p{{Latin}}]') THEN {cyrillic_as_greek} ELSE w END
        WHEN NOT regexp_matches(w, '[{OTHER}]') OR NOT regexp_matches(w, '\\p{{Latin}}') THEN w
        WHEN NOT regexp_matches(translate(w, {_q(CYRILLIC + GREEK)}, {_q(CYRILLIC_LATIN + GREEK_LATIN)}), '[{OTHER}]') THEN translate(w, {_q(CYRILLIC + GREEK)}, {_q(CYRILLIC_LATIN + GREEK_LATIN)})
        WHEN regexp_matches(w, '\\p{{Cyrillic}}') AND NOT regexp_matches(translate(w, {_q(LATIN_C)}, {_q(TO_C)}), '\\p{{Latin}}') THEN translate(w, {_q(LATIN_C)}, {_q(TO_C)})
        WHEN regexp_matches(w, '\\p{{Greek}}') AND NOT regexp_matches(translate(w, {_q(LATIN_G)}, {_q(TO_G)}), '\\p{{Latin}}') THEN translate(w, {_q(LATIN_G)}, {_q(TO_G)})
        ELSE translate(w, {_q(CYRILLIC + GREEK)}, {_q(CYRILLIC_LATIN + GREEK_LATIN)}) END"""
    return f"""
        WITH plain AS (
            SELECT table_name, row_id, text,
                   CASE WHEN regexp_matches(text, '[{"".join(more)}]') THEN {many} ELSE {expr} END AS a
            FROM {source}),
        composed AS (
            SELECT table_name, row_id, text, nfc_normalize(
                CASE WHEN regexp_matches(a, '[{FULL_PUNCTUATION.replace("［", "").replace("］", "").replace("＼", "").replace("＾", "").replace("－", "")}－］［＼＾]') AND NOT regexp_matches(a, '[{WIDE}]')
                     THEN translate(a, {_q(FULL_PUNCTUATION)}, {_q("".join(unicodedata.normalize("NFKC", c) for c in FULL_PUNCTUATION))}) ELSE a END) AS b
            FROM plain),
        formed AS (
            SELECT table_name, row_id, text, b,
                   CASE WHEN regexp_matches(b, '\\p{{Latin}}[{OTHER}]|[{OTHER}]\\p{{Latin}}|\\p{{Greek}}\\p{{Cyrillic}}|\\p{{Cyrillic}}\\p{{Greek}}')
                        THEN array_to_string(list_transform(regexp_extract_all(b, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: {word}), '')
                        ELSE b END AS form
            FROM composed)
        SELECT table_name, row_id, text, form,
               coalesce(form <> text OR regexp_matches(form, '[\\p{{Latin}}{OTHER}][\\x{{300}}-\\x{{36f}}]'), false) AS changed
        FROM formed"""


FORM_SCHEMA = "table_name string, row_id bigint, text string, form string, changed boolean"
_COLUMNS = pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("text", pa.string()), ("form", pa.string()), ("changed", pa.bool_())])


def one_form(passages: DataFrame, *, only_changed: bool = False) -> DataFrame:
    """Every passage (table_name, row_id, text) with its form and whether it was not in it. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            for batch in batches:
                con.register("passages", pa.Table.from_batches([batch]).cast(pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("text", pa.string())])))
                out = con.sql(form_sql() + (" WHERE form <> text OR regexp_matches(form, '[\\x{300}-\\x{36f}]')" if only_changed else "")).to_arrow_table()
                con.unregister("passages")
                if only_changed:
                    out = out.filter(out.column("changed"))
                yield from out.cast(_COLUMNS).to_batches()

    return passages.select("table_name", F.col("row_id").cast("bigint").alias("row_id"), "text").mapInArrow(run, FORM_SCHEMA)


# ---- the same for single words, as the search for wrong decodings needs it

_TO_LATIN = str.maketrans(CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN)
_TO = {"C": str.maketrans(LATIN_C, TO_C), "G": str.maketrans(LATIN_G, TO_G), "L": _TO_LATIN}


@lru_cache(maxsize=1)
def _fold() -> dict:
    one, plain, more = compatibility()
    table: dict = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in SPACES}
    return table | {ord(a): b for a, b in zip(one + PLAINER, plain + PLAIN, strict=True)} | {ord(a): b for a, b in more.items()}


def _script(c: str) -> str:
    if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ɏ" and c not in "×÷":
        return "L"
    if "Ѐ" <= c <= "ԯ":
        return "C"
    return "G" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else ""


@lru_cache(maxsize=1 << 16)
def plain_form(word: str) -> str:
    """A word without invisible signs, composed, in plain letters, of one script where look-alikes allow it."""
    w = unicodedata.normalize("NFC", word.translate(_fold()))
    scripts = [s for c in w if (s := _script(c))]
    if len(set(scripts)) < 2:
        return w
    for s in sorted(set(scripts), key=lambda s: (s != "L", -scripts.count(s))):
        out = w.translate(_TO[s])
        if len({t for c in out if (t := _script(c))}) == 1:
            return out
    return w.translate(_TO_LATIN)

"""Text functions as column expressions. Null gives null unless said otherwise; offsets and lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Replacements of the cleaning, in their order: sequences of a wrong decoding, then signs.
CLEANING = (
    ("\u00e2\u20ac\u2122", "'"), ("\u00e2\u20ac\u0153", '"'), ("\u00e2\u20ac\u009d", '"'), ("\u00e2\u20ac\u201c", "-"), ("\u00e2\u20ac\u201d", "--"), ("\u00e2\u20ac\u00a6", "..."), ("\u00e2\u20ac\u02dc", "'"), ("\u00e2\u20ac", '"'), ("\u00c3\u00a9", "e"),
    ("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "-"), ("\u2014", "--"), ("\u2026", "..."), ("\u00a0", " "), ("\u00e9", "e"), ("\u00e8", "e"), ("\u00ea", "e"),
)
#: What counts as white space at the ends of a text, as a character class.
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(x: Col) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(_c(x), f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def clean(x: Col) -> Column:
    """Plain quotes, dashes, dots and e in place of their typographic or wrongly decoded forms; stripped."""
    x = _c(x)
    for bad, good in CLEANING:
        x = F.replace(x, F.lit(bad), F.lit(good))
    return strip(x)


def squeeze(x: Col) -> Column:
    """Runs of spaces and tabs as one space; line breaks stay."""
    return F.regexp_replace(_c(x), "[ \\t]+", " ")


def one_line(x: Col) -> Column:
    """Words separated by single spaces, whatever separated them."""
    return strip(F.regexp_replace(_c(x), f"{SPACE}+", " "))


def ascii_only(x: Col) -> Column:
    return F.regexp_replace(_c(x), "[^\\x00-\\x7F]+", "")


def capitalize(x: Col) -> Column:
    """First letter upper case, the rest lower."""
    x = _c(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2_147_483_647)))


def json_body(x: Col) -> Column:
    """Stripped, without a leading json fence and a closing fence."""
    return F.regexp_replace(F.regexp_replace(strip(x), "^```json", ""), "```\\z", "")


def token_estimate(x: Col) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(_c(x)) / 4).cast("int")


def document_id(path: Col) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(_c(path), r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def unix_path(path: Col) -> Column:
    """C:\\a b as /mnt/c/a\\ b."""
    path = _c(path)
    rest = F.replace(F.substring(path, 3, 2_147_483_647), F.lit("\\"), F.lit("/"))
    return F.replace(F.concat(F.lit("/mnt/"), F.lower(F.substring(path, 1, 1)), rest), F.lit(" "), F.lit("\\ "))


def stable_id(*parts: Col) -> Column:
    """An id that is the same each time it is made from the same parts."""
    return F.sha2(F.concat_ws("|", *[_c(p).cast("string") for p in parts]), 256)


def left(x: Col, n: int, more: str = "") -> Column:
    """At most n characters, followed by ``more`` where that is a part."""
    x = _c(x)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(more))).otherwise(x)


def entity_label(kind: Col) -> Column:
    """Kind of entity in the singular, capitalised: one s at the end goes."""
    return F.regexp_replace(capitalize(kind), "s\\z", "")


def entity_id(label: Col, name: Col) -> Column:
    """label_name in lower case, spaces as underscores, other signs dropped."""
    return F.regexp_replace(F.concat(F.lower(_c(label)), F.lit("_"), F.lower(F.replace(_c(name), F.lit(" "), F.lit("_")))), "(?U)\\W+", "")


# Date layouts in the order they are tried, each with its form, and the time layouts that may follow.
_DATES = (("yyyy-M-d", r"\d{4}-\d{1,2}-\d{1,2}"), ("d-M-yyyy", r"\d{1,2}-\d{1,2}-\d{4}"), ("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), ("yyyyMMdd", r"\d{8}"), ("MMM d, yyyy", r"[A-Za-z]{3} \d{1,2}, \d{4}"), ("MMMM d, yyyy", r"[A-Za-z]{3,9} \d{1,2}, \d{4}"))
_TWELVE = ((" h:m:sa", r" \d{1,2}:\d{1,2}:\d{1,2}[AaPp]M"), (" h:ma", r" \d{1,2}:\d{1,2}[AaPp]M"), ("", ""))
_COMPACT = (("hhmmssa", r"\d{6}[AaPp]M"), ("hhmma", r"\d{4}[AaPp]M"), ("", ""))
_TWENTY_FOUR = ((" H:m:s", r" \d{1,2}:\d{1,2}:\d{1,2}"), (" H:m", r" \d{1,2}:\d{1,2}"))
LAYOUTS = tuple((d + t, f + g) for d, f in _DATES for t, g in (_COMPACT if d == "yyyyMMdd" else _TWELVE)) + tuple((d + t, f + g) for d, f in _DATES if d != "yyyyMMdd" for t, g in _TWENTY_FOUR)


def parse_datetime(x: Col) -> Column:
    """The time that a text in one of 28 layouts names, null for others. Months by English names; am and pm in either case; fields may lack leading zeros. Only layouts whose form the text has are tried."""
    x = F.replace(F.replace(_c(x), F.lit("am"), F.lit("AM")), F.lit("pm"), F.lit("PM"))
    return F.coalesce(*[F.when(x.rlike(f"^{form}$"), F.try_to_timestamp(x, F.lit(layout)).cast("timestamp_ntz")) for layout, form in LAYOUTS])


def sentence_start(x: Col) -> Column:
    """From the first start of a sentence on (a capital after an end sign); without one, from the next word; else as it is."""
    x = _c(x)
    sentence = F.regexp_extract(x, f"(?s)[.?!][\"’”']?{SPACE}+([A-Z].*)\\z", 1)
    word = F.regexp_extract(x, f"(?s){SPACE}+([A-Za-z].*)\\z", 1)
    return F.when(F.length(sentence) > 0, sentence).when(F.length(word) > 0, word).otherwise(x)


def truncate(x: Col, most: int) -> Column:
    """At most ``most`` characters: up to the last sentence end, else the last space beyond the middle, else cut hard."""
    x = _c(x)
    sentence = F.regexp_extract(F.substring(x, 1, most + 1), f"(?s)^(.*[.!?][\"’”']?{SPACE})", 1)
    head = F.regexp_replace(F.substring(x, 1, most), f"{SPACE}+\\z", "")
    word = F.regexp_extract(head, "(?s)^(.*) ", 1)
    return F.when(F.length(x) <= most, strip(x)).when(F.length(sentence) > 0, strip(sentence)).when(F.length(word) > most * 0.5, strip(word)).otherwise(head)

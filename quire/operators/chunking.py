"""Texts into blocks, scenes, paragraphs and chunks.

Inputs are keyed texts, one row a text; further columns are not read. Null and empty texts give no rows. Texts are
read whole. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.statistics import ranked
from quire.plans.session import written

#: A structural marker, line beginnings that make it none, and a scene break.
MARKER = r"(CHAPTER|PART|BOOK)\s+([IVXLCDM\d]+)"
NOT_MARKERS = ("to ", "heading to ", "contents:", "illustrations:")
SCENE_BREAK = r"\n\s*\n\s*\n+"

BLOCK_SCHEMA = "key string, block_index int, text string, type string, ref string, structural_marker string, start_char bigint"


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null and length(text) > 0")


def markers(df: DataFrame, key: str, text: str, *, strict: bool = False) -> DataFrame:
    """key, i, gap, match, start_char, accepted: a text as pieces, each a marker (none in piece 0) and what follows it.

    Matches and gaps between them are taken by two expressions of the same pattern, offsets by running sums, so a text
    crosses a shuffle once, in its pieces. strict: markers must end at a word boundary and be written in capitals or
    with a capital first letter.
    """
    pattern = rf"\b(CHAPTER|PART|BOOK|Chapter|Part|Book)\s+([IVXLCDM\d]+)\b" if strict else f"(?i){MARKER}"
    rows = _keyed(df, key, text).select("key", F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("matches"))
    each = rows.select("key", F.posexplode(F.arrays_zip("gaps", F.concat(F.array(F.lit("")), "matches").alias("found"))).alias("i", "p")).select("key", "i", F.col("p.gaps").alias("gap"), F.col("p.found").alias("match"))
    w = Window.partitionBy("key").orderBy("i")
    before = F.lag("gap").over(w)
    size = F.length("gap") + F.length("match")
    # the beginning of the line a marker stands in: the rest of the last gap with a line break, or of the text's first
    tail = F.when(F.col("gap").contains("\n") | (F.col("i") == 0), F.substring_index("gap", "\n", -1))
    line = F.last(tail, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = each.select("key", "i", "gap", "match", before.alias("before"), line.alias("line"), F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("start_char"))
    head = F.lower(F.regexp_replace("line", f"^{tx.SPACE}+", ""))
    ignored = F.lit(False)
    for p in NOT_MARKERS:
        ignored = ignored | head.startswith(p)
    after_space = F.regexp_like("before", F.lit(f"{tx.SPACE}\\z"))
    accepted = (F.col("i") > 0) & (F.col("start_char") > 0) & ~ignored & after_space
    return placed.select("key", "i", "gap", "match", "start_char", F.coalesce(accepted, F.lit(False)).alias("accepted"))


def structural_blocks(df: DataFrame, key: str, text: str, *, strict: bool = False) -> DataFrame:
    """Blocks between accepted markers, of texts that have any beyond their beginning."""
    w = Window.partitionBy("key").orderBy("i")
    pieces = markers(df, key, text, strict=strict)
    number = F.sum(F.col("accepted").cast("int")).over(w)
    blocks = pieces.select("key", "i", "gap", "match", "start_char", "accepted", number.cast("int").alias("unit")).groupBy("key", "unit").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.concat("match", "gap").alias("t")))), lambda p: p["t"]), "").alias("raw"),
        F.min(F.when(F.col("accepted"), F.col("match"))).alias("match"), F.min("start_char").alias("start_char"), F.max("accepted").alias("marked"),
    )
    held = blocks.withColumn("any", F.max("marked").over(Window.partitionBy("key"))).where("any").where(F.length(tx.strip("raw")) > 0)
    kind = F.coalesce(tx.capitalize(F.regexp_extract("match", f"(?i){MARKER}", 1)), F.lit("DetectedStructure"))
    ref = F.coalesce(F.regexp_extract("match", f"(?i){MARKER}", 2), F.concat(F.lit("Unit "), (F.col("unit") + 1).cast("string")))
    index = F.row_number().over(Window.partitionBy("key").orderBy("unit")) - 1
    return held.select("key", index.alias("block_index"), tx.clean("raw").alias("text"), kind.alias("type"), ref.alias("ref"), F.concat_ws(" ", kind, ref).alias("structural_marker"), F.when(F.col("unit") == 0, 0).otherwise(F.col("start_char")).cast("bigint").alias("start_char"))


def _windows(text: str, target: int, most: int, least: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(text):
        end = text.find(". ", at + target)
        if end < 0:
            end = text.find("\n", at + target)
        if end < 0 or end < at + least:
            end = min(len(text), at + most)
        yield at, end
        at = end + 1  # the sign at the cut goes


def fallback_blocks(df: DataFrame, key: str, text: str, *, tokens: int = 50_000, least: int = 10_000) -> DataFrame:
    """Windows of about 4 ``tokens`` characters, each ended at the next sentence or line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = 0
                for a, b in _windows(t, tokens * 4, tokens * 5, least * 4):
                    if t[a:b].strip():
                        for column, x in zip(out, (k, index, t[a:b], a), strict=True):
                            column.append(x)
                        index += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["key", "block_index", "raw", "start_char"])

    rows = _keyed(df, key, text).mapInArrow(run, "key string, block_index int, raw string, start_char bigint")
    number = (F.col("block_index") + 1).cast("string")
    return rows.select("key", "block_index", tx.clean("raw").alias("text"), F.lit("FallbackBlock").alias("type"), F.concat(F.lit("Block "), number).alias("ref"), F.concat(F.lit("FallbackBlock "), number).alias("structural_marker"), "start_char")


def coarse_blocks(df: DataFrame, key: str, text: str, *, strict: bool = False, tokens: int = 50_000) -> DataFrame:
    """Structural blocks where a text has markers, windows where it has none. ``key`` is unique."""
    structural = structural_blocks(df, key, text, strict=strict)
    rest = df.where(~F.col(key).isNull()).join(structural.select(F.col("key").alias("_done")).distinct(), F.col(key).cast("string") == F.col("_done"), "left_anti")
    return structural.unionByName(fallback_blocks(rest, key, text, tokens=tokens))


def scene_pieces(df: DataFrame, key: str, text: str, start: str | None = None) -> DataFrame:
    """key, piece_index, text, start_char, end_char: parts between scene breaks, stripped, with their offsets."""
    first = F.col(start).cast("bigint") if start else F.lit(0).cast("bigint")
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), first.alias("first")).where("length(text) > 0")
    parts = rows.select("key", "first", F.split("text", SCENE_BREAK, -1).alias("parts"), F.regexp_extract_all("text", F.lit(SCENE_BREAK), F.lit(0)).alias("breaks"))
    each = parts.select("key", "first", F.posexplode(F.arrays_zip("parts", F.concat(F.array(F.lit("")), "breaks").alias("gap"))).alias("i", "p"))
    w = Window.partitionBy("key", "first").orderBy("i")
    size = F.length("p.parts") + F.length("p.gap")
    placed = each.select("key", "first", "i", F.col("p.parts").alias("part"), (F.col("first") + F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("p.gap")).alias("at"))
    body = tx.strip("part")
    lead = F.length("part") - F.length(F.regexp_replace("part", f"^{tx.SPACE}+", ""))
    kept = placed.where(F.length(body) > 0)
    return kept.select("key", (F.row_number().over(Window.partitionBy("key", "first").orderBy("i")) - 1).alias("piece_index"), body.alias("text"), (F.col("at") + lead).alias("start_char"), (F.col("at") + lead + F.length(body)).alias("end_char"))


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, paragraph_index, text: stripped lines that are not blank, numbered by line."""
    each = _keyed(df, key, text).select("key", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw")).select("key", "line", tx.strip("raw").alias("text"))
    return each.where(F.length("text") > 0).select("key", F.col("line").alias("paragraph_index"), "text")


# ---- chunks


def quarter(s: str) -> int:
    """Tokens estimated as a quarter of the characters."""
    return len(s) // 4


def pack(text: str, target: int, overlap: int, *, least: int = 100, size: Callable[[str], int] = quarter) -> Iterator[tuple[str, int, int, int, bool]]:
    """(chunk, scene, first paragraph, last paragraph, split) of a block, greedily.

    Paragraphs are lines; tokens are counted by ``size``, by default estimated as a quarter of the characters. A buffer takes paragraphs until it has
    ``target`` tokens, is given out before a paragraph that would bring it over 1.2 targets, and starts anew with its
    last ``overlap`` words. A paragraph over 2.5 targets is cut at words. What is left at the end of a scene is given
    out if it has more than ``least`` characters. Where overlap and paragraph together are over the limit, the overlap
    goes; a word over the limit is cut by characters: so every step gives something out or takes something in.
    """
    most = int(2.5 * target)

    def tail(s: str) -> str:
        return " ".join(s.split()[-overlap:]) if overlap > 0 else ""

    for number, scene in enumerate(re.split(SCENE_BREAK, text), 1):
        lines = [s for line in scene.split("\n") if (s := line.strip())]
        buffer, first, fresh, i = "", 0, False, 0
        while i < len(lines):
            p = lines[i]
            if size(buffer) + size(p) > most:
                if buffer and fresh:
                    yield buffer, number, first + 1, i, False
                    buffer, first, fresh = tail(buffer), i, False
                elif buffer:
                    buffer = ""
                else:
                    words = p.split()
                    # the most words that fit, by halving, as more words are no fewer tokens
                    taken, beyond = 0, len(words) + 1
                    while beyond - taken > 1:
                        half = (taken + beyond) // 2
                        taken, beyond = (half, beyond) if size(" ".join(words[:half])) <= most else (taken, half)
                    head, rest = (" ".join(words[:taken]), " ".join(words[taken:])) if taken else (p[: most * 4], p[most * 4 :])
                    yield head, number, i + 1, i + 1, True
                    if rest.strip():
                        lines[i] = rest.strip()
                    else:
                        i += 1
                    first = i
                continue
            if fresh and size(buffer) + size(p) > 1.2 * target:
                yield buffer, number, first + 1, i, False
                buffer, first = f"{tail(buffer)} {p}".strip(), i
            else:
                buffer = f"{buffer} {p}".strip()
            fresh = True
            i += 1
            if size(buffer) >= target:
                yield buffer, number, first + 1, i, False
                buffer, first, fresh = tail(buffer), i, False
        if len(buffer.strip()) > least:
            yield buffer, number, min(first + 1, max(len(lines), 1)), len(lines), False


def adaptive_chunks(blocks: DataFrame, *, key: str = "key", index: str = "block_index", text: str = "text", kind: str = "type", marker: str = "structural_marker", target: int = 1000, overlap: int = 100, size: Callable[[str], int] = quarter) -> DataFrame:
    """chunk_id, key, sequence, structure_type, structure_ref, text of blocks; sequence runs through all blocks of a key.

    A block is packed within its task, once, and written; sequences are the packed counts of the blocks before, by
    ranked(), so no task holds a key's chunks. size: counts the tokens of a text, where an estimate will not do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for k, b, t, n, m in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for local, (chunk, scene, a, z, divided) in enumerate(pack(t, target, overlap, size=size)):
                    ref = f"{m or 'Unknown'} / Scene {scene} / Paras {a}-{z}" + " (split)" * divided
                    for column, x in zip(out, (k, b, local, n or "UnknownType", ref, chunk), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["key", "block", "local", "structure_type", "structure_ref", "text"])

    source = blocks.select(F.col(key).cast("string"), F.col(index).cast("bigint"), F.col(text).cast("string"), F.col(kind).cast("string"), F.col(marker).cast("string")).where(F.col(key).isNotNull() & F.col(index).isNotNull() & (F.length(text) > 0))
    chunks = written(source.mapInArrow(run, "key string, block bigint, local int, structure_type string, structure_ref string, text string"))
    before = ranked(chunks, ["key"], "block").select("key", F.col("x").cast("bigint").alias("block"), "before")
    sequence = (F.col("before") + F.col("local")).cast("bigint")
    return chunks.join(before, ["key", "block"]).select(tx.stable_id("key", sequence).alias("chunk_id"), "key", sequence.alias("sequence"), "structure_type", "structure_ref", "text")


def token_windows(df: DataFrame, key: str, text: str, *, size: int = 400, overlap: int = 60) -> DataFrame:
    """key, chunk_index, text: windows of ``size`` words, each beginning ``size - overlap`` words after the one before; the last one reaches the end."""
    step = size - overlap
    rows = _keyed(df, key, text).select("key", F.filter(F.split(tx.one_line("text"), " "), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - overlap - 1), F.lit(step))
    each = rows.select("key", "words", F.posexplode(starts).alias("chunk_index", "start"))
    return each.select("key", "chunk_index", F.array_join(F.slice("words", F.col("start") + 1, size), " ").alias("text"))


def tokenizer_windows(df: DataFrame, key: str, text: str, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], *, size: int = 400, overlap: int = 60) -> DataFrame:
    """key, chunk_index, text: windows of ``size`` tokens of a tokenizer, each beginning ``size - overlap`` tokens after the one before; the last one reaches the end. Decoding must give text for any run of ids."""
    step = size - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, ns, ts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(t)
                for n, at in enumerate(range(0, max(1, len(ids) - overlap), step)):
                    ks.append(k)
                    ns.append(n)
                    ts.append(decode(ids[at : at + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(ns, pa.int32()), pa.array(ts, pa.string())], names=["key", "chunk_index", "text"])

    return _keyed(df, key, text).mapInArrow(run, "key string, chunk_index int, text string")


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, split at the first separator that occurs, its parts merged with up to ``overlap`` characters of the parts before; parts that are too large are split by the next separator."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    out: list[str] = []
    held: list[str] = []

    def give() -> None:
        if joined := sep.join(held).strip():
            out.append(joined)

    for part in list(text) if sep == "" else text.split(sep):
        if len(part) > size:
            give()
            held = []
            out.extend(recursive_pieces(part, size, overlap, rest or ("",)))
            continue
        while held and len(sep.join([*held, part])) > size:
            give()
            while held and (len(sep.join(held)) > overlap or len(sep.join([*held, part])) > size):
                held.pop(0)
            break
        held.append(part)
    give()
    return out


def recursive_chunks(df: DataFrame, key: str, text: str, *, size: int = 512, overlap: int = 100) -> DataFrame:
    """key, chunk_index, text by recursive_pieces()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, ns, ts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, piece in enumerate(recursive_pieces(t, size, overlap)):
                    ks.append(k)
                    ns.append(n)
                    ts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(ns, pa.int32()), pa.array(ts, pa.string())], names=["key", "chunk_index", "text"])

    return _keyed(df, key, text).mapInArrow(run, "key string, chunk_index int, text string")


def overlap_removed(number: Column, text: Column, overlap: Column) -> Column:
    """A chunk's text without the characters it repeats, which the first chunk (number 0) has none of."""
    return F.when(number == 0, text).otherwise(text.substr(overlap + 1, F.length(text)))


def reconstruct(chunks: DataFrame, key: str, order: str, text: str, overlap: str) -> DataFrame:
    """key, text: a document from its chunks, each after the first without its overlap. One row holds a document, as the question has it."""
    first = F.min(order).over(Window.partitionBy(key))
    rows = chunks.select(F.col(key).alias("key"), F.col(order).alias("o"), F.col(text).alias("t"), F.coalesce(F.col(overlap), F.lit(0)).alias("lap"), first.alias("first")).where("t is not null")
    part = overlap_removed((F.col("o") > F.col("first")).cast("int"), F.col("t"), F.col("lap"))
    return rows.select("key", "o", part.alias("part")).groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "part"))), lambda p: p["part"]), "").alias("text"))

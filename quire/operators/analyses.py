"""Analyses of blocks and chunks: reading them, consolidating them, and asking a provider for new ones.

Reading: a null or unreadable text gives null members; members of another shape than the schema's are brought to it
(functions.analysis_json). Providers are called once a row, in Arrow batches, and must give the same answer when a lost
task calls again; a row whose call fails keeps its place, with its error.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import analysis_json as aj
from quire.functions import text as tx

NAMES = "array<string>"
BLOCK_SCHEMA = f"key bigint, readable boolean, block_summary string, title string, characters {NAMES}, locations {NAMES}, organizations {NAMES}, unit_type string, structural_marker_found string"
CHUNK_SCHEMA = f"key bigint, readable boolean, characters array<struct<name:string,presence:string>>, locations {NAMES}, organizations {NAMES}, interactions array<struct<type:string,participants:{NAMES},location:string,summary:string,topic:string>>, events {NAMES}, topics {NAMES}"
DOC_SCHEMA = f"key bigint, readable boolean, units array<struct<type:string,title:string,number:string>>"


def _text(x) -> str | None:
    """A member that the schema has as a string."""
    if x is None or isinstance(x, str):
        return x
    return json.dumps(x, ensure_ascii=False)


def _names(values: list) -> list[str]:
    return [n for x in values if (n := aj.name_of(x)) is not None]


def _strings(values: list) -> list[str]:
    return [_text(x) for x in values if not aj.is_nothing(x)]


def _block(root: dict) -> tuple:
    held = aj.as_object(root.get("key_entities_in_block"))
    return (_text(root.get("block_summary")), _text(root.get("title")), *(_names(aj.member(held, k)) for k in ("characters", "locations", "organizations")), _text(root.get("unit_type")), _text(root.get("structural_marker_found")))


def _chunk(root: dict) -> tuple:
    e = aj.as_object(root.get("entities"))
    characters = [{"name": n, "presence": _text(x.get("mentioned_or_present")) if isinstance(x, dict) else None} for x in aj.member(e, "characters") if (n := aj.name_of(x)) is not None]
    interactions = []
    for x in aj.elements(root.get("relationships_interactions")):
        x = x if isinstance(x, dict) else {}
        interactions.append({"type": _text(x.get("type")), "participants": [_text(p) if not isinstance(p, dict) else aj.name_of(p) for p in aj.member(x, "participants")], "location": _text(x.get("location")), "summary": _text(x.get("summary")), "topic": _text(x.get("topic"))})
    return (characters, _names(aj.member(e, "locations")), _names(aj.member(e, "organizations")), interactions, _strings(aj.elements(root.get("events"))), _strings(aj.elements(root.get("keywords_topics"))))


def _units(value) -> tuple:
    return ([{k: _text(x.get(k)) for k in ("type", "title", "number")} for x in aj.structure_units(value) if isinstance(x, dict) and x],)


def _reader(shape: Callable, schema: str, unwrap: bool = True):
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = aj.load(t)
                value = aj.as_object(value) if unwrap else value
                rows.append((k, value is not None, *(shape(value) if value is not None else (None,) * (len(arrow) - 2))))
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return run


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _read(df: DataFrame, key: str, text: str, shape: Callable, schema: str, key_type: str, unwrap: bool = True) -> DataFrame:
    schema = schema.replace("key bigint", f"key {key_type}", 1)
    return df.select(F.col(key).cast(key_type), F.col(text).cast("string")).mapInArrow(_reader(shape, schema, unwrap), schema)


def read_blocks(df: DataFrame, key: str = "row_id", text: str = "analysis", key_type: str = "bigint") -> DataFrame:
    return _read(df, key, text, _block, BLOCK_SCHEMA, key_type)


def read_chunks(df: DataFrame, key: str = "row_id", text: str = "analysis", key_type: str = "bigint") -> DataFrame:
    return _read(df, key, text, _chunk, CHUNK_SCHEMA, key_type)


def read_structures(df: DataFrame, key: str = "row_id", text: str = "structure", key_type: str = "bigint") -> DataFrame:
    return _read(df, key, text, _units, DOC_SCHEMA, key_type, unwrap=False)


# ---- consolidation


def consolidated(blocks: DataFrame, key: str = "document_id") -> DataFrame:
    """key, characters, locations, organizations: distinct names of all blocks, in code point order."""
    long = [blocks.select(key, F.lit(kind).alias("kind"), F.explode(kind).alias("name")) for kind in ("characters", "locations", "organizations")]
    names = long[0].unionByName(long[1]).unionByName(long[2]).select(key, "kind", tx.strip("name").alias("name")).where("name <> ''").distinct()
    lists = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("name")))).alias(k) for k in ("characters", "locations", "organizations")]
    return names.groupBy(key).agg(*lists)


def synthesis_input(blocks: DataFrame, key: str = "document_id", order: str = "block_index", ref: str = "block_ref", summary: str = "block_summary") -> DataFrame:
    """key, text: summaries of a document's blocks in order, one a line."""
    line = F.concat(F.lit("Block "), F.col(order).cast("string"), F.lit(" Summary (Ref: "), F.coalesce(ref, F.lit("Unknown")), F.lit("): "), F.coalesce(summary, F.lit("Summary Unavailable")), F.lit("\n"))
    rows = blocks.select(key, F.col(order).alias("o"), line.alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "").alias("text"))


def missing_blocks(blocks: DataFrame, analyses: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks without analysis and analyses without block, by side: must be empty before the two are put together."""
    left, right = blocks.select(*keys, F.lit(True).alias("_b")).distinct(), analyses.select(*keys, F.lit(True).alias("_a")).distinct()
    both = left.join(right, keys, "full_outer")
    return both.where("_a is null or _b is null").select(*keys, F.when(F.col("_a").isNull(), "no analysis").otherwise("no block").alias("side"))


def outcome_counts(df: DataFrame, status: str = "analysis_status") -> DataFrame:
    return df.agg(F.count_if(F.col(status) == "success").alias("succeeded"), F.count_if(F.col(status) == "error").alias("failed"), F.count("*").alias("total"))


def succeeded(df: DataFrame, status: str = "analysis_status") -> DataFrame:
    return df.where(F.col(status) == "success")


def reduce_failed(result: Column) -> Column:
    """Whether a reduced analysis is empty or an error: null, {} or with a member named error."""
    value = F.try_parse_json(result)
    return value.isNull() | F.try_variant_get(value, "$.error", "variant").isNotNull() | (F.regexp_replace(result, "\\s", "") == "{}")


def tokens_per_call(df: DataFrame, text: str, *, sample: int = 7, output_share: float = 0.2, seed: int = 23) -> DataFrame:
    """tokens_per_call: mean token estimate of a seeded sample of ``sample`` rows, with the share that answers add."""
    drawn = df.select(text).where(F.col(text).isNotNull()).orderBy(F.xxhash64(text, F.lit(seed)), text).limit(sample)
    return drawn.agg((F.avg(F.length(text) / 4) * (1 + output_share)).alias("tokens_per_call"))


# ---- prompts: own wording, rendered without a call

BLOCK_SHAPE = '{"block_summary": text, "title": text, "key_entities_in_block": {"characters": [text], "locations": [text], "organizations": [text]}, "unit_type": text, "structural_marker_found": text or null}'
CHUNK_SHAPE = '{"entities": {"characters": [{"name": text, "mentioned_or_present": text}], "locations": [{"name": text}], "organizations": [{"name": text}]}, "relationships_interactions": [{"type": text, "participants": [text], "location": text, "summary": text, "topic": text}], "events": [text], "keywords_topics": [text]}'
DOC_SHAPE = '{"document_type": text, "structure": [{"type": text, "title": text, "number": text}], "overall_summary": text, "preliminary_key_entities": {"characters": [text], "locations": [text], "organizations": [text]}}'
GUIDES = {"Novel": "Follow plot, cast and setting.", "Biography": "Follow the life told, its dates and people.", "Journal Article": "Follow question, method, result and conclusion."}


def block_prompt(ref: Column, text: Column, most: int = 80_000) -> Column:
    return F.concat(F.lit("Describe this part of a document ("), F.coalesce(ref, F.lit("unknown place")), F.lit(f"). Answer in JSON of the shape {BLOCK_SHAPE}.\n\n"), tx.left(text, most, "\n[shortened]"))


def chunk_prompt(context: Column, text: Column) -> Column:
    return F.concat(F.lit("Context: "), F.coalesce(tx.left(context, 500, "..."), F.lit("none")), F.lit(f"\nList what this passage holds. Answer in JSON of the shape {CHUNK_SHAPE}.\n\n"), text)


def reduce_prompt(n_blocks: Column, entities: Column, summaries: Column, kind: str = "Novel") -> Column:
    return F.concat(F.lit("Bring together the summaries of "), n_blocks.cast("string"), F.lit(f" parts. {GUIDES.get(kind, '')} Answer in JSON of the shape {DOC_SHAPE}.\n\nNames:\n"), entities, F.lit("\n\nSummaries:\n"), summaries)


# ---- providers


def offline_block(prompt: str) -> str:
    """A deterministic stand-in for a model: the first sentence as summary, capitalised words as names."""
    body = prompt.split("\n\n", 1)[-1]
    words = [w.strip(".,;:!?\"'“”") for w in body.split()]
    names = sorted({w for w in words if w[:1].isupper() and w[1:].islower() and len(w) > 3})[:5]
    return json.dumps({"block_summary": body.split(". ")[0][:200], "title": body[:40], "key_entities_in_block": {"characters": names, "locations": [], "organizations": []}, "unit_type": "Section", "structural_marker_found": None}, ensure_ascii=False)


def analyse(df: DataFrame, key: str, prompt: str, provider: Callable[[str], str], *, workers: int | None = None, attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """key, analysis, analysis_status, analysis_error of every row: the provider's answer as JSON, tried again up to ``attempts`` times. workers: partitions, so calls at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for p in batch.column(1).to_pylist():
                answer, error = None, "no text"
                for i in range(attempts if p else 0):
                    try:
                        answer = provider(p)
                        if aj.load(answer) is None:
                            raise ValueError("not JSON")
                        error = None
                        break
                    except Exception as e:  # any failure of a provider is a row's outcome
                        answer, error = None, f"{type(e).__name__}: {e}"
                        time.sleep(wait * 2**i)
                out.append((answer, "success" if error is None else "error", error))
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.string()) for c in columns)], names=[key, "analysis", "analysis_status", "analysis_error"])

    rows = df.select(F.col(key).cast("string").alias(key), F.col(prompt).cast("string").alias(prompt))
    if workers:
        rows = rows.repartition(workers, key)
    return rows.mapInArrow(run, f"`{key}` string, analysis string, analysis_status string, analysis_error string")


def offline_vector(text: str, length: int = 64) -> list[float]:
    """A deterministic stand-in for an embedding: signed counts of hashed words, normalised."""
    import hashlib
    import math

    v = [0.0] * length
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % length] += 1 if h >> 63 else -1
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def offline_vectors(texts: list[str]) -> list[list[float]]:
    return [offline_vector(t) for t in texts]


def embed(df: DataFrame, key: str, text: str, provider: Callable[[list[str]], list[list[float]]], *, length: int = 64, on_failure: str = "skip", attempts: int = 3, batch: int = 100, wait: float = 0.0) -> DataFrame:
    """key, vector of rows with text. The provider is given ``batch`` texts a call and tried up to ``attempts`` times, waiting ``wait`` seconds and twice as long each time after; a batch that fails is asked for text by text, so that one bad text costs no others. A failed row is left out, or has zeros with on_failure="zero"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ask(texts: list[str]) -> list[list[float]] | None:
            for i in range(attempts):
                try:
                    got = [[float(x) for x in v] for v in provider(texts)]
                    if len(got) != len(texts) or any(len(v) != length for v in got):
                        raise ValueError("length")
                    return got
                except Exception:  # see on_failure
                    if i < attempts - 1:
                        time.sleep(wait * 2**i)
            return None

        for rows in batches:
            keys, vectors = [], []
            for low in range(0, rows.num_rows, batch):
                own, texts = (rows.column(i).slice(low, batch).to_pylist() for i in (0, 1))
                got = ask(texts)
                each = got if got is not None else [one[0] if (one := ask([t])) is not None else None for t in texts] if len(texts) > 1 else [None]
                for k, v in zip(own, each, strict=True):
                    if v is not None or on_failure == "zero":
                        keys.append(k)
                        vectors.append(v if v is not None else [0.0] * length)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=["key", "vector"])

    return df.select(F.col(key).cast("string"), F.col(text).cast("string")).where(F.length(text) > 0).mapInArrow(run, "key string, vector array<float>")


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

"""The library: documents with metadata, their chunks, and the questions asked of both tables.

Names are unique; chunk numbers run through the library. Both are kept by the operators that add to it, as appends
after an anti-join, and can be checked by queries whose result must be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.chunking import reconstruct, token_windows
from quire.operators.statistics import ranked
from quire.plans.session import small, written

DOCUMENT_COLUMNS = ("document_id", "doc_name", "subject", "date_added", "start_chunk_id", "end_chunk_id", "chunk_overlap", "file_path")


def once(df: DataFrame, keys: list[str], *latest: str) -> DataFrame:
    """One row of each key: the one delivered last, by the columns named."""
    rows = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*latest)).alias("r"))
    return rows.select(*keys, *[F.col(f"r.{c}").alias(c) for c in df.columns if c not in keys])


def name_exists(documents: DataFrame, name: str) -> bool:
    return not documents.where(F.col("doc_name") == name).limit(1).isEmpty()


def duplicate_names(documents: DataFrame) -> DataFrame:
    """Names that break uniqueness, with how often they stand."""
    return documents.where("doc_name is not null").groupBy("doc_name").agg(F.count("*").alias("n")).where("n > 1")


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of no known document."""
    return chunks.join(documents.select("document_id"), "document_id", "left_anti")


def next_chunk_number(documents: DataFrame, inserted: str) -> DataFrame:
    """One row, next_number: after the end of the document inserted last; 0 for an empty library."""
    return documents.agg(F.coalesce(F.max_by("end_chunk_id", F.struct(inserted, "document_id")) + 1, F.lit(0)).cast("bigint").alias("next_number"))


def chunk_bounds(chunks: DataFrame) -> DataFrame:
    """document_id with its first and last chunk number."""
    return chunks.where("document_id is not null").groupBy("document_id").agg(F.min("chunk_num").alias("start_chunk_id"), F.max("chunk_num").alias("end_chunk_id"), F.count("*").alias("n_chunks"))


def number_chunks(chunks: DataFrame, document_order: str, sequence: str, first: int = 0) -> DataFrame:
    """Adds chunk_num, running from ``first`` over documents in their order and chunks in theirs, both numbers. No task holds the library or a document: counts are summed by ranked(), over documents and within each; only chunks of one place are numbered by rows."""
    starts = small(ranked(chunks, [], document_order).select(F.col("x").alias("_x"), F.col("before").alias("_start")))
    places = ranked(chunks, [document_order], sequence).select(F.col(document_order).alias("_d"), F.col("x").alias("_s"), F.col("before").alias("_place"))
    joined = chunks.join(starts, F.col(document_order).cast("double") == F.col("_x")).join(places, (F.col(document_order) == F.col("_d")) & (F.col(sequence).cast("double") == F.col("_s")))
    own = F.row_number().over(Window.partitionBy(document_order, sequence).orderBy(F.xxhash64(*chunks.columns))) - 1
    return joined.withColumn("chunk_num", (F.col("_start") + F.col("_place") + own + first).cast("bigint")).drop("_x", "_start", "_d", "_s", "_place")


def add_documents(documents: DataFrame, chunks: DataFrame, new_documents: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with new documents (document_id, doc_name, subject, date_added, chunk_overlap, file_path, doc_order) and their chunks (document_id, doc_order, sequence, text). Documents whose name is taken are left out, with their chunks."""
    fresh = new_documents.join(documents.select("doc_name"), "doc_name", "left_anti").dropDuplicates(["doc_name"])
    kept = new_chunks.join(fresh.select("document_id"), "document_id", "left_semi")
    start = documents.agg((F.coalesce(F.max("end_chunk_id"), F.lit(-1)) + 1).cast("bigint").alias("start"))
    numbered = number_chunks(kept, "doc_order", "sequence").crossJoin(F.broadcast(start)).withColumn("chunk_num", F.col("chunk_num") + F.col("start"))
    rows = numbered.select(tx.stable_id("document_id", "sequence").alias("chunk_id"), "chunk_num", "document_id", "text")
    bounds = chunk_bounds(rows)
    added = fresh.join(bounds, "document_id", "left").select(*DOCUMENT_COLUMNS)
    return documents.select(*DOCUMENT_COLUMNS).unionByName(added), chunks.select("chunk_id", "chunk_num", "document_id", "text").unionByName(rows)


def rebuild(documents: DataFrame, chunks: DataFrame, *, size: int = 400, overlap: int = 60) -> tuple[DataFrame, DataFrame]:
    """Both tables with every document rebuilt from its chunks and chunked anew, in windows of words."""
    laps = documents.select("document_id", "chunk_overlap", "start_chunk_id")
    texts = reconstruct(chunks.join(laps, "document_id"), "document_id", "chunk_num", "text", "chunk_overlap")
    windows = token_windows(texts, "key", "text", size=size, overlap=overlap).withColumnRenamed("key", "document_id")
    ordered = windows.join(documents.select("document_id", F.coalesce("start_chunk_id", F.lit(0)).alias("doc_order")), "document_id")
    numbered = number_chunks(ordered, "doc_order", "chunk_index")
    rows = numbered.select(tx.stable_id("document_id", "chunk_index").alias("chunk_id"), "chunk_num", "document_id", "text")
    kept = documents.drop("start_chunk_id", "end_chunk_id", "chunk_overlap").withColumn("chunk_overlap", F.lit(overlap))
    return kept.join(chunk_bounds(rows), "document_id", "left").select(*DOCUMENT_COLUMNS), rows


def listing(documents: DataFrame) -> DataFrame:
    """line: name - subject - date of every document."""
    date = F.coalesce(F.date_format("date_added", "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
    return documents.select("document_id", F.concat_ws(" - ", F.coalesce("doc_name", F.lit("None")), F.coalesce("subject", F.lit("None")), date).alias("line"))


def chunks_of(documents: DataFrame, chunks: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """document_id, chunk_num, line of documents' chunks within bounds of the number, renumbered from 0 within each document."""
    rows = documents.select("document_id").join(chunks.where("document_id is not null and chunk_num is not null"), "document_id")
    if low is not None:
        rows = rows.where(F.col("chunk_num") >= low)
    if high is not None:
        rows = rows.where(F.col("chunk_num") <= high)
    rank = ranked(rows, ["document_id"], "chunk_num").select("document_id", F.col("x").cast("bigint").alias("chunk_num"), F.col("before").cast("bigint").alias("i"))
    return rows.join(rank, ["document_id", "chunk_num"]).select("document_id", "chunk_num", F.format_string("Chunk %d:\n%s", "i", F.coalesce("text", F.lit(""))).alias("line"))


def like(chunks: DataFrame, pattern: str) -> DataFrame:
    """Chunks whose text holds the pattern, % and _ as wildcards, letters in either case (beyond ASCII too)."""
    return chunks.where(F.ilike(F.col("text"), F.lit(f"%{pattern}%")))


def by_ids(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with the ids given, of whatever number: a semi join, which batches of an IN list stand for."""
    return chunks.join(ids.select(key), key, "left_semi")


def context(chunks: DataFrame) -> DataFrame:
    """document_id, context: retrieved chunks of a document in order, below its id."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("chunk_num", "text"))), lambda c: F.concat(c["chunk_num"].cast("string"), F.lit(": "), F.coalesce(c["text"], F.lit(""))))
    return chunks.where("document_id is not null").groupBy("document_id").agg(lines.alias("lines")).select("document_id", F.concat(F.lit("Document "), "document_id", F.lit(":\n"), F.array_join("lines", "\n")).alias("context"))


def history(turns: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """conversation, turn, history: for every turn the texts before it, one a line. A conversation is the unit of the question; its turns are few."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.select(conversation, turn, F.array_join(F.collect_list(text).over(w), "\n").alias("history"))


def answer_prompt(history_text: Column, context_text: Column, question: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(history_text, F.lit("")), F.nullif(context_text, F.lit("")), question)


def setup(spark: SparkSession, documents: str, chunks: str, *, allowed: tuple[str, ...], overwrite: bool = False, confirm: bool = False) -> None:
    """Creates both tables where they are not there. Only allowed names; overwriting needs confirmation."""
    for name in (documents, chunks):
        if name not in allowed:
            raise ValueError(f"table name not allowed: {name}")
    if overwrite:
        drop_all(spark, documents, chunks, allowed=allowed, confirm=confirm)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {documents} (document_id STRING, doc_name STRING, subject STRING, date_added TIMESTAMP_NTZ, start_chunk_id BIGINT, end_chunk_id BIGINT, chunk_overlap INT, file_path STRING) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {chunks} (chunk_id STRING, chunk_num BIGINT, document_id STRING, text STRING) USING parquet CLUSTERED BY (document_id) INTO 16 BUCKETS")


def drop_all(spark: SparkSession, *tables: str, allowed: tuple[str, ...], confirm: bool) -> None:
    if not confirm:
        raise PermissionError("dropping tables needs confirm=True")
    for name in tables:
        if name not in allowed:
            raise ValueError(f"table name not allowed: {name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def reset(spark: SparkSession, documents: str, chunks: str, new_documents: DataFrame, new_chunks: DataFrame, *, allowed: tuple[str, ...], confirm: bool = False) -> None:
    """Drops both tables, creates them anew and loads them with the new documents alone. Needs confirmation."""
    setup(spark, documents, chunks, allowed=allowed, overwrite=True, confirm=confirm)
    empty = spark.table(documents).limit(0), spark.table(chunks).limit(0)
    for name, df in zip((documents, chunks), add_documents(*empty, new_documents, new_chunks), strict=True):
        held = written(df.select(*spark.table(name).columns))
        held.write.mode("append").insertInto(name)


def log_answers(answered: DataFrame, path: str) -> None:
    """Appends questions and answers (q_id, question, context, answer) to the log table at ``path``, contexts in ASCII, with the time."""
    rows = answered.select(F.col("q_id").cast("string").alias("q_id"), "question", tx.ascii_only(F.coalesce("context", F.lit(""))).alias("context"), F.coalesce("answer", F.lit("")).alias("answer"), F.current_timestamp().alias("logged_at"))
    rows.write.mode("append").parquet(path)


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())

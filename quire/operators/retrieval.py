"""Vectors and the chunks they stand for: storing, fetching, and answering by similarity.

Similarity is cosine; that of a zero vector is null and no result. Ties are by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.session import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


#: Numbers of a questions' matrix that tasks hold at most; more questions are asked in blocks of as many.
BLOCK_NUMBERS = 4_000_000


def _block(questions: pd.DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """_q (place of the question), _k, similarity of the k best of each question that each batch of vectors has."""
    q = np.array(questions["_qv"].tolist(), np.float64)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    length, kind = q.shape[1], vectors.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), length), False).to_numpy(zero_copy_only=False))
            x = np.array(lists.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, length)
            with np.errstate(all="ignore"):
                x /= np.linalg.norm(x, axis=1, keepdims=True)
            step = max(1, BLOCK_NUMBERS // max(len(x), 1))
            for low in range(0, len(q), step):
                with np.errstate(all="ignore"):
                    sims = q[low : low + step] @ x.T
                sims = np.where(np.isfinite(sims), sims, -np.inf)
                if sims.shape[1] > k:  # those that are no worse than the k-th, ties too
                    least = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k]
                    rows, cols = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
                else:
                    rows, cols = np.nonzero(sims > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64) + low), batch.column(0).take(pa.array(fit[cols])), pa.array(sims[rows, cols])], names=["_q", "_k", "similarity"])

    return vectors.mapInArrow(run, f"_q bigint, _k {kind}, similarity double")


def top_k(questions: DataFrame, vectors: DataFrame, *, k: int = 10, question: str = "q_id", key: str = "id", vector: str = "vector") -> DataFrame:
    """question, key, similarity, rank of the k most similar vectors of every question.

    A stated set of questions against all vectors: questions are sent to the tasks in blocks of at most BLOCK_NUMBERS
    numbers, and all vectors are compared with a block by one matrix product an Arrow batch; a batch gives k rows a
    question, and a question's rows are merged by rank. Vectors of another length, with nulls or not finite, and zero
    vectors are similar to nothing.
    """
    v = vectors.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")).where("_k is not null and _v is not null")
    size = norm(F.col("_qv"))
    q = written(questions.select(F.col(question).alias("_id"), F.col(vector).cast("array<double>").alias("_qv")).where("_id is not null and _qv is not null").where((size > 0) & (size < float("inf"))).withColumn("_n", F.size("_qv")))
    empty = v.sparkSession.createDataFrame([], f"_id {q.schema['_id'].dataType.simpleString()}, _k {v.schema['_k'].dataType.simpleString()}, similarity double")
    found = empty
    w = Window.partitionBy("_id").orderBy(F.col("similarity").desc(), "_k")
    for length in [r._n for r in q.select("_n").distinct().orderBy("_n").collect()]:
        held = q.where(F.col("_n") == length).select("_id", "_qv").toLocalIterator()
        while rows := list(islice(held, max(1, BLOCK_NUMBERS // length))):
            block = pd.DataFrame({"_qv": [r._qv for r in rows]})
            ids = v.sparkSession.createDataFrame([(i, r._id) for i, r in enumerate(rows)], f"_q bigint, _id {q.schema['_id'].dataType.simpleString()}")
            part = _block(block, v, k).join(F.broadcast(ids), "_q").select("_id", "_k", "similarity")
            found = found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("_id").alias(question), F.col("_k").alias(key), "similarity", "rank")


def vector_records(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, vector, text (at most 20000 characters), document_id, sequence, structure_ref: vectors with their chunk's metadata and its defaults. Vectors of no chunk are left out."""
    c = chunks.select("chunk_id", F.substring("text", 1, 20_000).alias("text"), F.coalesce("document_id", F.lit("Unknown")).alias("document_id"), F.coalesce("chunk_seq", F.lit(-1)).alias("sequence"), F.coalesce("structure_ref", F.lit("Unknown")).alias("structure_ref"))
    return embeddings.select("chunk_id", "vector").join(c, "chunk_id")


def unmatched(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return embeddings.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti").distinct()


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both, one a key, of the highest version; of equal versions the new."""
    rows = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, "_side")).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def fetch(records: DataFrame, ids: DataFrame, *, shown: int = 10) -> DataFrame:
    """Records of ids, with the first dimensions and the number of them; an id without record has nulls."""
    return ids.select("chunk_id").distinct().join(records, "chunk_id", "left").withColumn("first_dimensions", F.slice("vector", 1, shown)).withColumn("dimensions", F.size("vector")).drop("vector")


def wrong_length(vectors: DataFrame, vector: str, length: int) -> DataFrame:
    """Vectors that an index of this length must refuse."""
    return vectors.where(F.col(vector).isNull() | (F.size(vector) != length))

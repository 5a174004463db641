"""Questions answered from the library: the most similar chunks, put together by document, with what was asked before.

A batch of questions takes the place of a dialogue: each question has a conversation and a turn, and its prompt holds
the questions of the conversation's earlier turns. A question whose vector finds nothing (null or zero) falls back to a
search for its text, of which the first chunks by number are shown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import analyses as an
from quire.operators import library as lib
from quire.operators import retrieval as rt
from quire.plans.session import small

FALLBACK_CHUNKS = 3


def contexts(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, *, k: int = 10) -> DataFrame:
    """q_id, context, found_by of every question that finds anything. questions: q_id, question, vector; vectors: chunk_id, vector; chunks: chunk_id, chunk_num, document_id, text."""
    near = rt.top_k(questions.where("vector is not null"), vectors, k=k, key="chunk_id").select("q_id", "chunk_id").join(chunks.select("chunk_id", "chunk_num", "document_id", "text"), "chunk_id")
    by = near.select(F.concat_ws("\x1f", F.col("q_id").cast("string"), F.coalesce("document_id", F.lit("Unknown"))).alias("document_id"), "chunk_num", "text")
    parts = lib.context(by).select(F.substring_index("document_id", "\x1f", 1).alias("q"), F.substring_index("document_id", "\x1f", -1).alias("document_id"), "context")
    # the header of a context has the grouping key in it, of which only the document is to be seen
    shown = parts.select("q", "document_id", F.concat(F.lit("Document "), F.substring_index("context", "\x1f", -1)).alias("context"))
    found = shown.groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("document_id", "context"))), lambda x: x["context"]), "\n\n").alias("context"), F.lit("similarity").alias("found_by"))
    hit = questions.select("q_id", "question").join(found, F.col("q_id").cast("string") == F.col("q")).select("q_id", "context", "found_by")
    left = questions.join(hit.select("q_id"), "q_id", "left_anti").where("length(question) > 0").select("q_id", "question")
    held = chunks.where("text is not null").join(small(left), F.ilike("text", F.concat(F.lit("%"), "question", F.lit("%"))))
    w = Window.partitionBy("q_id").orderBy("chunk_num", "chunk_id")
    first = held.withColumn("n", F.row_number().over(w)).where(F.col("n") <= FALLBACK_CHUNKS)
    text = first.groupBy("q_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n").alias("context"), F.lit("text").alias("found_by"))
    return hit.unionByName(text)


def prompts(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, *, k: int = 10) -> DataFrame:
    """q_id, prompt, found_by. questions: q_id, conversation, turn, question, vector."""
    context = contexts(questions, vectors, chunks, k=k)
    past = lib.history(questions, "conversation", "turn", "question")
    rows = questions.select("q_id", "conversation", "turn", "question").join(past, ["conversation", "turn"]).join(context, "q_id", "left")
    return rows.select(F.col("q_id").cast("string").alias("q_id"), lib.answer_prompt(F.col("history"), F.col("context"), F.col("question")).alias("prompt"), "found_by")


def answer(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, provider: Callable[[str], str], *, k: int = 10) -> DataFrame:
    """q_id, prompt, found_by, answer, status, error. questions: q_id, conversation, turn, question, vector."""
    asked = prompts(questions, vectors, chunks, k=k)
    answered = an.analyse(asked, "q_id", "prompt", provider)
    return asked.join(answered, "q_id").select("q_id", "prompt", "found_by", F.col("analysis").alias("answer"), F.col("analysis_status").alias("status"), F.col("analysis_error").alias("error"))

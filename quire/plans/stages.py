"""The document pipeline as stages that are written and read again.

Each stage is a function of the stages before it; what it gives is written to a folder of its own, and a run can begin
at any stage whose predecessors are there. Errors are not swallowed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import analyses as an
from quire.operators import chunking, graph
from quire.operators import retrieval as rt
from quire.sources import readers
from quire.sources.writers import current_version, save_stage, save_version


class Stage(IntEnum):
    START = 0
    LARGE_BLOCK_ANALYSIS = 1
    REDUCE_ANALYSIS = 2
    DETAILED_ANALYSIS = 3
    EMBEDDINGS = 4
    GRAPH = 5
    STORE = 6


@dataclass
class Providers:
    """What answers prompts and embeds texts; the defaults are offline and deterministic."""

    block: Callable[[str], str] = an.offline_block
    reduce: Callable[[str], str] = lambda prompt: '{"document_type": "Other", "structure": [], "overall_summary": "", "preliminary_key_entities": {}}'
    chunk: Callable[[str], str] = lambda prompt: '{"entities": {"characters": [], "locations": [], "organizations": []}, "relationships_interactions": [], "events": [], "keywords_topics": []}'
    vectors: Callable[[list[str]], list[list[float]]] = an.offline_vectors


@dataclass
class Run:
    spark: SparkSession
    root: str
    providers: Providers = field(default_factory=Providers)
    target: int = 1000
    overlap: int = 100
    length: int = 64
    seconds: dict[str, float] = field(default_factory=dict)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        began = time.time()
        save_stage(df, f"{self.root}/{name}")
        self.seconds[name] = time.time() - began
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    # ---- stages

    def large_blocks(self, source: DataFrame | str) -> None:
        docs = readers.documents(self.spark, source).select("document_id", "text") if isinstance(source, str) else source.select("document_id", "text")
        docs = self.save("documents", docs)
        if docs.where("length(text) > 0").isEmpty():
            raise ValueError("no text to read")
        blocks = self.save("blocks", chunking.coarse_blocks(docs, "document_id", "text"))
        if blocks.isEmpty():
            raise ValueError("no blocks")
        prompts = blocks.select(F.to_json(F.struct(F.col("key").alias("document_id"), "block_index")).alias("id"), an.block_prompt(F.col("structural_marker"), F.col("text")).alias("prompt"))
        self.save("block_analyses", an.analyse(prompts, "id", "prompt", self.providers.block))

    def _blocks(self) -> DataFrame:
        raw = self.load("block_analyses").where("analysis_status = 'success'")
        place = F.from_json("key", "document_id string, block_index int")
        return an.read_blocks(raw, "id", key_type="string").select(place["document_id"].alias("document_id"), place["block_index"].alias("block_index"), "*").drop("key")

    def reduce(self) -> None:
        blocks = self._blocks().withColumn("block_ref", F.col("structural_marker_found"))
        names = an.consolidated(blocks).select("document_id", F.to_json(F.struct("characters", "locations", "organizations")).alias("names"))
        n = blocks.groupBy("document_id").agg(F.count("*").alias("n"))
        rows = an.synthesis_input(blocks).join(names, "document_id", "left").join(n, "document_id")
        prompts = rows.select("document_id", an.reduce_prompt(F.col("n"), F.coalesce("names", F.lit("{}")), F.col("text")).alias("prompt"))
        done = self.save("doc_analyses", an.analyse(prompts, "document_id", "prompt", self.providers.reduce))
        if not done.where(an.reduce_failed(F.col("analysis"))).isEmpty():
            raise ValueError("a document could not be reduced")

    def details(self) -> None:
        chunks = self.save("chunks", chunking.adaptive_chunks(self.load("blocks"), target=self.target, overlap=self.overlap))
        summary = F.try_variant_get(F.try_parse_json("analysis"), "$.overall_summary", "string")
        docs = self.load("doc_analyses").select(F.col("document_id").alias("key"), summary.alias("summary"))
        prompts = chunks.join(docs, "key", "left").select("chunk_id", an.chunk_prompt(F.col("summary"), F.col("text")).alias("prompt"))
        done = self.save("chunk_analyses", an.analyse(prompts, "chunk_id", "prompt", self.providers.chunk))
        if an.succeeded(done).isEmpty():
            raise ValueError("no chunk could be analysed")

    def embeddings(self) -> None:
        good = self.load("chunks").join(an.succeeded(self.load("chunk_analyses")).select("chunk_id"), "chunk_id", "left_semi")
        done = self.save("embeddings", an.embed(good, "chunk_id", "text", self.providers.vectors, length=self.length))
        if done.isEmpty():
            raise ValueError("nothing to embed")

    def graph(self) -> None:
        docs = self.load("doc_analyses").select("document_id", "analysis")
        value = F.try_parse_json("analysis")
        units = an.read_structures(docs.select("document_id", F.to_json(F.try_variant_get(value, "$.structure", "variant")).alias("structure")), "document_id", key_type="string").withColumnRenamed("key", "document_id")
        heads = docs.select("document_id", F.try_variant_get(value, "$.document_type", "string").alias("document_type"), F.try_variant_get(value, "$.overall_summary", "string").alias("overall_summary"))
        described = heads.join(units, "document_id", "left")
        read = an.read_chunks(an.succeeded(self.load("chunk_analyses")), "chunk_id", key_type="string").withColumnRenamed("key", "chunk_id")
        chunks = read.join(self.load("chunks").select("chunk_id", F.col("key").alias("document_id"), "sequence"), "chunk_id")
        self.save("nodes", graph.document_nodes(described).unionByName(graph.structure_nodes(described)).unionByName(graph.entity_nodes(chunks)))
        self.save("edges", graph.structure_edges(described).unionByName(graph.mention_edges(chunks)).unionByName(graph.interaction_edges(chunks)))

    def store(self) -> None:
        """Vectors, then graph, then chunks go to the tables below ``stored``, each as a new version that takes up what is there: vectors and chunks by chunk_id, nodes by id, edges by what they say. What is empty is left out."""
        chunks = self.load("chunks").select("chunk_id", F.col("key").alias("document_id"), F.col("sequence").alias("chunk_seq"), "text", "structure_type", "structure_ref")
        vectors = self.load("embeddings").select(F.col("key").alias("chunk_id"), "vector")
        records = rt.vector_records(vectors, chunks)
        if rt.wrong_length(vectors, "vector", self.length).limit(1).count():
            raise ValueError(f"the index takes vectors of {self.length} numbers only")

        def latest(old: DataFrame, new: DataFrame) -> DataFrame:
            return rt.upsert(old.withColumn("version", F.lit(0)), new.withColumn("version", F.lit(1)), "chunk_id", "version").drop("version")

        self._put("vectors", records, latest)
        self._put("nodes", self.load("nodes"), graph.merge_nodes)
        self._put("edges", graph.linked_edges(self.load("edges"), self.load("nodes").unionByName(chunks.select(F.col("chunk_id").alias("id"), F.array(F.lit("Chunk")).alias("labels"), F.col("chunk_id").alias("name"), F.create_map().cast("map<string,string>").alias("properties")))), graph.merge_edges)
        self._put("chunks", chunks, latest)

    def _put(self, name: str, df: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        began, root = time.time(), f"{self.root}/stored/{name}"
        if df.isEmpty():
            return
        try:
            df = merge(current_version(self.spark, root), df)
        except AnalysisException:  # nothing stored yet
            pass
        save_version(df, root)
        self.seconds[f"stored/{name}"] = time.time() - began

    def run(self, source: DataFrame | str | None = None, start: Stage = Stage.START) -> dict[str, float]:
        """All stages after ``start``, the last one that is done already; seconds by what was written."""
        steps: list[Callable[[], None]] = [lambda: self.large_blocks(source), self.reduce, self.details, self.embeddings, self.graph, self.store]
        for step in steps[int(start) :]:
            step()
        return self.seconds

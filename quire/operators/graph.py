"""Nodes and edges from analyses, and the questions asked of a graph.

Nodes: id, labels, name, properties. Edges: src, dst, type, properties; properties without a value are left out.
Entities are nodes by their id, names that clean to the same id are one node with aliases. Whether a participant of an
interaction is a known character, and a place a known location, is asked of the interaction's own document. Everything is a union of
plans over exploded arrays; there is one shuffle a distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx

KINDS = (("characters", "Character"), ("locations", "Location"), ("organizations", "Organization"))


def _properties(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def document_nodes(docs: DataFrame) -> DataFrame:
    """docs: document_id, document_type, overall_summary, one row a document."""
    p = _properties(document_id=F.col("document_id"), title=F.col("document_id"), summary=F.coalesce("overall_summary", F.lit("")), type=F.coalesce("document_type", F.lit("Unknown")))
    return docs.where("document_id is not null").select(F.col("document_id").alias("id"), F.array(F.lit("Document")).alias("labels"), F.col("document_id").alias("name"), p.alias("properties"))


def _units(docs: DataFrame) -> DataFrame:
    """docs: document_id, units."""
    each = docs.where("document_id is not null").select("document_id", F.posexplode("units").alias("i", "u"))
    number = (F.col("i") + 1).cast("string")
    title = F.coalesce(F.col("u.title"), F.concat(F.lit("Unit "), F.coalesce(F.col("u.number"), number)))
    return each.select("document_id", "i", F.concat("document_id", F.lit("_struct_"), number).alias("id"), F.replace(F.coalesce("u.type", F.lit("Structure")), F.lit("/"), F.lit("_or_")).alias("label"), title.alias("title"), F.col("u.number").alias("number"))


def structure_nodes(docs: DataFrame) -> DataFrame:
    return _units(docs).select("id", F.array("label").alias("labels"), F.col("title").alias("name"), _properties(structure_id=F.col("id"), title=F.col("title"), number=F.col("number")).alias("properties"))


def structure_edges(docs: DataFrame) -> DataFrame:
    return _units(docs).select(F.col("document_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_STRUCTURE").alias("type"), _properties(order=F.col("i")).alias("properties"))


def mentions(chunks: DataFrame) -> DataFrame:
    """document_id, chunk_id, label, name, id, present: named entities of chunks (document_id, chunk_id, characters, locations, organizations)."""
    parts = []
    for field, label in KINDS:
        element = F.col("e.name") if field == "characters" else F.col("e")
        present = F.coalesce(F.col("e.presence") == "present", F.lit(False)) if field == "characters" else F.lit(False)
        parts.append(chunks.select("document_id", "chunk_id", F.explode(field).alias("e")).select("document_id", "chunk_id", F.lit(label).alias("label"), tx.strip(element).alias("name"), present.alias("present")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("name <> ''")
    return rows.select("document_id", "chunk_id", "label", "name", tx.entity_id("label", "name").alias("id"), "present")


def entity_nodes(chunks: DataFrame) -> DataFrame:
    """One node an id; name is the first of its names by code point, the others are aliases."""
    by = mentions(chunks).groupBy("id", "label", "name").agg(F.lit(1)).groupBy("id").agg(F.min("label").alias("label"), F.sort_array(F.collect_list("name")).alias("names"))
    aliases = F.when(F.size("names") > 1, F.array_join(F.slice("names", 2, F.size("names")), "|"))
    return by.select("id", F.array("label").alias("labels"), F.element_at("names", 1).alias("name"), _properties(name=F.element_at("names", 1), aliases=aliases).alias("properties"))


def mention_edges(chunks: DataFrame) -> DataFrame:
    """PRESENT_IN and MENTIONED_IN of every entity and chunk, once."""
    by = mentions(chunks).groupBy("id", "chunk_id").agg(F.max("present").alias("present"))
    return by.select(F.col("id").alias("src"), F.col("chunk_id").alias("dst"), F.when(F.col("present"), "PRESENT_IN").otherwise("MENTIONED_IN").alias("type"), _properties(source_chunk_id=F.col("chunk_id")).alias("properties"))


def _interactions(chunks: DataFrame) -> DataFrame:
    """Interactions all of whose participants are known characters of their document: chunk_id, sequence, pos, ids (in order), location_id, members."""
    known = mentions(chunks).where("document_id is not null").select("document_id", "label", "name", "id").distinct()
    characters = known.where("label = 'Character'").select("document_id", F.col("name").alias("person"), F.col("id").alias("person_id"))
    places = known.where("label = 'Location'").select("document_id", F.col("name").alias("place"), F.col("id").alias("place_id"))
    each = chunks.select("document_id", "chunk_id", "sequence", F.posexplode("interactions").alias("pos", "x")).where(F.size("x.participants") > 0)
    people = each.select("document_id", "chunk_id", "sequence", "pos", "x", F.posexplode("x.participants").alias("k", "raw")).withColumn("person", tx.strip(F.coalesce("raw", F.lit(""))))
    found = people.join(characters, ["document_id", "person"], "left").groupBy("document_id", "chunk_id", "sequence", "pos").agg(
        F.bool_and(F.col("person_id").isNotNull()).alias("all_known"), F.sort_array(F.collect_list(F.struct("k", "person_id"))).alias("members"), F.first(F.struct("x.type", "x.location", "x.summary", "x.topic")).alias("x")
    )
    ids = F.transform("members", lambda m: m["person_id"])
    rows = found.where("all_known").select("document_id", "chunk_id", "sequence", "pos", ids.alias("ids"), "x", tx.strip("x.location").alias("place"))
    return rows.join(places, ["document_id", "place"], "left").select("chunk_id", "sequence", "pos", "ids", "x", F.col("place_id").alias("location_id"))


def interaction_edges(chunks: DataFrame) -> DataFrame:
    """INTERACTED_WITH between the first two participants, ends in order, the first of those with the same ends, chunk and summary; PRESENT_AT_INTERACTION of every participant at a known location.

    chunks: document_id, chunk_id, sequence, characters, locations, organizations, interactions; one row a chunk.
    """
    rows = _interactions(chunks).where(F.size("ids") >= 2)
    a, b = F.element_at("ids", 1), F.element_at("ids", 2)
    summary = F.coalesce(F.col("x.summary"), F.lit(""))
    ends = rows.select("*", F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), summary.alias("summary"))
    first = ends.groupBy("src", "dst", "chunk_id", "summary").agg(F.min_by(F.struct("sequence", "ids", "location_id", "x"), "pos").alias("r"))
    p = _properties(source_chunk_id=F.col("chunk_id"), sequence_marker=F.col("r.sequence"), summary=F.col("summary"), topic=F.col("r.x.topic"), interaction_type=F.coalesce("r.x.type", F.lit("interaction")), location_id=F.col("r.location_id"))
    met = first.select("src", "dst", F.lit("INTERACTED_WITH").alias("type"), p.alias("properties"))
    at = first.where("r.location_id is not null").select(F.explode("r.ids").alias("src"), F.col("r.location_id").alias("dst"), F.lit("PRESENT_AT_INTERACTION").alias("type"), _properties(source_chunk_id=F.col("chunk_id"), sequence_marker=F.col("r.sequence")).alias("properties"))
    return met.unionByName(at)


# ---- a stored graph


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of both, one an id; properties of the new overlay those of the old, labels are united."""
    rows = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    pairs = rows.select("id", "labels", "name", "_v", F.explode_outer("properties").alias("k", "v"))
    values = pairs.where("k is not null").groupBy("id", "k").agg(F.max_by("v", F.struct("_v", "v")).alias("v")).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("properties"))
    heads = rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.max_by("name", F.struct("_v", "name")).alias("name"))
    return heads.join(values, "id", "left").select("id", "labels", "name", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"))


def canonical_keys(nodes: DataFrame) -> DataFrame:
    """Nodes with merge_label and merge_key, by which a store tells them apart: documents by document_id, structure units by structure_id, entities by name, others by id."""
    p, label = F.col("properties"), F.element_at("labels", 1)
    key = F.when(label == "Document", p["document_id"]).when(p["structure_id"].isNotNull(), p["structure_id"]).when(label.isin(*[kind for _, kind in KINDS]), F.col("name")).otherwise(F.col("id"))
    return nodes.withColumn("merge_label", label).withColumn("merge_key", F.coalesce(key, F.col("id")))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both, those that are the same once: by ends, type and properties."""
    rows = old.unionByName(new)
    return rows.withColumn("_p", F.to_json(F.array_sort(F.map_entries("properties")))).dropDuplicates(["src", "dst", "type", "_p"]).drop("_p")


def linked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def id_conflicts(nodes: DataFrame) -> DataFrame:
    """Ids that are not unique."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def node_by(nodes: DataFrame, value: str) -> DataFrame:
    """The first node, by id, whose id, document_id, structure_id or name is the value."""
    p = F.col("properties")
    hit = (F.col("id") == value) | (p["document_id"] == value) | (p["structure_id"] == value) | (F.col("name") == value)
    return nodes.where(hit).orderBy("id").limit(1)


def neighbours(edges: DataFrame, nodes: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """start (id), other, type, direction, name: one step along edges in either direction; with ``limit`` the first of each start by type and other end."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type", F.lit("out").alias("direction"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "type", F.lit("in").alias("direction"))
    steps = out.unionByName(back).join(start.select("id").distinct(), "id").join(nodes.select(F.col("id").alias("other"), "name"), "other").distinct()
    if limit is None:
        return steps.select("id", "other", "type", "direction", "name")
    first = steps.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct("type", "other", "direction", "name"))), 1, limit).alias("s")).select("id", F.explode("s").alias("s"))
    return first.select("id", "s.other", "s.type", "s.direction", "s.name")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id"), "type").unionByName(edges.select(F.col("dst").alias("id"), "type"))
    return ends.groupBy("id", "type").agg(F.count("*").alias("degree"))

"""Entity graph as two frames: nodes keyed by (type, name), edges keyed by (source, relation, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.text import strip_code_fence
from usagelens.operators.tables import upsert


def parse_entities(answers: DataFrame, source_col: str, answer_col: str) -> DataFrame:
    """(source, entities map) from model answers that hold a JSON object of lists."""
    parsed = F.try_variant_get(F.try_parse_json(strip_code_fence(F.col(answer_col))), "$", "map<string,variant>")
    lists = F.transform_values(parsed, lambda k, v: F.try_variant_get(v, "$", "array<string>"))
    return answers.select(F.col(source_col).alias("source"), F.map_filter(
        lists, lambda k, v: v.isNotNull()).alias("entities"))


def mentions(entities: DataFrame) -> DataFrame:
    """One row per entity a source holds."""
    return entities.select("source", F.explode("entities").alias("kind", "names")).select(
        "source", F.initcap("kind").alias("type"), F.explode("names").alias("name"))


def nodes(entities: DataFrame) -> DataFrame:
    """Sources and entities, each once."""
    found = mentions(entities).select("type", "name")
    return entities.select(F.lit("Source").alias("type"), F.col("source").alias("name")).unionByName(found).distinct()


def edges(entities: DataFrame) -> DataFrame:
    return mentions(entities).select(
        F.col("source"), F.lit("CONTAINS").alias("relation"), F.col("type").alias("target_type"),
        F.col("name").alias("target")).distinct()


def record_nodes(records: DataFrame, entity_type: str, id_field: str) -> DataFrame:
    """Nodes of generic records: (type, id, properties); `record` is a map column."""
    return records.select(
        F.lit(entity_type).alias("type"), F.element_at("record", id_field).alias("id"),
        F.map_concat("record", F.create_map(
            F.lit("_source"), F.col("source"), F.lit("_source_type"), F.col("source_type"))).alias("properties"))


def merge_nodes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merge by (type, id); new properties win, others stay."""
    entries = lambda f, n: f.select(
        "type", "id", F.explode_outer("properties").alias("k", "v")).withColumn("_new", F.lit(n))
    folded = entries(stored, 0).unionByName(entries(fresh, 1)).groupBy("type", "id", "k").agg(
        F.max_by("v", F.struct("_new", "v")).alias("v"))
    return folded.groupBy("type", "id").agg(F.map_from_entries(F.array_sort(F.filter(
        F.collect_list(F.struct("k", "v")), lambda e: e["k"].isNotNull()))).alias("properties"))


def merge_edges(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert(stored, fresh, ["source", "relation", "target_type", "target"])


def relationships(pairs: DataFrame, node_frame: DataFrame, relation: str) -> DataFrame:
    """Edges between given (from_type, from_id, to_type, to_id) pairs whose ends both exist."""
    ends = node_frame.select("type", "id").distinct()
    a = ends.select(F.col("type").alias("from_type"), F.col("id").alias("from_id"))
    b = ends.select(F.col("type").alias("to_type"), F.col("id").alias("to_id"))
    return pairs.join(a, ["from_type", "from_id"], "left_semi").join(b, ["to_type", "to_id"], "left_semi").select(
        "from_type", "from_id", F.lit(relation).alias("relation"), "to_type", "to_id").distinct()

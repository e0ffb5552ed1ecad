"""Nested drafts from flat tables and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_draft(groups: DataFrame, exercises: DataFrame, options: DataFrame, fields: DataFrame) -> DataFrame:
    """One row a document: groups > exercises > options and fields, each in order.

    Exercises without provenance (``block_id`` null) are left out; see ``unassembled``.
    """
    opts = options.groupBy("doc_id", "exercise_id").agg(F.array_sort(F.collect_list(F.struct("ord", "option_id", "value"))).alias("options"))
    answers = fields.groupBy("doc_id", "exercise_id").agg(F.array_sort(F.collect_list(F.struct(
        "ord", "field_id", "accepted", "provenance", "review_status"))).alias("fields"))
    ex = exercises.where("block_id is not null").join(opts, ["doc_id", "exercise_id"], "left").join(answers, ["doc_id", "exercise_id"], "left")
    ex = ex.groupBy("doc_id", "group_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("ord"), F.col("exercise_id"), F.col("kind"), F.col("prompt"), F.col("block_id"), F.col("options"), F.col("fields")))).alias("exercises"))
    out = groups.join(ex, ["doc_id", "group_id"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("ord"), F.col("group_id"), F.col("instruction"), F.col("exercises")))).alias("groups"))
    return out


def unassembled(exercises: DataFrame, options: DataFrame) -> DataFrame:
    """Exercises and options without provenance."""
    a = exercises.where("block_id is null").select("doc_id", F.col("exercise_id").alias("entity_id"), F.lit("NO_PROVENANCE").alias("code"))
    lost = options.join(exercises.select("doc_id", "exercise_id"), ["doc_id", "exercise_id"], "left_anti")
    return a.unionByName(lost.select("doc_id", F.col("option_id").alias("entity_id"), F.lit("NO_PROVENANCE").alias("code")))


def flatten_exercises(drafts: DataFrame) -> DataFrame:
    return drafts.select("doc_id", F.inline("groups")).select("doc_id", "group_id", F.inline("exercises")).select(
        "doc_id", "group_id", "exercise_id", "ord", "kind", "prompt", "block_id", "options", "fields")


def flatten_fields(drafts: DataFrame) -> DataFrame:
    return flatten_exercises(drafts).select("doc_id", "group_id", "exercise_id", F.inline("fields")).select(
        "doc_id", "group_id", "exercise_id", "field_id", "ord", "accepted", "provenance", "review_status")


def flatten_options(drafts: DataFrame) -> DataFrame:
    return flatten_exercises(drafts).select("doc_id", "exercise_id", F.inline("options")).select("doc_id", "exercise_id", "option_id", "ord", "value")


def collect_refs(parts: dict[str, DataFrame]) -> DataFrame:
    """V1: every source reference of a draft or lesson as one flat table.

    ``parts`` maps an entity type (group, resource, entry, exercise, option, answer, referenceLine) to a frame with
    doc_id, entity_id and ``refs``, an array of (document_id, block_id, char_start, char_end, page_index, bbox).
    """
    out = None
    for kind, df in parts.items():
        one = df.select("doc_id", F.lit(kind).alias("entity_type"), "entity_id", F.posexplode("refs").alias("n", "r")).select(
            "doc_id", "entity_type", "entity_id", "n", "r.*")
        out = one if out is None else out.unionByName(one)
    return out

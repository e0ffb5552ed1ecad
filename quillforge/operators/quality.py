"""Rule tables over references, drafts, lessons, students' copies and events.

Every rule yields rows of one schema: entity_type, entity_id, code, severity, evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def violation(df: DataFrame, kind: str, entity: str, code: str | Column, severity: str = "blocking", evidence: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select(
        F.lit(kind).alias("entity_type"), F.col(entity).cast("string").alias("entity_id"), code.alias("code"), F.lit(severity).alias("severity"),
        (F.lit(None).cast("string") if evidence is None else evidence.cast("string")).alias("evidence"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lineage_failures(refs: DataFrame, blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """V2: codes of each reference: another document or source, unknown block, range, page, box; and of documents made from another source.

    ``refs``: doc_id, entity_id, source_id, ref_doc_id, block_id, char_start, char_end, page_index, x, y, width, height; what is null isn't checked.
    ``docs``: doc_id, source_id, and ``ir_source_id``, the source that the document's blocks were made from.  A reference to another document or source, or to
    an unknown block, is not checked further; a document's own failure comes once, without entity and block.
    """
    b = blocks.select(F.col("doc_id").alias("ref_doc_id"), "block_id", F.length("raw_text").alias("b_len"), F.col("page_index").alias("b_page"), F.lit(True).alias("b_known"),
                      *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "width", "height")])
    df = refs.join(docs.select("doc_id", F.col("source_id").alias("own_source")), "doc_id", "left").join(b, ["ref_doc_id", "block_id"], "left")
    outside = (F.col("x") < F.col("b_x")) | (F.col("y") < F.col("b_y")) | (
        F.col("x") + F.col("width") > F.col("b_x") + F.col("b_width")) | (F.col("y") + F.col("height") > F.col("b_y") + F.col("b_height"))
    detail = F.filter(F.array(
        F.when((F.col("char_start") > F.col("b_len")) | (F.col("char_end") > F.col("b_len")), F.lit("SOURCE_RANGE_OUT_OF_BOUNDS")),
        F.when(F.col("page_index").isNotNull() & ~F.col("page_index").eqNullSafe(F.col("b_page")), F.lit("SOURCE_PAGE_MISMATCH")),
        F.when(outside, F.lit("SOURCE_BBOX_OUT_OF_BOUNDS"))), lambda c: c.isNotNull())
    own = F.col("source_id").eqNullSafe(F.col("own_source")) & F.col("ref_doc_id").eqNullSafe(F.col("doc_id"))
    codes = F.when(~own, F.array(F.lit("CROSS_DOCUMENT_REF"))).when(F.col("b_known").isNull(), F.array(F.lit("UNKNOWN_BLOCK_REF"))).otherwise(detail)
    out = df.select("doc_id", "entity_id", "block_id", F.explode(codes).alias("code"))
    foreign = docs.where(~F.col("ir_source_id").eqNullSafe(F.col("source_id"))).select("doc_id").distinct()
    kinds = {f.name: f.dataType for f in out.schema}
    return out.unionByName(foreign.select("doc_id", F.lit(None).cast(kinds["entity_id"]).alias("entity_id"), F.lit(None).cast(kinds["block_id"]).alias("block_id"),
                                          F.lit("DOCUMENT_IR_SOURCE_MISMATCH").alias("code")))


def publish_lineage_reasons(refs: DataFrame, blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """V3: distinct lineage codes of each draft, in a fixed order."""
    order = ["DOCUMENT_IR_SOURCE_MISMATCH", "CROSS_DOCUMENT_REF", "UNKNOWN_BLOCK_REF", "SOURCE_RANGE_OUT_OF_BOUNDS"]
    found = lineage_failures(refs, blocks, docs).where(F.col("code").isin(*order)).groupBy("doc_id").agg(F.collect_set("code").alias("codes"))
    return found.select("doc_id", F.filter(F.array(*[F.lit(c) for c in order]), lambda c: F.array_contains("codes", c)).alias("reasons"))


CHOICES = ("singleChoice", "oddOneOut", "imageChoice", "matching")


def contract_violations(groups: DataFrame, exercises: DataFrame, options: DataFrame, fields: DataFrame, resources: DataFrame, entries: DataFrame, published: bool = False) -> DataFrame:
    """V4: rules of a draft, and with ``published`` those of a lesson version."""
    n_options = options.groupBy("doc_id", "exercise_id").agg(F.count("*").alias("n"))
    few = exercises.where(F.col("kind").isin("singleChoice", "oddOneOut", "imageChoice")).join(n_options, ["doc_id", "exercise_id"], "left").where("coalesce(n, 0) < 2")
    needs = F.col("kind").isin("wordBankGap", "matching")
    lost = exercises.where("shared_resource_id is not null").join(
        resources.select("doc_id", F.col("resource_id").alias("shared_resource_id")), ["doc_id", "shared_resource_id"], "left_anti")
    n_entries = entries.groupBy("doc_id", "resource_id").agg(F.count("*").alias("n"))
    short = resources.join(n_entries, ["doc_id", "resource_id"], "left").where("coalesce(n, 0) < if(kind = 'matching', 2, 1)")
    policy = resources.where("kind = 'matching' and usage_policy <> 'useOnce'")
    matching = exercises.where("kind = 'matching'").select("doc_id", "exercise_id", F.col("shared_resource_id").alias("resource_id")).join(
        fields.select("doc_id", "exercise_id", "field_id", "accepted"), ["doc_id", "exercise_id"])
    known = entries.groupBy("doc_id", "resource_id").agg(F.collect_set("entry_id").alias("ids"))
    unstable = matching.join(known, ["doc_id", "resource_id"], "left").where(
        "size(accepted) <> 1 or not coalesce(array_contains(ids, accepted[0]), false)")

    def repeated(df, kind, key):
        return violation(df.groupBy("doc_id", key).count().where("count > 1"), kind, key, "ID_REPEATED")

    parts = [
        violation(few, "exercise", "exercise_id", "TOO_FEW_OPTIONS"),
        violation(exercises.where(needs & F.col("shared_resource_id").isNull()), "exercise", "exercise_id", "RESOURCE_MISSING"),
        violation(exercises.where(~needs & F.col("shared_resource_id").isNotNull()), "exercise", "exercise_id", "RESOURCE_UNEXPECTED"),
        violation(lost, "exercise", "exercise_id", "RESOURCE_UNKNOWN"), violation(short, "resource", "resource_id", "TOO_FEW_ENTRIES"),
        violation(policy, "resource", "resource_id", "USAGE_POLICY"), violation(unstable, "field", "field_id", "ENTRY_UNSTABLE"),
        violation(groups.where("(completeness = 'partial') <> (missing_boundary is not null)"), "group", "group_id", "BOUNDARY_MISMATCH"),
        repeated(groups, "group", "group_id"), repeated(exercises, "exercise", "exercise_id"), repeated(options, "option", "option_id"), repeated(fields, "field", "field_id"),
        violation(fields.where("confidence < 0 or confidence > 1"), "field", "field_id", "CONFIDENCE_RANGE"),
        violation(fields.where("review_status = 'verified' and provenance = 'modelInferred'"), "field", "field_id", "MODEL_VERIFIED"),
    ]
    if published:
        parts += [
            violation(fields.where("coalesce(size(accepted), 0) < 1"), "field", "field_id", "NO_ACCEPTED_VALUE"),
            violation(fields.where("review_status <> 'verified'"), "field", "field_id", "NOT_VERIFIED"),
            violation(fields.where("provenance = 'modelInferred'"), "field", "field_id", "MODEL_INFERRED"),
        ]
    return union(parts)


ANSWER_COLUMNS = ("accepted", "accepted_values", "answer", "provenance", "review_status", "evidence", "confidence", "source_refs")


def _answer_fields(kind: T.DataType, path: str = "") -> list[str]:
    """Paths of a schema, at any depth, whose names hold answers or provenance."""
    if isinstance(kind, T.ArrayType):
        return _answer_fields(kind.elementType, path)
    if isinstance(kind, T.MapType):
        return _answer_fields(kind.valueType, path)
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for f in kind.fields:
        own = f"{path}.{f.name}".lstrip(".")
        out += [own] if f.name.lower() in ANSWER_COLUMNS else _answer_fields(f.dataType, own)
    return out


def student_violations(lessons: DataFrame, exercises: DataFrame, resources: DataFrame) -> DataFrame:
    """V5: the students' copy holds no answers at any depth; public ids are long and url-safe; resources pair up.

    Every row whose column holds something under an answer's name is reported.
    """
    parts = [violation(lessons.where("not public_lesson_id rlike '^[A-Za-z0-9_-]{22,}$'"), "lesson", "public_lesson_id", "PUBLIC_ID")]
    for df, kind, key in ((lessons, "lesson", "public_lesson_id"), (exercises, "exercise", "exercise_id"), (resources, "resource", "resource_id")):
        for path in _answer_fields(df.schema):
            parts.append(violation(df.where(F.col(path.split(".")[0]).isNotNull()), kind, key, "ANSWER_COLUMN", evidence=F.lit(path)))
    needs = F.col("kind").isin("wordBankGap", "matching")
    lost = exercises.where(needs).join(resources.select("doc_id", F.col("resource_id").alias("shared_resource_id")), ["doc_id", "shared_resource_id"], "left_anti")
    parts.append(violation(lost, "exercise", "exercise_id", "RESOURCE_UNKNOWN"))
    return union(parts)


def mutated_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows that changed or went between two snapshots of an append-only table."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key))), 256)
    both = before.select(key, digest(before).alias("b")).join(after.select(key, digest(after).alias("a")), key, "left")
    code = F.when(F.col("a").isNull(), "DELETED").when(F.col("a") != F.col("b"), "CHANGED")
    return both.withColumn("code", code).where("code is not null").select(key, "code")


def event_violations(events: DataFrame) -> DataFrame:
    """Failed events carry a failure, others none; only retriable ones resume; size failures carry details."""
    failed = F.col("status") == "failed"
    rules = [
        (failed & F.col("failure_kind").isNull(), "FAILURE_MISSING"), (~failed & F.col("failure_kind").isNotNull(), "FAILURE_UNEXPECTED"),
        (F.coalesce("resume_allowed", F.lit(False)) != F.coalesce(F.col("failure_kind") == "retriable", F.lit(False)), "RESUME_FLAG"),
        ((F.col("failure_code") == "SOURCE_TOO_LARGE") & F.col("details").isNull(), "DETAILS_MISSING"),
    ]
    codes = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in rules]), lambda c: c.isNotNull())
    sequence = events.groupBy("run_id", "seq").count().where("count > 1")
    found = events.select("run_id", "seq", F.explode(codes).alias("code"))
    return found.unionByName(sequence.select("run_id", "seq", F.lit("SEQUENCE_REPEATED").alias("code")))

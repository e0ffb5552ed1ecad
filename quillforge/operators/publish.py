"""Publication gate, versions and the students' copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upcast_word_banks(exercises: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V6: local options of a group's bank exercises merged by first value into one bank, numbered anew."""
    bank = exercises.where("kind = 'wordBankGap' and shared_resource_id is null").select("doc_id", "group_id", "exercise_id", F.col("ord").alias("e_ord"))
    found = bank.join(options, ["doc_id", "exercise_id"])
    firsts = found.groupBy("doc_id", "group_id", "value").agg(F.min(F.struct("e_ord", "ord")).alias("first"))
    resource = F.concat("group_id", F.lit(":bank"))
    n = F.row_number().over(W.partitionBy("doc_id", "group_id").orderBy("first", "value"))
    entries = firsts.select("doc_id", resource.alias("resource_id"), n.alias("ord"), "value").withColumn("entry_id", F.concat("resource_id", F.lit(":"), "ord"))
    old = (F.col("kind") == "wordBankGap") & F.col("shared_resource_id").isNull()
    return exercises.withColumn("shared_resource_id", F.when(old, resource).otherwise(F.col("shared_resource_id"))), entries


def block_reasons(drafts: DataFrame, issues: DataFrame, fields: DataFrame, coverage: DataFrame, lineage: DataFrame) -> DataFrame:
    """V7, V8: why a draft can't be published, each reason once, in order; an empty array if it can."""
    open_ = issues.where("severity = 'blocking' and resolution = 'open'").groupBy("draft_id").agg(F.lit(True).alias("open"))
    unverified = fields.where("review_status <> 'verified'").groupBy("draft_id").agg(F.lit(True).alias("unverified"))
    added = coverage.where("additions > 0").select("draft_id", F.lit(True).alias("added")).distinct()
    df = drafts.select("draft_id").join(open_, "draft_id", "left").join(added, "draft_id", "left").join(unverified, "draft_id", "left").join(
        lineage.select("draft_id", F.col("reasons").alias("lineage")), "draft_id", "left")
    fixed = F.filter(F.array(F.when(F.col("open"), F.lit("OPEN_BLOCKING_ISSUE")), F.when(F.col("added"), F.lit("CONTENT_ADDED")), F.when(F.col("unverified"), F.lit("ANSWER_UNVERIFIED"))), lambda r: r.isNotNull())
    return df.select("draft_id", F.array_distinct(F.concat(fixed, F.coalesce("lineage", F.array().cast("array<string>")))).alias("reasons"))


def publish(drafts: DataFrame, reasons: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V9: (new versions, lessons' current version) of drafts without reasons; the first publication needs ``confirmed``.

    Rows: draft_id, source_id, lesson_id, has_matching, confirmed, created_at.  Schema 1.2.0 if an exercise matches, else 1.1.0.
    """
    ready = drafts.join(reasons.where(F.size("reasons") == 0), "draft_id", "left_semi")
    last = versions.groupBy("source_id").agg(F.max("version").alias("last"), F.max_by("lesson_id", "version").alias("old_lesson"))
    df = ready.join(last, "source_id", "left").where(F.col("last").isNotNull() | F.coalesce("confirmed", F.lit(False)))
    n = F.row_number().over(W.partitionBy("source_id").orderBy("created_at", "draft_id"))
    df = df.select(
        "source_id", F.coalesce("old_lesson", F.min("lesson_id").over(W.partitionBy("source_id"))).alias("lesson_id"), "draft_id",
        (F.coalesce("last", F.lit(0)) + n).cast("int").alias("version"), F.when(F.col("has_matching"), "1.2.0").otherwise("1.1.0").alias("schema_version"), "created_at")
    return df, latest_versions(df)


def latest_versions(versions: DataFrame) -> DataFrame:
    """The latest version of each lesson."""
    return versions.groupBy("lesson_id").agg(F.max("version").alias("version"), F.max_by("draft_id", "version").alias("draft_id"))


def project_student(exercises: DataFrame) -> DataFrame:
    """Exercises as students see them: no answers, no provenance; the kind of response each field takes."""
    response = F.when(F.col("kind").isin("singleChoice", "oddOneOut", "imageChoice", "wordBankGap", "matching"), "choice").when(
        F.col("kind") == "wordOrder", "orderedTokens").otherwise("text")
    return exercises.select(
        "doc_id", "group_id", "exercise_id", "ord", "kind", "prompt", response.alias("response_kind"),
        F.transform("options", lambda o: F.struct(o["option_id"].alias("option_id"), o["ord"].alias("ord"), o["value"].alias("value"))).alias("options"),
        F.transform("fields", lambda f: F.struct(f["field_id"].alias("field_id"), f["ord"].alias("ord"))).alias("fields"))


def resolve_public(lessons: DataFrame, versions: DataFrame, public_ids: DataFrame) -> DataFrame:
    """The current version behind each public id; unknown or unpublished ids give no row."""
    current = public_ids.join(lessons.where("current_version is not null"), "public_lesson_id")
    return current.join(versions.withColumnRenamed("version", "current_version"), ["lesson_id", "current_version"])

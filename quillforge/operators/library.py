"""Listings: attempt history and detail, lesson library, versions, run workspace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.operators.grading import result_status


@dataclass(frozen=True)
class HistoryParams:
    owner: str
    query: str | None = None
    delivery: str | None = None
    result: str | None = None
    before: tuple[str, str] | None = None  # created_at and attempt_id of the last row seen
    limit: int = 24


def contains_text(col: Column, query: str) -> Column:
    """Case-insensitive contains; wildcard characters have no meaning."""
    return F.contains(F.lower(F.coalesce(col, F.lit(""))), F.lit(query.strip().lower()))


def history_rows(attempts: DataFrame, lessons: DataFrame, outbox: DataFrame, p: HistoryParams) -> DataFrame:
    """Filtered attempts of an owner, before paging; the total is this frame's count."""
    df = attempts.where(F.col("owner_id") == p.owner)
    df = df.join(lessons.select("lesson_id", "title"), "lesson_id").join(outbox.select("attempt_id", F.col("status").alias("delivery")), "attempt_id", "left")
    df = df.withColumn("delivery", F.coalesce("delivery", F.lit("pending"))).withColumn("result", result_status(F.col("correct"), F.col("total")))
    if p.query:
        df = df.where(contains_text(F.col("title"), p.query) | contains_text(F.col("student"), p.query))
    if p.delivery:
        df = df.where(F.col("delivery") == p.delivery)
    if p.result:
        df = df.where(F.col("result") == p.result)
    return df


def attempt_history(attempts: DataFrame, lessons: DataFrame, outbox: DataFrame, p: HistoryParams) -> DataFrame:
    """One page, newest first, with one row more than the limit if there is a next page.

    A keyset page: a filter and a top-k, which plans as TakeOrderedAndProject.
    """
    df = history_rows(attempts, lessons, outbox, p)
    if p.before:
        at, last = F.lit(p.before[0]).cast("timestamp"), p.before[1]
        df = df.where((F.col("created_at") < at) | (F.col("created_at") == at) & (F.col("attempt_id") < last))
    return df.orderBy(F.desc("created_at"), F.desc("attempt_id")).limit(p.limit + 1)


def attempt_detail(attempt_id, rows: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Response rows of an attempt with what the lesson says of their fields, and rows of unknown fields."""
    own = rows.where(F.col("attempt_id") == attempt_id)
    keys = ["lesson_id", "lesson_version", "field_id"]
    known = own.join(fields.select(*keys, "exercise_id", "ord", "prompt", "accepted"), keys)
    known = known.withColumn("shown", F.when(~F.col("correct"), F.col("accepted"))).drop("accepted")
    return known.orderBy("ord"), own.join(fields, keys, "left_anti")


def version_counts(versions: DataFrame) -> DataFrame:
    """Number of versions and the latest of each lesson."""
    return versions.groupBy("lesson_id").agg(F.count("*").alias("n_versions"), F.max("version").alias("latest"), F.max_by("version_id", "version").alias("latest_id"))


def library_cards(lessons: DataFrame, versions: DataFrame, runs: DataFrame, query: str | None = None, status: str | None = None) -> DataFrame:
    """Published cards, then editable runs, with their sort key."""
    counts = version_counts(versions)
    published = lessons.join(counts, "lesson_id", "left").select(
        F.lit(0).alias("rank"), F.lit("published").alias("kind"), F.col("lesson_id").cast("string").alias("card_id"), "title",
        F.col("created_at").alias("sort_at"), F.greatest(F.coalesce("n_versions", F.lit(0)), F.lit(1)).cast("long").alias("n_versions"))
    drafts = runs.select(
        F.lit(1).alias("rank"), F.lit("draft").alias("kind"), F.col("run_id").cast("string").alias("card_id"), "title",
        F.col("updated_at").alias("sort_at"), F.lit(0).cast("long").alias("n_versions"))
    return library_filter(published.unionByName(drafts), query, status)


def library_filter(cards: DataFrame, query: str | None, status: str | None) -> DataFrame:
    """Title search and status; an unknown status means all."""
    if query and query.strip():
        cards = cards.where(contains_text(F.col("title"), query))
    return cards.where(F.col("kind") == status) if status in ("published", "draft") else cards


def library_page(cards: DataFrame, page: int, size: int = 24) -> DataFrame:
    """One page across the boundary between published lessons and drafts."""
    return cards.orderBy("rank", F.desc("sort_at"), F.desc("card_id")).offset(page * size).limit(size)


def lesson_versions(versions: DataFrame, lesson_id) -> DataFrame:
    """Versions of a lesson, newest first."""
    return versions.where(F.col("lesson_id") == lesson_id).orderBy(F.desc("version"))


def run_workspace(runs: DataFrame, sources: DataFrame, drafts: DataFrame, reviews: DataFrame, issues: DataFrame, events: DataFrame) -> DataFrame:
    """Run, source, draft or active review, issues and events, one row a run."""
    many_issues = issues.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("issue_id", "code", "severity", "resolution"))).alias("issues"))
    log = events.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "status", "step"))).alias("events"))
    active = reviews.where("status = 'active'").select("run_id", "review_id")
    out = runs.join(sources.select("source_id", "title"), "source_id", "left").join(drafts.select("run_id", "draft_id"), "run_id", "left")
    return out.join(active, "run_id", "left").join(many_issues, "run_id", "left").join(log, "run_id", "left")

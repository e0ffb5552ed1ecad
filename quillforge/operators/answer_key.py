"""Answer keys and candidate accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def answer_key_entries(blocks: DataFrame) -> DataFrame:
    """After an answer-key heading, ``Exercise n`` sets the group (1 until then) and pairs ``n letter`` are entries."""
    t = F.trim("raw_text")
    upto = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    df = blocks.withColumn("t", t).withColumn("on", F.max(t.rlike(r"(?i)^answer\s*key\b")).over(upto)).where("on")
    named = F.nullif(F.regexp_extract("t", r"(?i)^exercise\s+(\d+)", 1), F.lit("")).cast("int")
    df = df.withColumn("group", F.coalesce(F.last(named, ignorenulls=True).over(upto), F.lit(1)))
    body = F.regexp_replace("t", r"(?i)^exercise\s+\d+", "")
    pattern = r"(?i)(?:^|\s)(\d{1,3})[.)]?\s+([a-z])(?=\s|$|[,;])"
    pairs = F.zip_with(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.regexp_extract_all(body, F.lit(pattern), F.lit(2)),
                       lambda n, x: F.struct(n.cast("int").alias("ordinal"), F.lower(x).alias("label")))
    return df.select("doc_id", "group", "block_id", F.inline(pairs))


def reconcile_key(targets: DataFrame, entries: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verified answers, conflicts).  Several different labels for an item are a conflict.

    ``targets``: doc_id, group, ordinal, exercise_id, field_id; ``options``: exercise_id, label, value.
    """
    found = entries.groupBy("doc_id", "group", "ordinal").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    met = targets.join(found, ["doc_id", "group", "ordinal"])
    conflicts = met.where(F.size("labels") > 1).select(
        "doc_id", F.col("exercise_id").alias("entity_id"), F.lit("ANSWER_KEY_CONFLICT").alias("code"), F.lit("blocking").alias("severity"), F.array_join("labels", ",").alias("evidence"))
    one = met.where(F.size("labels") == 1).withColumn("label", F.col("labels")[0])
    values = options.select("exercise_id", F.lower("label").alias("label"), "value")
    verified = one.join(values, ["exercise_id", "label"]).select(
        "doc_id", "exercise_id", "field_id", F.array("value").alias("accepted"), F.lit("sourceKey").alias("provenance"), F.lit("verified").alias("review_status"))
    return verified, conflicts


def account_candidates(candidates: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outcome of every candidate, and per document whether all are accounted for.

    ``accounts``: doc_id, candidate_id, seq, kind (exercise, issue, decision); an exercise beats an issue beats a
    decision, the last of a kind wins.  An account of no candidate is an addition.
    """
    rank = F.when(F.col("kind") == "exercise", 0).when(F.col("kind") == "issue", 1).otherwise(2)
    best = accounts.groupBy("doc_id", "candidate_id").agg(F.min_by("kind", F.struct(rank, -F.col("seq"))).alias("outcome"))
    out = candidates.select("doc_id", "candidate_id").withColumn("known", F.lit(True)).join(best, ["doc_id", "candidate_id"], "full_outer")
    out = out.withColumn("state", F.when(F.col("known").isNull(), "addition").when(F.col("outcome").isNull(), "gap").otherwise(F.col("outcome")))
    report = out.groupBy("doc_id").agg(
        F.count_if("known").alias("detected"), F.count_if(F.col("known") & F.col("outcome").isNotNull()).alias("accounted"),
        F.count_if(F.col("state") == "addition").alias("additions"), F.count_if(F.col("state") == "gap").alias("gaps"))
    status = F.when((F.col("gaps") > 0) | (F.col("additions") > 0), "blocked").otherwise("complete")
    return out.drop("known"), report.withColumn("status", status)

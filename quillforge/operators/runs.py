"""Runs, events, leases and outbox in batch form (ST1-ST3, ST5-ST14).  ``now`` is always a parameter."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.sources.intake import resolve_replay


def _now(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def _age(now: str, column: str) -> Column:
    """Seconds from a timestamp column, of either kind, to ``now``."""
    return _now(now).cast("double") - F.col(column).cast("timestamp").cast("double")


def sequence_events(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """ST1: gap-free sequence numbers per run; events already stored or repeated in the batch are ignored."""
    new = events.dropDuplicates(["run_id", "event_id"])
    order = W.partitionBy("run_id").orderBy("occurred_at", "event_id")
    if stored is None:
        return new.withColumn("seq", F.row_number().over(order))
    last = stored.groupBy("run_id").agg(F.max("seq").alias("__last"))
    new = new.join(stored.select("run_id", "event_id"), ["run_id", "event_id"], "left_anti").join(last, "run_id", "left")
    return new.withColumn("seq", F.coalesce("__last", F.lit(0)) + F.row_number().over(order)).drop("__last")


def run_state(events: DataFrame) -> DataFrame:
    """ST2: the last event of each run, by sequence, and the last status, step, checkpoint and failure that an event carries.

    An aggregate with map-side combining; columns that the events lack are left out.
    """
    carried = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("status", "step", "checkpoint", "failure_code", "failure_kind") if c in events.columns]
    return events.groupBy("run_id").agg(
        F.max("seq").alias("seq"), F.max_by("type", "seq").alias("type"), F.max_by("occurred_at", "seq").alias("updated_at"), F.count("*").alias("n_events"), *carried)


def stale_runs(runs: DataFrame, drafts: DataFrame, now: str, accepted_s: int = 30, processing_s: int = 180) -> DataFrame:
    """ST3: runs without a draft that have been accepted or processing too long; null times are never stale."""
    age = _age(now, "updated_at")
    old = F.when(F.col("status") == "accepted", age >= accepted_s).when(F.col("status") == "processing", age >= processing_s)
    return runs.where(F.coalesce(old, F.lit(False))).join(drafts.select("run_id"), "run_id", "left_anti")


def rate_limit(requests: DataFrame, limit: int = 30) -> DataFrame:
    """ST5: whether each request is within the limit of its identity and clock hour."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    hour = F.date_trunc("hour", "created_at")
    n = F.row_number().over(W.partitionBy("identity", hour).orderBy("created_at", "request_id"))
    return requests.withColumn("hour", hour).withColumn("n", n).withColumn("allowed", n <= limit)


def claim_outbox(outbox: DataFrame, claims: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """ST6: (outbox after the claims, outcome of each claim): the first claim of a pending row wins."""
    first = F.row_number().over(W.partitionBy("attempt_id").orderBy("arrived", "claim_id")) == 1
    met = claims.join(outbox.select("attempt_id", "status"), "attempt_id", "left").withColumn("won", first & (F.col("status") == "pending"))
    won = met.where("won").select("attempt_id").withColumn("__c", F.lit(True))
    after = outbox.join(won, "attempt_id", "left").withColumn("claimed_at", F.when(F.col("__c"), _now(now)).otherwise(F.col("claimed_at")))
    return after.withColumn("status", F.when(F.col("__c"), "sending").otherwise(F.col("status"))).drop("__c"), met.drop("status")


def recover_outbox(outbox: DataFrame, now: str, stuck_min: int = 10, pending_min: int = 2, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """ST7: (outbox with stuck rows pending again, the oldest pending rows to emit)."""
    age = lambda c: _age(now, c) / 60
    stuck = (F.col("status") == "sending") & (age("claimed_at") >= stuck_min)
    after = outbox.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))
    return after, after.where((F.col("status") == "pending") & (age("created_at") >= pending_min)).orderBy("created_at", "attempt_id").limit(limit)


def lease_batches(leases: DataFrame, requests: DataFrame, now: str, minutes: int = 2) -> DataFrame:
    """ST8: outcome of each request: reuse, in_progress, conflict, or claimed with a new lease.

    Keys: run_id, batch_index.  Of several requests for a key the first may claim, the rest find it in progress.
    """
    key = ["run_id", "batch_index"]
    old = leases.select(*key, F.col("batch_hash").alias("__hash"), "status", "attempt_count", "lease_expires_at")
    df = requests.join(old, key, "left")
    live = F.coalesce(F.col("lease_expires_at") > _now(now), F.lit(False))
    able = F.when(F.col("__hash").isNotNull() & (F.col("__hash") != F.col("batch_hash")), "conflict").when(
        F.col("status") == "completed", "reuse").when(live, "in_progress").otherwise("claimed")
    df = df.withColumn("outcome", able)
    turn = F.row_number().over(W.partitionBy(*key, "outcome").orderBy("arrived", "request_id"))
    df = df.withColumn("outcome", F.when((F.col("outcome") == "claimed") & (turn > 1), "in_progress").otherwise(F.col("outcome")))
    got = F.col("outcome") == "claimed"
    return df.select(
        *key, "request_id", "outcome", F.when(got, F.coalesce("attempt_count", F.lit(0)) + 1).alias("attempt_count"),
        F.when(got, _now(now) + F.expr(f"interval {minutes} minutes")).alias("lease_expires_at"))


def complete_leases(leases: DataFrame, completions: DataFrame) -> DataFrame:
    """ST8: completions with a stale token are rejected."""
    met = completions.join(leases.select("run_id", "batch_index", F.col("claim_token").alias("__t")), ["run_id", "batch_index"], "left")
    return met.withColumn("accepted", F.coalesce(F.col("claim_token") == F.col("__t"), F.lit(False))).drop("__t")


def resume_runs(runs: DataFrame, requests: DataFrame, stored: DataFrame) -> DataFrame:
    """ST9: resume requests: failed, retriable runs that allow it; idempotent by key."""
    fit = runs.select("run_id", ((F.col("status") == "failed") & (F.col("failure_kind") == "retriable") & F.col("resume_allowed")).alias("__fit"))
    df = resolve_replay(requests.join(fit, "run_id", "left"), stored, "key", "fingerprint", ("created_at", "request_id"))
    ok = F.coalesce("__fit", F.lit(False))
    return df.withColumn("outcome", F.when((F.col("outcome") == "create") & ~ok, "rejected").otherwise(F.col("outcome"))).drop("__fit")


def redispatch(runs: DataFrame, drafts: DataFrame, requests: DataFrame, stored: DataFrame, events: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """ST10: (outcome of redispatch requests on stale runs, the event rows they append)."""
    stale = stale_runs(runs, drafts, now).select("run_id").withColumn("__stale", F.lit(True))
    df = resolve_replay(requests.join(stale, "run_id", "left"), stored, "key", "fingerprint", ("created_at", "request_id"))
    df = df.withColumn("outcome", F.when((F.col("outcome") == "create") & F.col("__stale").isNull(), "rejected").otherwise(F.col("outcome"))).drop("__stale")
    new = df.where("outcome = 'create'").select("run_id", F.col("request_id").alias("event_id"), _now(now).alias("occurred_at"), F.lit("run.redispatched").alias("type"))
    return df, sequence_events(new, events)


#: fixed values: names of payload keys whose values never leave the store, and what stands in their place
SENSITIVE = (
    r"(?i)source(text|content)?|raw.?text|block.?text|accepted(values?)?|answer|evidence|secret|password|credential"
    r"|api.?key|signed.?url|storage.?url|(session|access|refresh|auth).?token")
REDACTED = "[REDACTED]"


def redact_fields(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """ST11, known payloads: the struct rebuilt with sensitive fields masked, in the JVM."""
    def mask(col: Column, kind: T.StructType) -> Column:
        out = []
        for f in kind.fields:
            hidden = re.search(SENSITIVE, f.name)
            value = F.lit(REDACTED) if hidden else mask(col[f.name], f.dataType) if isinstance(f.dataType, T.StructType) else col[f.name]
            out.append(value.alias(f.name))
        return F.struct(*out)

    return df.withColumn(column, F.to_json(mask(F.from_json(column, schema), schema)))


def _walk(value):
    if isinstance(value, dict):
        return {k: REDACTED if re.search(SENSITIVE, k) else _walk(v) for k, v in value.items()}
    return [_walk(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def _redacted(payload: pd.Series) -> pd.Series:
    def one(text):
        try:
            return json.dumps(_walk(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return "[unreadable]"

    return payload.map(one, na_action="ignore")


def redact(df: DataFrame, column: str) -> DataFrame:
    """ST11, free payloads: a recursive walk; rows that hold no sensitive name stay in the JVM."""
    suspect = F.coalesce(F.col(column).rlike(SENSITIVE) | F.col(column).contains("\\u"), F.lit(False))
    return df.where(~suspect).unionByName(df.where(suspect).withColumn(column, _redacted(F.col(column))))


def public_events(events: DataFrame) -> DataFrame:
    """ST12: five public fields of each event, with defaults."""
    v = F.try_parse_json("payload")
    return events.select(
        "run_id", "seq", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce(F.try_variant_get(v, "$.step", "string"), F.lit("none")).alias("step"),
        F.coalesce(F.try_variant_get(v, "$.progress", "double"), F.lit(0.0)).alias("progress"))


def limit_failures(fields: DataFrame, limit: int = 500) -> DataFrame:
    """ST13: runs with more answer fields than allowed end in a failure event."""
    return fields.groupBy("run_id").agg(F.count("*").alias("actual")).where(F.col("actual") > limit).select(
        "run_id", F.lit("run.failed").alias("type"), F.lit("ANSWER_FIELD_LIMIT").alias("failure_code"), F.lit("terminal").alias("failure_kind"), F.lit(limit).alias("limit"), "actual")


def route_extraction(docs: DataFrame, groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """ST14: groups make a draft, candidates without groups a layout review with a blocking issue, nothing a failure."""
    g = groups.groupBy("doc_id").agg(F.count("*").alias("n_groups"))
    c = candidates.groupBy("doc_id").agg(F.count("*").alias("n_candidates"))
    df = docs.select("doc_id").join(g, "doc_id", "left").join(c, "doc_id", "left").fillna(0)
    route = F.when(F.col("n_groups") > 0, "draft").when(F.col("n_candidates") > 0, "layoutReview").otherwise("empty")
    return df.withColumn("route", route).withColumn("issue", F.when(route == "layoutReview", "UNKNOWN_LAYOUT"))

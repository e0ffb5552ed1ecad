"""Streams: attempts de-duplicated with conflicts, hourly rate counts, outbox timers, ingestion (ST4, ST5, ST7, ST15)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillforge.operators import extract
from quillforge.sources import intake

def _timed(stream: DataFrame, column: str) -> DataFrame:
    """Watermarks take timestamps with a zone; others are read in the session's."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Attempts(StatefulProcessor):
    """The first fingerprint of each attempt id; later rows are replays or conflicts."""

    def __init__(self, keep_ms: int):
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._first = handle.getValueState("first", "fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._first.get()[0] if self._first.exists() else None
        for part in rows:
            part = part.sort_values(["created_at", "fingerprint"])
            out = []
            for fingerprint, at in zip(part["fingerprint"], part["created_at"]):
                if known is None:
                    known = fingerprint
                    self._first.update((known,))
                    self._handle.registerTimer(_millis(at) + self._keep)
                    out.append("create")
                else:
                    out.append("replay" if fingerprint == known else "conflict")
            yield pd.DataFrame({"attempt_id": key[0], "fingerprint": part["fingerprint"].to_numpy(), "outcome": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._first.clear()
        yield pd.DataFrame({"attempt_id": pd.Series(dtype="int64"), "fingerprint": pd.Series(dtype="str"), "outcome": pd.Series(dtype="str")})

    def close(self) -> None:
        pass


def _millis(at) -> int:
    return pd.Timestamp(at).value // 1_000_000


def dedupe_attempts_stream(stream: DataFrame, delay: str = "10 minutes", keep_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """ST4: outcome of every attempt row of a stream (attempt_id, fingerprint, created_at), in the order of their times.

    State is one fingerprint an id, dropped by an event-time timer once the watermark is ``keep_ms`` past the first row; rows behind the
    watermark are dropped.  No clock is read, so reruns agree and ``availableNow`` ends.  Rows without a fingerprint count as an empty one.
    """
    rows = _timed(stream, "created_at").withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))
    return rows.withWatermark("created_at", delay).groupBy("attempt_id").transformWithStateInPandas(
        _Attempts(keep_ms), "attempt_id bigint, fingerprint string, outcome string", "Append", "EventTime")


def replays_dropped(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """ST4, where conflicts can't occur: one row of each attempt id within the watermark."""
    return _timed(stream, "created_at").withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["attempt_id"])


def rate_counts(stream: DataFrame, limit: int = 30, delay: str = "10 minutes") -> DataFrame:
    """ST5: requests of each identity and clock hour, and how many of them exceed the limit."""
    n = _timed(stream, "created_at").withWatermark("created_at", delay).groupBy(F.window("created_at", "1 hour"), "identity").agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("hour"), "identity", "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("n_over"))


class _Outbox(StatefulProcessor):
    """The undone status of each delivery and its time; it falls due when the next row, or the watermark, is too late for it."""

    def __init__(self, pending_ms: int):
        self._wait = pending_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._since = handle.getValueState("since", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since, due = (self._since.get()[0] if self._since.exists() else None), []
        for part in rows:
            part = part.sort_values(["at", "status"])
            for at, status in zip(part["at"].map(_millis), part["status"]):
                if since is not None and at > since + self._wait:
                    due.append(since + self._wait)
                since = at if status in ("pending", "sending") else None
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if since is None:
            self._since.clear()
        else:
            self._since.update((since,))
            self._handle.registerTimer(since + self._wait)
        yield self._rows(key, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = [self._since.get()[0] + self._wait] if self._since.exists() else []
        self._since.clear()
        yield self._rows(key, due)

    @staticmethod
    def _rows(key, due: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"attempt_id": pd.Series([key[0]] * len(due), dtype="int64"), "due_ms": pd.Series(due, dtype="int64")})

    def close(self) -> None:
        pass


def recover_outbox_stream(stream: DataFrame, pending_ms: int = 120_000, delay: str = "10 minutes") -> DataFrame:
    """ST7: (attempt_id, status ``pending``, due_at) for every status row (attempt_id, status, at) pending or sending that no later row
    of the delivery follows within ``pending_ms``.

    Timers are of event time: a delivery is due once the watermark passes, or by a later row that comes too late.  It is emitted once
    a status; a sender that takes it up writes ``sending`` to the stream, which starts the next wait.  Reruns agree and ``availableNow`` ends.
    """
    out = _timed(stream, "at").withWatermark("at", delay).groupBy("attempt_id").transformWithStateInPandas(
        _Outbox(pending_ms), "attempt_id bigint, due_ms bigint", "Append", "EventTime")
    return out.select("attempt_id", F.lit("pending").alias("status"), F.timestamp_millis("due_ms").alias("due_at"))


def ingest_batch(sources: DataFrame, out: str, limits: intake.Limits = intake.Limits()) -> None:
    """ST15: one batch of new sources: identity, admission, items, fields, coverage; appended by key.

    Every table is appended through its keys, so a batch that is repeated after a failure adds nothing.
    """
    known = intake.add_identity(sources)
    accepted, rejected = intake.admit(known, limits)
    first = intake.dedupe_sources(accepted).select("doc_id", "owner_id", "title", "text", "content_hash", "created_at")
    items, fields, coverage = extract.extract_text(first)
    intake.append_new(first, f"{out}/sources", ["owner_id", "content_hash"])
    intake.append_new(rejected.select("doc_id", "limit_type", "limit", "actual"), f"{out}/rejected", ["doc_id", "limit_type"])
    intake.append_new(items.drop("is_last"), f"{out}/items", ["doc_id", "exercise_id"])
    intake.append_new(fields, f"{out}/fields", ["doc_id", "field_id"])
    intake.append_new(coverage, f"{out}/coverage", ["doc_id"])


def ingest_stream(stream: DataFrame, out: str, checkpoint: str, limits: intake.Limits = intake.Limits()):
    """ST15: the started query over a stream of sources; it ends when what is there has been read."""
    return stream.writeStream.foreachBatch(lambda df, _: ingest_batch(df, out, limits)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

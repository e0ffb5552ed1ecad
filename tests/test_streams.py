import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillforge.plans import bindings as b
from quillforge.sources import intake
from quillforge.streaming import jobs


def stream(spark, df, path):
    """The rows of a frame as a stream, a file at a time."""
    df.write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(300)
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def stateful(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    jobs.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_attempts_equal_batch(stateful, sf, tmp_path):
    e = b.table(stateful, sf, "events").select(F.col("user_id").cast("bigint").alias("attempt_id"), F.col("event_type").alias("fingerprint"), F.col("ts").alias("created_at"))
    half = e.agg(F.expr("percentile_approx(created_at, 0.5)")).first()[0]
    for part in (e.where(F.col("created_at") < half), e.where(F.col("created_at") >= half)):
        read = stream(stateful, part.coalesce(1), tmp_path / "in")
        time.sleep(1.1)  # files are taken in the order of their times
    got = drain(jobs.dedupe_attempts_stream(read, keep_ms=10**12), "attempts_out", "append")
    first = F.first("fingerprint").over(W.partitionBy("attempt_id").orderBy("created_at"))
    n = F.row_number().over(W.partitionBy("attempt_id").orderBy("created_at"))
    want = e.select("attempt_id", "fingerprint", F.when(n == 1, "create").when(F.col("fingerprint") == first, "replay").otherwise("conflict").alias("outcome"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 500


def test_attempts_forgotten_by_event_time(stateful, tmp_path):
    """Two runs over one checkpoint: the first id is forgotten once the watermark is an hour past it, the second is not."""
    def rows(*at):
        return stateful.createDataFrame([(i, f, t) for i, f, t in at], "attempt_id bigint, fingerprint string, t string").selectExpr(
            "attempt_id", "fingerprint", "cast(t as timestamp) as created_at")

    out, place = [], str(tmp_path / "in")
    for part in (
            rows((1, "a", "2024-01-01 10:00:00"), (2, "b", "2024-01-01 11:30:00"), (2, None, "2024-01-01 11:31:00")), rows((3, "c", "2024-01-01 12:00:00")),
            rows((1, "x", "2024-01-01 12:01:00"), (2, "b", "2024-01-01 12:01:00"))):
        read = stream(stateful, part.coalesce(1), place)
        jobs.dedupe_attempts_stream(read, "1 minute", 3_600_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option(
            "path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(300)
        got = sorted(map(tuple, stateful.read.parquet(str(tmp_path / "out")).collect()))
        out.append(got)
    assert out[0] == [(1, "a", "create"), (2, "", "conflict"), (2, "b", "create")]
    assert out[2] == sorted(out[0] + [(3, "c", "create"), (1, "x", "create"), (2, "b", "replay")])


def test_replays_dropped(spark, sf, tmp_path):
    e = b.table(spark, sf, "events").select(F.col("user_id").alias("attempt_id"), F.col("ts").alias("created_at"))
    got = drain(jobs.replays_dropped(stream(spark, e.coalesce(1), tmp_path / "in"), "3650 days"), "replays_out", "append")
    assert sorted(r.attempt_id for r in got.collect()) == sorted(r.attempt_id for r in e.select("attempt_id").distinct().collect())


def test_rate_counts_equal_batch(spark, sf, tmp_path):
    e = b.table(spark, sf, "events").select(F.col("event_type").alias("identity"), F.col("ts").cast("timestamp").alias("created_at"))
    got = drain(jobs.rate_counts(stream(spark, e.coalesce(1), tmp_path / "in"), limit=2), "rates_out", "complete")
    want = e.groupBy(F.date_trunc("hour", "created_at").alias("hour"), "identity").agg(F.count("*").alias("n")).withColumn("n_over", F.greatest(F.col("n") - 2, F.lit(0)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("n_over > 0").count() > 0


def test_outbox_equals_batch(stateful, sf, tmp_path):
    o = b.table(stateful, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "sent").when(F.col("o_orderstatus") == "O", "pending").otherwise("sending")
    rows = o.select(F.col("o_custkey").cast("bigint").alias("attempt_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("at"))
    rows = rows.dropDuplicates(["attempt_id", "at"])
    half, last = rows.select(F.expr("percentile_approx(at, 0.5)"), F.max("at")).first()
    wait = 30 * 86_400_000
    for part in (rows.where(F.col("at") < half), rows.where(F.col("at") >= half)):
        read = stream(stateful, part.coalesce(1), tmp_path / "in")
        time.sleep(1.1)
    got = drain(jobs.recover_outbox_stream(read, wait, "0 seconds"), "outbox_out", "append")
    after = F.lead("at").over(W.partitionBy("attempt_id").orderBy("at"))
    due = F.col("at") + F.expr("interval 30 days")
    want = rows.withColumn("after", after).where("status <> 'sent'").withColumn("due_at", due).where(
        (F.col("after") > F.col("due_at")) | F.col("after").isNull() & (F.col("due_at") < F.lit(last))).select("attempt_id", F.lit("pending").alias("status"), "due_at")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


class _Rushed(intake.CommitLog):
    """Lets another writer commit between the reading of the log and the first claim."""

    def __init__(self, folder, other):
        super().__init__(folder)
        self._other = other

    def claim(self, number, batch):
        other, self._other = self._other, None
        if other:
            other()
        return super().claim(number, batch)


def test_two_writers_store_each_key_once(spark, sf, tmp_path):
    o, path = b.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), str(tmp_path / "sink")
    first, second = o.where("o_orderkey % 3 < 2").withColumn("by", F.lit("first")), o.where("o_orderkey % 3 > 0").withColumn("by", F.lit("second"))
    keys = ["o_orderkey"]
    with ThreadPoolExecutor(2) as pool:
        numbers = list(pool.map(lambda df: intake.commit_new(df.unionByName(df), path, keys), (first, second)))
    stored = intake.committed_rows(spark, path, first.schema)
    assert sorted(numbers) == [0, 1] and stored.count() == o.count() == stored.select(keys).distinct().count()
    assert intake.commit_new(first, path, keys) == -1
    # the slower writer loses the keys both have
    slow = str(tmp_path / "slow")
    log = _Rushed(f"{slow}/_log", lambda: intake.commit_new(second, slow, keys))
    assert intake.commit_new(first, slow, keys, log) == 1
    kept = {r.o_orderkey: r.by for r in intake.committed_rows(spark, slow, first.schema).collect()}
    assert len(kept) == o.count() and all((by == "first") == (k % 3 == 0) for k, by in kept.items())
    # null keys and an empty batch
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "k int, v string")
    assert intake.commit_new(odd.limit(0), str(tmp_path / "odd"), ["k"]) == -1
    assert intake.commit_new(odd, str(tmp_path / "odd"), ["k"]) == 0 and intake.commit_new(odd, str(tmp_path / "odd"), ["k"]) == -1
    assert intake.committed_rows(spark, str(tmp_path / "odd"), odd.schema).count() == 2


def test_append_adds_only_new_keys(spark, sf, tmp_path):
    """A batch that is repeated, overlaps, or repeats a key itself."""
    o, path = b.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), str(tmp_path / "t")
    intake.append_new(o.where("o_orderstatus = 'F'"), path, ["o_orderkey"])
    before = spark.read.parquet(path).count()
    intake.append_new(o.where("o_orderstatus = 'F'"), path, ["o_orderkey"])
    assert spark.read.parquet(path).count() == before > 0
    intake.append_new(o.unionByName(o), path, ["o_orderkey"])
    after = spark.read.parquet(path)
    assert after.count() == o.count() == after.select("o_orderkey").distinct().count()


def test_load_sources(spark, tmp_path):
    """Texts of a folder, and typed rows with their problems."""
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "one.txt").write_text("1. first\n2. second\n")
    got = intake.load_sources(spark, str(tmp_path / "texts"), "text").first()
    assert (got.title, got.text, got.problems) == ("one.txt", "1. first\n2. second\n", [])
    rows = [("a", "o", "t", "text", None, "x", 1, None, "k" * 16), ("b", "o", " ", "text", bytearray(b"x"), "x", 1, None, "short"), ("c", None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, intake.SOURCE_SCHEMA).write.parquet(str(tmp_path / "rows"))
    found = {r.doc_id: r.problems for r in intake.load_sources(spark, str(tmp_path / "rows")).collect()}
    assert found == {"a": [], "b": ["ONE_OF_FILE_OR_TEXT", "TITLE_LENGTH", "KEY_LENGTH"], "c": ["ONE_OF_FILE_OR_TEXT", "TITLE_LENGTH"]}

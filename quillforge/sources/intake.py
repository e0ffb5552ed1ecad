"""Sources: reading, identity, admission, de-duplication, replay and append."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.functions.text import unify_newlines

SOURCE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("owner_id", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("bytes", T.BinaryType()), T.StructField("text", T.StringType()),
    T.StructField("page_count", T.IntegerType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("client_key", T.StringType()),
])


@dataclass(frozen=True)
class Limits:
    """Inclusive admission limits."""

    pages: int = 5
    bytes: int = 52_428_800
    code_points: int = 30_000
    answer_fields: int = 500


def load_sources(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Typed sources with ``problems``: exactly one of bytes and text, title and key lengths."""
    if fmt == "text":
        raw = spark.read.text(path, wholetext=True).select(
            F.input_file_name().alias("doc_id"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("title"),
            F.lit("text").alias("kind"), F.col("value").alias("text"))
        raw = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SOURCE_SCHEMA])
    else:
        raw = spark.read.schema(SOURCE_SCHEMA).format(fmt).load(path)
    return raw.withColumn("problems", source_problems())


def source_problems() -> Column:
    title = F.length(F.trim(F.coalesce("title", F.lit(""))))
    key = F.length(F.coalesce("client_key", F.lit("")))
    found = [
        (F.col("bytes").isNull() == F.col("text").isNull(), "ONE_OF_FILE_OR_TEXT"),
        (~title.between(1, 200), "TITLE_LENGTH"),
        (F.col("client_key").isNotNull() & ~key.between(16, 128), "KEY_LENGTH"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in found]), lambda x: x.isNotNull())


def read_artifacts(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """A JSON payload column as a typed struct; what does not parse is null and kept in ``bad_json``."""
    out = df.withColumn("artifact", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    return out.withColumn("bad_json", F.when(F.try_parse_json(F.col(column)).isNull(), F.col(column)))


def add_identity(df: DataFrame) -> DataFrame:
    """Content hash, request fingerprint and owner-scoped key."""
    content = F.coalesce(F.col("bytes"), unify_newlines(F.col("text")).cast("binary"))
    df = df.withColumn("content_hash", F.sha2(content, 256))
    canonical = F.to_json(F.struct(F.trim("title").alias("title"), "kind", F.col("content_hash").alias("hash")))
    return df.withColumn("fingerprint", F.sha2(canonical, 256)).withColumn(
        "owner_key", F.sha2(F.concat("owner_id", F.lit("\0"), "client_key"), 256))


def publish_key(run: Column, version: Column) -> Column:
    """Uniqueness key of a publication; null for versions below 1."""
    return F.when(version >= 1, F.concat_ws(":", run, version.cast("string")))


def dedupe_sources(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The first row of each (owner, content) that no existing source has.

    ``min_by`` keeps one row per key with map-side combining, so a hot content hash never meets in one task.
    """
    keys = ["owner_id", "content_hash"]
    if existing is not None:
        new = new.join(existing.select(keys).distinct(), keys, "left_anti")
    row = F.struct(*[c for c in new.columns if c not in keys])
    return new.groupBy(keys).agg(F.min_by(row, F.struct("created_at", "doc_id")).alias("r")).select(*keys, "r.*").select(new.columns)


def admit(df: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with a row for each limit passed.

    Reads ``page_count``, ``n_bytes``, ``text`` and ``n_fields`` where the columns exist.
    """
    measures = {
        "pages": (F.col("page_count") if "page_count" in df.columns else F.lit(None), limits.pages),
        "bytes": (F.col("n_bytes") if "n_bytes" in df.columns else F.lit(None), limits.bytes),
        "codePoints": (F.length(unify_newlines(F.col("text"))) if "text" in df.columns else F.lit(None), limits.code_points),
        "answerFields": (F.col("n_fields") if "n_fields" in df.columns else F.lit(None), limits.answer_fields),
    }
    breaches = F.filter(F.array(*[
        F.when(value > limit, F.struct(
            F.lit(name).alias("limit_type"), F.lit(limit).cast("long").alias("limit"), value.cast("long").alias("actual"),
            F.lit(name in ("pages", "codePoints")).alias("split_required")))
        for name, (value, limit) in measures.items()]), lambda b: b.isNotNull())
    judged = df.withColumn("breaches", breaches)
    rejected = judged.select("*", F.inline("breaches")).drop("breaches")
    return judged.where(F.size("breaches") == 0).drop("breaches"), rejected


def resolve_replay(incoming: DataFrame, existing: DataFrame, key: str = "owner_key", fingerprint: str = "fingerprint", order: tuple[str, ...] = ("created_at", "doc_id")) -> DataFrame:
    """``outcome`` create, replay or conflict for every incoming row, and missing_key for rows without a key.

    The first row of a key in the batch stands for it if nothing is stored under the key.
    """
    bare = incoming.where(F.col(key).isNull()).withColumn("outcome", F.lit("missing_key"))
    incoming = incoming.where(F.col(key).isNotNull())
    first = incoming.groupBy(key).agg(F.min_by(F.struct(fingerprint, *order), F.struct(*order)).alias("__first"))
    stored = existing.groupBy(key).agg(F.min(fingerprint).alias("__stored"))
    joined = incoming.join(first, key).join(stored, key, "left")
    leads = F.struct(fingerprint, *order) == F.col("__first")
    known = F.coalesce(F.col("__stored"), F.col(f"__first.{fingerprint}"))
    outcome = F.when(F.col("__stored").isNull() & leads, "create").when(known == F.col(fingerprint), "replay").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("__first", "__stored").unionByName(bare)


def new_rows(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new; of several in the batch, one."""
    return df.join(target.select(keys), keys, "left_anti").dropDuplicates(keys)


def append_new(df: DataFrame, path: str, keys: list[str], partition_by: tuple[str, ...] = ()) -> None:
    """Append-only sink for one writer at a time; rows whose key is stored already are left out, nothing is changed."""
    try:
        df = new_rows(df, df.sparkSession.read.schema(df.schema).parquet(path), keys)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        df = df.dropDuplicates(keys)
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


class CommitLog:
    """Numbered commits in a folder of a shared or local file system; a number belongs to the writer that links it first.

    Other stores need an object with the same two methods, over what they offer for create-if-absent.
    """

    def __init__(self, folder: str):
        self._folder = folder.removeprefix("file://")
        os.makedirs(self._folder, exist_ok=True)

    def batches(self) -> list[str]:
        """Batches in the order of their commits."""
        names = sorted((n for n in os.listdir(self._folder) if n.isdigit()), key=int)
        return [open(os.path.join(self._folder, n)).read() for n in names]

    def claim(self, number: int, batch: str) -> bool:
        """Takes a number for a batch; false if another writer has it."""
        own = os.path.join(self._folder, f"_{uuid.uuid4().hex}")
        with open(own, "w") as f:
            f.write(batch)
        try:
            os.link(own, os.path.join(self._folder, f"{number:020d}"))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)


def _batch_rows(spark: SparkSession, path: str, batches: list[str], schema: T.StructType) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{name}" for name in batches])


def committed_rows(spark: SparkSession, path: str, schema: T.StructType, log=None) -> DataFrame:
    """The rows of all committed batches of ``commit_new``; what a writer left behind uncommitted is not read."""
    return _batch_rows(spark, path, (log or CommitLog(f"{path}/_log")).batches(), schema)


def commit_new(df: DataFrame, path: str, keys: list[str], log=None) -> int:
    """Append-only sink for writers at the same time: each key is stored once, by the writer that commits first.

    Rows are written under a name of their own, then the next number of the log is claimed for them.  If another writer was faster,
    only the keys of its batches are taken out of the written rows, and the next number is tried.  A writer that is lost leaves files that no
    reader sees; one that repeats its batch adds nothing.  Returns the number of the commit, or -1 if no row was new.
    A null key is a key like any other.
    """
    spark, log = df.sparkSession, log or CommitLog(f"{path}/_log")
    seen: list[str] = []
    rows = df.dropDuplicates(keys)
    while True:
        batches = log.batches()
        fresh = batches[len(seen):]
        if fresh:
            stored = _batch_rows(spark, path, fresh, df.schema).select([F.col(k).alias(f"__{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            rows = rows.join(stored, same, "left_anti")
        if fresh or not seen:
            name = f"batch-{uuid.uuid4().hex}"
            rows.write.parquet(f"{path}/{name}")
            rows = spark.read.schema(df.schema).parquet(f"{path}/{name}")
            if rows.isEmpty():
                return -1
        seen = batches
        if log.claim(len(seen), name):
            return len(seen)


def scope(df: DataFrame, owner: str) -> DataFrame:
    """Rows of one owner."""
    return df.where(F.col("owner_id") == owner)


def tenant_violations(child: DataFrame, parent: DataFrame, key: str, child_id: str) -> DataFrame:
    """Child rows whose parent belongs to another owner, or does not exist."""
    joined = child.join(parent.select(key, F.col("owner_id").alias("parent_owner")), key, "left")
    code = F.when(F.col("parent_owner").isNull(), "NO_PARENT").when(~F.col("owner_id").eqNullSafe(F.col("parent_owner")), "OTHER_OWNER")
    return joined.withColumn("code", code).where("code is not null").select(F.col(child_id).alias("entity_id"), key, "code")


def orphan_rows(edges: list[tuple[str, DataFrame, DataFrame, str, str, str]]) -> DataFrame:
    """Rows of each child table whose key its parent table lacks.

    ``edges``: (name, child, parent, child key, parent key, child id).
    """
    out = None
    for name, child, parent, child_key, parent_key, child_id in edges:
        keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
        # tasks hold their share of the distinct keys; the child's rows, which are more, pass without a sort
        lost = child.join(keys.hint("shuffle_hash"), child_key, "left_anti").where(F.col(child_key).isNotNull())
        one = lost.select(F.lit(name).alias("edge"), F.col(child_id).cast("string").alias("entity_id"), F.col(child_key).cast("string").alias("missing"))
        out = one if out is None else out.unionByName(one)
    return out


def select_checkpoint(ir: DataFrame, parser_version: str) -> DataFrame:
    """The oldest block table of a text source, the oldest of the current parser of a PDF source."""
    usable = (F.col("source_kind") == "text") | (F.col("parser_version") == parser_version)
    return ir.where(usable).groupBy("source_id").agg(F.min_by("ir_id", F.struct("created_at", "ir_id")).alias("ir_id"))

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every node can reach, from ``spark.checkpoint.dir``.

    Unset, a local session gets a temporary folder (tests); on a cluster that would be another folder on
    every node, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at those files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def input_bytes(df: DataFrame, column: str) -> int:
    """Total bytes of a text column: one scan, one number to the driver."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def salts(most: int, rows: int) -> int:
    """Parts into which the rows of a key go so that a part of the largest key holds about ``rows``."""
    return max(1, -(-int(most or 0) // rows))


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], salt: Column, parts: int, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, which has one row for each key, with the rows of a key in ``parts`` tasks.

    ``salt`` is an integer over columns of ``many``; ``one`` is repeated for each part, so ``parts`` follows from the
    largest key (``salts``) and is 1 where no key is large.
    """
    if parts == 1:
        return many.join(one, keys, how)
    one = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return many.withColumn("__salt", F.pmod(salt, F.lit(parts)).cast("int")).join(one, [*keys, "__salt"], how).drop("__salt")


def components(edges: DataFrame, max_rounds: int = 60, hub_rows: int = 500_000) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has two long columns ``a`` and ``b``; direction, repeats and self links don't matter.
    Returns ``node`` and ``component`` (the smallest node reachable), for every node of an edge.
    Every step is an aggregate and a join on node ids.  The edges of a node with over ``hub_rows`` of them are
    joined in several tasks, so no component and no hub meets in one task; each
    round ends in a table in the shared folder.  Stops when a round changes nothing.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    pairs = stage(pairs, "edges")
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "lows")
        parts = salts(low.agg(F.max("n")).first()[0], hub_rows)
        # large star: every larger neighbour of u moves to u's smallest neighbour
        large = salted_join(both.where("v > u"), low.select("u", "m"), ["u"], F.xxhash64("v"), parts).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them; those are few after the large star
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            salted_join(large, low, ["u"], F.xxhash64("v"), parts)
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                      F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        pairs = stage(small, "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    heads = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)

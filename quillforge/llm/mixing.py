"""Mixing sources to target weights with weighted sampling without replacement.

Targets: sources share a total by weight, none above a multiple of its own size; what is over is shared
again among the others.  Selection inside a source follows Efraimidis and Spirakis: each
row gets the key -ln(u) / weight, u from a digest of its id, its text and its number among equal rows, and the smallest keys come first.  A source
whose target holds its whole size k times takes k complete epochs of every document; the rest of the
target is filled in key order, by prefix sums of sizes.

The prefix sums never gather a source: documents fall into buckets of the key, bucket totals are
summed first, and only the bucket in which a source's budget ends is sorted.  Rows without an id and repeats of a row
have keys of their own, so they spread over the buckets like others; they are numbered in ``SALTS`` parts.  The windows of
``targets`` are one task over one short row for each source.

Edge cases: null text has size 0; null source is a source of its own, last in order; null or
non-positive weights count as 1; repeated rows are separate documents (each within the limit), and which of equal
rows is taken makes no difference; sources without words have target 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, stage

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 64
_ROW = ["id", "source", "digest"]  # rows with these in common are equal to the mix


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Adds ``target`` to one row for each source (``source``, ``source_size``).

    In ascending order of limit / weight, a source is at its limit while an equal share by weight of
    what the sources before it have left exceeds the limit; the first share that doesn't holds for
    all the rest.  Both windows run over one row a source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    df = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    df = df.withColumn("cap", F.lit(most) * F.col("source_size"))
    everything = W.partitionBy()
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("level", (
        F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    df = df.withColumn("level", F.max(F.when(free, F.col("level"))).over(everything))
    return df.select("source", "source_size", "n_docs", F.least(
        F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``__number``, from 1 among the rows that agree on ``keys`` (nulls agree); a group meets in ``SALTS`` tasks.

    The rows are written first, so that both passes see one dealing of the salts.
    """
    rows = stage(rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), name)
    part = [*keys, "__salt"]
    counts = rows.groupBy(*part).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__salt")) - F.col("__n")
    counts = counts.withColumn("__before", before).where("__before > 0")
    counts = counts.select(*[F.col(c).alias(f"__k_{c}") for c in keys], F.col("__salt").alias("__k_salt"), "__before")
    same = F.col("__salt") == F.col("__k_salt")
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    own = rows.withColumn("__number", F.row_number().over(W.partitionBy(*part).orderBy(F.lit(0))))
    return own.join(counts, same, "left").withColumn("__number", F.col("__number") + F.coalesce("__before", F.lit(0))).drop(*counts.columns, "__salt")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def mix(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    most: float = 2.0,
    quality: DataFrame | None = None,
    seed: str = "mix",
    bucket_docs: int = 4096,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``id``, ``size``, ``source_size``, ``target``, ``taken`` (words), ``copies``, ``source`` and text ``digest`` of every row.

    ``weights`` repeat over the sources in code point order; ``quality`` has ``id`` and ``weight``.
    """
    df = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                     _digest(F.col(text_col)).alias("digest"))
    df = numbered(df, _ROW, "mix-rows")
    if quality is not None:
        one = quality.select(F.col(id_col).alias("id"), "weight").groupBy("id").agg(F.max("weight").alias("weight"))
        df = df.join(one, "id", "left")
    else:
        df = df.withColumn("weight", F.lit(1.0))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0))
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "digest", F.col("__number").cast("string"))
    digits = F.conv(F.substring(F.md5(name), 1, 12), 16, 10)
    u = (digits.cast("double") + 0.5) / F.lit(float(1 << 48))
    df = stage(df.select("id", "source", "digest", "size", (-F.log(u) / weight).alias("key")), "mix")

    by_source = df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = targets(by_source, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("epochs", epochs.cast("long"))
    goal = goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = goal.withColumn("n_buckets", F.ceil(F.col("n_docs") / bucket_docs))
    goal = stage(goal, "mix-targets").withColumnRenamed("source", "s")
    df = df.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    df = df.withColumn("bucket", F.least(
        F.floor((1 - F.exp(-F.col("key"))) * F.col("n_buckets")), F.col("n_buckets") - 1).cast("long"))

    totals = df.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(W.partitionBy("source").orderBy("bucket")) - F.col("total")
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "total", before.alias("before"))
    df = df.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    split = (F.col("before") < F.col("budget")) & (F.col("before") + F.col("total") > F.col("budget"))
    whole = df.where(~split).withColumn("chosen", F.col("before") + F.col("total") <= F.col("budget"))
    # the document on the border is taken if that comes nearer to the budget
    upto = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", "id", "digest").rowsBetween(W.unboundedPreceding, 0))
    parted = df.where(split).withColumn("chosen", 2 * (F.col("before") + upto) - F.col("size") < 2 * F.col("budget"))
    copies = F.col("epochs") + F.col("chosen").cast("long")
    return whole.unionByName(parted).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"),
        "source", "digest")


def repeat_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it, all columns kept.

    Rows are met by id, source and text digest.  Of equal rows the mix may take some once more than others: those rows
    alone are numbered, and the first ones get the further copy, so the words taken are the mix's.
    """
    key = [F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("digest").alias("__digest")]
    counts = mixed.groupBy(*key).agg(F.min("copies").alias("__low"), F.max("copies").alias("__high"), F.sum("copies").alias("__all"), F.count("*").alias("__rows"))
    counts = stage(counts.where("__high > 0"), "mix-counts")
    own = [F.col(id_col), F.col(source_col), _digest(F.col(text_col))]

    def met(which: DataFrame) -> DataFrame:
        same = [a.eqNullSafe(F.col(b)) for a, b in zip(own, ("__id", "__source", "__digest"))]
        return docs.join(which, same[0] & same[1] & same[2])

    out = met(counts.where("__low = __high")).select(*docs.columns, F.col("__low").alias("__copies"))
    parted = counts.where("__low < __high")
    if not parted.isEmpty():
        some = numbered(met(parted), ["__id", "__source", "__digest"], "mix-parted")
        more = F.col("__number") <= F.col("__all") - F.col("__low") * F.col("__rows")
        out = out.unionByName(some.select(*docs.columns, (F.col("__low") + more.cast("long")).alias("__copies")).where("__copies > 0"))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(docs.columns)


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights from the labels: 2 for good documents, 1/2 for bad ones; others count as 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), [3, 1, 2], quality=quality_weights(spark, sf_dir)).drop("copies", "source", "digest")


OP8_SQL = r"""
WITH q AS (
  SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END) AS weight FROM labels GROUP BY 1),
d AS (
  SELECT row_number() OVER () AS r, d.doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(text, '')) AS digest,
    -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' ||
      row_number() OVER (PARTITION BY d.doc_id, source, coalesce(text, ''))), 1, 12))::UBIGINT::DOUBLE + 0.5::DOUBLE)
      / 281474976710656::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS key
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (2 * sum(size))::DOUBLE AS cap,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM s WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER () * w, cap)) AS target FROM l),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (
  SELECT d.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, digest ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN 2 * upto - size < 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""

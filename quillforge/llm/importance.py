"""Importance resampling towards a target: hashed n-gram weights by bit-sliced aggregation, then Gumbel top-k.

Features are runs of one to three words in ``BUCKETS`` hash buckets.  A bucket's gain is the logarithm of the target's share of
it over the corpus' share.  A document's weight, the sum of its features' gains, is taken bit by bit: its bucket
counts become planes of ``BUCKETS`` bits (bit i of every count), each is ANDed with the planes of the positive and of the negative gains,
and set bits add 2^(i + j): whole numbers throughout.  Scores add Gumbel noise that depends on seed and id only, and
the highest are drawn: ranges of scores are sorted by themselves and numbered from the sizes of the ranges before, so no task sees all rows.

Only the ``BUCKETS`` totals and the sizes of the ranges reach the driver.

Edge cases: null texts have no features, weight 0; a null id counts as an empty one in the noise and comes last among ties; repeated rows
have one score and ranks of their own; very long texts are read in slices; an empty table gives no rows, an empty target gives gains against no counts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, stage
from .variants import CRC_SQL, crc_sql

BUCKETS = 10_000
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xFF]+"), re.compile(rb"[^0-9a-z\x80-\xFF]")
_SLICE = 4_000_000  # bytes of a text read at a time
_DOCS = 64  # whose counts are sliced into planes together
_PAD = -(-BUCKETS // 64) * 64


def _slices(raw: bytes):
    """Parts of a text that end between words."""
    begin = 0
    while len(raw) - begin > _SLICE:
        gap = _GAP.search(raw, begin + _SLICE)
        if gap is None:
            break
        yield raw[begin : gap.start()]
        begin = gap.end()
    yield raw[begin:]


def bucket_counts(text: str | None) -> tuple[np.ndarray, int]:
    """How many of a text's features fall in each bucket, and the number of its words."""
    counts, n_words, last = np.zeros(BUCKETS, np.int64), 0, []
    for part in _slices((text or "").encode().lower()):
        found = _WORD.findall(part)
        old, n_words = len(last), n_words + len(found)
        words = last + found
        joined = [b" " + w for w in words]
        one = list(map(crc32, words))
        two = list(map(crc32, joined[1:], one))
        three = list(map(crc32, joined[2:], two))
        # features that end in this part
        hashes = one[old:] + two[max(old - 1, 0) :] + three[max(old - 2, 0) :]
        counts += np.bincount(np.array(hashes, np.int64) % BUCKETS, minlength=BUCKETS)
        last = words[-2:]
    return counts, n_words


def bucket_totals(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of each bucket over all rows: added up in the task, then by bucket; ``BUCKETS`` numbers reach the driver."""

    def run(rows):
        total = np.zeros(BUCKETS, np.int64)
        for batch in rows:
            for text in batch.column(0):
                total += bucket_counts(text.as_py())[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], ["bucket", "n"])

    sums = docs.select(text_col).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of the shares' ratio, with one count added to each bucket."""
    all_corpus, all_target = int(corpus.sum()), int(target.sum())
    ratios = [((t + 1) * (all_corpus + BUCKETS)) / ((s + 1) * (all_target + BUCKETS)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of ``BUCKETS`` bits as 64-bit words."""
    padded = np.zeros((bits.shape[0], _PAD), bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of the positive and then of the negative gains, and what a bit of each is worth."""
    width = max(int(np.abs(gain).max(initial=0)).bit_length(), 1)
    planes = [((sign * gain > 0) & ((np.abs(gain) >> j) & 1 == 1)) for sign in (1, -1) for j in range(width)]
    return _pack(np.stack(planes)), np.array([sign << j if sign > 0 else -(1 << j) for sign in (1, -1) for j in range(width)], np.int64)


def sliced_weights(counts: np.ndarray, planes: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Sum of gains of each row of bucket counts, from set bits alone."""
    weights, i = np.zeros(len(counts), np.int64), 0
    rows = np.arange(len(counts))
    while len(rows):
        plane = _pack((counts[rows] >> i) & 1 == 1)
        set_bits = np.bitwise_count(plane[:, None, :] & planes[None, :, :]).sum(axis=2, dtype=np.int64)
        weights[rows] += (set_bits @ worth) << i
        i += 1
        rows = rows[(counts[rows] >> i).any(axis=1)]
    return weights


def noise(seed: int, name: object) -> int:
    """Gumbel noise in thousandths, from seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_features``, ``n_words``, ``weight`` and ``score`` of every row."""

    def run(rows):
        planes, worth = gain_planes(gain)
        for batch in rows:
            for begin in range(0, len(batch), _DOCS):
                some = batch.slice(begin, _DOCS)
                counted = [bucket_counts(text.as_py()) for text in some.column(1)]
                counts = np.stack([c for c, _ in counted])
                weights = sliced_weights(counts, planes, worth)
                score = weights + np.array([noise(seed, name.as_py()) for name in some.column(0)], np.int64)
                n_words = np.array([n for _, n in counted], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(counts.sum(axis=1)), pa.array(n_words), pa.array(weights), pa.array(score)],
                    [id_col, "n_features", "n_words", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_features bigint, n_words bigint, weight bigint, score bigint")


def draw(rows: DataFrame, percent: int, least_words: int, id_col: str = "doc_id") -> DataFrame:
    """Adds ``rank`` to the ``percent`` of rows with ``least_words`` or more that score highest; ties go to smaller ids."""
    spark = rows.sparkSession
    rows = stage(rows, "scores")
    fit = F.col("n_words") >= least_words
    rows = rows.withColumn("fit", fit).withColumn("row", F.monotonically_increasing_id())
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last(id_col), F.asc("row")]
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = stage(rows.repartitionByRange(n_ranges, *order).withColumn("range", F.spark_partition_id()), "score-ranges")
    sizes = sorted(tuple(r) for r in ranged.where("fit").groupBy("range").count().collect())
    quota = percent * sum(n for _, n in sizes) // 100
    before, starts = 0, {}
    for place, n in sizes:
        if before < quota:
            starts[place] = before
        before += n
    if not starts:
        return ranged.select(id_col, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    drawn = F.col("fit") & F.col("range").isin(list(starts))
    base = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("range")).cast("long")
    number = base + F.row_number().over(W.partitionBy("range").orderBy(*order[1:]))
    top = ranged.where(drawn).withColumn("rank", F.when(number <= quota, number))
    rest = ranged.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).select(id_col, "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_features``, ``weight``, ``score`` and, of the rows drawn, ``rank`` of every row of ``docs``."""
    gain = gains(bucket_totals(docs, text_col), bucket_totals(target, text_col))
    return draw(scored(docs, gain, seed, id_col, text_col), percent, least_words, id_col)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FEATURES = r"""
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM """
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id AS r, {_WORDS} AS w FROM benchmark),
df AS (SELECT r, f, count(*) AS c FROM ({_FEATURES} d) GROUP BY ALL),
bf AS (SELECT f, count(*) AS c FROM ({_FEATURES} b) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT f, ({crc_sql("f")} % {BUCKETS})::INT AS k FROM (SELECT DISTINCT f FROM df UNION SELECT f FROM bf), crcs),
s AS (SELECT k, sum(c) AS s FROM df JOIN hashed USING (f) GROUP BY k),
t AS (SELECT k, sum(c) AS t FROM bf JOIN hashed USING (f) GROUP BY k),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ns, (SELECT coalesce(sum(t), 0) FROM t) AS nt),
g AS (
  SELECT s.k, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ns + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (nt + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (k), n),
w AS (SELECT r, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM df JOIN hashed USING (f) JOIN g USING (k) GROUP BY r),
x AS (
  SELECT d.r, doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) FILTER (fit) OVER () AS n_fit FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * n_fit // 100 THEN place END AS rank FROM ranked
"""

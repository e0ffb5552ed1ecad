"""Exact top-k by inner product over an impact-ordered index, a score level at a time.

Candidates are dealt to blocks.  A block's index holds posting segments in order of quantised impact: for a
level, a dimension and a sign, the vectors with a component of about that size there.  Segments are
processed from the highest impact down for a block of queries: each adds query weight x quantised impact to the
accumulators of its vectors.  Impacts, weights and accumulators are whole numbers, so nothing is
rounded.  For each vector the index also keeps, level by level, the squared length of what the
processed segments leave out of it, quantisation error included; by Cauchy-Schwarz that length times the query's
length bounds how far an accumulator is from the true score.  A query stops only when those bounds
prove that all but ``possible`` vectors of the block lie below its k-th best lower bound (or when no
segment is left); the possible members are rescored exactly.

Queries are a stated set against all rows: both sides are dealt to blocks, and each pair of blocks is
one task's work; a query's block winners are merged by rank.  Work grows with queries times vectors, as
it must for exact scores; rows shuffled are that product over the size of a block.

Edge cases: vectors that are null or hold a null or non-finite component take no part, nor do rows
without an id; a query meets only vectors of its own length, empty ones (all scores 0) included; fewer than k
candidates give fewer rows; ties go to the smaller id; repeated rows of a candidate are candidates each, and a
query skips all rows of its own id; an empty table gives no rows; other columns are ignored.  Products beyond 64
bits are not defined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = 32
_AT_ONCE = 128  # queries whose accumulators are held at a time


class ImpactIndex:
    """Posting segments of integer vectors by descending quantised impact."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        size = np.abs(vectors)
        top = int(size.max(initial=0)) + 1
        # level edges grow with the square, so that a few large components don't coarsen all the others
        level = (levels * np.sqrt(size / top)).astype(np.int64)
        positive = vectors > 0
        left = vectors.astype(np.int64)
        self.levels = []  # (impact, segments, squared length left out of each vector)
        for at in range(int(level.max(initial=0)), -1, -1):
            impact = top * (at**2 + (at + 1) ** 2) // (2 * levels**2)
            segments = []
            if impact:
                inside = (level == at) & (vectors != 0)
                for sign, chosen in ((1, inside & positive), (-1, inside & ~positive)):
                    dims, rows = np.nonzero(chosen.T)
                    cuts = np.flatnonzero(np.diff(dims)) + 1
                    firsts = dims[np.concatenate(([0], cuts))] if len(dims) else []
                    segments += [(int(d), sign, r.astype(np.int32)) for d, r in zip(firsts, np.split(rows, cuts)) if len(r)]
                    left -= chosen * (sign * impact)
            self.levels.append((impact, segments, (left.astype(np.float64) ** 2).sum(axis=1)))
        self.n_postings = int(np.count_nonzero(vectors))

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, possible: int) -> list[np.ndarray]:
        """For each query the rows that may be among its k best, ``own`` rows (a mask) left out."""
        n, m = len(self.vectors), len(queries)
        length = (queries.astype(np.float64) ** 2).sum(axis=1)
        # a sum of impacts and weights that can't pass 31 bits is kept in them
        size = 4.0 * self.vectors.shape[1] * float(np.abs(self.vectors).max(initial=0) + 1) * float(np.abs(queries).max(initial=0) + 1)
        kind = np.int32 if size < 2**31 else np.int64
        score = np.zeros((n, m), kind)
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * m
        live = np.arange(m)
        self.processed = 0  # postings, for each query
        for turn, (impact, segments, rest) in enumerate(self.levels):
            weights = (queries[live].T * impact).astype(kind)
            for dim, sign, rows in segments:
                score[rows] += weights[dim] if sign > 0 else -weights[dim]
                self.processed += len(rows) * len(live)
            last = turn == len(self.levels) - 1
            if not last and (turn < len(self.levels) // 3 or turn % 2 or not segments):
                continue
            # the bound in whole numbers, rounded up
            wide = np.ceil(np.sqrt(rest[:, None] * length[live][None, :]) * (1 + 1e-9)).astype(np.int64)
            hidden = own[live].T
            low = np.where(hidden, np.iinfo(np.int64).min, score - wide)
            edge = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(live), np.iinfo(np.int64).min)
            may = (score + wide >= edge[None, :]) & ~hidden
            done = (may.sum(axis=0) <= possible) | last
            for i in np.flatnonzero(done):
                found[live[i]] = np.flatnonzero(may[:, i])
            live, score = live[~done], score[:, ~done]
            if not len(live):
                break
        return found


def _search(k: int, possible: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(table, rows, width):
        values = table.column("vector").combine_chunks().take(pa.array(rows))
        return np.array(values.flatten()).reshape(len(rows), width).astype(np.int64)

    def widths(table):
        return np.asarray(table.column("vector").combine_chunks().value_lengths())

    def search(left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        sizes, asked = widths(left), widths(right)
        out = []
        for width in np.unique(asked):
            use, ask = np.flatnonzero(sizes == width), np.flatnonzero(asked == width)
            if not len(use):
                continue
            v, q = matrix(left, use, width), matrix(right, ask, width)
            ids = left.column("vec_id").to_numpy()[use]
            names = right.column("query_id").to_numpy()[ask]
            index = ImpactIndex(v)
            for at in range(0, len(q), _AT_ONCE):
                part, name = q[at : at + _AT_ONCE], names[at : at + _AT_ONCE]
                for i, rows in enumerate(index.top(part, name[:, None] == ids[None, :], k, possible)):
                    exact = v[rows] @ part[i]
                    best = np.lexsort((ids[rows], -exact))[:k]
                    out.append((np.full(len(best), name[i]), ids[rows][best], exact[best]))
        if not out:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], schema=schema)

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    possible: int = 1024,
    block_rows: int | None = None,
    query_rows: int = 16_384,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k largest inner products of every query.

    ``vectors`` has ``vec_id`` and integer array ``vector``; ``queries`` has ``query_id`` and ``vector``.  A
    block holds ``block_rows`` vectors: by default a 64th of them, 4,096 at least and 32,768 at most.
    """
    n, m = vectors.count(), queries.count()
    block_rows = block_rows or min(max(n // 64, 4096), 32_768)
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    left = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        _search(k, possible), "query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` = floor(256 x) of every vector whose components are all finite."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("vector"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return top_k(vectors, queries)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)),
r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

import numpy as np
import pytest

from quillforge.llm import topk


def test_index_keeps_all_members_and_stops_on_proof():
    rng = np.random.default_rng(0)
    v = np.rint(rng.standard_t(2, (500, 24)) * 60).astype(np.int64).clip(-3000, 3000)
    index = topk.ImpactIndex(v)
    own = np.zeros((40, 500), bool)
    own[np.arange(40), np.arange(40)] = True
    found = index.top(v[:40], own, 5, 20)
    exact = (v[:40] @ v.T).astype(float)
    exact[own] = -np.inf
    for i, rows in enumerate(found):
        assert set(np.argsort(-exact[i], kind="stable")[:5]) <= set(rows)
    assert min(map(len, found)) < 100


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (None, [1.0, 1.0]),
            (50, [-0.001, 1.0]), (7, [1.0]), (8, []), (50, [-0.001, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert {(r.vec_id, tuple(r.vector)) for r in v.collect()} >= {(50, (-1, 256)), (0, (128, 64))}
    q = v.where("vec_id % 50 = 0").select(v.vec_id.alias("query_id"), "vector")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, q.where("query_id = 0"), k=5).collect()}
    assert got == {(0, 1): (1, 20480), (0, 2): (2, 20480), (0, 3): (50, 16256), (0, 4): (50, 16256)}
    assert topk.top_k(v.limit(0), q).count() == 0 and topk.top_k(v, q.limit(0)).count() == 0


def test_empty_vectors(spark):
    """An empty query meets the other empty vectors, all with score 0; ties go to the smaller id."""
    v = topk.quantised(spark.createDataFrame([(50, []), (1, []), (9, []), (2, [0.5]), (100, [0.5]), (150, [0.1, 0.2])], "vec_id bigint, embedding array<float>"))
    q = v.where("vec_id % 50 = 0").select(v.vec_id.alias("query_id"), "vector")
    got = sorted(tuple(r) for r in topk.top_k(v, q).collect())
    assert got == [(50, 1, 1, 0), (50, 2, 9, 0), (100, 1, 2, 128 * 128)]


def test_bounds_hold_for_wide_and_large_vectors():
    """Whole-number accumulators: no rounding at any width or size."""
    rng = np.random.default_rng(3)
    for width, top in ((1, 5), (700, 1000), (40_000, 3), (64, 2**24)):
        v = rng.integers(-top, top + 1, (60, width))
        index = topk.ImpactIndex(v)
        own = np.eye(60, dtype=bool)[:7]
        exact = v[:7] @ v.T
        for i, rows in enumerate(index.top(v[:7], own, 3, 10)):
            best = [j for j in np.argsort(-exact[i], kind="stable") if j != i][:3]
            assert set(best) <= set(rows)


@pytest.mark.parametrize("block_rows,query_rows", [(100_000, 4096), (60, 3)])
def test_against_brute_force(spark, sf, block_rows, query_rows):
    v = topk.quantised(spark.read.parquet(f"{sf}/embeddings.parquet"))
    q = v.where("vec_id % 50 = 0").select(v.vec_id.alias("query_id"), "vector")
    got = sorted(tuple(r) for r in topk.top_k(v, q, block_rows=block_rows, query_rows=query_rows).collect())
    rows = sorted((r.vec_id, r.vector) for r in v.collect())
    ids, m = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = m @ m[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want += [(int(ids[i]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]
    assert got == sorted(want)

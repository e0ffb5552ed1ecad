import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from quillforge.llm import repeats


def brute(rows, width):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - width + 1):
                k = b[p : p + width]
                first[k] = min(first.get(k, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - width + 1):
                if first[b[p : p + width]] < i:
                    gone[p : p + width] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("args", [{}, {"shard_bytes": 20_000, "bucket_bytes": 30_000}, {"shard_bytes": 5_000, "bucket_bytes": 9_000, "many": 1}])
def test_supplied_documents(spark, sf, sample, args):
    got = repeats.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"), **args).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(zip(sample.doc_id, sample.text)), 50)


@pytest.mark.parametrize("many", [1, 1024])
def test_edges(docs, none, many):
    got = repeats.remove_repeats(docs, shard_bytes=4_000, bucket_bytes=6_000, many=many).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert repeats.remove_repeats(none).count() == 0


def test_periodic_and_common_passages(spark):
    rng = np.random.default_rng(4)
    line = "this very common line stands in nearly every document of the set, word for word. "
    rows = [(i, "".join(rng.choice(list("abc"), 40)) + line * int(rng.integers(0, 3)) + "ab" * int(rng.integers(0, 60))) for i in range(80)]
    rows += [(3, rows[3][1]), (200, "z" * 200), (201, "z" * 120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for many in (2, 1024):
        got = repeats.remove_repeats(docs, shard_bytes=900, bucket_bytes=1_500, many=many).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, 50)


def test_kept_text(spark):
    text = "the same sixty bytes or more stand at the head of both documents here. "
    docs = spark.createDataFrame([(1, text + "one"), (2, text + "two")], "doc_id bigint, text string")
    kept = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(docs, with_text=True).collect()}
    assert kept == {1: (text + "one").encode(), 2: b"two"}


def test_query(spark, sf, sample):
    got = repeats.op10_repeat_removal(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(zip(sample.doc_id, sample.text)), 50)


@pytest.mark.parametrize("letters", ["ab", "abcd", "a", "abcdefghijklmnop"])
def test_longest_previous_factors(letters):
    """Every value, not only whole ones, against the longest prefix shared with a suffix of a smaller id."""
    rng = np.random.default_rng(len(letters))
    for n in (1, 2, 3, 50, 160):
        raw = "".join(rng.choice(list(letters), n + 60)).encode()
        buffer = np.frombuffer(raw + bytes(8), np.uint8)
        at, ids = rng.permutation(n), rng.integers(0, max(1, n // 4), n)
        want = []
        for a, i in zip(at, ids):
            best = 0
            for b, j in zip(at, ids):
                if j < i:
                    k = 0
                    while k < 50 and raw[a + k] == raw[b + k]:
                        k += 1
                    best = max(best, k)
            want.append(best)
        assert repeats.previous_factors(buffer, at, ids, 50).tolist() == want


def test_equal_hashes_of_other_bytes(spark, sf, sample, monkeypatch):
    """Spans and windows whose hashes agree inside a shard are told apart by their bytes."""
    table = pa.table({"id": sample.doc_id[:60], "row": np.arange(60), "text": sample.text[:60]})
    shard = repeats.Shard(table, 50)
    with monkeypatch.context() as m:
        m.setattr(repeats, "_gathered", lambda buffer, at, size: np.zeros(len(at), np.uint64))
        state = pa.table({"bucket": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "state": pa.array([], pa.binary())})
        sent = repeats._send(50, 2)((pa.scalar(0),), table, state)
    covered = sent.filter(pa.compute.equal(sent["kind"], 0)).to_pylist()[0]
    bytes_of = {int(r): t.encode() for r, t in zip(shard.row, [dict(zip(table["row"].to_pylist(), table["text"].to_pylist()))[int(r)] for r in shard.row])}
    seen = {}
    for r, i in zip(shard.row, shard.ids):
        b = bytes_of[int(r)]
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], int(i))
    owner = {int(r): int(i) for r, i in zip(shard.row, shard.ids)}
    for r, a, n in zip(np.frombuffer(covered["rows"], "<i8"), np.frombuffer(covered["bytes"], "<i8"), np.frombuffer(covered["sizes"], "<i4")):
        for p in range(a, a + n):
            assert seen[bytes_of[int(r)][p : p + 50]] < owner[int(r)]


def test_slices_agree(monkeypatch):
    rng = np.random.default_rng(1)
    buffer = np.concatenate([rng.integers(0, 2, 4000, dtype=np.uint8)] * 2 + [np.zeros(8, np.uint8)])
    at, ids = rng.integers(0, 7900, 9000), rng.integers(0, 40, 9000)
    whole = repeats.previous_factors(buffer, at, ids, 50)
    monkeypatch.setattr(repeats, "_STEP", 500)
    sliced = repeats.previous_factors(buffer, at, ids, 50)
    assert (sliced[whole >= 8] == whole[whole >= 8]).all() and (whole == 50).any() and (sliced <= whole).all()

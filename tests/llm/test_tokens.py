import random
import zlib

import numpy as np
import pytest

from quillforge.llm import packing, token_counts, token_files
from quillforge.llm.common import fresh_path
from quillforge.llm.pieces import Pieces, loaded

FILES = [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")]


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name,style", FILES)
def test_pieces_equal_the_library(name, style):
    rng = random.Random(9)
    alphabet = "ab sS'\n\t .,1é!ÉRrEvVlLdmt ×日<|"
    texts = ["", " ", "a  b", "don't I'LL we've", "<|endoftext|>x", "\x85a \x1c b", "it 's 's", "ABC ÀÖ ß"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ids, counts = loaded(name, style).encode(texts)
    ends = np.cumsum(counts)
    want = library(name).encode_batch(texts, add_special_tokens=False)
    for t, w, i, j in zip(texts, want, ends - counts, ends):
        assert w.ids == ids[i:j].tolist(), t


def test_memo_resets_and_crowded_slots(monkeypatch):
    import public_tokenizers

    p = Pieces(public_tokenizers.path("word_bpe_49k.json"), "words")
    p.slot_piece[:] = 0  # every slot taken by another piece
    p.slot_hash[:] = 1
    texts = ["alpha beta gamma", "beta delta"]
    ids, counts = p.encode(texts)
    assert ids.tolist() == [i for e in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert len(p.crowded) == 4
    monkeypatch.setattr("quillforge.llm.pieces._MAX_PIECES", 1)
    assert p.encode(texts)[0].tolist() == ids.tolist()


def test_pieces_with_one_hash_are_told_apart():
    import public_tokenizers

    p = Pieces(public_tokenizers.path("word_bpe_49k.json"), "words")
    texts = ["alpha beta", "", "gamma delta epsilon", "<|x|>", "a-very-long-piece-of-word here"]
    want = [i for e in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert p.encode(texts)[0].tolist() == want
    p.marks[2, : p.n_pieces] += np.uint64(1)  # as if the stored pieces were others of the same hash
    ids, counts = p.encode(texts)
    assert ids.tolist() == want and counts.sum() == len(want) and counts[1] == 0


def thue_morse(n, one, other):
    return "".join((one, other)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("name,style", FILES)
@pytest.mark.parametrize("apart", [False, True])
def test_long_pieces_of_one_hash_and_equal_ends_are_told_apart(name, style, apart):
    import public_tokenizers

    texts = []
    for n in (1024, 4096):
        for x, y, before, after in (("a", "b", "x" * 8, "x" * 8), ("e", "a", "x" * 8, "x" * 8), ("l", "o", "thththth", "erererer")):
            texts += [before + thue_morse(n, *pair) + after for pair in ((x, y), (y, x))]
    p = Pieces(public_tokenizers.path(name), style)
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    for part in ([[t] for t in texts] if apart else [texts]):
        ids, counts = p.encode(part)
        ends = np.cumsum(counts)
        for text, i, j in zip(part, ends - counts, ends):
            assert ids[i:j].tolist() == want[texts.index(text)]


@pytest.mark.parametrize("name,style", FILES)
def test_files_pieces_and_counts_of_such_texts(spark, name, style):
    texts = ["x" * 8 + thue_morse(1024, *pair) + "x" * 8 for pair in ("ea", "ae")] + ["plain words"]
    want = [library(name).encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = token_counts.token_counts(docs, fresh_path(spark, "counts"), name, style).orderBy("doc_id")
    assert [r["n_tokens"] for r in got.collect()] == [len(w) for w in want]
    if style == "words":
        rows = {r["doc_id"]: r["ids_crc32"] for r in packing.token_pieces(docs).collect()}
        assert rows == {i: zlib.crc32(np.array(w + [1], "<u4").tobytes()) for i, w in enumerate(want)}


def test_token_file_query(spark, sf, sample):
    want, start = {}, 0
    for i, ids in sorted(ids_of(sample).items()):
        want[i] = (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: tuple(r) for r in token_files.op4_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_hot_digests_meet_their_count_in_parts(spark, docs):
    plain = sorted(map(str, token_counts.token_counts(docs, fresh_path(spark, "cache")).collect()))
    assert sorted(map(str, token_counts.token_counts(docs, fresh_path(spark, "cache"), key_rows=1).collect())) == plain


def test_counts_query_and_cache(spark, sf, sample):
    want = [len(e.ids) for e in library("word_bpe_49k.json").encode_batch(sample.text.tolist(), add_special_tokens=False)]
    got = {r.doc_id: tuple(r) for r in token_counts.op6_token_counts(spark, sf).collect()}
    assert got == {i: (i, len(t.encode()), n, n > 2048) for i, t, n in zip(sample.doc_id, sample.text, want)}


def test_cache_is_reused_and_only_misses_are_added(spark, docs):
    path = fresh_path(spark, "cache")
    first = sorted(map(str, token_counts.token_counts(docs.where("doc_id < 8"), path).collect()))
    n = spark.read.parquet(path).count()
    assert n == len({(r.text or "").strip() for r in docs.where("doc_id < 8").collect()})
    assert sorted(map(str, token_counts.token_counts(docs.where("doc_id < 8"), path).collect())) == first
    assert spark.read.parquet(path).count() == n
    assert token_counts.token_counts(docs, path).count() == docs.count()
    # a stored count is used as it is
    spark.sql(f"select digest, tokenizer, 999999L as n_tokens from parquet.`{path}`").write.mode("append").parquet(path)
    assert {r.n_tokens for r in token_counts.token_counts(docs, path).collect()} == {999999}


def test_counts_edges(spark, docs, none):
    rows = token_counts.token_counts(docs, fresh_path(spark, "cache")).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() and (by[4].n_bytes, by[4].n_tokens) == (0, 0) and by[6].n_tokens == 0 and by[8].over_limit
    assert token_counts.token_counts(none, fresh_path(spark, "cache")).count() == 0


def ids_of(sample, end=2):
    return {i: e.ids + [end] for i, e in zip(sample.doc_id, library("byte_bpe_50k.json").encode_batch(sample.text.tolist(), add_special_tokens=False))}


def test_files_round_trip(spark, sf, sample):
    want, at = ids_of(sample), 0
    path = fresh_path(spark, "ids")
    token_files.write_ids(spark.read.parquet(f"{sf}/documents.parquet"), path, partition_bytes=100_000, block_chars=20_000)
    got = {r.doc_id: r for r in token_files.read_ids(spark, path).collect()}
    for i in sorted(want):
        crc = zlib.crc32(np.array(want[i], "<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].ids) == (at, len(want[i]), crc, want[i])
        at += len(want[i])
    blocks = spark.read.parquet(path).collect()
    assert len(blocks) > 5 and sum(len(b.symbols) // 2 for b in blocks) < 0.9 * at
    for row in blocks[:4]:
        block = token_files.Block(row.asDict())
        for k, i in enumerate(block.ids):
            assert block.document(k).tolist() == want[i]
            n = len(want[i])
            assert block.document(k, n // 3, n // 2 + 1).tolist() == want[i][n // 3 : n // 2 + 1]


def test_grammar_on_random_ids():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        ids = rng.integers(0, 6, n).astype(np.uint16)
        rules, symbols = token_files.compress(ids, 10, 2, per_round=8)
        sizes = token_files.expansion_lengths(rules, 10)
        assert token_files.expand(symbols, rules, sizes, 10).tolist() == ids.tolist()
    same = np.full(1001, 3, np.uint16)
    rules, symbols = token_files.compress(same, 10, 2)
    assert token_files.expand(symbols, rules, token_files.expansion_lengths(rules, 10), 10).tolist() == same.tolist() and len(symbols) < 300


def test_files_edges(spark, docs, none):
    path = fresh_path(spark, "ids")
    token_files.write_ids(docs, path)
    rows = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count() and rows[0].doc_id is None and {r.doc_id: r.n_tokens for r in rows}[4] == 1
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows][:-1]).tolist()
    empty = fresh_path(spark, "ids")
    token_files.write_ids(none, empty)
    assert token_files.read_ids(spark, empty).count() == 0


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, sf, sample):
    want = [e.ids + [1] for e in library("word_bpe_49k.json").encode_batch(sample.text.tolist(), add_special_tokens=False)]
    rows = packing.op9_best_fit_packing(spark, sf).collect()
    expected = {(i, p, s, len(w[s : s + 4096]), zlib.crc32(np.array(w[s : s + 4096], "<u4").tobytes()))
                for i, w in zip(sample.doc_id, want) for p, s in enumerate(range(0, len(w), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    assert check_packed(rows, 4096) <= -(-sum(map(len, want)) // 4096) + 1


def test_bounds_and_exchange(spark):
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        _, _, fill = packing.best_fit(lengths, 100)
        bound = packing.lower_bound(lengths, 100)
        assert -(-lengths.sum() // 100) <= bound <= len(fill) and fill.max() <= 100 and fill.sum() == lengths.sum()
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3
    df = spark.range(3000).selectExpr("id as doc_id", "cast(1 + pmod(xxhash64(id), 99) as bigint) as length")
    rows = packing.pack(df, 100, part_rows=1000).collect()
    assert len(rows) == 3000
    bound = packing.lower_bound(np.array([r.length for r in rows]), 100)
    assert check_packed(rows, 100) <= 1.02 * bound + 1


def test_packing_edges(docs, none):
    rows = packing.pack(packing.token_pieces(docs)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.length for r in by[4]] == [1] and len(by[7]) == 2 and len(by[8]) > 1 and len(by[None]) == 1
    check_packed(rows, 4096)
    assert packing.pack(packing.token_pieces(none)).count() == 0

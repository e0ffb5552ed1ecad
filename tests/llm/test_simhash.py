import re

import numpy as np
import xxhash

from quillforge.llm import simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_groups(ids, prints, bits=4):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, prints):
        for j, b in zip(ids, prints):
            if i < j and bin(a ^ b).count("1") <= bits:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_position_sets_meet_every_guaranteed_match():
    from itertools import combinations

    for bits in range(1, 7):
        sets = simhash.position_sets(bits)
        for shared in combinations(range(8), 8 - bits):
            assert any(set(s) <= set(shared) for s in sets)
    assert len(simhash.position_sets(4)) == 20


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for s in seeds]))
    ids = list(range(len(fp)))
    want = brute_groups(ids, [int(x) for x in fp])
    parent = list(ids)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in simhash.forest(fp, 4):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in ids} == want


def test_against_brute_force(spark, sf, sample):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash_near_dedup(spark, sf).collect()}
    prints = [brute_print(t) for t in sample.text]
    groups = brute_groups(sample.doc_id.tolist(), prints)
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in zip(sample.doc_id, prints)}


def test_long_lists_in_blocks_lose_no_link(spark, sf):
    prints = simhash.fingerprints(spark.read.parquet(f"{sf}/documents.parquet"))
    nodes = prints.groupBy("fp").agg({"id": "min"}).toDF("fp", "node")
    from quillforge.llm.common import components

    whole = {tuple(r) for r in components(simhash.links(nodes)).collect()}
    parts = {tuple(r) for r in components(simhash.links(nodes, list_rows=1)).collect()}
    assert whole == parts


def test_hot_keys_in_parts_change_nothing(spark, docs):
    texts = spark.range(300).selectExpr("id as doc_id", "if(id % 3 = 0, 'one hot text of a few words', concat('text ', id % 40, ' of some words')) as text")
    for frame in (docs, texts):
        plain = sorted(map(str, simhash.near_duplicates(frame).collect()))
        assert sorted(map(str, simhash.near_duplicates(frame, key_rows=2).collect())) == plain


def test_edges(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    zero = "0" * 16
    assert {by[i][0].fingerprint for i in (4, 5, 6)} == {zero} and {by[i][0].component_id for i in (4, 5, 6)} == {4}
    assert by[2][0].component_id == 1 and len(by[7]) == 2 and by[7][0] == by[7][1]
    assert by[None][0].component_id is None
    assert simhash.near_duplicates(none).count() == 0
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert 2 not in kept and kept.count(7) == 1 and None in kept and 1 in kept
    assert simhash.keep_first(docs).columns == docs.columns

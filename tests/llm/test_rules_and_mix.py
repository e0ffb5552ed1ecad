import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillforge.llm import mixing, quality_rules


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    marked = {i + o for i, w in enumerate(windows) if seen[w] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(marked)


def test_measurements(docs, spark, sf, sample):
    for frame in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        texts = Counter((r.doc_id, r.text) for r in frame.collect())
        got = Counter(tuple(r) for r in quality_rules.ledger(frame).select("doc_id", *quality_rules.MEASURES).collect())
        assert got == Counter({(i, *brute(t)): 0 for i, t in texts}) + Counter((i, *brute(t)) for (i, t), n in texts.items() for _ in range(n))


def test_windows_that_share_a_hash(spark, monkeypatch):
    """Hashes of a few bits: other windows stand between equal ones, and the repeats are the same."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(n))) for i, n in enumerate([0, 2, 3, 4, 60, 300, 900])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    real = F.expr
    monkeypatch.setattr(quality_rules.F, "expr", lambda text: real(text.replace("(xxhash64(__words[i], __words[i + 1], __words[i + 2]) & ~__mask)", "shiftleft(xxhash64(__words[i], __words[i + 1], __words[i + 2]) & 3L, 60)")))
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.ledger(frame).collect()}
    assert got == {i: brute(t)[5] for i, t in rows}


def test_policies_and_ablations(docs, none):
    entries = quality_rules.ledger(docs)
    bits = [r.fail_bits for r in entries.collect()]
    for version, mask in quality_rules.POLICIES.items():
        kept = sum(not b & mask for b in bits)
        for r in quality_rules.ablations(entries, version).collect():
            bit = quality_rules.BIT[r.rule]
            assert r.n_failed == sum(bool(b & bit & mask) for b in bits)
            assert r.kept_without_it == sum(not b & (mask & ~bit) for b in bits) and r.kept_without_it - r.n_failed_alone == kept
    assert quality_rules.ledger(none).count() == 0 and quality_rules.keep_passing(none).count() == 0


def test_keep_passing_keeps_rows_as_they_are(docs):
    kept = quality_rules.keep_passing(docs)
    want = quality_rules.ledger(docs).where("fail_bits = 0").count()
    assert kept.columns == docs.columns and kept.count() == want
    assert {r.n_words for r in kept.collect()} == {"clash"}


@pytest.mark.parametrize("weights,share", [([3, 1, 2], 1.5), ([1], 0.7), ([1, 100], 1.9)])
def test_mix(docs, weights, share):
    rows = mixing.mix(docs, weights, share=share, bucket_docs=2).collect()
    again = mixing.mix(docs, weights, share=share, bucket_docs=1000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    sources = {r.doc_id: r.source for r in docs.collect()}
    total, by = sum(r.size for r in rows), {}
    for r in rows:
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        by.setdefault(sources[r.doc_id], []).append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(share * total)
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v)
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 100, 1), (None, 0, 1)], "source string, source_size bigint, n_docs bigint")
    got = {r.source: r.target for r in mixing.targets(sizes, [3, 1, 2], 1.5, 2.0).collect()}
    assert got["a"] == 20 and got["c"] == 200 and got["b"] == pytest.approx(1.5 * 1110 - 220) and got[None] == 0


def test_weights_prefer(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'s' as source", "'one two' as text")
    weights = docs.selectExpr("doc_id", "if(doc_id < 1000, 4.0D, 0.25D) as weight")
    rows = mixing.mix(docs, [1], share=0.5, quality=weights).collect()
    good = sum(r.taken > 0 for r in rows if r.doc_id < 1000)
    assert good > 850 and abs(sum(r.taken for r in rows) - 2000) <= 2


def test_repeat_rows(docs, none):
    mixed = mixing.mix(docs, [3, 1, 2])
    rows = mixing.repeat_rows(docs, mixed)
    assert rows.columns == docs.columns
    n = Counter((r.doc_id, r.text, r.source) for r in rows.collect())
    sources = {(r.doc_id, mixing_digest(r.text)): (r.text, r.source) for r in docs.collect()}
    want = Counter()
    for r in mixed.collect():
        want[(r.doc_id, *sources[r.doc_id, r.digest])] += r.copies
    assert n == +want
    assert mixing.mix(none, [1]).count() == 0 and mixing.repeat_rows(none, mixing.mix(none, [1])).count() == 0


def mixing_digest(text):
    return hashlib.md5((text or "").encode()).hexdigest()


def test_rows_without_ids_and_repeats_are_single_rows(spark):
    """A third of all rows share one null id, another third one row: each is its own draw, and the words taken are the budget's."""
    docs = spark.range(600).selectExpr(
        "case when id % 3 = 0 then null when id % 3 = 1 then 7L else id end as doc_id", "'s' as source",
        "if(id % 3 = 1, 'five words in a text', concat('w', id, ' and four more here')) as text", "'other' as n")
    mixed = mixing.mix(docs, [1], share=0.5, bucket_docs=20)
    rows = mixed.collect()
    assert sum(r.taken for r in rows) == 1500
    third = [sum(r.copies for r in rows if r.doc_id is None), sum(r.copies for r in rows if r.doc_id == 7)]
    assert all(60 < x < 140 for x in third)
    out = mixing.repeat_rows(docs, mixed)
    assert out.count() == 300 and out.columns == docs.columns and out.where("doc_id = 7").count() == third[1]
    again = mixing.mix(docs.repartition(7), [1], share=0.5, bucket_docs=20).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("query,sql", [(quality_rules.op7_quality_rules, quality_rules.OP7_SQL), (mixing.op8_source_mixing, mixing.OP8_SQL), (quality_rules.rule_ablations, quality_rules.ABLATIONS_SQL)])
def test_against_sql(spark, sf, query, sql):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(sql).df()
    got = query(spark, sf).toPandas()[list(want.columns)]
    by = list(want.columns)
    assert got.sort_values(by).values.tolist() == want.sort_values(by).values.tolist()

import hashlib
import math
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from quillforge.llm import pii
from quillforge.llm.common import components, stage
from quillforge.llm.packing import lower_bound
from test_rules_and_mix import brute as brute_measures
from test_simhash import brute_groups, brute_print
from test_tokens import library


def test_stages(spark, docs, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "personal data", "source mix", "best-fit packing"]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == docs.columns, name
        empty = step(spark, docs.limit(0), sf)
        assert empty.count() == 0 and empty.columns == docs.columns, name


def test_near_duplicates_leave_one_of_each_group(spark, sf, sample):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    groups = brute_groups(sample.doc_id.tolist(), [brute_print(t) for t in sample.text])
    assert kept == set(groups.values())


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1


def mixed_copies(rows, labels):
    """(doc_id, text) -> copies, by the definition: keys in order until the budget, epochs first."""
    weight = {i: {1: 2.0, 0: 0.5}.get(q, 1.0) for i, q in labels}
    by = {}
    for i, text, source in rows:
        by.setdefault(source, []).append((i, text, len(text.split())))
    sources = sorted(by)
    size = {s: sum(n for *_, n in by[s]) for s in sources}
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    total, target, open_ = 1.5 * sum(size.values()), {}, set(sources)
    while open_:
        level = total / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > 2 * size[s]]
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        for s in full:
            target[s], total = 2 * size[s], total - 2 * size[s]
            open_.discard(s)
    copies = Counter()
    for s in sources:
        epochs = int(target[s] // size[s]) if size[s] else 0
        left, upto = target[s] - epochs * size[s], 0

        def key(d):
            name = f"mix:{d[0]}:{hashlib.md5(d[1].encode()).hexdigest()}:1"
            return -math.log((int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / weight.get(d[0], 1.0)

        for i, text, n in sorted(by[s], key=key):
            copies[i, text] = epochs + (2 * upto + n < 2 * left)
            upto += n
    return copies


def test_run_against_brute_force(spark, sf, sample):
    """Every stage by its definition on the whole small table; packing by its pieces and its bound."""
    good = [r for r in sample.itertuples() if quality_fails(r.text) == 0]
    groups = brute_groups([r.doc_id for r in good], [brute_print(r.text) for r in good])
    left = [r for r in good if groups[r.doc_id] == r.doc_id]
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    model = pii.train(frame.join(spark.createDataFrame([(int(r.doc_id),) for r in left], "doc_id bigint"), "doc_id"))
    clean = []
    for r in left:
        base = pii.base_spans(r.text)
        text = r.text
        for k, s, e in sorted(base + model.added(text, base), key=lambda x: (-x[1], x[2])):
            inner = [x for x in base if x[1:] != (s, e) and x[1] <= s and e <= x[2]]
            text = text if inner else text[:s] + f"[{pii.KINDS[k].upper()}]" + text[e:]
        clean.append((r.doc_id, text, r.source))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()
    copies = mixed_copies(clean, labels)
    encode = library("word_bpe_49k.json").encode
    want = Counter()
    for (i, text), n in copies.items():
        ids = encode(text, add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            want[i, p // 4096, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += n
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == +want
    bins, at = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 4096
    assert len(bins) <= lower_bound(np.array([r.length for r in rows]), 4096) + 1


def quality_fails(text):
    n, chars, symbols, lines, twice, repeats = brute_measures(text)
    return sum([n < 50, 100 * repeats > 50 * n, 10 * symbols > 3 * n, 2 * twice > lines, chars < 3 * n, chars > 12 * n])


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(100)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert stage(components(spark.createDataFrame([], "a bigint, b bigint")), "none").count() == 0

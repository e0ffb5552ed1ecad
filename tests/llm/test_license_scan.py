import random
import re
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillforge.llm import license_scan as ls


def brute(text):
    """All windows of all templates, best first, without overlaps."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    grams, found = [f"{a} {b}" for a, b in zip(words, words[1:])], []
    for k, (license, template) in enumerate(ls.TEMPLATES):
        own = Counter(ls.bigrams(template))
        b = sum(own.values())
        for s in range(len(grams)):
            for e in range(s, min(len(grams), s + 2 * b)):
                shared = sum((own & Counter(grams[s:e + 1])).values())
                if 200 * shared >= ls.THRESHOLD * (e - s + 1 + b):
                    found.append((-2.0 * shared / (e - s + 1 + b), -shared, s, e + 1, k, license))
    kept = []
    for x in sorted(found):
        if all(x[3] < y[2] or y[3] < x[2] for y in kept):
            kept.append(x)
    return sorted((x[5], x[4], x[2], x[3], -x[1], -x[0]) for x in kept)


def test_notices_equal_all_windows(spark):
    rng, short = random.Random(5), [t for _, t in ls.TEMPLATES if len(t) < 90]
    filler = "river stone under the public license version of software this work is".split()
    texts = [None, "", "mit", "Licensed under the MIT License licensed under the MIT license", "the license under the license " * 6]
    for _ in range(12):
        words = []
        for _ in range(3):
            words += rng.choices(filler, k=rng.randrange(6)) + [w for w in rng.choice(short).split() if rng.random() < 0.93]
        texts.append(rng.choice([" ", "\n", " -- "]).join(words).upper())
    rows = ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for k, text in enumerate(texts):
        got = sorted((r.license, r.template, r.first_word, r.last_word, r.n_shared, r.dice) for r in rows if r.doc_id == k)
        assert got == brute(text), text
    assert len(rows) > 15


def test_long_notice_across_lines(spark):
    text = dict((len(t), t) for _, t in ls.TEMPLATES)[max(len(t) for _, t in ls.TEMPLATES)]
    broken = "some words " * 3000 + re.sub(r" (\w+) (\w+) ", r" \1\n * \2 ", text) + " more words" * 3000
    got = ls.scan(spark.createDataFrame([(1, broken)], "doc_id int, text string")).collect()
    assert [(r.license, r.first_word, r.dice) for r in got] == [("MIT", 6000, 1.0)]


def test_every_license_line_of_the_table_is_found(spark, sf, sample):
    lines = re.compile(r"^(?:Licensed|Released|This work is licensed) under .*$", re.M)
    want = sum(len(lines.findall(t or "")) for t in sample["text"])
    assert want and entry.queries()["op5_license_scan"](spark, sf).count() >= want


def test_text_with_very_many_notices(spark):
    names = ["Licensed under the MIT License", "Released under the ISC License", "This work is licensed under CC BY-SA 4.0"]
    parts = [f"{names[k % 3]} {'word ' * (k % 4)}" for k in range(20_000)]
    want, at = [], 0
    for k, part in enumerate(parts):
        words = re.findall(r"[^\W_]+", names[k % 3])
        want.append((at, at + len(words) - 1, " ".join(words).lower()))
        at += len(re.findall(r"[^\W_]+", part))
    rows = ls.scan(spark.createDataFrame([(1, "\n".join(parts)), (2, parts[0])], "doc_id int, text string")).collect()
    assert sorted((r.first_word, r.last_word, r.notice) for r in rows if r.doc_id == 1) == want
    assert {r.dice for r in rows} == {1.0} and sum(r.doc_id == 2 for r in rows) == 1


def test_overlaps_that_outlast_the_rounds(spark, monkeypatch):
    templates = [("A", "a b c d e f"), ("B", "d e f g h i"), ("C", "g h i j k l m"), ("D", "k l m n o p q r")]
    monkeypatch.setattr(ls, "TEMPLATES", templates)
    texts = ["a b c d e f g h i j k l m n o p q r", "x a b c d f g h i j k m n o p r", "a b c d e f d e f g h i g h i j k l m"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for rounds in (0, 1, 4):
        monkeypatch.setattr(ls, "ROUNDS", rounds)
        rows = ls.scan(df).collect()
        for k, text in enumerate(texts):
            assert sorted((r.license, r.template, r.first_word, r.last_word, r.n_shared, r.dice) for r in rows if r.doc_id == k) == brute(text), (rounds, text)


def test_no_templates_no_texts_and_clashing_columns(spark, docs, none):
    assert ls.scan(docs, templates=[]).count() == 0 and ls.scan(none).count() == 0
    twice = docs.limit(1).withColumn("text", F.lit("Licensed under the MIT License"))
    assert [r.license for r in ls.scan(twice.unionByName(twice)).collect()] == ["MIT", "MIT"]

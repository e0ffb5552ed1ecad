import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillforge.operators import answer_key as ak
from quillforge.operators import blocks as bl
from quillforge.operators import extract as ex
from quillforge.operators import grading as gr
from quillforge.operators import planning as pl
from quillforge.operators import reconcile as rc
from quillforge.operators import review as rv
from quillforge.operators import runs as rn
from quillforge.operators import windows as wn
from test_text_and_blocks import page

ENGINE = [q for q in entry.oracle_sql() if not q.startswith("op")]


@pytest.fixture(scope="session")
def duck(sf):
    import os

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def canon(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    rows = [tuple("null" if v is None or v is pd.NaT or v != v else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in r) for r in df.itertuples(index=False)]
    return list(df.columns), sorted(rows)


@pytest.mark.parametrize("name", ENGINE)
def test_query_equals_sql(spark, duck, sf, name):
    assert canon(entry.queries()[name](spark, sf).toPandas()) == canon(duck.execute(entry.oracle_sql()[name]).df())


def test_answer_key(spark):
    entries = ak.answer_key_entries(page(spark))
    assert {(r.group, r.ordinal, r.label) for r in entries.collect()} == {(1, 1, "b"), (1, 2, "a")}
    targets = spark.createDataFrame([(1, 1, 1, "e1", "f1"), (1, 1, 2, "e2", "f2")], "doc_id int, group int, ordinal int, exercise_id string, field_id string")
    options = spark.createDataFrame([("e1", "b", "goes"), ("e2", "a", "is")], "exercise_id string, label string, value string")
    good, bad = ak.reconcile_key(targets, entries, options)
    assert {(r.field_id, r.accepted[0]) for r in good.collect()} == {("f1", "goes"), ("f2", "is")} and bad.count() == 0
    twice = entries.unionByName(entries.withColumn("label", F.lit("c")).where("ordinal = 1"))
    good, bad = ak.reconcile_key(targets, twice, options)
    assert [r.entity_id for r in bad.collect()] == ["e1"] and good.count() == 1


@pytest.mark.parametrize("n", [1, 63, 64, 65, 70, 120, 121, 300])
def test_windows_cover(spark, n):
    blocks = spark.range(n).selectExpr("1 as doc_id", "concat('b', id) as block_id", "cast(id as int) as ord", "'x' as raw_text")
    w = wn.window_overlaps(wn.plan_windows(blocks)).orderBy("window").collect()
    assert [(r.first, r.last + 1) for r in w] == [(56 * i, min(n, 56 * i + 64)) for i in range(1 if n <= 64 else 1 + -(-(n - 64) // 56))]
    assert {b for r in w for b in r.block_ids} == {f"b{i}" for i in range(n)}


def test_window_tokens_and_errors(spark):
    blocks = spark.createDataFrame([(1, f"b{i}", i, "x" * 4000) for i in range(4)] + [(2, "big", 0, "x" * 12_001)], "doc_id int, block_id string, ord int, raw_text string")
    assert wn.plan_windows(blocks).where("window = 0").first().tokens == 12_000
    assert [r.code for r in wn.window_errors(blocks).collect()] == ["BLOCK_TOO_LARGE"]


def test_grading_mixed_attempt(spark):
    fields = spark.createDataFrame([(1, 1, "g", "e1", None, "f1", 1, "choice", ["B"]), (1, 1, "g", "e1", None, "f2", 2, "text", ["Is it raining"]), (1, 1, "g", "e1", None, "f3", 3, "text", ["wore"])],
                                   "lesson_id int, lesson_version int, group_id string, exercise_id string, resource_id string, field_id string, ord int, kind string, accepted array<string>")
    options = spark.createDataFrame([("e1", "o1", "A"), ("e1", "o2", "B")], "exercise_id string, option_id string, value string")
    attempts = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 2)], "attempt_id int, lesson_id int, lesson_version int")
    responses = spark.createDataFrame([(1, "f1", "choice", None, "o2", None), (1, "f2", "text", "IS IT RAINING?", None, None), (1, "f3", "text", "wrong", None, None), (2, "fx", "text", "?", None, None)],
                                      "attempt_id int, field_id string, kind string, text string, option_id string, tokens array<string>")
    graded = gr.graded_fields(attempts, fields, responses, options)
    assert {r.field_id: (r.correct, r.shown) for r in graded.where("attempt_id = 1").collect()} == {"f1": (True, None), "f2": (True, None), "f3": (False, ["wore"])}
    assert {r.attempt_id: (r.correct, r.total, r.status) for r in gr.attempt_scores(graded).collect()} == {1: (2, 3, "partial"), 2: (0, 3, "incorrect")}
    rejects = {(r.attempt_id, r.code) for r in gr.attempt_rejects(attempts, fields, responses, options).collect()}
    assert rejects == {(2, "UNKNOWN_FIELD"), (3, "VERSION_MISMATCH")}
    assert gr.attempt_fingerprint(responses).count() == 2


def test_use_once(spark):
    attempts = spark.createDataFrame([(1, 1, 1)], "attempt_id int, lesson_id int, lesson_version int")
    fields = spark.createDataFrame([(1, 1, "g", "r", "f1"), (1, 1, "g", "r", "f2")], "lesson_id int, lesson_version int, group_id string, resource_id string, field_id string")
    responses = spark.createDataFrame([(1, "f1", "o"), (1, "f2", "o")], "attempt_id int, field_id string, option_id string")
    assert [r.code for r in gr.use_once_rejects(attempts, fields, responses).collect()] == ["ENTRY_REUSED"]


def test_report_parts(spark):
    rows = spark.createDataFrame([(1, i, "p" * 20, "<" * 10, True) for i in range(30)], "attempt_id int, ord int, prompt string, answer string, correct boolean")
    parts = gr.report_parts(rows, limit=200).orderBy("part").collect()
    assert all(len(p.body) <= 200 for p in parts) and sum(p.body.count("\n") + 1 for p in parts) == 30 and "&lt;" in parts[0].body


def test_merge_keeps_first_and_names_blocks(spark):
    src = "array<struct<block_id:string,char_start:int,char_end:int>>"
    rows = [(1, "r", 1, "exercisePrompt", 0.9, [("b1", 0, 5)]), (1, "r", 2, "instruction", 0.9, [("b9", 0, 5)]), (1, "r", 3, "exercisePrompt", 0.7, [("b2", 0, 5)])]
    regions = spark.createDataFrame(rows, f"doc_id int, region_id string, seq int, role string, confidence double, sources {src}")
    merged, conflicts = rc.merge_regions(regions)
    m = merged.first()
    assert (m.role, m.confidence, [s.block_id for s in m.sources]) == ("exercisePrompt", 0.7, ["b1", "b2"])
    assert [(c.code, c.block_ids) for c in conflicts.collect()] == [("INCOMPATIBLE_CONTINUATION", ["b1", "b9"])]


def test_reviews(spark):
    fields = spark.createDataFrame([("f1", ["a"], "deterministicRule", "needsReview", 0.5)], "field_id string, accepted array<string>, provenance string, review_status string, confidence double")
    reviews = spark.createDataFrame([("f1", 1, "x"), ("f1", 2, " y "), ("f2", 1, "z"), ("f1", 3, " ")], "field_id string, seq int, value string")
    done, bad = rv.apply_answer_reviews(fields, reviews)
    r = done.first()
    assert (r.accepted, r.provenance, r.review_status, r.confidence, r.before.accepted) == (["y"], "teacherSupplied", "verified", None, ["a"])
    assert {(b.field_id, b.code) for b in bad.collect()} == {("f2", "UNKNOWN_FIELD"), ("f1", "BLANK_VALUE")}


def _batches(exercises, bound=64):
    """First-fit decreasing of groups, exercises kept whole, by plain loops."""
    groups, units, batches = {}, [], []
    for g, x, _, n in sorted(exercises, key=lambda r: r[2]):
        groups.setdefault(g, []).append((x, n))
    for g, xs in groups.items():
        if sum(n for _, n in xs) <= bound:
            units.append([(g, x, 0, n) for x, n in xs])
            continue
        unit = []
        for x, n in xs:
            for first in range(0, n, bound):
                piece = (g, x, first, min(bound, n - first))
                if unit and sum(p[3] for p in unit) + piece[3] > bound:
                    units.append(unit)
                    unit = []
                unit.append(piece)
        units.append(unit)
    for unit in sorted(units, key=lambda u: -sum(p[3] for p in u)):
        size = sum(p[3] for p in unit)
        place = next((b for b in batches if sum(p[3] for p in b) + size <= bound), None)
        if place is None:
            batches.append(place := [])
        place.extend(unit)
    return {frozenset(b) for b in batches}


def test_batches_keep_exercises_whole(spark):
    rng = random.Random(1)
    rows = [(d, f"g{rng.randrange(9)}", f"x{d}:{i}", i, rng.choice([1, 3, 5, 20, 40, 63, 64, 65, 150])) for d in range(8) for i in range(30)]
    got = pl.pack_batches(spark.createDataFrame(rows, "draft_id int, group_id string, exercise_id string, ord int, n_fields int")).collect()
    for d in range(8):
        own = {}
        for r in got:
            if r.draft_id == d:
                own.setdefault(r.batch, set()).add((r.group_id, r.exercise_id, r.first, r.n_fields))
        assert max(sum(p[3] for p in b) for b in own.values()) <= 64
        assert {frozenset(b) for b in own.values()} == _batches([r[1:] for r in rows if r[0] == d])


def test_equal_groups_go_by_appearance(spark):
    rows = [(1, "z", "x1", 1, 40), (1, "a", "x2", 2, 40), (1, "m", "x3", 3, 24)]
    got = pl.pack_batches(spark.createDataFrame(rows, "draft_id int, group_id string, exercise_id string, ord int, n_fields int")).collect()
    batch = {r.group_id: r.batch for r in got}
    assert batch["z"] < batch["a"] and batch["m"] == batch["z"]


def test_redaction(spark):
    df = spark.createDataFrame([(1, '{"a":{"api_key":"k","n":1},"list":[{"password":"p"}]}'), (2, '{"n":1}'), (3, None)], "id int, payload string")
    got = {r.id: r.payload for r in rn.redact(df, "payload").collect()}
    assert got == {1: '{"a":{"api_key":"[REDACTED]","n":1},"list":[{"password":"[REDACTED]"}]}', 2: '{"n":1}', 3: None}
    # keys that hold source, answers or credentials go whole; counts of tokens and contexts stay
    for key in ("sourceContent", "credential", "signedUrl", "storage_url", "evidence", "accepted", "api-key", "refreshToken", "blockText"):
        assert rn.redact(spark.createDataFrame([(f'{{"{key}":{{"x":1}},"n":[2]}}',)], "payload string"), "payload").first()[0] == f'{{"{key}":"[REDACTED]","n":[2]}}'
    for key in ("total_tokens", "context", "tokenUsage", "email"):
        text = f'{{"{key}":5}}'
        assert rn.redact(spark.createDataFrame([(text,)], "payload string"), "payload").first()[0] == text


def test_streams_equal_batch(spark, sf, tmp_path):
    from quillforge.plans import bindings
    from quillforge.streaming import jobs

    texts = bindings.sources(spark, sf).drop("text").join(bindings.exercise_texts(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id").limit(60)
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out/coverage"))
    accepted = spark.read.parquet(str(tmp_path / "out/sources"))
    want = ex.extract_text(accepted)[2]
    assert sorted(map(tuple, stored.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and stored.count() > 20


def test_section_sticky_key(spark):
    kinds = [r.kind for r in bl.classify_sections(page(spark)).orderBy("ord").collect()]
    assert kinds[0] == "instruction" and kinds[-3:] == ["answerKey"] * 3 and "exercise" in kinds

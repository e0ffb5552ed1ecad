"""Answers beyond ASCII, overlap pairs and students' copies on literal rows."""

import random

from pyspark.sql import functions as F

from quillforge.functions import text as tx
from quillforge.operators import blocks as bl
from quillforge.operators import quality as ql
from quillforge.operators import reconcile as rc
from quillforge.operators import review as rv


def test_answers_in_compatibility_form(spark):
    rows = [
        ("ﬁne", ["fine"], True), ("ｄｏ", ["do"], True), ("wore?\t", ["wore"], True), (" wore", ["wore"], True),
        ("  Sat   down 　?! ", ["sat down"], True), ("doesn’t", ["DOES NOT"], True), ("wear", ["wore"], False), (None, ["x"], False),
        ("①", ["1"], True), ("fine", ["ﬁne"], True)]
    df = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(rows)], "i int, t string, a array<string>")
    folded = tx.fold_compatible(df, "t", "a")
    got = {r.i: r.ok for r in folded.select("i", tx.matches_any(F.col("t"), F.col("a")).alias("ok")).collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(rows)}


def test_overlap_pairs_are_all_listed(spark):
    rng = random.Random(5)
    size = 70
    spans = []
    for d in range(40):
        for i in range(9):
            s = rng.randrange(60)
            start, end = (None if rng.random() < 0.2 else s), (None if rng.random() < 0.2 else s + rng.randint(1, 12))
            spans.append((d, f"x{rng.randrange(6)}", f"r{d}:{i}", rng.choice(["b", "c", "gone"]), start, end))
    ex = spark.createDataFrame([(d, e, [r]) for d, e, r, *_ in spans], "doc_id int, exercise_id string, prompt_region_ids array<string>")
    rows = [(d, r, [(b, s, e)]) for d, _, r, b, s, e in spans]
    regions = spark.createDataFrame(rows, "doc_id int, region_id string, sources array<struct<block_id:string,char_start:int,char_end:int>>")
    blocks = spark.createDataFrame([(d, b, "t" * size) for d in range(40) for b in "bc"], "doc_id int, block_id string, raw_text string")
    found = [(r.doc_id, r.owner_id, r.other_id, tuple(r.block_ids)) for r in rc.overlapping_prompts(ex, regions, blocks).collect()]
    want = {}
    full = [(d, x, b, s or 0, size if e is None else e) for d, x, _, b, s, e in spans if b != "gone"]
    for d, x, b, s, e in full:
        for c, y, o, t, f in full:
            if d == c and b == o and x < y and max(s, t) < min(e, f):
                want.setdefault((d, x, y), set()).add(b)
    assert sorted(found) == sorted((*k, tuple(sorted(v))) for k, v in want.items())


def test_whole_block_sources_overlap_each_other_and_instructions(spark):
    regions = spark.createDataFrame(
        [(1, "i", "instruction", [("b", None, None)]), (1, "p", "exercisePrompt", [("b", None, None)]), (1, "q", "exercisePrompt", [("b", 3, None)]), (1, "z", "exercisePrompt", [("c", None, None)])],
        "doc_id int, region_id string, role string, sources array<struct<block_id:string,char_start:int,char_end:int>>")
    ex = spark.createDataFrame([(1, "e", "g", ["p"]), (1, "f", "h", ["q"]), (1, "k", "h", ["z"])], "doc_id int, exercise_id string, group_id string, prompt_region_ids array<string>")
    groups = spark.createDataFrame([(1, "g", ["i"]), (1, "h", [])], "doc_id int, group_id string, region_ids array<string>")
    blocks = spark.createDataFrame([(1, "b", "some text"), (1, "c", "")], "doc_id int, block_id string, raw_text string")
    assert [(r.owner_id, r.other_id) for r in rc.overlapping_prompts(ex, regions, blocks).collect()] == [("e", "f")]
    assert [(r.owner_id, r.block_ids) for r in rc.mixed_instruction(groups, ex, regions, blocks).collect()] == [("g", ["b"])]


def test_blocks_within_half_a_unit_are_one_line(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "right", 0, 350.0, 10.0), (1, 0, "b", 1, 90.0, 10.0), (1, 0, "a", 2, 20.0, 10.4), (1, 0, "c", 3, 10.0, 10.6)],
        "doc_id int, page_index int, raw_text string, ord int, x double, y double")
    pages = spark.createDataFrame([(1, 0, 600.0)], "doc_id int, page_index int, width double")
    got = bl.reading_order(blocks, pages).orderBy("ord").collect()
    assert [r.raw_text for r in got] == ["a", "b", "c", "right"]
    assert [r.block_id for r in got] == [f"page:0:block:{i}" for i in range(4)]


def test_nested_answers_in_a_students_copy_are_found(spark):
    lessons = spark.createDataFrame([("a" * 22,), ("b" * 22,)], "public_lesson_id string")
    exercises = spark.createDataFrame([(1, "e", "shortText", None, [("f", ["x"])])], "doc_id int, exercise_id string, kind string, shared_resource_id string, fields array<struct<field_id:string,accepted:array<string>>>")
    resources = spark.createDataFrame([], "doc_id int, resource_id string")
    got = sorted((r.entity_type, r.entity_id, r.code, r.evidence) for r in ql.student_violations(lessons, exercises, resources).collect())
    assert got == [("exercise", "e", "ANSWER_COLUMN", "fields.accepted")]


def test_created_exercises_keep_answers_and_options(spark):
    exercises = spark.createDataFrame([("g", "g:item:1", 1, "shortText", "p")], "group_id string, exercise_id string, ord int, kind string, prompt string")
    creates = spark.createDataFrame([("g", 1, "singleChoice", " q ", [" a "], ["a", " b ", ""]), ("g", 2, "singleChoice", "r", ["a"], ["a"])],
                                    "group_id string, seq int, kind string, prompt string, answers array<string>, options array<string>")
    out, refused = rv.apply_exercise_creates(exercises, creates)
    rows = {r.exercise_id: r for r in out.collect()}
    assert rows["g:item:2"].answers == ["a"] and rows["g:item:2"].options == ["a", "b"] and rows["g:item:2"].prompt == "q"
    assert rows["g:item:1"].answers is None and refused.count() == 1


def test_option_edits(spark):
    exercises = spark.createDataFrame([("e", "old", ["x", "y"]), ("f", "keep", ["z"])], "exercise_id string, prompt string, options array<string>")
    edits = spark.createDataFrame([("e", 1, "first", None, "d1"), ("e", 2, None, ["p", "q"], "d2")], "exercise_id string, seq int, prompt string, options array<string>, decision_id string")
    got = {r.exercise_id: (r.prompt, r.options, r.decision_id) for r in rv.apply_exercise_edits(exercises, edits).collect()}
    assert got == {"e": ("first", ["p", "q"], "d2"), "f": ("keep", ["z"], None)}


def test_partial_groups_coverage_and_deletes(spark):
    """Leading blocks of a page, not those of a page without headings.  E25: open candidates and additions.  R5: coverage entries."""
    from quillforge.operators import extract as ex
    from quillforge.operators import review as rv

    texts = {1: ["rest of it", "more", "Task 2", "body"], 2: ["no heading"], 3: ["Task 1", "body"], 4: ["lead", "Task 1", "body"]}
    blocks = spark.createDataFrame([(d, f"b{i}", i, t) for d, ts in texts.items() for i, t in enumerate(ts)], "doc_id int, block_id string, ord int, raw_text string")
    seg = ex.segment_articles(blocks, r"^Task (\d+)", r"^Notes", r"^Do ")
    own = spark.createDataFrame([(1, "group:1", "e2", 2), (1, "group:1", "e1", 1), (1, "group:2", "e3", 1)], "doc_id int, group_id string, exercise_id string, ord int")
    issues = ex.partial_group_issues(seg, own)
    assert [tuple(r) for r in issues.orderBy("doc_id").collect()] == [
        (1, "issue:group:1:source-truncated", "SOURCE_TRUNCATED", "blocking", ["group:1", "e1", "e2"], ["b0", "b1"]),
        (4, "issue:group:1:source-truncated", "SOURCE_TRUNCATED", "blocking", ["group:1"], ["b0"])]
    assert ex.partial_group_issues(seg).count() == 2 and ex.partial_group_issues(seg.limit(0)).count() == 0

    docs = spark.createDataFrame([(1, "1. We (go) home. 2. He ran."), (2, "nothing"), (3, None)], "doc_id int, text string")
    items, fields, plain = ex.extract_text(docs)
    assert ex.extraction_issues(items, fields, issues).where("entity_id = 'group:1'").count() == 2
    open_ = spark.createDataFrame([(1, "c1"), (2, "c1"), (2, "c2")], "doc_id int, candidate_id string")
    known = spark.createDataFrame([(1, "group:1:item:1"), (1, "group:1:item:1"), (2, "z")], "doc_id int, exercise_id string")
    rows = lambda df: {r.doc_id: (r.n_items, r.n_detected, r.n_accounted, r.n_additions, r.status) for r in df.collect()}
    assert rows(plain) == {1: (2, 2, 2, 0, "needsReview"), 2: (0, 0, 0, 0, "empty"), 3: (0, 0, 0, 0, "empty")}
    assert rows(ex.extraction_coverage(docs, items, open_, known)) == {1: (2, 2, 2, 1, "needsReview"), 2: (0, 2, 0, 0, "needsReview"), 3: (0, 0, 0, 0, "empty")}

    entries = spark.createDataFrame(
        [("d", "c1", "exercise", ["x1"], None), ("d", "c2", "exercise", ["x2", "x3"], None), ("d", "c3", "issue", ["x1"], None), ("d", "c4", "decision", None, "old"), ("e", "c1", "exercise", ["y"], None)],
        "draft_id string, candidate_id string, kind string, exercise_ids array<string>, decision_id string")
    exercises = spark.createDataFrame([("d", "g", x, i) for i, x in enumerate(["x1", "x2", "x3"])] + [("e", "g", "y", 1)], "draft_id string, group_id string, exercise_id string, ord int")
    deletes = spark.createDataFrame([("d", "x1", "r2"), ("d", "x3", "r3"), ("e", "y", "r4"), ("d", None, "r5")], "draft_id string, exercise_id string, decision_id string")
    left, _, refused = rv.apply_exercise_deletes(exercises, exercises.select("draft_id", "group_id").distinct(), deletes)
    assert sorted((r.draft_id, r.exercise_id, r.ord) for r in left.collect()) == [("d", "x2", 1), ("e", "y", 1)]
    got = rv.coverage_after_deletes(entries, deletes, refused).orderBy("draft_id", "candidate_id").collect()
    assert [tuple(r) for r in got] == [
        ("d", "c1", "decision", None, "r2"), ("d", "c2", "decision", None, "r3"), ("d", "c3", "issue", ["x1"], None), ("d", "c4", "decision", None, "old"), ("e", "c1", "exercise", ["y"], None)]

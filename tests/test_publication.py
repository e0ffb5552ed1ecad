from pyspark.sql import functions as F

from quillforge.operators import assemble, extract as ex, publish as pb, quality as ql, review as rv

B = "doc_id int, block_id string, page_index int, ord int, raw_text string, x double, y double"


def blocks(spark, texts, page=0):
    return spark.createDataFrame([(1, f"b{i}", page, i, t, x, float(10 * i)) for i, (t, x) in enumerate(texts)], B)


HEAD, REF, INS = r"^Exercise\s+(\d+)\s*$", r"^Remember(?:\s|$)", r"^Insert the article\.?$"


def test_articles(spark):
    texts = [("end of the first page.", 50.0), ("Exercise 4", 50.0), ("Insert the article.", 50.0), ("1. I see ... cat. 2. He is", 50.0), ("... doctor. 3. No.", 50.0), ("Remember this", 50.0), ("the sun", 50.0), ("Exercise 5", 50.0), ("1. ... end.", 50.0)]
    seg = ex.segment_articles(blocks(spark, texts), HEAD, REF, INS)
    got = {r.block_id: (r.group, r.role, r.completeness) for r in seg.collect()}
    assert got == {"b0": (3, "body", "partial"), "b2": (4, "instruction", "complete"), "b3": (4, "body", "complete"), "b4": (4, "body", "complete"),
                   "b5": (4, "reference", "complete"), "b6": (4, "reference", "complete"), "b8": (5, "body", "complete")}
    items, pieces = ex.stitch_items(seg)
    assert {(r.group, r.ordinal, r.prompt, r.n_gaps) for r in items.where("group >= 4").collect()} == {
        (4, 1, "I see ... cat.", 1), (4, 2, "He is ... doctor.", 1), (4, 3, "No.", 0), (5, 1, "... end.", 1)}
    two = pieces.where("source_order = 1 and ordinal = 2").orderBy("ord").collect()
    assert [(r.block_id, r.char_start, r.char_end) for r in two] == [("b3", 18, 26), ("b4", 0, 12)]


def test_column_repair(spark):
    pages = spark.createDataFrame([(1, 0, 600.0)], "doc_id int, page_index int, width double")
    texts = [("Exercise 1", 50.0), ("left one", 50.0), ("Exercise 2", 50.0), ("left two", 50.0), ("Right tail.", 350.0), ("goes on here", 350.0)]
    seg = ex.segment_articles(blocks(spark, texts), HEAD, REF, INS)
    got = {r.block_id: r.group for r in ex.repair_columns(seg, pages).collect()}
    assert got == {"b1": 1, "b3": 2, "b4": 1, "b5": 2}


SECTIONS = "section int, heading string, title string"


def test_passages(spark):
    s = spark.createDataFrame([(5, "^5 Read", "^Students$"), (6, "^6 Read", "^My place$")], SECTIONS)
    texts = [("5 Read the text", 50.0), ("6 Read it", 50.0), ("Students", 50.0), ("© book", 50.0), ("They live here.", 50.0)]
    got = {r.section: (r.passage, r.issue, r.completeness) for r in ex.link_passages(blocks(spark, texts), s).collect()}
    assert got == {5: ("They live here.", None, "complete"), 6: (None, "SOURCE_TRUNCATED", "partial")}
    got = {r.section: r.issue for r in ex.link_passages(blocks(spark, texts + [("Students", 50.0)]), s).collect()}
    assert got[5] == "READING_ORDER_UNCERTAIN"


def test_gaps_and_options_between(spark):
    q = blocks(spark, [("1 He lives in ___ town.", 50.0), ("A small B big", 50.0), ("2 Why ____?", 50.0), ("B no", 300.0), ("A yes", 60.0)])
    assert {(r.ordinal, r.char_start, r.char_end) for r in ex.passage_gaps(q).collect()} == {(1, 14, 17), (2, 6, 10)}
    questions = spark.createDataFrame([(1, 0, "q1", 0.0), (1, 0, "q2", 20.0)], "doc_id int, page_index int, question_id string, y double")
    got = [(r.question_id, r.ord, r.label, r.value) for r in ex.options_between(questions, q.where("block_id in ('b1', 'b3', 'b4')")).orderBy("question_id", "ord").collect()]
    assert got == [("q1", 1, "A", "small"), ("q1", 2, "B", "big"), ("q2", 1, "A", "yes"), ("q2", 2, "B", "no")]


def flat(spark):
    groups = spark.createDataFrame([(1, "g1", 1, "Do it.", "complete", None)], "doc_id int, group_id string, ord int, instruction string, completeness string, missing_boundary string")
    exercises = spark.createDataFrame([(1, "g1", "e2", 2, "singleChoice", "p2", "b", None), (1, "g1", "e1", 1, "shortText", "p1", "b", None)],
                                      "doc_id int, group_id string, exercise_id string, ord int, kind string, prompt string, block_id string, shared_resource_id string")
    options = spark.createDataFrame([(1, "e2", "o1", 1, "a"), (1, "e2", "o2", 2, "b")], "doc_id int, exercise_id string, option_id string, ord int, value string")
    fields = spark.createDataFrame([(1, "e1", "f1", 1, ["x"], "sourceKey", "verified", 1.0), (1, "e2", "f2", 1, ["a"], "modelInferred", "needsReview", 0.5)],
                                   "doc_id int, exercise_id string, field_id string, ord int, accepted array<string>, provenance string, review_status string, confidence double")
    return groups, exercises, options, fields


def test_nested_round_trip_and_student_copy(spark):
    groups, exercises, options, fields = flat(spark)
    draft = assemble.assemble_draft(groups, exercises, options, fields)
    assert [e.exercise_id for e in draft.first().groups[0].exercises] == ["e1", "e2"]
    cols = ["doc_id", "exercise_id", "field_id", "ord", "accepted", "provenance", "review_status"]
    assert sorted(map(str, assemble.flatten_fields(draft).select(cols).collect())) == sorted(map(str, fields.select(cols).collect()))
    assert sorted(map(str, assemble.flatten_options(draft).collect())) == sorted(map(str, options.collect()))
    copy = pb.project_student(assemble.flatten_exercises(draft))
    text = copy.schema.simpleString()
    assert not any(word in text for word in ("accepted", "provenance", "review_status", "confidence"))
    assert {r.exercise_id: r.response_kind for r in copy.collect()} == {"e1": "text", "e2": "choice"}


def test_contract_rules(spark):
    groups, exercises, options, fields = flat(spark)
    none = spark.createDataFrame([], "doc_id int, resource_id string, kind string, usage_policy string")
    entries = spark.createDataFrame([], "doc_id int, resource_id string, entry_id string")
    codes = lambda *a, **k: {(r.entity_id, r.code) for r in ql.contract_violations(*a, **k).collect()}
    assert codes(groups, exercises, options, fields, none, entries) == set()
    assert codes(groups, exercises, options, fields, none, entries, published=True) == {("f2", "NOT_VERIFIED"), ("f2", "MODEL_INFERRED")}
    bad = codes(groups.withColumn("completeness", F.lit("partial")), exercises.withColumn("shared_resource_id", F.lit("r")), options.limit(1), fields.unionByName(fields.limit(1)), none, entries)
    assert bad == {("g1", "BOUNDARY_MISMATCH"), ("e1", "RESOURCE_UNEXPECTED"), ("e2", "RESOURCE_UNEXPECTED"), ("e1", "RESOURCE_UNKNOWN"), ("e2", "RESOURCE_UNKNOWN"), ("e2", "TOO_FEW_OPTIONS"), ("f1", "ID_REPEATED")}


def test_gate_and_versions(spark):
    drafts = spark.createDataFrame([("d1", "s1", "l1", False, True, 1), ("d2", "s2", "l2", True, False, 2), ("d3", "s3", "l3", True, True, 3), ("d4", "s1", "l9", False, False, 4)],
                                   "draft_id string, source_id string, lesson_id string, has_matching boolean, confirmed boolean, created_at int")
    issues = spark.createDataFrame([("d2", "blocking", "open"), ("d2", "blocking", "open"), ("d1", "warning", "open")], "draft_id string, severity string, resolution string")
    fields = spark.createDataFrame([("d2", "needsReview"), ("d1", "verified")], "draft_id string, review_status string")
    coverage = spark.createDataFrame([("d2", 1)], "draft_id string, additions int")
    lineage = spark.createDataFrame([("d2", ["UNKNOWN_BLOCK", "UNKNOWN_BLOCK"])], "draft_id string, reasons array<string>")
    reasons = pb.block_reasons(drafts, issues, fields, coverage, lineage)
    assert {r.draft_id: r.reasons for r in reasons.collect()} == {"d1": [], "d3": [], "d4": [], "d2": ["OPEN_BLOCKING_ISSUE", "CONTENT_ADDED", "ANSWER_UNVERIFIED", "UNKNOWN_BLOCK"]}
    versions = spark.createDataFrame([("s1", "l1", 4)], "source_id string, lesson_id string, version int")
    new, latest = pb.publish(drafts, reasons, versions)
    assert {(r.draft_id, r.lesson_id, r.version, r.schema_version) for r in new.collect()} == {("d1", "l1", 5, "1.1.0"), ("d4", "l1", 6, "1.1.0"), ("d3", "l3", 1, "1.2.0")}
    assert {(r.lesson_id, r.draft_id) for r in latest.collect()} == {("l1", "d4"), ("l3", "d3")}


DECISIONS = "review_id string, candidate_id string, submission int, seq int, action string, kind string, outcome string, decision_id string"


def test_layout_decisions(spark):
    reviews = spark.createDataFrame([("r",), ("s",), ("t",), ("u",)], "review_id string")
    cands = spark.createDataFrame([("r", "c1"), ("r", "c2"), ("s", "c3"), ("s", "c4"), ("t", "c5"), ("u", "c6"), ("u", "c7")], "review_id string, candidate_id string")
    dec = spark.createDataFrame(
        [("r", "c1", 1, 1, "classify", "shortText", None, "d1"), ("r", "c1", 1, 2, "exclude", None, None, "d2"), ("r", "c2", 2, 1, "mark", None, "reference", "d3"),
         ("r", "c1", 2, 2, "mark", None, "reference", "d4"), ("r", "cx", 2, 3, "mark", None, "reference", "d5"), ("s", "c3", 1, 1, "exclude", None, None, "d6"),
         ("s", "c4", 2, 1, "exclude", None, None, "d7"), ("t", "c5", 1, 1, "mark", None, "reference", "d8"), ("u", "c6", 1, 1, "classify", "shortText", None, "d9")], DECISIONS)
    good, bad, state = rv.apply_layout_decisions(reviews, cands, dec)
    assert {(r.decision_id, r.code) for r in bad.collect()} == {("d2", "DUPLICATE_DECISION"), ("d4", "ALREADY_DECIDED"), ("d5", "UNKNOWN_CANDIDATE")}
    assert {r.review_id: (r.status, r.code) for r in state.collect()} == {
        "r": ("resolved", None), "s": ("active", "ZERO_VALID_GROUP"), "t": ("active", "ZERO_VALID_GROUP"), "u": ("active", None)}
    assert {r.decision_id for r in good.collect()} == {"d1", "d3", "d6", "d7", "d8", "d9"}


def test_a_resolved_review_becomes_a_draft(spark):
    reviews = spark.createDataFrame([("r",), ("s",)], "review_id string")
    cands = spark.createDataFrame([("r", "c1", "1. Name a   river ."), ("r", "c2", "A table"), ("r", "c3", "page 4"), ("s", "c4", "Pick one")], "review_id string, candidate_id string, raw_prompt string")
    dec = spark.createDataFrame([("r", "c2", 1, 1, "mark", None, "reference", "d1"), ("r", "c1", 2, 1, "classify", "shortText", None, "d2"), ("r", "c3", 2, 2, "exclude", None, None, "d3"),
                                 ("s", "c4", 1, 1, "classify", "singleChoice", None, "d4")], DECISIONS)
    good, _, state = rv.apply_layout_decisions(reviews, cands, dec)
    drafts, issues, bad = rv.layout_drafts(cands, good, state, "Answer.")
    d, = drafts.collect()
    assert d.review_id == "r" and [(x.exercise_id, x.ord, x.prompt, x.decision_id) for x in d.exercises] == [("candidate:c1:exercise", 1, "Name a river.", "d2")]
    assert [(x.block_id, x.ord, x.raw_text, x.decision_id) for x in d.reference_blocks] == [("candidate:c2:reference", 1, "A table", "d1")]
    assert [(x.candidate, x.kind, x.entity_id) for x in d.coverage] == [
        ("candidate:c2", "decision", "d1"), ("candidate:c1", "exercise", "candidate:c1:exercise"), ("candidate:c3", "decision", "d3")]
    assert (d.n_detected, d.n_accounted, d.n_additions) == (3, 3, 0)
    assert [(r.code, r.entity_id) for r in issues.collect()] == [("ANSWER_UNVERIFIED", "candidate:c1:answer:1")]
    assert [(r.review_id, r.candidate_id, r.code) for r in bad.collect()] == [("s", "c4", "TOO_FEW_OPTIONS")]


def test_candidates(spark):
    c = spark.createDataFrame([("c", "singleChoice", "3. He\tgoes\na) by bus\nb) on foot"), ("d", "singleChoice", "Only a stem"), ("e", "shortText", "7) Say why")], "candidate_id string, kind string, raw_prompt string")
    got = {r.candidate_id: (r.prompt, r.options, r.error) for r in rv.candidates_to_exercises(c).collect()}
    assert got == {"c": ("He ___ goes", ["by bus", "on foot"], None), "d": ("Only a stem", [], "TOO_FEW_OPTIONS"), "e": ("Say why", None, None)}

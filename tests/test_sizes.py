"""Odd inputs on which queries differed from their SQL, and steps whose work grew faster than their input."""

import duckdb

from __spark_entry__ import oracle_sql, queries


def _same(spark, tmp_path, name, **tables):
    """The rows of a query over the given tables, which its SQL gives too."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = queries()[name](spark, str(tmp_path))
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()[name]})").fetchall()
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(expected, key=repr)
    return rows


def test_a_single_call_named_by_two_windows_is_owned_twice(spark, tmp_path):
    e = spark.createDataFrame(
        [(1, 1, "purchase", 2.0), (3, 1, "click", 2.0), (4, 2, "click", 1.0), (7, 3, "view", 1.0), (9, 4, "purchase", 1.0), (11, 4, "purchase", 1.0)],
        "event_id long, user_id long, event_type string, value double")
    rows = _same(spark, tmp_path, "g11_manifest_violations", events=e)
    assert {r[0] for r in rows if r[1] == "CALL_OWNED_TWICE"} == {1, 4}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_folded_over_their_heights_not_over_their_items(spark):
    from quillforge.operators import blocks as bl

    items = spark.createDataFrame([("d", 0, i, f"w{i}", float(i), 10.0 * (i // 400) + i % 3, 0.5, 1.0, 0.9) for i in range(800)],
                                  "doc_id string, page_index int, seq int, text string, x double, y double, width double, height double, confidence double")
    pages = spark.createDataFrame([("d", 0, 5000.0)], "doc_id string, page_index int, width double")
    lines = bl.items_to_lines(items, pages)
    assert [(r.line, r["count"]) for r in lines.groupBy("line").count().orderBy("line").collect()] == [(0, 400), (1, 400)]
    assert "arraysort" not in _plan(bl.lines_to_blocks(lines)).lower().replace("_", "")


def test_spans_of_a_text_go_through_one_sort(spark):
    from quillforge.operators import blocks as bl

    docs = spark.createDataFrame([(1, " ab-\nc  d "), (2, "x"), (3, "  "), (4, ""), (5, None)], "doc_id int, text string")
    spans = bl.span_map(docs)
    got = [(r.doc_id, r.piece, r.raw_start, r.raw_end, r.norm_start, r.norm_end) for r in spans.orderBy("doc_id", "piece").collect()]
    assert got == [(1, 1, 0, 1, 0, 0), (1, 2, 1, 3, 0, 2), (1, 3, 3, 5, 2, 2), (1, 4, 5, 6, 2, 3), (1, 5, 6, 8, 3, 4), (1, 6, 8, 9, 4, 5), (1, 7, 9, 10, 5, 5), (2, 1, 0, 1, 0, 1), (3, 1, 0, 2, 0, 0)]
    assert _plan(spans).count("Window [") == 1


def test_overlaps_are_planned_without_a_pass_over_the_spans(spark):
    from quillforge.operators import reconcile as rc

    x = spark.createDataFrame([(1, f"e{i:02}", [f"r{i}"]) for i in range(40)], "doc_id int, exercise_id string, prompt_region_ids array<string>")
    regions = spark.createDataFrame([(1, f"r{i}", [("b", i, i + 2 if i % 2 else 90)]) for i in range(40)],
                                    "doc_id int, region_id string, sources array<struct<block_id:string,char_start:int,char_end:int>>")
    blocks = spark.createDataFrame([(1, "b", "x" * 50)], "doc_id int, block_id string, raw_text string")
    spark.sparkContext.setJobGroup("plan", "plan")
    found = rc.overlapping_prompts(x, regions, blocks)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    span = {f"e{i:02}": (i, i + 2 if i % 2 else 90) for i in range(40)}
    pairs = sorted((a, z) for a in span for z in span if a < z and max(span[a][0], span[z][0]) < min(span[a][1], span[z][1]))
    assert sorted((r.owner_id, r.other_id) for r in found.collect()) == pairs


def test_drafts_compute_their_decisions_twice_at_most(spark):
    from quillforge.operators import review as rv

    c = spark.createDataFrame([(1, 1, "1. Pick ___ one\na) x\nb) y"), (2, 1, "1. Pick ___ one")], "review_id int, candidate_id int, raw_prompt string")
    d = spark.createDataFrame([(r, 1, 1, 1, "classify", "singleChoice", "x", "d") for r in (1, 2)],
                              "review_id int, candidate_id int, submission int, seq int, action string, kind string, outcome string, decision_id string")
    good, _, states = rv.apply_layout_decisions(c.select("review_id").distinct(), c, d)
    drafts, issues, bad = rv.layout_drafts(c, good, states, "Do.")
    assert [r.review_id for r in drafts.collect()] == [1] and [(r.review_id, r.code) for r in bad.collect()] == [(2, "TOO_FEW_OPTIONS")]
    assert _plan(drafts).count("Window [") <= 2


def test_reused_entries_are_counted_over_sorted_rows(spark):
    from quillforge.operators import grading as gr

    attempts = spark.createDataFrame([(a, 1, 1) for a in (1, 2, 3, 4)], "attempt_id int, lesson_id int, lesson_version int")
    fields = spark.createDataFrame([(1, 1, "g", "b", "f1"), (1, 1, "g", "b", "f2"), (1, 1, "h", "b", "f3"), (1, 1, "g", None, "f4")],
                                   "lesson_id int, lesson_version int, group_id string, resource_id string, field_id string")
    given = [(1, "f1", "x"), (1, "f2", "x"), (2, "f1", "x"), (2, "f3", "x"), (3, "f1", "x"), (3, "f4", "x"), (4, "f1", "x"), (4, "f2", "y"), (4, "f2", None), (9, "f1", "x"), (9, "f2", "x")]
    found = gr.use_once_rejects(attempts, fields, spark.createDataFrame(given, "attempt_id int, field_id string, option_id string"))
    assert [tuple(r) for r in found.collect()] == [(1, "ENTRY_REUSED")]
    assert not any("Aggregate [" in line and "option_id" in line for line in _plan(found).splitlines())


def test_orphans_are_found_without_a_sort_of_the_children(spark):
    from quillforge.sources import intake

    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "parent int, id string")
    parent = spark.createDataFrame([(1,), (1,), (None,), (4,)], "key int")
    found = intake.orphan_rows([("edge", child, parent, "parent", "key", "id")])
    assert sorted((r.entity_id, r.missing) for r in found.collect()) == [("c", "2"), ("e", "3")]
    assert "strategy=shuffle_hash" in _plan(found)


def test_batches_are_packed_without_a_join(spark, tmp_path):
    lines = [(o, 10 * o + n, n, float(q), "ANR"[f]) for o, rows in enumerate(
        [[(50, 0), (50, 0), (7, 0), (33, 1)], [(40, 0)], [(41, 0), (39, 1), (1, 2), (1, 1)], [(13, 0), (13, 0), (13, 0), (13, 1), (14, 1)], [(100, 2), (20, 0), (20, 1)]]) for n, (q, f) in enumerate(rows, 1)]
    lines += [(0, 11, 1, 9.0, "A")] + [(8, 5, 1, 12.0, "A"), (8, 5, 1, 9.0, "N"), (8, 6, 2, 30.0, "A"), (8, 7, 3, 25.0, "R"), (8, 8, 4, 20.0, "R")]
    l = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string")
    rows = _same(spark, tmp_path, "g2_batches", lineitem=l)
    assert sum(r[5] for r in rows) == sum(int(q) for *_, q, _ in lines)
    assert "Join" not in _plan(queries()["g2_batches"](spark, str(tmp_path)))


def test_item_prompts_are_cut_in_one_pass(spark, tmp_path):
    texts = ["one two three\nfour five\n\nsix seven ... eight", "a (b) c (d)", "", None, "x y .... z", "no ( bracket\n12 monkeys 2. again"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = _same(spark, tmp_path, "e3_item_prompts", documents=d)
    assert {r[:2]: r[3] for r in rows}[(0, 1)] == 1
    plan = _plan(queries()["e3_item_prompts"](spark, str(tmp_path)))
    assert "Join" not in plan and plan.count("Relation [") == 1


def test_wide_answers_are_folded_and_met_without_python(spark, monkeypatch):
    import unicodedata

    from pyspark.sql import functions as F

    from quillforge.functions import text as tx

    @F.pandas_udf("string")
    def refused(values):
        raise ValueError(f"{len(values)} rows in Python")

    texts = ["plain", "", None, " ｗｉｄｅ　ＴＥＸＴ！\t", "".join(map(chr, range(0xFF01, 0xFF5F))), "a \n"]
    expected = [t and unicodedata.normalize("NFKC", t) for t in texts]
    with monkeypatch.context() as m:
        m.setattr(tx, "_nfkc", refused)
        df = tx.fold_compatible(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
        assert [r.t for r in df.orderBy("i").collect()] == expected
    odd = ["é Ａ", "½", "ﬁn", "ｅ́", "ﾞ", "가"]
    both = tx.fold_compatible(spark.createDataFrame([(i, t, [t, None, "ＡＢ"]) for i, t in enumerate(odd + texts[3:])], "i int, t string, a array<string>"), "t", "a")
    assert [(r.t, r.a) for r in both.orderBy("i").collect()] == [
        (unicodedata.normalize("NFKC", t), [unicodedata.normalize("NFKC", t), None, "AB"]) for t in odd + texts[3:]]
    forms = {"ABC d1": "abc d1", "ab\n": "ab", " a": "a", "a  b": "a b", "It can't?!": "it cannot", "a?": "a", "?": "", "É b": "é b", "x ": "x"}
    rows = spark.createDataFrame([(k, [v, "z"]) for k, v in forms.items()], "t string, a array<string>")
    assert {r.t: r.n for r in rows.select("t", tx.normalize_answer(F.col("t")).alias("n")).collect()} == forms
    assert all(r.m for r in rows.select(tx.matches_any(F.col("t"), F.col("a")).alias("m")).collect())
    assert not any(r.m for r in rows.select(tx.matches_any(F.concat("t", F.lit("q")), F.col("a")).alias("m")).collect())

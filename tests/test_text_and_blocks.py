import pytest
from pyspark.sql import functions as F

from quillforge.functions import text as tx
from quillforge.operators import blocks as bl
from quillforge.operators import extract as ex


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_normalize(spark):
    raw = "Our cat (to\nsleep) near a win-\ndow   "
    assert one(spark, raw, tx.normalize_text) == "Our cat (to sleep) near a window"
    assert one(spark, one(spark, raw, tx.normalize_text), tx.normalize_text) == "Our cat (to sleep) near a window"


def test_span_map(spark):
    raw = "Our cat (to\nsleep) near a win-\ndow"
    docs = spark.createDataFrame([(1, raw)], "doc_id bigint, text string")
    spans = bl.span_map(docs)
    norm = one(spark, raw, tx.normalize_text)
    at = norm.index("window")
    got = bl.map_range(spark.createDataFrame([(1, at, at + 6)], "doc_id bigint, start int, end int"), spans).first()
    assert raw[got.raw_start : got.raw_end] == "win-\ndow"


@pytest.mark.parametrize("a,b,same", [("IS IT RAINING?", "Is it raining", True), ("don’t go!!", "do not go", True), ("He can't", "he cannot", True), ("wore", "wear", False)])
def test_answers(spark, a, b, same):
    df = spark.createDataFrame([(a, [b])], "t string, acc array<string>")
    assert df.select(tx.matches_any(F.col("t"), F.col("acc")).alias("m")).first().m is same


def test_nfkc_only_touches_other_text(spark):
    df = spark.createDataFrame([("ﬁne",), ("plain",), (None,)], "t string")
    assert {r.t for r in tx.fold_compatible(df, "t").collect()} == {"fine", "plain", None}


def test_code_points(spark):
    docs = spark.createDataFrame([(1, "\U0001f600" * 9)], "doc_id bigint, text string")
    assert [len(r.raw_text) for r in bl.chunk_text(docs, 4).orderBy("ord").collect()] == [4, 4, 1]


def layout(spark, rows):
    return spark.createDataFrame([(1, 0, i, t, float(x), float(y), float(w), 10.0, 1.0) for i, (t, x, y, w) in enumerate(rows)],
                                 "doc_id int, page_index int, seq int, text string, x double, y double, width double, height double, confidence double")


def test_lines_and_order(spark):
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id int, page_index int, width double, height double")
    items = layout(spark, [("b", 60, 11, 10), ("a", 50, 10, 8), ("tab", 100, 10, 20), ("z", 400, 10, 10), ("c", 50, 14.5, 10), ("d", 62, 14, 10)])
    blocks = bl.reading_order(bl.lines_to_blocks(bl.items_to_lines(items, pages)), pages).orderBy("ord").collect()
    assert [b.raw_text for b in blocks] == ["a b\ttab", "c d", "z"]
    assert [b.block_id for b in blocks] == ["page:0:block:0", "page:0:block:1", "page:0:block:2"]  # both count from 0


def test_blanks(spark):
    items = layout(spark, [("1 The cat", 50, 10, 60), ("far", 50, 100, 20)])
    rules = spark.createDataFrame([(1, 0, 1, 115.0, 21.0, 50.0, 0.0), (1, 0, 2, 115.0, 21.0, 200.0, 0.0), (1, 0, 3, 115.0, 21.0, 50.0, 2.0)],
                                  "doc_id int, page_index int, rule_id int, x double, top double, width double, drift double")
    added = bl.inject_blanks(items, rules).where("text = '___'").collect()
    assert [(r.x, r.y) for r in added] == [(115.0, 10.0)]


def test_items_fields_truncation(spark):
    text = "Do it.\n1. We (to\nlisten) and (go) home. 7. no 2. He ... fast. 3. They (run away"
    items, fields, coverage = ex.extract_text(spark.createDataFrame([(1, text), (2, None), (3, "no items")], "doc_id bigint, text string"))
    assert [(r.ordinal, r.source_prompt) for r in items.orderBy("ordinal").collect()] == [
        (1, "We (to listen) and (go) home. 7. no"), (2, "He ... fast."), (3, "They (run away")]
    assert [(r.field_id, r.source_value) for r in fields.orderBy("field_id").collect()] == [
        ("group:1:item:1:answer:1", "to listen"), ("group:1:item:1:answer:2", "go"), ("group:1:item:2:answer:1", "...")]
    got = {r.doc_id: (r.n_items, r.n_fields, r.truncated) for r in coverage.collect()}
    assert got == {1: (3, 3, True), 2: (0, 0, False), 3: (0, 0, False)}


PAGE = [
    "1 Choose the best word", "for every gap.", "1 He ___ home.", "a go b goes c going", "2 They ___ here.", "a is b are",
    "2 Put the words in order.", "1 home / go / I", "3 Complete the text.", "1 ___ (be) and 2 ___ (have)",
    "4 Choose the odd one out.", "1 cat\tdog\tcar", "5 Complete with the bank.", "run\twalk  12", "1 I ___ fast.", "2 We ___ far.", "Answer key", "Exercise 1", "1 b 2 a",
]


def page(spark):
    return spark.createDataFrame([(1, f"b{i}", i, t) for i, t in enumerate(PAGE)], "doc_id int, block_id string, ord int, raw_text string")


def test_five_kinds(spark):
    s = ex.slice_groups(page(spark)).cache()
    assert s.where("group = 1").first().instruction == "1 Choose the best word for every gap."
    choice = ex.extract_single_choice(s).orderBy("ordinal").collect()
    assert [(c.ordinal, [o.value for o in c.options]) for c in choice] == [(1, ["go", "goes", "going"]), (2, ["is", "are"])]
    assert ex.extract_word_order(s).first().tokens == ["home", "go", "I"]
    assert [(r.ordinal, r.prompt) for r in ex.extract_bracket_gaps(s).orderBy("ordinal").collect()] == [(1, "(be)"), (2, "(have)")]
    assert ex.extract_odd_one_out(s).first().prompt == "cat | dog | car"
    bank = ex.extract_word_bank(s)
    assert [[o.value for o in r.options] for r in bank.collect()] == [["run", "walk"]] * 2
    items, entries = ex.hoist_shared_resources(bank)
    assert {r.shared_resource_id for r in items.collect()} == {"group:5:bank"} and entries.count() == 2


def test_router_and_fallback(spark):
    blocks = spark.createDataFrame([(1, "b0", 0, "Page 3"), (1, "b1", 1, "1) first"), (1, "b2", 2, "more"), (2, "c0", 0, "Read it"), (2, "c1", 1, "Title")],
                                   "doc_id int, block_id string, ord int, raw_text string")
    templates = spark.createDataFrame([("reading", 1, "^Read it$"), ("reading", 1, "^Title$"), ("other", 2, "^first$")], "template string, priority int, anchor string")
    assert {r.doc_id: r.template for r in ex.route_documents(blocks, templates).collect()} == {1: "generic", 2: "reading"}
    got = {(r.doc_id, r.ord): r.raw_prompt for r in ex.unknown_candidates(blocks).collect()}
    assert got == {(1, 1): "1) first\nmore", (2, 1): "Read it", (2, 2): "Title"}

"""Texts and blocks to exercises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillforge.functions.text import normalize_text, prompt_tokens

MARKER = r"(?:^|(?<=\s))(\d{1,3})([.)])?(?=\s)"
DEFAULT_INSTRUCTION = "Complete the exercise."
NUMBERED = r"^([1-9]\d*)\s+(.+)$"


def _small(patterns: DataFrame, rows: int = 1000) -> DataFrame:
    """A pattern table, broadcast if it has at most ``rows`` rows; Spark chooses the join of a larger one."""
    return F.broadcast(patterns) if patterns.limit(rows + 1).count() <= rows else patterns


def route_documents(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """The template of each document: the one of best priority whose anchors all hit some block, else ``generic``.

    ``templates``: template, priority, anchor; a table of patterns, broadcast while it is small.
    """
    anchors = templates.withColumn("n", F.count("*").over(W.partitionBy("template")))
    hits = blocks.select("doc_id", F.trim("raw_text").alias("t")).join(_small(anchors), F.expr("t rlike anchor"))
    claimed = hits.groupBy("doc_id", "template", "priority", "n").agg(F.count_distinct("anchor").alias("hit")).where("hit = n")
    best = claimed.groupBy("doc_id").agg(F.min_by("template", F.struct("priority", "template")).alias("template"))
    return blocks.select("doc_id").distinct().join(best, "doc_id", "left").withColumn("template", F.coalesce("template", F.lit("generic")))


def segment_items(docs: DataFrame, column: str = "text") -> DataFrame:
    """Normalized text ``n`` and the item boundaries: number markers that go on 1, 2, 3, ...

    Marker positions are running sums over the parts between markers; the sequence is a fold.
    """
    df = docs.withColumn("n", normalize_text(F.col(column)))
    marks, parts = F.regexp_extract_all("n", F.lit(MARKER), F.lit(0)), F.split("n", MARKER, -1)
    df = df.withColumn("marks", F.filter(F.zip_with(marks, parts, lambda m, p: F.struct(
        m.alias("mark"), F.length(p).alias("skip"), F.regexp_extract(m, r"\d+", 0).cast("int").alias("ordinal"))), lambda x: x["mark"].isNotNull()))
    fold = F.aggregate(
        "marks", F.expr("named_struct('at', 0, 'items', cast(array() as array<struct<ordinal:int,start:int,content:int>>))"),
        lambda acc, m: F.struct(
            (acc["at"] + m["skip"] + F.length(m["mark"])).alias("at"),
            F.when(m["ordinal"] == F.size(acc["items"]) + 1, F.concat(acc["items"], F.array(F.struct(
                m["ordinal"].alias("ordinal"), (acc["at"] + m["skip"]).alias("start"),
                (acc["at"] + m["skip"] + F.length(m["mark"])).alias("content"))))).otherwise(acc["items"]).alias("items")),
        lambda acc: acc["items"])
    return df.withColumn("items", fold).drop("marks")


def item_prompts(segmented: DataFrame) -> DataFrame:
    """One row an item: ordinal, prompt with its span in the normalized text, and the group instruction."""
    head = F.trim(F.substring("n", F.lit(1), F.get("items", F.lit(0))["start"]))
    df = segmented.withColumn("instruction", F.when(head != "", head).otherwise(F.lit(DEFAULT_INSTRUCTION)))
    # outer, so that no filter on the fold is inferred below it and the fold runs once
    df = df.select("doc_id", "n", "items", "instruction", F.posexplode_outer("items").alias("i", "item")).where("i is not null")
    stop = F.coalesce(F.get("items", F.col("i") + 1)["start"], F.length("n"))
    raw = F.substring(F.col("n"), F.col("item.content") + 1, stop - F.col("item.content"))
    start = F.col("item.content") + F.length(raw) - F.length(F.ltrim(raw))
    prompt = F.trim(raw)
    return df.select(
        "doc_id", F.concat(F.lit("group:1:item:"), F.col("item.ordinal")).alias("exercise_id"), F.col("item.ordinal").alias("ordinal"),
        "instruction", prompt.alias("source_prompt"), start.alias("start"), (start + F.length(prompt)).alias("end"),
        (F.col("i") == F.size("items") - 1).alias("is_last"))


def _positions(col: Column, pattern: str) -> Column:
    """Start, text and all spans of the matches of a pattern, as an array of structs."""
    found, parts = F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), F.split(col, pattern, -1)
    return F.aggregate(
        F.filter(F.zip_with(found, parts, lambda m, p: F.struct(m.alias("m"), F.length(p).alias("skip"))), lambda x: x["m"].isNotNull()),
        F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,value:string>>))"),
        lambda acc, x: F.struct((acc["at"] + x["skip"] + F.length(x["m"])).alias("at"), F.concat(
            acc["out"], F.array(F.struct((acc["at"] + x["skip"]).alias("start"), x["m"].alias("value")))).alias("out")),
        lambda acc: acc["out"])


def count_markers(col: Column) -> Column:
    """How many answer fields a prompt has."""
    brackets = F.regexp_count(col, F.lit(r"\([^)]+\)"))
    return F.when(brackets > 0, brackets).otherwise(F.regexp_count(col, F.lit(r"\.{3,}")))


def answer_markers(items: DataFrame) -> DataFrame:
    """Answer fields of each item: all brackets, or else the runs of three or more dots."""
    bracket = F.col("source_prompt").rlike(r"\([^)]+\)")
    found = F.when(bracket, _positions(F.col("source_prompt"), r"\([^)]+\)")).otherwise(_positions(F.col("source_prompt"), r"\.{3,}"))
    df = items.withColumn("marker_kind", F.when(bracket, "bracket").otherwise("ellipsis"))
    df = df.select("doc_id", "exercise_id", "start", "marker_kind", F.posexplode_outer(found).alias("i", "m")).where("i is not null")
    value = F.when(F.col("marker_kind") == "bracket", F.trim(F.expr("substring(m.value, 2, length(m.value) - 2)"))).otherwise(F.col("m.value"))
    return df.select(
        "doc_id", "exercise_id", F.concat("exercise_id", F.lit(":answer:"), F.col("i") + 1).alias("field_id"), (F.col("i") + 1).alias("ord"),
        "marker_kind", value.alias("source_value"), (F.col("start") + F.col("m.start")).alias("char_start"),
        (F.col("start") + F.col("m.start") + F.length("m.value")).alias("char_end"))


def shown_prompt(items: DataFrame) -> DataFrame:
    """The prompt as shown: ellipses of an item without brackets become ``___``."""
    dots = ~F.col("source_prompt").rlike(r"\([^)]+\)")
    return items.withColumn("prompt", F.when(dots, F.regexp_replace("source_prompt", r"\.{3,}", "___")).otherwise(F.col("source_prompt")))


def is_truncated(col: Column) -> Column:
    """E5: unbalanced brackets, or no closing mark; blank text is not truncated."""
    t = F.trim(col)
    unbalanced = (F.regexp_count(t, F.lit(r"\(")) != F.regexp_count(t, F.lit(r"\)"))) | (F.regexp_count(t, F.lit(r"\[")) != F.regexp_count(t, F.lit(r"\]")))
    return (t != "") & (unbalanced | ~t.rlike("[.!?…][\"'»)]?$"))


def flag_truncated(items: DataFrame) -> DataFrame:
    """E5: whether the last item of a document breaks off."""
    return items.withColumn("truncated", F.col("is_last") & is_truncated(F.col("source_prompt")))


def slice_groups(blocks: DataFrame) -> DataFrame:
    """Blocks of numbered instruction groups 1-5, with the group's instruction.

    A group runs from its heading to the next heading or answer key.  While the instruction has no closing mark,
    blocks without a number right after the heading belong to it.
    """
    text = F.trim("raw_text")
    df = blocks.withColumn("t", text).withColumn("head", F.when(text.rlike(r"(?i)^[1-5]\s+(choose|put|complete)\b"), F.substring(text, 1, 1).cast("int")))
    df = df.withColumn("stop", text.rlike(r"(?i)^answer\s*key\b") & F.col("head").isNull())
    order = W.partitionBy("doc_id").orderBy("ord")
    df = df.withColumn("slice", F.sum(F.when(F.col("head").isNotNull() | F.col("stop"), 1).otherwise(0)).over(order))
    inside = W.partitionBy("doc_id", "slice").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("doc_id", "slice").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("group", F.max("head").over(inside)).where("group is not null and not stop")
    closed = F.max(F.col("t").rlike(r"[.!?)]$")).over(before)
    numbered = F.max(F.col("head").isNull() & F.col("t").rlike(r"^[1-9]\d*\s+")).over(inside)
    df = df.withColumn("part", F.col("head").isNotNull() | ~(F.coalesce(closed, F.lit(False)) | numbered))
    # a block after the instruction has ended is never instruction again
    df = df.withColumn("part", F.min("part").over(inside))
    whole = W.partitionBy("doc_id", "slice")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part"), F.struct("ord", "t"))).over(whole)), lambda x: x["t"]), " ")
    return df.withColumn("instruction", words).drop("t", "head", "stop")


def _numbered(slices: DataFrame, group: int | None = None) -> DataFrame:
    df = slices.where("not part").withColumn("t", F.trim("raw_text"))
    df = df.withColumn("ordinal", F.nullif(F.regexp_extract("t", NUMBERED, 1), F.lit("")).cast("int")).withColumn("body", F.regexp_extract("t", NUMBERED, 2))
    return df if group is None else df.where(F.col("group") == group)


def _exercise(df: DataFrame, kind: str, prompt: Column) -> DataFrame:
    return df.select(
        "doc_id", "group", F.concat(F.lit("group:"), "group", F.lit(":item:"), "ordinal").alias("exercise_id"), "ordinal",
        F.lit(kind).alias("kind"), prompt.alias("prompt"), "block_id", "ord", *[c for c in ("options",) if c in df.columns])


def parse_options(col: Column) -> Column:
    """Labelled options ``a x b y`` as an array of (label, value)."""
    text = F.trim(F.translate(col, "\t", " "))
    pattern = r"(?i)(?:^|\s)([a-z])\s+(.+?)(?=\s+[a-z]\s+|$)"
    labels, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(labels, values, lambda a, b: F.struct(a.alias("label"), F.trim(b).alias("value")))


def extract_single_choice(slices: DataFrame, group: int = 1) -> DataFrame:
    """A numbered prompt with a gap, followed by a block of two or more options; that block is used up.

    A block is a prompt unless the prompt before it used it; runs of adjacent candidates alternate.
    """
    order = W.partitionBy("doc_id", "slice").orderBy("ord")
    df = _numbered(slices, group)
    df = df.withColumn("options", parse_options(F.lead("raw_text").over(order)))
    able = F.col("body").rlike("_{3,}") & (F.size("options") >= 2)
    df = df.withColumn("able", F.coalesce(able, F.lit(False)))
    run = F.sum((~F.col("able")).cast("int")).over(order)
    df = df.withColumn("run", run)
    place = F.sum(F.col("able").cast("int")).over(W.partitionBy("doc_id", "slice", "run").orderBy("ord"))
    return _exercise(df.withColumn("place", place).where("able and place % 2 = 1"), "singleChoice", F.col("body"))


def extract_word_order(slices: DataFrame, group: int = 2) -> DataFrame:
    """Numbered lines with slashes, and their tokens."""
    return _exercise(_numbered(slices, group).where("contains(body, '/')"), "wordOrder", F.col("body")).withColumn("tokens", prompt_tokens(F.col("prompt")))


def extract_bracket_gaps(slices: DataFrame, group: int = 3) -> DataFrame:
    """Every ``n ___ (verb)`` inside the blocks."""
    pattern = r"([1-9]\d*)\s*_{3,}\s*\(([^)]+)\)"
    df = slices.where("not part").where(F.col("group") == group)
    pairs = F.zip_with(
        F.regexp_extract_all("raw_text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("raw_text", F.lit(pattern), F.lit(2)),
        lambda n, v: F.struct(n.cast("int").alias("ordinal"), F.trim(v).alias("verb")))
    return _exercise(df.select("*", F.inline(pairs)), "bracketGap", F.concat(F.lit("("), "verb", F.lit(")")))


def extract_odd_one_out(slices: DataFrame, group: int = 4) -> DataFrame:
    """Numbered tab-separated values, three or more."""
    df = slices.where("not part").where(F.col("group") == group).withColumn("cols", F.split(F.trim("raw_text"), r"\t+"))
    df = df.withColumn("ordinal", F.nullif(F.regexp_extract(F.col("cols")[0], NUMBERED, 1), F.lit("")).cast("int")).where("ordinal is not null")
    values = F.filter(F.transform(F.concat(F.array(F.regexp_extract(F.col("cols")[0], NUMBERED, 2)), F.slice("cols", 2, F.greatest(F.size("cols") - 1, F.lit(0)))), lambda t: F.trim(t)), lambda v: v != "")
    df = df.withColumn("values", values).where(F.size("values") >= 3)
    df = df.withColumn("options", F.transform("values", lambda v, i: F.struct((i + 1).cast("string").alias("label"), v.alias("value"))))
    return _exercise(df, "oddOneOut", F.array_join("values", " | "))


def extract_word_bank(slices: DataFrame, group: int = 5) -> DataFrame:
    """Gap items after the first numbered block; what stands before it is the bank."""
    df = _numbered(slices, group)
    first = F.min(F.when(F.col("t").rlike(r"^[1-9]\d*\s+"), F.col("ord"))).over(W.partitionBy("doc_id", "slice"))
    df = df.withColumn("first", first).where("first is not null")
    words = df.where("ord < first").select("doc_id", "slice", "ord", F.posexplode(F.split("t", r"\t+|\s{2,}")).alias("i", "v"))
    words = words.withColumn("v", F.trim("v")).where((F.col("v") != "") & ~F.col("v").rlike(r"^/?\d+$"))
    bank = words.groupBy("doc_id", "slice").agg(F.array_sort(F.collect_list(F.struct("ord", "i", "v"))).alias("bank"))
    items = df.where("ord >= first").where(F.col("ordinal").isNotNull() & F.col("body").rlike("_{3,}")).join(bank, ["doc_id", "slice"], "left")
    options = F.transform(F.coalesce("bank", F.expr("cast(array() as array<struct<ord:int,i:int,v:string>>)")), lambda b, i: F.struct((i + 1).cast("string").alias("label"), b["v"].alias("value")))
    return _exercise(items.withColumn("options", options), "wordBankGap", F.col("body"))


def hoist_shared_resources(exercises: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The options of a group's bank items become one shared resource; the items keep its id."""
    shared = F.concat(F.lit("group:"), "group", F.lit(":bank"))
    bank = exercises.where("kind = 'wordBankGap'").groupBy("doc_id", "group").agg(F.min_by("options", "ord").alias("options"))
    entries = bank.select("doc_id", shared.alias("resource_id"), F.posexplode("options").alias("i", "o")).select(
        "doc_id", "resource_id", F.concat("resource_id", F.lit(":"), F.col("i") + 1).alias("entry_id"), (F.col("i") + 1).alias("ord"), F.col("o.value").alias("value"))
    is_bank = F.col("kind") == "wordBankGap"
    return exercises.withColumn("shared_resource_id", F.when(is_bank, shared)).withColumn(
        "options", F.when(~is_bank, F.col("options"))), entries


def segment_articles(blocks: DataFrame, heading: str, reference: str, instruction: str, running: str | None = None) -> DataFrame:
    """Blocks of headed exercises: group, role (instruction, body, reference), completeness.

    Text before the first heading is a partial group numbered one less; a reference heading opens a
    reference until the next exercise heading; running headers are dropped.
    """
    df = blocks.withColumn("t", F.trim("raw_text"))
    df = df.where(~F.col("t").rlike(running)) if running else df
    df = df.withColumn("head", F.nullif(F.regexp_extract("t", heading, 1), F.lit("")).cast("int"))
    order = W.partitionBy("doc_id").orderBy("ord")
    df = df.withColumn("source_order", F.sum(F.col("head").isNotNull().cast("int")).over(order))
    first = F.min_by("head", F.when(F.col("head").isNotNull(), F.col("ord"))).over(W.partitionBy("doc_id"))
    df = df.withColumn("group", F.coalesce(F.last("head", ignorenulls=True).over(order), first - 1))
    inside = W.partitionBy("doc_id", "source_order").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    refers = F.max(F.col("t").rlike(reference)).over(inside)
    role = F.when(F.col("head").isNotNull(), "heading").when(refers, "reference").when(F.col("t").rlike(instruction), "instruction").otherwise("body")
    return df.withColumn("role", role).withColumn("completeness", F.when(F.col("source_order") == 0, "partial").otherwise("complete")).withColumn(
        "missing_boundary", F.when(F.col("source_order") == 0, "start")).where("head is null").drop("t", "head")


def repair_columns(segmented: DataFrame, pages: DataFrame) -> DataFrame:
    """A run on the right half that begins with a capital, after left-half blocks of its group, up to a
    sentence end followed by a lower-case start, belongs to the group before."""
    df = segmented.join(pages.select("doc_id", "page_index", F.col("width").alias("__w")), ["doc_id", "page_index"], "left")
    order = W.partitionBy("doc_id", "source_order").orderBy("ord")
    df = df.withColumn("__right", F.col("x") >= F.col("__w") / 2).withColumn("__t", F.trim("raw_text"))
    crosses = F.col("__right") & ~F.coalesce(F.lag("__right").over(order), F.col("__right")) & F.col("__t").rlike(r"^\p{Lu}")
    df = df.withColumn("__from", F.min(F.when(crosses, F.col("ord"))).over(W.partitionBy("doc_id", "source_order")))
    ends = F.col("__right") & F.lag("__t").over(order).rlike(r"[.!?]$") & F.col("__t").rlike(r"^\p{Ll}") & (F.col("ord") > F.col("__from"))
    df = df.withColumn("__to", F.min(F.when(ends, F.col("ord"))).over(W.partitionBy("doc_id", "source_order")))
    moved = F.coalesce((F.col("ord") >= F.col("__from")) & (F.col("ord") < F.col("__to")) & (F.col("source_order") > 0), F.lit(False))
    return df.withColumn("group", F.when(moved, F.col("group") - 1).otherwise(F.col("group"))).withColumn(
        "source_order", F.when(moved, F.col("source_order") - 1).otherwise(F.col("source_order"))).drop("__w", "__right", "__t", "__from", "__to")


def stitch_items(segmented: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items ``n. ...`` and ellipsis gaps over a group's joined blocks, mapped back to the blocks.

    Returns (items, pieces): pieces are the block spans each item overlaps, by an interval join on the group.
    """
    key = ["doc_id", "source_order"]
    body = segmented.where("role = 'body'").withColumn("t", F.trim("raw_text"))
    order = W.partitionBy(*key).orderBy("ord")
    end = F.sum(F.length("t") + 1).over(order) - 1
    spans = body.withColumn("to", end).withColumn("from", end - F.length("t")).select(*key, "group", "block_id", "ord", "t", "from", "to")
    joined = spans.groupBy(*key, "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), " ").alias("text"))
    starts = F.filter(_positions(F.col("text"), r"(?:^|(?<=\s))\d{1,3}\.\s"), lambda s: s["start"].isNotNull())
    items = joined.withColumn("starts", starts).select(*key, "group", "text", "starts", F.posexplode("starts").alias("i", "s"))
    stop = F.coalesce(F.get("starts", F.col("i") + 1)["start"], F.length("text"))
    content = F.col("s.start") + F.length("s.value")
    prompt = F.trim(F.substring(F.col("text"), content + 1, stop - content))
    items = items.select(
        *key, "group", F.regexp_extract("s.value", r"\d+", 0).cast("int").alias("ordinal"), F.col("s.start").alias("item_start"), stop.alias("item_end"),
        prompt.alias("prompt"), F.regexp_count(prompt, F.lit(r"\.{3,}")).alias("n_gaps"))
    pieces = items.select(*key, "ordinal", "item_start", "item_end").join(spans.drop("group", "t"), key).where("from < item_end and to > item_start")
    return items, pieces.select(*key, "ordinal", "block_id", "ord", F.greatest(F.col("item_start") - F.col("from"), F.lit(0)).alias("char_start"),
                                F.least(F.col("item_end"), F.col("to")).alias("__e"), "from").withColumn("char_end", F.col("__e") - F.col("from")).drop("__e", "from")


def link_passages(blocks: DataFrame, sections: DataFrame, boilerplate: str = r"^©") -> DataFrame:
    """For each question section, its passage and the outcome.

    ``sections`` (broadcast while it is small): section, heading, title.  A passage runs from its title to the
    end of the page.  No passage makes the section partial (SOURCE_TRUNCATED); several link nothing
    (READING_ORDER_UNCERTAIN).
    """
    df, sections = blocks.withColumn("t", F.trim("raw_text")), _small(sections)
    heads = df.join(sections, F.expr("t rlike heading")).select("doc_id", "section", F.col("ord").alias("heading_ord")).dropDuplicates(["doc_id", "section"])
    titles = df.join(sections, F.expr("t rlike title")).select("doc_id", "section", F.col("page_index").alias("p"), F.col("ord").alias("title_ord"))
    found = titles.groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.min("p").alias("p"), F.min("title_ord").alias("title_ord"))
    lines = df.where(~F.col("t").rlike(boilerplate)).select("doc_id", "page_index", "ord", "t")
    body = found.where("n = 1").join(lines, "doc_id").where("page_index = p and ord > title_ord")
    passages = body.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "\n").alias("passage"))
    out = heads.join(found.select("doc_id", "section", "n"), ["doc_id", "section"], "left").join(passages, ["doc_id", "section"], "left")
    issue = F.when(F.coalesce("n", F.lit(0)) == 0, "SOURCE_TRUNCATED").when(F.col("n") > 1, "READING_ORDER_UNCERTAIN")
    return out.select("doc_id", "section", "heading_ord", "passage", issue.alias("issue"), F.when(F.coalesce("n", F.lit(0)) == 0, "partial").otherwise("complete").alias("completeness"))


def passage_gaps(blocks: DataFrame) -> DataFrame:
    """Gap questions: the span of the first underscore run of a numbered block."""
    t = F.trim("raw_text")
    df = blocks.where(t.rlike(r"^[1-9]\d*\s+.*_{2,}")).withColumn("t", t)
    start = F.regexp_instr("t", F.lit("_{2,}")) - 1
    return df.select("doc_id", "block_id", F.regexp_extract("t", r"^(\d+)", 1).cast("int").alias("ordinal"), start.alias("char_start"),
                     (start + F.length(F.regexp_extract("t", "_{2,}", 0))).alias("char_end"))


def options_between(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """A/B options that stand below a question and above the next one on the page, by x, then label.

    A join on the page with a vertical interval.
    """
    order = W.partitionBy("doc_id", "page_index").orderBy("y")
    spans = questions.withColumn("y_end", F.coalesce(F.lead("y").over(order), F.lit(float("inf")))).select("doc_id", "page_index", "question_id", F.col("y").alias("y_start"), "y_end")
    labelled = blocks.withColumn("o", F.explode(parse_options(F.col("raw_text")))).where(F.upper("o.label").isin("A", "B"))
    met = spans.join(labelled, ["doc_id", "page_index"]).where("y > y_start and y < y_end")
    n = F.row_number().over(W.partitionBy("doc_id", "page_index", "question_id").orderBy("x", F.upper("o.label")))
    return met.select("doc_id", "page_index", "question_id", n.alias("ord"), F.upper("o.label").alias("label"), F.col("o.value").alias("value"), "block_id")


BOILERPLATE = r"(?i)^(?:page\s+)?\d+\s*(?:of\s+\d+)?$|^©"
START = r"(?i)^(?:question\s*)?(\d{1,3})[.)\s]"


def unknown_candidates(blocks: DataFrame) -> DataFrame:
    """Candidates of an unknown layout: slices at numbered blocks, or each block if none is numbered."""
    t = F.trim("raw_text")
    df = blocks.where((t != "") & ~t.rlike(BOILERPLATE)).withColumn("t", t).withColumn("start", t.rlike(START))
    order = W.partitionBy("doc_id").orderBy("ord")
    some = F.max("start").over(W.partitionBy("doc_id"))
    df = df.withColumn("n", F.when(some, F.sum(F.col("start").cast("int")).over(order)).otherwise(F.row_number().over(order))).where("n > 0")
    out = df.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id", "t"))).alias("parts"))
    first = F.col("parts")[0]
    return out.select(
        "doc_id", F.concat(F.lit("unknown-candidate:"), "n", F.lit(":"), first["block_id"]).alias("candidate_id"), F.col("n").alias("ord"),
        F.nullif(F.regexp_extract(first["t"], START, 1), F.lit("")).alias("source_ordinal"),
        F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("raw_prompt"), F.size("parts").alias("n_blocks"))


def add_source_ref(df: DataFrame, fragment: str, block_text: str = "raw_text") -> DataFrame:
    """Span of the first occurrence of a fragment in its block, else the whole block."""
    at = F.expr(f"instr({block_text}, {fragment})")
    known = F.coalesce(at > 0, F.lit(False))
    start = F.when(known, at - 1).otherwise(F.lit(0))
    end = F.when(known, at - 1 + F.length(fragment)).otherwise(F.length(block_text))
    return df.withColumn("char_start", start).withColumn("char_end", end)


def extraction_issues(items: DataFrame, fields: DataFrame, partial: DataFrame | None = None) -> DataFrame:
    """A blocking issue for every unverified field, one for a text that breaks off, one for every partial group.

    ``partial``: the issues of ``partial_group_issues``, if the source has groups; the group is their entity here.
    """
    open_ = fields.select("doc_id", F.concat(F.lit("issue:"), "field_id").alias("issue_id"), F.lit("ANSWER_UNVERIFIED").alias("code"), F.lit("blocking").alias("severity"), F.col("field_id").alias("entity_id"))
    cut = items.where("truncated").select("doc_id", F.concat(F.lit("issue:truncated:"), "exercise_id").alias("issue_id"), F.lit("SOURCE_TRUNCATED").alias("code"), F.lit("blocking").alias("severity"), F.col("exercise_id").alias("entity_id"))
    out = open_.unionByName(cut)
    return out if partial is None else out.unionByName(partial.withColumn("entity_id", F.col("entity_ids")[0]).select(out.columns))


def partial_group_issues(segmented: DataFrame, exercises: DataFrame | None = None) -> DataFrame:
    """A blocking issue for every group of ``segment_articles`` that begins outside the supplied pages.

    It names the group, then its exercises (doc_id, group_id, exercise_id, ord), and has the group's blocks as evidence, both in
    order.  References are no groups, nor are documents without any heading.
    """
    group = F.concat(F.lit("group:"), F.greatest(F.col("group"), F.lit(1)))
    parts = segmented.where("completeness = 'partial' and role <> 'reference' and `group` is not null").groupBy("doc_id", group.alias("group_id")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "block_id"))).alias("b"))
    if exercises is None:
        parts = parts.withColumn("x", F.expr("cast(array() as array<string>)"))
    else:
        own = exercises.groupBy("doc_id", "group_id").agg(F.array_sort(F.collect_list(F.struct("ord", "exercise_id"))).alias("x"))
        parts = parts.join(own.select("doc_id", "group_id", F.transform("x", lambda x: x["exercise_id"].cast("string")).alias("x")), ["doc_id", "group_id"], "left")
    return parts.select(
        "doc_id", F.concat(F.lit("issue:"), "group_id", F.lit(":source-truncated")).alias("issue_id"), F.lit("SOURCE_TRUNCATED").alias("code"),
        F.lit("blocking").alias("severity"), F.concat(F.array("group_id"), F.coalesce("x", F.expr("cast(array() as array<string>)"))).alias("entity_ids"),
        F.transform("b", lambda b: b["block_id"]).alias("evidence"))


def extraction_coverage(docs: DataFrame, items: DataFrame, candidates: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Per document: items, fields, whether it breaks off, candidates detected and accounted for, additions, and the status.

    ``candidates`` (doc_id, candidate_id): unknown ones, which count as detected, not accounted, where a document has no item.
    ``expected`` (doc_id, exercise_id): what the source is known to hold; items beyond it are additions, none without it.
    Fields are counted on the items, so the texts are segmented once.
    """
    known = items.withColumn("__extra", F.lit(False))
    if expected is not None:
        known = items.join(expected.select("doc_id", "exercise_id").distinct().withColumn("__known", F.lit(True)), ["doc_id", "exercise_id"], "left")
        known = known.withColumn("__extra", F.col("__known").isNull())
    by_doc = known.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.sum(count_markers(F.col("source_prompt"))).alias("n_fields"), F.max("truncated").alias("truncated"),
        F.count_if("__extra").alias("n_additions"))
    out = docs.select("doc_id").join(by_doc, "doc_id", "left")
    zero = F.lit(0).cast("long")
    if candidates is not None:
        out = out.join(candidates.groupBy("doc_id").agg(F.count("*").alias("__open")), "doc_id", "left")
    n, m, cut = F.coalesce("n_items", zero), F.coalesce("n_fields", zero).cast("long"), F.coalesce("truncated", F.lit(False))
    unknown = F.when(n == 0, F.coalesce("__open", zero)).otherwise(zero) if candidates is not None else zero
    status = F.when((n == 0) & (unknown == 0), "empty").when((m > 0) | cut | (unknown > 0), "needsReview").otherwise("complete")
    return out.select(
        "doc_id", n.alias("n_items"), m.alias("n_fields"), cut.alias("truncated"), (n + unknown).alias("n_detected"), n.alias("n_accounted"),
        F.coalesce("n_additions", zero).alias("n_additions"), status.alias("status"))


def extract_text(docs: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """E2-E5, E25 in one: items, fields and coverage of numbered texts."""
    items = flag_truncated(item_prompts(segment_items(docs, column)))
    fields = answer_markers(items)
    return items, fields, extraction_coverage(docs, items)



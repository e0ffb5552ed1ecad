"""Text and layout to ordered blocks.

``blocks``: doc_id, block_id, page_index, raw_text, ord, x, y, width, height, confidence.
``items``: doc_id, page_index, seq, text, x, y, width, height, confidence.  ``pages``: doc_id, page_index, width, height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillforge.functions.text import unify_newlines

_DROPPED = r"(?<=\p{L})-\r?\n(?=\p{Ll})|(?U)\s+"


def span_map(docs: DataFrame, column: str = "text") -> DataFrame:
    """B2: the pieces of each text with their raw and normalized spans, in order.

    A piece is a stretch kept as it is, a white-space run that becomes one space, or a hyphen and line
    end that vanishes.  White space at either end of the text vanishes too.
    """
    gaps = F.regexp_extract_all(F.col(column), F.lit(_DROPPED), F.lit(0))
    kept = F.split(F.col(column), _DROPPED, -1)
    # a gap borders on kept text, so the texts kept first and last tell whether a gap opens or closes the document
    df = docs.select("doc_id", F.arrays_zip(kept.alias("kept"), gaps.alias("gap")).alias("z"))
    df = df.select("doc_id", F.size("z").alias("n"), (F.get("z", F.lit(0))["kept"] == "").alias("bare"), (F.element_at("z", -1)["kept"] == "").alias("ends"), F.posexplode("z").alias("i", "p"))
    outer = (F.col("i") == 0) & F.col("bare") | (F.col("i") == F.col("n") - 2) & F.col("ends")
    vanishes = outer | F.col("p.gap").startswith("-")
    # only lengths go through the one sort, a row for each kept text with the gap after it
    gap = F.coalesce(F.length("p.gap"), F.lit(0))
    df = df.select("doc_id", "i", F.length("p.kept").alias("text"), gap.alias("gap"), F.when((gap == 0) | vanishes, 0).otherwise(1).alias("space"))
    order = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    n = (F.col("text") > 0).cast("int") + (F.col("gap") > 0).cast("int")
    df = df.select(
        "doc_id", "text", "gap", "space", F.sum(n).over(order).cast("int").alias("piece"),
        F.sum(F.col("text") + F.col("gap")).over(order).alias("raw"), F.sum(F.col("text") + F.col("space")).over(order).alias("norm"))
    raw, norm = F.col("raw") - F.col("gap"), F.col("norm") - F.col("space")
    return df.select("doc_id", F.inline(F.array(
        F.struct((F.col("piece") - (F.col("gap") > 0).cast("int")).alias("piece"), (raw - F.col("text")).alias("raw_start"), raw.alias("raw_end"), (norm - F.col("text")).alias("norm_start"), norm.alias("norm_end")),
        F.struct(F.col("piece").alias("piece"), raw.alias("raw_start"), F.col("raw").alias("raw_end"), norm.alias("norm_start"), F.col("norm").alias("norm_end"))))).where("raw_end > raw_start")


def map_range(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """B2: normalized ranges (doc_id, start, end) to raw ones; an empty range maps to the next span."""
    stop = F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.col("start") + 1)
    met = ranges.withColumn("__stop", stop).join(spans.where("norm_end > norm_start"), "doc_id").where("norm_start < __stop and norm_end > start")
    kept = F.col("raw_end") - F.col("raw_start") == F.col("norm_end") - F.col("norm_start")
    low = F.when(kept, F.col("raw_start") + F.greatest(F.col("start") - F.col("norm_start"), F.lit(0))).otherwise(F.col("raw_start"))
    high = F.when(kept, F.col("raw_end") - F.greatest(F.col("norm_end") - F.col("__stop"), F.lit(0))).otherwise(F.col("raw_end"))
    out = met.groupBy("doc_id", "start", "end").agg(F.min(low).alias("raw_start"), F.max(high).alias("raw_end"))
    return out.withColumn("raw_end", F.when(F.col("end") > F.col("start"), F.col("raw_end")).otherwise(F.col("raw_start")))


def chunk_text(docs: DataFrame, size: int = 4000) -> DataFrame:
    """Blocks of at most ``size`` code points; an empty text gives one empty block."""
    n = F.greatest(F.ceil(F.length("text") / size).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * size + 1, F.lit(size)))
    return docs.where("text is not null").select("doc_id", F.posexplode(parts).alias("ord", "raw_text")).select(
        "doc_id", F.concat(F.lit("text:block:"), F.col("ord")).alias("block_id"), F.lit(None).cast("int").alias("page_index"),
        "raw_text", "ord", F.lit(1.0).alias("confidence"))


def tag_text_lines(docs: DataFrame) -> DataFrame:
    """Non-blank lines with raw offsets, tagged title, instruction or exercise.

    Exercise lines begin with the first line numbered 1 and go on to the end, titles apart.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(unify_newlines(F.col("text")), "\n")).alias("line", "raw_text"))
    order = W.partitionBy("doc_id").orderBy("line")
    start = F.sum(F.length("raw_text") + 1).over(order) - F.length("raw_text") - 1
    begun = F.max(F.col("raw_text").rlike(r"^\s*1\.\s")).over(order.rowsBetween(W.unboundedPreceding, 0))
    title = F.col("raw_text").rlike(r"(?iu)^\s*(?:упражнение|exercise)(?:\s|$|[^\p{L}\p{N}_])")
    kind = F.when(title, "title").when(begun, "exercise").otherwise("instruction")
    tagged = lines.withColumn("kind", kind).withColumn("start", start).withColumn("end", start + F.length("raw_text"))
    return tagged.where(F.col("raw_text").rlike(r"\S"))


def inject_blanks(items: DataFrame, rules: DataFrame, near: float = 3.0) -> DataFrame:
    """Horizontal strokes that are answer blanks become ``___`` items on the line of the nearest text.

    Strokes count if 35 to 90 wide and level within 1.5.  Joined on document and page, within ``near``.
    """
    fine = rules.where("width between 35 and 90 and abs(drift) <= 1.5")
    text = items.where("trim(text) <> ''").select("doc_id", "page_index", "seq", "y", "height", "confidence")
    met = fine.withColumnRenamed("x", "rx").withColumnRenamed("width", "rw").join(text, ["doc_id", "page_index"])
    met = met.withColumn("gap", F.abs(F.col("y") + F.col("height") - F.col("top"))).where(F.col("gap") <= near)
    best = met.groupBy("doc_id", "page_index", "rule_id", "rx", "rw").agg(
        F.min_by(F.struct("y", "height", "seq"), F.struct("gap", "seq")).alias("m"))
    blanks = best.select(
        "doc_id", "page_index", (F.lit(1_000_000) + F.col("rule_id")).cast("int").alias("seq"), F.lit("___").alias("text"),
        F.col("rx").alias("x"), F.col("m.y").alias("y"), F.col("rw").alias("width"), F.col("m.height").alias("height"), F.lit(1.0).alias("confidence"))
    return items.unionByName(blanks)


def items_to_lines(items: DataFrame, pages: DataFrame, epsilon: float = 3.0) -> DataFrame:
    """A line number for every item: same half page, y within ``epsilon`` of the line's first item.

    A fold in y order over each page half, since lines are anchored at their first item.  It goes over the distinct y, as items of one y share a line.
    """
    df = items.join(pages.select("doc_id", "page_index", F.col("width").alias("page_width")), ["doc_id", "page_index"])
    df = df.withColumn("half", (F.col("x") >= F.col("page_width") / 2).cast("int"))
    cell = F.struct("x", "seq", "text", "width", "height", "confidence")
    rows = df.groupBy("doc_id", "page_index", "half", "y").agg(F.collect_list(cell).alias("cells"))
    grouped = rows.groupBy("doc_id", "page_index", "half").agg(F.sort_array(F.collect_list(F.struct("y", "cells"))).alias("rows"))
    folded = F.aggregate(
        F.transform("rows", lambda r: r["y"]),
        F.expr("named_struct('line', -1, 'anchor', cast(null as double), 'out', cast(array() as array<int>))"),
        lambda acc, y: F.when(
            acc["anchor"].isNotNull() & (F.abs(y - acc["anchor"]) <= epsilon),
            F.struct(acc["line"].alias("line"), acc["anchor"].alias("anchor"), F.concat(acc["out"], F.array(acc["line"])).alias("out")),
        ).otherwise(F.struct((acc["line"] + 1).alias("line"), y.alias("anchor"), F.concat(acc["out"], F.array(acc["line"] + 1)).alias("out"))),
        lambda acc: acc["out"])
    out = grouped.select("doc_id", "page_index", "half", F.inline(F.arrays_zip("rows", folded.alias("line"))))
    return out.select("doc_id", "page_index", "half", "line", F.col("rows.y").alias("y"), F.inline("rows.cells"))


def lines_to_blocks(lines: DataFrame) -> DataFrame:
    """One block a line: items by x, tab for gaps of 10 and more, space from 1.5, else nothing."""
    by_line = W.partitionBy("doc_id", "page_index", "half", "line").orderBy("x", "seq")
    right = F.max(F.col("x") + F.col("width")).over(by_line.rowsBetween(W.unboundedPreceding, -1))
    gap = F.col("x") - right
    glue = F.when(gap.isNull(), "").when(gap >= 10, "\t").when(gap >= 1.5, " ").otherwise("")
    pieces = lines.withColumn("piece", F.concat(glue, "text")).withColumn("n", F.row_number().over(by_line))
    out = pieces.groupBy("doc_id", "page_index", "half", "line").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("n", "piece")))["piece"], "").alias("raw_text"),
        F.round(F.min("x"), 2).alias("x"), F.round(F.min("y"), 2).alias("y"),
        F.round(F.max(F.col("x") + F.col("width")) - F.min("x"), 2).alias("width"),
        F.round(F.max(F.col("y") + F.col("height")) - F.min("y"), 2).alias("height"), F.min("confidence").alias("confidence"))
    return out.withColumn("raw_text", F.trim("raw_text")).where("raw_text <> ''")


def reading_order(blocks: DataFrame, pages: DataFrame, epsilon: float = 0.5) -> DataFrame:
    """Left half before right, then y, then x; ids per page and one order over the document, both from 0.

    Blocks whose y differ by no more than ``epsilon`` stand on one line and go by x.  That is no order of single values, so a line
    is anchored at its first block, as in B5: a fold in y order over each page half.
    """
    df = blocks.drop("half", "line").join(pages.select("doc_id", "page_index", F.col("width").alias("__w")), ["doc_id", "page_index"])
    df = df.withColumn("__half", (F.col("x") >= F.col("__w") / 2).cast("int"))
    half = W.partitionBy("doc_id", "page_index", "__half")
    ys = F.array_sort(F.collect_set("y").over(half))
    anchors = F.aggregate(
        ys, F.expr("cast(array() as array<double>)"),
        lambda acc, y: F.when((F.size(acc) > 0) & (y - F.element_at(acc, -1) <= epsilon), acc).otherwise(F.concat(acc, F.array(y))))
    df = df.withColumn("__line", F.array_max(F.filter(anchors, lambda a: a <= F.col("y"))))
    order = ["__half", "__line", "x", "y", *[c for c in ("ord",) if c in df.columns]]
    n = F.row_number().over(W.partitionBy("doc_id", "page_index").orderBy(*order)) - 1
    all_ = F.row_number().over(W.partitionBy("doc_id").orderBy("page_index", *order)) - 1
    return df.withColumns({"block_id": F.concat(F.lit("page:"), "page_index", F.lit(":block:"), n), "ord": all_}).drop("__w", "__half", "__line")


#: fixed value: how an answer key begins, in English or Russian
ANSWER_KEY = r"(?iu)^(answers?|answer key|ключи?\s+ответов?)(?:\s|$|[^\p{L}\p{N}_])"


def has_key_marker(col) -> F.Column:
    """Whether a block begins like the heading of an answer key."""
    return F.coalesce(F.trim(col).rlike(ANSWER_KEY), F.lit(False))


#: fixed values: how sections begin
SECTION_KEY = r"(?i)^answer\s*key\b"
SECTION_INSTRUCTION = r"(?i)^[1-9]\d*\s+(choose|put|complete)\b"
SECTION_EXAMPLE = r"(?i)^example\b"
SECTION_ITEM = r"^[1-9]\d*\s+"


def classify_sections(blocks: DataFrame) -> DataFrame:
    """Section kind and confidence of every block; an answer key goes on until the next instruction."""
    text = F.trim("raw_text")
    key, instruction, example = text.rlike(SECTION_KEY), text.rlike(SECTION_INSTRUCTION), text.rlike(SECTION_EXAMPLE)
    mode = F.last(F.when(key, True).when(instruction & ~example, False), ignorenulls=True).over(
        W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    item = text.rlike(SECTION_ITEM) | text.rlike("_{3,}")
    kind = F.when(key, "answerKey").when(example, "example").when(instruction, "instruction").when(
        F.coalesce(mode, F.lit(False)), "answerKey").when(item, "exercise").otherwise("unknown")
    sure = F.when(key | example | instruction, 1.0).when(F.coalesce(mode, F.lit(False)), 0.95).when(item, 0.9).otherwise(0.65)
    return blocks.select("doc_id", "block_id", "ord", F.concat(F.lit("section:"), "block_id").alias("section_id"), kind.alias("kind"), sure.alias("confidence"))


def audit_text_layer(docs: DataFrame, blocks: DataFrame, least: float = 0.8) -> DataFrame:
    """Documents without text need OCR; blocks of low confidence may be in the wrong order."""
    some = blocks.where(F.trim("raw_text") != "").select("doc_id").distinct()
    none = docs.select("doc_id").join(some, "doc_id", "left_anti").select(
        "doc_id", F.lit("OCR_REQUIRED").alias("code"), F.lit("blocking").alias("severity"), F.lit(None).cast("string").alias("block_id"))
    low = blocks.where(F.col("confidence") < least).select(
        "doc_id", F.lit("READING_ORDER_UNCERTAIN").alias("code"), F.lit("warning").alias("severity"), "block_id")
    return none.unionByName(low)


def assemble_document(blocks: DataFrame, pages: DataFrame, parser_version: str = "1") -> DataFrame:
    """One nested row a document: pages and blocks in order."""
    many = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id", "page_index", "raw_text", "confidence"))).alias("blocks"))
    sheets = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "width", "height"))).alias("pages"))
    return sheets.join(many, "doc_id", "full_outer").select(
        "doc_id", F.lit(parser_version).alias("parser_version"), "pages", "blocks",
        F.when(F.col("blocks").isNull(), F.array(F.lit("NO_BLOCKS"))).otherwise(F.array().cast("array<string>")).alias("warnings"))

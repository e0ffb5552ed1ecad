"""Grading of attempts (H3-H9, H12, H13) and the attempt contract.

``fields``: one row for each answer field of a published version: lesson_id, lesson_version, exercise_id,
group_id, resource_id, field_id, ord, kind (text, choice, orderedTokens), accepted.
``responses``: attempt_id, field_id, kind, text, option_id, tokens.  ``attempts``: attempt_id, lesson_id, lesson_version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillforge.functions.text import escape_html, fold_compatible, matches_any, shorten


def graded_fields(attempts: DataFrame, fields: DataFrame, responses: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """H3: every field of the attempted version, correct or not; accepted answers shown only where incorrect."""
    # compatibility forms are taken before the joins: only narrow scans part into two, the joins run once
    fields = fold_compatible(fields.withColumn("__accepted", F.col("accepted")), "__accepted")
    said = responses.withColumnRenamed("kind", "given_kind").withColumns({"__text": F.col("text"), "__joined": F.array_join("tokens", " ")})
    given = attempts.join(fields, ["lesson_id", "lesson_version"]).join(fold_compatible(said, "__text", "__joined"), ["attempt_id", "field_id"], "left")
    if options is not None:
        values = options.select("option_id", F.col("value").alias("option_value"), F.col("value").alias("__option"))
        given = given.join(fold_compatible(values, "__option"), "option_id", "left")
    else:
        given = given.withColumns({c: F.lit(None).cast("string") for c in ("option_value", "__option")})

    def by_kind(option, joined, text):
        return F.when(F.col("kind") == "choice", option).when(F.col("kind") == "orderedTokens", joined).otherwise(text)

    given = given.withColumn("answer", by_kind(F.col("option_value"), F.array_join("tokens", " "), F.col("text")))
    given = given.withColumn("__own", by_kind(F.col("__option"), F.col("__joined"), F.col("__text")))
    by_id = F.coalesce((F.col("kind") == "choice") & F.array_contains("accepted", F.col("option_id")), F.lit(False))
    correct = by_id | F.coalesce(F.col("__own").rlike(r"(?U)\S"), F.lit(False)) & matches_any(F.col("__own"), F.col("__accepted"))
    return given.withColumn("correct", correct).select(
        "attempt_id", "lesson_id", "lesson_version", "group_id", "exercise_id", "field_id", "ord", "answer", "correct",
        F.when(~F.col("correct"), F.col("accepted")).alias("shown"))


def attempt_rejects(attempts: DataFrame, fields: DataFrame, responses: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """H4: (attempt, code) for version mismatch, unknown field, response kind, foreign option."""
    versions = fields.select("lesson_id", "lesson_version").distinct()
    version = attempts.join(versions, ["lesson_id", "lesson_version"], "left_anti").select("attempt_id", F.lit("VERSION_MISMATCH").alias("code"))
    asked = responses.join(attempts, "attempt_id")
    known = asked.join(fields.select("lesson_id", "lesson_version", "field_id", F.col("kind").alias("field_kind"), "exercise_id"),
                       ["lesson_id", "lesson_version", "field_id"], "left")
    unknown = known.where("field_kind is null").select("attempt_id", F.lit("UNKNOWN_FIELD").alias("code"))
    kind = known.where(F.col("field_kind") != F.col("kind")).select("attempt_id", F.lit("RESPONSE_KIND").alias("code"))
    out = version.unionByName(unknown).unionByName(kind)
    if options is not None:
        own = options.select("exercise_id", "option_id")
        foreign = known.where("field_kind = 'choice' and option_id is not null").join(own, ["exercise_id", "option_id"], "left_anti")
        out = out.unionByName(foreign.select("attempt_id", F.lit("FOREIGN_OPTION").alias("code")))
    return out.distinct()


def use_once_rejects(attempts: DataFrame, fields: DataFrame, responses: DataFrame) -> DataFrame:
    """H5: attempts in which matching fields of one group use an entry of a use-once bank twice.

    Entries that an attempt names once are dropped before the joins.  Repeats are counted over sorted rows, which take less memory than
    hash tables of combinations that hardly repeat, and can spill; the order of the first count is that of the join with the attempts.
    """
    named = F.count("*").over(W.partitionBy("attempt_id", "option_id"))
    given = responses.where("option_id is not null").repartition("attempt_id").withColumn("__n", named).where("__n > 1").drop("__n")
    used = given.join(attempts, "attempt_id").join(fields.where("resource_id is not null"), ["lesson_id", "lesson_version", "field_id"])
    uses = F.count("*").over(W.partitionBy("attempt_id", "group_id", "resource_id", "option_id"))
    twice = used.select("attempt_id", uses.alias("__n")).where("__n > 1")
    return twice.select("attempt_id", F.lit("ENTRY_REUSED").alias("code")).distinct()


def without(attempts: DataFrame, rejects: DataFrame) -> DataFrame:
    return attempts.join(rejects.select("attempt_id").distinct(), "attempt_id", "left_anti")


def result_status(correct: Column, total: Column) -> Column:
    """H12."""
    return F.when(correct == total, "correct").when(correct == 0, "incorrect").otherwise("partial")


def exercise_rollup(graded: DataFrame) -> DataFrame:
    """H6: status of each exercise."""
    out = graded.groupBy("attempt_id", "exercise_id").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    return out.withColumn("status", result_status(F.col("correct"), F.col("total")))


def attempt_scores(graded: DataFrame) -> DataFrame:
    """H6: score of each attempt."""
    out = graded.groupBy("attempt_id").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    return out.withColumn("status", result_status(F.col("correct"), F.col("total")))


def attempt_fingerprint(responses: DataFrame) -> DataFrame:
    """H7: digest of the responses in field order, independent of the order they came in."""
    one = F.struct("field_id", "kind", "text", "option_id", "tokens")
    return responses.groupBy("attempt_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(one))), 256).alias("fingerprint"))


def response_rows(responses: DataFrame) -> DataFrame:
    """H8: persisted rows: kind inferred where missing, one value, ordinal by field."""
    kind = F.coalesce("kind", F.when(F.col("option_id").isNotNull(), "choice").when(F.col("tokens").isNotNull(), "orderedTokens").otherwise("text"))
    value = F.when(kind == "choice", F.col("option_id")).when(kind == "orderedTokens", F.to_json("tokens")).otherwise(F.col("text"))
    order = W.partitionBy("attempt_id").orderBy("field_id")
    return responses.select("attempt_id", "field_id", kind.alias("kind"), value.alias("value"), F.row_number().over(order).alias("ord"))


def submit_attempts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """H9: ``outcome`` of each submission: create, replay, or conflict of one attempt id.

    Rows have attempt_id, lesson_id, fingerprint, created_at; created ones get a pending outbox row.
    """
    same = F.sha2(F.concat_ws("\0", "lesson_id", "fingerprint"), 256)
    new = incoming.withColumn("__print", same)
    old = stored.withColumn("__print", same).groupBy("attempt_id").agg(F.min("__print").alias("__old"))
    order = W.partitionBy("attempt_id").orderBy("created_at", "__print")
    new = new.withColumn("__n", F.row_number().over(order)).withColumn("__first", F.first("__print").over(order)).join(old, "attempt_id", "left")
    known = F.coalesce("__old", "__first")
    outcome = F.when(F.col("__old").isNull() & (F.col("__n") == 1), "create").when(known == F.col("__print"), "replay").otherwise("conflict")
    return new.withColumn("outcome", outcome).withColumn("outbox", F.when(F.col("outcome") == "create", "pending")).drop("__print", "__n", "__first", "__old")


def report_parts(rows: DataFrame, limit: int = 3900, answer_limit: int = 300) -> DataFrame:
    """Report lines of an attempt packed, in order, into parts of at most ``limit`` code points.

    ``rows``: attempt_id, ord, prompt, answer, correct.  A fold in row order: a line that does not fit opens a part; one longer than
    ``limit`` is carried on in parts of its own, never cut inside an escape, and the next line may follow in its last part.
    """
    mark = F.when(F.col("correct"), "+").otherwise("-")
    line = F.concat(mark, F.lit(" "), escape_html(F.coalesce("prompt", F.lit(""))), F.lit(": "),
                    escape_html(shorten(F.coalesce("answer", F.lit("")), answer_limit)))
    pieces = F.regexp_extract_all(line, F.lit(f"(?s).{{1,{limit}}}(?<!&[a-z]{{0,3}})"), F.lit(0))
    listed = rows.select("attempt_id", F.struct("ord", line.alias("line"), pieces.alias("pieces")).alias("r"))
    listed = listed.groupBy("attempt_id").agg(F.array_sort(F.collect_list("r")).alias("lines"))
    steps = F.flatten(F.transform("lines", lambda r: F.transform(r["pieces"], lambda p, i: F.struct(p.alias("text"), (i > 0).alias("carried")))))
    fold = F.aggregate(
        steps, F.expr("cast(array() as array<string>)"),
        lambda acc, x: F.when(
            ~x["carried"] & (F.size(acc) > 0) & (F.length(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) + 1 + F.length(x["text"]) <= limit),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit("\n"), x["text"]))),
        ).otherwise(F.concat(acc, F.array(x["text"]))))
    return listed.select("attempt_id", F.posexplode(fold).alias("part", "body"))


#: fixed values: the words and marks of a result message
REPORT_TITLE = "📝 <b>Результаты теста</b>"
REPORT_CONTINUED = "📝 <b>Результаты теста · продолжение</b>"
REPORT_VERSION, REPORT_STUDENT, REPORT_SCORE, REPORT_OF, REPORT_RIGHT = "версия", "Ученик", "Баллы", "из", "Верно"


def result_report(attempts: DataFrame, rows: DataFrame, limit: int = 3900) -> DataFrame:
    """The result message of each attempt: a header, then a block for each row, packed in order into parts.

    ``attempts``: attempt_id, title, lesson_version, student, correct, total.  ``rows``: attempt_id, ord, answer, correct,
    accepted.  A block that would take a part beyond ``limit`` opens the next one under a short header.  Answers are cut so that a
    block has room, accepted values at half of it; lengths are code points before escaping, so escapes may take a part beyond the
    limit.  Attempts without rows have the header alone; null answers, and accepted lists that are null or empty, show as a dash.
    """
    room = limit - len(REPORT_CONTINUED) - 2
    right = F.coalesce("correct", F.lit(False))
    filled = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))
    accepted = F.when(right, F.lit("")).otherwise(filled(F.array_join("accepted", " / ")))
    prefix = F.concat(F.when(right, "✅").otherwise("❌"), F.lit(" "), F.col("ord").cast("string"), F.lit(". "))
    below = f"\n   {REPORT_RIGHT}: "
    df = rows.select("attempt_id", "ord", right.alias("right"), prefix.alias("prefix"), accepted.alias("accepted"), filled(F.col("answer")).alias("answer"))
    answer_room = F.greatest(F.lit(32), F.lit(room - len(below)) - F.length("prefix") - F.length("accepted"))
    block = F.concat("prefix", escape_html(shorten(F.col("answer"), answer_room)), F.when(F.col("right"), "").otherwise(
        F.concat(F.lit(below), escape_html(shorten(F.col("accepted"), room // 2)))))
    blocks = df.groupBy("attempt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("block")))), lambda r: r["block"]).alias("blocks"))
    head = F.concat(
        F.lit(f"{REPORT_TITLE}\n<b>"), escape_html(F.coalesce("title", F.lit(""))), F.lit(f"</b> · {REPORT_VERSION} "), F.col("lesson_version").cast("string"),
        F.lit(f"\n{REPORT_STUDENT}: "), escape_html(F.coalesce("student", F.lit(""))),
        F.lit(f"\n{REPORT_SCORE}: <b>"), F.col("correct").cast("string"), F.lit(f" {REPORT_OF} "), F.col("total").cast("string"), F.lit("</b>"))
    listed = attempts.select("attempt_id", head.alias("head")).join(blocks, "attempt_id", "left")
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    parts = F.aggregate(
        F.coalesce("blocks", F.expr("cast(array() as array<string>)")), F.array("head"),
        lambda acc, x: F.when(F.length(last(acc)) + F.length(x) + 2 > limit, F.concat(acc, F.array(F.concat(F.lit(REPORT_CONTINUED + "\n\n"), x))))
        .otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last(acc), F.lit("\n\n"), x)))))
    return listed.select("attempt_id", F.posexplode(parts).alias("part", "body"))


def attempt_violations(attempts: DataFrame, responses: DataFrame, graded: DataFrame, max_fields: int = 500) -> DataFrame:
    """Repeated fields, too many responses, answers shown for correct fields, scores that don't add up."""
    def coded(df, code):
        return df.select(F.col("attempt_id").alias("entity_id"), F.lit(code).alias("code"))

    twice = responses.groupBy("attempt_id", "field_id").count().where("count > 1").select("attempt_id").distinct()
    many = responses.groupBy("attempt_id").count().where(F.col("count") > max_fields)
    shown = graded.where("correct and shown is not null").select("attempt_id").distinct()
    score = attempt_scores(graded).select("attempt_id", F.col("correct").alias("own"), F.col("total").alias("all"))
    wrong = attempts.where("correct is not null").join(score, "attempt_id").where("correct <> own or total <> all") if "correct" in attempts.columns else None
    out = coded(twice, "FIELD_REPEATED").unionByName(coded(many, "TOO_MANY_RESPONSES")).unionByName(coded(shown, "ANSWER_SHOWN"))
    return out if wrong is None else out.unionByName(coded(wrong, "SCORE_MISMATCH"))

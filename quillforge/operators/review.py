"""Review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def apply_answer_reviews(fields: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviewed fields with before and after, violations).  The last review of a field wins.

    ``reviews``: field_id, seq, value.  Blank values and unknown fields are violations and change nothing.
    """
    bad_value = reviews.where(F.trim(F.coalesce("value", F.lit(""))) == "").select("field_id", F.lit("BLANK_VALUE").alias("code"))
    unknown = reviews.join(fields.select("field_id"), "field_id", "left_anti").select("field_id", F.lit("UNKNOWN_FIELD").alias("code"))
    last = reviews.where(F.trim(F.coalesce("value", F.lit(""))) != "").groupBy("field_id").agg(F.max_by(F.trim("value"), "seq").alias("__new"))
    df = fields.join(last, "field_id", "left")
    changed = F.col("__new").isNotNull()
    before = F.when(changed, F.struct("accepted", "provenance", "review_status"))
    df = df.withColumn("before", before).withColumns({
        "accepted": F.when(changed, F.array("__new")).otherwise(F.col("accepted")), "provenance": F.when(changed, "teacherSupplied").otherwise(F.col("provenance")),
        "review_status": F.when(changed, "verified").otherwise(F.col("review_status")),
        "confidence": F.when(~changed, F.col("confidence"))}).drop("__new")
    return df, unknown.unionByName(bad_value)


def apply_issue_decisions(fields: DataFrame, exercises: DataFrame, issues: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R2: decisions on issues reach every field the issue names; an exclusion drops the exercise."""
    named = decisions.join(issues.select("issue_id", F.explode("entity_ids").alias("entity_id")), "issue_id")
    confirmed = named.where("decision = 'confirm'").select(F.col("entity_id").alias("field_id")).distinct().withColumn("__ok", F.lit(True))
    out = named.where("decision = 'exclude'").select("entity_id").distinct()
    owners = fields.join(out.withColumnRenamed("entity_id", "field_id"), "field_id", "left_semi").select("exercise_id").unionByName(
        exercises.join(out.withColumnRenamed("entity_id", "exercise_id"), "exercise_id", "left_semi").select("exercise_id")).distinct()
    kept = fields.join(owners, "exercise_id", "left_anti").join(confirmed, "field_id", "left")
    kept = kept.withColumn("review_status", F.when(F.col("__ok"), "verified").otherwise(F.col("review_status"))).drop("__ok")
    return kept, exercises.join(owners, "exercise_id", "left_anti")


def apply_exercise_edits(exercises: DataFrame, edits: DataFrame) -> DataFrame:
    """Prompt and option edits, the last of each; provenance becomes the decision.

    ``edits``: exercise_id, seq, prompt, options (where exercises have them), decision_id; null leaves a part as it is.
    """
    parts = [c for c in ("prompt", "options") if c in edits.columns and c in exercises.columns]
    last = edits.groupBy("exercise_id").agg(
        F.max_by("decision_id", "seq").alias("__decision"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__{c}") for c in parts])
    df = exercises.join(last, "exercise_id", "left")
    df = df.withColumns({c: F.coalesce(f"__{c}", c) for c in parts} | {"decision_id": F.col("__decision")})
    return df.drop("__decision", *[f"__{c}" for c in parts])


def apply_exercise_creates(exercises: DataFrame, creates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all exercises, rejected creates).  ``creates``: group_id, seq, kind, prompt, answers, options.

    A new exercise needs a prompt and an answer, a choice two options; ordinals go on from the group's last.  New exercises
    carry their ``answers`` and ``options``, which are null for those that were there.
    """
    tidy = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda x: x != "")
    new = creates.withColumn("prompt", F.trim("prompt")).withColumn("answers", tidy(F.col("answers"))).withColumn("options", tidy(F.col("options")))
    fine = (F.coalesce("prompt", F.lit("")) != "") & (F.size("answers") > 0) & (~F.col("kind").isin("singleChoice", "oddOneOut") | (F.size("options") >= 2))
    last = exercises.groupBy("group_id").agg(F.max("ord").alias("__last"))
    n = F.row_number().over(W.partitionBy("group_id").orderBy("seq"))
    added = new.where(fine).join(last, "group_id", "left").withColumn("ord", (F.coalesce("__last", F.lit(0)) + n).cast("int"))
    added = added.select("group_id", F.concat("group_id", F.lit(":item:"), "ord").alias("exercise_id"), "ord", "kind", "prompt", "answers", "options")
    old = exercises.select(*[F.col(c) if c in exercises.columns else F.lit(None).cast("array<string>").alias(c) for c in added.columns])
    return old.unionByName(added), new.where(~fine)


def apply_exercise_deletes(exercises: DataFrame, groups: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exercises numbered anew, groups left, refused deletes).  A draft's last exercise can't go."""
    gone = deletes.select("draft_id", "exercise_id").distinct()
    left = exercises.join(gone, ["draft_id", "exercise_id"], "left_anti")
    empty = exercises.select("draft_id").distinct().join(left.select("draft_id").distinct(), "draft_id", "left_anti")
    refused = gone.join(empty, "draft_id", "left_semi")
    left = exercises.join(gone.join(empty, "draft_id", "left_anti"), ["draft_id", "exercise_id"], "left_anti")
    left = left.withColumn("ord", F.row_number().over(W.partitionBy("draft_id", "group_id").orderBy("ord", "exercise_id")))
    return left, groups.join(left.select("draft_id", "group_id").distinct(), ["draft_id", "group_id"], "left_semi"), refused


def coverage_after_deletes(entries: DataFrame, deletes: DataFrame, refused: DataFrame) -> DataFrame:
    """Coverage entries (draft_id, candidate_id, kind, exercise_ids, decision_id) after deletes (draft_id, exercise_id, decision_id).

    An exercise entry that names a deleted exercise becomes a decision: the first, by id, that deleted one of them.  Refused deletes and
    entries of other kinds change nothing.
    """
    done = deletes.join(refused.select("draft_id", "exercise_id"), ["draft_id", "exercise_id"], "left_anti")
    named = entries.where("kind = 'exercise'").select("draft_id", "candidate_id", F.explode(F.array_distinct("exercise_ids")).alias("exercise_id"))
    by = named.join(done, ["draft_id", "exercise_id"]).groupBy("draft_id", "candidate_id").agg(F.min("decision_id").alias("__by"))
    df = entries.join(by, ["draft_id", "candidate_id"], "left")
    gone = (F.col("kind") == "exercise") & F.col("__by").isNotNull()
    return df.withColumns({
        "kind": F.when(gone, "decision").otherwise(F.col("kind")), "exercise_ids": F.when(~gone, F.col("exercise_ids")),
        "decision_id": F.when(gone, F.col("__by")).otherwise(F.col("decision_id"))}).drop("__by")


def issues_touched(issues: DataFrame, edited: DataFrame, deleted: DataFrame) -> DataFrame:
    """Open issues an edit resolves (truncation of that exercise) or a delete does (any that name it)."""
    named = issues.where("resolution = 'open'").select("issue_id", "code", F.explode("entity_ids").alias("exercise_id"))
    by_edit = named.where("code = 'SOURCE_TRUNCATED'").join(edited.select("exercise_id"), "exercise_id", "left_semi").select("issue_id", F.lit("edit").alias("by"))
    by_delete = named.join(deleted.select("exercise_id"), "exercise_id", "left_semi").select("issue_id", F.lit("delete").alias("by"))
    return by_edit.unionByName(by_delete).groupBy("issue_id").agg(F.min("by").alias("by"))


def resolve_issues(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open issues of the decision's run and owner: excluded ones are accepted risks, others resolved."""
    named = decisions.select("run_id", "owner_id", F.explode("resolved_issue_ids").alias("issue_id"), "decision", "created_at")
    last = named.groupBy("run_id", "owner_id", "issue_id").agg(F.max_by("decision", "created_at").alias("__d"))
    df = issues.join(last, ["run_id", "owner_id", "issue_id"], "left")
    open_ = (F.col("resolution") == "open") & F.col("__d").isNotNull()
    new = F.when(open_ & (F.col("__d") == "exclude"), "acceptedRisk").when(open_, "resolved").otherwise(F.col("resolution"))
    return df.withColumn("resolution", new).drop("__d")


def submit_reviews(drafts: DataFrame, submissions: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcome of every submission, drafts after them).

    ``submissions``: draft_id, key, fingerprint, expected_revision, arrived.  Repeats of a key are replays or conflicts; of the
    rest, the first with the draft's revision is applied and the others are stale.
    """
    by_key = W.partitionBy("draft_id", "key").orderBy("arrived")
    df = submissions.join(drafts.select("draft_id", "revision"), "draft_id")
    df = df.withColumn("__n", F.row_number().over(by_key)).withColumn("__f", F.first("fingerprint").over(by_key))
    fits = (F.col("__n") == 1) & (F.col("expected_revision") == F.col("revision"))
    df = df.withColumn("__fits", fits).withColumn("__turn", F.sum(fits.cast("int")).over(W.partitionBy("draft_id").orderBy("arrived", "key")))
    outcome = F.when(F.col("__n") > 1, F.when(F.col("fingerprint") == F.col("__f"), "replay").otherwise("conflict")).when(
        F.col("__fits") & (F.col("__turn") == 1), "applied").otherwise("stale")
    df = df.withColumn("outcome", outcome).drop("__n", "__f", "__fits", "__turn", "revision")
    done = df.where("outcome = 'applied'").select("draft_id").distinct().withColumn("__up", F.lit(1))
    after = drafts.join(done, "draft_id", "left").join(reasons, "draft_id", "left")
    after = after.withColumn("revision", F.col("revision") + F.coalesce("__up", F.lit(0))).withColumn(
        "run_status", F.when(F.coalesce(F.size("reasons"), F.lit(0)) > 0, "needsReview").otherwise("readyToPublish"))
    return df, after.drop("__up", "reasons")


def apply_layout_decisions(reviews: DataFrame, candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted decisions, rejected ones with a code, state of each review) after all submissions.

    ``candidates``: review_id, candidate_id; ``decisions``: review_id, candidate_id, submission, seq, action, kind, outcome.  The first
    decision on a candidate counts; later ones are ALREADY_DECIDED, or DUPLICATE_DECISION in the same submission.  A review is complete when
    every candidate is decided, and resolved if one of them was classified; else it stays active with ZERO_VALID_GROUP.
    """
    known = candidates.select("review_id", "candidate_id").distinct().withColumn("__known", F.lit(True))
    d = decisions.join(known, ["review_id", "candidate_id"], "left")
    order = W.partitionBy("review_id", "candidate_id").orderBy("submission", "seq")
    earlier = F.first("submission").over(order) < F.col("submission")
    code = F.when(F.col("__known").isNull(), "UNKNOWN_CANDIDATE").when(earlier, "ALREADY_DECIDED").when(F.row_number().over(order) > 1, "DUPLICATE_DECISION")
    d = d.withColumn("code", code).drop("__known")
    good = d.where("code is null").drop("code")
    # a candidate has one decision that counts, so candidates and decisions are counted apart, without a join of them
    each = known.select("review_id", F.lit(1).alias("__n"), F.lit(None).cast("string").alias("action")).unionByName(
        good.select("review_id", F.lit(0).alias("__n"), "action"))
    state = each.groupBy("review_id").agg(
        F.sum("__n").alias("n"), F.count("action").alias("n_decided"), F.count_if(F.col("action") == "classify").alias("n_classified"),
        F.count_if(F.col("action") == "exclude").alias("n_excluded"))
    complete = F.col("n_decided") == F.col("n")
    state = state.withColumn("status", F.when(complete & (F.col("n_classified") > 0), "resolved").otherwise("active")).withColumn(
        "code", F.when(complete & (F.col("n_classified") == 0), "ZERO_VALID_GROUP"))
    return good, d.where("code is not null"), reviews.select("review_id").join(state, "review_id")


def layout_drafts(candidates: DataFrame, accepted: DataFrame, states: DataFrame, instruction: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drafts of resolved reviews, their open issues, candidates that make no exercise) from the decisions of all submissions.

    ``candidates``: review_id, candidate_id, raw_prompt; ``accepted`` and ``states`` as of ``apply_layout_decisions``, with decision_id.  A draft has one group
    of the classified candidates in order of decision, reference blocks of those marked so, and a coverage entry for each decision.  Every
    answer field is an issue.  A review with a candidate that makes no exercise gives no draft.
    """
    d = accepted.join(states.where("status = 'resolved'").select("review_id"), "review_id").join(
        candidates.select("review_id", "candidate_id", "raw_prompt"), ["review_id", "candidate_id"])
    # exercises are made where the decisions stand, so that these are computed once
    classify = F.col("action") == "classify"
    d = candidates_to_exercises(d)
    d = d.withColumns({c: F.when(classify, F.col(c)) for c in ("prompt", "options", "error")})
    bad = d.where("error is not null").select("review_id", "candidate_id", F.col("error").alias("code"))
    name = F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string"))
    row = F.struct("submission", "seq", name.alias("name"), "decision_id", "action", "kind", "outcome", "prompt", F.coalesce("options", F.array().cast("array<string>")).alias("options"), "raw_prompt")
    one = d.groupBy("review_id").agg(F.array_sort(F.collect_list(row)).alias("ds"), F.count("error").alias("n_bad")).where("n_bad = 0")

    def exercise(x, i):
        return F.struct(
            F.concat(x["name"], F.lit(":exercise")).alias("exercise_id"), (i + 1).alias("ord"), x["kind"].alias("kind"), x["prompt"].alias("prompt"), x["options"].alias("options"),
            x["decision_id"].alias("decision_id"), F.concat(x["name"], F.lit(":answer:1")).alias("field_id"), F.lit("needsReview").alias("review_status"))

    def reference(x, i):
        return F.struct(F.concat(x["name"], F.lit(":reference")).alias("block_id"), (i + 1).alias("ord"), x["raw_prompt"].alias("raw_text"), x["decision_id"].alias("decision_id"))

    def entry(x):
        done = x["action"] == "classify"
        return F.struct(x["name"].alias("candidate"), F.when(done, "exercise").otherwise("decision").alias("kind"),
                        F.when(done, F.concat(x["name"], F.lit(":exercise"))).otherwise(x["decision_id"].cast("string")).alias("entity_id"))

    drafts = one.select(
        "review_id", F.concat(F.lit("layout-review:"), F.col("review_id").cast("string"), F.lit(":group:1")).alias("group_id"), F.lit(instruction).alias("instruction"),
        F.transform(F.filter("ds", lambda x: x["action"] == "classify"), exercise).alias("exercises"),
        F.transform(F.filter("ds", lambda x: (x["action"] == "mark") & (x["outcome"] == "reference")), reference).alias("reference_blocks"),
        F.transform("ds", entry).alias("coverage"), F.size("ds").alias("n_detected"), F.size("ds").alias("n_accounted"), F.lit(0).alias("n_additions"), F.lit("needsReview").alias("status"))
    fields = drafts.select("review_id", F.explode("exercises").alias("x"))
    issues = fields.select("review_id", F.lit("ANSWER_UNVERIFIED").alias("code"), F.lit("blocking").alias("severity"), F.col("x.field_id").alias("entity_id"), F.lit("open").alias("resolution"))
    return drafts, issues, bad


def clean_prompt(text) -> Column:
    """A prompt without its number, with single spaces and none before punctuation."""
    text = F.regexp_replace(text, r"^(?i:question\s*)?\d{1,3}[.)\s]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s+([,.!?;:])", "$1"))


def candidates_to_exercises(candidates: DataFrame) -> DataFrame:
    """A candidate's raw prompt as an exercise of its ``kind``.

    Choices: the lines before the first labelled one are the prompt, in which tabs become a gap unless there is one already; the labelled
    lines are the options; no prompt or fewer than two options is an error.  Without a labelled line all lines are the prompt.  Other kinds keep the
    whole prompt, cleaned.
    """
    lines = F.transform(F.split("raw_prompt", "\r?\n"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    label = r"(?iu)^[a-zа-яё][.)]?\s+"
    df = candidates.withColumn("l", lines).withColumn("at", F.array_position(F.transform("l", lambda x: x.rlike(label)), True).cast("int"))
    head = F.slice("l", 1, F.when(F.col("at") == 0, F.size("l")).otherwise(F.col("at") - 1))
    stem = F.array_join(head, " ")
    stem = clean_prompt(F.regexp_replace(stem, "\t+", F.when(F.contains(stem, F.lit("___")), " ").otherwise(" ___ ")))
    tail = F.filter(F.slice("l", F.greatest(F.col("at"), F.lit(1)), F.size("l")), lambda x: x.rlike(label + "."))
    options = F.transform(tail, lambda x: F.regexp_replace(x, label, ""))
    choice = F.col("kind").isin("singleChoice", "oddOneOut")
    df = df.withColumn("prompt", F.when(choice, stem).otherwise(clean_prompt(F.col("raw_prompt")))).withColumn(
        "options", F.when(choice & (F.col("at") > 1), options).when(choice, F.array().cast("array<string>")))
    few = choice & ((F.col("at") < 2) | (F.size("options") < 2))
    return df.select(
        *[c for c in candidates.columns if c not in ("prompt", "options", "error")], "prompt", "options",
        F.when(few, "TOO_FEW_OPTIONS").when(F.col("prompt") == "", "PROMPT_NOT_FOUND").alias("error"))


def overlap_violations(drafts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Runs that have a draft and an active layout review."""
    return drafts.select("run_id").distinct().join(reviews.where("status = 'active'").select("run_id").distinct(), "run_id")


SEVERITY = {"info": 1, "warning": 2, "blocking": 3}


def entity_severity(issues: DataFrame) -> DataFrame:
    """The highest open severity of each entity, and its issues."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in SEVERITY.items()])
    named = issues.where("resolution = 'open'").select("issue_id", rank.alias("rank"), "severity", F.explode("entity_ids").alias("entity_id"))
    return named.groupBy("entity_id").agg(F.max_by("severity", "rank").alias("severity"), F.array_sort(F.collect_list("issue_id")).alias("issue_ids"))


def visible_issues(issues: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Issues without the unverified-answer ones whose fields are all confirmed."""
    named = issues.where("code = 'ANSWER_UNVERIFIED'").select("issue_id", F.explode("entity_ids").alias("field_id"))
    left = named.join(confirmed.select("field_id"), "field_id", "left_anti").select("issue_id").distinct()
    done = named.select("issue_id").distinct().join(left, "issue_id", "left_anti")
    return issues.join(done, "issue_id", "left_anti")

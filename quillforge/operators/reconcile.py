"""Reconciliation of overlapping structural proposals.

Flat tables, each with doc_id and ``seq`` (proposal order, then position):
regions: region_id, role, confidence, sources array<(block_id, char_start, char_end)>; groups: group_id,
ordinal, region_ids; exercises: exercise_id, group_id, ordinal, kind, source_ordinal, n_fields, prompt_region_ids;
resources: resource_id, kind, usage_policy, region_ids; claims: block_id, proposal_id, outcome, region_ids; blocks: block_id, raw_text, ord.
Conflicts share one schema: doc_id, code, owner_id, block_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spans import placed, stabbed

LEAST = 0.8
#: fixed values: roles whose spans have one owner
LEAF_ROLES = ("localOption", "sharedBankEntry", "referenceMaterial", "example", "answerKey", "boilerplate")
#: fixed values: codes of structural conflicts, and those that structures of version 1.0.0 may hold
CONFLICT_CODES = (
    "OVERLAPPING_OWNERSHIP", "INCOMPATIBLE_CONTINUATION", "DANGLING_RELATION", "ORDER_CONFLICT", "MISSING_BLOCK", "INVALID_INTERACTION",
    "NON_ATOMIC_EXERCISE", "MIXED_INSTRUCTION_AND_ITEMS", "LOW_CONFIDENCE", "UNKNOWN_STRUCTURE")
LEGACY_CODES = tuple(c for c in CONFLICT_CODES if c not in ("NON_ATOMIC_EXERCISE", "MIXED_INSTRUCTION_AND_ITEMS"))


def _merge(df: DataFrame, key: str, same: list[str], unions: list[str]) -> tuple[DataFrame, DataFrame]:
    """First row of a key by ``seq``; compatible rows join it, the others are conflicts.

    What makes rows compatible (``same``) never changes by merging, so comparing with the first row is exact.  Union
    columns keep first-seen order; confidence is the lowest.
    """
    by_key = W.partitionBy("doc_id", key).orderBy("seq")
    lead = F.first(F.struct(*same)).over(by_key)
    df = df.withColumn("__same", F.struct(*same).eqNullSafe(lead))
    aggs = [F.min("confidence").alias("confidence"), F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in same]]
    aggs += [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("v")))), lambda x: x["v"]))).alias(c) for c in unions]
    return df.where("__same").groupBy("doc_id", key).agg(*aggs), df.where("not __same").drop("__same")


def _conflict(df: DataFrame, code: str, owner: str, blocks: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select("doc_id", F.lit(code).alias("code"), F.col(owner).cast("string").alias("owner_id"), (none if blocks is None else blocks).alias("block_ids"))


def _blocks_of(col: str = "sources") -> Column:
    return F.array_distinct(F.transform(col, lambda s: s["block_id"]))


def merge_regions(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged regions and INCOMPATIBLE_CONTINUATION conflicts.

    A conflict names the blocks of the compatible rows before it, then its own.
    """
    merged, wrong = _merge(regions, "region_id", ["role"], ["sources"])
    before = regions.withColumn("__lead", F.first("role").over(W.partitionBy("doc_id", "region_id").orderBy("seq")))
    before = before.where("role <=> __lead").select("doc_id", "region_id", F.col("seq").alias("__s"), F.explode(_blocks_of()).alias("__b"))
    seen = wrong.select("doc_id", "region_id", "seq").join(before, ["doc_id", "region_id"]).where("__s < seq")
    seen = seen.groupBy("doc_id", "region_id", "seq").agg(F.array_sort(F.collect_set("__b")).alias("__seen"))
    wrong = wrong.join(seen, ["doc_id", "region_id", "seq"], "left")
    none = F.array().cast("array<string>")
    return merged, _conflict(wrong, "INCOMPATIBLE_CONTINUATION", "region_id", F.array_union(F.coalesce("__seen", none), _blocks_of()))


def merge_groups(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W6."""
    merged, wrong = _merge(groups, "group_id", ["ordinal"], ["region_ids"])
    return merged, _conflict(wrong, "INCOMPATIBLE_CONTINUATION", "group_id")


def merge_exercises(exercises: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W7."""
    merged, wrong = _merge(exercises, "exercise_id", ["group_id", "ordinal", "kind", "source_ordinal", "n_fields"], ["prompt_region_ids"])
    return merged, _conflict(wrong, "INCOMPATIBLE_CONTINUATION", "exercise_id")


def merge_resources(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W8."""
    merged, wrong = _merge(resources, "resource_id", ["kind", "usage_policy"], ["region_ids"])
    return merged, _conflict(wrong, "INCOMPATIBLE_CONTINUATION", "resource_id")


def foreign_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals made for another document."""
    return _conflict(proposals.where(~F.col("proposed_doc_id").eqNullSafe(F.col("doc_id"))), "DANGLING_RELATION", "proposal_id")


def region_span_conflicts(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sources in unknown blocks, or past a block's end: one DANGLING_RELATION a region, with the blocks."""
    src = regions.select("doc_id", "region_id", F.inline("sources"))
    met = src.join(blocks.select("doc_id", "block_id", F.length("raw_text").alias("__n")), ["doc_id", "block_id"], "left")
    bad = met.where("__n is null or char_end > __n")
    return bad.groupBy("doc_id", "region_id").agg(F.array_sort(F.collect_set("block_id")).alias("b")).select(
        "doc_id", F.lit("DANGLING_RELATION").alias("code"), F.col("region_id").alias("owner_id"), F.col("b").alias("block_ids"))


def dangling(owners: DataFrame, owner: str, refs: str, targets: DataFrame, target: str) -> DataFrame:
    """Owners that name a target which does not exist; one conflict an owner."""
    named = owners.select("doc_id", owner, F.explode(refs).alias(target))
    lost = named.join(targets.select("doc_id", target), ["doc_id", target], "left_anti").select("doc_id", owner).distinct()
    return _conflict(lost, "DANGLING_RELATION", owner)


def prompt_role_conflicts(exercises: DataFrame, regions: DataFrame) -> DataFrame:
    """Prompts that are regions of another role."""
    named = exercises.select("doc_id", "exercise_id", F.explode("prompt_region_ids").alias("region_id"))
    wrong = named.join(regions.select("doc_id", "region_id", "role"), ["doc_id", "region_id"]).where("role <> 'exercisePrompt'")
    return _conflict(wrong.select("doc_id", "exercise_id").distinct(), "MIXED_INSTRUCTION_AND_ITEMS", "exercise_id")


def _spans(owners: DataFrame, owner: str, refs: str, regions: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    named = owners.select("doc_id", owner, *extra, F.explode(refs).alias("region_id"))
    return named.join(regions.select("doc_id", "region_id", "sources"), ["doc_id", "region_id"]).select("doc_id", owner, *extra, F.inline("sources"))


def overlapping_prompts(exercises: DataFrame, regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every pair of exercises whose prompts share text (owner_id, other_id), with the blocks in which they do.

    Sources without offsets are the whole block.
    """
    own = placed(blocks, _spans(exercises, "exercise_id", "prompt_region_ids", regions))[0]
    met = stabbed(own, own, ["doc_id", "block_id"]).where(
        "l_exercise_id <> r_exercise_id and (l_start < r_start or l_exercise_id < r_exercise_id)")
    pair = met.select("doc_id", "block_id", F.least("l_exercise_id", "r_exercise_id").alias("owner_id"), F.greatest("l_exercise_id", "r_exercise_id").alias("other_id"))
    return pair.groupBy("doc_id", "owner_id", "other_id").agg(F.array_sort(F.collect_set("block_id")).alias("block_ids")).select(
        "doc_id", F.lit("NON_ATOMIC_EXERCISE").alias("code"), "owner_id", "other_id", "block_ids")


def mixed_instruction(groups: DataFrame, exercises: DataFrame, regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Groups whose instruction regions share text with a prompt of the group, with the blocks in which they do."""
    a, p = placed(
        blocks, _spans(groups, "group_id", "region_ids", regions.where("role = 'instruction'")),
        _spans(exercises, "exercise_id", "prompt_region_ids", regions, ("group_id",)).drop("exercise_id"))
    keys = ["doc_id", "group_id", "block_id"]
    met = stabbed(a, p, keys).select(*keys).unionByName(stabbed(p, a, keys).select(*keys))
    return met.groupBy("doc_id", "group_id").agg(F.array_sort(F.collect_set("block_id")).alias("b")).select(
        "doc_id", F.lit("MIXED_INSTRUCTION_AND_ITEMS").alias("code"), F.col("group_id").alias("owner_id"), F.col("b").alias("block_ids"))


def confidence_conflicts(parts: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """(frame, id column, role or kind column): an unknown role or kind, or else confidence under 0.8."""
    out = None
    for df, owner, kind in parts:
        known = F.col(kind) != "unknown" if kind else F.lit(True)
        one = _conflict(df.where((F.col("confidence") < LEAST) & F.coalesce(known, F.lit(True))), "LOW_CONFIDENCE", owner)
        if kind:
            one = one.unionByName(_conflict(df.where(F.col(kind) == "unknown"), "UNKNOWN_STRUCTURE", owner))
        out = one if out is None else out.unionByName(one)
    return out


def ownership_conflicts(regions: DataFrame) -> DataFrame:
    """A span that several leaf regions own; a span without a start begins at 0.  Names all blocks of those regions."""
    leaf = regions.where(F.col("role").isin(*LEAF_ROLES)).select("doc_id", "region_id", "sources", F.inline("sources"))
    span = ["doc_id", "block_id", F.coalesce("char_start", F.lit(0)).alias("char_start"), "char_end"]
    many = leaf.select(*span, "region_id", _blocks_of().alias("b")).groupBy("doc_id", "block_id", "char_start", "char_end").agg(
        F.array_sort(F.collect_set("region_id")).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("b")))).alias("b")).where(F.size("r") > 1)
    return many.select("doc_id", F.lit("OVERLAPPING_OWNERSHIP").alias("code"), F.array_join("r", ",").alias("owner_id"), F.col("b").alias("block_ids"))


def block_coverage(blocks: DataFrame, claims: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outcome of every block that holds text, and MISSING_BLOCK, DANGLING_RELATION and OVERLAPPING_OWNERSHIP conflicts.

    ``claims``: doc_id, block_id, proposal_id, seq, outcome, region_ids (array).  A claim is one outcome on a set of regions, whatever their
    order; claims that agree in both are one.  Conflicts name the proposals that claimed the block.
    """
    named = claims.select("doc_id", F.explode("region_ids").alias("region_id")).distinct()
    lost = named.join(regions.select("doc_id", "region_id"), ["doc_id", "region_id"], "left_anti").withColumn("__lost", F.lit(True))
    wrong = claims.select("doc_id", "block_id", F.explode("region_ids").alias("region_id")).join(lost, ["doc_id", "region_id"]).select("doc_id", "block_id", "__lost").distinct()
    key = F.concat_ws(":", "outcome", F.array_join(F.array_sort("region_ids"), ","))
    first = F.min(F.struct("seq", "outcome", "region_ids"))
    per = claims.groupBy("doc_id", "block_id").agg(
        F.count_distinct(key).alias("n"), first.alias("c"), F.array_sort(F.collect_set("proposal_id")).alias("proposal_ids"))
    out = blocks.where(F.trim("raw_text") != "").select("doc_id", "block_id").distinct().join(per, ["doc_id", "block_id"], "left").join(wrong, ["doc_id", "block_id"], "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("__lost"), "dangling").when(F.col("n") > 1, "conflict").otherwise("mapped")
    out = out.withColumn("state", state)
    code = F.when(F.col("state") == "missing", "MISSING_BLOCK").when(F.col("state") == "dangling", "DANGLING_RELATION").otherwise("OVERLAPPING_OWNERSHIP")
    block = F.col("block_id").cast("string")
    conflicts = out.where("state <> 'mapped'").select("doc_id", code.alias("code"), block.alias("owner_id"), F.array(block).alias("block_ids"), "proposal_ids")
    kind = F.when((F.col("state") != "mapped") | (F.col("c.outcome") == "unknown"), "issue").otherwise(F.col("c.outcome"))
    return out.select("doc_id", "block_id", "state", kind.alias("outcome"), F.when(F.col("state") == "mapped", F.array_distinct("c.region_ids")).alias("region_ids")), conflicts


def with_fallback_blocks(conflicts: DataFrame, regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """A conflict without blocks takes its region's, else the document's first non-blank block, else a placeholder."""
    own = regions.select("doc_id", F.col("region_id").alias("owner_id"), _blocks_of().alias("__own"))
    first = blocks.where(F.trim("raw_text") != "").groupBy("doc_id").agg(F.min_by(F.col("block_id").cast("string"), "ord").alias("__first"))
    df = conflicts.join(own, ["doc_id", "owner_id"], "left").join(first, "doc_id", "left")
    picked = F.when(F.size("block_ids") > 0, F.col("block_ids")).when(F.size("__own") > 0, F.col("__own")).otherwise(F.array(F.coalesce("__first", F.lit("document"))))
    return df.withColumn("block_ids", picked).drop("__own", "__first")


def conflict_id(code: Column, block_ids: Column, proposal_ids: Column) -> Column:
    """The name of a conflict: its code, its blocks and its proposals, in order and each once."""
    def listed(ids: Column, none: str) -> Column:
        once = F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))
        return F.when(F.size(once) > 0, F.array_join(once, "|")).otherwise(none)

    return F.concat_ws(":", F.lit("conflict"), code, listed(block_ids, "unresolved:block"), listed(proposal_ids, "unresolved:proposal"))


def finalize_structure(docs: DataFrame, groups: DataFrame, exercises: DataFrame, conflicts: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conflicts with ids, each once, and the status of every document.

    ``docs``: doc_id, proposal_ids; a conflict without ``proposal_ids`` is one of all proposals of its document.  Documents without any
    group or any exercise, groups without exercises and exercises without fields are INVALID_INTERACTION; the first names the document's first
    block with text.
    """
    empty = groups.join(exercises.select("doc_id", "group_id").distinct(), ["doc_id", "group_id"], "left_anti")
    bare = exercises.where("coalesce(n_fields, 0) = 0")
    whole = groups.select("doc_id").distinct().join(exercises.select("doc_id").distinct(), "doc_id")
    first = blocks.where(F.trim("raw_text") != "").groupBy("doc_id").agg(F.min_by(F.col("block_id").cast("string"), "ord").alias("__first"))
    void = docs.join(whole, "doc_id", "left_anti").join(first, "doc_id", "left").withColumn("owner_id", F.concat(F.lit("document:"), F.col("doc_id").cast("string")))
    void = _conflict(void, "INVALID_INTERACTION", "owner_id", F.array(F.coalesce("__first", "owner_id")))
    all_ = conflicts.unionByName(void, allowMissingColumns=True)
    for part, owner in ((empty, "group_id"), (bare, "exercise_id")):
        # blocks are not known here: the owner stands for them, so that each keeps a conflict of its own
        all_ = all_.unionByName(_conflict(part, "INVALID_INTERACTION", owner, F.array(F.col(owner).cast("string"))), allowMissingColumns=True)
    own = F.col("proposal_ids") if "proposal_ids" in all_.columns else F.lit(None).cast("array<string>")
    all_ = all_.withColumn("__own", own).drop("proposal_ids").join(docs.select("doc_id", "proposal_ids"), "doc_id", "left")
    all_ = all_.withColumn("proposal_ids", F.coalesce("__own", "proposal_ids")).drop("__own")
    all_ = all_.withColumn("conflict_id", conflict_id(F.col("code"), F.col("block_ids"), F.col("proposal_ids"))).dropDuplicates(["doc_id", "conflict_id"])
    n = all_.groupBy("doc_id").agg(F.count("*").alias("n_conflicts"))
    status = docs.select("doc_id").join(n, "doc_id", "left").select(
        "doc_id", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), F.when(F.col("n_conflicts") > 0, "needsReview").otherwise("valid").alias("status"))
    return all_, status


def structure_violations(blocks: DataFrame, outcomes: DataFrame, status: DataFrame) -> DataFrame:
    """Blocks without or with several outcomes, outcomes of no block, valid documents with conflicts."""
    counted = outcomes.groupBy("doc_id", "block_id").agg(F.count("*").alias("n"))
    both = blocks.select("doc_id", "block_id").distinct().withColumn("b", F.lit(True)).join(counted, ["doc_id", "block_id"], "full_outer")
    code = F.when(F.col("b").isNull(), "OUTCOME_OF_NO_BLOCK").when(F.col("n").isNull(), "BLOCK_WITHOUT_OUTCOME").when(F.col("n") > 1, "SEVERAL_OUTCOMES")
    cover = both.withColumn("code", code).where("code is not null").select("doc_id", F.col("block_id").cast("string").alias("entity_id"), "code")
    state = status.where("status = 'valid' and n_conflicts > 0").select("doc_id", F.lit(None).cast("string").alias("entity_id"), F.lit("VALID_WITH_CONFLICTS").alias("code"))
    return cover.unionByName(state)


def upcast_structure(structures: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structures as version 1.1.0, and legacy ones rejected because they hold newer codes."""
    newer = conflicts.where(~F.col("code").isin(*LEGACY_CODES)).select("doc_id").distinct().withColumn("__new", F.lit(True))
    df = structures.join(newer, "doc_id", "left").withColumn("__bad", (F.col("schema_version") == "1.0.0") & F.coalesce("__new", F.lit(False)))
    good = df.where("not __bad").withColumn("schema_version", F.when(F.col("schema_version") == "1.0.0", "1.1.0").otherwise(F.col("schema_version")))
    bad = df.where("__bad").select("doc_id", F.lit("LEGACY_WITH_NEW_CODES").alias("code"))
    return good.drop("__new", "__bad"), bad

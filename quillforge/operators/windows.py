"""Structural windows and the proposals made for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    blocks: int = 64
    tokens: int = 12_000
    overlap: int = 8
    version: str = "1.0.0"


def window_errors(blocks: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Repeated block ids and blocks over the token bound."""
    twice = blocks.groupBy("doc_id", "block_id").count().where("count > 1").select("doc_id", "block_id", F.lit("DUPLICATE_BLOCK").alias("code"))
    large = blocks.where(F.length("raw_text") > p.tokens).select("doc_id", "block_id", F.lit("BLOCK_TOO_LARGE").alias("code"))
    return twice.unionByName(large)


def plan_windows(blocks: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Overlapping windows of each document's non-blank blocks, bounded in blocks and tokens.

    Where a window that begins at a block ends, and where the next one begins, is a range over running sizes, so it is known for all blocks at once;
    the blocks that do begin one are found by a fold over those positions, in the JVM.  Documents with errors are left out.  Returns doc_id,
    window, first and last position, tokens and the ordered block ids.
    """
    usable = blocks.where(F.trim("raw_text") != "").join(window_errors(blocks, p).select("doc_id").distinct(), "doc_id", "left_anti")
    sized = usable.select("doc_id", F.col("block_id").cast("string").alias("block_id"), "ord", F.greatest(F.length("raw_text"), F.lit(1)).cast("long").alias("size"))
    order = W.partitionBy("doc_id").orderBy("ord")
    sized = sized.withColumn("at", (F.row_number().over(order) - 1).cast("int")).withColumn("before", F.sum("size").over(order) - F.col("size"))
    whole = W.partitionBy("doc_id")
    # the last block that begins within the bound does not fit, unless the document ends within it
    reach = F.max("at").over(W.partitionBy("doc_id").orderBy("before").rangeBetween(0, p.tokens))
    fits = F.col("total") - F.col("before") <= p.tokens
    ends = sized.withColumn("total", F.sum("size").over(whole)).withColumn("n", F.count("*").over(whole).cast("int")).withColumn("reach", reach)
    ends = ends.withColumn("end", F.least(F.when(fits, F.col("n")).otherwise(F.col("reach")), F.col("at") + p.blocks).cast("int"))
    then = F.greatest(F.col("at") + 1, F.col("end") - F.least(F.lit(p.overlap), F.col("end") - F.col("at") - 1))
    ends = ends.withColumn("then", F.when(F.col("end") < F.col("n"), then).cast("int"))
    folded = ends.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "end", "then"))).alias("steps")).withColumn("begins", F.expr(
        """aggregate(steps, named_struct('due', 0, 'out', cast(array() as array<struct<first: int, end: int>>)), (a, x) -> if(x.at = a.due,
           named_struct('due', x.then, 'out', concat(a.out, array(named_struct('first', x.at, 'end', x.end)))), a), a -> a.out)"""))
    spans = folded.select("doc_id", F.posexplode("begins").alias("window", "w")).select("doc_id", "window", "w.first", (F.col("w.end") - 1).alias("last"))
    members = spans.select("*", F.explode(F.sequence("first", "last")).alias("at")).join(sized.select("doc_id", "at", "block_id", "size"), ["doc_id", "at"])
    return members.groupBy("doc_id", "window", "first", "last").agg(
        F.sum("size").cast("int").alias("tokens"), F.array_sort(F.collect_list(F.struct("at", "block_id"))).alias("b")).select(
        "doc_id", "window", "first", "last", "tokens", F.col("b.block_id").alias("block_ids"))


def window_overlaps(windows: DataFrame) -> DataFrame:
    """Block ids shared with the windows before and after, and a stable window id."""
    order = W.partitionBy("doc_id").orderBy("window")
    none = F.array().cast("array<string>")
    shared = lambda other: F.coalesce(F.array_intersect("block_ids", other), none)
    return windows.withColumn("shared_before", shared(F.lag("block_ids").over(order))).withColumn("shared_after", shared(F.lead("block_ids").over(order))).withColumn(
        "window_id", F.sha2(F.concat_ws("\0", F.col("doc_id").cast("string"), F.array_join("block_ids", "\0")), 256))


def window_requests(windows: DataFrame, blocks: DataFrame, model: str, p: Profile = Profile()) -> DataFrame:
    """One request a window: versions and its blocks in order, as JSON."""
    parts = windows.select("doc_id", "window", "window_id", F.posexplode("block_ids").alias("n", "block_id"))
    parts = parts.join(blocks.select("doc_id", F.col("block_id").cast("string").alias("block_id"), "raw_text"), ["doc_id", "block_id"])
    out = parts.groupBy("doc_id", "window", "window_id").agg(F.array_sort(F.collect_list(F.struct("n", "block_id", "raw_text"))).alias("blocks"))
    body = F.to_json(F.struct(F.lit(p.version).alias("profileVersion"), F.lit(model).alias("model"), F.col("window_id").alias("windowId"), "blocks"))
    return out.select("doc_id", "window", "window_id", F.size("blocks").alias("n_blocks"), body.alias("request"))


ENVELOPE = ("doc_id", "ir_id", "profile_version", "prompt_version", "model", "schema_version", "window_id")


def check_proposals(proposals: DataFrame, requests: DataFrame, refs: DataFrame, members: DataFrame) -> DataFrame:
    """Envelope fields that differ from the request, and references to blocks outside the window.

    ``refs``: proposal_id, window_id, block_id; ``members``: window_id, block_id.
    """
    asked = requests.select("window_id", *[F.col(c).alias(f"q_{c}") for c in ENVELOPE if c != "window_id"])
    met = proposals.join(asked, "window_id", "left")
    wrong = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"q_{c}")), F.lit(c)) for c in ENVELOPE if c != "window_id"]), lambda x: x.isNotNull())
    envelope = met.withColumn("field", F.explode(wrong)).select("proposal_id", F.lit("ENVELOPE_MISMATCH").alias("code"), F.col("field").alias("evidence"))
    outside = refs.join(members, ["window_id", "block_id"], "left_anti").select("proposal_id", F.lit("BLOCK_OUTSIDE_WINDOW").alias("code"), F.col("block_id").alias("evidence"))
    return envelope.unionByName(outside.distinct())

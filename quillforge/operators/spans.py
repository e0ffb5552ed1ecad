"""Overlaps of spans of source blocks, in time that grows with the spans and the overlaps found.

A span without a start begins with its block, one without an end ends with it; spans of unknown blocks are none.  A span is cut into the
dyadic nodes that tile it, its start lies in one node of every level, and two spans overlap iff the start of one lies in a node of the
other.  So an equi-join on the node meets overlapping spans only, a block is spread over its nodes, and no pair is formed in vain.
Nodes of blocks in which very many spans start are met in several tasks.  The spans of a block that has few need no nodes: they are met
and compared as they are, at most ``FEW`` for each span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: spans of a block, of all kinds, up to which they are compared pair by pair
FEW = 16

_NODES = """flatten(transform(sequence(0, levels), k -> filter(array(
  if(shiftright(start + shiftleft(1L, k) - 1, k) < shiftright(end, k) and shiftright(start + shiftleft(1L, k) - 1, k) % 2 = 1,
     struct(k as level, shiftright(start + shiftleft(1L, k) - 1, k) as node), null),
  if(shiftright(start + shiftleft(1L, k) - 1, k) < shiftright(end, k) and shiftright(end, k) % 2 = 1,
     struct(k as level, shiftright(end, k) - 1 as node), null)), x -> x is not null)))"""
_POINTS = "transform(sequence(0, levels), k -> struct(k as level, shiftright(start, k) as node))"


def placed(blocks: DataFrame, *spans: DataFrame) -> list[DataFrame]:
    """Each of ``spans`` (doc_id, block_id, char_start, char_end, ...) of known blocks with ``start`` and ``end``, each row once.

    ``blocks``: doc_id, block_id, raw_text.  Spans that hold no text are left out.  ``levels``, ``few`` and ``most`` say of the block how many
    levels its nodes have, whether few spans lie in it and how many lie in it; they come with the join that finds the block.
    """
    # blocks and spans meet in one aggregate
    size = blocks.select("doc_id", "block_id", F.length("raw_text").alias("__n"), F.lit(None).cast("int").alias("__end"), F.lit(0).alias("__s"))
    for s in spans:
        size = size.unionByName(s.select("doc_id", "block_id", F.lit(None).cast("int").alias("__n"), F.col("char_end").alias("__end"), F.lit(1).alias("__s")))
    known = size.groupBy("doc_id", "block_id").agg(F.max("__n").alias("__n"), F.max("__end").alias("__end"), F.sum("__s").alias("most")).where("__n is not null and most > 0").select(
        "doc_id", "block_id", "__n", "most", (F.col("most") <= FEW).alias("few"), F.length(F.bin(F.greatest("__n", F.coalesce("__end", F.lit(0))).cast("long"))).alias("levels"))
    out = []
    for s in spans:
        df = s.join(known, ["doc_id", "block_id"])
        df = df.withColumn("start", F.coalesce("char_start", F.lit(0)).cast("long")).withColumn("end", F.coalesce("char_end", "__n").cast("long"))
        out.append(df.where("start < end and start >= 0").drop("char_start", "char_end", "__n").distinct())
    return out


def stabbed(left: DataFrame, right: DataFrame, keys: list[str], node_rows: int = 200_000) -> DataFrame:
    """Pairs of placed spans that agree on ``keys``, doc_id and block_id among them, in which the right one starts inside the left one.

    Columns of ``keys``, then the others of both sides under ``l_`` and ``r_``.  A block with more than ``node_rows`` spans is met in parts.
    """
    whole = "if(few, array(struct(-1 as level, 0L as node)), {0})"
    parts = F.ceil(F.col("most") / node_rows).cast("int")

    def side(df: DataFrame, mark: str, nodes: str, part) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, "levels", "few", "most")]
        return df.select(*keys, *[F.col(c).alias(mark + c) for c in rest], part(rest), F.inline(F.expr(whole.format(nodes))))

    a = side(left, "l_", _NODES, lambda _: F.sequence(F.lit(0), parts - 1).alias("__parts"))
    a = a.withColumn("__part", F.explode("__parts")).drop("__parts")
    b = side(right, "r_", _POINTS, lambda rest: F.pmod(F.xxhash64(*rest), parts).cast("int").alias("__part"))
    return a.join(b, [*keys, "level", "node", "__part"]).where("r_start >= l_start and r_start < l_end").drop("level", "node", "__part")

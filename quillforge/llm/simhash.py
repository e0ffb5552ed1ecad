"""SimHash near-duplicate groups through an index of fingerprint bytes.

Fingerprints of 64 bits are eight byte positions.  Two that differ in at most ``bits`` bits differ in at
most ``bits`` bytes, so they share at least 8 - bits positional bytes (4 for the default of 4): the
guaranteed minimum.  A posting list of one (position, byte) holds 1/256 of all fingerprints, and its
pairs grow with the square of the input; so the index lists fingerprints under several positional bytes
at once.  Its position sets are chosen so that every possible set of ``8 - bits`` shared positions contains
one of them (20 triples for 4), hence every qualifying pair meets in some list, and random pairs meet
with chance 2^-24 each.  For each pair that meets, the shared positional bytes are tallied, pairs with
fewer than the minimum are dropped, and the rest are verified by Hamming distance.

Groups are what is asked for, so a list gives the links of a spanning forest of its verified pairs, not
every pair: a search from one fingerprint compares only with those not yet reached.  Equal fingerprints are one
entry from the start.  Lists longer than ``list_rows`` are cut into blocks and every pair of
blocks is searched, so no task holds more than two blocks and no link is lost.

Edge cases: null or blank texts have fingerprint zero and are linked like any other; texts of fewer
than four words are one shingle; repeated rows return a row each, and rows with equal ids are one
document, so their fingerprints are linked; a row with null id gets its fingerprint and the group of that
fingerprint, if any, but links nothing; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, salted_join, salts, stage


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash over word shingles; words are split at ASCII white space and A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - width].tolist()]
        stops = (ends[width - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[i:j], 42) for i, j in zip(starts, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed 64-bit integer."""

    def of(rows):
        for batch in rows:
            values = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(of, "id bigint, fp bigint")


def position_sets(bits: int, positions: int = 8) -> list[tuple[int, ...]]:
    """Position sets such that every set of ``positions - bits`` positions contains one of them.

    For four shared positions: deal the positions to three groups in a ring; a triple is chosen if it
    lies in one group, or has two positions in a group and one in the next.  Any four positions
    contain such a triple, and 20 triples do for eight positions.  For other distances the sets are
    found greedily, one position smaller than the guaranteed minimum.
    """
    shared = positions - bits
    if shared < 1:
        raise ValueError("fingerprints may share no byte at that distance")
    if shared == 4:
        chosen = []
        for c in combinations(range(positions), 3):
            groups = [p % 3 for p in c]
            if any(groups.count(g) == 3 or groups.count(g) == 2 and groups.count((g + 1) % 3) == 1 for g in range(3)):
                chosen.append(c)
        return chosen
    size = max(1, shared - 1)
    open_sets = {frozenset(c) for c in combinations(range(positions), shared)}
    chosen = []
    while open_sets:
        best = max(combinations(range(positions), size), key=lambda c: sum(s.issuperset(c) for s in open_sets))
        chosen.append(best)
        open_sets = {s for s in open_sets if not s.issuperset(best)}
    return chosen


def _tally(x: np.ndarray) -> np.ndarray:
    """Positional bytes that the two fingerprints of each XOR share."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _near(x: np.ndarray, bits: int) -> np.ndarray:
    """Which XORs pass the count filter and then the distance itself."""
    kept = np.flatnonzero(_tally(x) >= 8 - bits)
    return kept[np.bitwise_count(x[kept]) <= bits]


def forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Index pairs that connect what links of at most ``bits`` bits connect.

    Searches breadth-first; a fingerprint is compared with those not reached yet only.
    """
    rest = np.arange(len(fp))
    found = []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            near = _near(fp[rest] ^ fp[i], bits)
            if len(near):
                found += [(i, int(j)) for j in rest[near]]
                front += rest[near].tolist()
                rest = np.delete(rest, near)
    return found


def _linker(bits: int):
    """Links of the posting lists in a partition sorted by list; lists of two are compared at once."""

    def of_lists(table):
        cols = [table.column(c).to_numpy() for c in ("set", "bytes", "i", "j")]
        fp, node = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy()
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0)))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(fp)))
        two = begin[size == 2]
        two = two[_near(fp[two] ^ fp[two + 1], bits)]
        a, b = [node[two]], [node[two + 1]]
        for s, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
            found = np.array(forest(fp[s : s + n], bits), np.int64).reshape(-1, 2) + s
            a.append(node[found[:, 0]])
            b.append(node[found[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], ["a", "b"])

    def link(rows):
        held = None
        for batch in rows:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            last = np.ones(table.num_rows, bool)
            for c in ("set", "bytes", "i", "j"):
                x = table.column(c).to_numpy()
                last &= x == x[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            held = table.slice(cut)
            if cut:
                yield of_lists(table.slice(0, cut))
        if held is not None and held.num_rows:
            yield of_lists(held)

    return link


def links(nodes: DataFrame, bits: int = 4, list_rows: int = 20_000, key_rows: int = 500_000) -> DataFrame:
    """Links (``a``, ``b``) that connect all distinct fingerprints within ``bits`` bits.

    ``nodes``: one row for each distinct ``fp`` with its ``node`` id.  A list of over ``key_rows`` learns its
    length in several tasks.
    """
    if nodes.isEmpty():
        return nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    sets = position_sets(bits)
    masks = [sum(0xFF << (8 * p) for p in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    index = nodes.select("node", "fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("set"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bytes"))
        for i, m in enumerate(signed)])).alias("k")).select("k.set", "k.bytes", "node", "fp")
    lists = stage(index.groupBy("set", "bytes").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    parts = salts(lists.agg(F.max("n")).first()[0], key_rows)
    lists = lists.withColumn("blocks", F.ceil(F.col("n") / list_rows).cast("int"))
    index = salted_join(index, lists, ["set", "bytes"], F.xxhash64("node"), parts)
    # a list of one block is one task's; of a longer one, every pair of blocks meets somewhere
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    index = index.withColumn("own", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    index = index.select("set", "bytes", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp")
    key = ["set", "bytes", "i", "j"]
    return index.repartition(*key).sortWithinPartitions(*key).mapInArrow(_linker(bits), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", width: int = 4, key_rows: int = 500_000
) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    The component is the smallest id reachable over links; copies are joined through their fingerprint.
    A fingerprint of over ``key_rows`` rows is joined in several tasks.
    """
    prints = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("n")), "nodes")
    parts = salts(nodes.agg(F.max("n")).first()[0], key_rows)
    nodes = nodes.where("node is not null").select("fp", "node")
    # one id may have several texts: its fingerprints are then one document's
    repeats = salted_join(prints.where("id is not null").select("id", "fp").distinct(), nodes, ["fp"], F.xxhash64("id"), parts)
    repeats = repeats.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    several = prints.where("id is not null").groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    extra = repeats.join(several.select(F.col("id").alias("a")), "a", "left_semi")
    found = components(links(nodes, bits, key_rows=key_rows).unionByName(extra), hub_rows=key_rows)
    nodes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    salt = F.coalesce("id", F.monotonically_increasing_id())  # rows without an id share nothing else
    return salted_join(prints, nodes, ["fp"], F.xxhash64(salt), parts, "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row of each near-duplicate group: its smallest id.  Rows without an id stay as they are.

    The ids kept grow with the input, so the join is a merge join at every size.
    """
    groups = near_duplicates(docs, bits, id_col, text_col, width)
    firsts = stage(groups.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("n")), "firsts")
    kept = docs.join(firsts.hint("merge"), id_col, "left_semi").select(docs.columns)
    if not firsts.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))

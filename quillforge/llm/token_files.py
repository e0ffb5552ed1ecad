"""Token ids in grammar-compressed files with random access to every document.

Documents are dealt in ascending id order to range partitions and encoded into blocks.  In each
block, Re-Pair replaces the most frequent pairs of neighbouring ids by new symbols (nonterminals),
many pairs at a time, until no pair repeats often enough or the 16-bit symbol space is used up.
No pair holds the end id, so a document is a whole number of symbols.  A file row (Parquet, binary columns)
holds one block: document ids, their token and symbol counts, the rules, the expansion length of
every symbol above the vocabulary, and the symbols.  A document, or a range of its tokens, is decoded
from its own symbols and the rules alone.

Edge cases: null text is empty and still has its end id; null ids sort first; repeated ids keep
all their rows, ordered by text; an empty table writes an empty file; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, fresh_path, input_bytes
from .pieces import batches, loaded, spread

BLOCK_SCHEMA = (
    "part int, block int, base int, n_tokens bigint, doc_ids binary, has_id binary, doc_tokens binary,"
    " doc_symbols binary, rules binary, expansions binary, symbols binary"
)


def _first_of_overlaps(at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Drops every second match of runs of matches that overlap (position p and p + 1)."""
    run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    in_run = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    return at[in_run % 2 == 0]


def compress(ids: np.ndarray, base: int, end_id: int, rounds: int = 5, per_round: int = 4096, least: int = 12):
    """Re-Pair over uint16 ids below ``base``: rules (left, right) in order, and the symbols.

    Each round counts all neighbouring pairs and replaces up to ``per_round`` of the most frequent,
    left to right; a pair must occur ``least`` times to pay for its rule.
    """
    symbols, rules, top = ids, [], base
    bits = 14
    for _ in range(rounds):
        room = min(per_round, (1 << 16) - top)
        if room <= 0 or len(symbols) < 2:
            break
        left, right = symbols[:-1], symbols[1:]
        keys = (left.astype(np.uint32) << np.uint32(16)) | right
        usable = (left != end_id) & (right != end_id)
        ordered = np.sort(keys[usable])
        if not len(ordered):
            break
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(heads, len(ordered)))
        often = np.flatnonzero(counts >= least)
        often = often[np.argsort(-counts[often], kind="stable")[: 2 * room]]
        pairs = ordered[heads[often]]
        # one slot for each pair, the more frequent first; the others wait for the next round
        slot = (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        _, kept = np.unique(slot, return_index=True)
        kept = np.sort(kept)[:room]
        pairs, slot = pairs[kept], slot[kept]
        if not len(pairs):
            break
        table = np.zeros(1 << bits, np.uint32)
        number = np.zeros(1 << bits, np.uint16)
        known = np.zeros(1 << bits, bool)
        table[slot], number[slot], known[slot] = pairs, (top + np.arange(len(pairs))).astype(np.uint16), True
        where = (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        at = np.flatnonzero((table[where] == keys) & known[where])
        at = _first_of_overlaps(at, symbols)
        symbols = symbols.copy()
        symbols[at] = number[where[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        rules.append(np.stack([pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)], 1).astype(np.uint16))
        top += len(pairs)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)), symbols


def _rounds(rules: np.ndarray, base: int):
    """Runs of rules that only use symbols made before the run."""
    highest = rules.max(axis=1, initial=0).astype(np.int64)
    done = 0
    while done < len(rules):
        later = highest[done:] >= base + done
        ready = done + int(later.argmax()) if later.any() else len(rules)
        yield done, ready
        done = ready


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Tokens behind each nonterminal; a rule only uses symbols made before its own round."""
    size = np.ones(base + len(rules), np.int64)
    for done, ready in _rounds(rules, base):
        size[base + done : base + ready] = size[rules[done:ready, 0]] + size[rules[done:ready, 1]]
    return size[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids behind symbols: expansions of all rules are laid out once, then gathered."""
    start = np.arange(base + len(rules), dtype=np.int64)
    size = np.concatenate((np.ones(base, np.int64), lengths.astype(np.int64)))
    store, at = np.arange(base, dtype=np.uint16), base
    for done, ready in _rounds(rules, base):
        two = rules[done:ready].astype(np.int64).reshape(-1)
        new = store[spread(start[two], size[two])]
        own = size[base + done : base + ready]
        start[base + done : base + ready] = at + np.cumsum(own) - own
        store, at = np.concatenate((store, new)), at + len(new)
    s = symbols.astype(np.int64)
    return store[spread(start[s], size[s])]


def _writer(tokenizer: str, style: str, end_id: int, base: int, block_chars: int):
    def write(rows):
        encoder = loaded(tokenizer, style)
        block = 0
        for batch in rows:
            keys = batch.column(0)
            texts = batch.column(1).to_pylist()
            for begin, part in batches([t or "" for t in texts], block_chars):
                ids, counts = encoder.encode(part)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint16(end_id))
                counts = counts + 1
                rules, symbols = compress(ids, base, end_id)
                sizes = expansion_lengths(rules, base)
                size = np.concatenate((np.ones(base, np.int64), sizes))
                upto = np.cumsum(size[symbols])
                n_symbols = np.diff(np.searchsorted(upto, np.cumsum(counts), side="left") + 1, prepend=0)
                own = keys.slice(begin, len(part))
                has = np.array([v is not None for v in own.to_pylist()], np.uint8)
                number = np.array([v or 0 for v in own.to_pylist()], "<i8")
                yield pa.RecordBatch.from_pylist([{
                    "part": TaskContext.get().partitionId(), "block": block, "base": base, "n_tokens": len(ids),
                    "doc_ids": number.tobytes(), "has_id": has.tobytes(), "doc_tokens": counts.astype("<i8").tobytes(),
                    "doc_symbols": n_symbols.astype("<i8").tobytes(), "rules": rules.astype("<u2").tobytes(),
                    "expansions": sizes.astype("<u4").tobytes(), "symbols": symbols.astype("<u2").tobytes(),
                }], schema=_ARROW)
                block += 1

    return write


_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("base", pa.int32()), ("n_tokens", pa.int64()),
    *[(n, pa.binary()) for n in ("doc_ids", "has_id", "doc_tokens", "doc_symbols", "rules", "expansions", "symbols")],
])


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str = "byte_bpe_50k.json",
    style: str = "bytes",
    end_id: int = 2,
    base: int = 50_257,
    partition_bytes: int = 24 << 20,
    block_chars: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the ids of all documents in ascending id order.

    ``base`` is the tokenizer's id count; ``partition_bytes`` of text go to one task, ``block_chars``
    to one grammar.
    """
    parts = max(1, -(-input_bytes(docs, text_col) // partition_bytes))
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = dealt.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    dealt.mapInArrow(_writer(tokenizer, style, end_id, base, block_chars), BLOCK_SCHEMA).write.parquet(path)


class Block:
    """One block of a file; decodes all, one document, or a range of a document's tokens."""

    def __init__(self, row: dict):
        self.base = row["base"]
        self.ids = [i if h else None for i, h in zip(
            np.frombuffer(row["doc_ids"], "<i8").tolist(), np.frombuffer(row["has_id"], np.uint8).tolist())]
        self.tokens = np.frombuffer(row["doc_tokens"], "<i8")
        self.n_symbols = np.frombuffer(row["doc_symbols"], "<i8")
        self.rules = np.frombuffer(row["rules"], "<u2").reshape(-1, 2)
        self.lengths = np.frombuffer(row["expansions"], "<u4")
        self.symbols = np.frombuffer(row["symbols"], "<u2")

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.lengths, self.base)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens ``start`` to ``stop`` of the block's k-th document, from the symbols they need."""
        at = int(self.n_symbols[:k].sum())
        own = self.symbols[at : at + int(self.n_symbols[k])]
        size = np.ones(len(own), np.int64)
        high = own >= self.base
        size[high] = self.lengths[own[high].astype(np.int64) - self.base]
        upto = np.cumsum(size)
        stop = int(self.tokens[k]) if stop is None else min(stop, int(self.tokens[k]))
        i = int(np.searchsorted(upto, start, side="right"))
        j = int(np.searchsorted(upto, stop, side="left")) + 1
        skipped = int(upto[i - 1]) if i else 0
        return expand(own[i:j], self.rules, self.lengths, self.base)[start - skipped : stop - skipped]


def _reader(with_ids: bool):
    def read(rows):
        for batch in rows:
            for row in batch.to_pylist():
                block = Block(row)
                ids = block.all_ids().astype("<u4")
                ends = np.cumsum(block.tokens)
                starts = ends - block.tokens
                n = len(ends)
                out = {
                    "part": pa.array([row["part"]] * n, pa.int32()), "block": pa.array([row["block"]] * n, pa.int32()),
                    "place": pa.array(np.arange(n), pa.int64()), "doc_id": pa.array(block.ids, pa.int64()),
                    "before": pa.array(starts, pa.int64()), "n_tokens": pa.array(block.tokens, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[i:j].tobytes()) for i, j in zip(starts, ends)], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return read


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (and ``ids``) of every document of a file.

    ``start`` adds the tokens of all earlier blocks; the prefix sum runs over one small row for each block.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    fields = "part int, block int, place bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
    docs = blocks.mapInArrow(_reader(with_ids), fields + (", ids array<int>" if with_ids else ""))
    by_part = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    parts = by_part.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("part_start"))
    inside = W.partitionBy("part").orderBy("block")
    heads = blocks.select("part", "block", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("block_start"))
    heads = heads.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("head"))
    return docs.join(heads, ["part", "block"]).select(
        "doc_id", (F.col("head") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    write_ids(documents(spark, sf_dir), path)
    return read_ids(spark, path, with_ids=False)

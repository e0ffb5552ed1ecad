"""Exact repeats across documents by longest-previous-factor arrays, keeping the first copy.

A byte goes if it lies in a ``width``-byte string that also starts in a document with a smaller id.
Suffixes are sorted in shards: only suffixes that can share ``width`` bytes need to meet, and those share a
window minimum.  Steps:

1. Every ``width``-byte window has a minimal ``gram``-byte gram (by hash).  Successive windows with the same minimum
   form a run; equal windows lie in runs of equal minimum.  A shard of documents gives each distinct
   (minimum, span of the run) once, with its smallest id, to the bucket of the minimum.
2. A bucket sees all shards.  A whole span that occurs with a smaller id is covered: its factors are known to reach
   ``width``, so it is not sorted.  A minimum with several spans and ids needs a closer look: the first document of each
   such span sends its bytes.  If a minimum has very many spans (a common line in different surroundings), their windows
   are sent one by one, once for each shard, to the bucket of the window's own hash.
3. The bucket sorts all suffixes of these spans and takes the common prefix of neighbours.  The previous and the next
   smaller position of a suffix, by document id, are the candidates for its earlier match; the longer of the two common prefixes is
   its longest previous factor.  Where that reaches ``width``, the window is covered.
4. Each shard unites its covered windows and drops their bytes.

Inside a shard spans and windows are compared byte by byte.  Across shards step 2 takes two spans for equal if their
minima agree in 48 bits and their hashes in 64; step 3 compares bytes.

Rows exchanged are blocks of packed numbers, one for each shard and bucket.  A string that is in a
third of all documents reaches its bucket once for each shard, with its smallest id.

Edge cases: null text is empty; texts shorter than ``width`` keep every byte; rows with equal ids are
the same document and never cover each other; rows with null id are left as they are and cover
nothing; an empty table gives no rows; other columns are ignored; a document of any length is one shard's.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, input_bytes
from .pieces import spread

GRAM = 20
_STEP = 1 << 19  # windows hashed, or suffixes sorted, at a time
_SIDE = 4 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words8(buffer: np.ndarray, n: int, offset: int) -> np.ndarray:
    """The little-endian 8-byte words that start at offset, offset + 1, ... (n of them)."""
    return np.ndarray((n,), "<u8", buffer, offset, (1,)).copy()


def _gathered(buffer: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each position; the last word overlaps the one before."""
    view = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))
    out = np.full(len(at), size, np.uint64)
    for o in [*range(0, size - 8, 8), size - 8]:
        out = _mix(out * _U(0x9E3779B97F4A7C15) + view[at + o])
    return out


def runs(buffer: np.ndarray, begins: np.ndarray, width: int, gram: int):
    """Runs of windows with the same minimal gram: minimum, first window, number of windows, document.

    ``buffer``: all texts joined, ``begins``: where each begins, with the end.  Runs stay within a
    document and within ``width - gram + 1`` windows; none is lost where a slice of the buffer ends.
    """
    n = int(begins[-1])
    span = width - gram + 1
    parts = []
    for lo in range(0, n - width + 1, _STEP):
        hi = min(n - width + 1, lo + _STEP)  # windows lo .. hi - 1
        grams = hi - lo + span - 1
        h = _mix(_words8(buffer, grams, lo) * _U(0x9E3779B97F4A7C15) + _U(gram))
        for o in [*range(8, gram - 8, 8), gram - 8]:
            h = _mix(h ^ _words8(buffer, grams, lo + o))
        m, have = h, 1
        while have < span:
            move = min(have, span - have)
            m = np.minimum(m[: len(m) - move], m[move:])
            have += move
        new = np.concatenate(([True], m[1:] != m[:-1]))
        heads = begins[(begins > lo) & (begins < hi)] - lo
        new[heads] = True
        # the windows that would cross into the next document are no windows
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(m)))
        at, low = at + lo, m[at]
        doc = np.searchsorted(begins, at, side="right") - 1
        size = np.minimum(size, begins[doc + 1] - width + 1 - at)
        keep = size > 0
        at, low, doc, size = at[keep], low[keep], doc[keep], size[keep]
        pieces = -(-size // span)
        if (pieces > 1).any():
            step = spread(np.zeros(len(at), np.int64), pieces) * span
            at, low, doc = np.repeat(at, pieces) + step, np.repeat(low, pieces), np.repeat(doc, pieces)
            size = np.minimum(np.repeat(size, pieces) - step, span)
        parts.append((low, at, size, doc))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*parts))


class Shard:
    """The texts of a shard in one buffer, ordered by document id."""

    def __init__(self, table: pa.Table, width: int):
        ids, row = table.column("id").to_numpy(), table.column("row").to_numpy()
        order = np.lexsort((row, ids))
        again = np.zeros(len(order), bool)  # equal rows are listed once
        again[1:] = (np.diff(ids[order]) == 0) & (np.diff(row[order]) == 0)
        order = order[~again]
        texts = table.column("text").to_pylist()
        raws = [texts[i].encode("utf-8", "surrogatepass") for i in order]
        self.ids, self.row = ids[order], row[order]
        self.begins = np.concatenate(([0], np.cumsum([len(r) for r in raws]))).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(raws) + bytes(8), np.uint8)
        self.width = width

    def entries(self, buckets: int):
        """Distinct (minimum, span) in order of bucket, with the first document of each, and all runs.

        Returns per entry: bucket, minimum, span hash, id, first run's position; per run: entry, and the run arrays.
        """
        low, at, size, doc = runs(self.buffer, self.begins, self.width, GRAM)
        low = _mix(low)  # minima crowd near zero; mixed, they spread evenly over the buckets
        first = _gathered(self.buffer, at, self.width)
        span = _mix(first * _U(3) + _gathered(self.buffer, at + size - 1, self.width) * _U(5) + size.astype(np.uint64))
        # runs are in document order, so the first of equal ones is of the smallest id
        key = _mix(low ^ (span * _U(0xD6E8FEB86659FD93)))
        _, head, entry = np.unique(key, return_index=True, return_inverse=True)
        bucket = (low[head] >> _U(32)).astype(np.int64) * buckets >> 32
        order = np.lexsort((low[head], bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        head = head[order]
        return bucket[order], low[head], span[head], self.ids[doc[head]], at[head], place[entry], (at, size, doc)

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` (8 at least) bytes at each of two positions are equal."""
        view = np.ndarray((len(self.buffer) - 7,), "<u8", self.buffer, 0, (1,))
        out = np.ones(len(a), bool)
        for o in range(0, int(size.max(initial=0)), 8):
            at = np.minimum(o, size - 8)
            out &= view[a + at] == view[b + at]
        return out


def _planes(x: np.ndarray, size: int) -> bytes:
    """Numbers as byte planes, so that equal high bytes compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _from_planes(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.reshape(-1).view("<u8")


_ENTRY = "bucket int, shard int, n int, low binary, span binary, ids binary"
_STATE = "bucket int, shard int, state binary"
_SPAN = "bucket int, shard int, kind int, ids binary, rows binary, sizes binary, bytes binary"
_RANGE = "shard int, rows binary, starts binary, sizes binary"


def _arrow(fields: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


def _list_entries(width: int, buckets: int):
    """Step 1: a shard's entries, one row for each bucket."""
    schema = _arrow(_ENTRY)

    def work(key, table):
        bucket, low, span, ids, *_ = Shard(table, width).entries(buckets)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[b], cuts[b + 1])
            rows.append({"bucket": int(b), "shard": key[0].as_py(), "n": s.stop - s.start, "low": _planes(low[s], 6),
                         "span": _planes(span[s], 8), "ids": ids[s].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()})
        return pa.Table.from_pylist(rows, schema=schema)

    return work


def _judge(many: int):
    """Step 2: for each entry 0, 1 (covered by a smaller id), 2 (send the span) or 3 (send its windows)."""

    def work(key, table):
        n = table.column("n").to_numpy().astype(np.int64)
        low = np.concatenate([_from_planes(r, 6) for r in table.column("low").to_pylist()])
        span = np.concatenate([_from_planes(r, 8) for r in table.column("span").to_pylist()])
        ids = np.concatenate([_from_planes(r, 8) for r in table.column("ids").to_pylist()]).view("<i8")
        order = np.lexsort((ids, span, low))
        low, span, ids = low[order], span[order], ids[order]
        new_low = np.concatenate(([True], low[1:] != low[:-1]))
        new_span = new_low | np.concatenate(([True], span[1:] != span[:-1]))
        state = np.zeros(len(low), np.uint8)
        first = ids[np.maximum.accumulate(np.where(new_span, np.arange(len(ids)), 0))]
        covered = ids > first
        state[covered] = 1
        # minima with several spans and several ids: one of each span
        heads = np.flatnonzero(new_low)
        spans = np.add.reduceat(new_span.astype(np.int64), heads)
        several = (spans > 1) & (np.minimum.reduceat(ids, heads) < np.maximum.reduceat(ids, heads))
        ask = np.where(several, np.where(spans > many, 3, 2), 0).astype(np.uint8)
        ask = np.repeat(ask, np.diff(np.append(heads, len(low))))
        state[new_span] = ask[new_span]
        out = np.empty(len(state), np.uint8)
        out[order] = state
        cuts = np.concatenate(([0], np.cumsum(n)))
        return pa.table({
            "bucket": table.column("bucket"), "shard": table.column("shard"),
            "state": pa.array([out[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())}, schema=_arrow(_STATE))

    return work


def _send(width: int, buckets: int):
    """Step 3a: covered runs go to their shard's place, spans to be sorted to the bucket of their minimum."""
    schema = _arrow(_SPAN)

    def work(key, table, states):
        name = key[0].as_py()
        if not table.num_rows:
            return schema.empty_table()
        shard = Shard(table, width)
        bucket, low, _, ids, first, entry, (at, size, doc) = shard.entries(buckets)
        state = np.zeros(len(bucket), np.uint8)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b, raw in zip(states.column("bucket").to_pylist(), states.column("state").to_pylist()):
            state[cuts[b] : cuts[b + 1]] = np.frombuffer(raw, np.uint8)
        # a run is covered if its entry is, or if a smaller id of this shard has the same span
        other = np.zeros(len(at), bool)  # runs that share an entry's hash and not its bytes
        again = np.flatnonzero(at != first[entry])
        other[again] = ~shard.same(at[again], first[entry[again]], size[again] + width - 1)
        later = (shard.ids[doc] > ids[entry]) & ~other
        covered = (state[entry] == 1) & ~other | later
        hit = [(at[covered], size[covered], doc[covered])]
        ask = np.flatnonzero((state[entry] == 2) & ~later & ~other)
        sent = [(bucket[entry[ask]], at[ask], size[ask], doc[ask])]
        ask = np.flatnonzero((state[entry] == 3) & ~later | other)
        if len(ask):
            one, whose = spread(at[ask], size[ask]), np.repeat(doc[ask], size[ask])
            h = _gathered(shard.buffer, one, width)
            order = np.lexsort((whose, h))
            one, whose, h = one[order], whose[order], h[order]
            head = np.concatenate(([True], h[1:] != h[:-1]))
            lead = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
            more = shard.ids[whose] > shard.ids[whose[lead]]
            more &= shard.same(one, one[lead], np.full(len(one), width))
            hit.append((one[more], np.ones(more.sum(), np.int64), whose[more]))
            to = (h[~more] >> _U(32)).astype(np.int64) * buckets >> 32
            sent.append((to, one[~more], np.ones((~more).sum(), np.int64), whose[~more]))
        a, n, d = (np.concatenate(c) for c in zip(*hit))
        rows = [{
            "bucket": name % buckets, "shard": name, "kind": 0, "ids": b"", "rows": shard.row[d].astype("<i8").tobytes(),
            "sizes": n.astype("<i4").tobytes(), "bytes": (a - shard.begins[d]).astype("<i8").tobytes()}]
        to, a, n, d = (np.concatenate(c) for c in zip(*sent))
        order = np.argsort(to, kind="stable")
        to, a, n, d = to[order], a[order], n[order], d[order]
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[b], cuts[b + 1])
            rows.append({
                "bucket": int(b), "shard": name, "kind": 1, "ids": shard.ids[d[s]].astype("<i8").tobytes(),
                "rows": np.stack([shard.row[d[s]], a[s] - shard.begins[d[s]]]).astype("<i8").tobytes(),
                "sizes": n[s].astype("<i4").tobytes(), "bytes": shard.buffer[spread(a[s], n[s] + width - 1)].tobytes()})
        return pa.Table.from_pylist(rows, schema=schema)

    return work


def _smaller(own: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each position of a suffix order: the longer of the common prefixes with the
    previous and with the next position that has a smaller ``own``; 0 without one.

    ``lcp[i]`` is the common prefix of positions i - 1 and i, with a 0 at both ends.  Minima over stretches of 1, 2, 4, ...
    positions let all positions walk left, then right, past what isn't smaller, halving their steps.
    """
    n = len(own)
    low, least = [own], [lcp]
    while 2 << len(low) <= 2 * n:
        half = 1 << (len(low) - 1)
        a, b = low[-1].copy(), least[-1].copy()
        a[half:] = np.minimum(low[-1][half:], low[-1][:-half])
        b[half:] = np.minimum(least[-1][half:], least[-1][:-half])
        low.append(a)
        least.append(b)
    left, before = np.arange(n) - 1, lcp[:n].copy()
    right, after = np.arange(n) + 1, lcp[1:].copy()
    for k in range(len(low) - 1, -1, -1):
        step = 1 << k
        at = np.flatnonzero(left >= step - 1)
        at = at[low[k][left[at]] >= own[at]]
        before[at] = np.minimum(before[at], least[k][left[at]])
        left[at] -= step
        at = np.flatnonzero(right + step <= n)
        at = at[low[k][right[at] + step - 1] >= own[at]]
        right[at] += step
        after[at] = np.minimum(after[at], least[k][right[at]])
    return np.maximum(np.where(left >= 0, before, 0), np.where(right < n, after, 0))


def previous_factors(buffer: np.ndarray, at: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """Longest previous factor, up to ``width`` bytes, of the suffixes at ``at``: the longest prefix shared
    with a suffix of a document with a smaller id.

    Suffixes are ordered by their first ``width`` bytes as big-endian words, ties by id.  Of suffixes with equal bytes
    those after the smallest id have a whole factor; the smallest one's comes from its previous and next smaller
    positions.  Over about a million suffixes are sorted in slices of the order, in which factors under 8 bytes count as none.
    """
    view = np.ndarray((len(buffer) - 7,), ">u8", buffer, 0, (1,))
    if len(at) > 2 * _STEP:
        # slices of the suffix order by the first word; a word that many suffixes share stays in one
        first = view[at]
        cuts = np.unique(np.sort(first[:: max(1, len(at) // 65_536)])[:: max(1, 65_536 * _STEP // len(at))])
        part = np.searchsorted(cuts, first, side="right")
        if part.min() < part.max():
            factor = np.zeros(len(at), np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.flatnonzero(np.diff(part[order])) + 1
            for own in np.split(order, ends):
                factor[own] = previous_factors(buffer, at[own], ids[own], width) if len(own) < len(at) else 0
            return factor
    offsets = [*range(0, width - 8, 8), width - 8]
    words = [view[at + o].astype(np.uint64) for o in offsets]
    order = np.lexsort((ids, *words[::-1]))
    same, shared = np.ones(len(at), bool), np.zeros(len(at), np.int16)
    same[0] = False
    for o, w in zip(offsets, words):
        w = w[order]
        apart = w[1:] ^ w[:-1]
        # leading bytes in common
        equal = np.zeros(len(apart), np.int16)
        for bits in range(0, 64, 8):
            equal += apart < _U(1) << _U(bits)
        shared[1:] = np.where(same[1:], o + equal, shared[1:])
        same[1:] &= apart == 0
    own = ids[order]
    heads = np.flatnonzero(~same)
    tie = np.repeat(heads, np.diff(np.append(heads, len(at))))  # first suffix with these bytes
    lcp = np.append(np.minimum(shared[heads], width), 0).astype(np.int16)
    lcp[0] = 0
    number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(at))))
    _, rank = np.unique(own[heads], return_inverse=True)
    factor = np.zeros(len(at), np.int64)
    factor[order] = np.where(own > own[tie], width, _smaller(rank.astype(np.int32), lcp)[number])
    return factor


def _sort(width: int):
    """Step 3b: covered windows of the spans in a bucket; covered runs of shards pass through."""
    schema = _arrow(_RANGE)

    def work(key, table):
        rows = table.to_pylist()
        out = [{"shard": r["shard"], "rows": r["rows"], "starts": r["bytes"], "sizes": r["sizes"]} for r in rows if r["kind"] == 0]
        spans = [r for r in rows if r["kind"] == 1]
        if spans:
            sizes = [np.frombuffer(r["sizes"], "<i4").astype(np.int64) for r in spans]
            size = np.concatenate(sizes)
            ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in spans])
            where = np.concatenate([np.frombuffer(r["rows"], "<i8").reshape(2, -1) for r in spans], axis=1)
            buffer = np.frombuffer(b"".join(r["bytes"] for r in spans) + bytes(8), np.uint8)
            begin = np.cumsum(size + width - 1) - (size + width - 1)
            factor = previous_factors(buffer, spread(begin, size), np.repeat(ids, size), width)
            hit = factor >= width
            start = spread(where[1], size)
            shard = np.repeat(np.repeat([r["shard"] for r in spans], [len(s) for s in sizes]), size)
            row = np.repeat(where[0], size)
            shard, row, start = shard[hit], row[hit], start[hit]
            edge = np.ones(len(start), bool)
            edge[1:] = (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])
            at = np.flatnonzero(edge)
            length = np.diff(np.append(at, len(start)))
            for s in np.unique(shard[at]):
                k = shard[at] == s
                out.append({"shard": int(s), "rows": row[at][k].astype("<i8").tobytes(),
                            "starts": start[at][k].astype("<i8").tobytes(), "sizes": length[k].astype("<i4").tobytes()})
        return pa.Table.from_pylist(out, schema=schema)

    return work


def _drop(width: int, with_text: bool):
    """Step 4: unites covered windows and drops their bytes."""

    def work(key, table, ranges):
        row = table.column("row").to_numpy()
        raws = [t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        rows = np.frombuffer(b"".join(ranges.column("rows").to_pylist()), "<i8")
        starts = np.frombuffer(b"".join(ranges.column("starts").to_pylist()), "<i8")
        sizes = np.frombuffer(b"".join(ranges.column("sizes").to_pylist()), "<i4").astype(np.int64)
        order = np.argsort(rows, kind="stable")
        rows, starts, sizes = rows[order], starts[order], sizes[order]
        lo, hi = np.searchsorted(rows, row, side="left"), np.searchsorted(rows, row, side="right")
        removed, spans = np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64)
        kept = list(raws)
        for d in np.flatnonzero(hi > lo):
            own = slice(lo[d], hi[d])
            change = np.zeros(len(raws[d]) + 1, np.int64)
            np.add.at(change, starts[own], 1)
            np.add.at(change, starts[own] + sizes[own] + width - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed[d] = gone.sum()
            spans[d] = gone[0] + (gone[1:] & ~gone[:-1]).sum()
            kept[d] = np.frombuffer(raws[d], np.uint8)[~gone].tobytes()
        out = {
            "id": table.column("id"), "n_bytes": pa.array([len(r) for r in raws], pa.int64()),
            "n_removed": pa.array(removed), "n_spans": pa.array(spans),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if with_text:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    return work


def remove_repeats(
    docs: DataFrame,
    width: int = 50,
    shard_bytes: int | None = None,
    bucket_bytes: int | None = None,
    many: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept`` bytes) of every row.

    ``shard_bytes`` of text are one task's; ``bucket_bytes`` of text send their minima to one bucket.  By
    default both are 4 MiB, and grow with the square root of the input once a shard would send a
    bucket fewer than about a hundred entries.  A minimum with over ``many`` spans has its windows sent one by one.
    One shuffle of the texts, by shard, serves the three passes over them.
    """
    if width < GRAM + 8:
        raise ValueError(f"width must be at least {GRAM + 8}")
    total = input_bytes(docs, text_col)
    side = max(_SIDE, math.isqrt(1600 * total))
    shards, buckets = max(1, -(-total // (shard_bytes or side))), max(1, -(-total // (bucket_bytes or side)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    dealt = keyed.where("id is not null").select(
        F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", F.xxhash64("id", "text").alias("row"), "text",
    ).repartition(shards, "shard")
    by_shard = dealt.groupBy("shard")
    entries = by_shard.applyInArrow(_list_entries(width, buckets), _ENTRY)
    states = entries.groupBy("bucket").applyInArrow(_judge(many), _STATE)
    spans = by_shard.cogroup(states.groupBy("shard")).applyInArrow(_send(width, buckets), _SPAN)
    ranges = spans.groupBy("bucket").applyInArrow(_sort(width), _RANGE)
    done = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    out = by_shard.cogroup(ranges.groupBy("shard")).applyInArrow(_drop(width, with_text), done + ", kept binary" * with_text)
    apart = keyed.where("id is null").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
        *([F.col("text").cast("binary").alias("kept")] if with_text else []))
    return out.unionByName(apart).withColumnRenamed("id", id_col)


def op10_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))

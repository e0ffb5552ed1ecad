"""Best-fit packing of documents into fixed-length sequences, with certified bin counts.

Documents become token sequences with an end id; those longer than a sequence are cut into full
pieces and a rest.  Pieces are dealt evenly to partitions of bounded size.  Each partition is packed
best-fit decreasing, and its bin count is compared with lower bounds from dual feasible functions.
A partition whose count equals the bound is certified optimal: it keeps all but its emptiest bin.
One with a gap gives up every bin with noticeable slack.  What was given up is dealt anew, so that
pieces of different partitions meet, and packed again; rounds end when one partition has held all of
it, a round saves nothing, or after ``max_rounds``.  Every piece carries the certificate of the partition its sequence was
made in: ``part_bins`` sequences against a bound of ``part_bound``.

Edge cases: null text is empty and still has its end id; an empty table gives no pieces; repeated
rows are packed separately; other columns are ignored; a piece of exactly the limit fills a sequence.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, stage
from .pieces import batches, loaded


def token_pieces(
    docs: DataFrame,
    limit: int = 4096,
    tokenizer: str = "word_bpe_49k.json",
    style: str = "words",
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece of every document."""

    def cut(rows):
        encoder = loaded(tokenizer, style)
        for batch in rows:
            keys = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, part in batches(texts):
                ids, counts = encoder.encode(part)
                ids = ids.astype("<u4")
                row, piece, start, length, crc = [], [], [], [], []
                at = 0
                for i, n in enumerate(counts.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for p, s in enumerate(range(0, len(own), limit)):
                        one = own[s : s + limit]
                        row.append(begin + i)
                        piece.append(p)
                        start.append(s)
                        length.append(len(one))
                        crc.append(zlib.crc32(one.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    [id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)] + T.StructType.fromDDL(
        "piece int, start bigint, length bigint, ids_crc32 bigint").fields)
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins possible, by three families of dual feasible functions over the length counts.

    A dual feasible function maps lengths so that any set fitting one bin still fits one; the mapped
    total over the capacity is then a bound.  Used: the identity; for each threshold t, lengths over
    capacity - t count as full and those under t as nothing; for each k, floor-rounding to
    multiples of capacity / k where (k + 1) * length isn't a multiple of the capacity.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    upto_n, upto_sum = np.cumsum(counts), np.cumsum(counts * size)
    t = np.arange(1, capacity // 2 + 1)
    big = upto_n[-1] - upto_n[capacity - t]
    middle = upto_sum[capacity - t] - upto_sum[t - 1]
    best = max(best, int((big + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        mapped = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * mapped).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of every piece, and the fill of every bin.

    One bit of ``rooms`` for each amount of free space in use: the fullest bin that still fits is
    the lowest set bit at or above the length.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            b, room, n = n, capacity, n + 1
        where[i], offset[i] = b, capacity - room
        free[room - size].append(b)
        rooms |= 1 << (room - size)
    fill = np.bincount(where, weights=lengths, minlength=n).astype(np.int64)
    return where, offset, fill


def _packer(capacity: int, columns: list[str], turn: int, last: bool):
    def pack(rows):
        tables = list(rows)
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        lengths = table.column("length").to_numpy()
        where, offset, fill = best_fit(lengths, capacity)
        slack = capacity - fill
        bound = lower_bound(lengths, capacity)
        gap = len(fill) - bound
        give = slack > capacity // 64 if gap else np.zeros(len(fill), bool)
        if len(fill) and slack.max() > 0:
            give[slack.argmax()] = True
        if last:
            give[:] = False
        first = (turn << 56) + (TaskContext.get().partitionId() << 28)
        out = table.select(columns)
        out = out.append_column("sequence_id", pa.array(first + where, pa.int64()))
        out = out.append_column("offset", pa.array(offset, pa.int64()))
        out = out.append_column("part_bins", pa.array(np.full(len(where), len(fill), np.int64)))
        out = out.append_column("part_bound", pa.array(np.full(len(where), bound, np.int64)))
        out = out.append_column("open", pa.array(give[where]))
        yield from out.to_batches(max_chunksize=10_000)

    return pack


def pack(pieces: DataFrame, capacity: int = 4096, part_rows: int = 50_000, max_rounds: int = 8) -> DataFrame:
    """Adds ``sequence_id``, ``offset``, ``part_bins`` and ``part_bound`` to pieces with a ``length`` of 1 to ``capacity``.

    ``part_rows`` bounds what one task packs; it is independent of the size of the input.
    """
    columns = pieces.columns
    schema = T.StructType(pieces.schema.fields + T.StructType.fromDDL(
        "sequence_id bigint, offset bigint, part_bins bigint, part_bound bigint, open boolean").fields)
    todo, settled, before = stage(pieces, "pieces"), [], None
    for turn in range(max_rounds):
        n = todo.count()
        parts = max(1, -(-n // part_rows))
        last = parts == 1 or turn == max_rounds - 1 or n == before
        before = n
        packed = stage(todo.repartition(parts).mapInArrow(_packer(capacity, columns, turn, last), schema), "packed")
        settled.append(packed.where("not open").drop("open"))
        if last:
            break
        todo = packed.where("open").select(columns)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(documents(spark, sf_dir)))

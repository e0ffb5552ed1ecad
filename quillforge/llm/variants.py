"""Spelling variants: words that differ by one edit, found by comparing padded code-point matrices tile by tile.

Two words of which the longer has m code points differ by one inserted, deleted or replaced code point iff their common prefix
and common suffix together reach m - 1.  One of them then reaches half of m, so words meet under (m, first half) and under (m,
last half), each word for m its own length and one more.  The rows of a task, sorted by that key, are cut into blocks; every block pair that shares
a key is compared as a whole: rows against rows, code point by code point.  What a tile finds is added up for each word (number, best one) inside the
task, so pairs are never rows.  A key that over ``group_words`` words share is dealt into parts, and each pair of parts meets in a task of its own.

Edge cases: null texts have no words; a null id counts as an empty one in the noise; repeated rows count each; an empty table gives no words; very
long words shrink the blocks to fewer rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, salts, stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CELLS = 1 << 21  # code points compared at a time
_ROWS = 128  # of a block
_CHUNK = 20_000  # words held before their tiles are compared
_NONE = np.iinfo(np.int64).max


def vocabulary(docs: DataFrame, noise: int = 97, least_chars: int = 5, least_n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` of the words to compare.

    Words are runs of Latin letters in which A-Z are lower-cased; a run whose crc32 with its document's id ``noise`` divides
    loses the code point at crc32 modulo its length.  Counted over all documents, partial sums first.
    """
    run = F.explode(F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"), run.alias("__run")).where(F.length("__run") >= least_chars)
    h = F.crc32(F.concat("__id", F.lit(":"), "__run").cast("binary"))
    at = (h % F.length("__run")).cast("int")
    word = F.when(h % noise == 0, F.concat(F.expr("substring(__run, 1, __at)"), F.expr("substring(__run, __at + 2)"))).otherwise(F.col("__run"))
    words = runs.withColumn("__at", at).select(word.alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def keyed(words: DataFrame, group_words: int = 4096) -> DataFrame:
    """Each word under its four keys (m, side, half), and, of a large key, in each tile (i, j) of its parts."""
    length = F.length("word")
    m = F.explode(F.array(length, length + 1))
    out = words.select("word", "n", m.alias("m")).select("*", F.explode(F.array(F.lit("p"), F.lit("s"))).alias("side"))
    half = F.floor(F.col("m") / 2).cast("int")
    out = out.withColumn("half", F.when(F.col("side") == "p", F.left("word", half)).otherwise(F.right("word", F.col("m") - half)))
    keys = ["m", "side", "half"]
    large = stage(out.groupBy(*keys).count().where(F.col("count") > group_words), "large-keys")
    if large.isEmpty():
        return out.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part"))
    parts = F.coalesce(F.ceil(F.col("count") / group_words), F.lit(1)).cast("int")
    out = out.join(large, keys, "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.select("word", "n", *keys, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")


class _Chunk:
    """Words of whole keys, in key order, compared block by block."""

    def __init__(self, table: pa.Table):
        self.words = table.column("word").to_pylist()
        self.n = table.column("n").to_numpy()
        self.m, self.part = table.column("m").to_numpy(), table.column("part").to_numpy()
        self.own_part = table.column("i").to_numpy() == table.column("j").to_numpy()
        self.suffix_side = pc.equal(table.column("side"), "s").to_numpy()
        self.key = np.concatenate(([0], np.cumsum(_borders(table))))
        self.size = np.array([len(w) for w in self.words])
        self.code = np.frombuffer("".join(self.words).encode("utf-32-le"), "<u4")
        self.start = np.cumsum(self.size) - self.size
        by_word = np.argsort(np.array(self.words, object), kind="stable")
        place = np.empty(len(by_word), np.int64)
        place[by_word] = np.arange(len(by_word))
        self.order = np.lexsort((place, -self.n))  # best form first
        self.quality = np.empty(len(by_word), np.int64)
        self.quality[self.order] = np.arange(len(by_word))

    def _matrix(self, rows: slice, width: int, backwards: bool, pad: int) -> np.ndarray:
        at, size = np.arange(width), self.size[rows][:, None]
        where = self.start[rows][:, None] + (size - 1 - at if backwards else at)
        return np.where(at < size, self.code[np.clip(where, 0, len(self.code) - 1)], np.uint32(pad))

    def _common(self, x: slice, y: slice, width: int, backwards: bool) -> np.ndarray:
        """Length of the common prefix (suffix) of every row of one block and every row of the other."""
        left, right = self._matrix(x, width, backwards, 0xFFFFFFFF), self._matrix(y, width, backwards, 0xFFFFFFFE)
        alike, length = np.ones((len(left), len(right)), bool), np.zeros((len(left), len(right)), np.int32)
        for a, b in zip(left.T, right.T):
            alike &= a[:, None] == b
            if not alike.any():
                break
            length += alike
        return length

    def _near(self, x: slice, y: slice) -> np.ndarray:
        """Which rows of block ``x`` and block ``y`` (not before it) are one edit apart, each pair in one place."""
        width = int(max(self.size[x].max(), self.size[y].max())) + 1
        m = self.m[x][:, None]
        near = (self.key[x][:, None] == self.key[y]) & (np.maximum(self.size[x][:, None], self.size[y]) == m)
        prefix, suffix = self._common(x, y, width, False), self._common(x, y, width, True)
        near &= prefix + suffix >= m - 1
        near &= self.own_part[x][:, None] | (self.part[x][:, None] != self.part[y])
        near &= ~(self.suffix_side[x][:, None] & (prefix >= m // 2))  # those meet under their first half too
        if x.start == y.start:
            near &= np.arange(near.shape[0])[:, None] < np.arange(near.shape[1])
        return near

    def _blocks(self):
        begin = 0
        while begin < len(self.words):
            longest = int(self.size[begin : begin + _ROWS].max()) + 1
            end = min(len(self.words), begin + max(1, min(_ROWS, int((_CELLS / longest) ** 0.5))))
            yield slice(begin, end)
            begin = end

    def compare(self) -> pa.RecordBatch:
        count, best = np.zeros(len(self.words), np.int64), np.full(len(self.words), _NONE)
        blocks = list(self._blocks())
        for k, x in enumerate(blocks):
            for y in blocks[k:]:
                if self.key[y.start] > self.key[x.stop - 1]:
                    break
                near = self._near(x, y)
                if near.any():
                    for own, other, tile in ((x, y, near), (y, x, near.T)):
                        count[own] += tile.sum(axis=1)
                        best[own] = np.minimum(best[own], np.where(tile, self.quality[other], _NONE).min(axis=1))
        rows = np.flatnonzero(count)
        form = self.order[best[rows]]
        take = self.words.__getitem__
        return pa.RecordBatch.from_arrays(
            [pa.array(map(take, rows.tolist()), pa.string()), pa.array(count[rows]), pa.array(map(take, form.tolist()), pa.string()), pa.array(self.n[form])],
            ["word", "n_near", "form", "form_n"])


def _borders(table: pa.Table) -> np.ndarray:
    """Where a row's key differs from that of the row before it, from the second row on."""
    out = np.zeros(max(len(table) - 1, 0), bool)
    for name in ("m", "side", "half", "i", "j"):
        column = table.column(name).combine_chunks()
        out |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def _tiles(batches):
    """Compare whole keys as they come; the rows of the last key wait for the next batch."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if len(held) >= _CHUNK:
            border = np.flatnonzero(_borders(held))
            if len(border):
                cut = int(border[-1]) + 1
                yield _Chunk(held.slice(0, cut).combine_chunks()).compare()
                held = held.slice(cut)
    if held is not None and len(held):
        yield _Chunk(held.combine_chunks()).compare()


def near_words(words: DataFrame, group_words: int = 4096) -> DataFrame:
    """``word``, ``n_near``, ``form`` and ``form_n`` (its best near word) of every word of ``words`` that has a near one."""
    key = ["m", "side", "half", "i", "j"]
    rows = keyed(words, group_words).repartition(*key).sortWithinPartitions(*key)
    found = rows.mapInArrow(_tiles, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("worse"), "form"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.worse")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of words with a ``form``: the forms are followed to the last, twice as far each round.

    A form occurs at least twice as often as its word, so chains are as long as the logarithm of the largest count.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(docs: DataFrame, ratio: int = 2, group_words: int = 4096, **columns) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word.

    ``ratio``: how many times as often a form occurs; at 2 or more, forms can't lead back to a word.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = stage(vocabulary(docs, **columns), "vocabulary")
    near = near_words(words, group_words)
    out = words.join(near, "word", "left")
    often = F.col("form_n") >= ratio * F.col("n")
    out = stage(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("form")).alias("form"),
                           F.when(often, F.col("form_n")).alias("form_n")), "forms")
    out = out.join(roots(out.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(documents(spark, sf_dir))


#: crc32 by its table of 256 remainders; near words share a word less one code point, at one place or with the other itself.
CRC_SQL = """
crc(k, i, c) AS (
  SELECT k, 0, k::UBIGINT FROM range(256) AS r(k)
  UNION ALL SELECT k, i + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM crc WHERE i < 8),
crcs AS MATERIALIZED (SELECT list(c ORDER BY k) AS t FROM crc WHERE i = 8)"""


def crc_sql(text: str) -> str:
    """SQL of the crc32 of a text's UTF-8 bytes, with ``t`` of ``crcs`` at hand."""
    return f"""xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UBIGINT),
      lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)::INT]), 4294967295::UBIGINT), 4294967295::UBIGINT)"""


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
r AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, c, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r, crcs),
v AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM cut a JOIN v ON a.rest = v.word
  UNION SELECT v.word, a.word, a.n FROM cut a JOIN v ON a.rest = v.word),
best AS (SELECT word, count(*) AS n_near, min({{'worse': -other_n, 'form': other}}) AS b FROM near GROUP BY word),
f AS (
  SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.worse >= 2 * n THEN b.form END AS form, CASE WHEN -b.worse >= 2 * n THEN -b.worse END AS form_n
  FROM v LEFT JOIN best USING (word)),
go(word, here) AS (SELECT word, word FROM f UNION ALL SELECT go.word, f.form FROM go JOIN f ON f.word = go.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, go.here AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM f JOIN go ON go.word = f.word JOIN f AS last ON last.word = go.here AND last.form IS NULL
"""

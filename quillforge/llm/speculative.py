"""BPE encoding and decoding by speculation: propose greedily, verify pairs, merge exactly only what fails.

A word's tokens are proposed by longest match against the vocabulary.  A proposal is the word's encoding
exactly if every token encodes to itself and no merge ever crosses the border of two adjacent tokens; a
crossing shows in the two tokens alone.  Merges are ranked after those that make their parts, so a part lives from its own
merge to the one that takes it up, and a pair (a, b) of parts at a border merges iff its rank comes before a is
taken up and not after b is.  Verdicts are looked up for all distinct pairs at once; words with a failing pair undergo the merges themselves.

Files: merges with word ends, lower case, NFC, white space dropped, byte-level symbols, special strings taken
out of the raw text, no decoder (``word_bpe_49k.json``).  Texts within Latin-1 are split by a pattern; others by the file's own
normaliser and splitter.

Edge cases: null text is empty (no tokens); empty texts have no tokens and decode to nothing; very long texts and words are taken whole (memory grows
with one text); repeated rows and null ids each return a row; an empty table returns none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .pieces import batches

_NEVER = np.int32(2**31 - 1)
_END = 256  # added to a word's last byte
_SUFFIX = "</w>"
_SHORT = 48  # bytes of a word that is merged in the matrix
_CACHED_WORDS, _CACHED_CHARS, _CACHED_PAIRS = 500_000, 16_000_000, 2_000_000

#: What the file's pattern makes of Latin-1 (letters, digits one by one, other runs; white space).
_CUT = re.compile(r"[a-z\xAA\xB5\xBA\xDF-\xF6\xF8-\xFF]+|[0-9\xB2\xB3\xB9\xBC-\xBE]|'s|'t|'re|'ve|'m|'ll|'d|"
                  r"[^\x09-\x0D\x20\x85\xA0a-z\xAA\xB5\xBA\xDF-\xF6\xF8-\xFF0-9\xB2\xB3\xB9\xBC-\xBE]+")


def _byte_symbols() -> list[str]:
    """The printable character that byte-level files write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _within_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # its normaliser and splitter only
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("end_of_word_suffix") != _SUFFIX or model.get("ignore_merges") or model.get("dropout") or spec.get("decoder"):
            raise ValueError(f"{path}: not a file of ranked merges with word ends and no decoder")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab = model["vocab"]
        self.n = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * self.n
        for name, i in {**vocab, **self.special}.items():
            self.names[i] = name
        shown = _byte_symbols()
        self.to_bytes = {ord(c): chr(b) for b, c in enumerate(shown)}
        self.base = np.array([vocab[c] for c in shown] + [vocab[c + _SUFFIX] for c in shown], np.int32)
        self._read_merges(vocab, model["merges"])
        self._check_tokens()
        self.words: dict[str, bytes] = {}
        self.chars = 0
        self.pair_keys, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.n_failed = 0  # words that went through exact merging, for tests and figures

    def _read_merges(self, vocab: dict[str, int], merges: list) -> None:
        symbols = {int(t): (s,) for s, t in enumerate(self.base)}
        self.left, self.right = np.full(self.n, -1, np.int32), np.full(self.n, -1, np.int32)
        self.rank = np.full(self.n, -1, np.int32)
        self.ranked: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if left not in symbols or right not in symbols or whole in symbols:
                raise ValueError("a merge comes before those that make its parts, or makes a token again")
            symbols[whole] = symbols[left] + symbols[right]
            self.left[whole], self.right[whole], self.rank[whole] = left, right, rank
            self.ranked[left, right] = rank, whole
        keys = np.array([a * self.n + b for a, b in self.ranked], np.int64)
        order = np.argsort(keys)
        self.merge_keys = keys[order]
        self.merge_ranks, self.merge_whole = np.array(list(self.ranked.values()), np.int32)[order].T
        # the vocabulary as a tree of symbols: sorted (node, symbol) edges
        edges, token_at = {}, [-1]
        for token, path in symbols.items():
            node = 0
            for s in path:
                key = node * 512 + s
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = token
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.fromiter(edges.values(), np.int32, len(edges))[order]
        self.token_at = np.array(token_at, np.int32)
        self.right_parts, self.right_until = self._border(self.right)
        self.left_parts, self.left_until = self._border(self.left)

    def _border(self, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts at one end of every token, outermost first, and the rank of the merge that takes each up."""
        part, until = np.arange(self.n, dtype=np.int32), np.full(self.n, _NEVER)
        parts, ends = [], []
        while (part >= 0).any():
            parts.append(part)
            ends.append(until)
            until = np.where(part >= 0, self.rank[part], 0).astype(np.int32)
            part = np.where(part >= 0, child[part], -1).astype(np.int32)
        return np.stack(parts), np.stack(ends)

    def _crossed(self, a: np.ndarray, b: np.ndarray, but_whole: bool = False) -> np.ndarray:
        """Whether a merge crosses the border of each pair of tokens; ``but_whole``: other than that of the pair itself."""
        crossed = np.zeros(len(a), bool)
        for i in range(len(self.right_parts)):
            x = self.right_parts[i, a]
            some = np.flatnonzero((x >= 0) & ~crossed)
            if not len(some):
                break
            for j in range(len(self.left_parts)):
                if but_whole and i == j == 0:
                    continue
                y = self.left_parts[j, b[some]]
                have = (y >= 0) & ~crossed[some]
                if not (y >= 0).any():
                    break
                at = some[have]
                rank, _ = self._ranks(x[at], y[have])
                crossed[at] |= (rank < self.right_until[i, a[at]]) & (rank <= self.left_until[j, b[at]]) & (rank != _NEVER)
        return crossed

    def _check_tokens(self) -> None:
        """Which tokens encode to themselves: both halves do, and nothing crosses before the halves merge."""
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        good = np.ones(self.n, bool)
        fine = ~self._crossed(self.left[made], self.right[made], but_whole=True)
        for token, left, right, ok in zip(made.tolist(), self.left[made].tolist(), self.right[made].tolist(), fine.tolist()):
            good[token] = ok and good[left] and good[right]
        self.proper = good

    def _longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each symbol, and its length; a word's last symbol ends every match."""
        n = len(symbols)
        token, length = np.full(n, -1, np.int32), np.ones(n, np.int32)
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            key = node * 512 + symbols[at + depth]
            slot = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            met = self.edge_keys[slot] == key
            last = symbols[at + depth] >= _END
            at, node, last = at[met], self.edge_to[slot[met]].astype(np.int64), last[met]
            depth += 1
            ends = self.token_at[node] >= 0
            token[at[ends]], length[at[ends]] = self.token_at[node[ends]], depth
            at, node = at[~last], node[~last]
        return token, length

    def _good_pairs(self, keys: np.ndarray) -> np.ndarray:
        """Verdicts of pairs (sorted, distinct), from the memo or by the test."""
        slot = np.searchsorted(self.pair_keys, keys)
        known = slot < len(self.pair_keys)
        known[known] = self.pair_keys[slot[known]] == keys[known]
        good = np.zeros(len(keys), bool)
        good[known] = self.pair_good[slot[known]]
        fresh = keys[~known]
        if len(fresh):
            good[~known] = ~self._crossed(fresh // self.n, fresh % self.n)
            if len(self.pair_keys) + len(fresh) > _CACHED_PAIRS:
                self.pair_keys, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
            both = np.concatenate((self.pair_keys, fresh))
            order = np.argsort(both)
            self.pair_good = np.concatenate((self.pair_good, good[~known]))[order]
            self.pair_keys = both[order]
        return good

    def _merged_by_queue(self, raw: bytes) -> np.ndarray:
        """A long word's merges, lowest rank first and of equal ones the leftmost, from a queue."""
        tokens = self.base[np.frombuffer(raw, np.uint8)].tolist()
        tokens[-1] = int(self.base[_END + raw[-1]])
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        queue = [(self.ranked[pair][0], i, pair) for i, pair in enumerate(zip(tokens, tokens[1:])) if pair in self.ranked]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if tokens[i] is None or j >= len(tokens) or (tokens[i], tokens[j]) != pair:
                continue
            tokens[i], tokens[j] = self.ranked[pair][1], None
            after[i] = after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(tokens):
                    pair = tokens[k], tokens[after[k]]
                    if pair in self.ranked:
                        heapq.heappush(queue, (self.ranked[pair][0], k, pair))
        return np.array([t for t in tokens if t is not None], "<u4")

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merge of each pair of tokens; ``_NEVER`` where there is none."""
        key = a.astype(np.int64) * self.n + b
        slot = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        met = (self.merge_keys[slot] == key) & (a >= 0) & (b >= 0)
        return np.where(met, self.merge_ranks[slot], _NEVER), self.merge_whole[slot]

    def _merged(self, raws: list[bytes]) -> list[np.ndarray]:
        """The merges of short words, all words a merge at a time: rows of a padded matrix."""
        size = np.array([len(r) for r in raws])
        width = int(size.max())
        tokens = np.full((len(raws), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < size[:, None]
        tokens[inside] = self.base[np.frombuffer(b"".join(raws), np.uint8)]
        tokens[np.arange(len(raws)), size - 1] = self.base[_END + np.array([r[-1] for r in raws])]
        ranks, wholes = self._ranks(tokens[:, :-1], tokens[:, 1:])
        done: list[np.ndarray] = [None] * len(raws)  # type: ignore[list-item]
        row, column = np.arange(len(raws)), np.arange(width + 1)
        while len(row):
            at = ranks.argmin(axis=1)  # the leftmost of the lowest
            own = np.arange(len(row))
            busy = ranks[own, at] != _NEVER
            for k, ids in zip(row[~busy].tolist(), tokens[~busy]):
                done[k] = ids[ids >= 0].astype("<u4")
            row, at, own = row[busy], at[busy], own[: busy.sum()]
            tokens, ranks, wholes = tokens[busy], ranks[busy], wholes[busy]
            tokens[own, at] = wholes[own, at]
            shift = np.minimum(column + (column > at[:, None]), width)
            tokens = np.take_along_axis(tokens, shift, 1)
            tokens[:, -1] = -1
            shift = np.minimum(shift[:, :-1], width - 1)
            ranks, wholes = np.take_along_axis(ranks, shift, 1), np.take_along_axis(wholes, shift, 1)
            ranks[:, -1] = _NEVER
            for k in (np.maximum(at - 1, 0), np.minimum(at, width - 1)):
                ranks[own, k], wholes[own, k] = self._ranks(tokens[own, k], tokens[own, k + 1])
        return done

    def _merge(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of words by the merges themselves."""
        out: list[np.ndarray] = [None] * len(raws)  # type: ignore[list-item]
        order = sorted(range(len(raws)), key=lambda k: len(raws[k]))
        short = [k for k in order if len(raws[k]) <= _SHORT]
        for i in range(0, len(short), 8192):
            some = short[i : i + 8192]
            for k, ids in zip(some, self._merged([raws[k] for k in some])):
                out[k] = ids
        for k in order[len(short) :]:
            out[k] = self._merged_by_queue(raws[k])
        return out

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: propose, verify, merge what fails."""
        raws = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raws])
        starts = np.concatenate(([0], ends[:-1]))
        symbols = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
        symbols[ends - 1] += _END
        token, length = self._longest(symbols)
        # follow the matches from each word's start, all words a step at a time and what is left of long ones by themselves
        taken = np.zeros(len(symbols), bool)
        at, stop = starts, ends
        while len(at) > 64:
            taken[at] = True
            at = at + length[at]
            at, stop = at[at < stop], stop[at < stop]
        if len(at):
            for i, j in zip(at.tolist(), stop.tolist()):
                step, own = length[i:j].tolist(), taken[i:j]
                k = 0
                while k < j - i:
                    own[k] = True
                    k += step[k]
        where = np.flatnonzero(taken)
        ids = token[where]
        word = np.searchsorted(ends, where, side="right")
        bad = np.zeros(len(words), bool)
        bad[word[~self.proper[ids]]] = True
        same = word[1:] == word[:-1]
        keys = ids[:-1][same].astype(np.int64) * self.n + ids[1:][same]
        distinct, inverse = np.unique(keys, return_inverse=True)
        bad[word[1:][same][~self._good_pairs(distinct)[inverse]]] = True
        flat = ids.astype("<u4").tobytes()
        first = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        for k, w in enumerate(words):
            self.words[w] = flat[4 * first[k] : 4 * first[k + 1]]
        failed = np.flatnonzero(bad).tolist()
        self.n_failed += len(failed)
        for k, merged in zip(failed, self._merge([raws[k] for k in failed])):
            self.words[words[k]] = merged.tobytes()
        self.chars += len(symbols)

    def _split(self, text: str) -> list[str]:
        """Words of a text without special strings, lower-cased."""
        if _within_latin1(text):
            return _CUT.findall(text.lower())
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [w.translate(self.to_bytes).encode("latin-1").decode() for w, _ in found]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.words) > _CACHED_WORDS or self.chars > _CACHED_CHARS:
            self.words, self.chars = {}, 0
        out = []
        for _, part in batches([t or "" for t in texts]):
            cut = []
            for text in part:
                spans = self.special_cut.split(text) if self.special_cut and "<" in text else [text]
                cut.append([self.special[s] if k % 2 else self._split(s) for k, s in enumerate(spans)])
            missing: set[str] = set().union(*(s for spans in cut for s in spans if not isinstance(s, int))) - self.words.keys()
            if missing:
                self._learn(list(missing))
            known = self.words.__getitem__
            for spans in cut:
                ids = b"".join(s.to_bytes(4, "little") if isinstance(s, int) else b"".join(map(known, s)) for s in spans)
                out.append(np.frombuffer(ids, "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder in the file, tokens stand as they are written, with a space between."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_LOADED: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """The worker's codec for a file of the public tokenizers, or for a path."""
    if name not in _LOADED:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _LOADED[name] = Codec(path)
    return _LOADED[name]


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (array of int) of every row."""

    def run(rows):
        own = codec(tokenizer)
        for batch in rows:
            names = batch.column(id_col)
            for begin, texts in batches(batch.column(text_col).to_pylist()):
                ids = own.encode(texts)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([names.slice(begin, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), flat)], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id`` and ``text`` of every row of ids; null ids are null text."""

    def run(rows):
        own = codec(tokenizer)
        for batch in rows:
            lists = batch.column(ids_col)
            texts = [None if not x.is_valid else own.decode(x.values.to_numpy(zero_copy_only=False)) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row: encoded and decoded in one pass, nothing is shuffled."""

    def run(rows):
        own = codec(tokenizer)
        for batch in rows:
            names = batch.column(id_col)
            for begin, texts in batches(batch.column(text_col).to_pylist()):
                ids = own.encode(texts)
                columns = [
                    names.slice(begin, len(texts)), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids])]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias(text_col)).mapInArrow(run, schema)


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))

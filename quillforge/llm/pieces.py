"""Exact, memoised token ids for whole texts.

The public tokenizers split a text into pieces (words, digit runs, punctuation runs, white space)
before any merge is looked up, and a piece's ids don't depend on its neighbours.  So each distinct
piece goes to the ``tokenizers`` library once per Python worker; texts are then assembled from the
stored ids with numpy.  A piece is looked up by a 64-bit hash and then compared: its length, its first and last eight bytes (all of its
bytes, up to 16) and, of a longer one, every byte with those stored; a text with a piece that differs goes to the library whole.  Pieces are found on UTF-8 bytes, for texts of ASCII and Latin-1 letters; any
other text, and any text with ``<|`` (special strings), goes to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

_LETTER, _DIGIT, _SPACE, _BLANK, _OTHER = 0, 1, 2, 3, 4
_MAX_PIECES = 2_000_000
_MAX_LONG_BYTES = 1 << 26
_BATCH_CHARS = 1_000_000  # texts cut at a time; the arrays take about 60 bytes a character


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
    kinds[48:58] = _DIGIT
    kinds[9:14] = _BLANK
    kinds[32] = _SPACE
    return kinds


_CLASS = _byte_classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Pieces:
    """Token ids of texts for one tokenizer file; ``style`` is 'bytes' or 'words'.

    'bytes': byte-level BPE whose pieces may begin with one space.
    'words': lower-cased BPE with word ends, single digits, white space dropped.
    """

    def __init__(self, path: str, style: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.style = style
        rng = np.random.default_rng(7)
        self.factor = int(rng.integers(1 << 60, dtype=np.uint64)) * 8 + 5
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)
        self._reset()

    def _reset(self):
        self.bits = 22
        self.slot_hash = np.zeros(1 << self.bits, np.uint64)
        self.slot_piece = np.full(1 << self.bits, -1, np.int32)
        self.crowded: dict[int, int] = {}
        self.n_pieces = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.marks = np.zeros((3, 1 << 16), np.uint64)
        self.flat = np.zeros(1 << 18, np.uint16)
        self.n_flat = 0
        self.places = np.zeros(1 << 16, np.int64)  # where the bytes of a piece of over 16 are stored
        self.long = np.zeros(1 << 16, np.uint8)
        self.n_long = 0

    def _grow_powers(self, n: int):
        if len(self.powers) >= n:
            return
        n = max(n, 1 << 20)
        up = np.full(n, self.factor, np.uint64)
        down = np.full(n, pow(self.factor, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.powers, self.inverse = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def _encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)

    @staticmethod
    def _plain(raw: bytes) -> bool:
        if b"<|" in raw:
            return False
        if raw.isascii():
            return True
        a = np.frombuffer(raw, np.uint8)
        lead = a >= 0xC0
        if (a[lead] != 0xC3).any():
            return False
        second = a[1:][lead[:-1]]
        return not ((second == 0x97) | (second == 0xB7)).any()

    def _cut(self, a: np.ndarray, ends: np.ndarray):
        """Byte starts and ends of the pieces in the joined texts; ``ends``: where each text ends."""
        if self.style == "words":
            low = _LOWER[a]
            up = (a[1:] >= 0x80) & (a[1:] <= 0x9E) & (a[:-1] == 0xC3)
            low[1:][up] += 32
            a = low
        n = len(a)
        kind = _CLASS[a]
        edge = np.zeros(n, bool)  # a text begins here
        edge[0] = True
        edge[ends[:-1][ends[:-1] < n]] = True
        white = (kind == _SPACE) | (kind == _BLANK)
        family = np.where(white, _SPACE, kind)
        first = edge.copy()
        first[1:] |= family[1:] != family[:-1]
        last = np.empty(n, bool)
        last[:-1], last[-1] = first[1:], True
        final = np.empty(n, bool)  # a text ends with this byte
        final[:-1], final[-1] = edge[1:], True
        # a contraction: an apostrophe that is a run of its own, then s t m d re ve ll
        mark = (a == 0x27) & first & last & ~final
        if self.style == "bytes":
            mark[1:] &= (a[:-1] != 0x20) | edge[1:]
        at = np.flatnonzero(mark)
        if len(at):
            room = np.append(ends, n)[np.searchsorted(ends, at, side="right")]
            one = a[at + 1]
            two = np.where(at + 2 < room, a[np.minimum(at + 2, n - 1)], 0)
            single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            double = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
            size = np.where(single, 1, np.where(double, 2, 0))
            at, size = at[size > 0], size[size > 0]
        if self.style == "bytes":
            # the last white byte before other text stands apart from the run; a space joins the text
            before = white & last & ~final
            first |= before
            after = np.flatnonzero(before & (kind == _SPACE)) + 1
            first[after] = False
        else:
            first |= kind == _DIGIT
        if len(at):
            first[at + 1] = False
            rest = at + 1 + size
            first[rest[rest < n]] = True
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], n)
        if self.style == "words":
            keep = ~white[starts]
            starts, stops = starts[keep], stops[keep]
        return a, starts, stops

    def _learn(self, a: np.ndarray, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        raw = a.tobytes()
        texts = [raw[i:j].decode() for i, j in zip(starts.tolist(), stops.tolist())]
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint16, int(lengths.sum()))
        n, m = self.n_pieces + len(found), self.n_flat + len(flat)
        if n > len(self.starts):
            size = max(n, 2 * len(self.starts))
            self.starts, self.lengths = np.resize(self.starts, size), np.resize(self.lengths, size)
            self.marks = np.concatenate((self.marks, np.zeros((3, size - self.marks.shape[1]), np.uint64)), axis=1)
            self.places = np.resize(self.places, size)
        if m > len(self.flat):
            self.flat = np.resize(self.flat, max(m, 2 * len(self.flat)))
        self.starts[self.n_pieces : n] = self.n_flat + np.cumsum(lengths) - lengths
        self.lengths[self.n_pieces : n] = lengths
        self.marks[:, self.n_pieces : n] = self._marks(a, starts, stops)
        sizes = np.where(stops - starts > 16, stops - starts, 0)
        end = self.n_long + int(sizes.sum())
        if end > len(self.long):
            self.long = np.resize(self.long, max(end, 2 * len(self.long)))
        self.places[self.n_pieces : n] = self.n_long + np.cumsum(sizes) - sizes
        self.long[self.n_long : end] = a[spread(starts, sizes)]
        self.n_long = end
        self.flat[self.n_flat : m] = flat
        mask = np.uint64((1 << self.bits) - 1)
        left = np.arange(self.n_pieces, n)
        for shift in (0, 22, 42):
            slot = ((hashes >> np.uint64(shift)) & mask).astype(np.int64)
            free = self.slot_piece[slot] < 0
            slot, hashes_free, ids = slot[free], hashes[free], left[free]
            self.slot_piece[slot], self.slot_hash[slot] = ids, hashes_free
            won = self.slot_piece[slot] == ids
            self.slot_hash[slot[won]] = hashes_free[won]
            rest = ~free
            rest[np.flatnonzero(free)[~won]] = True
            hashes, left = hashes[rest], left[rest]
        self.crowded.update(zip(hashes.tolist(), left.tolist()))
        self.n_pieces, self.n_flat = n, m

    @staticmethod
    def _marks(a: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Length, first and last eight bytes of each piece (those it has)."""
        padded = np.concatenate((np.zeros(8, np.uint8), a, np.zeros(8, np.uint8)))
        view = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        size = stops - starts
        bits = (8 * np.maximum(8 - size, 0)).astype(np.uint64)
        first, last = view[starts + 8], view[stops]
        return np.stack((size.astype(np.uint64), first << bits, last >> bits << bits))

    def _differ(self, a: np.ndarray, starts: np.ndarray, stops: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether a piece found by its hash is another one."""
        wrong = (self.marks[:, piece] != self._marks(a, starts, stops)).any(axis=0)
        long = np.flatnonzero((stops - starts > 16) & ~wrong)
        if len(long):
            sizes = stops[long] - starts[long]
            unlike = a[spread(starts[long], sizes)] != self.long[spread(self.places[piece[long]], sizes)]
            wrong[long] = np.logical_or.reduceat(unlike, np.cumsum(sizes) - sizes)
        return wrong

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        slot = (hashes & mask).astype(np.int64)
        piece = np.where(self.slot_hash[slot] == hashes, self.slot_piece[slot], -1)
        for shift in (22, 42):
            miss = np.flatnonzero(piece < 0)
            if not len(miss):
                return piece
            h = hashes[miss]
            slot = ((h >> np.uint64(shift)) & mask).astype(np.int64)
            piece[miss] = np.where(self.slot_hash[slot] == h, self.slot_piece[slot], -1)
        if self.crowded:
            miss = np.flatnonzero(piece < 0)
            piece[miss] = [self.crowded.get(h, -1) for h in hashes[miss].tolist()]
        return piece

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint16) and the number of ids of each text."""
        found = [self._encode(part) for _, part in batches(texts, _BATCH_CHARS)]
        if not found:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*found))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.n_pieces > _MAX_PIECES or self.n_long > _MAX_LONG_BYTES:
            self._reset()
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = {i: self._encode_whole(texts[i]) for i, r in enumerate(raws) if r and not self._plain(r)}
        sizes = np.array([0 if i in whole else len(r) for i, r in enumerate(raws)], np.int64)
        n = int(sizes.sum())
        counts = np.zeros(len(texts), np.int64)
        ids = np.zeros(0, np.uint16)
        if n:
            a = np.frombuffer(b"".join(r for i, r in enumerate(raws) if i not in whole), np.uint8)
            ends = np.cumsum(sizes)
            a, starts, stops = self._cut(a, np.unique(ends[sizes > 0]))
            self._grow_powers(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
            hashes = (sums[stops] - sums[starts]) * self.inverse[starts]
            hashes ^= hashes >> np.uint64(31)
            hashes *= np.uint64(0x9E3779B97F4A7C15)
            hashes ^= (stops - starts).astype(np.uint64) << np.uint64(50)
            hashes ^= hashes >> np.uint64(29)
            piece = self._find(hashes)
            miss = np.flatnonzero(piece < 0)
            if len(miss):
                _, at = np.unique(hashes[miss], return_index=True)
                at = miss[at]
                self._learn(a, hashes[at], starts[at], stops[at])
                piece[miss] = self._find(hashes[miss])
            wrong = self._differ(a, starts, stops, piece)
            if wrong.any():
                bad = set(np.searchsorted(ends, starts[wrong], side="right").tolist())
                again = [self._encode_whole(t) if i in bad else self._encode([t])[0] for i, t in enumerate(texts)]
                return np.concatenate(again), np.array([len(x) for x in again], np.int64)
            lengths = self.lengths[piece].astype(np.int64)
            ids = self.flat[spread(self.starts[piece], lengths)]
            seen = np.concatenate(([0], np.cumsum(lengths)))
            upto = seen[np.searchsorted(starts, ends, side="left")]
            counts = np.diff(upto, prepend=0)
        if whole:
            parts, done = [], np.concatenate(([0], np.cumsum(counts)))
            for i in range(len(texts)):
                parts.append(whole[i] if i in whole else ids[done[i] : done[i + 1]])
            counts = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, counts


_LOADED: dict[tuple[str, str], Pieces] = {}


def loaded(name: str, style: str) -> Pieces:
    """The worker's encoder for a file of the public tokenizers, or for a path."""
    if (name, style) not in _LOADED:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _LOADED[name, style] = Pieces(path, style)
    return _LOADED[name, style]


def batches(texts, limit: int = 2_000_000):
    """Runs of a list of texts with about ``limit`` characters each, and where each begins."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]

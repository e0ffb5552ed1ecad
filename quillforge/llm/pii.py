"""Personal data: fixed patterns, and further spans chosen by boosted trees.

Base spans of four kinds come from fixed patterns and checks and always stay.  High-recall generators
propose more, overlapping spans: spelled-out addresses, and stretches of digit groups with other separators or
without a plus sign, whole and cut at either end.  Boosted trees score each proposal from its format and
its context; a threshold for each kind, set on held-out examples for a stated precision, selects
what is added.  Added spans never overlap a base span or each other.

No table labels personal data, so the training sample labels itself: base spans of sampled documents are rewritten in
other formats where they stand (positive), look-alike numbers and phrases are written into the same
places (negative), and the generators' own finds in documents without base spans are negative.  The
sample is bounded: ``sample_docs`` documents for each kind of base span and as many without any, in order of a hash of
their id, each giving at most ``PER_DOC`` of its spans.  ``Model.report`` holds, for each kind, held-out
examples, threshold, precision and recall; a kind without ten held-out positives at that precision is switched off,
which the report shows.

All searches take time in proportion to the text: matches are sought from dots, signs and digit groups, and overlaps
are found by sorted sweeps.

Edge cases: null text is empty; repeated rows are treated alike; a corpus without base spans adds
nothing (no positives to learn from); an empty table gives no rows; other columns are ignored; offsets
are code points.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, threshold
from .common import documents, stage

KINDS = ("email", "ip", "card", "phone")

#: fixed values: the base patterns
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP_TAIL = re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGITS = frozenset("0123456789")
_DIGIT = re.compile("[0-9]")
_GROUP = re.compile("[0-9]+")
_NOT_DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    # from the first dot: the digits before it, back to the last match, are its first part
    done, m = 0, _IP_TAIL.search(text)
    while m:
        start = m.start()
        while start > done and text[start - 1] in _DIGITS:
            start -= 1
        if start == m.start():
            m = _IP_TAIL.search(text, m.start() + 1)
            continue
        if all(_small(p) for p in text[start : m.end()].split(".")):
            out.append((1, start, m.end()))
        done = m.end()
        m = _IP_TAIL.search(text, done)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


_AT = r"(?:@|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20)"
#: lengths that addresses may have: 64 characters before the sign, 63 in each part of the domain
_MAIL = re.compile(rf"[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,4}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}")
_HINT = re.compile(r"@|[(\[{]\x20?at\x20?[)\]}]|\x20at\x20[^\x20]{1,64}\x20?[(\[{]?\x20?dot[\x20)\]}]")
_REACH = 5 * 64 + 10  # what an address may take on either side of its sign

#: for each kind of digit groups: separator, sizes of a group, groups, digits
_STRETCHES = (
    (1, re.compile(r"\x20?(?:\.|\[\.\]|,)\x20?"), (1, 3), (4, 4), (4, 12)),
    (2, re.compile(r"[\x20./_-]{1,2}"), (2, 19), (1, 6), (9, 24)),
    (3, re.compile(r"[\x20./()-]{1,3}"), (1, 8), (2, 6), (7, 15)),
)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Overlapping candidate spans of every generator."""
    out: list[tuple[int, int, int]] = []
    done = 0
    # around each hint only: the pattern is not run over long stretches without one
    for hint in _HINT.finditer(text):
        if hint.start() < done:
            continue
        for m in _MAIL.finditer(text, max(done, hint.start() - _REACH), min(len(text), hint.end() + _REACH)):
            if m.end() > hint.start():
                if m.start() <= hint.start():
                    out.append((0, *m.span()))
                    done = m.end()
                break
    groups = [m.span() for m in _GROUP.finditer(text)]
    for kind, separator, (low, high), (few, many), (least, most) in _STRETCHES:
        i = 0
        while i < len(groups):
            j = i
            while j + 1 < len(groups) and groups[j + 1][0] - groups[j][1] <= 5 and separator.fullmatch(text, groups[j][1], groups[j + 1][0]):
                j += 1
            # the stretch i..j as it is, and what its ends leave: first and last groups of up to ``many``
            spans = {(i, e) for e in range(i, min(j + 1, i + many))} | {(b, j) for b in range(max(i, j - many + 1), j + 1)}
            for b, e in spans:
                sizes = [y - x for x, y in groups[b : e + 1]]
                if few <= len(sizes) <= many and least <= sum(sizes) <= most and min(sizes) >= low and max(sizes) <= high:
                    start = groups[b][0]
                    if kind == 3 and start and text[start - 1] == "(":
                        start -= 1
                    out.append((kind, start, groups[e][1]))
            i = j + 1
    return sorted(set(out))


#: fixed values: words that announce a kind
_CUES = (
    ("mail", "e-mail", "email", "contact", "address", "write"),
    ("ip", "host", "server", "address", "ping", "node"),
    ("card", "visa", "credit", "debit", "payment", "account"),
    ("tel", "phone", "call", "mobile", "fax", "contact"),
)
_OTHER_CUES = ("version", "page", "isbn", "order", "date", "total", "price", "no", "id", "section", "chapter", "usd", "eur")
N_FEATURES = 22
PER_DOC = 8  # spans of a sampled document that become examples


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span, then its context."""
    span = text[start:end]
    digits = _NOT_DIGITS.sub("", span)
    groups = re.findall("[0-9]+", span)
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 12].lower()
    words = re.findall("[a-z-]+", before)[-3:]
    tail = re.split(r"[^A-Za-z0-9]+", span)[-1]
    separators = set(re.sub("[A-Za-z0-9]", "", span))
    return [
        float(kind == 0), float(kind == 1), float(kind == 2), float(kind == 3),
        len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(luhn(digits)) if digits else 0.0,
        float(len(groups) == 4 and all(_small(g) for g in groups)),
        float(span.startswith(("+", "00"))), float("(" in span), float("@" in span),
        float(bool(re.search(r"[(\[{]\x20?(?:at|dot)", span))), float(tail.isalpha() and 2 <= len(tail) <= 4),
        len(separators), float(bool(groups) and len(groups[0]) == 4 and groups[0][:2] in ("19", "20")),
        float(any(w in _CUES[kind] for w in words)), float(any(w in _OTHER_CUES for w in words)),
        float(before[-1:].isalnum() or before[-1:] in "$€£#/._-" and before != ""), float(after[:1].isalnum() or after[:1] in "%/_"),
    ]


def _rewritten(kind: int, span: str, rng: random.Random) -> str:
    """A base span in another format of the same kind."""
    digits = _NOT_DIGITS.sub("", span)
    if kind == 0:
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", ".")])
        return span.replace("@", at).replace(".", dot)
    if kind == 1:
        return span.replace(".", rng.choice(["[.]", " . ", " ."]))
    if kind == 2:
        return rng.choice([".", "/", "  ", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:]
    a, b, c = local[:3], local[3:6], local[6:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10]} {a} {b} {c}", f"{a} {b} {c}"])


def _look_alike(kind: int, rng: random.Random) -> str:
    """Text that a generator of the kind proposes but that is no personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    if kind == 0:
        word = lambda: "".join(rng.choice("abdehilnorst") for _ in range(rng.randint(2, 9)))
        return rng.choice([f"{word()} at {word()}. {word()}", f"{word()} at {word()}.{word()}{word()}", f"{word()}@{word()}. {word()}"])
    if kind == 1:
        return rng.choice([f"{n(3)},{n(3)},{n(3)},{n(3)}", f"{n(2)}, {n(2)}, {n(1)}, {n(2)}", f"{rng.randint(256, 999)}.{n(2)}.{n(1)}.{n(2)}", f"{n(3)}. {n(3)}. {n(3)}. {n(3)}"])
    if kind == 2:
        return rng.choice([n(rng.randint(9, 15)), f"{n(4)}-{n(4)}-{n(4)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{n(5)}/{n(4)}/{n(3)}", n(rng.randint(20, 24))])
    return rng.choice([
        f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{n(3)} {n(3)}", f"{n(1)}.{n(2)}.{n(2)}",
        f"{rng.randint(1900, 1999)}-{rng.randint(2000, 2030)}", f"{n(4)} {n(4)} {n(4)} {n(4)}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(2)}.{n(3)}.{n(3)}", f"({n(4)}) {n(2)}"])


def _examples(doc_id: int, text: str) -> list[tuple[list[float], int, int, int]]:
    """(features, kind, label, held out) made from one sampled document."""
    rng = random.Random(doc_id or 0)
    held = rng.random() < 0.4
    out = []
    found = base_spans(text)

    def written(kind, start, end, words, label):
        new = text[max(0, start - 60) : start] + words + text[end : end + 30]
        at = min(start, 60)
        for k, i, j in proposals(new):
            if k == kind and i <= at and j >= at + len(words):
                out.append((features(new, k, i, j), k, label, held))
            elif label and k != kind and i < at + len(words) and j > at and rng.random() < 0.5:
                out.append((features(new, k, i, j), k, 0, held))

    for kind, start, end in found if len(found) <= PER_DOC else rng.sample(found, PER_DOC):
        for _ in range(3):
            written(kind, start, end, _rewritten(kind, text[start:end], rng), 1)
        for _ in range(3):
            written(kind, start, end, _look_alike(kind, rng), 0)
    own = [p for p in proposals(text) if not found or not _Cover(found).meets(p[1], p[2])]
    for k, i, j in own if len(own) <= PER_DOC else rng.sample(own, PER_DOC):
        out.append((features(text, k, i, j), k, 0, held))
    if not found and text:
        at = rng.randrange(len(text))
        for kind in range(4):
            written(kind, at, at, " " + _look_alike(kind, rng) + " ", 0)
    return out


class _Cover:
    """The union of spans, for overlap tests by bisection."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted((s, e) for _, s, e in spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


class Model:
    """Trees and, by kind, the score from which a proposal is added (2 where a kind is switched off)."""

    def __init__(self, trees: Trees | None, edges: list[float], report: list[dict] | None = None):
        self.trees, self.edges, self.report = trees, edges, report or []

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        return self.added_all([text], [base])[0]

    def added_all(self, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """For each text the selected proposals, best score first, apart from base spans and from each other.

        The proposals of all the texts are scored at once.
        """
        if self.trees is None:
            return [[] for _ in texts]
        asked, rows, x = [], [], []
        for text, base in zip(texts, bases):
            cover = _Cover(base)
            open_ = [p for p in proposals(text) if self.edges[p[0]] <= 1 and not cover.meets(p[1], p[2])] if text else []
            asked.append(open_)
            rows.append(len(open_))
            x += [features(text, *p) for p in open_]
        if not x:
            return [[] for _ in texts]
        score, at, out = self.trees.score(np.array(x)), 0, []
        for open_, n in zip(asked, rows):
            own, at = score[at : at + n], at + n
            starts: list[int] = []
            ends: list[int] = []
            kept = []
            for i in np.argsort(-own, kind="stable"):
                k, s, e = open_[i]
                if own[i] < self.edges[k]:
                    continue
                here = bisect_left(starts, s)
                if (here and ends[here - 1] > s) or (here < len(starts) and starts[here] < e):
                    continue
                starts.insert(here, s)
                ends.insert(here, e)
                kept.append((k, s, e))
            out.append(kept)
        return out


#: texts that may hold a base span of a kind, as the JVM sees them
_MAY_HOLD = (r"@[A-Za-z0-9-]+\.[A-Za-z0-9]", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[ -]?[0-9]){15}", r"\+[0-9][ ().0-9-]{6}")


def train(docs: DataFrame, sample_docs: int = 3000, precision: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits the trees and thresholds on at most ``sample_docs`` documents of each kind and as many others.

    One scan notes which kinds a text may hold; ids are taken by hash within each kind, so that a rare kind is
    seen however large the corpus is.  The ids are broadcast (their number is the bound), and what reaches the driver are
    the examples of those documents, each a short list of numbers.  Of rows with one id, one text is used.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in enumerate(_MAY_HOLD)]), lambda k: k.isNotNull())
    noted = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit(4))).alias("kinds"))
    noted = stage(noted, "pii-kinds")
    picks = [noted.where(F.array_contains("kinds", k)).select("id", F.xxhash64("id").alias("h")).distinct().orderBy("h", "id").limit(sample_docs).select("id")
             for k in range(5)]
    ids = picks[0]
    for more in picks[1:]:
        ids = ids.union(more)
    ids = stage(ids.distinct(), "pii-sample")
    sampled = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(F.broadcast(ids), "id", "left_semi")
    sampled = sampled.groupBy("id").agg(F.min("text").alias("text"))

    def make(rows):
        for batch in rows:
            made = [e for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in _examples(i, t)]
            yield pa.RecordBatch.from_pydict({
                "x": pa.array([e[0] for e in made], pa.list_(pa.float64())), "kind": pa.array([e[1] for e in made], pa.int32()),
                "y": pa.array([e[2] for e in made], pa.int32()), "held": pa.array([bool(e[3]) for e in made], pa.bool_())})

    table = sampled.mapInArrow(make, "x array<double>, kind int, y int, held boolean").toArrow()
    if not table.num_rows:
        return Model(None, [2.0] * 4)
    x = np.array(table.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES)
    kind, y = table.column("kind").to_numpy(), table.column("y").to_numpy()
    held = table.column("held").to_numpy()
    order = np.lexsort((*x.T, kind, y, held))  # the same model whatever the order of the tasks
    x, kind, y, held = x[order], kind[order], y[order], held[order]
    if not y[~held].any() or not y[held].any():
        return Model(None, [2.0] * 4)
    trees = Trees().fit(x[~held], y[~held])
    score = trees.score(x[held])
    edges, report = [], []
    for k in range(4):
        s, t = score[kind[held] == k], y[held][kind[held] == k]
        edges.append(max(threshold(s, t, precision), 0.5))
        hit = t[s >= edges[k]]
        report.append({
            "kind": KINDS[k], "positives": int(t.sum()), "negatives": int((t == 0).sum()), "threshold": edges[k],
            "precision": float(hit.mean()) if len(hit) else None, "recall": float(hit.sum() / t.sum()) if t.any() else None})
    return Model(trees, edges, report)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, counts of base spans by kind, ``base_sha256``, ``spans`` and ``n_added`` of every row."""
    names = ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def work(rows):
        for batch in rows:
            out = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            for base, more in zip(bases, model.added_all(texts, bases)):
                counts = [sum(b[0] == k for b in base) for k in range(4)]
                out.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + more), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    schema = "id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; all columns stay, null text stays null."""
    at = docs.columns.index(text_col)

    def work(rows):
        for batch in rows:
            out = []
            texts = batch.column(at).to_pylist()
            bases = [base_spans(t) if t else [] for t in texts]
            for t, base, more in zip(texts, bases, model.added_all([t or "" for t in texts], bases)):
                parts, done = [], 0
                spans = base + more
                for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s >= done:
                        parts += [t[done:s], f"[{KINDS[k].upper()}]"]
                    done = max(done, e)
                out.append("".join(parts) + t[done:] if spans else t)
            yield batch.set_column(at, text_col, pa.array(out, pa.string()))

    return docs.mapInArrow(work, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, train(docs))

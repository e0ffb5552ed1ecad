"""Quality rules kept as a bitmask ledger.

``ledger`` measures every text once and evaluates every rule once: the measurements and one bit for
each failed rule, which ``store`` writes.  A policy is a version and the mask of the rules it enforces, so verdicts
of any version, and what each rule does alone, come from the stored bits by bitwise operations.
All of it is built-in column functions, and no row leaves its partition.

Edge cases: null text has no words and fails ``too_few_words``; empty tables give empty ledgers;
repeated rows are judged alike; ids may be null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: name and SQL condition of failure, in bit order; integer arithmetic only.
RULES = [
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_words"]

#: policy version -> mask of enforced rules
POLICIES = {1: BASE, 2: sum(BIT.values())}

_BLANKS = r"[\x20\x09-\x0D]+"


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measurements of a text column.

    Repeats of 3-word windows: each window's hash, cut to leave room for its position, is sorted as
    one long; neighbours with equal hashes whose words are equal too mark their positions, and the
    marked windows' lengths are added up without their overlaps.  Where other windows share a cut hash,
    which takes a very long text, a window could stand between two equal ones: such a text's windows are
    sorted by their words instead.
    """
    df = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("__words", F.expr(rf"filter(split(__text, '{_BLANKS}'), w -> w <> '')".replace("\\", "\\\\")))
    df = df.withColumn("__lines", F.expr(r"filter(split(__text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    })
    df = df.withColumn("__mask", F.expr("shiftleft(1L, length(bin(n_words))) - 1L"))
    df = df.withColumn("__windows", F.expr(
        "sort_array(if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0L, n_words - 3L),"
        " i -> (xxhash64(__words[i], __words[i + 1], __words[i + 2]) & ~__mask) | i)))"
    ))
    same = (
        "(({x} | __mask) = (__windows[{j}] | __mask)"
        " and __words[{x} & __mask] = __words[__windows[{j}] & __mask]"
        " and __words[({x} & __mask) + 1] = __words[(__windows[{j}] & __mask) + 1]"
        " and __words[({x} & __mask) + 2] = __words[(__windows[{j}] & __mask) + 2])"
    )
    add_up = (
        "aggregate(sort_array({marked}), named_struct('n', 0L, 'upto', 0L),"
        " (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.upto), 'upto', p + 3), a -> a.n)"
    )
    by_hash = (
        "transform(filter(__windows, (x, i) ->"
        f" (i > 0 and {same.format(x='x', j='i - 1')}) or (i < n_words - 3 and {same.format(x='x', j='i + 1')})), x -> x & __mask)"
    )
    by_words = (
        "transform(filter(transform(__sorted, (x, i) -> named_struct('p', x.p, 'again',"
        " (i > 0 and x.w = __sorted[i - 1].w) or (i < n_words - 3 and x.w = __sorted[i + 1].w))), x -> x.again), x -> x.p)"
    )
    windows = "sort_array(transform(sequence(0L, n_words - 3L), i -> named_struct('w', array(__words[i], __words[i + 1], __words[i + 2]), 'p', i)))"
    equal = same.format(x="__windows[i]", j="i - 1")
    clash = f"exists(sequence(1, size(__windows) - 1), i -> (__windows[i - 1] | __mask) = (__windows[i] | __mask) and not {equal})"
    df = df.withColumn("__sorted", F.expr(f"if(size(__windows) > 1 and {clash}, {windows}, null)"))
    repeated = F.expr(f"if(__sorted is null, {add_up.format(marked=by_hash)}, {add_up.format(marked=by_words)})")
    # a generator of one row: filters on measurements stay above it, so none is computed again inside a condition
    measures = F.struct(*MEASURES[:-1], repeated.alias(MEASURES[-1]))
    return df.select(*[c for c in docs.columns if c not in MEASURES], F.inline(F.array(measures)))


def fail_bits() -> Column:
    """One bit for each failed rule, from the measurement columns."""
    return F.expr(" | ".join(f"if({rule}, {1 << i}L, 0L)" for i, (_, rule) in enumerate(RULES)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the measurements and ``fail_bits`` of every document."""
    return measured(docs.select(id_col, text_col), text_col).select(id_col, *MEASURES, fail_bits().alias("fail_bits"))


def store(entries: DataFrame) -> DataFrame:
    """The ledger as a written table in the shared folder: policies and ablations read it, no rule is evaluated again."""
    return stage(entries, "rule-ledger")


def passes(bits: Column, version: int) -> Column:
    """Whether no rule that the policy enforces has failed."""
    return bits.bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def keep_passing(docs: DataFrame, version: int = 2, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy passes, with their own columns, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__t"))
    return measured(rows, "__t").where(passes(fail_bits(), version)).select("__row.*")


def ablations(entries: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents it fails, fails alone, and what would be kept without it.

    One aggregate row: counts over masked bits, unpivoted; nothing but partial sums is shuffled.
    """
    mask = POLICIES[version]
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    used = [(n, 1 << i) for i, (n, _) in enumerate(RULES) if mask >> i & 1]
    sums = entries.agg(F.count_if(bits == 0).alias("kept"), *[
        F.struct(
            F.lit(name).alias("rule"),
            F.count_if(bits.bitwiseAND(F.lit(bit).cast("long")) != 0).alias("n_failed"),
            F.count_if(bits == bit).alias("n_failed_alone"),
        ).alias(f"r{bit}") for name, bit in used
    ])
    return sums.select("kept", F.explode(F.array(*[f"r{bit}" for _, bit in used])).alias("r")).select(
        F.lit(version).alias("version"), "r.rule", "r.n_failed", "r.n_failed_alone",
        (F.col("kept") + F.col("r.n_failed_alone")).alias("kept_without_it"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = store(ledger(documents(spark, sf_dir)))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(F.col("fail_bits"), 1)).alias("base_failed"), passes(F.col("fail_bits"), 2).alias("kept"), "fail_bits")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the full policy does alone, over the stored ledger of all documents."""
    return ablations(store(ledger(documents(spark, sf_dir))), 2)


_WORDS_SQL = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LINES_SQL = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"

OP7_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS_SQL} AS w, {_LINES_SQL} AS l
  FROM documents),
win AS (
  SELECT r, unnest(range(1, greatest(len(w) - 1, 1))) AS p, w FROM d),
dup AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, w[p], w[p + 1], w[p + 2]) AS n FROM win),
rep AS (
  SELECT r, count(DISTINCT p + o) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY r),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
f AS (
  SELECT *, {" + ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, (_, rule) in enumerate(RULES))} AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & {BASE}) <> 0 AS base_failed,
  bits = 0 AS kept, bits::BIGINT AS fail_bits
FROM f
"""

ABLATIONS_SQL = f"""
WITH l AS ({OP7_SQL}), u AS (SELECT unnest([{", ".join(f"'{n}'" for n in BIT)}]) AS rule, unnest([{", ".join(str(x) for x in BIT.values())}]) AS bit)
SELECT 2::INTEGER AS version, rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (fail_bits = bit)::BIGINT AS n_failed_alone,
  count(*) FILTER (fail_bits IN (0, bit))::BIGINT AS kept_without_it
FROM l, u GROUP BY rule
"""

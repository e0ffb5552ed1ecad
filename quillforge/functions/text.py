"""Text expressions.  Offsets and lengths count code points."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: contractions that compare equal to their long form
CONTRACTIONS = {
    "can't": "cannot",
    "won't": "will not",
    "don't": "do not",
    "doesn't": "does not",
    "didn't": "did not",
    "isn't": "is not",
    "aren't": "are not",
    "wasn't": "was not",
    "weren't": "were not",
}


def normalize_text(col: Column) -> Column:
    """Joins words hyphenated over a line end, collapses white space and trims."""
    joined = F.regexp_replace(col, r"(?<=\p{L})-\r?\n(?=\p{Ll})", "")
    return F.regexp_replace(F.regexp_replace(joined, r"(?U)\s+", " "), r"^ | $", "")


def unify_newlines(col: Column) -> Column:
    return F.regexp_replace(col, r"\r\n?", "\n")


#: white space at either end, of any script
_ENDS = r"(?U)^\s+|\s+$"

_FORMED = r"^[a-z0-9]++(?: [a-z0-9]++)*+\z"


def normalize_answer(col: Column) -> Column:
    """English answer form of a text in compatibility form (``fold_compatible``): straight apostrophes, lower case, closing
    marks dropped once, long forms, single spaces."""
    straight = F.translate(col, "\u2018\u2019\u02bc", "'''")
    low = F.lower(straight)
    out = F.regexp_replace(low, _ENDS, "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[?!.]+$", ""), _ENDS, ""), r"(?U)\s+", " ")
    spelled = out
    for short, long in CONTRACTIONS.items():
        spelled = F.regexp_replace(spelled, rf"\b{short}\b", long)
    # every short form has an apostrophe: texts without one skip the search for them
    full = F.when(F.contains(straight, F.lit("'")), F.trim(F.regexp_replace(spelled, r"(?U)\s+", " "))).otherwise(out)
    # words of letters and digits with single spaces have this form already
    return F.when(low.rlike(_FORMED), low).otherwise(full)


_PLAIN = r"^[\x00-\x7F]*$"

#: full-width forms and the wide spaces, whose compatibility form is one ASCII character
_WIDE = "\u00a0\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = unicodedata.normalize("NFKC", _WIDE)
_SIMPLE = r"^[\x00-\x7F\x{FF01}-\x{FF5E}\x{A0}\x{3000}]*+\z"


def _narrow(col: Column) -> Column:
    return F.translate(col, _WIDE, _NARROW)


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_all(values: pd.Series) -> pd.Series:
    return values.map(lambda vs: [v and unicodedata.normalize("NFKC", v) for v in vs], na_action="ignore")


def fold_compatible(df: DataFrame, *columns: str) -> DataFrame:
    """NFKC of string or string array columns.  Only rows with characters beyond ASCII and its wide forms pass through Python; the others stay
    in the JVM."""
    arrays = {c for c in columns if isinstance(df.schema[c].dataType, T.ArrayType)}
    plain, single = F.lit(True), {}
    for c in columns:
        text = F.array_join(c, " ") if c in arrays else F.col(c)
        ascii_ = F.coalesce(text.rlike(_PLAIN), F.lit(True))
        plain &= ascii_ | text.rlike(_SIMPLE)
        single[c] = F.when(ascii_, F.col(c)).otherwise(F.transform(c, _narrow) if c in arrays else _narrow(F.col(c)))
    folded = {c: (_nfkc_all if c in arrays else _nfkc)(F.col(c)) for c in columns}
    return df.where(plain).withColumns(single).unionByName(df.where(~plain).withColumns(folded))


def matches_any(text: Column, accepted: Column) -> Column:
    """Whether a text equals any accepted value after normalization, both in compatibility form; false for nulls."""
    # an accepted value as it stands needs no normal form; no lambda around the text's form, which would be taken anew for each value
    same = F.array_contains(accepted, text)
    return F.coalesce(same, F.lit(False)) | F.coalesce(F.array_contains(F.transform(accepted, normalize_answer), normalize_answer(text)), F.lit(False))


def prompt_tokens(col: Column) -> Column:
    """Words of a word-order prompt: split at slashes, without a leading number, blanks dropped."""
    bare = F.regexp_replace(col, r"^\s*\d+[.)]?\s+", "")
    return F.filter(F.transform(F.split(bare, "/"), lambda t: F.trim(t)), lambda t: t != "")


def split_gap(col: Column) -> Column:
    """``before`` and ``after`` of a prompt with exactly one gap, else null."""
    parts = F.split(col, "_{3,}")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("before"), parts[1].alias("after")))


def escape_html(col: Column) -> Column:
    out = F.regexp_replace(col, "&", "&amp;")
    return F.regexp_replace(F.regexp_replace(out, "<", "&lt;"), ">", "&gt;")


def shorten(col: Column, limit: int | Column) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.when(F.length(col) > limit, F.concat(F.substring(col, F.lit(1), limit - 1), F.lit("…"))).otherwise(col)

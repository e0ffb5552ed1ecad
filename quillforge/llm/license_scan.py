"""License notices in texts: Dice similarity of word bigrams with templates.

A text is normalised to lower-case words of letters and digits.  A notice is a window of words whose bigrams
have Dice = 2 * shared / (a + b) of at least ``THRESHOLD`` with a template's, repeats counted.  Windows of any place and length are
judged: the best one begins and ends with a bigram of the template, so only those are formed.  The threshold bounds both
sizes: a template of b bigrams needs b * t / (2 - t) shared ones, in a window of at most b * (2 - t) / t.  Templates
that share fewer bigrams with the whole text go before any window is counted.  Of overlapping notices the best stays.
All of it is built-in column functions.

Texts without enough bigrams of any template go in the first pass, which shuffles nothing.  Of the others each bigram met is a row, windows are
formed over the few rows that follow it, and overlaps are settled word by word: a notice that is the best one at each of its words stays, those that
meet it go, and so on with the rest.  After ``ROUNDS`` rounds, which only chains of ever better overlapping notices outlast, what is left of a
text is settled in order of quality.  So time grows with the words and notices of a text, not with their square.

Edge cases: null and empty texts have no notices; very long texts are taken whole; repeated rows are judged alike, each for itself; ids may be null;
an empty table or no templates give no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, stage

#: Dice in hundredths: comparisons are of whole numbers.
THRESHOLD = 80
ROUNDS = 4

_NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 License"],
    "MIT": ["the MIT License"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "ISC": ["the ISC License"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "EPL-2.0": ["the Eclipse Public License, Version 2.0"],
    "Unlicense": ["the Unlicense license"],
    "CC0-1.0": ["CC0 1.0 Universal"],
} | {f"CC-{k}-{v}": [f"CC {k} {v}"] for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")}

_TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]

#: (license, text) of every template
TEMPLATES = [
    (license, f"{verb} under {name}") for license, names in _NAMES.items() for name in names
    for verb in ("Licensed", "Released", "Distributed", "This work is licensed")
] + _TEXTS


def bigrams(text: str) -> list[str]:
    """Word bigrams of a template, in order and with repeats."""
    words = re.findall(r"[^\W_]+", text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def sizes(b: int) -> tuple[int, int]:
    """Fewest shared and most bigrams of a window that reaches the threshold with ``b`` bigrams."""
    return -(-b * THRESHOLD // (200 - THRESHOLD)), b * (200 - THRESHOLD) // THRESHOLD


def _literal(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each notice: ``id``, license, template, first_word, last_word, n_shared, dice, notice."""
    rows = [(k, license, bigrams(text)) for k, (license, text) in enumerate(TEMPLATES if templates is None else templates)]
    rows = [(k, license, grams, *sizes(len(grams))) for k, license, grams in rows if grams]
    if not rows:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, license string, template int, "
                                                 "first_word int, last_word int, n_shared int, dice double, notice string")
    vocabulary = sorted({g for r in rows for g in r[2]})
    first = sorted({g.split(" ")[0] for g in vocabulary})
    known = F.array(*[F.struct(
        F.lit(k).alias("id"), F.lit(license).alias("license"), F.array(*map(F.lit, grams)).alias("grams"),
        F.lit(least).alias("least"), F.lit(most).alias("most")) for k, license, grams, least, most in rows])
    fewest = min((r[3] for r in rows), default=1)

    df = docs.select(F.col(id_col).alias("__id"), F.expr(
        r"filter(split(lower(coalesce(" + text_col + r", '')), '[^\\p{L}\\p{N}]+'), w -> w <> '')").alias("__w"))
    gram = "concat(__w[i], ' ', __w[i + 1])"
    df = df.select("__id", "__w", F.expr(
        f"transform(filter(if(size(__w) < 2, cast(array() as array<int>), sequence(0, size(__w) - 2)), i -> __w[i] in ({', '.join(map(_literal, first))})"
        f" and {gram} in ({', '.join(map(_literal, vocabulary))})), i -> struct(i as p, {gram} as g))").alias("__h"))
    df = _once(df, ["__id"], "__w", "__h").where(F.size("__h") >= fewest)
    df = df.withColumn("__g", F.array_distinct(F.col("__h.g"))).withColumn("__t", F.transform(F.filter(
        known, lambda t: F.size(F.filter(t["grams"], lambda g: F.array_contains("__g", g))) >= t["least"]), lambda t: t["id"]))
    df = _once(df, ["__id"], "__w", "__h", "__t").where(F.size("__t") > 0)
    texts = stage(df.withColumn("__r", F.monotonically_increasing_id()), "license-texts")
    longest = max(r[4] for r in rows)
    found = _settle(stage(_windows(texts, rows, longest), "license-windows"))
    return _with_words(texts, found, longest + 1).select(
        F.col("__id").alias(id_col), "license", F.col("id").alias("template"), F.col("s").alias("first_word"), F.col("e").alias("last_word"),
        F.col("shared").alias("n_shared"), (-F.col("worse")).alias("dice"), "notice")


def _once(df: DataFrame, keys: list[str], *made: str) -> DataFrame:
    """A generator of one row: conditions and later columns stay above it, so nothing is computed twice."""
    return df.select(*keys, F.inline(F.array(F.struct(*made))))


#: A window's columns in order of quality: the first of two windows is the better one.
_QUALITY = ["worse", "fewer", "s", "e", "id", "license", "shared"]


def _windows(texts: DataFrame, rows: list[tuple], longest: int) -> DataFrame:
    """Windows that reach the threshold: ``__r`` and the columns of ``_QUALITY``, one row each."""
    of = texts.sparkSession.createDataFrame(
        [(k, license, g, grams.count(g), len(grams), least, most) for k, license, grams, least, most in rows for g in dict.fromkeys(grams)],
        "id int, license string, g string, c int, b int, least int, most int")
    hits = texts.select("__r", "__t", F.inline("__h")).join(of, "g").where(F.array_contains("__t", F.col("id")))
    after = W.partitionBy("__r", "id").orderBy("p").rangeBetween(0, longest - 1)
    near = hits.withColumn("near", F.collect_list(F.struct("p", "g", "c")).over(after))
    near = near.select("__r", "id", "license", "b", "least", F.col("p").alias("s"), F.filter("near", lambda x: x["p"] - F.col("p") < F.col("most")).alias("near"))
    near = near.where(F.size("near") >= F.col("least"))
    ends = near.select("*", F.posexplode("near").alias("k", "last")).where(F.col("k") + 1 >= F.col("least"))
    # no window shares more than it has, so most go before anything is counted
    length = F.col("last.p") - F.col("s") + 1
    ends = ends.where(200 * (F.col("k") + 1) >= THRESHOLD * (length + F.col("b")))
    inside = F.slice("near", 1, F.col("k") + 1)
    ends = _once(ends.withColumn("inside", inside).withColumn("e", F.col("last.p") + 1), ["__r", "id", "license", "b", "s", "e"], "inside")
    shared = F.aggregate(F.array_distinct(F.transform("inside", lambda x: F.struct(x["g"], x["c"]))), F.lit(0), lambda n, g: n + F.least(
        g["c"], F.size(F.filter("inside", lambda x: x["g"] == g["g"]))))
    judged = _once(ends.withColumn("shared", shared), ["__r", "id", "license", "b", "s", "e"], "shared")
    length = F.col("e") - F.col("s")
    judged = judged.where(200 * F.col("shared") >= THRESHOLD * (length + F.col("b")))
    dice = F.lit(2.0) * F.col("shared") / (length + F.col("b"))
    return judged.select("__r", (-dice).alias("worse"), (-F.col("shared")).alias("fewer"), "s", "e", "id", "license", "shared")


def _settle(windows: DataFrame) -> DataFrame:
    """Of overlapping windows of a text the best stays."""
    kept, left = [], windows
    for _ in range(ROUNDS):
        if left.isEmpty():
            break
        own = F.struct(*_QUALITY)
        words = left.select("__r", own.alias("w"), F.explode(F.sequence("s", "e")).alias("at"))
        words = words.withColumn("best", F.min("w").over(W.partitionBy("__r", "at")) == F.col("w"))
        words = words.withColumn("wins", F.min("best").over(W.partitionBy("__r", "w")))
        words = words.withColumn("taken", F.max("wins").over(W.partitionBy("__r", "at")))
        judged = stage(words.groupBy("__r", "w").agg(F.max("wins").alias("wins"), F.max("taken").alias("taken")), "license-rounds")
        kept.append(judged.where("wins").select("__r", "w.*"))
        left = judged.where("not taken").select("__r", "w.*")
    else:
        order = left.groupBy("__r").agg(F.sort_array(F.collect_list(F.struct(*_QUALITY))).alias("ws"))
        some = F.aggregate("ws", F.slice("ws", 1, 0), lambda a, x: F.when(
            F.exists(a, lambda k: (k["s"] <= x["e"]) & (x["s"] <= k["e"])), a).otherwise(F.concat(a, F.array(x))))
        kept.append(order.select("__r", F.inline(some)))
    out = windows.limit(0)
    for part in kept:
        out = out.unionByName(part)
    return out


def _with_words(texts: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """Adds ``__id`` and the words of each notice; a notice lies in two blocks of words at most."""
    some = texts.join(found.select("__r").distinct(), "__r", "left_semi").select("__r", "__id", F.posexplode("__w").alias("at", "word"))
    blocks = some.withColumn("block", F.floor(F.col("at") / block)).groupBy("__r", "block").agg(
        F.first("__id").alias("__id"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    found = found.withColumn("block", F.explode(F.array_distinct(F.array(F.floor(F.col("s") / block), F.floor(F.col("e") / block)))))
    met = found.join(blocks, ["__r", "block"]).withColumn("words", F.filter("words", lambda x: x["at"].between(F.col("s"), F.col("e"))))
    whole = met.groupBy("__r", *_QUALITY).agg(F.first("__id").alias("__id"), F.sort_array(F.flatten(F.collect_list("words"))).alias("words"))
    return whole.withColumn("notice", F.array_join(F.col("words.word"), " "))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


_VALUES = ", ".join(f"({k}, '{license}', '{' '.join(re.findall(r'[^' + chr(92) + 'W_]+', text.lower()))}')" for k, (license, text) in enumerate(TEMPLATES))

#: Every window between two bigrams of a template, with no template left out beforehand.
OP5_SQL = f"""
WITH t AS (
  SELECT id, license, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS grams
  FROM (SELECT id, license, string_split(words, ' ') AS w FROM (VALUES {_VALUES}) AS v(id, license, words))),
tg AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(grams) AS g FROM t) GROUP BY 1, 2),
d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT r, unnest(range(1, len(w))) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d),
h AS (SELECT r, p, g, id, c FROM g JOIN tg USING (g)),
win AS (
  SELECT a.r, a.id, len(grams) AS b, license, a.p AS s, z.p AS e
  FROM h a JOIN t USING (id) JOIN h z ON z.r = a.r AND z.id = a.id AND z.p >= a.p AND (z.p - a.p + 1) * {THRESHOLD} <= len(grams) * {200 - THRESHOLD}),
cnt AS (SELECT win.*, h.g, least(count(*), any_value(c)) AS k FROM win JOIN h ON h.r = win.r AND h.id = win.id AND h.p BETWEEN s AND e GROUP BY ALL),
j AS (SELECT r, id, b, license, s, e, sum(k)::INTEGER AS shared FROM (SELECT r, id, b, license, s, e, g, k FROM cnt) GROUP BY ALL),
m AS (
  SELECT r, list_sort(list({{'worse': -(2.0::DOUBLE * shared / (e - s + 1 + b)), 'fewer': -shared, 's': s, 'e': e + 1, 'id': id, 'license': license, 'shared': shared}})) AS ms
  FROM j WHERE 200 * shared >= {THRESHOLD} * (e - s + 1 + b) GROUP BY 1),
f AS (
  SELECT r, unnest(list_reduce(list_transform(ms, lambda x: [x]), lambda a, x:
    CASE WHEN len(list_filter(a, lambda k: k.s <= x[1].e AND x[1].s <= k.e)) > 0 THEN a ELSE list_concat(a, x) END)) AS k FROM m)
SELECT doc_id, k.license AS license, k.id::INTEGER AS template, (k.s - 1)::INTEGER AS first_word, (k.e - 1)::INTEGER AS last_word,
  k.shared AS n_shared, -k.worse AS dice, array_to_string(w[k.s:k.e], ' ') AS notice
FROM f JOIN d USING (r)
"""

"""Views over the supplied tables in the shapes the operators take.

Each view is given twice, as a DataFrame and as DuckDB SQL with the same name, so that oracles stay
self-contained.  Exercise texts are composed from whole document texts: every line becomes a numbered
item whose second word stands in brackets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text source a document; the language is the owner."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("owner_id"), F.substring("text", 1, 40).alias("title"),
        F.lit("text").alias("kind"), F.lit(None).cast("binary").alias("bytes"), "text", F.lit(1).alias("page_count"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at"),
        F.concat(F.lit("key-of-the-source-"), F.col("doc_id")).alias("client_key"))


SOURCES_SQL = """v_sources AS (
  SELECT doc_id::VARCHAR AS doc_id, lang AS owner_id, substr(text, 1, 40) AS title, text,
    make_timestamp((1700000000 + doc_id) * 1000000) AS created_at, 'key-of-the-source-' || doc_id AS client_key FROM documents)"""


def exercise_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``text``: each line as ``k. word (word) rest``."""
    d = table(spark, sf_dir, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return d.select("doc_id", F.array_join(F.transform(lines, lambda line, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), F.regexp_replace(line, "^([^ ]+) ([^ ]+)", "$1 ($2)"))), "\n").alias("text"))


EXERCISE_TEXTS_SQL = r"""v_texts AS (
  SELECT doc_id, list_aggregate(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i:
    i::VARCHAR || '. ' || regexp_replace(l, '^([^ ]+) ([^ ]+)', '\1 (\2)')), 'string_agg', chr(10)) AS text FROM documents)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block a document line; 40 lines a page in two columns."""
    d = table(spark, sf_dir, "documents")
    b = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw_text"))
    return b.select(
        "doc_id", F.concat("doc_id", F.lit(":"), "line").alias("block_id"), F.floor(F.col("line") / 40).cast("int").alias("page_index"), "raw_text",
        F.col("line").alias("ord"), F.when(F.col("line") % 2 == 0, 50.0).otherwise(350.0).alias("x"),
        (F.floor((F.col("line") % 40) / 2) * 12.0).alias("y"), F.lit(200.0).alias("width"), F.lit(10.0).alias("height"),
        F.when(F.length("raw_text") % 10 == 0, 0.7).otherwise(0.95).alias("confidence"))


BLOCKS_SQL = """v_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw_text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
v_blocks AS (
  SELECT doc_id, doc_id || ':' || line AS block_id, (line // 40)::INTEGER AS page_index, raw_text, line::INTEGER AS ord,
    CASE WHEN line % 2 = 0 THEN 50.0 ELSE 350.0 END AS x, ((line % 40) // 2) * 12.0 AS y, 200.0 AS width, 10.0 AS height,
    CASE WHEN length(raw_text) % 10 = 0 THEN 0.7 ELSE 0.95 END AS confidence FROM v_lines)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "page_index").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt for each order; the customer is the student, the customer's nation the owner."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    c = c.join(n, c.c_nationkey == n.n_nationkey)
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("attempt_id"), F.lit(1).alias("lesson_id"), F.lit(1).alias("lesson_version"), F.col("n_name").alias("owner_id"),
        F.col("c_name").alias("student"), F.col("o_orderdate").alias("created_at"), "o_orderstatus", "o_custkey")


ASCII = "abcdefghijklmnopqrstuvwxyz"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in ASCII)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each line of an order: the field is the part's, the text its name, shouted, in full-width letters, between other
    white space, or wrong, by quantity."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    l = l.groupBy("l_orderkey", "l_partkey").agg(F.min("l_quantity").alias("q"))
    wide = F.translate("p_name", ASCII, WIDE)
    text = F.when(F.col("q") % 12 == 3, wide).when(F.col("q") % 12 == 6, F.concat(F.lit("\u00a0"), "p_name", F.lit("?\t"))).when(
        F.col("q") % 3 == 0, F.concat(F.upper("p_name"), F.lit("?"))).when(F.col("q") % 3 == 1, F.col("p_name")).otherwise(F.col("p_type"))
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("field_id"), F.lit("text").alias("kind"), text.alias("text"),
        F.lit(None).cast("string").alias("option_id"), F.lit(None).cast("array<string>").alias("tokens"), F.col("q").alias("quantity"))


RESPONSES_SQL = f"""v_responses AS (
  SELECT l_orderkey AS attempt_id, l_partkey AS field_id,
    CASE WHEN q % 12 = 3 THEN translate(p_name, '{ASCII}', '{WIDE}') WHEN q % 12 = 6 THEN chr(160) || p_name || '?' || chr(9)
      WHEN q % 3 = 0 THEN upper(p_name) || '?' WHEN q % 3 = 1 THEN p_name ELSE p_type END AS text, p_name, p_brand, p_type
  FROM (SELECT l_orderkey, l_partkey, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey)"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lesson whose fields are the parts: brand is the exercise, type the group, the name the accepted value."""
    return table(spark, sf_dir, "part").select(
        F.lit(1).alias("lesson_id"), F.lit(1).alias("lesson_version"), F.col("p_type").alias("group_id"), F.col("p_brand").alias("exercise_id"),
        F.lit(None).cast("string").alias("resource_id"), F.col("p_partkey").alias("field_id"), F.col("p_size").alias("ord"),
        F.lit("text").alias("kind"), F.array("p_name").alias("accepted"))


def asked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by attempt: the parts of an order are the fields of a version of its own."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("field_id")).distinct()
    return l.join(fields(spark, sf_dir), "field_id").drop("lesson_id", "lesson_version").withColumns({
        "lesson_id": F.col("attempt_id"), "lesson_version": F.lit(1)}).drop("attempt_id")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user; its events in time order."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id"), F.col("ts").alias("occurred_at"), F.col("event_type").alias("type"), "value", F.col("props").alias("payload"))

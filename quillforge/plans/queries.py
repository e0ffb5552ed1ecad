"""Registered queries: each applies operators to whole tables of the input folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillforge.functions import text as tx
from quillforge.operators import blocks as bl
from quillforge.operators import extract as ex
from quillforge.operators import grading as gr
from quillforge.operators import library as lb
from quillforge.plans import bindings as b
from quillforge.sources import intake

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the DuckDB SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def also(name: str):
    """Registers the query below under a second, earlier name too."""

    def keep(f):
        QUERIES[name] = f
        if f.__name__ in ORACLES:
            ORACLES[name] = ORACLES[f.__name__]
        return f

    return keep


_ITEMS_SQL = "WITH " + b.EXERCISE_TEXTS_SQL + r""",
norm AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(\p{L})-\r?\n(\p{Ll})', '\1\2', 'g'), '\s+', ' ', 'g')) AS n FROM v_texts),
word AS (SELECT doc_id, n, unnest(string_split(n, ' ')) AS w, unnest(range(len(string_split(n, ' ')))) AS i, len(string_split(n, ' ')) AS k FROM norm),
place AS (SELECT *, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1)::BIGINT AS pos FROM word),
mark AS (SELECT doc_id, n, [regexp_extract(w, '\d+')::BIGINT, pos, pos + length(w)] AS m FROM place WHERE i < k - 1 AND regexp_full_match(w, '\d{1,3}[.)]?')),
fold AS (SELECT doc_id, n, list_reduce(list_prepend([0::BIGINT], list(m ORDER BY m[2])), lambda a, x:
    CASE WHEN x[1] = a[1] + 1 THEN list_concat(list_concat([a[1] + 1], a[2:]), x[2:]) ELSE a END) AS f FROM mark GROUP BY doc_id, n),
item AS (SELECT doc_id, n, f, unnest(range(1, f[1] + 1)) AS ordinal FROM fold WHERE f[1] > 0),
prompt AS (SELECT doc_id, ordinal, ordinal = f[1] AS is_last,
    trim(substr(n, f[2 * ordinal + 1] + 1, coalesce(f[2 * ordinal + 2], length(n)) - f[2 * ordinal + 1])) AS p FROM item),
cut AS (SELECT *, CASE WHEN regexp_matches(p, '\([^)]+\)') THEN len(regexp_extract_all(p, '\([^)]+\)')) ELSE len(regexp_extract_all(p, '\.{3,}')) END AS nf,
    is_last AND p <> '' AND (length(replace(p, '(', '')) <> length(replace(p, ')', '')) OR length(replace(p, '[', '')) <> length(replace(p, ']', ''))
      OR NOT regexp_matches(p, '[.!?…]["''»)]?$')) AS truncated FROM prompt)"""


@query(_ITEMS_SQL + """, a AS (SELECT doc_id, count(*) AS n_items, sum(nf) AS n_fields, bool_or(truncated) AS truncated FROM cut GROUP BY 1)
SELECT d.doc_id, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(n_fields, 0)::BIGINT AS n_fields, coalesce(truncated, false) AS truncated,
  coalesce(n_items, 0)::BIGINT AS n_detected, coalesce(n_items, 0)::BIGINT AS n_accounted, 0::BIGINT AS n_additions,
  CASE WHEN coalesce(n_items, 0) = 0 THEN 'empty' WHEN n_fields > 0 OR truncated THEN 'needsReview' ELSE 'complete' END AS status
FROM documents d LEFT JOIN a USING (doc_id)""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, answer fields and truncation of every document."""
    return ex.extract_text(b.exercise_texts(spark, sf_dir))[2]


@query(_ITEMS_SQL + " SELECT doc_id, ordinal::INTEGER AS ordinal, p AS source_prompt, nf::BIGINT AS n_fields FROM cut")
def e3_item_prompts(spark, sf_dir):
    """Every item with its prompt and number of fields."""
    items = ex.extract_text(b.exercise_texts(spark, sf_dir))[0]
    # counted where the prompt is: fields as rows would have every text segmented twice and joined with itself
    return items.select("doc_id", "ordinal", "source_prompt", ex.count_markers(F.col("source_prompt")).cast("long").alias("n_fields"))


@query(_ITEMS_SQL + r""", f AS (SELECT doc_id, ordinal, unnest(regexp_extract_all(p, '\(([^)]+)\)', 1)) AS v, unnest(range(1, nf + 1)) AS i FROM cut WHERE regexp_matches(p, '\([^)]+\)'))
SELECT doc_id, 'group:1:item:' || ordinal || ':answer:' || i AS field_id, trim(v) AS source_value FROM f""")
def e4_bracket_fields(spark, sf_dir):
    """Bracket markers with their values."""
    fields = ex.extract_text(b.exercise_texts(spark, sf_dir))[1]
    return fields.where("marker_kind = 'bracket'").select("doc_id", "field_id", "source_value")


@query(_ITEMS_SQL + """ SELECT doc_id, 'ANSWER_UNVERIFIED' AS code, sum(nf)::BIGINT AS n FROM cut GROUP BY 1 HAVING sum(nf) > 0
UNION ALL SELECT doc_id, 'SOURCE_TRUNCATED', count(*)::BIGINT FROM cut WHERE truncated GROUP BY 1""")
def e24_extraction_issues(spark, sf_dir):
    """Blocking issues by document and code."""
    items, fields, _ = ex.extract_text(b.exercise_texts(spark, sf_dir))
    return ex.extraction_issues(items, fields).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@query(_ITEMS_SQL + r""", a AS (SELECT doc_id, count(*) AS n_items, sum(nf) AS n_fields, bool_or(truncated) AS truncated, count(*) FILTER (ordinal > 3) AS extra FROM cut GROUP BY 1),
u AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda t: regexp_matches(t, '\S'))) AS lines FROM v_texts)
SELECT d.doc_id, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(n_fields, 0)::BIGINT AS n_fields, coalesce(truncated, false) AS truncated,
  coalesce(n_items, lines, 0)::BIGINT AS n_detected, coalesce(n_items, 0)::BIGINT AS n_accounted, coalesce(extra, 0)::BIGINT AS n_additions,
  CASE WHEN n_items IS NULL AND coalesce(lines, 0) = 0 THEN 'empty' WHEN n_fields > 0 OR truncated OR n_items IS NULL THEN 'needsReview' ELSE 'complete' END AS status
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN u USING (doc_id)""")
def e25_coverage(spark, sf_dir):
    """E25 against candidates and expectations: in texts without items each line is an open candidate; three items are expected of a text."""
    docs = b.exercise_texts(spark, sf_dir)
    items, _, _ = ex.extract_text(docs)
    lines = bl.tag_text_lines(docs).select("doc_id", F.concat(F.lit("line:"), "line").alias("candidate_id"))
    expected = docs.select("doc_id", F.explode(F.array(*[F.lit(f"group:1:item:{i}") for i in (1, 2, 3)])).alias("exercise_id"))
    return ex.extraction_coverage(docs, items, lines, expected)


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(\p{L})-\r?\n(\p{Ll})', '\1\2', 'g'), '\s+', ' ', 'g')) AS normalized FROM documents""")
def b1_normalized_texts(spark, sf_dir):
    """B1."""
    return b.table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


@query("""WITH c AS (SELECT doc_id, text, unnest(range(greatest(ceil(length(text) / 400.0), 1)::BIGINT)) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i::INTEGER AS ord, 'text:block:' || i AS block_id, substr(text, i * 400 + 1, 400) AS raw_text FROM c""")
def b3_text_chunks(spark, sf_dir):
    """B3 with blocks of 400 code points, which most documents exceed."""
    return bl.chunk_text(b.table(spark, sf_dir, "documents"), 400).select("doc_id", "ord", "block_id", "raw_text")


@query("WITH " + b.EXERCISE_TEXTS_SQL + r""", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM v_texts),
o AS (SELECT *, (sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 1)::BIGINT AS start FROM l)
SELECT doc_id, i::INTEGER AS line, start, start + length(t) AS "end", CASE WHEN bool_or(regexp_matches(t, '^\s*1\.\s')) OVER (PARTITION BY doc_id ORDER BY i) THEN 'exercise' ELSE 'instruction' END AS kind
FROM o WHERE regexp_matches(t, '\S')""".replace("FROM o WHERE", "FROM o QUALIFY"))
def b4_tagged_lines(spark, sf_dir):
    """Non-blank lines, their offsets and kinds."""
    return bl.tag_text_lines(b.exercise_texts(spark, sf_dir)).select("doc_id", "line", F.col("start").cast("long"), F.col("end").cast("long"), "kind")


@query("WITH " + b.BLOCKS_SQL + """, m AS (SELECT doc_id, block_id, page_index, ord, x >= 300 AS rt, CASE WHEN ord % 3 = 0 THEN x + 20 ELSE x END AS x, y + CASE ord % 5 WHEN 0 THEN 0.4 WHEN 1 THEN -11.8 ELSE 0 END AS y FROM v_blocks),
a AS (SELECT doc_id, page_index, rt, list_reduce(list_prepend([]::DOUBLE[], list_transform(list_sort(list_distinct(list(y))), lambda v: [v])), lambda acc, v:
  CASE WHEN len(acc) > 0 AND v[1] - acc[-1] <= 0.5 THEN acc ELSE list_concat(acc, v) END) AS anchors FROM m GROUP BY ALL),
k AS (SELECT m.*, list_max(list_filter(anchors, lambda v: v <= y)) AS line FROM m JOIN a USING (doc_id, page_index, rt))
SELECT doc_id, block_id AS old_id, 'page:' || page_index || ':block:' || (row_number() OVER (PARTITION BY doc_id, page_index ORDER BY rt, line, x, y, ord) - 1) AS block_id,
(row_number() OVER (PARTITION BY doc_id ORDER BY page_index, rt, line, x, y, ord) - 1)::INTEGER AS ord FROM k""")
def b7_reading_order(spark, sf_dir):
    """Left column, then right, page by page; some blocks stand a little lower, some nearly on the line above."""
    df = b.blocks(spark, sf_dir).withColumn("old_id", F.col("block_id")).withColumns({"half": F.lit(0), "line": F.lit(0)})
    k = F.col("ord") % 5
    df = df.withColumns({"x": F.col("x") + F.when(F.col("ord") % 3 == 0, 20.0).otherwise(0.0), "y": F.col("y") + F.when(k == 0, 0.4).when(k == 1, -11.8).otherwise(0.0)})
    return bl.reading_order(df, b.pages(spark, sf_dir)).select("doc_id", "old_id", "block_id", "ord")


@query("WITH " + b.BLOCKS_SQL + r""" SELECT kind, count(*)::BIGINT AS n, round(sum(confidence), 4) AS confidence FROM (
  SELECT CASE WHEN regexp_matches(trim(raw_text), '(?i)^answer\s*key\b') THEN 'answerKey' WHEN regexp_matches(trim(raw_text), '(?i)^example\b') THEN 'example'
    WHEN regexp_matches(trim(raw_text), '(?i)^[1-9]\d*\s+(choose|put|complete)\b') THEN 'instruction' WHEN regexp_matches(trim(raw_text), '^[1-9]\d*\s+') OR regexp_matches(raw_text, '_{3,}') THEN 'exercise' ELSE 'unknown' END AS kind,
    CASE kind WHEN 'unknown' THEN 0.65 WHEN 'exercise' THEN 0.9 ELSE 1.0 END AS confidence FROM v_blocks) GROUP BY 1""")
def b9_section_kinds(spark, sf_dir):
    """Blocks by section kind."""
    return bl.classify_sections(b.blocks(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query("WITH " + b.BLOCKS_SQL + """ SELECT doc_id, 'READING_ORDER_UNCERTAIN' AS code, 'warning' AS severity, block_id FROM v_blocks WHERE confidence < 0.8
UNION ALL SELECT doc_id, 'OCR_REQUIRED', 'blocking', NULL FROM documents WHERE coalesce(trim(text), '') = ''""")
def b11_text_layer_audit(spark, sf_dir):
    """B11."""
    return bl.audit_text_layer(b.table(spark, sf_dir, "documents").select("doc_id"), b.blocks(spark, sf_dir))


@query("WITH " + b.BLOCKS_SQL + """, p AS (SELECT doc_id, count(DISTINCT page_index) AS n_pages, count(*) AS n_blocks, sum(length(raw_text)) AS chars FROM v_blocks GROUP BY 1)
SELECT doc_id, n_pages::INTEGER AS n_pages, n_blocks::INTEGER AS n_blocks, chars::BIGINT AS chars FROM p""")
def b12_documents(spark, sf_dir):
    """Nested documents, measured."""
    docs = bl.assemble_document(b.blocks(spark, sf_dir), b.pages(spark, sf_dir))
    chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + F.length(x["raw_text"]))
    return docs.select("doc_id", F.size("pages").alias("n_pages"), F.size("blocks").alias("n_blocks"), chars.alias("chars"))


@query("WITH " + b.BLOCKS_SQL + r""", c AS (SELECT *, regexp_matches(trim(raw_text), '(?i)^(?:question\s*)?(\d{1,3})[.)\s]') AS s FROM v_blocks
  WHERE trim(raw_text) <> '' AND NOT regexp_matches(trim(raw_text), '(?i)^(?:page\s+)?\d+\s*(?:of\s+\d+)?$|^©')),
g AS (SELECT *, CASE WHEN bool_or(s) OVER (PARTITION BY doc_id) THEN sum(s::INTEGER) OVER (PARTITION BY doc_id ORDER BY ord) ELSE row_number() OVER (PARTITION BY doc_id ORDER BY ord) END AS n FROM c)
SELECT doc_id, n::BIGINT AS ord, 'unknown-candidate:' || n || ':' || arg_min(block_id, ord) AS candidate_id, string_agg(trim(raw_text), chr(10) ORDER BY ord) AS raw_prompt, count(*)::INTEGER AS n_blocks FROM g WHERE n > 0 GROUP BY doc_id, n""")
def e20_unknown_candidates(spark, sf_dir):
    """The fallback on every document."""
    return ex.unknown_candidates(b.blocks(spark, sf_dir)).select("doc_id", F.col("ord").cast("long"), "candidate_id", "raw_prompt", "n_blocks")


@query("WITH " + b.SOURCES_SQL + """ SELECT doc_id, owner_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash,
sha256(owner_id || chr(0) || client_key) AS owner_key FROM v_sources""".replace("sha256(owner_id || chr(0) || client_key)", "sha256(encode(owner_id) || '\\x00'::BLOB || encode(client_key))"))
def s3_identity(spark, sf_dir):
    """Content hash and owner key."""
    return intake.add_identity(b.sources(spark, sf_dir)).select("doc_id", "owner_id", "content_hash", "owner_key")


@query("WITH " + b.SOURCES_SQL + """ SELECT owner_id, arg_min(doc_id, (created_at, doc_id)) AS doc_id, sha256(text) AS content_hash FROM v_sources GROUP BY owner_id, text""")
def s4_first_sources(spark, sf_dir):
    """The first source of each owner and content."""
    return intake.dedupe_sources(intake.add_identity(b.sources(spark, sf_dir))).select("owner_id", "doc_id", "content_hash")


@query("WITH " + b.SOURCES_SQL + """ SELECT doc_id, 'codePoints' AS limit_type, 5000::BIGINT AS "limit", length(text)::BIGINT AS actual, true AS split_required FROM v_sources WHERE length(text) > 5000
UNION ALL SELECT page_id::VARCHAR, 'bytes', 4000, strlen(html)::BIGINT, false FROM pages WHERE strlen(html) > 4000""")
def s7_rejected(spark, sf_dir):
    """Limits small enough that some texts and raw pages pass them."""
    limits = intake.Limits(code_points=5000, bytes=4000)
    raw = b.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.octet_length("html").alias("n_bytes"))
    cols = ["doc_id", "limit_type", "limit", "actual", "split_required"]
    return intake.admit(b.sources(spark, sf_dir).drop("page_count"), limits)[1].select(cols).unionByName(intake.admit(raw, limits)[1].select(cols))


@also("s8_replays")
@query("WITH " + b.SOURCES_SQL + """, k AS (SELECT *, CASE WHEN length(text) % 9 > 0 THEN owner_id || substr(doc_id, length(doc_id)) END AS key, sha256(text) AS f, created_at >= (SELECT min(created_at) + (max(created_at) - min(created_at)) / 2 FROM v_sources) AS late FROM v_sources),
w AS (SELECT *, first_value(f) OVER o AS ff, row_number() OVER o AS n FROM k WINDOW o AS (PARTITION BY key, late ORDER BY created_at, doc_id)),
s AS (SELECT key, f AS old FROM w WHERE n = 1 AND NOT late)
SELECT doc_id, late, CASE WHEN w.key IS NULL THEN 'missing_key' WHEN n = 1 AND NOT (late AND s.key IS NOT NULL) THEN 'create' WHEN f = CASE WHEN late THEN coalesce(old, ff) ELSE ff END THEN 'replay' ELSE 'conflict' END AS outcome FROM w LEFT JOIN s USING (key)""")
def s8_stored_replays(spark, sf_dir):
    """The later half of the sources against what the earlier half has stored; all rows of both, some without a key."""
    src = b.sources(spark, sf_dir).withColumn("owner_key", F.when(F.length("text") % 9 > 0, F.concat("owner_id", F.substring("doc_id", -1, 1)))).withColumn("fingerprint", F.sha2("text", 256))
    lo, hi = F.unix_seconds(F.min("created_at")), F.unix_seconds(F.max("created_at"))
    src = src.crossJoin(F.broadcast(src.agg((lo + (hi - lo) / 2).alias("cut")))).withColumn("late", F.unix_seconds("created_at") >= F.col("cut"))
    early = intake.resolve_replay(src.where("not late"), src.limit(0))
    late = intake.resolve_replay(src.where("late"), early.where("outcome = 'create'"))
    return early.unionByName(late).select("doc_id", "late", "outcome")


@query("""SELECT 'line-order' AS edge, l_linenumber::VARCHAR AS entity_id, l_orderkey::VARCHAR AS missing FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order-line', o_orderkey::VARCHAR, o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def s11_orphans(spark, sf_dir):
    """Lines without order and orders without lines."""
    l, o = b.table(spark, sf_dir, "lineitem"), b.table(spark, sf_dir, "orders")
    return intake.orphan_rows([("line-order", l, o, "l_orderkey", "o_orderkey", "l_linenumber"), ("order-line", o, l, "o_orderkey", "l_orderkey", "o_orderkey")])


@query("""SELECT s_suppkey::VARCHAR AS entity_id, s_nationkey::VARCHAR AS owner_id, CASE WHEN c.c_custkey IS NULL THEN 'NO_PARENT' ELSE 'OTHER_OWNER' END AS code
FROM supplier LEFT JOIN customer c ON c_custkey = s_suppkey WHERE c.c_custkey IS NULL OR c_nationkey <> s_nationkey""")
def s10_tenant_violations(spark, sf_dir):
    """Suppliers as children of the customer with their key."""
    child = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("owner_id"))
    parent = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("string").alias("owner_id"))
    found = intake.tenant_violations(child, parent, "key", "id")
    return found.join(child.select("key", "owner_id"), "key").select("entity_id", "owner_id", "code")


_NORM_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'), '[?!.]+$', ''), '[\s\x{{00A0}}]+', ' ', 'g'))"
_GRADED_SQL = "WITH " + b.RESPONSES_SQL + ", g AS (SELECT *, " + _NORM_SQL.format(f"lower(translate(text, '{b.WIDE}', '{b.ASCII}'))") + " = " + _NORM_SQL.format("lower(p_name)") + " AS correct FROM v_responses)"


def _graded(spark, sf_dir):
    attempts = b.attempts(spark, sf_dir).withColumn("lesson_id", F.col("attempt_id")).select("attempt_id", "lesson_id", "lesson_version")
    return gr.graded_fields(attempts, b.asked_fields(spark, sf_dir), b.responses(spark, sf_dir))


@query(_GRADED_SQL + " SELECT attempt_id, field_id, text AS answer, correct, CASE WHEN NOT correct THEN p_name END AS shown FROM g WHERE attempt_id IN (SELECT o_orderkey FROM orders)")
def h3_graded_fields(spark, sf_dir):
    """H1-H3: every field of every attempt."""
    return _graded(spark, sf_dir).select("attempt_id", "field_id", "answer", "correct", F.col("shown")[0].alias("shown"))


@query(_GRADED_SQL + """ SELECT attempt_id, count(*) FILTER (correct)::BIGINT AS correct, count(*)::BIGINT AS total,
CASE count(*) FILTER (correct) WHEN count(*) THEN 'correct' WHEN 0 THEN 'incorrect' ELSE 'partial' END AS status FROM g WHERE attempt_id IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
def h6_attempt_scores(spark, sf_dir):
    """Score and status of every attempt."""
    return gr.attempt_scores(_graded(spark, sf_dir))


@query(_GRADED_SQL + """ SELECT attempt_id, p_brand AS exercise_id, count(*) FILTER (correct)::BIGINT AS correct, count(*)::BIGINT AS total,
CASE count(*) FILTER (correct) WHEN count(*) THEN 'correct' WHEN 0 THEN 'incorrect' ELSE 'partial' END AS status FROM g WHERE attempt_id IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2""")
def h6_exercise_rollup(spark, sf_dir):
    """H6: status of every exercise."""
    return gr.exercise_rollup(_graded(spark, sf_dir))


@query("WITH " + b.RESPONSES_SQL + """ SELECT DISTINCT attempt_id, 'UNKNOWN_FIELD' AS code FROM v_responses WHERE p_type = 'ECONOMY' UNION
SELECT o_orderkey, 'VERSION_MISMATCH' FROM orders WHERE o_orderkey % 97 = 0""")
def h4_rejects(spark, sf_dir):
    """H4 against a lesson that lacks the ECONOMY group, and attempts of a version that does not exist."""
    fields = b.fields(spark, sf_dir).where("group_id <> 'ECONOMY'")
    attempts = b.attempts(spark, sf_dir).withColumn("lesson_version", F.when(F.col("attempt_id") % 97 == 0, 2).otherwise(1))
    one = attempts.select("attempt_id", "lesson_id", F.lit(1).alias("lesson_version"))
    unknown = gr.attempt_rejects(one, fields, b.responses(spark, sf_dir))
    version = gr.attempt_rejects(attempts.select("attempt_id", "lesson_id", "lesson_version"), fields, b.responses(spark, sf_dir).limit(0))
    return unknown.unionByName(version)


@query("WITH " + b.RESPONSES_SQL + """ SELECT attempt_id, field_id, 'text' AS kind, text AS value, (row_number() OVER (PARTITION BY attempt_id ORDER BY field_id))::INTEGER AS ord FROM v_responses""")
def h8_response_rows(spark, sf_dir):
    """H8."""
    return gr.response_rows(b.responses(spark, sf_dir))


@also("h9_submissions")
@query("""WITH s AS (SELECT o_custkey AS attempt_id, o_orderstatus AS lesson, o_orderpriority AS f, o_orderdate AS made, o_orderdate >= TIMESTAMP '1998-01-01' AS late FROM orders),
w AS (SELECT *, sha256(encode(lesson) || '\\x00'::BLOB || encode(f)) AS p FROM s),
n AS (SELECT *, row_number() OVER o AS n, first_value(p) OVER o AS fp FROM w WINDOW o AS (PARTITION BY attempt_id, late ORDER BY made, p)),
old AS (SELECT attempt_id, p AS old FROM n WHERE n = 1 AND NOT late)
SELECT attempt_id, late, outcome, count(*)::BIGINT AS n FROM (SELECT attempt_id, late,
  CASE WHEN n = 1 AND NOT (late AND old IS NOT NULL) THEN 'create' WHEN p = CASE WHEN late THEN coalesce(old, fp) ELSE fp END THEN 'replay' ELSE 'conflict' END AS outcome
  FROM n LEFT JOIN old USING (attempt_id)) GROUP BY 1, 2, 3""")
def h9_stored_submissions(spark, sf_dir):
    """H9: orders from 1998 on against what the earlier ones have stored; all rows of both."""
    o = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("attempt_id"), F.col("o_orderstatus").alias("lesson_id"), F.col("o_orderpriority").alias("fingerprint"), F.col("o_orderdate").alias("created_at"))
    o = o.withColumn("late", F.col("created_at") >= F.lit("1998-01-01").cast("timestamp"))
    early = gr.submit_attempts(o.where("not late"), o.limit(0))
    late = gr.submit_attempts(o.where("late"), early.where("outcome = 'create'").select(o.columns))
    return early.unionByName(late).groupBy("attempt_id", "late", "outcome").agg(F.count("*").alias("n"))


_HISTORY = lb.HistoryParams(owner="NATION_3", query="customer#", delivery="sent", before=("1998-06-01", "999999"))


def _history_inputs(spark, sf_dir):
    a = b.attempts(spark, sf_dir).where(F.col("owner_id") == _HISTORY.owner)
    # only this owner's answers are graded
    asked = b.responses(spark, sf_dir).join(a.select("attempt_id"), "attempt_id", "left_semi")
    fields = b.asked_fields(spark, sf_dir).join(a.select(F.col("attempt_id").alias("lesson_id")), "lesson_id", "left_semi")
    own = a.withColumn("lesson_id", F.col("attempt_id")).select("attempt_id", "lesson_id", "lesson_version")
    scores = gr.attempt_scores(gr.graded_fields(own, fields, asked)).select("attempt_id", "correct", "total")
    a = a.join(scores, "attempt_id").withColumn("lesson_id", F.col("o_custkey"))
    lessons = a.select("lesson_id", F.concat(F.lit("Lesson of "), "student").alias("title")).distinct()
    outbox = a.where("o_orderstatus <> 'P'").select("attempt_id", F.when(F.col("o_orderstatus") == "F", "sent").otherwise("failed").alias("status"))
    return a, lessons, outbox


_HISTORY_SQL = _GRADED_SQL + """, sc AS (SELECT attempt_id, count(*) FILTER (correct)::BIGINT AS correct, count(*)::BIGINT AS total FROM g GROUP BY 1),
h AS (SELECT o_orderkey AS attempt_id, o_orderdate AS created_at, c_name AS student, correct, total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN sc ON sc.attempt_id = o_orderkey WHERE n_name = 'NATION_3' AND o_orderstatus = 'F')"""


@query(_HISTORY_SQL + """ SELECT attempt_id, created_at, student, correct, total FROM h WHERE created_at < TIMESTAMP '1998-06-01' OR (created_at = TIMESTAMP '1998-06-01' AND attempt_id < 999999)
ORDER BY created_at DESC, attempt_id DESC LIMIT 25""")
def h10_history_page(spark, sf_dir):
    """One keyset page."""
    return lb.attempt_history(*_history_inputs(spark, sf_dir), _HISTORY).select("attempt_id", "created_at", "student", "correct", "total")


@query(_HISTORY_SQL + " SELECT count(*)::BIGINT AS total_matched FROM h")
def h10_history_total(spark, sf_dir):
    """The total, which does not depend on the page."""
    return lb.history_rows(*_history_inputs(spark, sf_dir), _HISTORY).agg(F.count("*").alias("total_matched"))


@query(_GRADED_SQL + """ SELECT g.attempt_id, field_id, text AS answer, correct, p_brand AS exercise_id FROM g WHERE attempt_id IN (SELECT max(o_orderkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))""")
def h11_attempt_detail(spark, sf_dir):
    """The newest attempt."""
    graded = _graded(spark, sf_dir)
    newest = b.table(spark, sf_dir, "orders").join(b.table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).agg(F.max("o_orderkey").alias("attempt_id"))
    rows = graded.join(newest, "attempt_id", "left_semi").select("attempt_id", "lesson_id", "lesson_version", "field_id", "answer", "correct")
    fields = b.asked_fields(spark, sf_dir).withColumn("prompt", F.col("exercise_id"))
    known, _ = lb.attempt_detail(F.col("attempt_id"), rows, fields)
    return known.select("attempt_id", "field_id", "answer", "correct", "exercise_id")


@also("h13_reports")
@query("WITH " + b.RESPONSES_SQL + """, l AS (SELECT attempt_id, length('+ ' || p_brand || ': ' || text) AS n, field_id, p_brand || ': ' || text AS t FROM v_responses),
p AS (SELECT attempt_id, field_id, t, unnest(range(0, n, 3900)) AS k, n FROM l), s AS (SELECT attempt_id, list([(k > 0)::BIGINT, least(n - k, 3900)] ORDER BY field_id, t, k) AS steps FROM p GROUP BY 1),
f AS (SELECT attempt_id, list_reduce(list_prepend([]::BIGINT[], list_transform(steps, lambda x: x::BIGINT[])), lambda a, x:
  CASE WHEN len(a) > 0 AND x[1] = 0 AND a[-1] + 1 + x[2] <= 3900 THEN list_append(a[:-2], a[-1] + 1 + x[2]) ELSE list_append(a, x[2]) END) AS parts FROM s)
SELECT attempt_id, unnest(range(len(parts)))::INTEGER AS part, unnest(parts)::INTEGER AS characters FROM f""")
def h13_report_parts(spark, sf_dir):
    """Every part of every attempt's report."""
    return gr.report_parts(_responses_as_rows(spark, sf_dir)).select("attempt_id", "part", F.length("body").alias("characters"))


def _responses_as_rows(spark, sf_dir):
    r = b.responses(spark, sf_dir).join(b.fields(spark, sf_dir).select("field_id", "exercise_id"), "field_id")
    return r.select("attempt_id", F.col("field_id").alias("ord"), F.col("exercise_id").alias("prompt"), F.col("text").alias("answer"), (F.col("quantity") % 3 < 2).alias("correct"))


@query("WITH " + b.RESPONSES_SQL + f""", n AS (SELECT *, (row_number() OVER (PARTITION BY attempt_id ORDER BY field_id))::INTEGER AS ord, field_id % 3 > 0 AS ok FROM v_responses),
w AS (SELECT *, (CASE WHEN ok THEN '✅' ELSE '❌' END) || ' ' || ord || '. ' AS pre, CASE WHEN ok THEN '' ELSE p_name || ' / ' || p_brand END AS acc, 250 - {len(gr.REPORT_CONTINUED)} - 2 AS room FROM n),
x AS (SELECT *, greatest(32, room - length(pre) - 11 - length(acc)) AS free, room // 2 AS half FROM w),
k AS (SELECT attempt_id, ord, pre || CASE WHEN length(text) > free THEN substr(text, 1, free - 1) || '…' ELSE text END ||
  CASE WHEN ok THEN '' ELSE chr(10) || '   {gr.REPORT_RIGHT}: ' || CASE WHEN length(acc) > half THEN substr(acc, 1, half - 1) || '…' ELSE acc END END AS block FROM x),
l AS (SELECT attempt_id, list([block] ORDER BY ord) AS blocks FROM k GROUP BY 1),
s AS (SELECT attempt_id, count(*) AS total, count(*) FILTER (ok) AS correct FROM n GROUP BY 1),
h AS (SELECT o_orderkey AS attempt_id, '{gr.REPORT_TITLE}' || chr(10) || '<b>' || replace(replace(replace(o_orderpriority || ' & ' || o_orderstatus, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</b> · {gr.REPORT_VERSION} 1' || chr(10) ||
  '{gr.REPORT_STUDENT}: ' || c_name || chr(10) || '{gr.REPORT_SCORE}: <b>' || coalesce(correct, 0) || ' {gr.REPORT_OF} ' || coalesce(total, 0) || '</b>' AS head FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN s ON s.attempt_id = o_orderkey),
f AS (SELECT h.attempt_id, list_reduce(list_prepend([head], coalesce(blocks, []::VARCHAR[][])), lambda a, y: CASE WHEN length(a[-1]) + length(y[1]) + 2 > 250
  THEN list_append(a, '{gr.REPORT_CONTINUED}' || chr(10) || chr(10) || y[1]) ELSE list_append(a[:-2], a[-1] || chr(10) || chr(10) || y[1]) END) AS parts FROM h LEFT JOIN l USING (attempt_id))
SELECT attempt_id, unnest(range(len(parts)))::INTEGER AS part, unnest(parts) AS body FROM f""")
def h13_result_messages(spark, sf_dir):
    """The result message of every order, in parts of 250 so that many have several."""
    r = b.responses(spark, sf_dir).join(b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("field_id"), "p_name", "p_brand"), "field_id")
    ord_ = F.row_number().over(W.partitionBy("attempt_id").orderBy("field_id"))
    rows = r.select("attempt_id", ord_.alias("ord"), F.col("text").alias("answer"), (F.col("field_id") % 3 > 0).alias("correct"), F.array("p_name", "p_brand").alias("accepted"))
    score = rows.groupBy("attempt_id").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    o, c = b.table(spark, sf_dir, "orders"), b.table(spark, sf_dir, "customer")
    heads = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("attempt_id"), F.concat("o_orderpriority", F.lit(" & "), "o_orderstatus").alias("title"), F.lit(1).alias("lesson_version"), F.col("c_name").alias("student"))
    heads = heads.join(score, "attempt_id", "left").fillna(0, ["correct", "total"])
    return gr.result_report(heads, rows, 250)


def _library(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    lessons = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lesson_id"), F.col("c_name").alias("title"), F.timestamp_seconds(F.lit(10**9) + F.col("c_custkey") % 500).alias("created_at"))
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    versions = o.select(F.col("o_custkey").alias("lesson_id"), n.alias("version"), F.col("o_orderkey").alias("version_id"))
    runs = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_name").alias("title"), F.timestamp_seconds(F.lit(10**9) + F.col("s_suppkey") % 7).alias("updated_at"))
    return lessons, versions, runs


@query("""SELECT o_custkey AS lesson_id, count(*)::BIGINT AS n_versions, count(*)::INTEGER AS latest, max(o_orderkey) AS latest_id FROM orders GROUP BY 1""")
def h15_version_counts(spark, sf_dir):
    """Versions of every lesson."""
    return lb.version_counts(_library(spark, sf_dir)[1])


@query("""WITH v AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT 0 AS rank, 'published' AS kind, c_custkey::VARCHAR AS card_id, c_name AS title, make_timestamp((1000000000 + c_custkey % 500) * 1000000) AS made, greatest(coalesce(n, 0), 1)::BIGINT AS n_versions FROM customer LEFT JOIN v ON o_custkey = c_custkey
  UNION ALL SELECT 1, 'draft', s_suppkey::VARCHAR, s_name, make_timestamp((1000000000 + s_suppkey % 7) * 1000000), 0 FROM supplier)
SELECT kind, card_id, title, n_versions FROM c WHERE contains(lower(title), '00001') ORDER BY rank, made DESC, card_id DESC LIMIT 24 OFFSET 24""")
def h14_library_page(spark, sf_dir):
    """The second page of a search."""
    return lb.library_page(lb.library_cards(*_library(spark, sf_dir), query=" 00001 "), 1).select("kind", "card_id", "title", "n_versions")

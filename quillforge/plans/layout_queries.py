"""Registered queries over laid-out blocks, answer keys, reconciliation, contracts, review and runs.

Layouts are made from the supplied texts by a column expression each, given again in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.operators import answer_key as ak
from quillforge.operators import blocks as bl
from quillforge.operators import extract as ex
from quillforge.operators import grading as gr
from quillforge.operators import planning as pl
from quillforge.operators import publish as pb
from quillforge.operators import quality as ql
from quillforge.operators import reconcile as rc
from quillforge.operators import review as rv
from quillforge.operators import runs as rn
from quillforge.plans import bindings as b
from quillforge.plans.queries import query
from quillforge.sources import intake

# ---- a workbook: every document's lines as instruction groups, items, options and an answer key


def workbook(spark, sf_dir):
    """Blocks whose text depends on their place: headings, gaps with options, slashes, bracket gaps, tabbed values, a key."""
    df = b.blocks(spark, sf_dir).withColumn("w", F.regexp_extract("raw_text", r"^([A-Za-z]+)", 1))
    k, g, n = F.col("ord") % 6, F.floor(F.col("ord") / 6) % 6 + 1, F.col("ord") % 6 + F.floor(F.col("ord") / 36) * 6
    n, g = n.cast("int").cast("string"), g.cast("int")
    c = F.concat
    item = F.when(g == 1, F.when(k % 2 == 1, c(n, F.lit(" The "), "w", F.lit(" ___ here."))).otherwise(c(F.lit("a "), "w", F.lit(" b other c third")))).when(
        g == 2, c(n, F.lit(" the / "), "w", F.lit(" / is / red"))).when(
        g == 3, c(n, F.lit(" ____ ("), "w", F.lit(") and then"))).when(
        g == 4, c(n, F.lit(" cat\tdog\t"), "w")).when(k == 1, c("w", F.lit("\tsecond"))).otherwise(c(n, F.lit(" A ___ for "), "w", F.lit(".")))
    head = F.when(g == 6, "Answer key").otherwise(c(g.cast("string"), F.when(g % 2 == 1, " Choose the word.").otherwise(" Put the words")))
    key = F.when(k == 1, c(F.lit("Exercise "), (F.floor(F.col("ord") / 36) % 5 + 1).cast("int").cast("string"))).otherwise(c(n, F.lit(" a, "), n, F.lit(" b")))
    text = F.when(k == 0, head).when(g == 6, key).otherwise(item)
    return df.withColumn("raw_text", text).drop("w")


_WORKBOOK_SQL = r"""v_wb0 AS (SELECT *, regexp_extract(raw_text, '^([A-Za-z]+)', 1) AS w, ord % 6 AS k, (ord // 6) % 6 + 1 AS g, (ord % 6 + (ord // 36) * 6)::VARCHAR AS n FROM v_blocks),
v_wb AS (SELECT doc_id, block_id, page_index, ord, x, y, width, height, confidence, CASE
  WHEN k = 0 THEN CASE WHEN g = 6 THEN 'Answer key' WHEN g % 2 = 1 THEN g || ' Choose the word.' ELSE g || ' Put the words' END
  WHEN g = 6 THEN CASE WHEN k = 1 THEN 'Exercise ' || ((ord // 36) % 5 + 1) ELSE n || ' a, ' || n || ' b' END
  WHEN g = 1 THEN CASE WHEN k % 2 = 1 THEN n || ' The ' || w || ' ___ here.' ELSE 'a ' || w || ' b other c third' END
  WHEN g = 2 THEN n || ' the / ' || w || ' / is / red' WHEN g = 3 THEN n || ' ____ (' || w || ') and then'
  WHEN g = 4 THEN n || ' cat' || chr(9) || 'dog' || chr(9) || w WHEN k = 1 THEN w || chr(9) || 'second' ELSE n || ' A ___ for ' || w || '.' END AS raw_text, k, g, n, w FROM v_wb0)"""
_WB = "WITH " + b.BLOCKS_SQL + ", " + _WORKBOOK_SQL


@query(_WB + """ SELECT kind, count(*)::BIGINT AS n, round(sum(confidence)::DOUBLE, 4) AS confidence FROM (
  SELECT CASE WHEN k = 0 AND g < 6 THEN 'instruction' WHEN g = 6 THEN 'answerKey' WHEN g = 1 AND k % 2 = 0 OR g = 5 AND k = 1 THEN 'unknown'
    WHEN n = '0' AND g <> 1 AND g < 3 OR n = '0' AND g = 4 THEN 'unknown' ELSE 'exercise' END AS kind,
    CASE kind WHEN 'unknown' THEN 0.65 WHEN 'exercise' THEN 0.9 WHEN 'instruction' THEN 1.0 ELSE CASE WHEN k = 0 THEN 1.0 ELSE 0.95 END END AS confidence FROM v_wb) GROUP BY 1""")
def b9_workbook_sections(spark, sf_dir):
    """Every kind of section but examples, with the answer key going on to the next instruction."""
    return bl.classify_sections(workbook(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query(_WB + """ SELECT doc_id, block_id, g::INTEGER AS "group", k = 0 OR g = 2 AND n = '0' AS part FROM v_wb WHERE g < 6""")
def e6_group_slices(spark, sf_dir):
    """Blocks of the groups; the heading is the instruction, the numbered block after it ends it."""
    return ex.slice_groups(workbook(spark, sf_dir)).select("doc_id", "block_id", "group", "part")


@query(_WB + """, nx AS (SELECT *, lead(raw_text) OVER (PARTITION BY doc_id, ord // 6 ORDER BY ord) AS opts, lead(w) OVER (PARTITION BY doc_id, ord // 6 ORDER BY ord) AS nw FROM v_wb WHERE g = 1 AND k > 0)
SELECT doc_id, n::INTEGER AS ordinal, 'The ' || w || ' ___ here.' AS prompt, (CASE WHEN nw = '' THEN 2 ELSE 3 END)::INTEGER AS n_options FROM nx WHERE k % 2 = 1 AND opts IS NOT NULL""")
def e7_single_choice(spark, sf_dir):
    """Prompts with a gap and the options of the block after them."""
    found = ex.extract_single_choice(ex.slice_groups(workbook(spark, sf_dir)))
    return found.select("doc_id", "ordinal", "prompt", F.size("options").alias("n_options"))


@query(_WB + """ SELECT doc_id, n::INTEGER AS ordinal, array_to_string(list_filter(['the', trim(w), 'is', 'red'], lambda x: x <> ''), '|') AS tokens FROM v_wb WHERE g = 2 AND k > 0 AND n <> '0'""")
def e9_word_order(spark, sf_dir):
    """Lines with slashes and their tokens."""
    return ex.extract_word_order(ex.slice_groups(workbook(spark, sf_dir))).select("doc_id", "ordinal", F.array_join("tokens", "|").alias("tokens"))


@query(_WB + """ SELECT doc_id, n::INTEGER AS ordinal, '(' || w || ')' AS prompt FROM v_wb WHERE g = 3 AND k > 0 AND w <> ''""")
def e10_bracket_gaps(spark, sf_dir):
    """A gap and its verb in every block."""
    return ex.extract_bracket_gaps(ex.slice_groups(workbook(spark, sf_dir))).select("doc_id", "ordinal", "prompt")


@query(_WB + """ SELECT doc_id, n::INTEGER AS ordinal, 'cat | dog | ' || w AS prompt, 3::INTEGER AS n_options FROM v_wb WHERE g = 4 AND k > 0 AND w <> ''""")
def e11_odd_one_out(spark, sf_dir):
    """Three values between tabs."""
    return ex.extract_odd_one_out(ex.slice_groups(workbook(spark, sf_dir))).select("doc_id", "ordinal", "prompt", F.size("options").alias("n_options"))


@query(_WB + """, bank AS (SELECT doc_id, ord // 6 AS s, list_filter([w, 'second'], lambda x: x <> '') AS vs FROM v_wb WHERE g = 5 AND k = 1),
it AS (SELECT doc_id, ord // 6 AS s, n::INTEGER AS ordinal FROM v_wb WHERE g = 5 AND k > 1)
SELECT doc_id, ordinal, array_to_string(vs, '|') AS bank, 'group:5:bank' AS shared_resource_id FROM it JOIN bank USING (doc_id, s)""")
def e12_word_banks(spark, sf_dir):
    """Gap items with the bank before them; the items keep the id of the shared bank."""
    found = ex.extract_word_bank(ex.slice_groups(workbook(spark, sf_dir)))
    shared, _ = ex.hoist_shared_resources(found)
    both = shared.select("doc_id", "exercise_id", "ord", "shared_resource_id").join(found.select("doc_id", "ord", "ordinal", "options"), ["doc_id", "ord"])
    return both.select("doc_id", "ordinal", F.array_join(F.transform("options", lambda o: o["value"]), "|").alias("bank"), "shared_resource_id")


@query(_WB + """, e AS (SELECT doc_id, block_id, (ord // 36) % 5 + 1 AS gr, n FROM v_wb WHERE g = 6 AND k > 1)
SELECT doc_id, block_id, gr::INTEGER AS "group", n::INTEGER AS ordinal, unnest(['a', 'b']) AS label FROM e""")
def e21_key_entries(spark, sf_dir):
    """Entries of the answer keys, by exercise."""
    df = workbook(spark, sf_dir)
    keyed = df.where(bl.has_key_marker(F.col("raw_text"))).select("doc_id").distinct()
    # a key goes on to the end of its text, so each key is read up to the next heading
    part = F.floor(F.col("ord") / 36)
    df = df.join(keyed, "doc_id", "left_semi").where(F.floor(F.col("ord") / 6) % 6 == 5)
    found = ak.answer_key_entries(df.withColumn("doc_id", F.struct("doc_id", part.alias("part"))))
    return found.select("doc_id.doc_id", "block_id", "group", "ordinal", "label")


@query(_WB + """, t AS (SELECT doc_id, n::INTEGER AS ordinal, ord // 36 AS part FROM v_wb WHERE g = 6 AND k > 1)
SELECT doc_id, 'x' || ordinal AS entity_id, 'ANSWER_KEY_CONFLICT' AS code, 'a,b' AS evidence FROM t WHERE ordinal % 2 = 0""")
def e22_key_conflicts(spark, sf_dir):
    """Items for which the key names two letters."""
    df = workbook(spark, sf_dir).where((F.floor(F.col("ord") / 6) % 6 == 5) & (F.col("ord") % 6 != 1))
    entries = ak.answer_key_entries(df.withColumn("raw_text", F.when(F.col("ord") % 2 == 1, F.regexp_replace("raw_text", ", .*", "")).otherwise(F.col("raw_text"))))
    targets = entries.select("doc_id", "group", "ordinal").distinct().withColumns({
        "exercise_id": F.concat(F.lit("x"), "ordinal"), "field_id": F.concat(F.lit("f"), "ordinal")})
    options = targets.select("exercise_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("label"), F.lit("v").alias("value")).distinct()
    return ak.reconcile_key(targets, entries, options)[1].select("doc_id", "entity_id", "code", "evidence")


# ---- items of a page: lines and blocks

@query("WITH " + b.BLOCKS_SQL + r""", w AS (SELECT doc_id, page_index, ord, x, y, unnest(string_split(raw_text, ' ')) AS t, unnest(range(len(string_split(raw_text, ' ')))) AS i FROM v_blocks WHERE trim(raw_text) <> ''),
p AS (SELECT doc_id, page_index, x >= 300 AS rt, y, string_agg(t, ' ' ORDER BY i) AS raw_text FROM w GROUP BY 1, 2, 3, 4)
SELECT doc_id, page_index, rt::INTEGER AS half, y::DOUBLE AS y, trim(raw_text) AS raw_text FROM p WHERE trim(raw_text) <> ''""")
def b6_line_blocks(spark, sf_dir):
    """The words of every line as layout items a little above or below it, put together again."""
    df = b.blocks(spark, sf_dir).where(F.trim("raw_text") != "").select("*", F.posexplode(F.split("raw_text", " ")).alias("i", "t"))
    items = df.select(
        "doc_id", "page_index", (F.col("ord") * 100_000 + F.col("i")).alias("seq"), F.col("t").alias("text"), (F.col("x") + F.col("i") / 1000).alias("x"),
        (F.col("y") + (F.col("i") % 3) * 0.5).alias("y"), (F.lit(0.001) - 2).alias("width"), "height", "confidence")
    lines = bl.items_to_lines(items, b.pages(spark, sf_dir))
    return bl.lines_to_blocks(lines).select("doc_id", "page_index", "half", "y", "raw_text")


@query("""SELECT doc_id, sum(length(text))::BIGINT AS raw_end, length(trim(regexp_replace(regexp_replace(any_value(text), '(\\p{L})-\\r?\\n(\\p{Ll})', '\\1\\2', 'g'), '\\s+', ' ', 'g')))::BIGINT AS norm_end
FROM documents WHERE text <> '' GROUP BY doc_id""")
def b2_span_ends(spark, sf_dir):
    """B2: the pieces of every text reach the end of the raw and of the normalized text."""
    spans = bl.span_map(b.table(spark, sf_dir, "documents"))
    return spans.groupBy("doc_id").agg(F.max("raw_end").alias("raw_end"), F.max("norm_end").alias("norm_end"))


# ---- sources and events

@query("""SELECT event_id, user_id, (props::JSON->>'k')::INTEGER AS k, false AS bad FROM events""")
def s2_payloads(spark, sf_dir):
    """Typed payloads of all events."""
    df = intake.read_artifacts(b.table(spark, sf_dir, "events"), "props", T.StructType([T.StructField("k", T.IntegerType())]))
    return df.select("event_id", "user_id", F.col("artifact.k").alias("k"), F.col("bad_json").isNotNull().alias("bad"))


@query("""SELECT event_id, '{"tokenUsage":' || event_id || ',"nested":{"sessionToken":"[REDACTED]","list":[{"rawText":"[REDACTED]","n":1}]},"step":"' || event_type || '"}' AS payload
FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, '{"step":"' || event_type || '","n":' || event_id || '}' FROM events WHERE event_id % 2 = 1""")
def st11_redacted(spark, sf_dir):
    """ST11: payloads of all events, every other one with sensitive keys at several depths."""
    e = b.table(spark, sf_dir, "events")
    full = F.concat(F.lit('{"tokenUsage":'), "event_id", F.lit(',"nested":{"sessionToken":"abc","list":[{"rawText":"a text","n":1}]},"step":"'), "event_type", F.lit('"}'))
    short = F.concat(F.lit('{"step":"'), "event_type", F.lit('","n":'), "event_id", F.lit("}"))
    return rn.redact(e.select("event_id", F.when(F.col("event_id") % 2 == 0, full).otherwise(short).alias("payload")), "payload")


@query("""SELECT event_id AS request_id, user_id AS run_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 'conflict'
  WHEN user_id % 3 = 0 THEN 'create' ELSE 'rejected' END AS outcome FROM events""")
def st9_resumes(spark, sf_dir):
    """ST9: events as resume requests of their user's run; a third of the runs may resume."""
    e = b.table(spark, sf_dir, "events")
    runs = e.select(F.col("user_id").alias("run_id")).distinct().withColumns({
        "status": F.lit("failed"), "failure_kind": F.when(F.col("run_id") % 3 == 0, "retriable").otherwise("terminal"), "resume_allowed": F.lit(True)})
    asked = e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("run_id"), F.col("user_id").alias("key"), F.col("event_id").cast("string").alias("fingerprint"), F.col("ts").alias("created_at"))
    return rn.resume_runs(runs, asked, asked.limit(0)).select("request_id", "run_id", "outcome")


@query("""WITH f AS (SELECT user_id AS run_id, event_id, ts, user_id % 4 <> 0 AND max(ts) OVER (PARTITION BY user_id) <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 180 SECOND AS stale,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id AS request_id, run_id, CASE WHEN n > 1 THEN 'conflict' WHEN stale THEN 'create' ELSE 'rejected' END AS outcome FROM f""")
def st10_redispatches(spark, sf_dir):
    """ST10: events as redispatch requests; every fourth run has a draft."""
    e = b.table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("updated_at")).withColumn("status", F.lit("processing"))
    asked = e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("run_id"), F.col("user_id").alias("key"), F.col("event_id").cast("string").alias("fingerprint"), F.col("ts").alias("created_at"))
    stored = rn.sequence_events(b.run_events(spark, sf_dir))
    out, _ = rn.redispatch(runs, runs.where("run_id % 4 = 0"), asked, asked.limit(0), stored, "2024-01-20 00:00:00")
    return out.select("request_id", "run_id", "outcome")


# ---- reconciliation

def _proposals(spark, sf_dir):
    """Lines as proposals: the order is the document, the line number the position."""
    return b.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("e"), F.col("l_partkey") % 50).alias("id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"),
        (F.col("l_quantity") % 3).cast("int").alias("ordinal"), F.concat(F.lit("r"), F.col("l_orderkey") % 30).alias("region"), (F.col("l_quantity") / 50).alias("confidence"))


_PROPOSALS_SQL = """v_prop AS (SELECT l_suppkey AS doc_id, 'e' || (l_partkey % 50) AS id, (l_orderkey, l_linenumber, l_partkey) AS seq, (l_quantity % 3)::INTEGER AS ordinal,
  'r' || (l_orderkey % 30) AS region, l_quantity / 50 AS confidence FROM lineitem),
v_lead AS (SELECT *, first_value(ordinal) OVER (PARTITION BY doc_id, id ORDER BY seq) AS lead_ordinal FROM v_prop)"""


@query("WITH " + _PROPOSALS_SQL + """ SELECT doc_id, id AS group_id, lead_ordinal AS ordinal, count(DISTINCT region) FILTER (ordinal = lead_ordinal)::INTEGER AS n_regions,
count(*) FILTER (ordinal <> lead_ordinal)::BIGINT AS n_conflicts FROM v_lead GROUP BY 1, 2, 3""")
def w6_merged_groups(spark, sf_dir):
    """Groups merged by id where the ordinal agrees, and how many rows conflict."""
    g = _proposals(spark, sf_dir).select("doc_id", F.col("id").alias("group_id"), "seq", "ordinal", F.array("region").alias("region_ids"), "confidence")
    merged, wrong = rc.merge_groups(g)
    n = wrong.groupBy("doc_id", F.col("owner_id").alias("group_id")).agg(F.count("*").alias("n"))
    return merged.join(n, ["doc_id", "group_id"], "left").select("doc_id", "group_id", "ordinal", F.size("region_ids").alias("n_regions"), F.coalesce("n", F.lit(0)).alias("n_conflicts"))


@query("WITH " + _PROPOSALS_SQL + """ SELECT doc_id, id AS exercise_id, count(DISTINCT region) FILTER (ordinal = lead_ordinal)::INTEGER AS n_prompts FROM v_lead GROUP BY 1, 2""")
def w7_merged_exercises(spark, sf_dir):
    """Exercises merged by id where ordinal, kind, source ordinal and number of fields agree."""
    e = _proposals(spark, sf_dir).select(
        "doc_id", F.col("id").alias("exercise_id"), "seq", F.lit("g").alias("group_id"), "ordinal", F.lit("gap").alias("kind"), F.lit(1).alias("source_ordinal"),
        F.lit(1).alias("n_fields"), F.array("region").alias("prompt_region_ids"), "confidence")
    return rc.merge_exercises(e)[0].select("doc_id", "exercise_id", F.size("prompt_region_ids").alias("n_prompts"))


@query("""SELECT DISTINCT l_suppkey AS doc_id, 'DANGLING_RELATION' AS code, 'e' || (l_partkey % 50) AS owner_id FROM lineitem WHERE l_orderkey % 30 >= 25""")
def w11_dangling_groups(spark, sf_dir):
    """Owners that name a region which is not there."""
    p = _proposals(spark, sf_dir)
    owners = p.groupBy("doc_id", "id").agg(F.collect_set("region").alias("region_ids"))
    regions = p.where("cast(substring(region, 2) as int) < 25").select("doc_id", F.col("region").alias("region_id")).distinct()
    return rc.dangling(owners, "id", "region_ids", regions, "region_id").select("doc_id", "code", "owner_id")


@query("""SELECT DISTINCT l_suppkey AS doc_id, 'MIXED_INSTRUCTION_AND_ITEMS' AS code, 'e' || (l_partkey % 50) AS owner_id FROM lineitem WHERE l_orderkey % 30 % 7 = 0""")
def w12_prompt_roles(spark, sf_dir):
    """Prompts that are regions of another role."""
    p = _proposals(spark, sf_dir)
    e = p.groupBy("doc_id", F.col("id").alias("exercise_id")).agg(F.collect_set("region").alias("prompt_region_ids"))
    role = F.when(F.expr("cast(substring(region, 2) as int) % 7 = 0"), "instruction").otherwise("exercisePrompt")
    regions = p.select("doc_id", F.col("region").alias("region_id")).distinct().withColumn("role", F.expr("if(cast(substring(region_id, 2) as int) % 7 = 0, 'instruction', 'exercisePrompt')"))
    return rc.prompt_role_conflicts(e, regions).select("doc_id", "code", "owner_id")


_STRUCTURES = """WITH e AS (SELECT event_id AS d, event_type, event_id % 5 AS k, CASE WHEN event_id % 3 > 0 THEN 'b1' ELSE 'document:' || event_id END AS first, CASE WHEN user_id % 2 = 0 THEN 'p1|p2' ELSE 'unresolved:proposal' END AS ps FROM events),
c AS (SELECT d, 'conflict:LOW_CONFIDENCE:b1|b2:' || ps AS id FROM e WHERE event_type = 'error' UNION ALL SELECT d, 'conflict:MISSING_BLOCK:unresolved:block:p9' FROM e WHERE event_type = 'error'
  UNION ALL SELECT d, 'conflict:INVALID_INTERACTION:g:' || ps FROM e WHERE k = 1 UNION ALL SELECT d, 'conflict:INVALID_INTERACTION:x:' || ps FROM e WHERE k = 2
  UNION ALL SELECT d, 'conflict:INVALID_INTERACTION:' || first || ':' || ps FROM e WHERE k IN (0, 1)) """


def _structures(spark, sf_dir):
    """Events as documents.  Errors bring two conflicts, one of them twice; a fifth each has no group, no exercise, an exercise without fields."""
    e = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type", "user_id", (F.col("event_id") % 5).alias("k"))
    docs = e.withColumn("proposal_ids", F.when(F.col("user_id") % 2 == 0, F.array(F.lit("p1"), F.lit("p2"))).otherwise(F.array().cast("array<string>")))
    none = F.lit(None).cast("array<string>")
    low = e.where("event_type = 'error'").select("doc_id", F.lit("LOW_CONFIDENCE").alias("code"), F.lit("r").alias("owner_id"), F.array(F.lit("b1"), F.lit("b2"), F.lit("b1")).alias("block_ids"), none.alias("proposal_ids"))
    missing = e.where("event_type = 'error'").select("doc_id", F.lit("MISSING_BLOCK").alias("code"), F.lit("b").alias("owner_id"), F.array().cast("array<string>").alias("block_ids"), F.array(F.lit("p9")).alias("proposal_ids"))
    groups = e.where("k > 0").select("doc_id", F.lit("g").alias("group_id"))
    exercises = e.where("k > 1").select("doc_id", F.lit("g").alias("group_id"), F.lit("x").alias("exercise_id"), F.when(F.col("k") != 2, 1).alias("n_fields"))
    blocks = e.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).withColumn("block_id", F.concat(F.lit("b"), "ord"))
    blocks = blocks.withColumn("raw_text", F.when((F.col("doc_id") % 3 > 0) & (F.col("ord") == 1), "text").otherwise(" "))
    return rc.finalize_structure(docs, groups, exercises, low.unionByName(low).unionByName(missing), blocks)


@query(_STRUCTURES + "SELECT d AS doc_id, count(DISTINCT id)::INTEGER AS n_conflicts, CASE WHEN count(id) > 0 THEN 'needsReview' ELSE 'valid' END AS status FROM e LEFT JOIN c USING (d) GROUP BY d")
def w18_structure_status(spark, sf_dir):
    """The status of every document."""
    return _structures(spark, sf_dir)[1].withColumn("n_conflicts", F.col("n_conflicts").cast("int"))


@query(_STRUCTURES + "SELECT DISTINCT d AS doc_id, id AS conflict_id FROM c")
def w18_conflict_ids(spark, sf_dir):
    """The conflicts of every document, each once."""
    return _structures(spark, sf_dir)[0].select("doc_id", "conflict_id")


@query("""SELECT event_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN '1.0.0' ELSE '1.1.0' END AS old, '1.1.0' AS schema_version FROM events WHERE NOT (event_id % 3 = 0 AND event_type = 'error')""")
def w20_upcast(spark, sf_dir):
    """Structures of both versions; legacy ones with a newer code are left out, those with an old code stay."""
    e = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type", F.when(F.col("event_id") % 3 == 0, "1.0.0").otherwise("1.1.0").alias("schema_version"))
    code = F.when(F.col("event_type") == "error", "NON_ATOMIC_EXERCISE").when(F.col("event_type") == "click", "ORDER_CONFLICT").otherwise("OVERLAPPING_OWNERSHIP")
    good, _ = rc.upcast_structure(e.withColumn("old", F.col("schema_version")), e.select("doc_id", code.alias("code")))
    return good.select("doc_id", "old", "schema_version")


# ---- contracts, gate and students' copy

def _lesson(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 4 == 0, "wordBankGap").when(F.col("p_size") % 4 == 1, "singleChoice").otherwise("shortText")
    ex_ = p.select(
        F.lit(1).alias("doc_id"), F.col("p_brand").alias("group_id"), F.col("p_partkey").cast("string").alias("exercise_id"), F.col("p_size").alias("ord"), kind.alias("kind"),
        F.col("p_name").alias("prompt"), F.when(F.col("p_size") % 8 == 0, F.concat("p_brand", F.lit(":bank"))).alias("shared_resource_id"))
    options = p.select(F.lit(1).alias("doc_id"), F.col("p_partkey").cast("string").alias("exercise_id"), F.posexplode(F.slice(F.split("p_name", " "), 1, F.col("p_partkey") % 3)).alias("ord", "value"))
    return ex_, options


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS id, p_size, least(p_partkey % 3, len(string_split(p_name, ' '))) AS n FROM part)
SELECT id AS entity_id, 'TOO_FEW_OPTIONS' AS code FROM p WHERE p_size % 4 = 1 AND n < 2 UNION ALL SELECT id, 'RESOURCE_MISSING' FROM p WHERE p_size % 4 = 0 AND p_size % 8 <> 0
UNION ALL SELECT id, 'RESOURCE_UNKNOWN' FROM part JOIN p ON id = p_partkey::VARCHAR WHERE part.p_size % 8 = 0 AND p_brand = 'Brand#7'""")
def v4_contract(spark, sf_dir):
    """V4: parts as exercises: choices without options, banks that are missing or unknown."""
    ex_, options = _lesson(spark, sf_dir)
    groups = ex_.select("doc_id", "group_id").distinct().withColumns({"completeness": F.lit("complete"), "missing_boundary": F.lit(None).cast("string")})
    options = options.withColumn("option_id", F.concat_ws(":", "exercise_id", F.col("ord").cast("string")))
    fields = ex_.select("doc_id", "exercise_id", F.concat(F.lit("f"), "exercise_id").alias("field_id"), F.array("prompt").alias("accepted"), F.lit("verified").alias("review_status"),
                        F.lit("sourceKey").alias("provenance"), F.lit(0.9).alias("confidence"))
    resources = groups.where("group_id <> 'Brand#7'").select("doc_id", F.concat("group_id", F.lit(":bank")).alias("resource_id"), F.lit("wordBank").alias("kind"), F.lit("reusable").alias("usage_policy"))
    entries = resources.select("doc_id", "resource_id", F.concat("resource_id", F.lit(":1")).alias("entry_id"))
    return ql.contract_violations(groups, ex_, options, fields, resources, entries).select("entity_id", "code")


@query("""WITH o AS (SELECT p_brand, unnest(list_slice(string_split(p_name, ' '), 1, p_partkey % 3)) AS value, unnest(range(least(p_partkey % 3, len(string_split(p_name, ' '))))) AS i, p_size, p_partkey
  FROM part WHERE p_size % 4 = 0 AND p_size % 8 <> 0),
f AS (SELECT p_brand, value, min((p_size, i)) AS first FROM o GROUP BY 1, 2)
SELECT p_brand || ':bank' AS resource_id, (row_number() OVER (PARTITION BY p_brand ORDER BY first, value))::INTEGER AS ord, value FROM f""")
def v6_word_banks(spark, sf_dir):
    """V6: the local options of bank exercises as one bank for each group."""
    return pb.upcast_word_banks(*_lesson(spark, sf_dir))[1].select("resource_id", "ord", "value")


@query("""WITH u AS (SELECT l_orderkey AS d, bool_or(l_quantity % 5 = 0) AS unverified FROM lineitem GROUP BY 1)
SELECT o_orderkey AS draft_id, array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'OPEN_BLOCKING_ISSUE' END, CASE WHEN o_orderkey % 5 = 0 THEN 'CONTENT_ADDED' END,
  CASE WHEN unverified THEN 'ANSWER_UNVERIFIED' END, CASE WHEN o_orderkey % 7 = 0 THEN 'UNKNOWN_BLOCK_REF' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders LEFT JOIN u ON d = o_orderkey""")
def v7_block_reasons(spark, sf_dir):
    """V7, V8: orders as drafts, lines as their fields: each reason once, in order."""
    o, l = b.table(spark, sf_dir, "orders"), b.table(spark, sf_dir, "lineitem")
    issues = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("draft_id"), F.lit("blocking").alias("severity"), F.lit("open").alias("resolution"))
    fields = l.select(F.col("l_orderkey").alias("draft_id"), F.when(F.col("l_quantity") % 5 == 0, "needsReview").otherwise("verified").alias("review_status"))
    coverage = o.select(F.col("o_orderkey").alias("draft_id"), F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0).alias("additions"))
    lineage = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("draft_id"), F.array(F.lit("UNKNOWN_BLOCK_REF")).alias("reasons"))
    found = pb.block_reasons(o.select(F.col("o_orderkey").alias("draft_id")), issues, fields, coverage, lineage)
    return found.select("draft_id", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT c_name AS public_lesson_id, o_orderkey AS version_id FROM customer JOIN v ON o_custkey = c_custkey AND n = 2 WHERE c_custkey % 3 <> 0""")
def v12_public_lessons(spark, sf_dir):
    """The current version, the second, behind each public id; a third of the lessons is unpublished."""
    c, o = b.table(spark, sf_dir, "customer"), b.table(spark, sf_dir, "orders")
    lessons = c.select(F.col("c_custkey").alias("lesson_id"), F.col("c_name").alias("public_lesson_id"), F.when(F.col("c_custkey") % 3 != 0, 2).alias("current_version"))
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    versions = o.select(F.col("o_custkey").alias("lesson_id"), n.alias("version"), F.col("o_orderkey").alias("version_id"))
    return pb.resolve_public(lessons, versions, c.select(F.col("c_name").alias("public_lesson_id"))).select("public_lesson_id", "version_id")


@query("""SELECT l_orderkey AS entity_id, 'FIELD_REPEATED' AS code FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
UNION ALL SELECT l_orderkey, 'TOO_MANY_RESPONSES' FROM lineitem GROUP BY 1 HAVING count(*) > 6""")
def v14_attempt_rules(spark, sf_dir):
    """Lines as responses, six of them allowed; parts repeated in an order."""
    r = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("field_id"))
    graded = r.withColumns({"correct": F.lit(False), "shown": F.array(F.lit("x")), "exercise_id": F.lit("e")})
    return gr.attempt_violations(r.select("attempt_id").distinct(), r, graded, 6)


@query("""WITH u AS (SELECT l_orderkey AS a, l_partkey % 4 AS g, l_suppkey % 10 AS o, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT DISTINCT a AS attempt_id, 'ENTRY_REUSED' AS code FROM u WHERE n > 1""")
def h5_reused_entries(spark, sf_dir):
    """H5: entries of one bank used twice by fields of one group of an attempt."""
    l = b.table(spark, sf_dir, "lineitem").withColumn("f", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.monotonically_increasing_id()))
    l = l.select(F.col("l_orderkey").alias("attempt_id"), F.lit(1).alias("lesson_id"), F.lit(1).alias("lesson_version"), (F.col("l_partkey") % 4).alias("group_id"),
                 (F.col("l_partkey") % 4).alias("resource_id"), F.concat_ws(":", F.col("l_partkey") % 4).alias("field_id"), (F.col("l_suppkey") % 10).cast("string").alias("option_id"))
    fields = l.select("lesson_id", "lesson_version", "group_id", "resource_id", "field_id").distinct()
    return gr.use_once_rejects(l.select("attempt_id", "lesson_id", "lesson_version").distinct(), fields, l.select("attempt_id", "field_id", "option_id"))


# ---- review and planning

@query("""WITH named AS (SELECT event_id AS i, event_id % 700 AS f, event_type FROM events),
ok AS (SELECT DISTINCT f FROM named WHERE event_type = 'click'), gone AS (SELECT DISTINCT p_brand FROM part JOIN named ON f = p_partkey WHERE event_type = 'error' AND p_partkey < 5)
SELECT p_partkey::VARCHAR AS field_id, CASE WHEN f IS NULL THEN 'needsReview' ELSE 'verified' END AS review_status FROM part LEFT JOIN ok ON f = p_partkey WHERE p_brand NOT IN (SELECT p_brand FROM gone)""")
def r2_issue_decisions(spark, sf_dir):
    """R2: decisions on issues reach the fields they name; an exclusion drops the whole exercise."""
    p, e = b.table(spark, sf_dir, "part"), b.table(spark, sf_dir, "events")
    fields = p.select(F.col("p_partkey").cast("string").alias("field_id"), F.col("p_brand").alias("exercise_id"), F.lit("needsReview").alias("review_status"))
    issues = e.select(F.col("event_id").alias("issue_id"), F.array((F.col("event_id") % 700).cast("string")).alias("entity_ids"))
    decision = F.when(F.col("event_type") == "click", "confirm").when((F.col("event_type") == "error") & (F.col("event_id") % 700 < 5), "exclude").otherwise("keep")
    kept, _ = rv.apply_issue_decisions(fields, fields.select("exercise_id").distinct(), issues, e.select(F.col("event_id").alias("issue_id"), decision.alias("decision")))
    return kept.select("field_id", "review_status")


@query("""WITH x AS (SELECT o_custkey AS d, o_orderstatus AS g, o_orderkey AS k, o_orderkey % 3 = 0 AS gone FROM orders),
e AS (SELECT d FROM x GROUP BY 1 HAVING bool_and(gone)), l AS (SELECT * FROM x WHERE NOT gone OR d IN (SELECT d FROM e))
SELECT d AS draft_id, g AS group_id, k AS exercise_id, (row_number() OVER (PARTITION BY d, g ORDER BY k))::INTEGER AS ord FROM l""")
def r5_deleted_exercises(spark, sf_dir):
    """Orders as exercises of the customer's draft; a third goes, but never all of a draft."""
    x = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft_id"), F.col("o_orderstatus").alias("group_id"), F.col("o_orderkey").alias("exercise_id"), F.col("o_orderkey").alias("ord"))
    left, _, _ = rv.apply_exercise_deletes(x, x.select("draft_id", "group_id").distinct(), x.where("exercise_id % 3 = 0"))
    return left.select("draft_id", "group_id", "exercise_id", "ord")


@query("""WITH x AS (SELECT o_custkey AS d, o_orderkey AS k, o_orderkey % 3 = 0 AS gone FROM orders),
e AS (SELECT d FROM x GROUP BY 1 HAVING bool_and(gone))
SELECT d AS draft_id, k AS candidate_id, CASE WHEN gone AND d NOT IN (SELECT d FROM e) THEN 'decision' WHEN k % 5 = 1 THEN 'issue' ELSE 'exercise' END AS kind,
  CASE WHEN gone AND d NOT IN (SELECT d FROM e) THEN 'delete:' || k END AS decision_id FROM x WHERE NOT (gone AND k % 5 = 1)
UNION ALL SELECT d, k, 'issue', NULL FROM x WHERE gone AND k % 5 = 1""")
def r5_coverage_entries(spark, sf_dir):
    """Coverage entries of the orders of a customer's draft; those of deleted exercises become decisions, issues stay."""
    x = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft_id"), F.col("o_orderstatus").alias("group_id"), F.col("o_orderkey").alias("exercise_id"), F.col("o_orderkey").alias("ord"))
    deletes = x.where("exercise_id % 3 = 0").withColumn("decision_id", F.concat(F.lit("delete:"), "exercise_id"))
    _, _, refused = rv.apply_exercise_deletes(x, x.select("draft_id", "group_id").distinct(), deletes)
    entries = x.select("draft_id", F.col("exercise_id").alias("candidate_id"), F.when(F.col("exercise_id") % 5 == 1, "issue").otherwise("exercise").alias("kind"),
                       F.array("exercise_id").alias("exercise_ids"), F.lit(None).cast("string").alias("decision_id"))
    return rv.coverage_after_deletes(entries, deletes, refused).select("draft_id", "candidate_id", "kind", "decision_id")


@query("""WITH n AS (SELECT event_id, event_id % 97 AS x, event_type FROM events)
SELECT event_id AS issue_id, CASE WHEN x % 5 = 0 THEN 'delete' ELSE 'edit' END AS by FROM n WHERE x % 5 = 0 OR x % 3 = 0 AND event_type = 'error'""")
def r6_touched_issues(spark, sf_dir):
    """Issues that an edit (of a truncated exercise) or a deletion resolves."""
    e = b.table(spark, sf_dir, "events")
    issues = e.select(F.col("event_id").alias("issue_id"), F.lit("open").alias("resolution"), F.when(F.col("event_type") == "error", "SOURCE_TRUNCATED").otherwise("OTHER").alias("code"), F.array(F.col("event_id") % 97).alias("entity_ids"))
    ids = e.select((F.col("event_id") % 97).alias("exercise_id")).distinct()
    return rv.issues_touched(issues, ids.where("exercise_id % 3 = 0"), ids.where("exercise_id % 5 = 0"))


@query("""SELECT event_id AS issue_id FROM events WHERE NOT (event_type = 'error' AND event_id % 10 < 4)""")
def r13_visible_issues(spark, sf_dir):
    """Issues less the unverified answers that are confirmed."""
    e = b.table(spark, sf_dir, "events")
    issues = e.select(F.col("event_id").alias("issue_id"), F.when(F.col("event_type") == "error", "ANSWER_UNVERIFIED").otherwise("OTHER").alias("code"), F.array(F.col("event_id") % 10).alias("entity_ids"))
    confirmed = e.select((F.col("event_id") % 10).alias("field_id")).distinct().where("field_id < 4")
    return rv.visible_issues(issues, confirmed).select("issue_id")


@query("""WITH s AS (SELECT event_id % 50 AS r, event_id % 400 AS c, count(*) AS n, min(event_type) AS k FROM events GROUP BY 1, 2), c AS (SELECT DISTINCT event_id % 50 AS r, event_id % 400 AS c FROM events WHERE event_id % 400 < 300)
SELECT coalesce(s.r, c.r) AS review_id, coalesce(s.c, c.c) AS candidate_id, CASE WHEN c.c IS NULL THEN 'UNKNOWN_CANDIDATE' WHEN n > 1 THEN 'DUPLICATE' END AS code,
  CASE WHEN c.c IS NOT NULL AND n = 1 THEN CASE k WHEN 'error' THEN 'exclude' ELSE 'classify' END END AS action FROM s LEFT JOIN c ON s.r = c.r AND s.c = c.c""")
def g9_layout_suggestions(spark, sf_dir):
    """Events as suggestions for candidates, of which some are unknown and some have several."""
    e = b.table(spark, sf_dir, "events").select(
        (F.col("event_id") % 50).alias("review_id"), (F.col("event_id") % 400).alias("candidate_id"), F.when(F.col("event_type") == "error", "notExercise").otherwise("shortText").alias("kind"), "event_type")
    # the least type stands for a candidate, as its only one where the code is null
    return pl.layout_suggestions(e.where("candidate_id < 300"), e).select("review_id", "candidate_id", "code", "action")


@query("""WITH a AS (SELECT p_brand || p_type AS m, p_type AS f, count(*) AS v FROM part GROUP BY 1, 2), x AS (SELECT p_brand || p_type AS m, p_type AS f, count(*) + (p_type = 'LARGE')::INTEGER AS v FROM part WHERE p_brand <> 'Brand#7' GROUP BY 1, 2)
SELECT a.f AS fixture_id, a.m AS metric, coalesce(x.v, -1)::BIGINT AS expected, a.v::BIGINT AS actual FROM a LEFT JOIN x ON a.m = x.m AND a.f = x.f WHERE x.v IS DISTINCT FROM a.v""")
def g13_extraction_report(spark, sf_dir):
    """Counts that differ from what was expected, or that nobody expected (-1)."""
    p = b.table(spark, sf_dir, "part")
    measured = p.groupBy(F.col("p_type").alias("fixture_id"), F.concat("p_brand", "p_type").alias("metric")).agg(F.count("*").alias("value"))
    expected = measured.where("metric not like 'Brand#7' || fixture_id").withColumn("value", F.col("value") + F.when(F.col("fixture_id") == "LARGE", 1).otherwise(0))
    return pl.evaluate_extraction(measured, expected).select("fixture_id", "metric", F.coalesce("expected", F.lit(-1)).alias("expected"), "actual")

"""Registered queries over windows, reconciliation, rules, review, planning and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.operators import answer_key as ak
from quillforge.operators import extract as ex
from quillforge.operators import planning as pl
from quillforge.operators import publish as pb
from quillforge.operators import quality as ql
from quillforge.operators import reconcile as rc
from quillforge.operators import review as rv
from quillforge.operators import runs as rn
from quillforge.operators import windows as wn
from quillforge.plans import bindings as b
from quillforge.plans.queries import also, query

NOW = "2024-01-20 00:00:00"


def _turns(spark, sf_dir):
    t = b.table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "exercise").when(F.col("role") == "assistant", "issue").otherwise("decision")
    return t.select(F.col("conv_id").alias("doc_id"), (F.col("turn") % 3).cast("string").alias("candidate_id"), F.col("turn").alias("seq"), kind.alias("kind"), "text")


_TURNS_SQL = """v_turns AS (SELECT conv_id AS doc_id, (turn % 3)::VARCHAR AS candidate_id, turn AS seq,
  CASE role WHEN 'user' THEN 'exercise' WHEN 'assistant' THEN 'issue' ELSE 'decision' END AS kind, text FROM conversations)"""


@query("WITH " + _TURNS_SQL + """, a AS (SELECT doc_id, candidate_id, arg_min(kind, CASE kind WHEN 'exercise' THEN 0 WHEN 'issue' THEN 1 ELSE 2 END) AS outcome FROM v_turns GROUP BY 1, 2),
c AS (SELECT DISTINCT doc_id, unnest(['0', '1']) AS candidate_id FROM v_turns),
o AS (SELECT doc_id, candidate_id, c.doc_id IS NOT NULL AND c.candidate_id IN ('0', '1') AS x, outcome, candidate_id IN ('0', '1') AS known FROM c FULL JOIN a USING (doc_id, candidate_id))
SELECT doc_id, count(*) FILTER (known)::BIGINT AS detected, count(*) FILTER (known AND outcome IS NOT NULL)::BIGINT AS accounted, count(*) FILTER (NOT known)::BIGINT AS additions,
  count(*) FILTER (known AND outcome IS NULL)::BIGINT AS gaps, CASE WHEN count(*) FILTER (NOT known OR outcome IS NULL) > 0 THEN 'blocked' ELSE 'complete' END AS status FROM o GROUP BY 1""")
def e26_candidate_accounts(spark, sf_dir):
    """Turns as accounts of two candidates a conversation."""
    t = _turns(spark, sf_dir)
    cands = t.select("doc_id").distinct().withColumn("candidate_id", F.explode(F.array(F.lit("0"), F.lit("1"))))
    return ak.account_candidates(cands, t)[1]


@query("WITH RECURSIVE " + b.BLOCKS_SQL + """, bad AS (SELECT DISTINCT doc_id FROM v_blocks WHERE length(raw_text) > 3000),
z AS (SELECT doc_id, block_id, greatest(length(raw_text), 1) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos FROM v_blocks WHERE trim(raw_text) <> '' AND doc_id NOT IN (SELECT doc_id FROM bad)),
r AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, count(*) OVER (PARTITION BY doc_id) AS n FROM z),
e AS (SELECT x.doc_id, x.pos, x.n, max(y.pos) + 1 AS e FROM r x JOIN r y ON y.doc_id = x.doc_id AND y.pos >= x.pos AND y.pos < x.pos + 16 AND y.upto - x.upto + x.size <= 3000 GROUP BY 1, 2, 3),
w(doc_id, k, s) AS (SELECT DISTINCT doc_id, 0, 0::BIGINT FROM z
  UNION ALL SELECT w.doc_id, k + 1, greatest(s + 1, e.e - least(4, e.e - s - 1)) FROM w JOIN e ON e.doc_id = w.doc_id AND e.pos = s WHERE e.e < e.n),
v AS (SELECT w.doc_id, k, s, e.e FROM w JOIN e ON e.doc_id = w.doc_id AND e.pos = s),
g AS (SELECT v.doc_id, k, s, v.e, sum(size) AS tokens, list(block_id ORDER BY pos) AS ids FROM v JOIN z ON z.doc_id = v.doc_id AND pos >= s AND pos < v.e GROUP BY ALL)
SELECT doc_id, k AS window, s::INTEGER AS first, (e - 1)::INTEGER AS last, tokens::INTEGER AS tokens,
  coalesce(len(list_intersect(ids, lag(ids) OVER o)), 0)::INTEGER AS n_before, coalesce(len(list_intersect(ids, lead(ids) OVER o)), 0)::INTEGER AS n_after FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY k)""")
def w1_windows(spark, sf_dir):
    """Windows of every document's lines, with their overlaps."""
    out = wn.window_overlaps(wn.plan_windows(b.blocks(spark, sf_dir), wn.Profile(blocks=16, tokens=3000, overlap=4)))
    return out.select("doc_id", "window", "first", "last", "tokens", F.size("shared_before").alias("n_before"), F.size("shared_after").alias("n_after"))


@query("WITH " + b.BLOCKS_SQL + """ SELECT doc_id, block_id, 'BLOCK_TOO_LARGE' AS code FROM v_blocks WHERE length(raw_text) > 500""")
def w1_window_errors(spark, sf_dir):
    """Blocks over the token bound."""
    return wn.window_errors(b.blocks(spark, sf_dir), wn.Profile(tokens=500))


_OUTCOMES = "CASE WHEN seq % 5 = 4 THEN 'unknown' ELSE kind END"


@query("WITH " + _TURNS_SQL + f""", c AS (SELECT doc_id, candidate_id AS block_id, seq, {_OUTCOMES} AS outcome, list_sort(list_distinct(['r' || seq % 2, 'r' || seq % 4 // 2])) AS rs, 'p' || seq % 3 AS p FROM v_turns),
f AS (SELECT doc_id, block_id, count(DISTINCT outcome || ':' || array_to_string(rs, ',')) AS n, arg_min(outcome, seq) AS o, arg_min(rs, seq) AS rs, bool_or(list_contains(rs, 'r1') AND doc_id % 4 = 0) AS lost,
  array_to_string(list_sort(list(DISTINCT p)), ',') AS ps FROM c GROUP BY 1, 2),
bl AS (SELECT DISTINCT doc_id, unnest(['0', '1', '2', '3']) AS block_id FROM v_turns),
s AS (SELECT bl.*, o, rs, ps, CASE WHEN n IS NULL THEN 'missing' WHEN lost THEN 'dangling' WHEN n > 1 THEN 'conflict' ELSE 'mapped' END AS state FROM bl LEFT JOIN f USING (doc_id, block_id) WHERE block_id <> '3' OR doc_id % 2 = 0)
SELECT doc_id, block_id, state, CASE WHEN state <> 'mapped' OR o = 'unknown' THEN 'issue' ELSE o END AS outcome, CASE WHEN state = 'mapped' THEN array_to_string(rs, ',') END AS region_ids,
  CASE state WHEN 'missing' THEN 'MISSING_BLOCK' WHEN 'dangling' THEN 'DANGLING_RELATION' WHEN 'conflict' THEN 'OVERLAPPING_OWNERSHIP' END AS code, CASE WHEN state <> 'mapped' THEN ps END AS proposal_ids FROM s""")
def w17_block_coverage(spark, sf_dir):
    """Turns as claims, each on up to two regions, on four blocks a conversation, the last one blank in half of them; one region is unknown in some."""
    t = _turns(spark, sf_dir)
    docs = t.select("doc_id").distinct()
    blocks = docs.withColumn("block_id", F.explode(F.array(*map(F.lit, "0123")))).withColumn("raw_text", F.when((F.col("block_id") == "3") & (F.col("doc_id") % 2 == 1), " ").otherwise("x"))
    both = F.array_distinct(F.array(F.concat(F.lit("r"), F.col("seq") % 2), F.concat(F.lit("r"), F.floor(F.col("seq") % 4 / 2).cast("int"))))
    claims = t.select("doc_id", F.col("candidate_id").alias("block_id"), "seq", F.expr(_OUTCOMES).alias("outcome"), both.alias("region_ids"), F.concat(F.lit("p"), F.col("seq") % 3).alias("proposal_id"))
    regions = docs.withColumn("region_id", F.explode(F.array(F.lit("r0"), F.lit("r1")))).where("region_id <> 'r1' or doc_id % 4 <> 0")
    out, wrong = rc.block_coverage(blocks, claims, regions)
    out = out.join(wrong.select("doc_id", F.col("owner_id").alias("block_id"), "code", "proposal_ids"), ["doc_id", "block_id"], "left")
    return out.select("doc_id", "block_id", "state", "outcome", F.array_join(F.array_sort("region_ids"), ",").alias("region_ids"), "code", F.array_join("proposal_ids", ",").alias("proposal_ids"))


def _regions(spark, sf_dir):
    t = _turns(spark, sf_dir)
    role = F.when(F.col("kind") == "exercise", "exercisePrompt").when(F.col("kind") == "issue", "instruction").otherwise("localOption")
    src = F.array(F.struct(F.col("candidate_id").alias("block_id"), (F.col("seq") * 10).cast("int").alias("char_start"), (F.col("seq") * 10 + 25).cast("int").alias("char_end")))
    return t.select("doc_id", F.concat(F.lit("region:"), F.col("seq") % 4).alias("region_id"), "seq", role.alias("role"), (F.length("text") % 10 / 10).alias("confidence"), src.alias("sources"))


@query("WITH " + _TURNS_SQL + """, r AS (SELECT doc_id, 'region:' || (seq % 4) AS region_id, seq, CASE kind WHEN 'exercise' THEN 'exercisePrompt' WHEN 'issue' THEN 'instruction' ELSE 'localOption' END AS role, (length(text) % 10) / 10.0 AS confidence FROM v_turns),
f AS (SELECT *, first_value(role) OVER (PARTITION BY doc_id, region_id ORDER BY seq) AS lead_role FROM r)
SELECT doc_id, region_id, lead_role AS role, min(confidence)::DOUBLE AS confidence, count(*)::INTEGER AS n_sources FROM f WHERE role = lead_role GROUP BY 1, 2, 3""")
def w5_merged_regions(spark, sf_dir):
    """Turns as region proposals."""
    merged, _ = rc.merge_regions(_regions(spark, sf_dir))
    return merged.select("doc_id", "region_id", "role", "confidence", F.size("sources").alias("n_sources"))


@query("WITH " + _TURNS_SQL + """, r AS (SELECT doc_id, 'region:' || (seq % 4) AS region_id, (length(text) % 10) / 10.0 AS confidence FROM v_turns)
SELECT doc_id, 'LOW_CONFIDENCE' AS code, region_id AS owner_id, count(*)::BIGINT AS n FROM r WHERE confidence < 0.8 GROUP BY 1, 2, 3""")
def w15_low_confidence(spark, sf_dir):
    """W15."""
    found = rc.confidence_conflicts([(_regions(spark, sf_dir), "region_id", "role")])
    return found.groupBy("doc_id", "code", "owner_id").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS e, l_suppkey % 5 AS b, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey % 100 END AS s0,
  CASE WHEN l_partkey % 3 = 0 OR l_partkey % 7 = 0 THEN 120 ELSE l_partkey % 100 + l_quantity END AS s1 FROM lineitem WHERE l_suppkey % 5 <> 4)
SELECT x.d AS doc_id, 'NON_ATOMIC_EXERCISE' AS code, x.e AS owner_id, y.e AS other_id, array_to_string(list_sort(list(DISTINCT x.b)), ',') AS block_ids
FROM s x JOIN s y ON x.d = y.d AND x.b = y.b AND x.e < y.e AND greatest(x.s0, y.s0) < least(x.s1, y.s1) GROUP BY ALL""")
def w13_overlapping_prompts(spark, sf_dir):
    """Order lines as prompt spans in four blocks of 120 code points (a fifth is not there), a third without offsets, some without an end."""
    l = b.table(spark, sf_dir, "lineitem")
    ref = F.concat_ws("/", "l_linenumber", F.col("l_suppkey") % 5, "l_partkey", F.col("l_quantity").cast("int"))
    open_, endless = F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 7 == 0
    rows = l.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("exercise_id"), ref.alias("region_id"), (F.col("l_suppkey") % 5).alias("block_id"),
        F.when(~open_, F.col("l_partkey") % 100).cast("int").alias("s"), F.when(~open_ & ~endless, F.col("l_partkey") % 100 + F.col("l_quantity")).cast("int").alias("e")).distinct()
    ex = rows.select("doc_id", "exercise_id", F.array("region_id").alias("prompt_region_ids"))
    regions = rows.select("doc_id", "region_id", F.array(F.struct("block_id", F.col("s").alias("char_start"), F.col("e").alias("char_end"))).alias("sources")).dropDuplicates(["doc_id", "region_id"])
    blocks = rows.select("doc_id", "block_id", F.lit("x" * 120).alias("raw_text")).where("block_id < 4").distinct()
    return rc.overlapping_prompts(ex, regions, blocks).select("doc_id", "code", "owner_id", "other_id", F.array_join(F.col("block_ids").cast("array<string>"), ",").alias("block_ids"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'DELETED' ELSE 'CHANGED' END AS code FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def v13_mutations(spark, sf_dir):
    """A second snapshot of the orders with rows gone and statuses changed."""
    o = b.table(spark, sf_dir, "orders")
    after = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")))
    return ql.mutated_rows(o, after, "o_orderkey")


def _part_fields(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("field_id"), F.col("p_brand").alias("exercise_id"), F.col("p_type").alias("group_id"), F.col("p_size").alias("ord"), F.array("p_name").alias("accepted"),
        F.when(F.col("p_size") % 3 == 0, "modelInferred").otherwise("deterministicRule").alias("provenance"), F.lit("needsReview").alias("review_status"), F.lit(0.5).alias("confidence"))


@query("""WITH r AS (SELECT doc_id AS field_id, CASE WHEN quality = 1 THEN ' good ' ELSE '  ' END AS value FROM labels), g AS (SELECT DISTINCT field_id FROM r WHERE trim(value) <> '')
SELECT p_partkey AS field_id, CASE WHEN field_id IS NULL THEN p_name ELSE 'good' END AS answer, CASE WHEN field_id IS NULL THEN 'needsReview' ELSE 'verified' END AS review_status FROM part LEFT JOIN g ON field_id = p_partkey""")
def r1_answer_reviews(spark, sf_dir):
    """Labels as reviews of the parts' fields."""
    reviews = b.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("field_id"), F.lit(1).alias("seq"), F.when(F.col("quality") == 1, " good ").otherwise("  ").alias("value"))
    fields, _ = rv.apply_answer_reviews(_part_fields(spark, sf_dir), reviews)
    return fields.select("field_id", F.col("accepted")[0].alias("answer"), "review_status")


def _issues(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("issue_id"), F.col("user_id").alias("run_id"), F.lit("o").alias("owner_id"), F.when(F.col("event_type") == "error", "ANSWER_UNVERIFIED").otherwise("SOURCE_TRUNCATED").alias("code"),
        F.when(F.col("event_type") == "error", "blocking").when(F.col("event_type") == "click", "warning").otherwise("info").alias("severity"), F.lit("open").alias("resolution"),
        F.array((F.col("event_id") % 500).cast("string")).alias("entity_ids"))


@query("""WITH i AS (SELECT event_id, event_id % 500 AS e, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS k FROM events)
SELECT e::VARCHAR AS entity_id, CASE max(k) WHEN 3 THEN 'blocking' WHEN 2 THEN 'warning' ELSE 'info' END AS severity, count(*)::INTEGER AS n_issues FROM i GROUP BY e""")
def r12_entity_severity(spark, sf_dir):
    """Events as issues of 500 entities."""
    return rv.entity_severity(_issues(spark, sf_dir)).select("entity_id", "severity", F.size("issue_ids").alias("n_issues"))


@query("""SELECT event_id AS issue_id, CASE WHEN toxic = 1 THEN 'acceptedRisk' WHEN quality = 1 THEN 'resolved' ELSE 'open' END AS resolution FROM events LEFT JOIN labels ON doc_id = event_id""")
def r7_resolved_issues(spark, sf_dir):
    """Labels as decisions on the issue of their id: toxic excludes, quality confirms."""
    issues = _issues(spark, sf_dir)
    lab = b.table(spark, sf_dir, "labels").where("toxic = 1 or quality = 1")
    d = lab.join(issues.select(F.col("issue_id").alias("doc_id"), "run_id", "owner_id"), "doc_id").select(
        "run_id", "owner_id", F.array("doc_id").alias("resolved_issue_ids"), F.when(F.col("toxic") == 1, "exclude").otherwise("confirm").alias("decision"), F.lit(NOW).cast("timestamp").alias("created_at"))
    return rv.resolve_issues(issues, d).select("issue_id", "resolution")


@query("""WITH s AS (SELECT o_custkey AS d, o_orderkey AS k, o_orderdate AS made, (o_orderkey % 3)::INTEGER AS rev FROM orders),
w AS (SELECT *, rev = 1 AS fits, sum((rev = 1)::INTEGER) OVER (PARTITION BY d ORDER BY made, k) AS turn FROM s)
SELECT d AS draft_id, count(*) FILTER (fits AND turn = 1)::BIGINT AS applied, count(*) FILTER (NOT (fits AND turn = 1))::BIGINT AS stale FROM w GROUP BY 1""")
def r8_submissions(spark, sf_dir):
    """Orders as submissions on the customers' drafts of revision 1."""
    o = b.table(spark, sf_dir, "orders")
    subs = o.select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("key"), F.lit("f").alias("fingerprint"), (F.col("o_orderkey") % 3).cast("int").alias("expected_revision"), F.col("o_orderdate").alias("arrived"))
    drafts = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("draft_id"), F.lit(1).alias("revision"))
    out, _ = rv.submit_reviews(drafts, subs, drafts.select("draft_id", F.array().cast("array<string>").alias("reasons")))
    return out.groupBy("draft_id").agg(F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") == "stale").alias("stale"))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '^((?i:question)\s*)?\d{{1,3}}[.)\s]+', ''), '\s+', ' ', 'g'), '\s+([,.!?;:])', '\1', 'g'))"


@query(r"""WITH c AS (SELECT item_id, item_id % 2 = 0 AS choice, item_id || '. ' || text || CASE item_id % 4 WHEN 0 THEN chr(10) || 'a) one' || chr(10) || 'B two ' || chr(10) || 'no option' WHEN 2 THEN chr(10) || 'c. only' ELSE '' END AS raw FROM benchmark),
l AS (SELECT *, list_transform(string_split(raw, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM c),
k AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '^[a-zA-Zа-яёА-ЯЁ][.)]?\s+')), true), 0) AS k FROM l)
SELECT item_id::VARCHAR AS candidate_id, CASE WHEN choice THEN """ + _CLEAN.format("replace(array_to_string(CASE WHEN k > 0 THEN l[:k - 1] ELSE [] END, ' '), chr(9), ' ___ ')") + " ELSE " + _CLEAN.format("raw") + r""" END AS prompt,
  CASE WHEN choice AND k > 1 THEN array_to_string(list_transform(list_filter(l[k:], lambda x: regexp_matches(x, '^[a-zA-Zа-яёА-ЯЁ][.)]?\s+.')), lambda x: regexp_replace(x, '^[a-zA-Zа-яёА-ЯЁ][.)]?\s+', '')), '|') WHEN choice THEN '' END AS options,
  CASE WHEN choice AND (k < 2 OR len(list_filter(l[k:], lambda x: regexp_matches(x, '^[a-zA-Zа-яёА-ЯЁ][.)]?\s+.'))) < 2) THEN 'TOO_FEW_OPTIONS' END AS error FROM k""")
def r10_candidate_prompts(spark, sf_dir):
    """Benchmark items as candidates: half of them choices, with two options or one."""
    c = b.table(spark, sf_dir, "benchmark")
    more = F.when(c.item_id % 4 == 0, "\na) one\nB two \nno option").when(c.item_id % 4 == 2, "\nc. only").otherwise("")
    c = c.select(F.col("item_id").cast("string").alias("candidate_id"), F.when(c.item_id % 2 == 0, "singleChoice").otherwise("shortText").alias("kind"),
                 F.concat("item_id", F.lit(". "), "text", more).alias("raw_prompt"))
    return rv.candidates_to_exercises(c).select("candidate_id", "prompt", F.array_join("options", "|").alias("options"), "error")


@query("""SELECT item_id % 10 AS review_id, count(*)::BIGINT AS n, ceil(sum(length(text)) / 4.0 + 120 * count(*) + 300)::BIGINT AS tokens FROM benchmark GROUP BY 1""")
def g8_layout_preflight(spark, sf_dir):
    """G8."""
    c = b.table(spark, sf_dir, "benchmark").select((F.col("item_id") % 10).alias("review_id"), F.col("text").alias("raw_prompt"))
    return pl.layout_preflight(c).select("review_id", "n", "tokens")


@query("""WITH RECURSIVE x AS (SELECT l_orderkey AS d, l_returnflag AS g, l_linenumber || '/' || l_partkey AS x, l_linenumber::BIGINT * 1000000000 + l_partkey AS o, sum(l_quantity)::INTEGER AS n FROM lineitem GROUP BY ALL),
y AS (SELECT *, sum(n) OVER (PARTITION BY d, g) AS total, min(o) OVER (PARTITION BY d, g) AS pos FROM x),
c AS (SELECT *, least(40, n - first) AS m, row_number() OVER (PARTITION BY d, pos ORDER BY o, first) AS r FROM (SELECT *, unnest(range(0, n, 40)) AS first FROM y WHERE total > 40)),
f(d, pos, r, used, unit) AS (SELECT d, pos, r, m, 0 FROM c WHERE r = 1
  UNION ALL SELECT c.d, c.pos, c.r, CASE WHEN used + m > 40 THEN m ELSE used + m END, CASE WHEN used + m > 40 THEN unit + 1 ELSE unit END FROM f JOIN c ON c.d = f.d AND c.pos = f.pos AND c.r = f.r + 1),
p AS (SELECT c.d, c.g, c.x, c.pos, c.first, c.m, unit FROM c JOIN f USING (d, pos, r) UNION ALL SELECT d, g, x, pos, 0, n, 0 FROM y WHERE total <= 40),
u AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC, pos, unit) AS r FROM (SELECT d, pos, unit, sum(m)::INTEGER AS n FROM p GROUP BY 1, 2, 3)),
b(d, r, room, batch) AS (SELECT d, r, [40 - n], 0 FROM u WHERE r = 1
  UNION ALL SELECT d, r, CASE WHEN k IS NULL OR k = 0 THEN list_append(room, 40 - n) ELSE list_concat(list_append(room[:k - 1], room[k] - n), room[k + 1:]) END, CASE WHEN k IS NULL OR k = 0 THEN len(room) ELSE k - 1 END
  FROM (SELECT u.d, u.r, u.n, room, list_position(list_transform(room, lambda v: v >= u.n), true) AS k FROM b JOIN u ON u.d = b.d AND u.r = b.r + 1))
SELECT p.d AS draft_id, batch::INTEGER AS batch, g AS group_id, x AS exercise_id, first::INTEGER AS first, m::INTEGER AS n_fields FROM p JOIN u USING (d, pos, unit) JOIN b ON b.d = u.d AND b.r = u.r""")
def g2_batches(spark, sf_dir):
    """Orders as drafts, return flags as groups, lines as exercises with a field for each piece; batches of 40."""
    l = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("draft_id"), F.col("l_returnflag").alias("group_id"), F.concat_ws("/", "l_linenumber", "l_partkey").alias("exercise_id"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("ord"), "l_quantity")
    # lines of a draft hardly ever make one exercise: they are dealt by draft once, before they are added up
    ex = l.repartition("draft_id").groupBy("draft_id", "group_id", "exercise_id", "ord").agg(F.sum("l_quantity").cast("int").alias("n_fields"))
    return pl.pack_batches(ex, 40)


@query("""WITH x AS (SELECT l_suppkey AS d, l_linenumber AS bt, count(*) AS nf, sum(l_orderkey % 1000)::BIGINT AS ch FROM lineitem GROUP BY 1, 2),
y AS (SELECT d AS draft_id, sum(nf)::BIGINT AS n_fields, count(*)::BIGINT AS n_batches, ceil(sum(ch) / 4.0 + 96 * sum(nf) + 180 * count(*))::BIGINT AS tokens FROM x GROUP BY 1),
z AS (SELECT *, ceil(tokens::DOUBLE / 1000 * 0.172::DOUBLE * 10000) / 10000 AS usd FROM y)
SELECT *, usd > 1 AS needs_confirmation, usd > 10 AS refused FROM z""")
def g3_preflight(spark, sf_dir):
    """Suppliers as drafts, line numbers as batches."""
    x = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("draft_id"), F.col("l_linenumber").alias("batch")).agg(
        F.count("*").alias("n_fields"), F.sum(F.col("l_orderkey") % 1000).alias("chars")).withColumn("payload", F.col("chars").cast("string"))
    return pl.preflight(x).select("draft_id", "n_fields", "n_batches", "tokens", "usd", "needs_confirmation", "refused")


@also("g5_suggestion_checks")
@query("""SELECT l_partkey AS field_id, 'DUPLICATE_ID' AS code FROM lineitem GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT p_partkey, 'MISSING_ID' FROM part WHERE p_type <> 'ECONOMY' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT DISTINCT l_partkey, 'UNKNOWN_ID' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY')""")
def g5_all_suggestion_checks(spark, sf_dir):
    """Every line as a suggestion for the fields outside one group."""
    s = b.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("field_id"))
    return pl.check_suggestions(s, b.table(spark, sf_dir, "part").where("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("field_id")))


@query("""SELECT user_id AS run_id, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN round(sum(value), 4) END AS tokens FROM events GROUP BY 1""")
def g7_usage_totals(spark, sf_dir):
    """Values of errors are unknown, and make their user's total unknown."""
    c = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("tokens"))
    return pl.usage_totals(c, "run_id", ["tokens"]).withColumn("tokens", F.round("tokens", 4))


def _calls(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("call_id"), (F.col("event_id") % 5).alias("window_id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.lit(1).alias("attempts"), F.col("event_id").alias("duration_ms"), F.when(F.col("event_type") != "view", F.col("event_id")).alias("tokens"), F.col("value").alias("cost"), F.lit("USD").alias("currency"))


@query("""SELECT user_id AS run_id, count(DISTINCT event_id % 5)::BIGINT AS n_windows, count(*) FILTER (event_type <> 'error')::BIGINT AS n_ok, count(*) FILTER (event_type = 'error')::BIGINT AS n_failed,
sum(event_id) FILTER (event_type <> 'view')::BIGINT AS tokens, count(*) FILTER (event_type = 'view')::BIGINT AS n_without_tokens, round(sum(value), 4) AS usd FROM events GROUP BY 1""")
def g10_manifest_aggregates(spark, sf_dir):
    """Events as model calls of the users' runs."""
    c = _calls(spark, sf_dir)
    out = pl.manifest_aggregate(c, c.select("run_id", "window_id").distinct())
    return out.select("run_id", "n_windows", "n_ok", "n_failed", "tokens", "n_without_tokens", F.round(F.col("cost")["USD"], 4).alias("usd"))


@query("WITH " + b.RESPONSES_SQL + """, s AS (SELECT field_id, min(text) AS t FROM v_responses GROUP BY 1),
j AS (SELECT p_partkey, coalesce(trim(regexp_replace(regexp_replace(lower(translate(t, '""" + b.WIDE + "', '" + b.ASCII + r"""')), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'), '[?!.]+$', '')) = lower(p_name), false) AS ok FROM part LEFT JOIN s ON field_id = p_partkey)
SELECT count(*)::BIGINT AS n, count(*) FILTER (ok)::BIGINT AS n_right, round(count(*) FILTER (ok) / count(*), 4) AS accuracy, round(count(*) FILTER (ok) / count(*), 4) >= 0.9 AS passed FROM j""")
def g12_accuracy(spark, sf_dir):
    """Each field's first response as the suggestion."""
    s = b.responses(spark, sf_dir).groupBy("field_id").agg(F.array(F.min("text")).alias("accepted"))
    golden = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("field_id"), F.array("p_name").alias("expected"))
    return pl.evaluate_answers(s, golden)[0]


@query("""SELECT user_id AS run_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS seq FROM events""")
def st1_sequences(spark, sf_dir):
    """ST1."""
    return rn.sequence_events(b.run_events(spark, sf_dir)).select("run_id", "event_id", "seq")


@query("""SELECT user_id AS run_id, count(*)::BIGINT AS n_events, arg_max(event_type, (ts, event_id)) AS type, max(ts) AS updated_at FROM events GROUP BY 1""")
def st2_run_state(spark, sf_dir):
    """ST2."""
    return rn.run_state(rn.sequence_events(b.run_events(spark, sf_dir))).select("run_id", "n_events", "type", "updated_at")


@query("""SELECT event_id AS run_id, CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'processing' END AS status FROM events
WHERE event_type IN ('click', 'view') AND ts <= TIMESTAMP '2024-01-20 00:00:00' - CASE event_type WHEN 'click' THEN INTERVAL 30 SECOND ELSE INTERVAL 180 SECOND END AND event_id % 5 <> 0""")
def st3_stale_runs(spark, sf_dir):
    """ST3: events as runs; every fifth has a draft."""
    e = b.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "view", "processing").otherwise("done")
    runs = e.select(F.col("event_id").alias("run_id"), status.alias("status"), F.col("ts").alias("updated_at"))
    return rn.stale_runs(runs, e.where("event_id % 5 = 0").select(F.col("event_id").alias("run_id")), NOW).select("run_id", "status")


@query("""WITH r AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events)
SELECT event_type AS identity, hour, count(*)::BIGINT AS n, count(*) FILTER (n <= 3)::BIGINT AS n_allowed FROM r GROUP BY 1, 2""")
def st5_rate_limit(spark, sf_dir):
    """ST5 with event types as identities and a limit of 3."""
    e = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("identity"), F.col("event_id").alias("request_id"), F.col("ts").alias("created_at"))
    return rn.rate_limit(e, 3).groupBy("identity", "hour").agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"))


@query("""WITH o AS (SELECT event_id, ts, event_type = 'click' AND ts <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE AS stuck, event_type = 'view' AS pending FROM events)
SELECT event_id AS attempt_id, ts AS created_at FROM o WHERE (stuck OR pending) AND ts <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 MINUTE ORDER BY ts, event_id LIMIT 100""")
def st7_outbox_recovery(spark, sf_dir):
    """ST7: events as deliveries."""
    status = F.when(F.col("event_type") == "click", "sending").when(F.col("event_type") == "view", "pending").otherwise("sent")
    o = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("attempt_id"), status.alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("claimed_at"))
    return rn.recover_outbox(o, NOW)[1].select("attempt_id", "created_at")


@query("""WITH r AS (SELECT event_id, user_id, event_id % 4 AS bi, ts FROM events),
l AS (SELECT DISTINCT ON (user_id, event_id % 4) user_id, event_id % 4 AS bi, value, ts, event_type FROM events ORDER BY user_id, event_id % 4, ts, event_id),
j AS (SELECT r.*, CASE WHEN event_type = 'error' THEN 'reuse' WHEN l.ts > TIMESTAMP '2024-01-01 02:00:00' THEN 'in_progress' ELSE 'claimed' END AS o FROM r JOIN l USING (user_id, bi)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, bi, o ORDER BY ts, event_id) AS n FROM j)
SELECT CASE WHEN o = 'claimed' AND n > 1 THEN 'in_progress' ELSE o END AS outcome, count(*)::BIGINT AS n FROM k GROUP BY 1""")
def st8_leases(spark, sf_dir):
    """ST8: a user's first event of each of four batches is the lease, all events are requests."""
    e = b.table(spark, sf_dir, "events").withColumn("bi", F.col("event_id") % 4)
    lease = e.groupBy(F.col("user_id").alias("run_id"), F.col("bi").alias("batch_index")).agg(F.min_by(F.struct("ts", "event_type"), F.struct("ts", "event_id")).alias("f"))
    lease = lease.select("run_id", "batch_index", F.lit("h").alias("batch_hash"), F.when(F.col("f.event_type") == "error", "completed").otherwise("leased").alias("status"), F.lit(1).alias("attempt_count"), F.col("f.ts").alias("lease_expires_at"))
    req = e.select(F.col("user_id").alias("run_id"), F.col("bi").alias("batch_index"), F.lit("h").alias("batch_hash"), F.col("event_id").alias("request_id"), F.col("ts").alias("arrived"))
    return rn.lease_batches(lease, req, "2024-01-01 02:00:00").groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT event_id, user_id AS run_id, event_type AS type, coalesce(json_extract_string(props, '$.k')::DOUBLE, 0) AS k FROM events""")
def st12_public_events(spark, sf_dir):
    """ST12, S2: public fields of the events; the number comes from the payload."""
    e = b.run_events(spark, sf_dir).withColumn("seq", F.col("event_id")).withColumn("payload", F.regexp_replace("payload", '"k"', '"progress"'))
    return rn.public_events(e).select(F.col("seq").alias("event_id"), "run_id", "type", F.col("progress").alias("k"))


@query("""SELECT l_suppkey AS run_id, 'ANSWER_FIELD_LIMIT' AS failure_code, count(*)::BIGINT AS actual FROM lineitem GROUP BY 1 HAVING count(*) > 500""")
def st13_limit_failures(spark, sf_dir):
    """ST13: suppliers with over 500 lines."""
    f = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"))
    return rn.limit_failures(f).select("run_id", "failure_code", "actual")


@also("v9_versions")
@query("""WITH s AS (SELECT o_custkey AS source_id, o_orderkey, o_orderdate, o_orderdate >= TIMESTAMP '1998-01-01' AS late FROM orders WHERE o_orderstatus = 'F'),
old AS (SELECT source_id, count(*) AS n FROM s WHERE NOT late GROUP BY 1)
SELECT source_id, o_orderkey AS draft_id, late, (CASE WHEN late THEN coalesce(n, 0) ELSE 0 END + row_number() OVER (PARTITION BY source_id, late ORDER BY o_orderdate, o_orderkey))::INTEGER AS version
FROM s LEFT JOIN old USING (source_id)""")
def v9_stored_versions(spark, sf_dir):
    """V9: orders from 1998 on go on from the versions that the earlier ones have stored; all rows of both."""
    o = b.table(spark, sf_dir, "orders")
    drafts = o.select(F.col("o_orderkey").alias("draft_id"), F.col("o_custkey").alias("source_id"), F.col("o_custkey").alias("lesson_id"), F.lit(False).alias("has_matching"), F.lit(True).alias("confirmed"), F.col("o_orderdate").alias("created_at"))
    reasons = o.select(F.col("o_orderkey").alias("draft_id"), F.when(F.col("o_orderstatus") == "F", F.array().cast("array<string>")).otherwise(F.array(F.lit("OPEN_BLOCKING_ISSUE"))).alias("reasons"))
    late = F.col("created_at") >= F.lit("1998-01-01").cast("timestamp")
    early, _ = pb.publish(drafts.where(~late), reasons, drafts.limit(0).withColumn("version", F.lit(0)))
    new, _ = pb.publish(drafts.where(late), reasons, early)
    return early.withColumn("late", F.lit(False)).unionByName(new.withColumn("late", F.lit(True))).select("source_id", "draft_id", "late", "version")


@query("WITH " + b.BLOCKS_SQL + """, r AS (SELECT doc_id, block_id, ord % 9 AS k FROM v_blocks),
c AS (SELECT *, CASE WHEN k IN (0, 6) THEN 'SOURCE_RANGE_OUT_OF_BOUNDS' WHEN k IN (1, 7) THEN 'SOURCE_PAGE_MISMATCH' WHEN k IN (2, 3) THEN 'CROSS_DOCUMENT_REF' WHEN k = 4 THEN 'UNKNOWN_BLOCK_REF' WHEN k = 5 THEN 'SOURCE_BBOX_OUT_OF_BOUNDS' END AS code FROM r)
SELECT doc_id, CASE WHEN k = 4 THEN block_id || '?' ELSE block_id END AS block_id, code FROM c WHERE code IS NOT NULL
UNION ALL SELECT DISTINCT doc_id, NULL, 'DOCUMENT_IR_SOURCE_MISMATCH' FROM r WHERE doc_id % 10 = 0""")
def v2_lineage_failures(spark, sf_dir):
    """V2: a reference to every block: another source or document, an unknown block, ends or starts past the text, other pages, boxes a little outside."""
    bl = b.blocks(spark, sf_dir)
    k = F.col("ord") % 9
    known = bl.withColumn("page_index", F.when(k != 7, F.col("page_index")))
    refs = bl.select(
        "doc_id", F.col("block_id").alias("entity_id"), F.when(k == 2, F.lit(-1)).otherwise(F.col("doc_id")).alias("source_id"), (F.col("doc_id") + F.when(k == 3, 1).otherwise(0)).alias("ref_doc_id"),
        F.when(k == 4, F.concat("block_id", F.lit("?"))).otherwise(F.col("block_id")).alias("block_id"), F.when(k == 6, F.length("raw_text") + 1).when(k != 8, 0).alias("char_start"),
        F.when(~k.isin(6, 8), F.length("raw_text") + F.when(k == 0, 1).otherwise(0)).alias("char_end"), F.when(k != 8, F.col("page_index") + F.when(k == 1, 1).otherwise(0)).alias("page_index"),
        F.when(k != 8, F.col("x") - F.when(k == 5, 0.005).otherwise(0)).alias("x"), "y", "width", "height")
    docs = bl.select("doc_id", F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 10 > 0, F.col("doc_id")).alias("ir_source_id")).distinct()
    return ql.lineage_failures(refs, known, docs).select("doc_id", "block_id", "code")


@query("""WITH c AS (SELECT event_id, event_id % 300 AS a, row_number() OVER (PARTITION BY event_id % 300 ORDER BY ts, event_id) AS n FROM events)
SELECT a AS attempt_id, event_id AS claim_id FROM c WHERE n = 1 AND a % 2 = 0""")
def st6_outbox_claims(spark, sf_dir):
    """ST6: events as claims on 300 deliveries, half of them pending."""
    e = b.table(spark, sf_dir, "events")
    claims = e.select((F.col("event_id") % 300).alias("attempt_id"), F.col("event_id").alias("claim_id"), F.col("ts").alias("arrived"))
    outbox = claims.select("attempt_id").distinct().select(
        "attempt_id", F.when(F.col("attempt_id") % 2 == 0, "pending").otherwise("sent").alias("status"), F.lit(None).cast("timestamp").alias("claimed_at"))
    return rn.claim_outbox(outbox, claims, NOW)[1].where("won").select("attempt_id", "claim_id")


@query("""SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'draft' WHEN n_chars % 3 = 1 THEN 'layoutReview' ELSE 'empty' END AS route FROM documents""")
def st14_routes(spark, sf_dir):
    """ST14: documents with groups, with candidates only, and with neither, by their length."""
    d = b.table(spark, sf_dir, "documents")
    return rn.route_extraction(d, d.where("n_chars % 3 = 0"), d.where("n_chars % 3 <> 2")).select("doc_id", "route")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS d, 'x' || l_partkey % 4 AS region, l_suppkey % 6 AS blk, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE floor(l_quantity / 30)::INTEGER END AS s, CASE WHEN l_partkey % 5 <> 0 THEN 60 END AS e
  FROM lineitem WHERE l_returnflag <> 'A'),
m AS (SELECT d, blk, s, e, list_sort(list(region)) AS rs FROM r GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)
SELECT m.d AS doc_id, 'OVERLAPPING_OWNERSHIP' AS code, array_to_string(rs, ',') AS owner_id, array_to_string(list_sort(list(DISTINCT r.blk::VARCHAR)), ',') AS block_ids
FROM m JOIN r ON r.d = m.d AND list_contains(rs, r.region) GROUP BY m.d, m.blk, m.s, m.e, rs""")
def w16_ownership(spark, sf_dir):
    """Lines as sources of four leaf regions an order (returned ones belong to other roles); some have no start, some no end."""
    l = b.table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey"))
    source = F.struct((F.col("l_suppkey") % 6).cast("string").alias("block_id"), F.when(F.col("k") % 3 != 0, F.floor(F.col("l_quantity") / 30)).cast("int").alias("char_start"), F.when(F.col("k") % 5 != 0, 60).alias("char_end"))
    role = F.when(F.col("l_returnflag") == "A", "instruction").otherwise("localOption").alias("role")
    regions = l.groupBy(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("x"), F.col("k") % 4).alias("region_id"), role).agg(F.collect_list(source).alias("sources"))
    return rc.ownership_conflicts(regions).select("doc_id", "code", "owner_id", F.array_join("block_ids", ",").alias("block_ids"))


@query("WITH " + b.BLOCKS_SQL + """ SELECT doc_id, 'DANGLING_RELATION' AS code, block_id AS owner_id FROM v_blocks WHERE ord % 5 = 0 OR ord % 7 = 0""")
def w10_span_conflicts(spark, sf_dir):
    """A region for each line; some reach past the block, some name a block that is not there."""
    bl = b.blocks(spark, sf_dir)
    known = F.when(F.col("ord") % 7 == 0, F.concat("block_id", F.lit("?"))).otherwise(F.col("block_id"))
    end = F.length("raw_text") + F.when(F.col("ord") % 5 == 0, 1).otherwise(0)
    regions = bl.select("doc_id", F.col("block_id").alias("region_id"), F.array(F.struct(known.alias("block_id"), F.lit(0).alias("char_start"), end.alias("char_end"))).alias("sources"))
    return rc.region_span_conflicts(regions, bl).select("doc_id", "code", "owner_id")


@query("""SELECT user_id AS run_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'FAILURE_MISSING' ELSE 'FAILURE_UNEXPECTED' END AS code FROM events WHERE (event_type = 'error') <> (value > 10)""")
def v15_event_rules(spark, sf_dir):
    """Errors as failed events; those with large values carry a failure."""
    e = b.table(spark, sf_dir, "events")
    ev = e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.when(F.col("value") > 10, "terminal").alias("failure_kind"), F.lit(None).cast("string").alias("failure_code"), F.lit(False).alias("resume_allowed"), F.lit(None).cast("string").alias("details"))
    return ql.event_violations(ev)


@query("WITH " + b.BLOCKS_SQL + """, f AS (SELECT doc_id, block_id, raw_text, CASE WHEN ord % 4 = 0 THEN '#none#' ELSE string_split(raw_text, ' ')[2] END AS w FROM v_blocks)
SELECT doc_id, block_id, CASE WHEN strpos(raw_text, w) > 0 THEN strpos(raw_text, w) - 1 ELSE 0 END::BIGINT AS char_start,
  CASE WHEN strpos(raw_text, w) > 0 THEN strpos(raw_text, w) - 1 + length(w) ELSE length(raw_text) END::BIGINT AS char_end FROM f""")
def e23_source_refs(spark, sf_dir):
    """The second word of each line, or a fragment that is not there."""
    bl = b.blocks(spark, sf_dir).withColumn("w", F.when(F.col("ord") % 4 == 0, "#none#").otherwise(F.get(F.split("raw_text", " "), F.lit(1))))
    return ex.add_source_ref(bl, "w").select("doc_id", "block_id", F.col("char_start").cast("long"), F.col("char_end").cast("long"))

import duckdb

import __spark_entry__ as entry


def test_late_submissions_meet_stored_keys(spark, sf):
    rows = entry.queries()["h9_stored_submissions"](spark, sf).where("late").groupBy("outcome").count().collect()
    assert {"replay", "conflict"} <= {r.outcome for r in rows}


def test_late_sources_with_a_stored_key_create_nothing(spark, sf):
    key = "case when length(text) % 9 > 0 then lang || right(doc_id::varchar, 1) end"
    keys = dict(duckdb.sql(f"select doc_id::varchar, {key} from '{sf}/documents.parquet'").fetchall())
    rows = entry.queries()["s8_stored_replays"](spark, sf).collect()
    assert len(rows) == len(keys) and all((r.outcome == "missing_key") == (keys[r.doc_id] is None) for r in rows)
    stored = {keys[r.doc_id] for r in rows if not r.late} - {None}
    met = [r.outcome for r in rows if r.late and keys[r.doc_id] in stored]
    assert met and "create" not in met


def test_late_versions_go_on_from_stored_ones(spark, sf):
    rows = entry.queries()["v9_stored_versions"](spark, sf).collect()
    stored = {}
    for r in rows:
        if not r.late:
            stored[r.source_id] = max(stored.get(r.source_id, 0), r.version)
    firsts = {}
    for r in rows:
        if r.late:
            firsts[r.source_id] = min(firsts.get(r.source_id, r.version), r.version)
    assert set(firsts) & set(stored) and all(v == stored.get(k, 0) + 1 for k, v in firsts.items())

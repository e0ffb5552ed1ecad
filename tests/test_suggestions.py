import duckdb

import __spark_entry__ as entry


def test_every_repeated_id_of_the_lines_is_reported(spark, sf):
    want = duckdb.sql(f"select l_partkey from '{sf}/lineitem.parquet' group by 1 having count(*) > 1").fetchall()
    rows = entry.queries()["g5_all_suggestion_checks"](spark, sf).where("code = 'DUPLICATE_ID'").select("field_id").collect()
    assert sorted(map(tuple, rows)) == sorted(want)

"""Every registered query with SQL gives the rows of that SQL on the smallest given tables."""

from pathlib import Path

import duckdb
import pytest

from spoor.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no given tables")
SOME = ["candidate_edges", "candidate_edges_mv", "edge_recall", "objective_cell_state", "division_state", "indicators", "split_at_divisions", "edge_matches", "fn_divisions", "perfect_segments", "score_upsert", "best_config", "avg_movement_vector", "normalize_median", "movement_vector_paint", "validation_score_gaps", "rasterize_tubes", "fp_divisions_open_end"]


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        db.sql(f"create view {file.stem} as select * from '{file}'")
    found = QUERIES[name](spark, DATA)
    expected = db.sql(ORACLE[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_negative_costs_that_round_to_zero_keep_their_sign_as_in_sql(spark, tmp_path):
    """A cell predicted 0.999999 from another: the logarithm of their distance rounds to minus zero."""
    db = duckdb.connect()
    where = f"{tmp_path}/events.parquet"
    db.sql(f"""copy (select event_id, (timestamp '2024-01-01' + to_days(CAST(event_id AS INTEGER))) as ts, 5 + event_id as user_id, 'view' as event_type, v as value, '{{"k": ' || k || '}}' as props
      from (values (0::BIGINT, 10.0::DOUBLE, 4), (1::BIGINT, 14.0::DOUBLE + 0.999999, 6)) e(event_id, v, k)) to '{where}' (format parquet)""")
    db.sql(f"create view events as select * from '{where}'")
    found, expected = QUERIES["objective_log"](spark, str(tmp_path)), db.sql(ORACLE["objective_log"])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())
    assert "-0.0" in {str(r[0]) for r in found.filter("kind = 'edge_selected'").select("coef").collect()}

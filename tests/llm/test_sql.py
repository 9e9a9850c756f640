import os

import duckdb
import pytest

from groundmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for f in os.listdir(sf):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    result = duck.execute(queries.ORACLES[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[at.index(c)] for c in columns) for r in result.fetchall()), key=repr)


def test_every_problem_has_its_query():
    assert {"p2_found", "p3_found", "p4_found", "p5_contexts", "p6_found", "p7_pieces"} <= set(queries.QUERIES)

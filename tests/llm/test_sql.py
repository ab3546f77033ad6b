"""Corpus queries against their SQL twins; those without one have plain versions in the other tests."""

import pytest
from tablestakes.llm.oracles import ORACLES
from tablestakes.llm.queries import QUERIES


def text(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def test_twins_belong_to_queries():
    assert set(ORACLES) < set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    theirs = sorted(tuple(text(row[order.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == theirs

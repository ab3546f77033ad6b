"""Every query outside the corpus operators against its SQL twin on a second engine."""

import pytest

import __spark_entry__ as entry
from tablestakes.plans.oracles import ORACLES as SQL
from tablestakes.plans.queries import QUERIES


def text(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    theirs = sorted(tuple(text(row[order.index(c)]) for c in columns) for row in result.fetchall())
    assert mine == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

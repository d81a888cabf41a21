"""Every query with SQL gives the rows of that SQL; every other one runs and has a stable schema."""

import pandas as pd
import pytest

from shelfspark import registry

from .conftest import SMALL


def cell(x):
    if pd.isna(x):
        return "None"
    return f"{x:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    a, b = registry.queries()[name](spark, SMALL), registry.queries()[name](spark, SMALL)
    assert a.dtypes == b.dtypes and a.count() == b.count() > 0


def test_comparison_sees_a_difference(duck):
    a = duck.execute("select 1.5 as x, 'a' as y union all select 2.5, 'b'").fetchdf()
    b = duck.execute("select 1.5 as x, 'a' as y union all select 2.6, 'b'").fetchdf()
    assert rows(a) != rows(b) and rows(a) != rows(a.head(1))

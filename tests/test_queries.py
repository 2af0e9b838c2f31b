"""Every registered gridded query against its SQL twin."""

import pandas as pd
import pytest

from lattica.plans.catalogue import ORACLE, QUERIES


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            u, w = a[c].astype(float), b[c].astype(float)
            assert ((u == w) | (u.isna() & w.isna())).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(name, spark, sf, duck):
    same(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_twin(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())

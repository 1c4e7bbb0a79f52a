"""Every query with SQL equals that SQL, as multisets of rows with equal column types."""

import os

import pytest
from compare import compare, connect

from sessionloom.checks import catalog, modelling

ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


# Each fits several full models; test_models.py runs the same plans on small ones.
SLOW = {"m_train_all", "e_evaluate_capture", "m_clean_train", "m_mlp_balanced"}
NAMES = sorted(ORACLE if os.environ.get("TEST_FULL_MODELS") else set(ORACLE) - SLOW)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, sf_dir, name, monkeypatch):
    # Full models on fewer labelled rows, to keep the run short.
    monkeypatch.setattr(modelling, "FIT_ROWS", 300)
    assert compare(spark, con, catalog.queries()[name], ORACLE[name], sf_dir) is None


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert len(df.columns) == 312 and df.count() > 0

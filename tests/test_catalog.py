"""Every catalogued query against its literal SQL on DuckDB."""

import pytest

from compare import connection, difference
from matchlake.plans import catalog, oracles

SQL = oracles.oracle_sql()
UNCHECKED = {"pred_linear", "pred_tree"}


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


def test_only_trained_scores_lack_sql():
    assert set(catalog.queries()) - set(SQL) == UNCHECKED
    assert set(SQL) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, small, name):
    got = catalog.queries()[name](spark, small).toPandas()
    told = difference(got, duck.execute(SQL[name]).df())
    assert told is None, told


def test_scores_cover_all_featured_games(spark, small):
    featured = catalog.queries()["features"](spark, small).count()
    for name in ("pred_linear", "pred_dense"):
        rows = catalog.queries()[name](spark, small)
        assert rows.columns == ["game_id", "pred_home_score", "pred_away_score", "pred_home_win_pct"]
        assert rows.dropna().count() == featured


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())

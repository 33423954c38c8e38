"""What the registered searches fit on, with small grids; whole ones take minutes."""

import os

import pytest

import __spark_entry__ as driver
from cohortspark.plans import models
from cohortspark.queries.events import FEATURE_COLUMNS, WIDE_SQL
from oracle import connect, difference

FOLDER = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


@pytest.mark.parametrize("name, grid", [("logistic_cv", "logistic"), ("forest_cv", "forest")])
def test_search_fits_on_the_features_of_the_events(spark, monkeypatch, name, grid):
    monkeypatch.setitem(models.GRIDS[grid], "full", models.GRIDS[grid]["small"])
    given, prepare = [], models.prepare
    monkeypatch.setattr(models, "prepare", lambda features, key: given.append(features) or prepare(features, key))
    db = connect(FOLDER)
    assert difference(driver.queries()[name](spark, FOLDER), db, driver.oracle_sql()[name]) is None

    (events,) = [features for features in given if "user_id" in features.columns]
    got = sorted((r.user_id, r.label, *r.features.toArray()) for r in events.collect())
    assert got == sorted(db.execute(f"SELECT user_id, label, {', '.join(FEATURE_COLUMNS)} FROM ({WIDE_SQL})").fetchall())
    assert all(len(set(column)) > 1 for column in zip(*got))

"""Registered queries call their operators at the surveyed sizes."""

import inspect

from duelframe.operators import evaluation as ev
from duelframe.plans import evaluation as plans


def test_bootstrap_draws_the_surveyed_iterations(monkeypatch):
    real, seen = inspect.signature(ev.bootstrap_mean), []
    monkeypatch.setattr(plans, "tables", lambda *_: ("labels",))
    monkeypatch.setattr(ev, "bootstrap_mean", lambda *a, **k: seen.append(real.bind(*a, **k)))
    plans.bootstrap(None, "")
    seen[0].apply_defaults()
    assert seen[0].arguments["iterations"] == 2000


def test_moving_rate_counts_twelve_hours_and_the_minute(spark, monkeypatch):
    """the window of twelve hours had become one minute."""
    from duelframe.plans import more

    rows = [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 11:59:30"), (3, 7, "2024-01-01 12:00:10"), (4, 8, "2024-01-01 12:00:10")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "CAST(ts AS timestamp) AS ts")
    monkeypatch.setattr(more, "tables", lambda *_: (events,))
    assert sorted(map(tuple, more.moving_rate(spark, "").collect())) == [(1, 1, 1), (2, 2, 1), (3, 2, 2), (4, 1, 1)]

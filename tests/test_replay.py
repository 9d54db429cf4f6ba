"""W3 over history: summaries of days against the plain fold."""

import datetime as dt
import random

from tidegauge.operators.planning import Thresholds, replay


def _fold(rows, t):
    once = {}
    for url, at, cost, positive, failed in rows:
        once[url, at] = max(once.get((url, at), (False, -1, False)), (positive, cost, failed))
    state = {}
    for (url, at), (positive, cost, failed) in sorted(once.items()):
        strikes, since, _ = state.get(url, (0, None, None))
        struck = not positive and (cost > t.cost_ms or failed)
        strikes = strikes + 1 if struck else 0
        if positive:
            since = None
        elif struck and strikes >= t.strikes and since is None:
            since = at
        state[url] = strikes, since, at
    return sorted((u, *s) for u, s in state.items())


def test_replay_is_the_fold(spark):
    rng = random.Random(3)
    for strikes in (1, 2, 3, 7):
        t = Thresholds(strikes=strikes, cost_ms=100)
        rows = []
        for e in range(60):
            p = rng.choice([0.02, 0.2, 0.6])
            rows += [(f"u{e}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 12)), rng.choice([1, 500]), rng.random() < p, rng.random() < 0.5) for _ in range(rng.randint(1, 60))]
        frame = spark.createDataFrame(rows, "url string, at timestamp, cost_ms long, positive boolean, liveness_failed boolean").repartition(4)
        found = replay(frame, t)
        assert sorted(map(tuple, found.collect())) == _fold(rows, t)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    assert replay(frame.where("false"), t).count() == 0

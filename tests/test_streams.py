"""Keyed state: holds that lapse by a timer, and state that goes."""

import datetime as dt

from tidegauge.operators.planning import Thresholds
from tidegauge.plans import stream_queries
from tidegauge.streaming import jobs

SCHEMA = "url string, at timestamp, cost_ms long, positive boolean, liveness_failed boolean, hold string, held_until timestamp"
D = lambda d, h=0: dt.datetime(2024, 1, d, h)


def test_holds_lapse_without_input_and_old_state_goes(spark):
    bad = lambda url, at: (url, at, 1, False, True, None, None)
    parts = [
        [bad("a", D(1)), bad("b", D(1)), ("a", D(1, 1), None, None, None, "asked for", D(5)), bad("gone", D(1))],
        [bad("a", D(2)), bad("a", D(3)), bad("b", D(2))],
        [bad("b", D(9))],  # no outcome of a: time alone ends its hold
        [bad("a", D(10)), bad("a", D(11)), bad("gone", D(12))],
    ]
    frames = [spark.createDataFrame(p, SCHEMA) for p in parts]
    out = stream_queries._run(lambda s: jobs.strikes_stream(s, Thresholds(strikes=2), delay="1 hour", keep_days=8), frames, "update")
    rows = sorted((r.url, r.last_probed, r.lapsed_hold or "", r.strikes, r.dormant_since) for r in out.collect())
    a = [r[1:] for r in rows if r[0] == "a"]
    assert (D(3), "", 2, None) in a and (D(3), "asked for", 0, None) in a  # held awake, then lapsed
    assert (D(11), "", 2, D(11)) in a
    # Untouched for more than eight days: the state had gone, so strikes begin anew.
    assert ("gone", D(12), "", 1, None) in rows and ("b", D(9), "", 3, D(2)) in rows

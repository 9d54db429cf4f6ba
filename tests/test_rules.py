"""Rules on small hand-written frames: state, time series, scoring, declarations, planning, names."""

import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import text as t
from tidegauge.functions.rotation import fnv1a, rotation_bucket
from tidegauge.operators import current, declarations, facts, planning, profile, readers, registry, rollup, search, verdicts
from tidegauge.plans import quad_queries
from tidegauge.schemas import RDF_TYPE, SD, VOID

D = lambda d, h=0: dt.datetime(2024, 1, d, h)
READING = "endpoint string, metric string, run string, run_at timestamp, kind string, verdict string, reason string, elapsed_ms long, level int"


def readings(spark, *rows):
    return spark.createDataFrame([(e, m, f"r{at:%d%H}", at, "declined" if why else "measured", v, why, ms, None) for e, m, at, v, why, ms in rows], READING)


def test_measured_hides_later_declines(spark):
    r = readings(spark, ("e", "m", D(1), "absent", None, 5), ("e", "m", D(2), None, "liveness-failed", None), ("e", "n", D(1), None, "liveness-failed", None), ("e", "n", D(3), None, "cadence", None))
    got = {x.metric: x for x in current.current_readings(r).collect()}
    assert got["m"].verdict == "absent" and got["n"].reason == "liveness-failed"


def test_merge_is_order_free(spark):
    rows = [("e", "m", D(d), v, why, None) for d, v, why in ((1, "verified", None), (2, None, "cadence"), (3, None, "liveness-failed"))]
    full = current.current_readings(readings(spark, *rows)).collect()
    for order in itertools.permutations(rows):
        state = current.current_readings(readings(spark, order[0]))
        for row in order[1:]:
            state = current.merge_current(state, readings(spark, row))
        assert state.collect() == full


def test_ties_are_refused(spark):
    r = readings(spark, ("e", "m", D(1), "absent", None, 5)).unionByName(readings(spark, ("e", "m", D(1), "verified", None, 5)).withColumn("run", F.lit("other")))
    assert current.ties(r, ["endpoint"]).count() == 1
    with pytest.raises(ValueError):
        current.refuse_ties(r, ["endpoint"])


def test_a_run_that_is_loaded_again_replaces_its_text(spark):
    old = readings(spark, ("e", "m", D(1), "absent", None, 5), ("e", "m", D(2), "verified", None, 9), ("f", "m", D(2), "verified", None, 9))
    new = readings(spark, ("e", "m", D(2), "absent", None, 1))
    got = {r.endpoint: (r.verdict, r.elapsed_ms) for r in current.merge_current(current.current_readings(old), new).collect()}
    assert got == {"e": ("absent", 1), "f": ("verified", 9)}
    assert {r.endpoint: r.elapsed_ms for r in current.merge_current(current.current_readings(old), readings(spark, ("e", "m", D(1), "verified", None, 1))).collect()} == {"e": 9, "f": 9}


INDEX = "endpoint string, own_run string, own_at int, own_emission string, own_finalised boolean, newest_run string, newest_emission string, newest_finalised boolean, measured_at int"
STATUS = [
    # own run unfinished only where it says how it is written
    (("own", 5, "1", None, "own", "1", None, 5), (), (), {"unfinished"}), (("own", 5, None, None, "own", None, None, 5), (), (), set()), (("own", 5, "1", True, "own", "1", True, 5), (), (), set()),
    # a newer run stopped before this endpoint
    (("own", 5, "1", True, "new", "1", None, 5), (), (), {"not_reached"}), (("own", 5, "1", True, "new", None, None, 5), (), (), set()), (("own", 5, "1", True, "new", "1", None, 5), ("new",), (), set()),
    (("own", 5, "1", True, "new", "1", None, 5), (), ("new",), {"declined_to_ask"}), (("own", 5, "1", True, None, None, None, 5), (), (), set()),
    # a newer run finished without it
    (("own", 5, "1", True, "new", "1", True, 5), (), (), {"newest_recorded_nothing"}), (("own", 5, "1", True, "new", None, True, 5), (), (), {"newest_recorded_nothing"}),
    (("own", 5, "1", True, "new", "1", True, 5), ("new",), (), set()), (("own", 5, "1", True, "new", "1", True, 5), ("old",), ("old",), {"newest_recorded_nothing"}),
    (("own", 5, "1", True, "new", "1", True, 5), (), ("new",), {"newest_recorded_nothing", "declined_to_ask"}),
    # the own run's declaration is no second sweep; a reading older than its run
    (("own", 5, "1", True, "own", "1", True, 5), (), ("own",), set()), (("own", 5, "1", True, "own", "1", True, 4), (), (), {"older_than_header"}), (("own", 5, "1", True, "own", "1", True, None), (), (), set()),
]


def test_run_status(spark):
    rows, done, dormant = [], [], []
    for k, (row, completed, declared, _) in enumerate(STATUS):
        rows.append((f"e{k}", *row))
        done += [(run, f"e{k}") for run in completed]
        dormant += [(run, f"e{k}") for run in declared]
    facts_of = lambda f: spark.createDataFrame(f, "run string, endpoint string")
    got = {r.endpoint: r for r in readers.run_status(spark.createDataFrame(rows, INDEX), facts_of(done), facts_of(dormant)).collect()}
    flags = ("unfinished", "not_reached", "newest_recorded_nothing", "declined_to_ask", "older_than_header")
    for k, (*_, want) in enumerate(STATUS):
        assert {f for f in flags if got[f"e{k}"][f]} == want, STATUS[k]


def test_places_are_the_plain_order(spark):
    rng = random.Random(4)
    rows = [(f"http{'s' if rng.random() < 0.5 else ''}://{rng.choice('abc')}{rng.randrange(300)}.org/x{k}", rng.choice([None, *[D(d, h) for d in (1, 2, 9) for h in (0, 5)]])) for k in range(200)]
    got = {r.url: r.place for r in planning._places(spark.createDataFrame(rows, "url string, last_probed timestamp")).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or D(1), r[0]))
    assert got == {url: k + 1 for k, (url, _) in enumerate(order)}
    assert planning._places(spark.createDataFrame([], "url string, last_probed timestamp")).isEmpty()


def test_replaced_run_equals_rebuild(spark):
    old = readings(spark, ("e", "m", D(1), "absent", None, 5), ("e", "m", D(2), "verified", None, 5), ("e", "n", D(2), "absent", None, 1))
    new = old.where("run <> 'r0200' or metric = 'n'")
    merged = current.advance_current(current.current_readings(old), new.where("run = 'r0200'"), spark.createDataFrame([("r0200",)], "run string"), lambda stale: new)
    assert sorted(merged.collect()) == sorted(current.current_readings(new).collect())


def test_a_reload_that_declines_shows_the_older_measurement(spark):
    first = readings(spark, ("e", "m", D(1), "absent", None, 5), ("e", "m", D(2), "verified", None, 5), ("e", "n", D(3), "absent", None, 5), ("f", "m", D(2), "verified", None, 1))
    again = readings(spark, ("e", "m", D(2), None, "liveness-failed", None), ("e", "n", D(2), "absent", None, 2), ("g", "m", D(2), "absent", None, 3))
    whole = first.where("run <> 'r0200'").unionByName(again)
    got = current.advance_current(current.current_readings(first), again, again.select("run"), lambda stale: whole)
    assert sorted(got.collect()) == sorted(current.current_readings(whole).collect())
    assert got.where("endpoint = 'e' and metric = 'm'").first().run == "r0100"


def test_check_reads_differing_buckets_only(spark):
    whole = readings(spark, *[(f"e{k}", "m", D(1 + k % 9, k % 20), "absent", None, k) for k in range(400)])
    stored = current.current_readings(whole).where("endpoint <> 'e7'").withColumn("elapsed_ms", F.when(F.col("endpoint") == "e9", 0).otherwise(F.col("elapsed_ms")))
    stored = stored.unionByName(stored.where("endpoint = 'e3'").withColumn("endpoint", F.lit("more")))
    found = current.check_current(stored, current.current_readings(whole), buckets=64)
    assert {(r.endpoint, *r.reasons, r.pairs) for r in found.collect()} == {("e7", "missing", 1), ("e9", "differs", 1), ("more", "not in the archive", 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[endpoint[^\n]*\n[^\n]*(Project[^\n]*\n[^\n]*)?Filter [^\n]*xxhash64\(endpoint", plan)  # below the derivation
    same = current.check_current(current.current_readings(whole), current.current_readings(whole.repartition(7)))
    assert same.isEmpty()


def test_pinned_and_pointers(spark):
    runs = spark.createDataFrame([("r1", "a1"), ("r2", "a2"), ("r3", "a3")], "run string, activity string")
    cur = spark.createDataFrame([("r1", "x"), ("y", "a2")], "s string, o string")
    assert {r.run for r in current.pinned_runs(cur, runs).collect()} == {"r1", "r2"}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 19, 20, 21])
def test_percentiles(spark, n):
    row = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("a")).select(
        *[rollup.summary_percentile(F.col("a"), q).alias(f"s{k}") for k, q in enumerate((0.5, 0.95))], *[rollup.chart_percentile(F.col("a"), q).alias(f"c{k}") for k, q in enumerate((0.5, 0.95))]
    ).first()
    for k, q in enumerate((0.5, 0.95)):
        assert row[f"s{k}"] == max(1, min(n, round(q * n + 0.5)))
        assert row[f"c{k}"] == min(n - 1, round(q * (n - 1))) + 1


def test_uptime_falls_back_to_asked(spark):
    r = readings(spark, ("e", "m", D(1), "indeterminate", None, None), ("e", "m", D(1, 5), "indeterminate", None, None), ("e", "m", D(2), "verified", None, 3), ("e", "m", D(2, 1), "indeterminate", None, None))
    got = {x.day.day: (x.uptime, x.answered, x.probes) for x in rollup.uptime(r).collect()}
    assert got == {1: (0.0, 0, 2), 2: (100.0, 1, 2)}


def test_calendar_has_gaps_and_prefers_summaries(spark):
    r = readings(spark, ("e", "m", D(1), "verified", None, 3), ("e", "m", D(4), "absent", None, 3))
    stored = rollup.uptime_of_summary(rollup.daily(readings(spark, ("e", "m", D(4), "verified", None, 9))))
    got = [(x.day.day, x.uptime) for x in rollup.calendar_series(rollup.uptime(r), stored).orderBy("day").collect()]
    assert got == [(1, 100.0), (2, None), (3, None), (4, 100.0)]


def test_transitions_and_changes(spark):
    r = readings(spark, ("e", "m", D(1), "verified", None, 1), ("f", "m", D(2), "verified", None, 1), ("e", "m", D(3), "verified", None, 1))
    got = [(x.endpoint, x.run_at.day, x.was, x.now) for x in rollup.transitions(r).orderBy("endpoint", "run_at").collect()]
    assert got == [("e", 1, None, "verified"), ("e", 2, "verified", "not-measured"), ("e", 3, "not-measured", "verified"), ("f", 2, None, "verified"), ("f", 3, "verified", "not-measured")]
    assert not rollup.changed_pairs(r).where("endpoint = 'e'").first().changed


def test_matrix_shows_unknown_values(spark):
    r = readings(spark, ("e", "m", D(1), "brand-new", None, 1), ("f", "m", D(1), None, "cadence", None))
    got = {x.state: x.cells for x in rollup.state_matrix(r).collect()}
    assert got["unrecognised"] == 1 and got["not-measured"] == 1 and sum(got.values()) == 2 and len(got) == 8


def test_stretches(spark):
    days = spark.createDataFrame([("e", "m", D(d).date()) for d in (1, 2, 5)], "endpoint string, metric string, day date")
    assert sorted((x["first"].day, x["days"]) for x in rollup.stretches(days).collect()) == [(1, 2), (5, 1)]


OBS = "kind string, status int, error string, body_kind string, boolean boolean, expect boolean, bindings array<string>, cors boolean, allow_origin string, allow_methods string, declared_by string, claimed boolean, stated long, tolerance double, expired boolean"
BASE = dict(kind=None, status=200, error=None, body_kind="sparql-json", boolean=None, expect=None, bindings=None, cors=False, allow_origin=None, allow_methods=None, declared_by=None, claimed=False, stated=None, tolerance=None, expired=False)
CASES = [
    (dict(kind="ask-data", boolean=True, declared_by="f"), "undeclared-but-verified"), (dict(kind="ask-data", boolean=True, declared_by="f", claimed=True), "verified"),
    (dict(kind="ask-filter", boolean=False, expect=True, claimed=True), "declared-but-wrong"), (dict(kind="ask-filter", boolean=False, expect=True, status=500, claimed=True), "indeterminate"),
    (dict(kind="ask-data", claimed=True), "declared-only"), (dict(kind="fetch-void", status=404, body_kind="html"), "absent"), (dict(kind="fetch-void", body_kind="html"), "indeterminate"),
    (dict(kind="fetch-void", body_kind="other"), "declared-but-wrong"), (dict(kind="cors-preflight", status=405), "absent"), (dict(kind="cors-preflight", status=302), "indeterminate"),
    (dict(kind="cors-preflight", allow_origin="*"), "verified"), (dict(kind="cors-preflight", allow_origin="*", allow_methods=""), "absent"), (dict(kind="cors-preflight", allow_origin="*", allow_methods="POST , get"), "verified"),
    (dict(kind="liveness", body_kind="other"), "absent"), (dict(kind="liveness", error="timeout"), "indeterminate"), (dict(kind="counted", stated=100, bindings=["105"], tolerance=0.05), "verified"),
    (dict(kind="counted", stated=100, bindings=["106"], tolerance=0.05), "declared-but-wrong"), (dict(kind="counted", stated=0, bindings=["1"], tolerance=9.0), "declared-but-wrong"), (dict(kind="counted", bindings=["0"]), "absent"),
    (dict(kind="counted", stated=5), "declared-only"), (dict(kind="select-iris", bindings=["x"]), "verified"), (dict(kind="select-iris"), "absent"), (dict(kind="vocabulary-described", claimed=True), "declared-only"),
    (dict(kind="dereference-endpoint", body_kind="rdf"), "verified"), (dict(kind="dereference-endpoint", status=410, body_kind="other"), "absent"), (dict(kind="liveness", expired=True), "indeterminate"), (dict(kind="class-profile"), "indeterminate"),
]


def test_resolve_cases(spark):
    rows = [tuple((BASE | c)[k] for k in BASE) for c, _ in CASES]
    got = [r.v for r in spark.createDataFrame(rows, OBS).coalesce(1).select(verdicts.resolve().alias("v")).collect()]
    assert got == [v for _, v in CASES]


def test_scope(spark):
    svc = lambda g, s, e: [(g, s, RDF_TYPE, f"{SD}Service", "iri"), (g, s, f"{SD}endpoint", e, "iri")]
    rows = [*svc("g1", "s1", "http://a.org/q"), *svc("g1", "s2", "http://b.org/q"), ("g1", "s1", f"{SD}defaultDataset", "d", "iri"), ("g1", "d", f"{VOID}classPartition", "c", "blank"), ("g1", "d", f"{SD}graph", "s2", "iri"),
            ("g1", "c", f"{VOID}class", "K", "iri"), ("g1", "s2", f"{SD}feature", "F", "iri"), ("g2", "x", f"{VOID}triples", "7", "literal"), *svc("g3", "s", "http://other/q"), *svc("g3", "t", "http://third/q"), *svc("g4", "s", "http://other/q")]
    q = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "g string, s string, p string, o string, o_kind string, line_no int")
    ends = spark.createDataFrame([(g, "https://www.a.org:443/q/") for g in ("g1", "g2", "g3", "g4")], "g string, endpoint string")
    scoped = declarations.scope(q, ends)
    got = {(r.g, r.s) for r in scoped.collect()}
    assert got == {("g1", "s1"), ("g1", "d"), ("g1", "c"), ("g2", "x"), ("g4", "s")}
    assert declarations.scoped_sets(q, scoped).where("g = 'g1'").first().classes == ["K"]
    assert declarations.scoped_counts(q, scoped).where("g = 'g2'").first().triples == 7
    flags = {r.g: r for r in declarations.document_flags(q).collect()}
    assert flags["g1"].names_dataset and flags["g1"].has_partitions and not flags["g2"].names_dataset


def test_void_claims_need_the_exact_endpoint(spark):
    q = spark.createDataFrame([("g", 1, "d1", f"{VOID}sparqlEndpoint", "http://a/"), ("g", 2, "d2", f"{VOID}sparqlEndpoint", "http://a"), ("g", 3, "d2", f"{VOID}triples", "12")], "g string, line_no int, s string, p string, o string")
    got = facts.void_claims(q, spark.createDataFrame([("g", "http://a")], "g string, endpoint string")).first()
    assert (got.dataset, got.declared_triples) == ("d2", 12)


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def state(spark, **cols):
    base = dict(url="u", strikes=0, strikes_before_last=0, last_probed=None, last_cost_ms=None, last_triples=None, last_classes=None, last_profiled_at=None, dormant_since=None, hold=None, lapsed_hold=None)
    return spark.createDataFrame([tuple((base | cols).values())], planning.STATE)


def outcome(spark, cost=1, positive=False, failed=False):
    return spark.createDataFrame([("u", cost, positive, None, None, False, failed)], "url string, cost_ms long, positive boolean, triples long, classes long, profiled boolean, liveness_failed boolean")


@pytest.mark.parametrize(
    ("before", "out", "strikes", "dormant"),
    [
        (dict(strikes=2), dict(cost=99_999), 3, True), (dict(strikes=2), dict(failed=True), 3, True), (dict(strikes=2), dict(), 0, False), (dict(strikes=5, dormant_since=D(3)), dict(positive=True), 0, False),
        (dict(strikes=3, strikes_before_last=1, last_probed=dt.datetime(2024, 2, 1)), dict(failed=True), 2, False), (dict(strikes=1, last_probed=dt.datetime(2024, 3, 1)), dict(failed=True), 1, False),
        (dict(strikes=2, hold=("awake", "x", None)), dict(failed=True), 3, False), (dict(strikes=2, hold=("dormant", "x", None)), dict(failed=True), 2, False),
        (dict(strikes=2, hold=("awake", "x", D(5))), dict(failed=True), 1, False),
    ],
)
def test_update(spark, before, out, strikes, dormant):
    urls = spark.createDataFrame([("u",)], "url string")
    got = planning.update(state(spark, **before), urls, outcome(spark, **out), now()).first()
    assert (got.strikes, got.dormant_since is not None) == (strikes, dormant)
    again = planning.update(planning.update(state(spark, **before), urls, outcome(spark, **out), now()), urls, outcome(spark, **out), now()).first()
    assert again.strikes == strikes


def test_update_refuses_unlisted(spark):
    with pytest.raises(ValueError):
        planning.update(state(spark), spark.createDataFrame([("v",)], "url string"), outcome(spark), now())


def test_wake_sleep_prune(spark):
    ask = spark.createDataFrame([("u", "why"), ("n", "new")], "url string, reason string")
    awake = {r.url: r for r in planning.wake(state(spark, strikes=4, dormant_since=D(1)), ask, now()).collect()}
    assert awake["u"].dormant_since is None and awake["u"].hold.state == "awake" and awake["n"].strikes == 0
    asleep = {r.url: r for r in planning.sleep(state(spark, dormant_since=D(1)), ask, now()).collect()}
    assert asleep["u"].dormant_since == D(1) and asleep["n"].hold.state == "dormant"
    none = spark.createDataFrame([], "url string")
    assert planning.prunable(state(spark), none).count() == 1 and planning.prunable(state(spark, hold=("dormant", "x", None)), none).count() == 0


def test_rotation(spark):
    def slow(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h

    names = ["", "a", "http://exämple/", "x" * 300]
    assert fnv1a(names).tolist() == [slow(n) for n in names]
    got = spark.createDataFrame([(n,) for n in names] + [(None,)], "u string").select(rotation_bucket(F.col("u"), 7).alias("b")).collect()
    assert [r.b for r in got] == [slow(n) % 7 for n in names] + [None]
    m = spark.createDataFrame([("p", "exhaustive"), ("a", "cheap")], "metric string, cost string")
    split = planning.rotation_split(spark.createDataFrame([(n,) for n in names[1:]], "url string"), m, now(), 1)
    assert split.where("reason is not null").isEmpty()


@pytest.mark.parametrize(("a", "b", "near"), [("receptor", "recpetor", True), ("name", "name", True), ("name", "nam", True), ("abc", "cba", False), ("abcd", "badc", False), ("ab", "ba", True), ("abcd", "abdd", True), ("abc", "abcde", False), ("", "a", True)])
def test_one_edit(spark, a, b, near):
    assert spark.range(1).select(t.within_one_edit(F.lit(a), F.lit(b)).alias("x")).first().x is near


def test_hosts(spark):
    urls = ["HTTP://U:p@Ex.org:80/a", "https://[::1]:8443/", "http://10.1.2.3/", "http://172.32.0.1/", "http://0.0.0.0", "http://x.example.org", "http://[::ffff:127.0.0.1]/", "http://fine.eu:8080/"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").coalesce(1).select(t.host_key(F.col("u")).alias("k"), t.host(F.col("u")).alias("h"), t.unroutable(F.col("u")).alias("x"), t.reserved_name(F.col("u")).alias("r")).collect()
    assert [r.k for r in rows][:2] == ["ex.org", "[::1]:8443"] and rows[7].k == "fine.eu:8080"
    assert [r.x for r in rows] == [None, "loopback", "private", None, "unspecified", None, "loopback", None]
    assert rows[5].r and not rows[7].r


def test_prefixes_are_distinct(spark):
    names = spark.createDataFrame([("http://a.org/onto#", 5), ("http://b.org/onto#", 4), ("http://c.org/onto2#", 9), ("http://xmlns.com/foaf/0.1/", 1), ("http://z.org/foaf#", 1)], "namespace string, n int")
    got = {r.namespace: r.prefix for r in t.allocate_prefixes(names, [F.desc("n"), F.col("namespace")]).collect()}
    assert len(set(got.values())) == 5 and got["http://xmlns.com/foaf/0.1/"] == "foaf" and got["http://z.org/foaf#"] == "foaf2" and got["http://a.org/onto#"] == "onto"


def test_prefixes_move_on(spark):
    """Numbered names that meet other stems, against the fold one namespace at a time."""
    rng = random.Random(7)
    rows = [(f"http://h{k}.org/{rng.choice(['onto', 'onto2', 'onto22', 'Onto3', 'x9', 'x', 'foaf'])}#", rng.randint(1, 9)) for k in range(60)] + [("http://xmlns.com/foaf/0.1/", 3)]
    got = {r.namespace: r.prefix for r in t.allocate_prefixes(spark.createDataFrame(rows, "namespace string, n int"), [F.desc("n"), F.col("namespace")]).collect()}
    want = {"http://xmlns.com/foaf/0.1/": "foaf"}
    for namespace, _ in sorted(rows[:-1], key=lambda r: (-r[1], r[0])):
        stem = namespace.rstrip("#").rsplit("/", 1)[-1].lower()
        want[namespace] = next(p for p in itertools.chain([stem], (f"{stem}{i}" for i in itertools.count(2))) if p not in set(want.values()))
    assert got == want


def test_merge_names_fold(spark):
    rows = [("u", 1, None, "d1", 7), ("u", 2, "T", None, None), ("u", 3, "S", "d3", 9)]
    got = registry.merge_names(spark.createDataFrame(rows, "url string, position int, title string, domain string, datasets long")).first()
    assert (got.title, got.domain, got.datasets) == ("T", "d1", 9)


def test_no_query_is_dropped(spark):
    asked = spark.range(10_050).select(F.format_string("q%05d", "id").alias("query"))
    terms = spark.createDataFrame([("http://v/#q10042x", "e"), ("http://v/#q00007x", "e")], "term string, endpoint string")
    got = profile.autocomplete(terms, asked).collect()
    assert sorted((r.query, r.place) for r in got) == [("q00007", 1), ("q10042", 1)]
    names = terms.select(F.col("term").alias("iri"), t.local_name(F.col("term")).alias("local"), F.lit("v").alias("prefix"))
    hits = search.search(names, asked).where("band = 'match'").collect()
    assert sorted((r.query, r.place) for r in hits) == [("q00007", 1), ("q10042", 1)]
    for plan in (search.search(names, asked), profile.autocomplete(terms, asked)):
        assert not re.search("NestedLoop|Cartesian", plan._jdf.queryExecution().executedPlan().toString())


def _fold_names(rows):
    """G5 by its rule: one entry after the other, in order of position."""
    (_, title, domain, datasets), *rest = rows
    for _, t2, d2, n2 in rest:
        if (title is None) != (t2 is None):
            datasets = n2 if title is None else datasets
        else:
            datasets = n2 if datasets is None else datasets
        title, domain = t2 if title is None else title, d2 if domain is None else domain
    return title, domain, datasets


def test_merge_names_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"u{k % 150}", k, *(rng.choice((None, None, f"{c}{k}")) for c in "TD"), rng.choice((None, None, k))) for k in range(750)]
    names = registry.merge_names(spark.createDataFrame(rows, "url string, position int, title string, domain string, datasets long"))
    want = {u: _fold_names([r[1:] for r in rows if r[0] == u]) for u in {r[0] for r in rows}}
    assert {r.url: (r.title, r.domain, r.datasets) for r in names.collect()} == want
    assert "collect_list" not in names._jdf.queryExecution().executedPlan().toString()


def test_merge_names_reads_every_event(spark, tmp_path):
    spark.range(390, 460).selectExpr("id AS event_id", "id % 35 AS user_id").union(spark.range(1000, 1006).selectExpr("id", "id")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.url: (r.title, r.domain, r.datasets) for r in quad_queries.q_merge_names(spark, str(tmp_path)).collect()}
    ids = {}
    for e, u in [(e, e % 35) for e in range(390, 460)] + [(e, e) for e in range(1000, 1006)]:
        ids.setdefault(f"urn:user:{u}", []).append((e, None if e % 5 else f"T{e}", f"D{e}" if e % 4 == 1 else None, e if e % 3 == 2 else None))
    assert got == {u: _fold_names(sorted(rows, key=lambda r: r[0])) for u, rows in ids.items()} and len(got) == 41


def test_overlap_and_sampling(spark):
    q = spark.createDataFrame([(f"s{k}", RDF_TYPE, "C", "iri", None, "g") for k in range(300)], "s string, p string, o string, o_kind string, o_datatype string, g string")
    asked = spark.createDataFrame([("C", "", 504), ("C", "0", None), ("C", "00", 503)], "class string, prefix string, status int")
    plan = profile.sampling_plan(profile.typed_subjects(q), asked)
    assert plan.first().sampling == "first-n" and profile.profile_classes(q, plan=plan).first().subjects == 200
    assert profile.dataset_counts(q).first().triples == 300


@pytest.mark.parametrize(
    ("start", "rungs"), [("", ["", "0", "00", None]), ("0", ["0", "00", None]), ("00", ["00", None]), ("abc", ["abc"]), (None, [None])]
)
def test_ladder_goes_down_from_its_start(start, rungs):
    assert profile.ladder(start) == rungs


def test_sampling_plan_retries_only_what_was_too_much(spark):
    asked = [
        ("whole", "", 200), ("sixteenth", "", 504), ("sixteenth", "0", 200), ("lost", "", None), ("lost", "0", None), ("lost", "00", 200), ("refused", "", 400), ("refused late", "", 500), ("refused late", "0", 404),
        ("spent", "", 504), ("spent", "0", 504), ("spent", "00", 504), ("spent", None, 599), ("untried", "", 502),
    ]
    classes = spark.createDataFrame([(c,) for c in {a[0] for a in asked} | {"new"}], "class string")
    attempts = spark.createDataFrame(asked, "class string, prefix string, status int")
    got = {r["class"]: (r.prefix, r.sampling) for r in profile.sampling_plan(classes, attempts).collect()}
    assert got == {
        "whole": ("", "exact"), "sixteenth": ("0", "hash-prefix"), "lost": ("00", "hash-prefix"), "refused": (None, None), "refused late": (None, None), "spent": (None, None), "untried": ("0", "hash-prefix"), "new": ("", "exact"),
    }
    late = {r["class"]: r.prefix for r in profile.sampling_plan(classes, attempts, "00").collect()}
    assert late["whole"] == late["lost"] == "00" and late["spent"] is None


def test_fingerprint_depends_on_order(spark):
    m = spark.createDataFrame([(1, "a"), (2, "b")], "position int, id string")
    other = m.withColumn("position", 3 - F.col("position"))
    a, b = (verdicts.definition_fingerprint(x, ["id"]).first()[0] for x in (m, other))
    assert a != b

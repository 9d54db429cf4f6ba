"""Queries over quads, registries, vocabularies, scoring and planning, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegauge.functions import text as t
from tidegauge.functions.rotation import rotation_bucket
from tidegauge.operators import facts, gates, planning, profile, readers, registry, rollup, search, verdicts
from tidegauge.plans.adapters import QUADS_SQL, READINGS_SQL, quads, readings
from tidegauge.schemas import NAMESPACE, PROV
from tidegauge.session import materialise, shared_dir, table
from tidegauge.sources import quads as nq
from tidegauge.sources import store

_TYPE = "rdf:type"


def _terms(spark, sf):
    """Part types and names as terms in the namespace of their brand."""
    p = table(spark, sf, "part")
    words = F.split(F.concat_ws(" ", "p_type", "p_name"), " ")
    rows = p.select(
        F.concat(F.lit("http://v.example/"), F.regexp_replace("p_brand", "#", "-"), F.lit("#"), F.lower(words[0]), F.initcap(words[1]), F.initcap(words[2])).alias("term"),
        F.when(F.col("p_size") % 2 == 0, "class").otherwise("property").alias("kind"), F.concat(F.lit("urn:e:"), F.col("p_partkey") % 20).alias("endpoint"),
        (F.col("p_partkey") % 3 == 0).alias("declared"),
    )
    return rows


_TERMS_SQL = """WITH terms AS (SELECT 'http://v.example/' || replace(p_brand, '#', '-') || '#' || lower(split_part(p_type || ' ' || p_name, ' ', 1)) || upper(split_part(p_type || ' ' || p_name, ' ', 2)[1]) || lower(split_part(p_type || ' ' || p_name, ' ', 2)[2:]) || upper(split_part(p_type || ' ' || p_name, ' ', 3)[1]) || lower(split_part(p_type || ' ' || p_name, ' ', 3)[2:]) AS term,
  CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'property' END AS kind, 'urn:e:' || (p_partkey % 20) AS endpoint, p_partkey % 3 = 0 AS declared FROM part),
vocab AS (SELECT term, kind, endpoint, bool_or(declared) AS declared, bool_or(NOT declared) AS observed FROM terms GROUP BY ALL),
vocabulary AS (SELECT *, CASE WHEN declared AND observed THEN 'verified' WHEN observed THEN 'undeclared-but-verified' ELSE 'declared-only' END AS state FROM vocab)"""


def _vocabulary(spark, sf):
    rows = _terms(spark, sf)
    return profile.vocabulary(rows.where("declared"), rows.where("not declared"))


def q_vocabulary(spark, sf):
    return _vocabulary(spark, sf)


def q_vocabulary_totals(spark, sf):
    return profile.vocabulary_totals(_vocabulary(spark, sf))


def q_namespace_totals(spark, sf):
    return profile.namespace_totals(_vocabulary(spark, sf))


def q_endpoint_vocabulary(spark, sf):
    return profile.endpoint_vocabulary(_vocabulary(spark, sf), "urn:e:7").select("term", "kind", "local", "state")


def q_filter_terms(spark, sf):
    return profile.filter_terms(_vocabulary(spark, sf), kind="class", endpoint="urn:e:3", state="declared-only")


def q_facet_counts(spark, sf):
    return profile.facet_counts(_vocabulary(spark, sf), kind="class", state="declared-only")


def _asked(spark, sf):
    """Queries from the data: the brands' materials, one misspelt by a swap."""
    p = table(spark, sf, "part").select(F.lower(F.split("p_name", " ")[1]).alias("m")).distinct()
    swapped = F.concat(F.substring("m", 1, 1), F.substring("m", 3, 1), F.substring("m", 2, 1), F.substring("m", 4, 20))
    return p.select(F.col("m").alias("query")).unionByName(p.select(swapped.alias("query"))).distinct()


_ASKED_SQL = """m AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS m FROM part), asked AS (SELECT m AS query FROM m UNION SELECT m[1] || m[3] || m[2] || m[4:] FROM m)"""


def q_autocomplete(spark, sf):
    return profile.autocomplete(_vocabulary(spark, sf), _asked(spark, sf))


def q_search(spark, sf):
    terms = _vocabulary(spark, sf).select(F.col("term").alias("iri")).distinct().withColumns({"local": t.local_name(F.col("iri")), "prefix": F.lit("v")})
    return search.search(terms, _asked(spark, sf))


def q_tokens(spark, sf):
    terms = _terms(spark, sf).select("term").distinct()
    return terms.select("term", t.namespace_of(F.col("term")).alias("namespace"), t.local_name(F.col("term")).alias("local"), F.array_join(t.tokens(t.local_name(F.col("term"))), " ").alias("tokens"))


def q_prefixes(spark, sf):
    names = _terms(spark, sf).groupBy(t.namespace_of(F.col("term")).alias("namespace")).agg(F.count("*").alias("n"))
    return t.allocate_prefixes(names, [F.desc("n"), F.col("namespace")])


def q_engine(spark, sf):
    pages = table(spark, sf, "pages")
    ns = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://Jena.apache.org/x#"), "page_id")).otherwise(F.col("url"))
    return pages.select("page_id", t.is_engine(ns).alias("engine"), t.is_engine(ns, subdomains=True).alias("engine_or_below"))


def q_percent(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", t.percent_encode(F.concat("c_name", F.lit(" é~*+/"), "c_mktsegment")).alias("encoded"))


def _dirty(spark, sf):
    """Page URLs in the many spellings of one endpoint."""
    p = table(spark, sf, "pages")
    path = F.regexp_extract("url", "^https?://[^/]*(/[^?]*)", 1)
    own = F.regexp_extract("url", "^https?://([^/]*)", 1)
    k = F.col("page_id") % 8
    url = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("https://user:pw@"), own, path)).when(k == 2, F.concat(F.lit("HTTP://WWW."), F.upper(own), F.lit(":80"), path, F.lit("/")))
        .when(k == 3, F.concat(F.lit("http://192.168.0."), F.col("page_id") % 200, path)).when(k == 4, F.concat(F.lit("https://"), F.col("page_id"), F.lit(".org:443"), path, F.lit("#frag")))
        .when(k == 5, F.concat(F.lit("http://svc.test"), path)).when(k == 6, F.concat(F.lit("https://data"), F.col("page_id") % 50, F.lit(".eu/a b"))).otherwise(F.concat(F.lit("https://data"), F.col("page_id") % 50, F.lit(".eu"), path))
    )
    return p.select("page_id", url.alias("url"))


_DIRTY_SQL = r"""WITH raw AS (SELECT page_id, url AS u, regexp_extract(url, '^https?://[^/]*(/[^?]*)', 1) AS path, regexp_extract(url, '^https?://([^/]*)', 1) AS own FROM pages),
dirty AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN u WHEN 1 THEN 'https://user:pw@' || own || path WHEN 2 THEN 'HTTP://WWW.' || upper(own) || ':80' || path || '/' WHEN 3 THEN 'http://192.168.0.' || (page_id % 200) || path
  WHEN 4 THEN 'https://' || page_id || '.org:443' || path || '#frag' WHEN 5 THEN 'http://svc.test' || path WHEN 6 THEN 'https://data' || (page_id % 50) || '.eu/a b' ELSE 'https://data' || (page_id % 50) || '.eu' || path END AS url FROM raw),
parts AS (SELECT *, lower(trim(url)) AS low, regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)', 1) AS auth FROM dirty),
hosts AS (SELECT *, CASE WHEN instr(auth, '@') > 0 THEN regexp_extract(auth, '@([^@]*)$', 1) ELSE auth END AS hp FROM parts),
keyed AS (SELECT *, regexp_replace(hp, ':[^:]*$', '') AS host, CASE WHEN low LIKE 'https://%' THEN regexp_replace(hp, ':443$', '') WHEN low LIKE 'http://%' THEN regexp_replace(hp, ':80$', '') ELSE hp END AS host_key FROM hosts)"""
_REFUSED_SQL = """judged AS (SELECT *, CASE WHEN instr(auth, '@') > 0 AND auth NOT LIKE '@%' THEN 'credentials' WHEN host = 'data7.eu' THEN 'excluded' WHEN host LIKE '192.168.%' OR host LIKE '%.test' THEN {unroutable}
  WHEN regexp_matches(host, '(^|\\.)(example|invalid)$') OR regexp_matches(host, '(^|\\.)example\\.(com|net|org)$') THEN 'reserved' WHEN instr(url, ' ') > 0 THEN 'unpublishable' END AS refused
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS k FROM keyed) WHERE k = 1)"""


def _judged(spark, sf, rules):
    rows = registry.dedupe(_dirty(spark, sf).withColumnRenamed("page_id", "position"))
    exclusions = rows.limit(1).select(F.lit("DATA7.eu").alias("host"))
    return rows, registry.refusals(rows, exclusions, rules)


def q_hosts(spark, sf):
    rows = _dirty(spark, sf)
    u = F.col("url")
    return rows.select("page_id", t.host_key(u).alias("host_key"), t.short_label(u).alias("label"), t.short_label(u, False).alias("label_no_port"), t.unroutable(u).alias("unroutable"), t.reserved_name(u).alias("reserved"))


def q_same_endpoint(spark, sf):
    return _dirty(spark, sf).groupBy(t.same_endpoint_key(F.col("url")).alias("endpoint")).agg(F.count("*").alias("n"))


def q_dedupe(spark, sf):
    return registry.dedupe(_dirty(spark, sf).withColumnRenamed("page_id", "position"))


def q_refusals(spark, sf):
    return registry.refusal_counts(_judged(spark, sf, registry.SEED_RULES)[1])


def q_load_refusals(spark, sf):
    return registry.refusal_counts(_judged(spark, sf, registry.LOAD_RULES)[1])


def q_balanced(spark, sf):
    rows, judged = _judged(spark, sf, registry.SEED_RULES)
    return registry.balanced(rows, judged)


def q_candidate_attributes(spark, sf):
    p = _dirty(spark, sf)
    rows = p.select(t.same_endpoint_key(F.col("url")).alias("url"), F.concat(F.lit("set"), F.col("page_id") % 11).alias("dataset"), F.concat(F.lit("Set "), F.col("page_id") % 11).alias("title"), F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("dom"), F.col("page_id") % 4)).alias("domain"), F.col("page_id").alias("position"))
    return registry.candidate_attributes(rows)


def q_host_groups(spark, sf):
    return registry.host_groups(_dirty(spark, sf).withColumn("cost_ms", F.col("page_id") % 100))


def q_merge_names(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(
        F.concat(F.lit("urn:user:"), "user_id").alias("url"), F.col("event_id").alias("position"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("T"), "event_id")).alias("title"),
        F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("D"), "event_id")).alias("domain"), F.when(F.col("event_id") % 3 == 2, F.col("event_id")).alias("datasets"),
    )
    return registry.merge_names(rows)


def q_dump_digests(spark, sf):
    """Pages as dump files; every third claim is wrong."""
    p = table(spark, sf, "pages").withColumn("path", F.concat(F.lit("dump"), "page_id"))
    files = p.select("path", F.coalesce("html", F.lit("")).alias("content"))
    claims = p.select("path", F.sha2(F.when(F.col("page_id") % 3 > 0, F.coalesce("html", F.lit(""))).otherwise(F.col("url")), 256).alias("sha256"))
    return registry.dump_digests(files, claims)


def q_last_namespace(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.namespace_at_last(F.col("url")).alias("namespace"))


def q_document_triples(spark, sf):
    """The triples of two documents, by predicate."""
    q = quads(spark, sf)
    graphs = q.where("g like '%:nation' or g like '%:supplier'").select(F.col("g").alias("graph"))
    return facts.document_triples(q, graphs).groupBy("g", "p").agg(F.count("*").alias("n"))


def q_aliases(spark, sf):
    r = readings(spark, sf)
    names = r.select("endpoint").distinct().where(F.col("endpoint").rlike("[05]$")).select(F.col("endpoint").alias("url"), F.concat(F.lit("urn:main:"), F.right("endpoint", F.lit(1))).alias("preferred"))
    return registry.resolve_aliases(r, names).groupBy("endpoint").agg(F.count("*").alias("n"))


def q_alive(spark, sf):
    r = readings(spark, sf)
    urls = r.select(F.col("endpoint").alias("url")).distinct()
    return registry.alive_candidates(urls, r, urls.where(F.col("url").rlike("[0-4]$")), "m2")


def q_display(spark, sf):
    p = _dirty(spark, sf)
    k = F.col("page_id")
    return p.select("page_id", t.display_name(F.when(k % 3 == 0, F.concat(F.lit("Title "), k)), F.when(k % 5 == 0, k % 2), F.col("url"), k % 7 != 0).alias("shown"))


def q_responses(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id") % 6
    retry = F.when(k == 0, F.lit("120")).when(k == 1, F.lit(" 7200 ")).when(k == 2, F.lit("Wed, 21 Oct 2026 07:28:00 GMT")).when(k == 3, F.lit("soon")).when(k == 4, F.lit("-5"))
    media = F.when(k == 0, F.lit("Text/Turtle; charset=utf-8")).when(k == 1, F.lit("text/html")).when(k == 2, F.lit("application/sparql-results+json")).when(k == 3, F.lit("application/problem+json")).otherwise(F.col("event_type"))
    return e.select("event_id", t.retry_after(retry, 3600).alias("retry"), t.body_kind(media).alias("body_kind"))


def q_profiles(spark, sf):
    return profile.profile_classes(quads(spark, sf), _TYPE)


def _sampled(q, *limits):
    """The sampling plan after asking an endpoint that gives up on classes over a rung's limit."""
    sizes = profile.typed_subjects(q, _TYPE).groupBy("class").agg(F.count("*").alias("n"))
    rungs = F.array(*[F.struct(F.lit(prefix).cast("string").alias("prefix"), F.lit(limit).alias("limit")) for prefix, limit in zip(profile.ladder(), [*limits, None], strict=True)])
    asked = sizes.select("class", "n", F.explode(rungs).alias("r")).select("class", "r.prefix", F.when(F.col("n") > F.col("r.limit"), 504).otherwise(200).alias("status"))
    return profile.sampling_plan(sizes, asked)


def q_profiles_sampled(spark, sf):
    q = quads(spark, sf)
    return profile.profile_classes(q, _TYPE, _sampled(q, 50, 1000, 0)).select("class", "property", "subjects")


def q_denominators(spark, sf):
    return profile.denominators(profile.profile_classes(quads(spark, sf), _TYPE), _TYPE)


def q_dataset_counts(spark, sf):
    q = quads(spark, sf)
    both = q.unionByName(q.where("s like '%1'").withColumn("g", F.lit(None).cast("string")))
    return profile.dataset_counts(both, _TYPE)


def q_reprofile(spark, sf):
    c = table(spark, sf, "customer")
    k, n = F.col("c_custkey"), F.floor(F.col("c_acctbal")).cast("long")
    state = c.select(
        "c_custkey", F.when(k % 11 > 0, F.abs(n)).alias("last_triples"), F.when(k % 13 > 0, k % 5).alias("last_classes"), F.date_sub(F.lit("2024-03-01").cast("date"), (k % 60).cast("int")).alias("last_profiled_at"),
        F.when(k % 7 > 0, F.abs(n) + k % 40).alias("triples"), F.when(k % 17 > 0, k % 5).alias("classes"),
    )
    return profile.worth_reprofiling(state, F.lit("2024-03-01").cast("date")).select("c_custkey", "worth")


def q_void(spark, sf):
    q = quads(spark, sf)
    p = profile.profile_classes(q, _TYPE)
    plan = _sampled(q, 500, 10**9, 10**9)
    d = profile.void_description(p, plan, "urn:d", "urn:v:")
    return d.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("nodes"))


def q_complete(spark, sf):
    q = quads(spark, sf)
    plan = _sampled(q, 500, 10**9, 10**9)
    rows = plan.select(F.when(F.col("class").rlike("nation|supplier"), "urn:e:small").otherwise("urn:e:large").alias("endpoint"), "sampling", F.lit(2).alias("reported"))
    return profile.provably_complete(rows)


def q_partitions(spark, sf):
    rows = profile.partition_table(profile.profile_classes(quads(spark, sf), _TYPE))
    return rows.select("class", "properties", F.array_join(F.transform("rows", lambda r: F.concat_ws("=", r["property"], r["subjects"].cast("string"))), ",").alias("rows"))


def q_statistics(spark, sf):
    """The quads, a current graph of every seventh customer, and the instants of the hours with events."""
    q = quads(spark, sf).select("s", "p", "o", "g")
    now = q.where("s like 'urn:customer:%7'").withColumn("g", F.lit(f"{NAMESPACE}current"))
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    runs = table(spark, sf, "events").select(F.concat(F.lit(f"{NAMESPACE}activity:"), hour).alias("s"), F.lit(f"{PROV}generatedAtTime").alias("p"), hour.alias("o"), F.concat(F.lit("urn:run:"), hour).alias("g")).distinct()
    return rollup.archive_statistics(q.unionByName(now).unionByName(runs), _TYPE)


def q_facts(spark, sf):
    """Readings written as quads and read back as facts."""
    r = readings(spark, sf)
    back = facts.measurements(nq.to_nquads(r)).unionByName(facts.declines(nq.to_nquads(r)), allowMissingColumns=True)
    return back.select("run", "endpoint", "metric", "kind", "verdict", "reason", "elapsed_ms", "observed_count")


def q_nquads(spark, sf):
    """Every reading as lines, parsed again, counted by predicate."""
    lines = nq.to_lines(nq.to_nquads(readings(spark, sf))).select(F.lit("f").alias("src_file"), F.lit(1).cast("long").alias("line_no"), "value")
    parsed = nq.parse_lines(lines)
    return parsed.groupBy("p", "o_kind").agg(F.count("*").alias("n"), F.count_distinct("g").alias("graphs"), F.count("bad").alias("bad"))


def q_star(spark, sf):
    rows = facts.star(quads(spark, sf), {"name": "urn:p:c_name", "segment": "urn:p:c_mktsegment", "balance": "urn:p:c_acctbal"})
    return rows.where("name is not null")


def q_governed(spark, sf):
    g = gates.governed(nq.to_nquads(readings(spark, sf)))
    return g.groupBy("g").agg(F.count("*").alias("endpoints"))


def q_shapes(spark, sf):
    rows = _dirty(spark, sf).withColumns({"at": F.when(F.col("page_id") % 9 == 0, "2024-13-01T00:00:00Z").otherwise("2024-01-01T00:00:00Z"), "metric": F.when(F.col("page_id") % 10 == 0, "Bad_Id").otherwise("good-id")})
    return gates.shape_faults(rows, "at", "url", "metric").select("page_id", "fault")


def q_registry_conflicts(spark, sf):
    o = table(spark, sf, "orders")
    claims = o.select(F.concat(F.lit("urn:"), "o_custkey").alias("url"), F.col("o_orderstatus").alias("role"), F.lit("x").alias("owner"))
    return gates.registry_conflicts(claims)


def q_outcome_faults(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("urn:"), "o_custkey").alias("url"))
    return gates.outcome_faults(o, table(spark, sf, "customer").where("c_custkey % 4 > 0").select(F.concat(F.lit("urn:"), "c_custkey").alias("url")))


def q_drifted(spark, sf):
    r = readings(spark, sf)
    pointers = r.groupBy("endpoint").agg(F.max_by("run", "run_at").alias("run"))
    moved = pointers.withColumn("run", F.when(F.col("endpoint").endswith("3"), "urn:run:none").otherwise(F.col("run")))
    a = gates.drifted(moved, r).withColumn("fault", F.lit("drifted"))
    return a.unionByName(gates.dangling(moved, r.select("run").distinct()).select("endpoint", "run", F.lit("dangling").alias("fault")))


def _observations(spark, sf):
    """Lineitem rows as probe outcomes over eight kinds."""
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    kinds = F.array(*[F.lit(x) for x in ("ask-data", "fetch-void", "cors", "cors-preflight", "liveness", "counted", "select-iris", "dereference-endpoint")])
    return li.select(
        "l_orderkey", "l_linenumber", F.element_at(kinds, (k % 8 + 1).cast("int")).alias("kind"), F.element_at(F.array(*[F.lit(x) for x in (200, 404, 405, 302, 500)]), (F.col("l_partkey") % 5 + 1).cast("int")).alias("status"),
        F.when(F.col("l_suppkey") % 17 == 0, "timeout").alias("error"), F.element_at(F.array(*[F.lit(x) for x in ("sparql-json", "rdf", "html", "other")]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("body_kind"),
        F.when(k % 3 > 0, k % 3 == 1).alias("boolean"), F.when(k % 5 == 0, True).alias("expect"), F.when(k % 4 > 0, F.array(F.col("l_quantity").cast("int").cast("string"))).alias("bindings"),
        (k % 2 == 0).alias("cors"), F.when(k % 3 == 0, "*").otherwise("https://elsewhere").alias("allow_origin"), F.when(k % 7 == 0, "POST, get").when(k % 7 == 1, "").alias("allow_methods"),
        F.when(k % 2 == 0, "urn:f").alias("declared_by"), (k % 6 == 0).alias("claimed"), F.when(k % 4 < 2, F.lit(25).cast("long")).alias("stated"), F.when(k % 3 == 0, 0.1).alias("tolerance"), F.lit(False).alias("expired"),
    )


_OBS_SQL = """WITH o AS (SELECT l_orderkey, l_linenumber, ['ask-data', 'fetch-void', 'cors', 'cors-preflight', 'liveness', 'counted', 'select-iris', 'dereference-endpoint'][(l_orderkey + l_linenumber) % 8 + 1] AS kind, [200, 404, 405, 302, 500][l_partkey % 5 + 1] AS status,
  l_suppkey % 17 = 0 AS failed, ['sparql-json', 'rdf', 'html', 'other'][l_suppkey % 4 + 1] AS body, CASE (l_orderkey + l_linenumber) % 3 WHEN 1 THEN true WHEN 2 THEN false END AS got, (l_orderkey + l_linenumber) % 5 = 0 AS expect,
  CASE WHEN (l_orderkey + l_linenumber) % 4 > 0 THEN CAST(floor(l_quantity) AS BIGINT) END AS n, l_orderkey + l_linenumber AS k FROM lineitem),
c AS (SELECT *, status = 200 AS ok, k % 6 = 0 AS claimed, CASE WHEN k % 2 = 1 OR k % 6 = 0 THEN 'verified' ELSE 'undeclared-but-verified' END AS yes, CASE WHEN k % 4 < 2 THEN 25 END AS stated FROM o),
v AS (SELECT *, CASE WHEN body = 'sparql-json' AND ok THEN n END AS cnt FROM c)
"""
_RESOLVE_SQL = """SELECT kind, CASE WHEN kind = 'fetch-void' AND NOT failed AND status = 404 THEN 'absent' WHEN failed OR body = 'html' THEN 'indeterminate'
  WHEN kind = 'ask-data' THEN CASE WHEN got IS NULL THEN CASE WHEN claimed THEN 'declared-only' ELSE 'indeterminate' END WHEN NOT ok THEN 'indeterminate' WHEN got THEN yes WHEN expect AND claimed THEN 'declared-but-wrong' ELSE 'absent' END
  WHEN kind = 'fetch-void' THEN CASE WHEN NOT ok THEN 'indeterminate' WHEN body = 'rdf' THEN 'undeclared-but-verified' ELSE 'declared-but-wrong' END
  WHEN kind = 'cors' THEN CASE WHEN k % 2 = 0 THEN yes WHEN ok THEN 'absent' ELSE 'indeterminate' END
  WHEN kind = 'cors-preflight' THEN CASE WHEN status = 405 THEN 'absent' WHEN NOT ok THEN 'indeterminate' WHEN k % 3 = 0 AND k % 7 <> 1 THEN yes ELSE 'absent' END
  WHEN kind = 'liveness' THEN CASE WHEN NOT ok THEN 'indeterminate' WHEN body = 'sparql-json' THEN yes ELSE 'absent' END
  WHEN kind = 'counted' THEN CASE WHEN stated IS NOT NULL AND cnt IS NOT NULL THEN CASE WHEN cnt = stated OR (k % 3 = 0 AND abs(cnt - stated) / stated <= 0.1) THEN 'verified' ELSE 'declared-but-wrong' END WHEN stated IS NOT NULL THEN 'declared-only' WHEN cnt = 0 THEN 'absent' WHEN cnt IS NOT NULL THEN yes ELSE 'indeterminate' END
  WHEN kind = 'select-iris' THEN CASE WHEN n IS NOT NULL AND ok THEN yes WHEN n IS NULL AND body = 'sparql-json' AND ok THEN 'absent' ELSE 'indeterminate' END
  ELSE CASE WHEN body = 'rdf' AND ok THEN 'verified' WHEN status = 404 THEN 'absent' ELSE 'indeterminate' END END AS verdict, count(*) AS n FROM v GROUP BY 1, 2"""


def q_resolve(spark, sf):
    return _observations(spark, sf).select("kind", verdicts.resolve().alias("verdict")).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


def q_tolerance(spark, sf):
    p = table(spark, sf, "part")
    stated, found = (F.col("p_partkey") % 100).cast("long"), (F.col("p_size") * 2).cast("long")
    return p.select("p_partkey", verdicts.within_tolerance(stated, found, F.when(F.col("p_partkey") % 2 == 0, 0.25)).alias("within"))


def q_grade(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    rows = p.select("p_partkey", (k % 7).alias("triples"), (k % 5 == 0).alias("has_entailment"), (k % 11 == 0).alias("has_functions"), (k % 13 == 0).alias("has_examples"), (k % 3 == 0).alias("has_partitions"), (k % 2 == 0).alias("names_dataset"))
    return rows.withColumn("level", verdicts.grade()).groupBy("level").agg(F.count("*").alias("n"))


def q_admit(spark, sf):
    p = table(spark, sf, "part")
    costs, cadences = F.array(*[F.lit(c) for c in verdicts.COSTS]), F.array(*[F.lit(c) for c in verdicts.CADENCES])
    m = p.select(F.col("p_partkey").alias("metric"), F.element_at(costs, F.col("p_size") % 3 + 1).alias("cost"), F.element_at(cadences, (F.col("p_partkey") % 2 + 1).cast("int")).alias("cadence"))
    return verdicts.admit(m, "expensive", "hourly").groupBy("reason").agg(F.count("*").alias("n"))


def q_fill(spark, sf):
    r = readings(spark, sf)
    pairs = r.select("endpoint").distinct().join(F.broadcast(r.select("metric").distinct()), F.lit(True))
    return verdicts.fill_budget(pairs, r)


def q_gate(spark, sf):
    r = readings(spark, sf)
    o = r.groupBy("endpoint").agg(F.max_by(F.struct("metric", "elapsed_ms"), F.struct("run_at", "metric")).alias("x")).select("endpoint", F.lit("m0").alias("metric"), F.when(F.col("x.elapsed_ms") % 3 > 0, 200).alias("status"), F.when(F.col("endpoint").endswith("9"), "prober-failed").alias("error"), F.lit(False).alias("expired"))
    metrics = r.select("metric").distinct()
    return verdicts.liveness_gate(o, metrics, "m0").groupBy("metric", "reason").agg(F.count("*").alias("n"))


def q_severity(spark, sf):
    from tidegauge.schemas import severity

    r = readings(spark, sf)
    return r.groupBy("endpoint").agg(F.max(severity(F.col("verdict"))).alias("worst"), F.min(severity(F.col("verdict"))).alias("best"))


def q_decisive(spark, sf):
    v = _vocabulary(spark, sf)
    state = verdicts.decisive_term_state(F.col("declared"), F.col("observed"), F.col("endpoint").rlike("[02468]$"), F.col("endpoint").rlike("[0-4]$"))
    return v.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def _outcomes(spark, sf):
    r = readings(spark, sf).where("kind = 'measured'")
    o = rollup.sweep_outcomes(r, r, "m0")
    runs = r.select("run", "run_at").distinct()
    return o.join(runs, "run").select(F.col("endpoint").alias("url"), F.col("run_at").alias("at"), "cost_ms", "positive", "liveness_failed")


def q_replay(spark, sf):
    s = planning.replay(_outcomes(spark, sf), planning.Thresholds(strikes=2, cost_ms=20_000))
    return s.select("url", "strikes", F.date_format("last_probed", "yyyy-MM-dd HH:mm:ss").alias("last_probed"))


def q_plan(spark, sf):
    """Customers as endpoints: every third dormant, some held."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    day = lambda n: F.to_timestamp(F.date_sub(F.lit("2024-03-01").cast("date"), n.cast("int")))
    none = F.lit(None).cast("timestamp")
    hold = F.when(k % 10 == 1, F.struct(F.lit("dormant").alias("state"), F.lit("x").alias("reason"), none.alias("until"))).when(k % 10 == 2, F.struct(F.lit("awake").alias("state"), F.lit("y").alias("reason"), day(k % 20 - 10).alias("until")))
    state = c.where("c_custkey % 7 > 0").select(F.concat(F.lit("urn:"), k).alias("url"), F.when(k % 3 == 0, day(k % 50)).alias("dormant_since"), F.when(k % 5 > 0, day(k % 15)).alias("last_probed"), hold.alias("hold"))
    urls = c.select(F.concat(F.lit("urn:"), k).alias("url"))
    p = planning.plan(state, urls, F.lit("2024-03-01 12:00:00").cast("timestamp"), last_sweep=F.lit("2024-02-28").cast("date"))
    return p.groupBy("action", "reason").agg(F.count("*").alias("n"))


def q_rotation(spark, sf):
    r = readings(spark, sf).select("endpoint").distinct()
    return r.select("endpoint", rotation_bucket(F.col("endpoint"), 7).alias("bucket"))


def q_rotation_split(spark, sf):
    """What waits for its endpoint's day on 2024-03-01, over a week; odd metrics are exhaustive."""
    r = readings(spark, sf)
    metrics = r.select("metric").distinct().withColumn("cost", F.when(F.substring("metric", -1, 1).isin("1", "3"), "exhaustive").otherwise("cheap"))
    return planning.rotation_split(r.select(F.col("endpoint").alias("url")), metrics, F.lit("2024-03-01").cast("date"), 7)


def q_gzip(spark, sf):
    """The lines of all readings written as packed and as plain files, read back by one reader, line by line."""
    path = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    lines = nq.to_lines(nq.to_nquads(materialise(readings(spark, sf), "readings")))
    packed = F.contains("value", F.lit("measurement:"))
    lines.where(packed).write.option("compression", "gzip").text(path)
    lines.where(~packed).write.mode("append").text(path)
    back = nq.read_quads(spark, path)
    return back.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("g").alias("graphs"), F.count("bad").alias("bad"))


def q_registry_dump(spark, sf):
    """A dump document built from the pages, exploded again."""
    p = table(spark, sf, "pages")
    service = F.struct(F.col("url").alias("access_url"), F.lit("OK").alias("status"), F.lit("s").alias("title"))
    sets = p.groupBy(F.concat(F.lit("set"), F.col("page_id") % 50).alias("dataset")).agg(F.array_sort(F.collect_list(service)).alias("sparql"))
    line = F.to_json(F.create_map("dataset", F.struct(F.concat(F.lit("T "), "dataset").alias("title"), F.lit("d").alias("domain"), "sparql")))
    return store.registry_candidates(sets.select(line.alias("value"))).select("dataset", "url", "title", "position")


def q_bounded(spark, sf):
    rows, cut = readers.bounded(quads(spark, sf), 1000)
    return rows.agg(F.count("*").alias("n")).withColumn("truncated", F.lit(cut))


_PROFILE_SQL = f"""{QUADS_SQL}, typed AS (SELECT DISTINCT s, o AS class FROM quads WHERE p = 'rdf:type'),
prof AS (SELECT class, p AS property, count(DISTINCT q.s) AS subjects, count(DISTINCT CASE WHEN o_kind = 'literal' THEN o_datatype ELSE 'IRI' END) AS datatypes, min(CASE WHEN o_kind = 'literal' THEN o_datatype ELSE 'IRI' END) AS any_datatype FROM quads q JOIN typed USING (s) GROUP BY 1, 2)"""
_SCORE_SQL = f"""{_TERMS_SQL}, {_ASKED_SQL}, t AS (SELECT DISTINCT term AS iri, split_part(term, '#', 2) AS local FROM vocabulary),
w AS (SELECT *, list_transform(regexp_split_to_array(regexp_replace(local, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '_'), lambda x: lower(x)) AS words, lower(local || ' v ' || iri) AS hay FROM t),
s AS (SELECT query, iri, local, CASE WHEN list_contains(words, query) THEN 4 WHEN len(list_filter(words, lambda x: starts_with(x, query))) > 0 THEN 3 WHEN instr(hay, query) > 0 THEN 2 WHEN len(query) >= 4 AND len(list_filter(words, lambda x: damerau_levenshtein(x, query) <= 1)) > 0 THEN 1 ELSE 0 END AS score FROM w, asked)
SELECT query, iri, local, CASE WHEN score >= 2 THEN 'match' ELSE 'close' END AS band, score, row_number() OVER (PARTITION BY query ORDER BY score < 2, score DESC, len(local), local, iri) AS place FROM s WHERE score > 0"""


QUERIES = {
    "p11_vocabulary": (q_vocabulary, f"{_TERMS_SQL} SELECT * FROM vocabulary"),
    "p11_endpoint_totals": (q_vocabulary_totals, f"{_TERMS_SQL} SELECT endpoint, count(*) FILTER (WHERE observed) AS used, count(*) FILTER (WHERE declared) AS declared, count(*) AS terms FROM vocabulary GROUP BY 1"),
    "p11_namespace_totals": (q_namespace_totals, f"{_TERMS_SQL} SELECT split_part(term, '#', 1) || '#' AS namespace, count(DISTINCT term) AS terms, count(DISTINCT endpoint) AS endpoints FROM vocabulary GROUP BY 1"),
    "p12_endpoint_vocabulary": (q_endpoint_vocabulary, f"{_TERMS_SQL} SELECT term, kind, split_part(term, '#', 2) AS local, state FROM vocabulary WHERE endpoint = 'urn:e:7'"),
    "p14_filter_terms": (q_filter_terms, f"{_TERMS_SQL} SELECT DISTINCT term, kind FROM vocabulary WHERE kind = 'class' AND endpoint = 'urn:e:3' AND state = 'declared-only'"),
    "p15_facet_counts": (
        q_facet_counts,
        f"""{_TERMS_SQL} SELECT 'kind' AS facet, kind AS value, count(DISTINCT term) AS terms FROM vocabulary WHERE state = 'declared-only' GROUP BY 2
UNION ALL SELECT 'namespace', split_part(term, '#', 1) || '#', count(DISTINCT term) FROM vocabulary WHERE state = 'declared-only' AND kind = 'class' GROUP BY 2
UNION ALL SELECT 'endpoint', endpoint, count(DISTINCT term) FROM vocabulary WHERE state = 'declared-only' AND kind = 'class' GROUP BY 2 UNION ALL SELECT 'state', state, count(DISTINCT term) FROM vocabulary WHERE kind = 'class' GROUP BY 2""",
    ),
    "p16_autocomplete": (
        q_autocomplete,
        f"""{_TERMS_SQL}, {_ASKED_SQL}, t AS (SELECT term, count(DISTINCT endpoint) AS endpoints, lower(split_part(term, '#', 2)) AS local FROM vocabulary GROUP BY 1),
b AS (SELECT query, term, endpoints, CASE WHEN starts_with(local, query) THEN 0 WHEN instr(local, query) > 0 THEN 1 ELSE 2 END AS bucket FROM t, asked WHERE instr(lower(term), query) > 0)
SELECT * FROM (SELECT query, term, bucket, endpoints, row_number() OVER (PARTITION BY query ORDER BY bucket, endpoints DESC, len(term), term) AS place FROM b) WHERE place <= 8""",
    ),
    "t6_search": (q_search, _SCORE_SQL),
    "t2_t3_tokens": (
        q_tokens,
        f"{_TERMS_SQL} SELECT DISTINCT term, split_part(term, '#', 1) || '#' AS namespace, split_part(term, '#', 2) AS local, lower(regexp_replace(split_part(term, '#', 2), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS tokens FROM terms",
    ),
    "t7_prefixes": (
        q_prefixes,
        f"""{_TERMS_SQL}, n AS (SELECT split_part(term, '#', 1) || '#' AS namespace FROM terms GROUP BY 1) SELECT namespace, lower(regexp_extract(namespace, '/([^/#]+)#$', 1)) AS prefix FROM n""",
    ),
    "t8_engine": (q_engine, "SELECT page_id, page_id % 5 = 0 AS engine, page_id % 5 = 0 AS engine_or_below FROM pages"),
    "t1_percent_encode": (q_percent, "SELECT c_custkey, url_encode(c_name || ' é~*+/' || c_mktsegment) AS encoded FROM customer"),
    "t9_t13_hosts": (
        q_hosts,
        f"""{_DIRTY_SQL} SELECT page_id, host_key, regexp_replace(hp, '^www\\.', '') AS label, regexp_replace(host, '^www\\.', '') AS label_no_port,
CASE WHEN host LIKE '192.168.%' THEN 'private' WHEN host LIKE '%.test' THEN 'reserved for local use' END AS unroutable, CASE WHEN regexp_matches(host, '(^|\\.)(example|invalid)$') THEN 'reserved top-level domain' WHEN regexp_matches(host, '(^|\\.)example\\.(com|net|org)$') THEN 'reserved second-level domain' END AS reserved FROM keyed""",
    ),
    "t12_same_endpoint": (
        q_same_endpoint,
        f"""{_DIRTY_SQL}, b AS (SELECT regexp_replace(regexp_replace(trim(url), '^https?://', ''), '#.*$', '') AS b FROM dirty), s AS (SELECT regexp_extract(b, '^([^/]*)', 1) AS a, b FROM b)
SELECT regexp_replace(regexp_replace(lower(regexp_extract(a, '([^@]*)$', 1)), '(:443|:80)$', ''), '^www\\.', '') || regexp_replace(substr(b, len(a) + 1), '/+$', '') AS endpoint, count(*) AS n FROM s GROUP BY 1""",
    ),
    "g1_dedupe": (q_dedupe, f"{_DIRTY_SQL} SELECT min(page_id) AS position, url FROM dirty GROUP BY url"),
    "g2_refusals": (q_refusals, f"{_DIRTY_SQL}, {_REFUSED_SQL.format(unroutable=repr('unroutable'))} SELECT coalesce(refused, 'kept') AS rule, count(*) AS n FROM judged GROUP BY 1"),
    "g3_load_refusals": (q_load_refusals, f"{_DIRTY_SQL}, {_REFUSED_SQL.format(unroutable='NULL')} SELECT coalesce(refused, 'kept') AS rule, count(*) AS n FROM judged GROUP BY 1"),
    "g10_balanced": (q_balanced, f"{_DIRTY_SQL}, {_REFUSED_SQL.format(unroutable=repr('unroutable'))} SELECT count(DISTINCT url) AS \"distinct\", count(refused) AS refused, count(*) - count(refused) AS kept, true AS balanced FROM judged"),
    "g4_candidate_attributes": (
        q_candidate_attributes,
        f"""{_DIRTY_SQL}, b AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '^https?://', ''), '#.*$', '') AS b FROM dirty), s AS (SELECT page_id, regexp_extract(b, '^([^/]*)', 1) AS a, b FROM b),
e AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(a, '([^@]*)$', 1)), '(:443|:80)$', ''), '^www\\.', '') || regexp_replace(substr(b, len(a) + 1), '/+$', '') AS url FROM s)
SELECT url, CASE WHEN count(DISTINCT page_id % 11) = 1 THEN 'Set ' || arg_min(page_id % 11, page_id) END AS title, CASE WHEN count(DISTINCT page_id % 11) > 1 THEN count(DISTINCT page_id % 11) END AS datasets, 'dom' || (min(page_id) FILTER (WHERE page_id % 3 > 0) % 4) AS domain FROM e GROUP BY 1""",
    ),
    "g9_host_groups": (q_host_groups, f"{_DIRTY_SQL} SELECT CASE WHEN host_key = '' THEN low ELSE host_key END AS host, count(DISTINCT url) AS endpoints, CAST(sum(page_id % 100) AS BIGINT) AS serial_ms FROM keyed GROUP BY 1"),
    "g5_merge_names": (
        q_merge_names,
        """WITH e AS (SELECT 'urn:user:' || user_id AS url, list(struct_pack(title := CASE WHEN event_id % 5 = 0 THEN 'T' || event_id END, domain := CASE WHEN event_id % 4 = 1 THEN 'D' || event_id END, datasets := CASE WHEN event_id % 3 = 2 THEN event_id END) ORDER BY event_id) AS entries FROM events GROUP BY 1),
f AS (SELECT url, list_reduce(entries, lambda a, b: struct_pack(title := coalesce(a.title, b.title), domain := coalesce(a.domain, b.domain), datasets := CASE WHEN a.title IS NULL AND b.title IS NOT NULL THEN b.datasets WHEN a.title IS NOT NULL AND b.title IS NULL THEN a.datasets ELSE coalesce(a.datasets, b.datasets) END)) AS m FROM e)
SELECT url, m.title AS title, m.domain AS domain, m.datasets AS datasets FROM f""",
    ),
    "g10_dump_digests": (q_dump_digests, "SELECT 'dump' || page_id AS path, CASE WHEN page_id % 3 > 0 THEN sha256(coalesce(html, '')) ELSE sha256(url) END AS sha256, sha256(coalesce(html, '')) AS found FROM pages WHERE page_id % 3 = 0 AND coalesce(html, '') <> url"),
    "t2_last_namespace": (q_last_namespace, "SELECT page_id, regexp_extract(url, '^(.*[#/])?', 0) AS namespace FROM pages"),
    "f10_document_triples": (q_document_triples, f"{QUADS_SQL} SELECT g, p, count(*) AS n FROM quads WHERE g IN ('urn:g:nation', 'urn:g:supplier') GROUP BY 1, 2"),
    "g6_aliases": (q_aliases, f"{READINGS_SQL} SELECT CASE WHEN regexp_matches(endpoint, '[05]$') THEN 'urn:main:' || right(endpoint, 1) ELSE endpoint END AS endpoint, count(*) AS n FROM readings GROUP BY 1"),
    "g8_alive": (q_alive, f"{READINGS_SQL} SELECT DISTINCT endpoint AS url FROM readings WHERE metric = 'm2' AND verdict IN ('verified', 'undeclared-but-verified') AND regexp_matches(endpoint, '[5-9]$')"),
    "t20_display_name": (
        q_display,
        f"{_DIRTY_SQL} SELECT page_id, CASE WHEN page_id % 7 = 0 THEN url WHEN page_id % 5 = 0 AND page_id % 2 > 0 THEN host WHEN page_id % 3 = 0 THEN 'Title ' || page_id ELSE host END AS shown FROM keyed",
    ),
    "t14_responses": (
        q_responses,
        "SELECT event_id, ['wait', 'too-long', 'http-date', 'junk', 'junk', NULL][event_id % 6 + 1] AS retry, ['rdf', 'html', 'sparql-json', 'json', 'other', 'other'][event_id % 6 + 1] AS body_kind FROM events",
    ),
    "p1_profiles": (q_profiles, f"{_PROFILE_SQL} SELECT * FROM prof"),
    "p2_p3_sampled_profiles": (
        q_profiles_sampled,
        f"""{_PROFILE_SQL}, sizes AS (SELECT class, count(*) AS n FROM typed GROUP BY 1), kept AS (SELECT s, class FROM (SELECT s, class, n, row_number() OVER (PARTITION BY class ORDER BY s) AS k FROM typed JOIN sizes USING (class))
  WHERE n <= 50 OR (n <= 1000 AND starts_with(sha256(s), '0')) OR (n > 1000 AND k <= 200))
SELECT class, p AS property, count(DISTINCT q.s) AS subjects FROM quads q JOIN kept USING (s) GROUP BY 1, 2""",
    ),
    "p4_denominators": (q_denominators, f"{_PROFILE_SQL} SELECT class, max(subjects) FILTER (WHERE property = 'rdf:type') AS denominator FROM prof GROUP BY 1"),
    "p6_dataset_counts": (q_dataset_counts, f"{QUADS_SQL} SELECT count(*) AS triples, count(DISTINCT g) AS graphs, count(DISTINCT o) FILTER (WHERE p = 'rdf:type') AS classes, count(DISTINCT s) FILTER (WHERE p = 'rdf:type') AS entities, true AS overlap FROM quads"),
    "p5_reprofile": (
        q_reprofile,
        """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN true WHEN c_custkey % 7 = 0 OR c_custkey % 17 = 0 THEN c_custkey % 60 > 30
ELSE CASE WHEN abs(floor(c_acctbal)) = 0 THEN c_custkey % 40 <> 0 ELSE (c_custkey % 40)::DOUBLE / abs(floor(c_acctbal)) > 0.01 END OR c_custkey % 60 > 30 END AS worth FROM customer""",
    ),
    "p8_void": (
        q_void,
        f"""{_PROFILE_SQL} SELECT 'http://rdfs.org/ns/void#classPartition' AS p, count(DISTINCT class) AS n, 1 AS nodes FROM prof
UNION ALL SELECT 'http://rdfs.org/ns/void#class', count(DISTINCT class), count(DISTINCT class) FROM prof UNION ALL SELECT CASE WHEN n <= 500 THEN 'http://rdfs.org/ns/void#entities' ELSE 'urn:v:sampledEntities' END, count(*), count(*) FROM (SELECT class, count(*) AS n FROM typed GROUP BY 1) GROUP BY 1
UNION ALL SELECT 'http://rdfs.org/ns/void#propertyPartition', count(*), count(DISTINCT class) FROM prof UNION ALL SELECT 'http://rdfs.org/ns/void#property', count(*), count(*) FROM prof UNION ALL SELECT 'urn:v:subjects', count(*), count(*) FROM prof""",
    ),
    "p9_complete": (
        q_complete,
        f"""{_PROFILE_SQL}, n AS (SELECT class, count(*) AS n FROM typed GROUP BY 1), e AS (SELECT CASE WHEN regexp_matches(class, 'nation|supplier') THEN 'urn:e:small' ELSE 'urn:e:large' END AS endpoint, n <= 500 AS ex FROM n)
SELECT endpoint, count(*) AS described, 2 AS reported, bool_and(ex) AS exact, count(*) = 2 AND bool_and(ex) AS complete FROM e GROUP BY 1""",
    ),
    "p10_partitions": (q_partitions, f"{_PROFILE_SQL} SELECT class, count(*) AS properties, string_agg(property || '=' || subjects, ',' ORDER BY property) AS rows FROM prof GROUP BY 1"),
    "a17_statistics": (q_statistics, f"""{QUADS_SQL}, h AS (SELECT DISTINCT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS h FROM events),
a AS (SELECT s, p, o, g FROM quads UNION ALL SELECT s, p, o, 'urn:obs:current' FROM quads WHERE s LIKE 'urn:customer:%7' UNION ALL SELECT 'urn:obs:activity:' || h, 'http://www.w3.org/ns/prov#generatedAtTime', h, 'urn:run:' || h FROM h)
SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, count(DISTINCT o) FILTER (WHERE p = 'rdf:type') AS classes, count(DISTINCT g) AS graphs, count(*) FILTER (WHERE g = 'urn:obs:current') AS current, max(o) FILTER (WHERE p LIKE '%generatedAtTime') AS newest FROM a"""),
    "f2_f4_facts": (q_facts, f"{READINGS_SQL} SELECT run, endpoint, metric, kind, verdict, reason, elapsed_ms, observed_count FROM readings"),
    "s1_s6_nquads": (
        q_nquads,
        f"""{READINGS_SQL}, m AS (SELECT * FROM readings WHERE kind = 'measured'), d AS (SELECT * FROM readings WHERE kind = 'declined')
SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'iri' AS o_kind, count(*) AS n, count(DISTINCT run) AS graphs, 0 AS bad FROM readings UNION ALL SELECT 'http://www.w3.org/ns/prov#wasGeneratedBy', 'iri', count(*), count(DISTINCT run), 0 FROM readings
UNION ALL SELECT 'http://www.w3.org/ns/dqv#' || unnest(['computedOn', 'isMeasurementOf', 'value']), unnest(['iri', 'iri', 'literal']), count(*), count(DISTINCT run), 0 FROM m UNION ALL SELECT 'urn:obs:' || unnest(['elapsedMs', 'observedCount']), 'literal', count(*), count(DISTINCT run), 0 FROM m
UNION ALL SELECT 'urn:obs:' || unnest(['notMeasuredOn', 'notMeasuredMetric', 'notMeasuredReason']), unnest(['iri', 'iri', 'literal']), count(*), count(DISTINCT run), 0 FROM d""",
    ),
    "f1_star": (q_star, "SELECT 'urn:g:customer' AS g, 'urn:customer:' || c_custkey AS s, c_name AS name, c_mktsegment AS segment, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS balance FROM customer"),
    "v4_governed": (q_governed, f"{READINGS_SQL} SELECT run AS g, count(DISTINCT endpoint) AS endpoints FROM readings GROUP BY 1"),
    "v12_shapes": (
        q_shapes,
        f"{_DIRTY_SQL} SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'instant' WHEN page_id % 8 IN (2, 6) THEN 'url' ELSE 'metric' END AS fault FROM dirty WHERE page_id % 9 = 0 OR page_id % 8 IN (2, 6) OR page_id % 10 = 0",
    ),
    "v10_registry_conflicts": (q_registry_conflicts, "SELECT 'urn:' || o_custkey AS url, count(DISTINCT o_orderstatus) AS claims FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1"),
    "v11_outcome_faults": (q_outcome_faults, "SELECT 'urn:' || o_custkey AS url, 'twice' AS fault FROM orders GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'urn:' || o_custkey, 'not listed' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 > 0)"),
    "v8_v9_pointers": (q_drifted, f"{READINGS_SQL} SELECT DISTINCT endpoint, 'urn:run:none' AS run, unnest(['drifted', 'dangling']) AS fault FROM readings WHERE endpoint LIKE '%3'"),
    "j1_resolve": (q_resolve, _OBS_SQL + _RESOLVE_SQL),
    "j3_tolerance": (q_tolerance, "SELECT p_partkey, p_partkey % 100 = p_size * 2 OR coalesce(p_partkey % 2 = 0 AND p_partkey % 100 <> 0 AND abs(p_size * 2 - p_partkey % 100)::DOUBLE / (p_partkey % 100) <= 0.25, false) AS within FROM part"),
    "j6_grade": (
        q_grade,
        "SELECT CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 5 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 4 WHEN p_partkey % 3 = 0 THEN 3 WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS level, count(*) AS n FROM part GROUP BY 1",
    ),
    "j10_admit": (q_admit, "SELECT CASE WHEN p_size % 3 = 2 THEN 'cost-ceiling' WHEN p_partkey % 2 = 1 THEN 'cadence' END AS reason, count(*) AS n FROM part GROUP BY 1"),
    "j12_fill": (q_fill, f"{READINGS_SQL} SELECT e.endpoint, m.metric, 'indeterminate' AS verdict, CAST(NULL AS BIGINT) AS elapsed_ms FROM (SELECT DISTINCT endpoint FROM readings) e, (SELECT DISTINCT metric FROM readings) m WHERE NOT EXISTS (SELECT 1 FROM readings r WHERE r.endpoint = e.endpoint AND r.metric = m.metric)"),
    "j11_liveness_gate": (
        q_gate,
        f"""{READINGS_SQL}, l AS (SELECT endpoint, elapsed_ms FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY run_at DESC, metric DESC) AS k FROM readings) WHERE k = 1),
c AS (SELECT endpoint, CASE WHEN endpoint LIKE '%9' THEN 'prober-failed' WHEN elapsed_ms IS NULL OR elapsed_ms % 3 = 0 THEN 'liveness-failed' END AS reason FROM l)
SELECT m.metric, reason, count(*) AS n FROM c, (SELECT DISTINCT metric FROM readings) m WHERE reason IS NOT NULL AND (reason = 'prober-failed' OR m.metric <> 'm0') GROUP BY 1, 2""",
    ),
    "j9_severity": (q_severity, f"{READINGS_SQL}, s AS (SELECT endpoint, CASE verdict WHEN 'verified' THEN 0 WHEN 'undeclared-but-verified' THEN 1 WHEN 'absent' THEN 3 WHEN 'indeterminate' THEN 5 END AS v FROM readings) SELECT endpoint, max(v) AS worst, min(v) AS best FROM s GROUP BY 1"),
    "j15_decisive_state": (
        q_decisive,
        f"{_TERMS_SQL} SELECT CASE WHEN declared AND observed THEN 'verified' WHEN observed THEN CASE WHEN regexp_matches(endpoint, '[0-4]$') THEN 'undeclared-but-verified' ELSE 'indeterminate' END WHEN regexp_matches(endpoint, '[02468]$') THEN 'declared-only' ELSE 'indeterminate' END AS state, count(*) AS n FROM vocabulary GROUP BY 1",
    ),
    "w3_replay": (
        q_replay,
        f"""{READINGS_SQL}, o AS (SELECT run_at, endpoint, sum(coalesce(elapsed_ms, 0)) AS cost, bool_or(verdict IN ('verified', 'undeclared-but-verified')) AS pos, bool_or(metric = 'm0' AND verdict NOT IN ('verified', 'undeclared-but-verified')) AS lf FROM readings WHERE kind = 'measured' GROUP BY 1, 2),
x AS (SELECT *, NOT pos AND (cost > 20000 OR lf) AS struck, max(CASE WHEN pos OR NOT (cost > 20000 OR lf) THEN run_at END) OVER (PARTITION BY endpoint) AS cleared FROM o)
SELECT endpoint AS url, CAST(count(*) FILTER (WHERE struck AND (cleared IS NULL OR run_at > cleared)) AS INT) AS strikes, strftime(max(run_at), '%Y-%m-%d %H:%M:%S') AS last_probed FROM x GROUP BY 1""",
    ),
    "w1_plan": (
        q_plan,
        """WITH s AS (SELECT c_custkey AS k, 'urn:' || c_custkey AS url, c_custkey % 7 > 0 AS known, c_custkey % 7 > 0 AND c_custkey % 3 = 0 AS dormant, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 5 > 0 THEN c_custkey % 15 END AS ago,
  CASE WHEN c_custkey % 7 = 0 THEN 'none' WHEN c_custkey % 10 = 1 THEN 'dormant' WHEN c_custkey % 10 = 2 THEN CASE WHEN c_custkey % 20 - 10 <= 0 THEN 'awake' ELSE 'lapsed' END ELSE 'none' END AS effect FROM customer),
g AS (SELECT *, dormant AND effect IN ('none', 'lapsed') AS governed, dormant AND effect IN ('none', 'lapsed') AND (ago IS NULL OR ago >= 7) AS due FROM s), n AS (SELECT greatest(1, least(ceil(count(*) FILTER (WHERE governed) * 2 / 7.0), count(*) FILTER (WHERE governed))) AS slice FROM g),
q AS (SELECT g.*, row_number() OVER (PARTITION BY due ORDER BY ago DESC NULLS FIRST, url) AS place FROM g),
r AS (SELECT CASE WHEN effect = 'dormant' THEN 'operator-hold' WHEN effect = 'awake' OR NOT dormant OR (due AND place <= slice) THEN NULL ELSE 'automatic' END AS reason FROM q, n)
SELECT CASE WHEN reason IS NULL THEN 'probe' ELSE 'skip' END AS action, reason, count(*) AS n FROM r GROUP BY 1, 2""",
    ),
    "t11_rotation": (
        q_rotation,
        f"""{READINGS_SQL} SELECT DISTINCT endpoint, CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(endpoint, ''), lambda c: ord(c)::UHUGEINT)),
lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % 7 AS BIGINT) AS bucket FROM readings""",
    ),
    "w5_rotation_split": (
        q_rotation_split,
        f"""{READINGS_SQL}, b AS (SELECT DISTINCT endpoint AS url, CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(endpoint, ''), lambda c: ord(c)::UHUGEINT)),
lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % 7 AS BIGINT) AS bucket FROM readings),
m AS (SELECT DISTINCT metric FROM readings)
SELECT url, metric, CASE WHEN bucket <> (DATE '2024-03-01' - DATE '1970-01-01') % 7 AND metric[-1] IN ('1', '3') THEN 'cadence' END AS reason FROM b, m""",
    ),
    "s2_gzip": (
        q_gzip,
        f"""{READINGS_SQL}, m AS (SELECT * FROM readings WHERE kind = 'measured'), d AS (SELECT * FROM readings WHERE kind = 'declined')
SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, count(*) AS n, count(DISTINCT run) AS graphs, 0 AS bad FROM readings UNION ALL SELECT 'http://www.w3.org/ns/prov#wasGeneratedBy', count(*), count(DISTINCT run), 0 FROM readings
UNION ALL SELECT 'http://www.w3.org/ns/dqv#' || unnest(['computedOn', 'isMeasurementOf', 'value']), count(*), count(DISTINCT run), 0 FROM m UNION ALL SELECT 'urn:obs:' || unnest(['elapsedMs', 'observedCount']), count(*), count(DISTINCT run), 0 FROM m
UNION ALL SELECT 'urn:obs:' || unnest(['notMeasuredOn', 'notMeasuredMetric', 'notMeasuredReason']), count(*), count(DISTINCT run), 0 FROM d""",
    ),
    "s7_registry_dump": (
        q_registry_dump,
        "SELECT 'set' || (page_id % 50) AS dataset, url, 'T set' || (page_id % 50) AS title, 'set' || (page_id % 50) || '#' || lpad(CAST(row_number() OVER (PARTITION BY page_id % 50 ORDER BY url) - 1 AS VARCHAR), 6, '0') AS position FROM pages",
    ),
    "r12_bounded": (q_bounded, "SELECT 1000 AS n, true AS truncated"),
}

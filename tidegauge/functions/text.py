"""Column steps on names, URLs and words, all native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.session import materialise

# Hosts whose terms belong to an engine, and well-known prefixes.
ENGINE_HOSTS = ("www.openlinksw.com", "openlinksw.com", "www.ontotext.com", "ontotext.com", "jena.apache.org", "rdf4j.org")
PREFIXES = {
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf",
    "http://www.w3.org/2000/01/rdf-schema#": "rdfs",
    "http://www.w3.org/2002/07/owl#": "owl",
    "http://www.w3.org/2001/XMLSchema#": "xsd",
    "http://www.w3.org/2004/02/skos/core#": "skos",
    "http://xmlns.com/foaf/0.1/": "foaf",
    "http://purl.org/dc/terms/": "dcterms",
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://rdfs.org/ns/void#": "void",
    "http://www.w3.org/ns/dcat#": "dcat",
    "http://www.w3.org/ns/prov#": "prov",
    "http://www.w3.org/ns/sparql-service-description#": "sd",
    "http://www.opengis.net/ont/geosparql#": "geo",
    "http://purl.obolibrary.org/obo/": "obo",
    "http://schema.org/": "schema",
    "https://schema.org/": "schema",
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def percent_encode(text: Column) -> Column:
    """All bytes but the unreserved characters of RFC 3986."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def namespace_of(iri: Column) -> Column:
    """Up to the last ``#`` with something after it, else the last such ``/``, else the whole."""
    hashed = F.regexp_extract(iri, "^(.*#)[^#]+$", 1)
    slashed = F.regexp_extract(iri, "^(.*/)[^/]+$", 1)
    return F.when(hashed != "", hashed).when(slashed != "", slashed).otherwise(iri)


def local_name(iri: Column) -> Column:
    """What follows the namespace, possibly empty."""
    return F.substring(iri, F.length(namespace_of(iri)) + 1, F.length(iri))


def namespace_at_last(iri: Column) -> Column:
    """T2, build-tool variant: up to the later of the last ``#`` and ``/``."""
    return F.regexp_extract(iri, "^(.*[#/])?", 0)


def tokens(name: Column) -> Column:
    """The lower-case words of a name: camel case and ``_-./:`` are boundaries."""
    marked = F.regexp_replace(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_"), "[_\\-./:]+", "_")
    return F.transform(F.filter(F.split(marked, "_"), lambda t: t != ""), F.lower)


def within_one_edit(a: Column, b: Column) -> Column:
    """T4: at most one insertion, deletion, substitution or swap of neighbours."""
    close = F.levenshtein(a, b, 1) >= 0
    # A swap is two substitutions at neighbouring places that exchange two characters.
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first, second = F.try_element_at(places, F.lit(1)), F.try_element_at(places, F.lit(2))
    one = F.lit(1)
    swapped = (
        (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & (F.size(places) == 2) & (second == first + 1)
        & (F.substring(a, first, one) == F.substring(b, second, one)) & (F.substring(a, second, one) == F.substring(b, first, one))
    )
    return close | F.coalesce(swapped, F.lit(False))


def word_score(word: Column, words: Column, haystack: Column) -> Column:
    """T5: 4 for a word of the term, 3 for a prefix of one, 2 inside the term, 1 one edit away."""
    return (
        F.when(F.array_contains(words, word), 4)
        .when(F.exists(words, lambda t: F.startswith(t, word)), 3)
        .when(F.contains(haystack, word), 2)
        .when((F.length(word) >= 4) & F.exists(words, lambda t: within_one_edit(word, t)), 1)
        .otherwise(0)
    )


def prefix_stem(namespace: Column) -> Column:
    """A label from the last path segment or the host."""

    def label(bare: Column) -> Column:
        segment = F.regexp_extract(F.coalesce(F.try_parse_url(bare, F.lit("PATH")), F.lit("")), "([^/]+)/*$", 1)
        first = F.split(F.lower(F.coalesce(F.try_parse_url(bare, F.lit("HOST")), bare)), "\\.")[0]
        return _let(F.coalesce(F.nullif(segment, F.lit("")), first), lambda x: F.substring(F.regexp_replace(x, "[^a-zA-Z0-9-]+", ""), 1, 12))

    return F.lower(F.coalesce(F.nullif(_let(F.regexp_replace(namespace, "[#/]+$", ""), label), F.lit("")), F.lit("ns")))


def allocate_prefixes(namespaces: DataFrame, order: list[Column]) -> DataFrame:
    """A distinct prefix for each namespace (columns namespace, n).

    Well-known names are fixed, and no other namespace of the table gets one. In the
    given order, which has no ties, each takes the first free of its stem, stem and
    2, stem and 3, and so on. Names can only meet within stems that are alike but
    for digits at the end; a family with one stem is numbered by place. In the
    others each name stays with the first that asks for it, the rest move on by at
    least one, and rounds repeat until no name is asked for twice.
    """
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair]), F.col("namespace"))
    rows = namespaces.withColumns({"known": known, "stem": prefix_stem(F.col("namespace"))})
    reserved = rows.where("known is not null").select(F.col("known").alias("stem"), F.lit(1).alias("shift")).distinct()
    by_stem = Window.partitionBy("stem").orderBy(*order)
    placed = rows.where("known is null").withColumn("place", F.row_number().over(by_stem))
    placed = placed.join(reserved, "stem", "left").withColumn("k", F.col("place") + F.coalesce("shift", F.lit(0)))
    placed = materialise(placed.withColumn("family", F.regexp_replace("stem", "[0-9]+$", "")), "prefixes")
    name = F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat("stem", F.col("k").cast("string")))
    mixed = placed.groupBy("family").agg((F.min("stem") != F.max("stem")).alias("mixed")).where("mixed").select("family")
    asking = placed.join(mixed, "family", "left_semi")
    while True:
        lost = (F.row_number().over(Window.partitionBy("prefix").orderBy(*order)) > 1).cast("int")
        judged = materialise(asking.withColumn("prefix", name).withColumn("lost", lost), "asked")
        if judged.where("lost = 1").isEmpty():
            break
        # Within a stem the places stay in order: one behind another takes at least the next number.
        behind = F.max(F.col("k") + F.col("lost") - F.col("place")).over(by_stem.rowsBetween(Window.unboundedPreceding, 0))
        asking = judged.withColumn("k", F.col("place") + behind)
    alone = placed.join(mixed, "family", "left_anti").select("namespace", name.alias("prefix"))
    fixed = rows.where("known is not null").select("namespace", F.col("known").alias("prefix"))
    return alone.unionByName(judged.select("namespace", "prefix")).unionByName(fixed)


def is_engine(namespace: Column, subdomains: bool = False) -> Column:
    """Whether a namespace's host is an engine's, or with ``subdomains`` below one."""
    host = F.lower(F.try_parse_url(namespace, F.lit("HOST")))
    found = host.isin(*ENGINE_HOSTS)
    if subdomains:
        for known in ENGINE_HOSTS:
            found = found | F.endswith(host, F.lit("." + known))
    return F.coalesce(found, F.lit(False))


def authority(url: Column) -> Column:
    """The lower-case authority with userinfo and port."""
    return F.regexp_extract(F.lower(F.trim(url)), "^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1)


def userinfo(url: Column) -> Column:
    return F.regexp_extract(authority(url), "^(.*)@[^@]*$", 1)


def host_port(url: Column) -> Column:
    return F.regexp_extract(authority(url), "([^@]*)$", 1)


def host_key(url: Column) -> Column:
    """Host and port without the scheme's default port; the whole URL if there is no host."""
    whole = F.lower(F.trim(url))
    bare = F.when(whole.startswith("https://"), F.regexp_replace(host_port(url), ":443$", "")).when(whole.startswith("http://"), F.regexp_replace(host_port(url), ":80$", ""))
    key = F.coalesce(bare, host_port(url))
    return F.when(key == "", whole).otherwise(key)


def host(url: Column) -> Column:
    """The host without port; brackets of an IPv6 address are taken off."""
    hp = host_port(url)
    return F.when(hp.startswith("["), F.regexp_extract(hp, "^\\[([^\\]]*)", 1)).otherwise(F.regexp_replace(hp, ":[^:]*$", ""))


def short_label(url: Column, port: bool = True) -> Column:
    """What a row shows of an endpoint: its host, with or without port."""
    label = host_port(url) if port else host(url)
    return F.when(label == "", url).otherwise(F.regexp_replace(label, "^www\\.", ""))


def same_endpoint_key(url: Column) -> Column:
    """Equal for URLs that name one endpoint (scheme, fragment, userinfo, www, ports, slash)."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "^https?://", ""), "#.*$", "")
    head = F.regexp_extract(bare, "^([^/]*)", 1)
    path = F.regexp_replace(F.substring(bare, F.length(head) + 1, F.length(bare)), "/+$", "")
    own = F.regexp_replace(F.lower(F.regexp_extract(head, "([^@]*)$", 1)), "(:443|:80)$", "")
    return F.concat(F.regexp_replace(own, "^www\\.", ""), path)


def unroutable(url: Column) -> Column:
    """Why a host cannot be reached from outside, or null."""
    whole = r"^(?:::ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$"

    def judge(h: Column) -> Column:
        octets = F.transform(F.split(F.regexp_extract(h, whole, 1), "\\."), lambda x: x.try_cast("int"))
        return _let(octets, lambda o: by_number(h, o))

    def by_number(h: Column, o: Column) -> Column:
        valid = (F.size(o) == 4) & F.forall(o, lambda x: x <= 255)
        a, b = F.get(o, F.lit(0)), F.get(o, F.lit(1))
        return (
            F.when(valid & (a == 127), "loopback")
            .when(valid & ((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))), "private")
            .when(valid & (a == 169) & (b == 254), "link-local")
            .when(valid & F.forall(o, lambda x: x == 0), "unspecified")
            .when(h == "::1", "loopback").when(h == "::", "unspecified")
            .when(h.rlike("^f[cd][0-9a-f]{2}:"), "unique-local").when(h.rlike("^fe[89ab][0-9a-f]:"), "link-local")
            .when(h.rlike("(^|\\.)(localhost|test)$"), "reserved for local use")
        )

    return _let(F.regexp_replace(host(url), "\\.$", ""), judge)


def reserved_name(url: Column) -> Column:
    """Why a host is a documentation name, or null."""
    h = F.regexp_replace(host(url), "\\.$", "")
    return F.when(h.rlike("(^|\\.)(example|invalid)$"), "reserved top-level domain").when(h.rlike("(^|\\.)example\\.(com|net|org)$"), "reserved second-level domain")


def retry_after(value: Column, cap_seconds: int) -> Column:
    """Wait, too-long, http-date or junk."""
    text = F.trim(value)
    seconds = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    return (
        F.when(value.isNull(), F.lit(None).cast("string")).when(seconds < 0, "junk").when(seconds <= cap_seconds, "wait").when(seconds > cap_seconds, "too-long")
        .when(F.contains(text, F.lit(",")) & F.endswith(text, F.lit("GMT")), "http-date").otherwise("junk")
    )


def media_essence(content_type: Column) -> Column:
    return F.lower(F.trim(F.split(content_type, ";")[0]))


def body_kind(content_type: Column) -> Column:
    """Sparql-json, rdf, html, json or other."""
    e = media_essence(content_type)
    rdf = ("text/turtle", "application/rdf+xml", "application/n-triples", "application/n-quads", "application/trig", "text/n3", "application/ld+json")
    return (
        F.when(e == "application/sparql-results+json", "sparql-json").when(e.isin(*rdf), "rdf").when(e.isin("text/html", "application/xhtml+xml"), "html")
        .when(e.rlike("^application/([a-z0-9.+-]+\\+)?json$"), "json").otherwise("other")
    )


def days_between(earlier: Column, later: Column) -> Column:
    """Civil days between two instants."""
    return F.datediff(later, earlier)


def day_index(at: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(at))


def curie(iri: Column, prefix: Column) -> Column:
    """Prefix:local, or the IRI where there is no prefix or local name."""
    name = local_name(iri)
    return F.when(prefix.isNull() | (name == ""), iri).otherwise(F.concat(prefix, F.lit(":"), name))


def display_name(title: Column, datasets: Column, url: Column, known: Column) -> Column:
    """The host if several datasets share the endpoint, else title, host, or URL if unknown."""
    shown = host(url)
    return F.when(~F.coalesce(known, F.lit(False)), url).when(F.coalesce(datasets, F.lit(0)) > 0, shown).when(F.coalesce(title, F.lit("")) != "", title).otherwise(shown)

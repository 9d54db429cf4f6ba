"""Content profiles of quads, dataset descriptions, and the fleet's vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions import text as t
from tidegauge.operators import search
from tidegauge.operators.rollup import distinct_sizes
from tidegauge.operators.verdicts import term_state
from tidegauge.schemas import RDF_TYPE, VOID

#: Digest prefixes of the hash rungs; the empty one takes all subjects.
RUNGS = ("", "0", "00")
FIRST_N = 200
MAX_AGE_DAYS = 30


def typed_subjects(quads: DataFrame, type_iri: str = RDF_TYPE) -> DataFrame:
    return quads.where(F.col("p") == type_iri).select("s", F.col("o").alias("class")).distinct()


def ladder(start: str | None = "") -> list[str | None]:
    """The digest prefixes to try for a class, from ``start`` to ever smaller samples.

    Empty: all subjects. None: the first subjects, the last resort. A prefix that is
    no rung is the only one to try, and so is the last resort.
    """
    return [*RUNGS[RUNGS.index(start) :], None] if start in RUNGS else [start]


def sampling_plan(classes: DataFrame, attempts: DataFrame, start: str | None = "") -> DataFrame:
    """How each class (column class) is sampled: the first rung that was not too much for the endpoint.

    ``attempts`` has class, prefix (null: first subjects) and status: the HTTP status
    of that rung's query, null where there was no response. No response and 5xx ask
    for a smaller sample; any other failure refuses them all (sampling null), as does
    a ladder that failed to its end. A rung that was not tried is the next to try.
    """
    rungs = ladder(start)
    number = F.lit(None).cast("int")
    for k, prefix in enumerate(rungs):
        number = F.when(F.col("prefix").eqNullSafe(F.lit(prefix)), k).otherwise(number)
    tried = attempts.withColumn("k", number).where("k is not null")
    large = F.col("status").isNull() | F.col("status").between(500, 599)
    # At most one entry for each rung of the ladder.
    outcomes = tried.groupBy("class").agg(
        F.collect_set(F.when(large, F.col("k"))).alias("large"), F.collect_set(F.when(~large & ~F.col("status").between(200, 299), F.col("k"))).alias("refused")
    )
    rows = classes.select("class").distinct().join(outcomes, "class", "left")
    steps = F.array(*[F.lit(k) for k in range(len(rungs))])
    first = F.try_element_at(F.filter(steps, lambda k: ~F.array_contains(F.coalesce("large", F.array().cast("array<int>")), k)), F.lit(1))
    rows = rows.withColumn("k", first).withColumn("k", F.when(~F.coalesce(F.array_contains("refused", F.col("k")), F.lit(False)), F.col("k")))
    prefix, sampling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, rung in enumerate(rungs):
        prefix = F.when(F.col("k") == k, F.lit(rung)).otherwise(prefix)
        sampling = F.when(F.col("k") == k, "first-n" if rung is None else "exact" if rung == "" else "hash-prefix").otherwise(sampling)
    return rows.select("class", prefix.alias("prefix"), sampling.alias("sampling"))


#: Parts of a class that its first subjects are looked for in.
_PARTS = 64


def sampled_subjects(subjects: DataFrame, plan: DataFrame, first_n: int = FIRST_N) -> DataFrame:
    """Subjects (class, s) that each class's sampling keeps.

    ``first-n`` takes the least subjects: stable, but not representative. They are
    the least of the least of each part, so no task sorts a whole class.
    """
    rows = subjects.join(plan.select("class", "prefix", "sampling"), "class")
    hashed = rows.where("sampling <> 'first-n'").where(F.startswith(F.sha2("s", 256), "prefix"))
    order = Window.partitionBy("class").orderBy("s")
    first = rows.where("sampling = 'first-n'").withColumn("part", F.pmod(F.xxhash64("s"), F.lit(_PARTS)))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("class", "part").orderBy("s"))).where(F.col("k") <= first_n)
    first = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= first_n)
    return hashed.select("class", "s").unionByName(first.select("class", "s"))


def profile_classes(quads: DataFrame, type_iri: str = RDF_TYPE, plan: DataFrame | None = None) -> DataFrame:
    """For each class and property: distinct subjects, distinct datatypes, one of them.

    All classes in one job. IRIs count as the datatype ``IRI``.
    """
    subjects = typed_subjects(quads, type_iri)
    subjects = subjects if plan is None else sampled_subjects(subjects, plan)
    kind = F.when(F.col("o_kind") == "literal", F.coalesce("o_datatype", F.lit("string"))).otherwise("IRI")
    # Distinct in two steps: each (class, property, subject) once, then counts.
    per_subject = quads.select("s", "p", kind.alias("dt")).join(subjects, "s").groupBy("class", "p", "s").agg(F.collect_set("dt").alias("dts"))
    return per_subject.groupBy("class", F.col("p").alias("property")).agg(
        F.count("*").alias("subjects"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("dts")))).alias("dts")
    ).select("class", "property", "subjects", F.size("dts").cast("long").alias("datatypes"), F.try_element_at("dts", F.lit(1)).alias("any_datatype"))


def denominators(profiles: DataFrame, type_iri: str = RDF_TYPE) -> DataFrame:
    """Subjects on each class's type row, or 0."""
    return profiles.groupBy("class").agg(F.coalesce(F.max(F.when(F.col("property") == type_iri, F.col("subjects"))), F.lit(0)).alias("denominator"))


def worth_reprofiling(state: DataFrame, at: Column, tolerance: float = 0.01, max_age: int = MAX_AGE_DAYS) -> DataFrame:
    """P5: whether each endpoint should be profiled again.

    ``state`` has last_triples, last_classes, last_profiled_at, triples, classes.
    """
    known = F.col("last_triples").isNotNull() & F.col("last_classes").isNotNull() & F.col("last_profiled_at").isNotNull()
    old = F.datediff(at, "last_profiled_at") > max_age
    counted = F.col("triples").isNotNull() & F.col("classes").isNotNull()
    then = F.col("last_triples")
    moved = F.when(then == 0, F.col("triples") != 0).otherwise(F.abs(F.col("triples") - then) / F.when(then != 0, then) > tolerance)
    return state.withColumn("worth", F.when(~known, True).when(~counted, old).otherwise((F.col("classes") != F.col("last_classes")) | moved | old))


def dataset_counts(quads: DataFrame, type_iri: str = RDF_TYPE) -> DataFrame:
    """Triples, named graphs, classes and typed entities; the default graph has g null.

    Where the default graph repeats a named graph's triple, it is taken as their
    union and only the named ones are counted.
    """
    named = quads.where("g is not null")
    default = quads.where("g is null").select("s", "p", "o")
    overlap = default.join(named.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_semi").limit(1).agg((F.count("*") > 0).alias("overlap"))
    typed = F.col("p") == type_iri
    sizes = distinct_sizes({"graphs": named.select("g"), "classes": quads.where(typed).select("o"), "entities": quads.where(typed).select("s")})
    counts = quads.agg(F.count("*").alias("all_triples"), F.count("g").alias("named_triples")).crossJoin(sizes)
    return counts.crossJoin(overlap).select(F.when(F.col("overlap"), F.col("named_triples")).otherwise(F.col("all_triples")).alias("triples"), "graphs", "classes", "entities", "overlap")  # one row each


def enumerate_classes(quads: DataFrame, limit: int, type_iri: str = RDF_TYPE) -> tuple[DataFrame, bool]:
    """The first classes by name, and whether the list was cut."""
    classes = quads.where(F.col("p") == type_iri).select(F.col("o").alias("class")).distinct()
    return classes.orderBy("class").limit(limit), classes.limit(limit + 1).count() > limit


def unreached_classes(declared: DataFrame, profiled: DataFrame) -> DataFrame:
    """Declared classes that no profile reached."""
    return declared.select("class").distinct().join(profiled.select("class"), "class", "left_anti")


def void_description(profiles: DataFrame, plan: DataFrame, dataset: str, namespace: str) -> DataFrame:
    """A dataset's class and property partitions as triples; nodes are named by digest."""
    node = lambda *c: F.concat(F.lit(f"{namespace}part:"), F.sha2(F.concat_ws("\u0001", F.lit(dataset), *c), 256))
    entities = F.when(F.col("sampling") == "exact", f"{VOID}entities").otherwise(f"{namespace}sampledEntities")
    classes = denominators(profiles).join(plan.select("class", "sampling"), "class", "left")
    pair = lambda p, o: F.struct((p if isinstance(p, Column) else F.lit(p)).alias("p"), o.cast("string").alias("o"))

    def arm(df: DataFrame, s: Column, *facts: Column) -> DataFrame:
        return df.select(s.alias("s"), F.explode(F.array(*facts)).alias("f")).select("s", "f.p", "f.o")

    own = arm(classes, node("class"), pair(f"{VOID}class", F.col("class")), pair(entities, F.col("denominator")))
    linked = arm(classes, F.lit(dataset), pair(f"{VOID}classPartition", node("class")))
    held = arm(profiles, node("class"), pair(f"{VOID}propertyPartition", node("class", "property")))
    counted = arm(profiles, node("class", "property"), pair(f"{VOID}property", F.col("property")), pair(f"{namespace}subjects", F.col("subjects")))
    return own.unionByName(linked).unionByName(held).unionByName(counted).distinct()


def provably_complete(described: DataFrame) -> DataFrame:
    """Endpoints whose described classes are all of those reported, each exactly.

    Columns: endpoint, sampling; and reported (classes the endpoint counts, or null).
    """
    per = described.groupBy("endpoint").agg(F.count("*").alias("described"), F.max("reported").alias("reported"), F.bool_and(F.col("sampling") == "exact").alias("exact"))
    return per.withColumn("complete", (F.col("described") > 0) & F.coalesce(F.col("described") == F.col("reported"), F.lit(False)) & F.col("exact"))


def partition_table(profiles: DataFrame) -> DataFrame:
    """P10: each class with its properties in the order of their short names."""
    rows = F.array_sort(F.collect_list(F.struct(t.local_name(F.col("property")).alias("name"), "property", "subjects")))
    return profiles.groupBy("class").agg(F.count("*").alias("properties"), rows.alias("rows")).withColumn("short", t.local_name(F.col("class")))


def vocabulary(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Each (term, kind, endpoint) with its state, from declared and observed terms."""
    arms = declared.select("term", "kind", "endpoint", F.lit(True).alias("d"), F.lit(False).alias("o")).unionByName(
        observed.select("term", "kind", "endpoint", F.lit(False).alias("d"), F.lit(True).alias("o"))
    )
    seen = arms.groupBy("term", "kind", "endpoint").agg(F.bool_or("d").alias("declared"), F.bool_or("o").alias("observed"))
    return seen.withColumn("state", term_state(F.col("declared"), F.col("observed")))


def vocabulary_totals(terms: DataFrame) -> DataFrame:
    """Terms used and declared by each endpoint."""
    return terms.groupBy("endpoint").agg(F.count_if("observed").alias("used"), F.count_if("declared").alias("declared"), F.count("*").alias("terms"))


def namespace_totals(terms: DataFrame) -> DataFrame:
    """Distinct terms and endpoints of each namespace."""
    return terms.groupBy(t.namespace_of(F.col("term")).alias("namespace")).agg(F.count_distinct("term").alias("terms"), F.count_distinct("endpoint").alias("endpoints"))


def endpoint_vocabulary(terms: DataFrame, endpoint: str) -> DataFrame:
    """One endpoint's terms, classes first, then by local name."""
    own = terms.where(F.col("endpoint") == endpoint).withColumn("local", t.local_name(F.col("term")))
    return own.orderBy(F.col("kind") != "class", "local", "term")


def vocabulary_status(endpoints: DataFrame, profiles: DataFrame, samples: DataFrame) -> DataFrame:
    """Complete, sampled or none, and the classes known: profiled ones, else sampled ones."""
    p = profiles.groupBy("endpoint").agg(F.count_distinct("class").alias("profiled"), F.bool_and(F.col("sampling") == "exact").alias("exact"))
    s = samples.groupBy("endpoint").agg(F.count_distinct("class").alias("sampled"))
    rows = endpoints.select("endpoint").join(p, "endpoint", "left").join(s, "endpoint", "left")
    status = F.when(F.col("exact"), "complete").when(F.col("profiled").isNotNull() | F.col("sampled").isNotNull(), "sampled").otherwise("none")
    return rows.select("endpoint", status.alias("status"), F.coalesce("profiled", "sampled", F.lit(0)).alias("classes"))


def _facet(kind: str | None = None, namespace: str | None = None, endpoint: str | None = None, state: str | None = None, engine: bool = False, iri: str | None = None, skip: str = "") -> Column:
    """Rows of (term, kind, endpoint, state) that a choice of facets keeps, leaving one group out."""
    ns = t.namespace_of(F.col("term"))
    keep = F.lit(True)
    if iri is not None:
        return F.col("term") == iri
    if kind and skip != "kind":
        keep = keep & (F.col("kind") == kind)
    if namespace and skip != "namespace":
        keep = keep & (ns == namespace)
    if endpoint and skip != "endpoint":
        keep = keep & (F.col("endpoint") == endpoint)
    if state and skip != "state":
        keep = keep & (F.col("state") == state)
    return keep if engine else keep & ~t.is_engine(ns)


def filter_terms(terms: DataFrame, **choice: object) -> DataFrame:
    """Terms with one observation that meets the endpoint and the state together."""
    return terms.where(_facet(**choice)).select("term", "kind").distinct()


def facet_counts(terms: DataFrame, **choice: object) -> DataFrame:
    """Terms behind each value of each group, under the choices of the other groups."""
    groups = {"kind": F.col("kind"), "namespace": t.namespace_of(F.col("term")), "endpoint": F.col("endpoint"), "state": F.col("state")}
    out = None
    for name, value in groups.items():
        part = terms.where(_facet(**choice, skip=name)).groupBy(value.alias("value")).agg(F.count_distinct("term").alias("terms")).withColumn("facet", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def autocomplete(terms: DataFrame, queries: DataFrame, top: int = 8) -> DataFrame:
    """Up to ``top`` terms for each query of two letters or more.

    Local names that start with it come first, then those that hold it, then IRIs;
    inside a bucket by endpoints (most first), length and IRI. Terms are found by
    their pieces of three characters, never one by one.
    """
    counted = terms.groupBy("term").agg(F.count_distinct("endpoint").alias("endpoints"))
    counted = counted.select("term", "endpoints", F.lower(t.local_name(F.col("term"))).alias("local"), F.lower("term").alias("hay"))
    asked = queries.select("query", F.lower(F.trim("query")).alias("q")).where("length(q) >= 2").distinct()
    rows = search.containing(counted, asked.select(F.col("q").alias("needle")), "term", "hay").withColumnRenamed("needle", "q").join(asked, "q")
    bucket = F.when(F.startswith("local", "q"), 0).when(F.contains("local", "q"), 1).otherwise(2)
    order = Window.partitionBy("query").orderBy("bucket", F.desc("endpoints"), F.length("term"), "term")
    return rows.withColumn("bucket", bucket).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("query", "term", "bucket", "endpoints", "place")

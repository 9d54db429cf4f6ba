"""The archive format: reading N-Quads files as a table and writing facts as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.text import percent_encode
from tidegauge.schemas import DQV, NAMESPACE, PROV, RDF_TYPE

_IRI, _BLANK = r"<([^<>\"{}|^`\\\x00-\x20]*)>", r"(_:[^\s<>\"]+)"
_LITERAL = r"(\")([^\"\\\n\r]*+(?:\\.[^\"\\\n\r]*+)*+)\"(?:\^\^<([^<>\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?"
_LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(?:{_IRI}|{_BLANK}|{_LITERAL})\s*(?:{_IRI})?\s*\.\s*$"
#: The parts of a line by group of the pattern. No group can hold a line feed, so one replacement takes a line apart.
_PARTS = ("si", "sb", "p", "oi", "ob", "q", "ol", "dt", "lang", "g")
_APART = "".join(f"${k}\n" for k in range(1, len(_PARTS) + 1))


def _unescape(text: Column) -> Column:
    """String escapes of a literal; \\u escapes go through JSON's own rule."""
    plain = F.when(~F.contains(text, F.lit("\\")), text)
    quoted = F.concat(F.lit('{"v":"'), F.regexp_replace(F.regexp_replace(text, r"\\'", "'"), "\t", "\\\\t"), F.lit('"}'))
    return F.coalesce(plain, F.get_json_object(quoted, "$.v"), text)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Quads of a frame (src_file, line_no, value); ``bad`` holds a line that does not parse.

    Comments and blank lines go. A missing graph leaves g null.
    """
    body = lines.where("value is not null and trim(value) <> '' and not startswith(trim(value), '#')")
    # The pattern is matched once a line; a line that it does not match stays as it is.
    apart = body.select("src_file", "line_no", "value", F.regexp_replace("value", _LINE, _APART).alias("apart"))
    fields = apart.select("src_file", "line_no", "value", (F.col("apart") != F.col("value")).alias("ok"), F.split("apart", "\n").alias("f"))
    terms = fields.select("src_file", "line_no", "ok", "value", *[F.get("f", k).alias(c) for k, c in enumerate(_PARTS)])
    literal, ok = F.col("q") == '"', F.col("ok")
    none = lambda c: F.when(ok & (c != ""), c)
    return terms.select(
        "src_file", "line_no", F.when(ok, F.when(F.col("sb") != "", F.col("sb")).otherwise(F.col("si"))).alias("s"),
        F.when(ok, F.when(F.col("sb") != "", "blank").otherwise("iri")).alias("s_kind"), F.when(ok, F.col("p")).alias("p"),
        F.when(ok, F.when(literal, _unescape(F.col("ol"))).when(F.col("ob") != "", F.col("ob")).otherwise(F.col("oi"))).alias("o"),
        F.when(ok, F.when(literal, "literal").when(F.col("ob") != "", "blank").otherwise("iri")).alias("o_kind"),
        none(F.col("dt")).alias("o_datatype"), none(F.col("lang")).alias("o_lang"), none(F.col("g")).alias("g"), F.when(~ok, F.col("value")).alias("bad"),
    )


def read_lines(spark: SparkSession, path: str | list[str], few: bool = False) -> DataFrame:
    """Rows (src_file, line_no, value) of all files under a path, or of named files; .gz files are read as they are.

    Large files are read in byte ranges by several tasks. A line's number is its place in
    its range plus the lines of the ranges before it, which a first scan has counted. The
    file key has no ``.gz``, so a packed file is the same file. ``few``: the files are so few
    that the counts of their ranges may be broadcast; no line is shuffled then.
    """
    meta, place = F.col("_metadata"), F.monotonically_increasing_id()
    rows = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), place.alias("place"), "value"
    )
    # Rows of a range are numbered one after another in its task.
    keys = ["file", "start", F.shiftright("place", 33).alias("task")]
    ranges = rows.groupBy(*keys).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")
    ranges = ranges.select("file", "start", "task", F.regexp_replace("file", "\\.gz$", "").alias("src_file"), (before - F.col("first") + 1).alias("shift"))
    lines = rows.withColumn("task", F.shiftright("place", 33)).join(F.broadcast(ranges) if few else ranges, ["file", "start", "task"], "left")
    # Both scans cut the files alike; if they ever did not, numbers would be wrong.
    number = F.coalesce(F.col("place") + F.col("shift"), F.raise_error(F.lit("a range of a file was not counted")).cast("long"))
    value = F.when(F.endswith("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    return lines.select("src_file", number.alias("line_no"), value.alias("value"))


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """Quads of all files under a path, however large."""
    return parse_lines(read_lines(spark, path))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """S3: key and digest of every file, over its unpacked text."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), "\\.gz$", "").alias("key"), F.sha2(F.col("value").cast("binary"), 256).alias("digest"))


def pending_files(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """S3: files whose key and digest are not recorded; without a manifest, all."""
    return files if manifest is None else files.join(manifest.select("key", "digest"), ["key", "digest"], "left_anti")


def _term(value: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    text = value
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise(""))
    return F.when(kind == "literal", literal).when(kind == "blank", value).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def to_line() -> Column:
    """The N-Quads line of a quad."""
    none = F.lit(None).cast("string")
    subject = _term(F.col("s"), F.col("s_kind"), none, none)
    obj = _term(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang"))
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise("")
    return F.concat(subject, F.lit(" <"), F.col("p"), F.lit("> "), obj, graph, F.lit(" ."))


def to_lines(quads: DataFrame) -> DataFrame:
    """One N-Quads line per quad (column value), in no promised order."""
    return quads.select(to_line().alias("value"))


def reading_facts(namespace: str = NAMESPACE) -> tuple[Column, list[tuple[Column, str, Column, str, str | None]]]:
    """The node of a reading, and what is said of it as (whether, predicate, object, kind, datatype)."""
    xsd = "http://www.w3.org/2001/XMLSchema#"
    instant = F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    measured = F.col("kind") == "measured"
    name = F.concat(
        F.lit(namespace), F.when(measured, "measurement:").otherwise("not-measured:"), instant, F.lit(":"), percent_encode(F.col("endpoint")), F.lit(":"), F.col("metric")
    )
    metric = F.concat(F.lit(f"{namespace}metric:"), F.col("metric"))
    activity = F.concat(F.lit(f"{namespace}activity:"), instant)
    fact = lambda when, p, o, kind="iri", dt=None, known=None: (when & (o if known is None else known).isNotNull(), p, o.cast("string"), kind, dt)
    return name, [
        fact(measured, RDF_TYPE, F.lit(f"{DQV}QualityMeasurement")), fact(~measured, RDF_TYPE, F.lit(f"{namespace}NotMeasured")),
        fact(measured, f"{DQV}computedOn", F.col("endpoint")), fact(measured, f"{DQV}isMeasurementOf", metric, known=F.col("metric")), fact(measured, f"{DQV}value", F.col("verdict"), "literal"),
        fact(~measured, f"{namespace}notMeasuredOn", F.col("endpoint")), fact(~measured, f"{namespace}notMeasuredMetric", metric, known=F.col("metric")),
        fact(~measured, f"{namespace}notMeasuredReason", F.col("reason"), "literal"),
        fact(measured, f"{namespace}level", F.col("level"), "literal", f"{xsd}integer"), fact(measured, f"{namespace}elapsedMs", F.col("elapsed_ms"), "literal", f"{xsd}integer"),
        fact(measured, f"{namespace}declaredCount", F.col("declared_count"), "literal", f"{xsd}integer"),
        fact(measured, f"{namespace}observedCount", F.col("observed_count"), "literal", f"{xsd}integer"), fact(F.lit(True), f"{PROV}wasGeneratedBy", activity, known=F.col("run_at")),
    ]


def to_nquads(readings: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Readings as quads: one node per measurement or decline, in its run's graph."""
    name, said = reading_facts(namespace)
    facts = F.array(*[F.when(when, F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_datatype"))) for when, p, o, kind, dt in said])
    rows = readings.select(name.alias("s"), F.col("run").alias("g"), F.explode(F.filter(facts, lambda f: f.isNotNull())).alias("f"))
    return rows.select("s", F.lit("iri").alias("s_kind"), "f.p", "f.o", "f.o_kind", "f.o_datatype", F.lit(None).cast("string").alias("o_lang"), "g")

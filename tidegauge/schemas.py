"""Schemas and closed value sets of the observation archive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabulary namespace of an archive; readers take another one as a parameter.
NAMESPACE = "urn:obs:"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
PROV = "http://www.w3.org/ns/prov#"
DQV = "http://www.w3.org/ns/dqv#"
VOID = "http://rdfs.org/ns/void#"
SD = "http://www.w3.org/ns/sparql-service-description#"

# Verdicts from best to worst, and what they are counted as.
VERDICTS = ("verified", "undeclared-but-verified", "declared-only", "absent", "declared-but-wrong", "indeterminate")
POSITIVE = ("verified", "undeclared-but-verified")
UNREACHED = "indeterminate"
NOT_MEASURED = "not-measured"
UNRECOGNISED = "unrecognised"
#: Reasons that say what a sweep chose, not what it saw.
POLICY_REASONS = ("cost-ceiling", "cadence")

QUADS = (
    "src_file string, line_no long, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, g string"
)
READINGS = (
    "run string, run_at timestamp, endpoint string, metric string, kind string, verdict string, reason string, level int, "
    "elapsed_ms long, declared_count long, observed_count long"
)


def severity(verdict: Column) -> Column:
    """0 (best) to 5; null for a value outside the set."""
    out = F.lit(None).cast("int")
    for k, v in enumerate(VERDICTS):
        out = F.when(verdict == v, k).otherwise(out)
    return out


def display_state(kind: Column, verdict: Column) -> Column:
    """The verdict, ``not-measured`` for declines, ``unrecognised`` for unknown values."""
    return F.when(kind == "declined", NOT_MEASURED).when(verdict.isin(*VERDICTS), verdict).otherwise(UNRECOGNISED)


def is_positive(verdict: Column) -> Column:
    return F.coalesce(verdict.isin(*POSITIVE), F.lit(False))


def is_policy(reason: Column) -> Column:
    return F.coalesce(reason.isin(*POLICY_REASONS), F.lit(False))

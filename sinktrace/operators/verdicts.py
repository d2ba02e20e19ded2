"""Verdicts, summaries, facets and the order of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinktrace.storage import numbered

VERDICTS = ("yes", "uncertain", "no", "failed", "unverified")


def verdict_of(finding: Column) -> Column:
    """The verdict of a finding struct (reachable, reasoning); none is unverified, a verifier's failure is failed."""
    return (
        F.when(finding.isNull(), "unverified")
        .when(F.coalesce(finding["reasoning"].contains("verifier_failed"), F.lit(False)), "failed")
        .when(finding["reachable"].isin("yes", "no"), finding["reachable"])
        .otherwise("uncertain")
    )


def summary(findings: DataFrame) -> DataFrame:
    """One row: the number of findings, and of each verdict."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return findings.agg(
        F.count(F.lit(1)).alias("total"), count("yes").alias("reachable"), count("uncertain").alias("uncertain"), count("no").alias("not_reachable"), count("failed").alias("verifier_failed"), count("unverified").alias("unverified"),
        F.count_if(F.col("verdict").isin("uncertain", "failed", "unverified")).alias("needs_review"),
    )


def facets(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each key alone, of all keys in one aggregation: facet, value, n and the value's rank in its facet."""
    sets = findings.groupingSets([[k] for k in keys], *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    which = {(1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)): k for i, k in enumerate(keys)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g, k in which.items():
        name, value = F.when(F.col("g") == g, F.lit(k)).otherwise(name), F.when(F.col("g") == g, F.col(k).cast("string")).otherwise(value)
    named = sets.select(name.alias("facet"), value.alias("value"), "n")
    return within(numbered(named, "rank", F.col("facet"), F.desc("n"), F.col("value")), "rank", "facet")


def facet_pages(ranked: DataFrame, page: int = 5) -> DataFrame:
    """Facet values with whether they show at once or behind the button for more, and how many there are: facet, value, n, rank, shown, of."""
    sizes = ranked.groupBy("facet").agg(F.max("rank").alias("of"))
    return ranked.join(F.broadcast(sizes), "facet").withColumn("shown", F.col("rank") <= page)  # a row for each facet


def within(rows: DataFrame, place: str, key: str) -> DataFrame:
    """Places over all rows, in order of a key of few values, as places within each value of the key."""
    low = rows.groupBy(key).agg(F.min(place).alias("__low"))
    return rows.join(F.broadcast(low), key).withColumn(place, F.col(place) - F.col("__low") + 1).drop("__low")


def selected(findings: DataFrame, verdict: str | None = None, label: str | None = None, file: str | None = None, risk_level: str | None = None) -> DataFrame:
    """Findings that meet every choice made: by verdict, kind, file and risk level."""
    for column, value in (("verdict", verdict), ("label", label), ("sink_file", file), ("risk_level", risk_level)):
        if value is not None:
            findings = findings.where(F.col(column) == value)
    return findings


def first_findings(findings: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` findings in input order."""
    return findings.orderBy("seq").limit(limit)


def persisted(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each candidate (seq): its finding, or one that says unverified. findings: seq, verdict, confidence, reasoning."""
    met = candidates.join(findings.select("seq", "verdict", "confidence", "reasoning"), "seq", "left")
    return met.withColumn("verdict", F.coalesce("verdict", F.lit("unverified")))


def report_rank(verdict: Column, severity: Column) -> list[Column]:
    """Sort keys of a report: reachable first, refuted last; then by severity."""
    by_verdict = F.when(verdict == "yes", 0).when(verdict == "no", 2).otherwise(1)
    by_severity = F.when(severity == "ERROR", 0).when(severity == "WARNING", 1).when(severity == "INFO", 2).otherwise(3)
    return [by_verdict, by_severity]


def numbered_by_level(findings: DataFrame) -> DataFrame:
    """Findings numbered from 1 within their risk level, by place."""
    return within(numbered(findings, "number", F.col("risk_level"), F.col("sink_file"), F.col("sink_line"), F.col("seq")), "number", "risk_level")

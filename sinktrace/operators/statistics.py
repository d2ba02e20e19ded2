"""Statistics of rules over a corpus of reports, and agreement with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinktrace.functions.text import basename, slashed

_COUNTS = ("yes", "no", "uncertain", "failed", "unverified")


def _verdict_counts() -> list:
    return [F.count_if(F.col("verdict") == v).alias(v) for v in _COUNTS]


def rule_ids_of(rule_ids: Column, rule_id: Column | None = None) -> Column:
    """The rule ids of a merged candidate without blanks, or the one rule id if there are none."""
    named = F.filter(F.coalesce(rule_ids, F.array().cast("array<string>")), lambda r: F.trim(r) != "")
    if rule_id is None:
        return named
    return F.when(F.size(named) > 0, named).otherwise(F.filter(F.array(rule_id), lambda r: F.trim(F.coalesce(r, F.lit(""))) != ""))


def _exploded(findings: DataFrame) -> DataFrame:
    rules = rule_ids_of(F.col("rule_ids"), F.col("rule_id") if "rule_id" in findings.columns else None)
    return findings.withColumn("solo", F.size(rules) == 1).withColumn("rule", F.explode(rules))


def rule_stats(findings: DataFrame) -> DataFrame:
    """For each rule its hits, those that it alone reported, the verdicts, and the reports that it occurs in."""
    return _exploded(findings).groupBy("rule").agg(F.count(F.lit(1)).alias("hits"), F.count_if("solo").alias("solo_hits"), *_verdict_counts(), F.countDistinct("report_id").alias("reports"))


def file_clusters(findings: DataFrame) -> DataFrame:
    """The same for each rule and file; rows without a file are left out."""
    rows = _exploded(findings).withColumn("file", slashed(F.col("sink_file"))).where(F.trim("file") != "")
    return rows.groupBy("rule", "file").agg(F.count(F.lit(1)).alias("hits"), *_verdict_counts())


def noise_candidates(stats: DataFrame) -> DataFrame:
    """Rules that nothing confirms, that report places on their own, and that were refuted."""
    return stats.where("yes = 0 AND solo_hits > 0 AND no > 0")


def noise_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters that were refuted and never confirmed; the whole rule is in doubt unless it is confirmed in another file."""
    confirmed = clusters.groupBy("rule").agg(F.max("yes").alias("best"))
    noisy = clusters.where("yes = 0 AND no > 0").join(confirmed, "rule")
    return noisy.select("rule", "file", "hits", "no", F.when(F.col("best") > 0, "file-only").otherwise("rule-wide").alias("scope"))


def label_matches(labels: DataFrame, verified: DataFrame, tolerance: int = 2) -> DataFrame:
    """Each label (label_id, file, line, expected) with the first verified row (seq, sink_file, sink_line, verdict) of the
    same base name within ``tolerance`` lines; unmatched labels stay.

    The band is dealt into cells of ``tolerance + 1`` lines, so the join has an equality on the line as well as on the name.
    """
    cell = tolerance + 1
    left = labels.withColumn("name", basename(F.col("file"))).withColumn("cell", F.explode(F.array(*(F.floor(F.col("line") / cell).cast("long") + d for d in (-1, 0, 1)))))
    right = verified.select("seq", "verdict", basename(F.col("sink_file")).alias("name"), F.col("sink_line").alias("at"), F.floor(F.col("sink_line") / cell).cast("long").alias("cell"))
    hits = left.join(right, ["name", "cell"]).where(F.abs(F.col("at") - F.col("line")) <= tolerance)
    best = hits.groupBy("label_id").agg(F.min_by("verdict", "seq").alias("verdict"), F.min("seq").alias("seq"))
    return labels.join(best, "label_id", "left")


def agreement(matches: DataFrame) -> DataFrame:
    """One row: labels, those matched, those that agree, and the percentage of the matched (0 if there are none)."""
    agree = F.count_if(F.col("verdict") == F.col("expected"))
    matched = F.count("seq")
    return matches.agg(F.count(F.lit(1)).alias("total"), matched.alias("matched"), agree.alias("agree"), F.floor(100 * agree / F.greatest(matched, F.lit(1))).alias("percent"))

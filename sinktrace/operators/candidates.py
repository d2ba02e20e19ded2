"""Candidates: from raw rule results to filtered, deduplicated rows."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinktrace.functions.text import cwe_ids, slashed

# Weakness classes that reachability says nothing about.
OUT_OF_SCOPE = (
    "CWE-295", "CWE-297", "CWE-311", "CWE-319", "CWE-326", "CWE-327", "CWE-328", "CWE-329",
    "CWE-330", "CWE-338", "CWE-347", "CWE-352", "CWE-614", "CWE-1004", "CWE-1275",
)
# Path globs that are never scanned.
EXCLUDED_PATHS = (
    "target", "out", ".gradle", "gen", "generated", "venv", "third_party", "external", "testdata",
    "src/it", "src/integrationTest", "*.min.js", "*_test.go", "bin", "obj", "packages",
)


def normalize(raw: DataFrame) -> DataFrame:
    """Candidate rows from raw results (seq, check_id, path, start, end, extra: a variant).

    The source is where a trace begins, if there is one; without a trace source and sink are the same place.
    """
    get = lambda path, kind: F.try_variant_get("extra", path, kind)
    source_line = get("$.dataflow_trace.taint_source[1][0].start.line", "int")
    source_file = get("$.dataflow_trace.taint_source[1][0].path", "string")
    traced = source_line.isNotNull()
    as_array = lambda p: F.coalesce(get(p, "array<string>"), F.when(get(p, "string").isNotNull(), F.array(get(p, "string"))), F.array().cast("array<string>"))
    rows = raw.select(
        "seq", F.element_at(F.split("check_id", r"\."), -1).alias("rule_id"), F.trim(get("$.message", "string")).alias("message"), get("$.severity", "string").alias("severity"),
        as_array("$.metadata.cwe").alias("cwe"), as_array("$.metadata.owasp").alias("owasp"),
        F.when(traced, source_file).otherwise(F.col("path")).alias("source_file"), F.when(traced, source_line).otherwise(F.col("start.line")).alias("source_line"),
        F.col("path").alias("sink_file"), F.col("start.line").alias("sink_line"), F.coalesce(get("$.metadata.verification", "string"), F.lit("dataflow")).alias("verification_mode"),
    )
    return rows.withColumn("is_intraprocedural", F.col("source_file") == F.col("sink_file"))


def out_of_scope(cwe: Column, denied: Iterable[str] = OUT_OF_SCOPE) -> Column:
    """Whether a candidate has weakness classes, and all of them are denied."""
    ids = F.coalesce(cwe_ids(cwe), F.array().cast("array<string>"))
    return (F.size(ids) > 0) & (F.size(F.array_except(ids, F.array(*map(F.lit, denied)))) == 0)


def glob_pattern(globs: Iterable[str]) -> str:
    """One pattern that finds a run of path segments matching any of the globs, at any depth."""
    runs = []
    for glob in globs:
        segments = [s for s in glob.replace("\\", "/").split("/") if s and s != "**"]
        if segments:
            runs.append("/".join(re.escape(s).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") for s in segments))
    return f"(^|/)({'|'.join(runs)})(/|$)" if runs else "(?!)"


def excluded_path(path: Column, globs: Iterable[str] = EXCLUDED_PATHS) -> Column:
    return slashed(path).rlike(glob_pattern(globs))


def dedup_key(source_file: Column, source_line: Column, sink_file: Column, sink_line: Column) -> Column:
    return F.sha2(F.concat_ws(":", source_file, source_line.cast("string"), sink_file, sink_line.cast("string")), 256)


def in_order(seq: str, value: str) -> Column:
    """An aggregate: the values of a group in order of seq."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))), lambda x: x["v"])


def dedup(candidates: DataFrame) -> DataFrame:
    """One row for each pair of places: the first candidate, with the rule ids and messages of all in order.

    The rows gathered for a place are the rules that report it, so a group is as small as the ruleset.
    """
    keyed = candidates.withColumn("dedup_key", dedup_key(*(F.col(c) for c in ("source_file", "source_line", "sink_file", "sink_line"))))
    rest = [c for c in candidates.columns if c not in ("message", "verification_mode")]
    first = F.min_by(F.struct(*rest, "message", "verification_mode"), "seq")
    grouped = keyed.groupBy("dedup_key").agg(first.alias("f"), in_order("seq", "rule_id").alias("rule_ids"), in_order("seq", "message").alias("messages"), F.countDistinct("verification_mode").alias("modes"))
    return grouped.select("dedup_key", *(f"f.{c}" for c in rest), "f.message", "rule_ids", "messages", F.when(F.col("modes") > 1, "dataflow").otherwise(F.col("f.verification_mode")).alias("verification_mode"))


def fingerprint(text: Column) -> Column:
    """A digest of a source text that ignores package and import lines and blanks at line ends.

    Lines end at a line feed, a carriage return or both; an empty last line does not count.
    """
    lines = F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    kept = F.filter(lines, lambda x: ~F.regexp_replace(x, r"^\s+", "").rlike("^(package|import) "))
    return F.sha2(F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"), 256)


def dedup_copies(candidates: DataFrame) -> DataFrame:
    """Each candidate with ``first_seq``, the first of those in copies of its file (same fingerprints, lines and rules).

    Those with first_seq = seq stay; the others' sink_file values are the places of the copies. The result is a long table,
    so that a group of copies of any size never meets in one row.
    """
    keys = ["source_print", "source_line", "sink_print", "sink_line", "rules"]
    keyed = candidates.withColumn("rules", F.array_join(F.array_sort("rule_ids"), ","))
    first = keyed.groupBy(*keys).agg(F.min("seq").alias("first_seq"))
    return keyed.join(first, keys).select("seq", "sink_file", "first_seq")


def matched_bytes(content: Column, start: Column, end: Column) -> Column:
    """The bytes of a file from one offset up to another; none if they are not in order."""
    return F.when((start >= 0) & (end >= start), F.substring(content, start + 1, end - start))


def matched_source(content: Column, start: Column, end: Column) -> Column:
    """The text that a rule matched, by byte offsets; bytes that are no UTF-8 are replaced, and where there is nothing it is empty."""
    return F.coalesce(F.make_valid_utf8(matched_bytes(content, start, end).cast("string")), F.lit(""))

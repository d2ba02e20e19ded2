"""Reports of graded findings, as rows of JSON and Markdown, one report to a row or a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.functions.text import html_escaped, one_line, short_location
from sinktrace.operators.candidates import in_order
from sinktrace.operators.verdicts import numbered_by_level, report_rank

LEVELS = ("critical", "high", "medium", "low")


def json_lines(findings: DataFrame) -> DataFrame:
    """Each finding as a JSON object, in input order within its report (report_id, seq, json)."""
    return findings.select("report_id", "seq", F.to_json(F.struct(*[c for c in findings.columns if c != "report_id"])).alias("json"))


def write_json(findings: DataFrame, path: str) -> None:
    """Reports as folders of JSON lines, report_id=.../, sorted by seq: a report may be larger than a task's memory."""
    json_lines(findings).repartitionByRange("report_id", "seq").sortWithinPartitions("report_id", "seq").select("report_id", F.col("json").alias("value")).write.partitionBy("report_id").text(path)


def markdown_entries(findings: DataFrame) -> DataFrame:
    """Entries of a Markdown export: report_id, risk level, number within it, and the entry's text."""
    numbered = numbered_by_level(findings)
    text = F.format_string("### %s-%d %s\n\n- place: `%s:%d`\n- verdict: %s\n- score: %.1f", "risk_level", "number", html_escaped(one_line(F.col("label"))), short_location(F.col("sink_file")), "sink_line", "verdict", "score")
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("risk_level"))
    return numbered.select("seq", "risk_level", level.alias("level"), "number", text.alias("entry"))


def markdown_sections(entries: DataFrame) -> DataFrame:
    """One row for each risk level with its entries in order; for reports that a reader reads, not for a corpus."""
    return entries.groupBy("level", "risk_level").agg(F.array_join(in_order("number", "entry"), "\n\n").alias("section"))


def headers(findings: DataFrame, project: str) -> DataFrame:
    """What stands before a report's findings, as JSON: project, summary and counts by risk level. One row for each report (report_id, header)."""
    n = lambda c: F.count_if(c)
    verdict, risk = F.col("verdict"), F.col("risk_level")
    summary = F.struct(F.count(F.lit(1)).alias("total"), n(verdict == "yes").alias("reachable"), n(verdict == "uncertain").alias("uncertain"), n(verdict == "no").alias("not_reachable"), n(verdict == "failed").alias("verifier_failed"), n(verdict == "unverified").alias("unverified"))
    told = findings.groupBy("report_id").agg(summary.alias("summary"), F.struct(*(n(risk == level).alias(level) for level in LEVELS)).alias("risk"))
    return told.select("report_id", F.to_json(F.struct(F.lit(project).alias("project"), "summary", "risk")).alias("header"))


def write_report(findings: DataFrame, project: str, path: str) -> None:
    """Reports as folders: header.json beside the findings as JSON lines in order; a report may be larger than a task's memory."""
    headers(findings, project).select(F.concat_ws("/", F.lit("header"), "report_id").alias("part"), F.col("header").alias("value")).write.partitionBy("part").text(f"{path}/headers")
    write_json(findings, f"{path}/findings")


def html_cards(findings: DataFrame) -> DataFrame:
    """A card of HTML for each finding: report_id, seq, card; all text is escaped."""
    shown = lambda c: html_escaped(one_line(F.col(c)))
    card = F.concat(
        F.lit('<article class="card" data-verdict="'), shown("verdict"), F.lit('" data-risk="'), shown("risk_level"), F.lit('"><h3>'), shown("sink_file"), F.lit(":"), F.col("sink_line").cast("string"),
        F.lit("</h3><p>"), shown("message"), F.lit("</p><p>"), F.format_string("%.1f", "score"), F.lit("</p></article>"),
    )
    return findings.select("report_id", "seq", card.alias("card"))


def html_tiles(findings: DataFrame) -> DataFrame:
    """The numbers at the head of each report as HTML: report_id, tiles."""
    verdict = F.col("verdict")
    tile = lambda name, c: F.concat(F.lit(f'<div class="tile {name}">'), F.count_if(c).cast("string"), F.lit("</div>"))
    return findings.groupBy("report_id").agg(F.concat(tile("total", F.lit(True)), tile("reachable", verdict == "yes"), tile("safe", verdict == "no"), tile("review", verdict.isin("uncertain", "failed", "unverified"))).alias("tiles"))


def write_html(findings: DataFrame, path: str) -> None:
    """Reports as folders of HTML parts, report_id=.../, cards in the report's order; a page that shows one reads its parts in order."""
    ranks = report_rank(F.col("verdict"), F.col("severity"))
    ordered = findings.select("*", ranks[0].alias("__a"), ranks[1].alias("__b"))
    cards = html_cards(ordered.withColumn("seq", F.struct("__a", "__b", "seq")))
    cards.repartitionByRange("report_id", "seq").sortWithinPartitions("report_id", "seq").select("report_id", F.col("card").alias("value")).write.partitionBy("report_id").text(path)


# The words of a report in both languages, by their place in its page.
LABELS = {
    "zh": {
        "reportTitle": "扫描报告", "stats.total": "候选总数", "stats.reachable": "可达漏洞", "stats.safe": "安全数量", "stats.needsReview": "需要人工复查",
        "filters.all": "全部", "filters.yes": "可达", "filters.no": "不可达", "filters.uncertain": "不确定", "filters.failed": "复核失败", "filters.unverified": "未复核",
        "risk.critical": "致命", "risk.high": "高危", "risk.medium": "中危", "risk.low": "低危", "facet.type": "按漏洞类型", "facet.file": "按文件", "facet.severity": "按危险程度", "facet.more": "显示更多",
        "empty.noFindings": "没有候选发现", "empty.noMatch": "没有匹配这个筛选条件的发现",
    },
    "en": {
        "reportTitle": "Scan report", "stats.total": "Total candidates", "stats.reachable": "Reachable", "stats.safe": "Safe count", "stats.needsReview": "Needs manual review",
        "filters.all": "All", "filters.yes": "Reachable", "filters.no": "Not reachable", "filters.uncertain": "Uncertain", "filters.failed": "Failed", "filters.unverified": "Not verified",
        "risk.critical": "Critical", "risk.high": "High", "risk.medium": "Medium", "risk.low": "Low", "facet.type": "By vulnerability type", "facet.file": "By file", "facet.severity": "By severity", "facet.more": "Show more",
        "empty.noFindings": "No candidate findings", "empty.noMatch": "No findings match this filter",
    },
}


def labels(spark: SparkSession) -> DataFrame:
    """The words of a report: lang, path, label."""
    return spark.createDataFrame([(lang, path, label) for lang, words in LABELS.items() for path, label in words.items()], "lang string, path string, label string")

"""Matching of statements on span tables: leaf patterns that bind metavariables, joined by them and by where they lie.

A leaf is a frame of places (path, pos, end_pos, block_end, method_pos) with a column for each metavariable. Leaves are
joined on the metavariables that they share, so a name stands for one text throughout a match. A leaf is inside another
one's reach if it follows it in the same block, however deep: an interval join within the file, by its path and the
shared metavariables as keys. All matches of a file count, and each place once for a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinktrace.operators.spans import line
from sinktrace.storage import materialise

PLACES = ("path", "pos", "end_pos", "block_end", "method_pos")
LITERAL = r'^"([^"\\]|\\.)*"$'


def leaf(spans: DataFrame, where: Column, **bound: Column) -> DataFrame:
    """The places of the rows that a condition holds for, with metavariables."""
    return spans.where(where).select(*PLACES, *(c.alias(n) for n, c in bound.items()))


def _joined(hits: DataFrame, spans: DataFrame, on: tuple[str, ...], lies: Column, how: str) -> DataFrame:
    other = spans.select(*(F.col(c).alias(f"__{c}") for c in spans.columns))
    keys = [hits[c] == F.col(f"__{c}") for c in ("path", *on)]
    more = [c for c in spans.columns if c not in hits.columns]
    if how == "inner" and not more:  # nothing is bound, so a hit stays as it is, and as often as it is there
        how = "left_semi"
    met = hits.join(other, [*keys, lies], how)
    if how != "inner":
        return met
    return met.select(*hits.columns, *(F.col(f"__{c}").alias(c) for c in more)).distinct()


def _follows(hits: DataFrame) -> Column:
    return (F.col("__end_pos") < hits["pos"]) & (hits["pos"] <= F.col("__block_end"))


def inside(hits: DataFrame, spans: DataFrame, *on: str) -> DataFrame:
    """Hits that follow a span in its block, equal in the metavariables ``on``; with the span's other metavariables."""
    return _joined(hits, spans, on, _follows(hits), "inner")


def not_inside(hits: DataFrame, spans: DataFrame, *on: str) -> DataFrame:
    """Hits that follow no such span."""
    return _joined(hits, spans, on, _follows(hits), "left_anti")


def within(hits: DataFrame, spans: DataFrame, *on: str) -> DataFrame:
    """Hits with a span that lies in them, equal in the metavariables ``on``; with the span's other metavariables."""
    return _joined(hits, spans, on, (hits["pos"] <= F.col("__pos")) & (F.col("__end_pos") <= hits["end_pos"]), "inner")


def not_in_method_of(hits: DataFrame, spans: DataFrame, *on: str) -> DataFrame:
    """Hits whose method holds no such span, before or after them."""
    return _joined(hits, spans, on, hits["method_pos"] == F.col("__method_pos"), "left_anti")


def _one(spans: DataFrame, kind: str, name: str, *bound: str, receiver: str | None = None) -> DataFrame:
    """Calls or constructions of a name (a pattern) with just the arguments ``bound``."""
    where = (F.col("kind") == kind) & F.col("name").rlike(f"^(?:{name})$") & (F.size("args") == len(bound))
    if receiver is not None:
        where = where & F.col("receiver").rlike(f"^(?:{receiver})$")
    return leaf(spans, where, R=F.col("receiver"), **{b: F.element_at("args", i + 1) for i, b in enumerate(bound)})


def _given(spans: DataFrame, target: str, form: str, *bound: str) -> DataFrame:
    """Assignments to ``target`` of a value of a form (a pattern) with just the parts ``bound``."""
    where = (F.col("kind") == "assign") & F.col("receiver").rlike(f"^(?:{form})$") & (F.size("args") == len(bound))
    return leaf(spans, where, **{target: F.col("name")}, **{b: F.element_at("args", i + 1) for i, b in enumerate(bound)})


def _union(*frames: DataFrame) -> DataFrame:
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    out = frames[0].select(*names)
    for f in frames[1:]:
        out = out.unionByName(f.select(*names))
    return out.distinct()


def _not_literal(hits: DataFrame, name: str, spans: DataFrame | None = None) -> DataFrame:
    """Hits whose metavariable is no literal, and, given spans, has been assigned none."""
    out = hits.where(~F.col(name).rlike(LITERAL))
    return out if spans is None else not_inside(out, leaf(spans, (F.col("kind") == "assign") & F.col("value").rlike(LITERAL), **{name: F.col("name")}), name)


def shell_commands(spans: DataFrame) -> DataFrame:
    """A shell that runs a command that is no constant: its words written at the call, in an array or list there, or in a local before it."""
    words = ("SH", "FLAG", "ARG")
    shell = lambda hits: hits.where(F.col("SH").rlike(r'^"(/bin/(sh|bash)|sh|bash|cmd)"$') & F.col("FLAG").rlike(r'^"(-c|/c)"$'))
    direct = _union(_one(spans, "new", "ProcessBuilder", *words), _one(spans, "call", "exec", *words, receiver=".+"))
    sink = _union(_one(spans, "new", "ProcessBuilder", "ARGV"), _one(spans, "call", "exec", "ARGV", receiver=".+"))
    listed = leaf(spans, ((F.col("kind") == "array") | (F.col("kind") == "call") & (F.col("name") == "asList")) & (F.size("args") == 3), ARGV=F.col("value"), **{w: F.element_at("args", i + 1) for i, w in enumerate(words)})
    local = _union(_given(spans, "ARGV", r"\{\}", *words), _given(spans, "ARGV", r"Arrays\.asList", *words))
    return _not_literal(shell(_union(direct, within(sink, listed, "ARGV"), inside(sink, local, "ARGV"))), "ARG", spans)


def _built(spans: DataFrame, target: str) -> DataFrame:
    """Locals that are put together from parts, the last of which is SEGMENT: a sum, ``concat``, ``format``, or a builder that is appended to."""
    last = F.element_at("args", -1)
    form = F.col("receiver").rlike(r"^\+$|(^|\.)concat$|^String\.format$") & (F.col("kind") == "assign") & (F.size("args") > 0)
    plain = leaf(spans, form, **{target: F.col("name")}, SEGMENT=last)
    made = leaf(spans, (F.col("kind") == "assign") & (F.col("receiver") == "new StringBuilder"), SB=F.col("name"))
    appended = leaf(spans, (F.col("kind") == "call") & (F.col("name") == "append") & (F.size("args") == 1), SB=F.regexp_extract("receiver", r"^([\w$]+)", 1), SEGMENT=F.element_at("args", 1))
    told = leaf(spans, (F.col("kind") == "assign") & F.col("receiver").rlike(r"^[\w$]+\.toString$"), **{target: F.col("name")}, SB=F.regexp_extract("receiver", r"^([\w$]+)", 1))
    return _union(plain, inside(inside(told, made, "SB"), appended, "SB"))


def file_paths(spans: DataFrame) -> DataFrame:
    """A file or resource opened at a path with a part that is no constant, written at the call or built in a local before it."""
    opens = r"(?:java\.io\.)?(?:File|FileInputStream|FileReader|FileOutputStream)|ClassPathResource"
    called = ((F.col("type") == "") & (F.col("name").isin("getResourceAsStream", "getResource") | (F.col("name") == "get") & (F.col("receiver") == "Paths") | (F.col("name") == "of") & (F.col("receiver") == "Path"))) | (F.col("type") == "new") & F.col("name").rlike(f"^(?:{opens})$")
    summed = leaf(spans, (F.col("kind") == "sum") & called, SEGMENT=F.element_at("args", -1))
    # A receiver of type Path is one that was declared so, as a local or as a parameter.
    resolved = _one(spans, "call", "resolve", "SEGMENT", receiver=r"[\w$]+")
    path = leaf(spans, (F.col("kind") == "assign") & F.col("type").rlike(r"(^|[ .])Path$"), R=F.col("name"))
    given = spans.where("kind = 'method'").select("path", "end_pos", F.col("pos").alias("method_pos"), F.explode("args").alias("p")).where(F.col("p").rlike(r"\bPath\s+[\w$]+$")).select("path", "method_pos", F.regexp_extract("p", r"([\w$]+)$", 1).alias("R"))
    typed = _union(inside(resolved, path, "R"), resolved.join(given, ["path", "method_pos", "R"], "left_semi"))
    moved = _one(spans, "call", "transferTo", "SEGMENT", receiver=".+")
    local = inside(_one(spans, "call", "get", "V", receiver="Paths"), _built(spans, "V"), "V")
    found = _union(summed, typed, moved, local)
    return _not_literal(found, "SEGMENT").where(~F.col("SEGMENT").rlike(r"^([A-Za-z_$][A-Za-z0-9_$]*\.)*[A-Z][A-Z0-9_]*$"))


def request_urls(spans: DataFrame) -> DataFrame:
    """A URL with a part that is no constant, written at its construction, or built in a local and then opened."""
    summed = leaf(spans, (F.col("kind") == "sum") & (F.col("type") == "new") & (F.col("name") == "URL") & (F.size("args") > 2), SEGMENT=F.element_at("args", -2))
    direct = _one(spans, "new", "URL", "V")
    called = leaf(spans, (F.col("kind") == "call") & ((F.col("name") == "format") & (F.col("receiver") == "String") & (F.size("args") == 2) | (F.col("name") == "concat") & F.col("receiver").rlike(r"\.concat\(.*\)$")), V=F.col("value"), SEGMENT=F.when(F.col("name") == "format", F.element_at("args", -1)).otherwise(F.regexp_extract("receiver", r"\.concat\((.*)\)$", 1)))
    opened = leaf(spans, (F.col("kind") == "call") & F.col("name").isin("openStream", "openConnection"), E=F.col("receiver"))
    endpoint = _given(spans, "E", "new URL", "V")
    # Of a sum or a chain the part before the last one.
    form = (F.col("kind") == "assign") & (F.col("receiver") == "+") & (F.size("args") > 2)
    chain = (F.col("kind") == "assign") & F.col("receiver").rlike(r"\.concat\(.*\)\.concat$")
    local = _union(
        leaf(spans, form, V=F.col("name"), SEGMENT=F.element_at("args", -2)), leaf(spans, chain, V=F.col("name"), SEGMENT=F.regexp_extract("receiver", r"\.concat\((.*)\)\.concat$", 1)),
        leaf(spans, (F.col("kind") == "assign") & (F.col("receiver") == "String.format") & (F.size("args") == 2), V=F.col("name"), SEGMENT=F.element_at("args", -1)), _appended_twice(spans, "V"),
    )
    return _not_literal(_union(summed, within(direct, called, "V"), inside(inside(opened, endpoint, "E"), local, "V")), "SEGMENT")


def _appended_twice(spans: DataFrame, target: str) -> DataFrame:
    """Locals told by a builder to which a part and a tail were appended in one chain."""
    made = leaf(spans, (F.col("kind") == "assign") & (F.col("receiver") == "new StringBuilder"), SB=F.col("name"))
    twice = leaf(spans, (F.col("kind") == "call") & (F.col("name") == "append") & F.col("receiver").rlike(r"^[\w$]+\.append\(.*\)$"), SB=F.regexp_extract("receiver", r"^([\w$]+)", 1), SEGMENT=F.regexp_extract("receiver", r"\.append\((.*)\)$", 1))
    told = leaf(spans, (F.col("kind") == "assign") & F.col("receiver").rlike(r"^[\w$]+\.toString$"), **{target: F.col("name")}, SB=F.regexp_extract("receiver", r"^([\w$]+)", 1))
    return inside(inside(told, made, "SB"), twice, "SB")


def request_xml(spans: DataFrame) -> DataFrame:
    """XML that is unmarshalled from the request itself, at the call or by way of a local."""
    sink = _one(spans, "call", "unmarshal", "IN", receiver=".+")
    stream = leaf(spans, (F.col("kind") == "call") & F.col("name").isin("getInputStream", "getReader") & (F.size("args") == 0) & (F.col("receiver") != ""), IN=F.col("value"))
    local = leaf(spans, (F.col("kind") == "assign") & F.col("receiver").rlike(r".\.(getInputStream|getReader)$") & (F.size("args") == 0), IN=F.col("name"))
    return _union(within(sink, stream, "IN"), inside(sink, local, "IN"))


def half_closed_parsers(spans: DataFrame) -> DataFrame:
    """A parser factory that turns off general entities in a method that neither turns off parameter entities nor forbids document types."""
    sets = lambda feature, value: leaf(spans, (F.col("kind") == "call") & (F.col("name") == "setFeature") & (F.size("args") == 2) & (F.element_at("args", 1) == f'"{feature}"') & (F.element_at("args", 2) == value), F_=F.col("receiver"))
    hits = sets("http://xml.org/sax/features/external-general-entities", "false")
    closed = _union(sets("http://xml.org/sax/features/external-parameter-entities", "false"), sets("http://apache.org/xml/features/disallow-doctype-decl", "true"))
    return not_in_method_of(hits, closed, "F_")


# Rules of our own by what they match; weakness classes and severities are fixed values.
STATEMENT_MATCHES = (
    ("java-shell-command", shell_commands, "CWE-78", "ERROR"), ("java-file-path", file_paths, "CWE-22", "WARNING"), ("java-request-url", request_urls, "CWE-918", "WARNING"),
    ("java-xml-unmarshal", request_xml, "CWE-611", "ERROR"), ("java-xml-entities", half_closed_parsers, "CWE-611", "ERROR"),
)


def statement_hits(spans: DataFrame) -> DataFrame:
    """All matches of the statement rules in a span table: path, line_no, rule_id, cwe, severity, pos; each place once for a rule."""
    # The rules read the table dozens of times; it is written once, so that files are not parsed again for each.
    java, out = materialise(spans.where("lang = 'java'"), "matching-spans"), None
    for rule, match, cwe, severity in STATEMENT_MATCHES:
        found = match(java).select("path", line(F.col("pos")).alias("line_no"), F.lit(rule).alias("rule_id"), F.lit(cwe).alias("cwe"), F.lit(severity).alias("severity"), "pos").distinct()
        out = found if out is None else out.unionByName(found)
    return out

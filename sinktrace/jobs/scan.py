"""A scan from sources to graded findings: every step a DataFrame, the driver only in charge of their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.functions import cvss
from sinktrace.functions.text import cwe_ids, slashed
from sinktrace.operators import candidates, context, entries, explain, graph, indexing, matching, routes, rules, spans, trace, verdicts, verification
from sinktrace.sources import readers
from sinktrace.storage import materialise, numbered

PROMPT = "Rules: %s\nSink: %s:%d\n\n%s\n\nCan a request reach the sink with a value of its own choice? Answer in JSON."


def method_key(path, name, line):
    return F.concat_ws("#", path, name, line.cast("string"))


def matched(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """Candidates of the rules in sources (path, lang, text), filtered by path, scope and checks, and deduplicated; seq is their place by file, line, column and rule.

    Comments are blanked first. Every match counts, in lines, in statements, and in statements that belong together (``matching``).
    """
    kept = sources.where(~candidates.excluded_path(F.col("path")))
    lines = materialise(context.lines_of(indexing.masked(kept, False), "lang"), "scan-lines")
    hits = rules.scan(lines, rules.rule_table(spark)).unionByName(rules.scan(rules.statements_of(lines.where("lang = 'java'")), rules.statement_rules(spark)))
    joined = matching.statement_hits(spans.tracked(kept.where("lang = 'java'")))
    none = F.lit("")
    hits = hits.unionByName(joined.select("path", "line_no", F.col("pos").bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias("col"), "rule_id", "cwe", "severity", none.alias("validators"), none.alias("statement")))
    settled = rules.validated(hits, kept)
    placed = numbered(settled, "seq", F.col("path"), F.col("line_no"), F.col("rule_id"), F.col("col"))
    static = F.contains("validators", F.lit("memcpy-bounds")) | F.col("rule_id").isin("CPP005", "CPP006", "CPP007", "CPP008")
    rows = placed.select(
        "seq", "rule_id", F.coalesce("message", F.lit("")).alias("message"), "severity", F.array("cwe").alias("cwe"), slashed(F.col("path")).alias("source_file"), F.col("line_no").alias("source_line"),
        slashed(F.col("path")).alias("sink_file"), F.col("line_no").alias("sink_line"), F.when(static, "static").otherwise("dataflow").alias("verification_mode"), F.coalesce("rule_confidence", F.lit("MEDIUM")).alias("rule_confidence"),
    )
    return candidates.dedup(rows.where(~candidates.out_of_scope(F.col("cwe"))))


def with_mappers(methods: DataFrame, sources: DataFrame) -> DataFrame:
    """Methods after those that stand for the statements of mapper files among the sources: a call of an interface's method reaches its statement."""
    statements = readers.mapper_statements(sources.where("lang = 'xml'"))
    found = trace.mapper_methods(statements, methods.select("seq", "file", "name", "arity"))
    last = methods.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))  # one number
    placed = numbered(found.select("file", "name", "arity", "start_line", "end_line"), "seq", F.col("file"), F.col("start_line"), F.col("name")).join(F.broadcast(last))
    made = placed.select("file", F.col("file").alias("path"), "name", "arity", "start_line", "end_line", (F.col("seq") + F.col("last")).alias("seq"), method_key(F.col("file"), F.col("name"), F.col("start_line")).alias("method_id"), F.lit("").alias("owner"))
    return methods.unionByName(made, allowMissingColumns=True)


def with_handlers(methods: DataFrame, sites: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Methods after the handler blocks that nested routes declare, as entries; calls in such a block are the block's."""
    told = routes.nested_handlers(sources)
    reason = F.concat_ws(" ", "verb", "route")
    blocks = numbered(told.select(F.col("path").alias("file"), reason.alias("name"), "start_line", "end_line", reason.alias("reason")), "entry_id", F.col("file"), F.col("start_line"), F.col("end_line"), F.col("name"))
    blocks = materialise(blocks, "scan-handlers")
    unmarked = methods.withColumn("entry_reason", F.lit(None).cast("string")).withColumn("entry_definitive", F.lit(False))
    named, calls = trace.with_synthetic(unmarked, blocks, sites)
    named = named.withColumn("path", F.coalesce("path", "file")).withColumn("owner", F.coalesce("owner", F.lit("")))
    return materialise(named, "scan-methods-marked"), materialise(calls, "scan-calls-marked")


def call_graph(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Methods, calls and resolved edges (caller, callee, seq) of sources; a call on the object itself stays within its type and that type's relatives."""
    methods, calls = indexing.index(sources)
    key = method_key(F.col("path"), F.col("name"), F.col("start_line"))
    methods = numbered(methods.select("*", key.alias("method_id"), F.col("path").alias("file")), "seq", F.col("path"), F.col("start_line"), F.col("name"))
    methods = materialise(with_mappers(materialise(methods, "scan-indexed"), sources), "scan-methods")
    caller = F.when(F.col("caller").isNotNull(), method_key(F.col("path"), F.col("caller"), F.col("caller_line")))
    sites = numbered(calls.select("callee", "arity", "receiver_is_self", F.col("path").alias("file"), F.col("line_no").alias("line"), caller.alias("caller_id")), "call_id", F.col("file"), F.col("line"), F.col("callee"))
    methods, sites = with_handlers(methods, materialise(sites, "scan-calls"), sources)
    parents = methods.where("owner <> ''").select(F.col("owner").alias("type"), F.explode("owner_supertypes").alias("parent")).distinct()
    owners = methods.select("method_id", "owner")
    resolved = graph.callers_of(sites, methods)
    resolved = resolved.join(owners.withColumnsRenamed({"method_id": "caller_id", "owner": "caller_owner"}), "caller_id").join(owners.withColumnRenamed("owner", "callee_owner"), "method_id")
    within = graph.self_calls_within(resolved, graph.closure(parents))
    edges = within.groupBy(F.col("caller_id").alias("caller"), F.col("method_id").alias("callee")).agg(F.min("call_id").alias("seq"))
    return methods, sites, materialise(edges, "scan-edges")


def no_entry_reasons(sources: DataFrame, placed: DataFrame, methods: DataFrame, edges: DataFrame) -> DataFrame:
    """Why no chain reaches a sink: sink_id, reason."""
    marked = spans.tracked(sources).where(F.col("kind") == "method").where(F.col("value").rlike(r"@Override\b|\boverride\b"))
    over = marked.select("path", "name", spans.line(F.col("pos")).alias("low"), spans.line(F.col("end_pos")).alias("high"))
    named = methods.select("path", "name", "start_line", "method_id")
    of = named.join(over, ["path", "name"]).where("start_line BETWEEN low AND high").select("method_id").distinct().withColumn("overrides", F.lit(True))
    told = methods.select("method_id", "name").join(of, "method_id", "left").withColumn("overrides", F.coalesce("overrides", F.lit(False)))
    return explain.told(explain.no_entry(placed.select("sink_id", "method_id"), told, edges, indexing.literals_of(sources)))


def entry_marks(spark: SparkSession, sources: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods that a request or a message reaches first: node, reason, definitive; proof goes before a hint."""
    lines = materialise(context.lines_of(indexing.masked(sources, False), "lang"), "scan-code")
    langs = methods.join(sources.select("path", "lang"), "path")
    names = entries.registered(lines)
    late = graph.late_references(methods.select("path", "name", "start_line", F.lit(None).cast("string").alias("entry_reason")), names, ["path", "name"]).where("entry_reason IS NOT NULL")
    found = entries.entry_points(methods, lines, entries.mark_table(spark)).unionByName(entries.served(langs)).unionByName(late.select("path", "name", "start_line", F.col("entry_reason").alias("reason"), F.lit(True).alias("definitive")))
    table = readers.route_entries(sources.where("lang = 'routes'"))
    declared = routes.declared_routes(sources).unionByName(table.withColumn("at", F.lit(0)))
    placed = numbered(declared, "seq", F.col("path"), F.col("at"), F.col("route"), F.col("verb"), F.col("action"))
    by_route = trace.routed(methods.withColumn("entry_reason", F.lit(None).cast("string")).withColumn("entry_definitive", F.lit(False)), placed).where("entry_definitive")
    found = found.unionByName(by_route.select("path", "name", "start_line", F.col("entry_reason").alias("reason"), F.lit(True).alias("definitive")))
    best = found.groupBy("path", "name", "start_line").agg(F.min_by(F.struct("reason", "definitive"), F.struct(~F.col("definitive"), "reason")).alias("e"))
    nodes = best.select(method_key(F.col("path"), F.col("name"), F.col("start_line")).alias("node"), "e.reason", "e.definitive")
    if "entry_definitive" not in methods.columns:  # methods of files without handler blocks may come without
        return materialise(nodes, "scan-entries")
    blocks = methods.where("entry_definitive").select(F.col("method_id").alias("node"), F.col("entry_reason").alias("reason"), F.lit(True).alias("definitive"))
    return materialise(nodes.unionByName(blocks), "scan-entries")


def scan(spark: SparkSession, sources: DataFrame, ask: Callable[[str], str | None], model: str, cache: DataFrame) -> tuple[DataFrame, bool]:
    """Graded findings of sources (path, lang, text), and whether the model gave out on the way."""
    sources = materialise(sources, "scan-sources")
    found = materialise(matched(spark, sources), "scan-candidates")
    methods, calls, edges = call_graph(sources)
    marked = entry_marks(spark, sources, methods)
    methods = methods.drop("entry_reason", "entry_definitive")
    placed = materialise(graph.enclosing_method(found.select(F.col("seq").alias("sink_id"), F.col("sink_file").alias("file"), F.col("sink_line").alias("line")), methods), "scan-sinks")
    starts = placed.where("method_id IS NOT NULL").select(F.col("sink_id").alias("sink"), F.col("method_id").alias("node"))
    chains = trace.entry_traces(starts, edges, marked.select("node", "definitive"))
    code = sources.select(F.col("path").alias("file"), F.split("text", r"\r\n|\r|\n").alias("l"))
    named = methods.join(marked.select(F.col("node").alias("method_id"), F.col("reason").alias("entry_reason")), "method_id", "left")
    shown = materialise(graph.top_chains(chains), "scan-chains")
    callers = trace.caller_context(shown, named, code)
    callees = trace.callee_context(trace.callee_bodies(placed, calls, methods), methods, code)
    around = placed.join(methods.select("method_id", "start_line", "end_line"), "method_id", "left").select("file", "line", "start_line", "end_line").distinct()
    reasons = no_entry_reasons(sources, placed, methods, edges)
    texts = trace.build_context(found, around, code, callers, callees, reasons)
    hops = shown.groupBy(F.col("sink").alias("seq")).agg(F.min("depth").alias("hops"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.array_join("chain", " <- ").alias("c")))), lambda x: x["c"]), "; ").alias("chains"))
    asked = found.join(texts, "seq").join(hops, "seq", "left")
    prompt = F.format_string(PROMPT, F.array_join("rule_ids", ", "), "sink_file", "sink_line", "context")
    answered, halted = verification.verified(asked.withColumn("prompt", prompt), ask, model, cache)
    graded = answered.withColumn("verdict", verdicts.verdict_of(F.col("finding"))).withColumn("w", cvss.worst(spark, cwe_ids(F.col("cwe")))).select("*", "w.vector", "w.score").drop("w", "prompt", "context")
    return graded.withColumn("risk_level", cvss.risk_level(F.col("verdict"), F.col("score"))), halted

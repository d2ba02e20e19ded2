"""More queries of the catalogue: traces with proof and hints, links of mapper files and routes, contexts, verdict loops, logs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinktrace.functions import text
from sinktrace.jobs import reports
from sinktrace.jobs.adapters import ALL_EDGES_SQL, FINDINGS_SQL, METHODS_SQL, all_edges, findings, methods, sinks, table
from sinktrace.jobs.catalogue import _GRADED_SQL, _graded, query
from sinktrace.operators import aliases, candidates, context, graph, indexing, matching, routes, rules, spans, statistics, trace, verdicts, verification
from sinktrace.sources import readers
from sinktrace.storage import scratch, spread
from sinktrace.streaming import events as live

_MARKS_SQL = "marks AS (SELECT p_partkey AS node, p_type = 'PROMO' AS definitive FROM part WHERE p_type IN ('PROMO', 'ECONOMY'))"


@query(f"""WITH RECURSIVE {ALL_EDGES_SQL}, {_MARKS_SQL},
open AS (SELECT node FROM starts WHERE node NOT IN (SELECT node FROM marks WHERE definitive)),
walk AS (SELECT node AS sink, node, 0 AS depth FROM open UNION SELECT w.sink, e.caller, w.depth + 1 FROM walk w JOIN edges e ON e.callee = w.node WHERE w.depth < 7 AND (w.depth = 0 OR w.node NOT IN (SELECT node FROM marks))),
first AS (SELECT sink, node, min(depth) AS depth FROM walk GROUP BY sink, node), chains AS (SELECT sink, node AS entry, depth FROM first WHERE depth > 0 AND node IN (SELECT node FROM marks))
SELECT * FROM chains UNION ALL SELECT node, node, 0 FROM starts WHERE node IN (SELECT node FROM marks WHERE definitive)
UNION ALL SELECT node, node, 0 FROM open WHERE node IN (SELECT node FROM marks) AND node NOT IN (SELECT sink FROM chains)""")
def trace_sources(spark, sf_dir):
    kind = F.col("p_type")
    marks = table(spark, sf_dir, "part").where(kind.isin("PROMO", "ECONOMY")).select(F.col("p_partkey").alias("node"), (kind == "PROMO").alias("definitive"))
    return trace.entry_traces(sinks(spark, sf_dir), all_edges(spark, sf_dir), marks, nodes=False).select("sink", "entry", "depth")


@query("""WITH m AS (SELECT p_partkey AS seq, 'mod' || (p_partkey % 3) || '/java/com/p' || (p_partkey % 25) || '/M' || p_size || '.java' AS file, 'find' || (p_partkey % 4) AS name, CAST(p_partkey % 3 AS INT) AS arity FROM part),
s AS (SELECT 'x/' || s_suppkey || '.xml' AS path, 'com.p' || s_nationkey || '.M' || (s_suppkey % 60) AS namespace, 'find' || (s_suppkey % 4) AS id, CAST(s_suppkey % 90 AS INT) AS start_line FROM supplier),
f AS (SELECT s.path, arg_min(m.file, m.seq) AS interface FROM s JOIN m ON ('/' || m.file) LIKE '%/' || replace(s.namespace, '.', '/') || '.java' GROUP BY s.path)
SELECT s.path AS file, s.id AS name, s.start_line, f.interface, CAST(coalesce((SELECT CASE WHEN min(m.arity) = max(m.arity) THEN min(m.arity) END FROM m WHERE m.file = f.interface AND m.name = s.id), -1) AS INT) AS arity FROM s LEFT JOIN f ON s.path = f.path""")
def mybatis_link(spark, sf_dir):
    k, c = F.col("p_partkey"), lambda x: x.cast("string")
    file = F.concat(F.lit("mod"), c(k % 3), F.lit("/java/com/p"), c(k % 25), F.lit("/M"), c(F.col("p_size")), F.lit(".java"))
    own = table(spark, sf_dir, "part").select(k.alias("seq"), file.alias("file"), F.concat(F.lit("find"), c(k % 4)).alias("name"), (k % 3).cast("int").alias("arity"))
    s = F.col("s_suppkey")
    namespace = F.concat(F.lit("com.p"), c(F.col("s_nationkey")), F.lit(".M"), c(s % 60))
    statements = table(spark, sf_dir, "supplier").select(F.concat(F.lit("x/"), c(s), F.lit(".xml")).alias("path"), namespace.alias("namespace"), F.concat(F.lit("find"), c(s % 4)).alias("id"), (s % 90).cast("int").alias("start_line"), (s % 90 + 4).cast("int").alias("end_line"))
    return trace.mapper_methods(statements, own).select("file", "name", "start_line", "interface", "arity")


@query(f"""WITH {METHODS_SQL}, r AS (SELECT o_orderkey AS seq, CASE WHEN o_orderpriority < '3' THEN 'GET' ELSE 'POST' END AS verb, '/r' || o_orderkey AS route, 'O' || (o_custkey % 9) AS owner, 'm' || (o_orderkey % 60) AS name FROM orders),
f AS (SELECT owner, name, arg_min(verb || ' ' || route, seq) AS by FROM r GROUP BY ALL), k AS (SELECT m.*, p.p_type = 'PROMO' AS proved FROM methods m JOIN part p ON p.p_partkey = m.method_id)
SELECT k.method_id, CASE WHEN proved THEN 'mark' ELSE f.by END AS reason, proved OR f.by IS NOT NULL AS proof FROM k LEFT JOIN f ON k.owner = f.owner AND k.name = f.name""")
def route_link(spark, sf_dir):
    proved = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("method_id"), (F.col("p_type") == "PROMO").alias("entry_definitive")).withColumn("entry_reason", F.when(F.col("entry_definitive"), "mark"))
    o, c = F.col("o_orderkey"), lambda x: x.cast("string")
    verb = F.when(F.col("o_orderpriority") < "3", "GET").otherwise("POST")
    routes = table(spark, sf_dir, "orders").select(o.alias("seq"), verb.alias("verb"), F.concat(F.lit("/r"), c(o)).alias("route"), F.concat(F.lit("O"), c(F.col("o_custkey") % 9)).alias("class_name"), F.concat(F.lit("m"), c(o % 60)).alias("action"))
    met = trace.routed(methods(spark, sf_dir).join(proved, "method_id"), routes)
    return met.select("method_id", F.col("entry_reason").alias("reason"), F.col("entry_definitive").alias("proof"))


_SITES_SQL = "sites AS (SELECT o_orderkey AS call_id, o_custkey % 50 AS file, CAST(1 + o_orderkey % 60 AS INT) AS line FROM orders)"


@query(f"""WITH {METHODS_SQL}, {_SITES_SQL}, e AS (SELECT c_custkey AS entry_id, c_custkey % 50 AS file, 'm' || (c_custkey % 40) AS name, CAST(1 + c_custkey % 60 AS INT) AS a, CAST(3 + c_custkey % 60 AS INT) AS b, c_mktsegment AS reason FROM customer),
f AS (SELECT e.entry_id, arg_min(m.method_id, m.seq) AS method_id FROM e LEFT JOIN methods m ON e.file = m.file AND e.name = m.name AND e.a BETWEEN m.start_line AND m.end_line GROUP BY 1),
p AS (SELECT e.*, coalesce(CAST(f.method_id AS VARCHAR), 'entry#' || e.entry_id) AS node, f.method_id IS NOT NULL AS known FROM e JOIN f ON e.entry_id = f.entry_id)
SELECT 'method' AS kind, node AS id, arg_max(reason, entry_id) AS value FROM p GROUP BY node UNION ALL
SELECT 'call', CAST(s.call_id AS VARCHAR), arg_max(p.node, p.entry_id) FROM sites s JOIN p ON s.file = p.file AND s.line BETWEEN p.a AND p.b GROUP BY s.call_id""")
def synthetic_entries(spark, sf_dir):
    c = F.col("c_custkey")
    made = table(spark, sf_dir, "customer").select(c.alias("entry_id"), (c % 50).alias("file"), F.concat(F.lit("m"), (c % 40).cast("string")).alias("name"), (1 + c % 60).cast("int").alias("start_line"), (3 + c % 60).cast("int").alias("end_line"), F.col("c_mktsegment").alias("reason"))
    own = methods(spark, sf_dir).withColumn("method_id", F.col("method_id").cast("string")).withColumn("entry_reason", F.lit(None).cast("string")).withColumn("entry_definitive", F.lit(False))
    sites = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), (F.col("o_custkey") % 50).alias("file"), (1 + F.col("o_orderkey") % 60).cast("int").alias("line"), F.lit(None).cast("string").alias("caller_id"))
    marked, calls = trace.with_synthetic(own, made, sites)
    found = marked.where("entry_definitive").select(F.lit("method").alias("kind"), F.col("method_id").alias("id"), F.col("entry_reason").alias("value"))
    return found.unionByName(calls.where("caller_id IS NOT NULL").select(F.lit("call").alias("kind"), F.col("call_id").cast("string").alias("id"), F.col("caller_id").alias("value")))


@query(f"""WITH {METHODS_SQL} SELECT target, count(*) AS n FROM (SELECT CASE WHEN o.o_orderstatus = 'F' THEN 'given' WHEN EXISTS (SELECT 1 FROM methods m WHERE m.owner <> '' AND m.owner = 'O' || (o.o_custkey % 9) AND m.name = 'm' || (o.o_orderkey % 45) AND m.arity = o.o_orderkey % 4) THEN 'O' || (o.o_custkey % 9) END AS target FROM orders o) GROUP BY target""")
def implicit_members(spark, sf_dir):
    o, c = F.col("o_orderkey"), lambda x: x.cast("string")
    sites = table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), c(o % 45)).alias("callee"), (o % 4).cast("int").alias("arity"), F.concat(F.lit("O"), c(F.col("o_custkey") % 9)).alias("caller_owner"), F.when(F.col("o_orderstatus") == "F", "given").alias("target_owner"))
    return trace.qualified_members(sites, methods(spark, sf_dir)).groupBy(F.col("target_owner").alias("target")).agg(F.count(F.lit(1)).alias("n"))


_BODIES_SQL = """m AS (SELECT p_partkey AS method_id, 'n' || (p_partkey % 1700) AS name, CAST(p_size % 2 AS INT) AS arity, CASE p_type WHEN 'SMALL' THEN 'boolean' ELSE 'String' END AS return_type FROM part),
one AS (SELECT name, arity, min(method_id) AS callee_id FROM m GROUP BY 1, 2 HAVING count(*) = 1),
c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_partkey AS caller_id, 'n' || (l_suppkey * 17 % 1700) AS callee, CAST(l_linenumber % 2 AS INT) AS arity, CAST(l_quantity AS INT) AS line FROM lineitem),
s AS (SELECT p_partkey AS sink_id, p_partkey AS method_id, CAST(20 + p_size AS INT) AS line FROM part),
near AS (SELECT s.sink_id, one.callee_id, s.line - c.line AS d, c.call_id FROM s JOIN c ON s.method_id = c.caller_id AND c.line <= s.line JOIN one ON one.name = c.callee AND one.arity = c.arity WHERE one.callee_id <> s.method_id),
once AS (SELECT sink_id, callee_id, min(d * 10000000000 + call_id) AS key FROM near JOIN m ON m.method_id = callee_id WHERE return_type <> 'boolean' GROUP BY 1, 2)"""


@query(f"""WITH {_BODIES_SQL} SELECT * FROM (SELECT sink_id, callee_id, row_number() OVER (PARTITION BY sink_id ORDER BY key) AS place, greatest(count(*) OVER (PARTITION BY sink_id) - 3, 0) AS more FROM once) WHERE place <= 3""")
def callee_bodies(spark, sf_dir):
    k = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select(k.alias("method_id"), F.concat(F.lit("n"), (k % 1700).cast("string")).alias("name"), (F.col("p_size") % 2).cast("int").alias("arity"), F.when(F.col("p_type") == "SMALL", "boolean").otherwise("String").alias("return_type"))
    sites = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("l_partkey").alias("caller_id"), F.concat(F.lit("n"), (F.col("l_suppkey") * 17 % 1700).cast("string")).alias("callee"), (F.col("l_linenumber") % 2).cast("int").alias("arity"), F.col("l_quantity").cast("int").alias("line"))
    sinks = table(spark, sf_dir, "part").select(k.alias("sink_id"), k.alias("method_id"), (20 + F.col("p_size")).cast("int").alias("line"))
    return trace.callee_bodies(sinks, sites, own).select("sink_id", "callee_id", F.col("place").cast("long").alias("place"), F.col("more").cast("long").alias("more"))


@query("""WITH e AS (SELECT event_id, user_id % 20 AS scan_id, ts AS began, ts + INTERVAL 3 HOUR AS ended FROM events WHERE event_type = 'signup'), l AS (SELECT event_id AS seq, ts, event_type = 'error' AS server FROM events)
SELECT l.seq, (SELECT max_by(e.scan_id, (e.began, e.scan_id)) FROM e WHERE NOT l.server AND l.ts >= e.began AND l.ts < e.ended) AS scan_id FROM l""")
def scan_tagging(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    spans = rows.where("event_type = 'signup'").select((F.col("user_id") % 20).alias("scan_id"), F.col("ts").alias("began"), (F.col("ts") + F.expr("INTERVAL 3 HOUR")).alias("ended"))
    log = rows.select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("line"), (F.col("event_type") == "error").alias("server"))
    return live.tagged(log, spans).select("seq", "scan_id")


@query("""SELECT record_id, min(seq) AS seq, arg_min(line, seq) AS line FROM (SELECT user_id AS record_id, event_id AS seq, event_type || ' /' || CASE WHEN value > 50 THEN 'log' ELSE 'scan' END AS line FROM events) WHERE line NOT LIKE '%/log%' GROUP BY record_id""")
def record_dedup(spark, sf_dir):
    line = F.concat("event_type", F.lit(" /"), F.when(F.col("value") > 50, "log").otherwise("scan"))
    return live.without_repeats(table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), line.alias("line")), "/log")


@query("""WITH l AS (SELECT user_id % 300 AS scan_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'pause' WHEN 'click' THEN 'resume' WHEN 'error' THEN CASE WHEN value > 90 THEN 'cancel' ELSE 'pause' END END AS action FROM events)
SELECT scan_id, seq, CASE WHEN ended THEN 'end' WHEN last = 'pause' THEN 'wait' ELSE 'go on' END AS does FROM (SELECT *, bool_or(coalesce(action = 'cancel', false)) OVER w AS ended, last_value(CASE WHEN action IN ('pause', 'resume') THEN action END IGNORE NULLS) OVER w AS last FROM l WINDOW w AS (PARTITION BY scan_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE action IS NULL""")
def pause_and_cancel(spark, sf_dir):
    kind = F.col("event_type")
    action = F.when(kind == "signup", "pause").when(kind == "click", "resume").when(kind == "error", F.when(F.col("value") > 90, "cancel").otherwise("pause"))
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 300).alias("scan_id"), F.col("event_id").alias("seq"), action.alias("action"))
    return live.stopped_at(log.where("action IS NULL"), log.where("action IS NOT NULL"))


@query("SELECT event_id, greatest(CAST(floor(epoch(TIMESTAMP '2024-06-01 00:00:00') - epoch(ts)) AS BIGINT), 0) AS seconds FROM events")
def stage_elapsed(spark, sf_dir):
    seconds = live.elapsed_seconds(F.col("ts"), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", seconds.alias("seconds"))


@query("""SELECT event_id, n = 3 OR event_type = 'error' OR regexp_matches(props, '(^|[^0-9])429($|[^0-9])') AS limited FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 7 AS n FROM events)""")
def rate_limited(spark, sf_dir):
    n = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 7
    kind = F.when(F.col("event_type") == "error", "Rate_Limit_Error").otherwise("ValueError")
    return table(spark, sf_dir, "events").select("event_id", verification.is_rate_limited(F.when(n == 3, 429).otherwise(200), kind, F.col("props")).alias("limited"))


@query(f"""WITH {FINDINGS_SQL} SELECT seq, CASE WHEN verification_mode = 'static' THEN 'yes' WHEN sink_line = 11 AND verdict = 'failed' THEN 'unverified' ELSE 'no' END AS verdict FROM findings""")
def verify_halt(spark, sf_dir):
    """The model gives out on some prompts, which halts the first run: how many of the others were asked before depends on the tasks. A second run takes what the
    first one was told and asks the rest, so all have a verdict but those on which the model gives out."""
    ask = lambda p: None if p.endswith("stop") else '```json\n{"reachable": "no"}\n```'
    rows = findings(spark, sf_dir).select("seq", F.concat(F.lit("q"), F.col("seq").cast("string"), F.when((F.col("sink_line") == 11) & (F.col("verdict") == "failed"), F.lit(" stop")).otherwise("")).alias("prompt"), "verification_mode", F.lit("HIGH").alias("rule_confidence"))
    cache = verification.ReplyCache(spark, scratch(spark, "halt-replies"))
    halted, _ = verification.verified_with_cache(rows, ask, "stub", cache, blocks=1)
    stops = F.col("prompt").endswith("stop")
    resumed, _ = verification.verified_with_cache(rows.where(~stops), ask, "stub", cache, blocks=1)
    every = halted.where(stops).select("seq", "finding").unionByName(resumed.select("seq", "finding"))
    return every.select("seq", verdicts.verdict_of(F.col("finding")).alias("verdict"))


@query("""SELECT conv_id, turn, coalesce(regexp_matches(text, '[一-鿿]'), false) AS zh, CASE role WHEN 'user' THEN false ELSE trim(text) <> '' AND NOT (h > 0 AND h / (h + l) >= 0.15) END AS valid FROM (SELECT *, length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) AS h, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS l FROM conversations)""")
def translation_valid(spark, sf_dir):
    reply = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("other")))).otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("reasoning"))), F.lit("\n```")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", verification.is_language(F.col("text"), "zh").alias("zh"), verification.valid_translation(reply, ["reasoning"], "en").alias("valid"))


@query(f"{_GRADED_SQL} SELECT seq, risk_level FROM graded WHERE verdict = 'yes' AND risk_level = 'critical' AND sink_file LIKE 'src/m1/%'")
def report_filters(spark, sf_dir):
    rows = _graded(spark, sf_dir).withColumn("sink_file", F.when(F.startswith("sink_file", F.lit("src/m1/")), "src/m1").otherwise(F.col("sink_file")))
    return verdicts.selected(rows, verdict="yes", file="src/m1", risk_level="critical").select("seq", "risk_level")


@query(f"WITH {FINDINGS_SQL} SELECT seq, rule_id FROM findings ORDER BY seq LIMIT 100")
def first_findings(spark, sf_dir):
    return verdicts.first_findings(findings(spark, sf_dir), 100).select("seq", "rule_id")


@query("""WITH n AS (SELECT 'type' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY user_id)
SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 5 AS shown, count(*) OVER (PARTITION BY facet) AS of FROM n""")
def facet_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("user"))
    return verdicts.facet_pages(verdicts.facets(rows, ["type", "user"])).select("facet", "value", "n", F.col("rank").cast("long").alias("rank"), "shown", F.col("of").cast("long").alias("of"))


@query("SELECT doc_id AS seq, coalesce(CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END, 'unverified') AS verdict, coalesce(CAST(toxic AS INT), -1) AS confidence FROM documents LEFT JOIN labels USING (doc_id)")
def persisted_findings(spark, sf_dir):
    told = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").alias("verdict"), F.col("toxic").cast("int").alias("confidence"), F.lit("").alias("reasoning"))
    return verdicts.persisted(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq")), told).select("seq", "verdict", F.coalesce("confidence", F.lit(-1)).alias("confidence"))


@query("""SELECT o_orderkey, regexp_full_match(o_orderpriority, '[A-Za-z_$][A-Za-z0-9_$]{2,63}') OR o_orderstatus = 'F' AS named FROM orders""")
def identifier_literals(spark, sf_dir):
    word = F.when(F.col("o_orderstatus") == "F", "handle_request").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.is_identifier(word).alias("named"))


@query(f"WITH {FINDINGS_SQL} SELECT seq, CASE WHEN seq % 5 = 0 THEN rule_id ELSE array_to_string(rule_ids, ',') END AS rules FROM findings")
def merged_rule_ids(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumn("rule_ids", F.when(F.col("seq") % 5 == 0, F.array(F.lit(""))).otherwise(F.concat("rule_ids", F.array(F.lit("  ")))))
    return rows.select("seq", F.array_join(statistics.rule_ids_of(F.col("rule_ids"), F.col("rule_id")), ",").alias("rules"))


@query(f"WITH {METHODS_SQL} SELECT method_id, '| ' || rpad(name, 8, ' ') || ' | ' || lpad(CAST(arity AS VARCHAR), 4, ' ') || ' |' AS line FROM methods")
def console_rows(spark, sf_dir):
    return methods(spark, sf_dir).select("method_id", text.console_row([(F.col("name"), -8), (F.col("arity").cast("string"), 4)]).alias("line"))


@query("""SELECT supp, n_callers FROM (SELECT s_suppkey AS supp, count(DISTINCT e.caller) AS n_callers FROM supplier JOIN (SELECT DISTINCT x.l_partkey AS caller, y.l_suppkey AS supp FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1) e ON e.supp = s_suppkey GROUP BY s_suppkey)""")
def supplier_callers(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nxt = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("supp"))
    sites = items.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("supp").cast("string").alias("callee"), F.lit(0).alias("arity"), F.col("l_partkey").alias("caller_id"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("method_id"), F.col("s_suppkey").cast("string").alias("name"), F.lit(0).alias("arity"))
    return graph.caller_counts(sites, own).select(F.col("method_id").alias("supp"), "n_callers")


@query("""WITH c AS (SELECT n_nationkey, 'C' || n_nationkey AS owner, 'R' || n_regionkey AS parent FROM nation), m AS (SELECT s_suppkey, s_nationkey FROM supplier)
SELECT 'src/N' || c.n_nationkey || '.java' AS path, 'm' || m.s_suppkey AS name, c.owner, c.parent || ',I' || c.n_nationkey AS supertypes, 'String' AS return_type, 'int,List' AS parameter_types, 'a,b' AS parameter_names FROM m JOIN c ON m.s_nationkey = c.n_nationkey""")
def index_types(spark, sf_dir):
    c = lambda x: F.col(x).cast("string")
    body = F.concat(F.lit("  public String m"), c("s_suppkey"), F.lit("(final int a, @X List<String> b) {\n    return a(\"}\");\n  }"))
    made = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(body)), "\n").alias("b"))
    met = made.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    head = F.concat(F.lit("package p;\n@Y class C"), c("n_nationkey"), F.lit("<T> extends R"), c("n_regionkey"), F.lit("<T> implements q.I"), c("n_nationkey"), F.lit(" {\n"))
    files = met.select(F.concat(F.lit("src/N"), c("n_nationkey"), F.lit(".java")).alias("path"), F.lit("java").alias("lang"), F.concat(head, "b", F.lit("\n}\n")).alias("text"))
    found, _ = indexing.index(files)
    bare = F.transform("parameter_types", lambda t: F.regexp_replace(t, "<.*", ""))
    return found.select("path", "name", "owner", F.array_join("owner_supertypes", ",").alias("supertypes"), "return_type", F.array_join(bare, ",").alias("parameter_types"), F.array_join("parameter_names", ",").alias("parameter_names"))


@query("""SELECT DISTINCT user_id AS file, x AS literal FROM (SELECT user_id, unnest([event_type, 'on_' || event_type]) AS x FROM events)""")
def string_literals(spark, sf_dir):
    body = F.concat(F.lit('run("'), F.col("event_type"), F.lit("\", 'on_"), F.col("event_type"), F.lit("', \"a b\", \"ab\");"))
    files = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path")).agg(F.array_join(F.array_sort(F.collect_set(body)), "\n").alias("text"))
    return indexing.literals_of(files)


# Statements with the rest of their file, the rule that finds them, and whether its checks pass.
_CPP_CASES = (
    ("strcpy(a, b);", "", "CPP001", True), ("strcpy(a, b);", "char *strcpy(char *a, char *b) {", "CPP001", False), ("std::memcpy(to, from, 9);", "char to[8];", "CPP004", True),
    ("memcpy(to, from, 8);", "char to[8];", "CPP004", False), ("delete p;", "char *p = new char[4];", "CPP005", True), ("delete[] p;", "char *p = new char[4];", "CPP005", False),
    ("delete q;", "T *make() { return new T[2]; }\nT *q = make();", "CPP005", True), ("delete r;", "T *r = other();", "CPP005", False), ("x->run();", "T *x = nullptr;", "CPP006", True),
    ("x->run();", "T *x = nullptr;\nx = make();", "CPP006", False), ('api_token = "abc";', "", "CPP007", True), ("api_token = read();", "", "CPP007", False),
    ("chmod(path, 0666);", "", "CPP008", True), ("chmod(path, 0640);", "", "CPP008", False), ("tmpnam(name);", "", "CPP008", True), ("return system(line);", "", "CPP002", True),
)
_CPP_SQL = "CASE o_orderkey % 16 " + " ".join(f"WHEN {k} THEN '{rule}'" for k, (_, _, rule, right) in enumerate(_CPP_CASES) if right) + " END"


@query(f"SELECT o_orderkey, rule_id FROM (SELECT o_orderkey, {_CPP_SQL} AS rule_id FROM orders) WHERE rule_id IS NOT NULL")
def cpp_validators(spark, sf_dir):
    k, rest, statement = F.col("o_orderkey") % len(_CPP_CASES), F.lit(""), F.lit("")
    for n, (s, t, _, _) in enumerate(_CPP_CASES):
        rest, statement = F.when(k == n, t).otherwise(rest), F.when(k == n, s).otherwise(statement)
    files = spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("path"), F.lit("cpp").alias("lang"), F.concat(rest, F.lit("\nvoid use() {\n  "), statement, F.lit("\n}\n")).alias("text"))
    hits = rules.scan(context.lines_of(files, "lang"), rules.rule_table(spark)).where("line_no > 1")
    uses = hits.where(~F.col("statement").rlike(r"^\*"))
    return rules.validated(uses, files).select(F.col("path").alias("o_orderkey"), "rule_id")


# Statements of a method, and the rule that finds the second line of the method.
_JAVA_CASES = (
    ('String[] v = {"/bin/sh", "-c", line};\n    new ProcessBuilder(v).start();', "java-shell-command"), ('String[] v = {"/bin/ls", "-c", line};\n    new ProcessBuilder(v).start();', None), ('String[] v = {"sh", "-c", line};\n    new ProcessBuilder(w).start();', None),
    ('line = "ls";\n    run.exec(new String[] {"sh", "-c", line});', None), ('int n = 1;\n    run.exec(new String[] {"sh", "-c",\n      line + n});', "java-shell-command"), ('{ List<String> v = Arrays.asList("sh", "-c", line); }\n    new ProcessBuilder(v);', None),
    ('String p = String.format("%s/x", line);\n    Paths.get(p);', "java-file-path"), ('String p = root + "x";\n    Paths.get(p);', None), ('StringBuilder b = new StringBuilder(root); b.append(line); String p = b.toString();\n    Paths.get(p);', "java-file-path"), ("int n = 2;\n    new File(root + NAME);", None),
    ('URL u = new URL("http://" + line);\n    u.close();', None), ('String s = "http://" + line + "/x"; URL u = new URL(s);\n    u.openStream();', "java-request-url"), ("InputStream in = request.getInputStream();\n    u.unmarshal(in);", "java-xml-unmarshal"), ("InputStream in = file.open();\n    u.unmarshal(in);", None),
    ('int n = 3;\n    f.setFeature("http://xml.org/sax/features/external-general-entities", false);', "java-xml-entities"),
    ('f.setFeature("http://apache.org/xml/features/disallow-doctype-decl", true);\n    f.setFeature("http://xml.org/sax/features/external-general-entities", false);', None), ('// go\n    r.setHeader("Location", target);', "java-location-header"), ("// go\n    /* sendRedirect(target); */", None),
)
_JAVA_SQL = f"CASE o_orderkey % {len(_JAVA_CASES)} " + " ".join(f"WHEN {k} THEN '{rule}'" for k, (_, rule) in enumerate(_JAVA_CASES) if rule) + " END"


@query(f"SELECT o_custkey AS path, CAST(3 * n AS INT) AS line_no, rule_id FROM (SELECT o_custkey, {_JAVA_SQL} AS rule_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE rule_id IS NOT NULL AND n > 0")
def java_statement_rules(spark, sf_dir):
    """A class for each customer and a method of two statements for each order; the second one begins on each third line."""
    k, body = F.col("o_orderkey"), F.lit("")
    for n, (s, _) in enumerate(_JAVA_CASES):
        body = F.when(k % len(_JAVA_CASES) == n, s.replace(",\n", ",")).otherwise(body)
    method = F.concat(F.lit("void m"), k.cast("string"), F.lit("(String line) { "), body, F.lit(" }\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, method.alias("t")))), lambda x: x["t"]), "\n")
    files = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.concat(F.lit("class A {\n"), text, F.lit("}\n")).alias("text")).withColumn("lang", F.lit("java"))
    lines = context.lines_of(indexing.masked(files, False), "lang")
    found = matching.statement_hits(spans.tracked(files)).select("path", "line_no", "rule_id").unionByName(rules.scan(rules.statements_of(lines), rules.statement_rules(spark)).select("path", "line_no", "rule_id"))
    return found


_SPANS_SQL = """s AS (SELECT l_orderkey AS path, l_linenumber AS pos, l_linenumber AS end_pos, l_linenumber + CAST(l_quantity AS INT) % 5 AS block_end, l_partkey % 20 // 10 AS method_pos, l_suppkey % 3 AS v, l_returnflag AS kind FROM lineitem)"""


def _line_spans(spark, sf_dir):
    """Lines of an order as spans of a file: returned ones are assignments that hold for some lines, open ones uses, accepted ones assignments of a literal."""
    n = F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), n.alias("pos"), n.alias("end_pos"), (n + F.col("l_quantity").cast("int") % 5).alias("block_end"), F.floor(F.col("l_partkey") % 20 / 10).alias("method_pos"),
        (F.col("l_suppkey") % 3).alias("v"), F.col("l_returnflag").alias("kind"),
    )


@query(f"""WITH {_SPANS_SQL} SELECT h.path, h.pos, h.v FROM s h WHERE kind = 'N'
AND EXISTS (SELECT 1 FROM s d WHERE d.kind = 'R' AND d.path = h.path AND d.v = h.v AND d.end_pos < h.pos AND h.pos <= d.block_end)
AND NOT EXISTS (SELECT 1 FROM s d WHERE d.kind = 'A' AND d.path = h.path AND d.v = h.v AND d.end_pos < h.pos AND h.pos <= d.block_end)""")
def matched_inside(spark, sf_dir):
    every = _line_spans(spark, sf_dir)
    of = lambda kind: every.where(F.col("kind") == kind).drop("kind")
    return matching.not_inside(matching.inside(of("N"), of("R"), "v"), of("A"), "v").select("path", "pos", "v")


@query(f"""WITH {_SPANS_SQL} SELECT h.path, h.pos, h.v FROM s h WHERE kind = 'R' AND NOT EXISTS (SELECT 1 FROM s d WHERE d.kind = 'A' AND d.path = h.path AND d.v = h.v AND d.method_pos = h.method_pos)""")
def matched_by_method(spark, sf_dir):
    every = _line_spans(spark, sf_dir)
    of = lambda kind: every.where(F.col("kind") == kind).drop("kind")
    return matching.not_in_method_of(of("R"), of("A"), "v").select("path", "pos", "v")


@query("""WITH RECURSIVE a AS (SELECT l_orderkey AS path, l_linenumber AS pos, 'n' || (l_partkey % 6) AS name, CASE WHEN l_suppkey % 4 = 0 THEN 'nullptr' WHEN l_suppkey % 4 = 1 THEN '"lit' || (l_suppkey % 9) || '"' ELSE 'n' || (l_suppkey % 7) END AS value FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)),
q AS (SELECT path, pos, name FROM a),
w AS (SELECT path, pos, name, name AS at, [name] AS seen, CAST(NULL AS VARCHAR) AS value, true AS open FROM q
UNION ALL SELECT w.path, w.pos, w.name, CASE WHEN a.value LIKE 'n%' AND a.value <> 'nullptr' THEN a.value END, list_append(w.seen, a.value), CASE WHEN a.value LIKE 'n%' AND a.value <> 'nullptr' THEN NULL ELSE a.value END, a.value LIKE 'n%' AND a.value <> 'nullptr' AND NOT list_contains(w.seen, a.value)
  FROM w JOIN a ON w.open AND a.path = w.path AND a.name = w.at AND a.pos = (SELECT max(b.pos) FROM a b WHERE b.path = w.path AND b.name = w.at AND b.pos < w.pos))
SELECT path, pos, name, max(value) AS held FROM w GROUP BY path, pos, name""")
def alias_values(spark, sf_dir):
    """What each name holds right before it is assigned, aliases followed to their ends: lines of an order as the assignments of a file."""
    s = F.col("l_suppkey")
    value = F.when(s % 4 == 0, "nullptr").when(s % 4 == 1, F.concat(F.lit('"lit'), (s % 9).cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("n"), (s % 7).cast("string")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    assigns = lines.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("pos"), F.concat(F.lit("n"), (F.col("l_partkey") % 6).cast("string")).alias("name"), value.alias("value"))
    return aliases.held(assigns.drop("value"), aliases.resolved(assigns)).select("path", "pos", "name", "held")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'cpp' WHEN 1 THEN CASE WHEN html LIKE '%<script%' THEN 'cpp' END WHEN 2 THEN NULL ELSE 'c' END AS kind FROM pages""")
def header_gate(spark, sf_dir):
    k = F.col("page_id") % 4
    path = F.concat(F.lit("a/f"), F.col("page_id").cast("string"), F.when(k == 0, ".HPP").when(k == 1, ".h").when(k == 2, ".txt").otherwise(".h"))
    code = F.when((k == 1) & F.contains("html", F.lit("<script")), "// c\nnamespace x {}").otherwise('/* class A; */ const char *s = "template";\nint f(int a);')
    files = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), code.alias("text"))
    kinds = readers.c_family(files).select("path", "kind")
    return files.join(kinds, "path", "left").select("page_id", F.when((k == 1) & (F.col("kind") == "c"), None).otherwise(F.col("kind")).alias("kind"))


@query("""SELECT doc_id, hex(encode(text)[11:30]) AS bytes, CASE WHEN octet_length(encode(text)) < 30 THEN '' ELSE 'x' END AS some FROM documents WHERE text IS NOT NULL""")
def matched_source(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    part = candidates.matched_bytes(F.col("content"), F.lit(10), F.lit(30))
    some = F.when(F.length(F.coalesce(candidates.matched_source(F.col("content"), F.lit(10), F.lit(30)), F.lit(""))) > 0, "x").otherwise("")
    return files.select("doc_id", F.hex(part).alias("bytes"), F.when(F.octet_length("content") < 30, "").otherwise(some).alias("some"))


@query(f"""{_GRADED_SQL} SELECT f.report_id, count(*) AS total, count(*) FILTER (WHERE g.verdict = 'yes') AS reachable, count(*) FILTER (WHERE g.risk_level = 'critical') AS critical FROM graded g JOIN findings f ON g.seq = f.seq GROUP BY f.report_id""")
def report_headers(spark, sf_dir):
    heads = reports.headers(_graded(spark, sf_dir), "project")
    parsed = F.from_json("header", "project string, summary struct<total: bigint, reachable: bigint>, risk struct<critical: bigint>")
    return heads.select("report_id", parsed.alias("h")).select("report_id", "h.summary.total", "h.summary.reachable", "h.risk.critical")


@query(f"""{_GRADED_SQL} SELECT g.seq, md5('<article class="card" data-verdict="' || g.verdict || '" data-risk="' || g.risk_level || '"><h3>' || replace(f.sink_file, '&', '&amp;') || ':' || f.sink_line || '</h3><p>' || f.message || '</p><p>' || printf('%.1f', g.score) || '</p></article>') AS card FROM graded g JOIN findings f ON g.seq = f.seq""")
def html_cards(spark, sf_dir):
    return reports.html_cards(_graded(spark, sf_dir)).select("seq", F.md5("card").alias("card"))


@query("SELECT event_type AS key, CASE event_type WHEN 'view' THEN 'Reachable' WHEN 'click' THEN 'Not reachable' ELSE 'Uncertain' END AS en, count(*) AS n FROM events GROUP BY event_type")
def report_labels(spark, sf_dir):
    key = F.when(F.col("event_type") == "view", "filters.yes").when(F.col("event_type") == "click", "filters.no").otherwise("filters.uncertain")
    rows = table(spark, sf_dir, "events").withColumn("path", key)
    met = rows.join(F.broadcast(reports.labels(spark).where("lang = 'en'")), "path")
    return met.groupBy(F.col("event_type").alias("key"), F.col("label").alias("en")).agg(F.count(F.lit(1)).alias("n"))


def _order_files(spark, sf_dir, lang, head, line, tail):
    """A file for each order: a head, a text for each of its lines in order, and a tail."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("l"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus").join(lines, "l_orderkey")  # an order has a few lines
    body = F.concat(head, F.array_join(F.transform("l", line), ""), F.lit(tail))
    return orders.select(F.col("l_orderkey").cast("string").alias("path"), F.lit(lang).alias("lang"), body.alias("text"))


@query("""WITH o AS (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
a(action, verb, tail, only_, but_) AS (VALUES ('index', 'GET', '', true, true), ('create', 'POST', '', false, true), ('new', 'GET', '/new', false, false), ('edit', 'GET', '/:id/edit', false, true), ('show', 'GET', '/:id', true, true), ('update', 'PATCH', '/:id', false, true), ('destroy', 'DELETE', '/:id', false, false))
SELECT o_orderkey, verb, '/old_orders' || o_orderkey || tail AS route, 'OldOrders' || o_orderkey || 'Controller' AS class_name, action FROM o, a WHERE CASE o_orderstatus WHEN 'F' THEN only_ WHEN 'O' THEN but_ ELSE true END
UNION ALL SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'POST' ELSE 'GET' END, '/p/' || l_partkey, 'Part' || (l_partkey % 10) || 'Controller', 'm' || l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) AND l_returnflag <> 'N'""")
def declared_routes(spark, sf_dir):
    c = lambda x: x.cast("string")
    narrowed = F.when(F.col("o_orderstatus") == "F", ", only: [:index,\n  :show]").when(F.col("o_orderstatus") == "O", ", except: [:new, :destroy] do").otherwise("")
    head = F.concat(F.lit("resources :old_orders"), c(F.col("l_orderkey")), narrowed, F.lit("\n"))
    verb = lambda x: F.when(x.l_returnflag == "R", "  post '/p/").otherwise("  get '/p/")
    line = lambda x: F.concat(verb(x), c(x.l_partkey), F.lit("',\n    to: 'part"), c(x.l_partkey % 10), F.lit("#m"), c(x.l_linenumber), F.lit("'\n"))
    commented = lambda x: F.when(x.l_returnflag == "N", F.concat(F.lit("  # get '/p/"), c(x.l_partkey), F.lit("', to: 'part#no'\n"))).otherwise(line(x))
    found = routes.declared_routes(_order_files(spark, sf_dir, "ruby", head, commented, "end\n"))
    return found.select(F.col("path").cast("long").alias("o_orderkey"), "verb", "route", "class_name", "action")


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT l_orderkey AS o_orderkey, CASE WHEN l_returnflag = 'R' THEN 'DELETE' ELSE 'GET' END AS verb, '/o' || l_orderkey || '/l' || l_linenumber || '/{p' || l_partkey || '}' AS route, CAST(3 * n AS INT) AS start_line, CAST(3 * n + 1 AS INT) AS end_line FROM l""")
def nested_handlers(spark, sf_dir):
    c = lambda x: x.cast("string")
    head = F.concat(F.lit('route("/o'), c(F.col("l_orderkey")), F.lit('") {\n'))
    verb = lambda x: F.when(x.l_returnflag == "R", "delete").otherwise("get")
    line = lambda x: F.concat(F.lit('  route("/l'), c(x.l_linenumber), F.lit('") { // {\n    '), verb(x), F.lit('("/{p'), c(x.l_partkey), F.lit('}") {\n      call("}") } }\n'))
    found = routes.nested_handlers(_order_files(spark, sf_dir, "kotlin", head, line, "}\n"))
    return found.select(F.col("path").cast("long").alias("o_orderkey"), "verb", "route", "start_line", "end_line")

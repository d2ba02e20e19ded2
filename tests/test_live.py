"""Streams against their batch forms, last values over a long log, the halt across tasks, the cache of replies, spans and matches."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from sinktrace.jobs import scan
from sinktrace.operators import aliases, graph, matching, spans, verification
from sinktrace.streaming import events

START = dt.datetime(2024, 1, 1)


def streamed(spark, tmp_path, name, frames, transform):
    """The rows that a stream over the frames, one file each, gives at its end."""
    folder = str(tmp_path / name)
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = transform(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_sessions_on_a_stream_are_those_of_the_table(spark, tmp_path):
    r = random.Random(8)
    rows = [(r.randrange(4), k, START + dt.timedelta(seconds=7 * k + r.randrange(-20, 20)), r.random() < 0.25) for k in range(120)]
    schema = "client long, seq long, ts timestamp, closing boolean"
    last = [(9, 1000, START + dt.timedelta(days=1), False), (9, 1001, START + dt.timedelta(days=2), False)]
    frames = [spark.createDataFrame(part, schema) for part in (rows[:40], rows[40:80], rows[80:], last[:1], last[1:])]
    got = streamed(spark, tmp_path, "sessions", frames, lambda s: events.stream_sessions(s.withWatermark("ts", "2 minutes")))
    want = sorted(map(tuple, events.heartbeat_sessions(spark.createDataFrame(rows, schema)).select("client", "opened", "deadline", "beats").collect()), key=str)
    assert [x for x in got if x[0] != 9] == want


def test_states_and_stops_on_a_stream_are_those_of_the_table(spark, tmp_path):
    r = random.Random(9)
    rows = [(r.randrange(5), k, r.choice(["queued", "scanning", "paused", "resumed", "verifying", "paused", "resumed", "done" if k > 50 else "indexing"])) for k in range(90)]
    schema = "scan_id long, seq long, status string"
    got = streamed(spark, tmp_path, "states", [spark.createDataFrame(rows[k : k + 30], schema) for k in (0, 30, 60)], events.stream_states)
    last = {}
    for scan_id, _, state in sorted(got, key=lambda x: x[1]):
        last[scan_id] = state
    assert last == {x.scan_id: x.state for x in events.job_states(spark.createDataFrame(rows, schema)).collect()}
    log = [(r.randrange(5), k, r.choice([None, None, "pause", "resume", None, "cancel" if k > 60 else None])) for k in range(90)]
    schema = "scan_id long, seq long, action string"
    got = streamed(spark, tmp_path, "stops", [spark.createDataFrame(log[k : k + 45], schema) for k in (0, 45)], events.stream_stops)
    whole = spark.createDataFrame(log, schema)
    assert got == sorted(map(tuple, events.stopped_at(whole.where("action IS NULL"), whole.where("action IS NOT NULL")).collect()), key=str)


def test_the_last_change_is_carried_over_ranges(spark):
    r = random.Random(2)
    log = [(k, START + dt.timedelta(minutes=r.randrange(3000)), f"l{k}", k % 7 == 0) for k in range(300)]
    found = [(k, START + dt.timedelta(minutes=b), START + dt.timedelta(minutes=b + r.randrange(0, 400))) for k, b in enumerate(r.sample(range(3000), 20))] + [(99, START + dt.timedelta(minutes=2500), None)]
    rows = events.tagged(spark.createDataFrame(log, "seq long, ts timestamp_ntz, line string, server boolean"), spark.createDataFrame(found, "scan_id long, began timestamp_ntz, ended timestamp_ntz")).collect()

    def active(ts):
        on = [(b, k) for k, b, e in found if b <= ts and (e is None or ts < e)]
        return max(on)[1] if on else None

    assert {x.seq: x.scan_id for x in rows} == {k: None if server else active(ts) for k, ts, _, server in log}


def test_after_the_first_giving_up_no_task_asks_again(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def ask(prompt):
        with open(asked, "a") as f:
            f.write("x\n")
        return None if int(prompt[1:]) % 5 == 3 else '{"reachable": "yes"}'

    queue = spark.createDataFrame([(f"k{k}", f"p{k}", k) for k in range(80)], "key string, prompt string, first_seq long").repartition(4, "key")
    found, halted = verification.replies(queue, ask, 1)
    n = len(open(asked).read().split())
    assert halted and found.count() < 20 and n <= found.count() + 4  # each task may have one call under way


def test_a_second_run_asks_nothing(spark, tmp_path):
    cache = verification.ReplyCache(spark, f"file://{tmp_path}/cache")
    rows = spark.createDataFrame([(k, f"p{k % 3}", "dataflow", "HIGH") for k in range(6)], "seq long, prompt string, verification_mode string, rule_confidence string")
    first, halted = verification.verified_with_cache(rows, lambda p: '{"reachable": "no"}', "m", cache, 1)
    assert not halted and {x.finding.reachable for x in first.collect()} == {"no"} and cache.read().count() == 3

    def never(prompt):
        raise AssertionError(prompt)

    again, halted = verification.verified_with_cache(rows, never, "m", cache, 1)
    assert not halted and {x.finding.reachable for x in again.collect()} == {"no"}
    key = cache.read().first().key
    cache.put(spark.createDataFrame([(key, "new")], "key string, reply string"))
    cache.compact()
    assert cache.read().where(F.col("key") == key).first().reply == "new" and cache.read().count() == 3 and len(cache._parts()) == 1
    cache.put(spark.createDataFrame([(key, "newer")], "key string, reply string"))
    assert cache.read().where(F.col("key") == key).first().reply == "newer"


def test_components_and_leaves_are_those_of_a_walk(spark):
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(45)] + [(50, 51), (51, 52), (52, 50), (52, 53), (54, 54)]
    calls = {}
    for a, b in edges:
        if a != b:
            calls.setdefault(b, set()).add(a)

    def back(node):
        seen, todo = {node}, [node]
        while todo:
            for x in calls.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    nodes = {x for e in edges if e[0] != e[1] for x in e}
    reach = {n: back(n) for n in nodes}
    frame = spark.createDataFrame(edges, "caller long, callee long")
    cycles = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes if any(m != n and n in reach[m] for m in reach[n])}
    assert {x.node: x.component for x in graph.condensed(frame).collect()} == cycles
    of, leaves = graph.leaf_components(frame)
    got = {}
    for x in of.join(leaves, "component").collect():
        got.setdefault(x.node, set()).add(x.leaf)
    assert got == {n: ends for n in nodes if (ends := {m for m in reach[n] if m not in calls})}
    pairs = [(a, b) for a, b in edges if a % 3]
    group = {x.node: x.component for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert group.get(n, n) == min(seen)


JAVA = '''package a;
@RequestMapping("/x")
public class C<T> extends Base implements I, J {
  // void nope() { }
  @GetMapping(value = "/y")
  public List<String> find(
      @RequestParam("q") String q,
      Map<String, Integer> m) throws IOException {
    String[] argv = {"/bin/sh", "-c", q};
    new ProcessBuilder(argv).start();
    Thread t = new Thread(new Runnable() {
      public void run() { send(a, "b"); }
    });
    return helper.make(q).get(0);
  }
  C() { super(1); }
}
'''


def test_one_pass_finds_what_spreads_over_lines(spark):
    rows = spans.tracked(spark.createDataFrame([("C.java", "java", JAVA), ("e", "java", None), ("f", "java", "}}) ( {")], "path string, lang string, text string")).where("path = 'C.java'").collect()
    of = lambda kind: {r.name: r for r in rows if r.kind == kind}
    methods = of("method")
    assert set(methods) == {"find", "run", "C"} and methods["find"].args == ['@RequestParam("q") String q', "Map<String, Integer> m"]
    assert (methods["find"].pos >> 20, methods["find"].end_pos >> 20, methods["find"].owner) == (5, 15, "C")
    assert (methods["run"].owner, methods["run"].anonymous, methods["run"].method_pos) == ("Runnable", True, methods["find"].pos)
    assert of("assign")["argv"].args == ['"/bin/sh"', '"-c"', "q"] and of("call")["send"].args == ["a", '"b"'] and of("call")["get"].receiver == "helper.make(q)"
    assert [(x.rule_id, x.line_no) for x in matching.statement_hits(spark.createDataFrame(rows, spans.COLUMNS)).collect()] == [("java-shell-command", 10)]


def test_names_in_a_circle_hold_nothing(spark):
    assigns = spark.createDataFrame([("f", 1, "a", "b"), ("f", 2, "b", "a"), ("f", 3, "c", "d"), ("f", 5, "a", "this"), ("f", 7, "this->a", "1")], "path string, pos long, name string, value string")
    asks = spark.createDataFrame([("f", p, n) for p in (1, 3, 4, 6, 9) for n in "abcx"], "path string, pos long, name string")
    got = {(x.pos, x.name): x.held for x in aliases.held(asks, aliases.resolved(assigns)).collect()}
    assert {k for k, v in got.items() if v} == {(6, "a"), (9, "a"), (6, "b"), (9, "b")} and got[9, "a"] == "1" and got[6, "b"] == "this"


def test_links_and_reasons_reach_the_scan(spark):
    """Controller, mapper interface and mapper file make a chain; a route table makes an entry point; a commented mark and a commented call make nothing."""
    sources = [
        ("web/LogController.java", "java", "class LogController {\n  @GetMapping(\"/l\")\n  public List list(String q) {\n    return logMapper.findLogs(q);\n  }\n  // @PostMapping(\"/z\")\n  void idle(String q) {\n    r.sendRedirect(q);\n  }\n}\n"),
        ("dao/LogMapper.java", "java", "package dao;\npublic interface LogMapper {\n  List findLogs(String q);\n}\n"),
        ("dao/LogMapper.xml", "xml", '<mapper namespace="dao.LogMapper">\n  <select id="findLogs">\n    select * from l order by ${q}\n  </select>\n</mapper>\n'),
        ("app/Users.scala", "scala", "class Users {\n  def show(n: String) = {\n    run(n)\n  }\n}\n"), ("conf/routes", "routes", "GET  /users  controllers.Users.show(n)\n"),
        ("x/a.cpp", "cpp", "void f(char *a) {\n  // strcpy(a, b);\n  strcpy(a, b); /* gets(a) */ gets(a);\n}\n"),
    ]
    prompts = spark.sparkContext.accumulator(0)

    def ask(prompt):
        prompts.add(1)
        return '{"reachable": "%s", "confidence": 80, "reasoning": "r"}' % ("no" if "Nothing calls it." in prompt else "yes")

    frame = spark.createDataFrame(sources, "path string, lang string, text string")
    found, _ = scan.scan(spark, frame, ask, "stub", spark.createDataFrame([], "key string, reply string"))
    rows = {(r.sink_file, r.sink_line): r for r in found.collect()}
    assert set(rows) == {("dao/LogMapper.xml", 3), ("web/LogController.java", 8), ("x/a.cpp", 3)}
    assert "web/LogController.java#list" in rows["dao/LogMapper.xml", 3].chains and rows["dao/LogMapper.xml", 3].hops == 1
    assert rows["web/LogController.java", 8].chains is None and rows["web/LogController.java", 8].verdict == "no"
    methods, _, _ = scan.call_graph(frame)
    marks = {x.node.split("#")[1]: x.reason for x in scan.entry_marks(spark, frame, methods).collect()}
    assert marks == {"list": "request mapping", "show": "GET /users"}

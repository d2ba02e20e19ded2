"""Golden cases of traces, entry marks, indexes, contexts, verdict loops and readers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sinktrace.functions import text
from sinktrace.jobs import reports, scan
from sinktrace.operators import context, entries, indexing, rules, trace, validators, verification
from sinktrace.sources import readers
from sinktrace.storage import discard, materialise, numbered
from sinktrace.streaming import events


def index_of(spark, files):
    frame = spark.createDataFrame(files, "path string, lang string, text string")
    methods, calls = indexing.index(frame)
    return {(r.path, r.name): r for r in methods.collect()}, calls.collect(), frame


def test_traces_tell_proof_from_hints(spark):
    edges = spark.createDataFrame([(2, 1, 1), (3, 2, 2), (4, 1, 3), (6, 5, 4)], "caller long, callee long, seq long")
    starts = spark.createDataFrame([(10, 1), (20, 5), (30, 7), (40, 8), (50, 6)], "sink long, node long")
    marks = spark.createDataFrame([(3, True), (4, False), (5, False), (7, True), (8, False), (6, True)], "node long, definitive boolean")
    found = {(r.sink, r.entry, r.depth) for r in trace.entry_traces(starts, edges, marks).collect()}
    # 1 is reached from 3 (proof) and 4 (hint); 5 has a hint itself but a caller that is an entry; 7 is proved; 8 has a hint and no caller
    assert found == {(10, 3, 2), (10, 4, 1), (20, 6, 1), (30, 7, 0), (40, 8, 0), (50, 6, 0)}


def test_asking_waits_while_busy_and_asks_again_if_it_cannot_read():
    waits, prompts = [], []

    def chat(prompt):
        prompts.append(prompt)
        if len(prompts) < 3:
            raise verification.RateLimited("7" if len(prompts) == 1 else None)
        return "no json" if len(prompts) == 3 else '```json\n{"reachable": "yes"}\n```'

    ask = verification.asker(chat, hint="JSON!", sleep=waits.append)
    assert ask("q") == '```json\n{"reachable": "yes"}\n```' and waits == [7.0, 4.0] and prompts == ["q", "q", "q", "q\n\nJSON!"]

    def busy(_):
        raise verification.RateLimited()

    waits.clear()
    assert verification.asker(busy, sleep=waits.append)("q") is None and waits == [2.0, 4.0, 8.0]
    assert [verification.wait_seconds(2, x) for x in ("3600", "-4", "Wed, 21 Oct 2026 07:28:00 GMT")] == [30.0, 0.0, 2.0]


def test_fenced_replies_are_read(spark):
    replies = [('```json\n{"reachable": "yes", "confidence": 3}\n```', "yes"), ('{"reachable": "no"}', "no"), ("what", "uncertain"), ("", "uncertain")]
    frame = spark.createDataFrame(replies, "r string, e string").withColumn("x", verification.parsed_reply(F.col("r")).getField("reachable"))
    assert all(r.x == r.e for r in frame.collect())


def test_translations_are_judged_when_used(spark):
    rows = [(1, "It is reachable", "Send a request", None), (2, "它可达", None, None), (3, None, "", None), (4, "Not sent", None, None)]
    findings = spark.createDataFrame(rows, "seq long, reasoning string, exploit_scenario string, remediation string")
    asked = []

    def ask(prompt):
        asked.append(prompt)
        given = json.loads(prompt.split("\n", 1)[1])
        return "```json\n" + json.dumps({k: "译文 " + v if "Not" not in v else v for k, v in given.items()}, ensure_ascii=False) + "\n```"

    found, halted = verification.translations(findings, ask, "m", "zh", spark.createDataFrame([], "key string, reply string"))
    got = {r.seq: (r.reasoning_zh, r.exploit_scenario_zh) for r in found.collect()}
    assert not halted and got == {1: ("译文 It is reachable", "译文 Send a request"), 2: ("它可达", None), 3: (None, ""), 4: ("Not sent", None)}


def test_types_owners_and_parameters_by_language(spark):
    methods, calls, _ = index_of(spark, [
        ("A.java", "java", "public class A<T> extends b.Base<T> implements I, J {\n  @X\n  public List<String> f(final Map<String, Integer> m, int... n) {\n    this.g(1);\n  }\n  class In {\n    void g(int a) { }\n  }\n}\n"),
        ("b.py", "python", "class B(Base, m.Other):\n    def f(self, a: int, *rest) -> str:\n        return g(a)\n\ndef g(a):\n    return a\n"),
        ("c.rb", "ruby", "class C < ApplicationController\n  def show\n    if params[:id]\n      run(params[:id])\n    end\n  end\n\n  def run(x)\n    x\n  end\nend\n"),
        ("d.cpp", "cpp", "class D : public Base, private x::Y {\n  int f(const char* a, int b) {\n    return b;\n  }\n};\n"),
        ("e.kt", "kotlin", "class E(val x: Int) : Base(), I {\n  fun f(a: String): Int {\n    return 1\n  }\n}\n"),
        ("h.cs", "csharp", "public class H : Base, IThing {\n  public string F(int a) {\n    return a;\n  }\n}\n"),
    ])
    a = methods["A.java", "f"]
    assert (a.owner, a.owner_supertypes, a.return_type, a.arity, a.start_line, a.end_line) == ("A", ["Base", "I", "J"], "List<String>", -1, 3, 5)
    assert methods["A.java", "g"].owner == "In" and methods["A.java", "g"].parameter_types == ["int"] and methods["A.java", "g"].parameter_names == ["a"]
    assert (methods["b.py", "f"].owner, methods["b.py", "f"].owner_supertypes, methods["b.py", "f"].return_type, methods["b.py", "g"].owner) == ("B", ["Base", "Other"], "str", "")
    c = methods["c.rb", "show"]
    assert (c.owner, c.owner_supertypes, c.start_line, c.end_line, methods["c.rb", "run"].end_line) == ("C", ["ApplicationController"], 2, 6, 10)
    assert methods["d.cpp", "f"].owner_supertypes == ["Base", "Y"] and methods["d.cpp", "f"].parameter_names == ["a", "b"]
    assert methods["e.kt", "f"].owner_supertypes == ["Base", "I"] and methods["e.kt", "f"].parameter_types == ["String"] and methods["e.kt", "f"].return_type == "Int"
    assert methods["h.cs", "F"].owner_supertypes == ["Base", "IThing"] and methods["h.cs", "F"].return_type == "string"
    assert {(r.callee, r.caller, r.receiver_is_self) for r in calls if r.path == "A.java"} == {("g", "f", True)}


def test_entry_marks(spark):
    files = [
        ("A.java", "java", 'class A {\n  @GetMapping("/x")\n\n  // note\n  @One\n  @Two(\n    a = 1)\n  @Three\n  public void far(int a) {\n    b();\n  }\n  @Scheduled\n  void nightly() {\n  }\n}\n'),
        ("S.java", "java", "class S extends HttpServlet {\n  void doGet(Q q) {\n  }\n  void other() {\n  }\n}\n"),
        ("p.php", "php", "function a($x) {\n  return 1;\n}\nfunction b($x) {\n  $y = $_GET['q'];\n}\n"),
        ("r.rb", "ruby", "class R < ApplicationController\n  def index\n    x\n  end\n  def helper\n    x\n  end\nend\n"),
        ("j.js", "javascript", "function show(a) {\n}\nfunction hide(req, res) {\n}\napp.get('/x', guard, show);\n"),
    ]
    methods, _, frame = index_of(spark, files)
    table, _ = indexing.index(frame)
    found = {(r.node.split("#")[0], r.node.split("#")[1]): (r.reason, r.definitive) for r in scan.entry_marks(spark, frame, table).collect()}
    assert found == {("A.java", "far"): ("request mapping", True), ("S.java", "doGet"): ("served type", True), ("p.php", "b"): ("request data", False), ("r.rb", "index"): ("served type", True), ("j.js", "show"): ("route", True), ("j.js", "hide"): ("handler type", False)}
    assert entries.mark_table(spark).count() == len(entries.MARKS)


def test_bodies_and_callers_in_a_prompt(spark):
    code = spark.createDataFrame([("a", ["def top():", "  x = clean(y)", "  z = ok(x)", "  run(x)"]), ("b", ["def clean(y):", *["  line"] * 50])], "file string, l array<string>")
    methods = spark.createDataFrame([("t", "top", 0, "a", 1, 4, "", "route"), ("c", "clean", 1, "b", 1, 51, "str", ""), ("o", "ok", 1, "b", 60, 61, "boolean", "")], "method_id string, name string, arity int, file string, start_line int, end_line int, return_type string, entry_reason string")
    calls = spark.createDataFrame([(1, "t", "clean", 1, 2), (2, "t", "ok", 1, 3), (3, "t", "clean", 1, 9)], "call_id long, caller_id string, callee string, arity int, line int")
    sinks = spark.createDataFrame([(7, "t", 4)], "sink_id long, method_id string, line int")
    bodies = trace.callee_bodies(sinks, calls, methods)
    shown = trace.callee_context(bodies, methods, code).first().callees
    assert shown.startswith("### Methods called on the way to the sink\n\nclean() in b\n    1 | def clean(y):\n") and shown.endswith("\n      | ... 11 more lines ...")
    chains = spark.createDataFrame([(7, 1, 0, 1, "t", ["c", "t"]), (8, 1, 0, 0, "t", ["t"])], "sink long, place int, more int, depth int, entry string, chain array<string>")
    got = {r.sink_id: r.callers for r in trace.caller_context(chains, methods, code).collect()}
    assert "top() at a:1\nEntry point: top() in a, reached via route\n    1 | def top():" in got[7] and got[8] == "### Call path\nThe sink sits directly inside a request handler."
    candidates = spark.createDataFrame([(7, "a", 4, "a", 4), (8, "b", 2, "a", 4)], "seq long, source_file string, source_line int, sink_file string, sink_line int")
    spans = spark.createDataFrame([("a", 4, 1, 4)], "file string, line int, start_line int, end_line int")
    callers = trace.caller_context(chains, methods, code)
    texts = {r.seq: r.context for r in trace.build_context(candidates, spans, code, callers, trace.callee_context(bodies, methods, code)).collect()}
    assert texts[7].startswith("### a (source == sink)\n    1 | def top():") and "### Methods called" in texts[7]
    assert texts[8].startswith("### Source: b\n    1 | def clean(y):") and "### Sink: a\n" in texts[8] and texts[8].endswith("request handler.")


def settled(spark, files, *rule):
    """The statements that the rules find and the checks let pass, in C++ files."""
    frame = spark.createDataFrame([(p, "cpp", t) for p, t in files], "path string, lang string, text string")
    found = rules.validated(rules.scan(context.lines_of(indexing.masked(frame, False), "lang"), rules.rule_table(spark)), frame)
    return sorted((x.path, x.statement) for x in found.where(F.col("rule_id").isin(*rule)).collect())


def test_allocations_are_followed(spark):
    """Deletions of one form of what was made in the other; what isn't known or not of one form passes for right."""
    files = [
        ("a", "void f() { char *q = new char[3]; p = q; delete p; }"), ("b", "void f() { this->p = new T; delete this->p; delete[] this->p; }"), ("c", "A::~A() { delete p; }\nA::A() { p = new T[2]; }"),
        ("d", "void f() { p = new T; p = new T[2]; delete p; delete[] p; }"), ("e", "void drop(T *o, T *p) { delete p; }"), ("f", "void f() {\n  T *x = new T[9];\n  drop(0, x);\n}"), ("g", "void f() { delete p; } // p = new T[2]; delete p;"),
        ("h", "T *make(int n) {\n  return new T[n];\n}\nvoid f() { auto *x = make(3); delete\n x; delete[] x; }"), ("i", "void f() { int *raw = new int[4]; int *alias = raw; delete alias; }"), ("j", "struct X { int *items; X() : n(0) { items = new int[4]; } ~X() { delete items; } };"),
    ]
    assert settled(spark, files, "CPP005") == [("a", "delete p;"), ("b", "delete[] this->p;"), ("c", "delete p;"), ("e", "delete p;"), ("i", "delete alias;"), ("j", "delete items;")]


def test_names_are_followed_to_what_they_hold(spark):
    n = 300
    chain = "void f() {\n T *a0 = nullptr;\n" + "".join(f" T *a{k} = a{k - 1};\n" for k in range(1, n)) + f" a{n - 1}->x(); a{n - 2}->y();\n}}\n"
    files = [
        ("a", "void f() { I *i = NULL; *i; }"), ("b", "void f(I *r) { I *i = nullptr; i = r; *i; }"), ("c", "void f() { I *i = nullptr; I *a = i; a->run(); }"), ("d", "void f() { I *i = nullptr; if (!i) { return; } i->run(); }"),
        ("e", "void f() { a->go(); T *x = static_cast<T *>(nullptr); x->run(); x->run(); /* x->no(); */ }"), ("g", "void f() { x = y; y = x; x->run(); }"), ("h", chain), ("k", "void f() { T *x = 0; if (x == nullptr) throw 1; x->run(); }"),
    ]
    assert settled(spark, files, "CPP006") == [("a", "*i;"), ("c", "a->run();"), ("e", "x->run();"), ("e", "x->run();"), ("h", f"a{n - 2}->y();"), ("h", f"a{n - 1}->x();")]
    secrets = [("a", 'void f() { const char *k = "v"; const char *api_key = k; }'), ("b", "void f() { token = read(); }"), ("c", 'auto password = "x", n = 1; // secret = "y"'), ("d", 'a = "v"; b = a; auth_token = b;')]
    assert settled(spark, secrets, "CPP007") == [("a", "api_key = k;"), ("c", 'password = "x", n = 1;'), ("d", "auth_token = b;")]
    opened = [("a", 'void f() { char *n = tmpnam(0); fopen(n, "w"); fopen(n, "r"); open(p, O_RDONLY, 0666); open(p, O_CREAT | O_RDWR, 0666); }')]
    assert settled(spark, opened, "CPP008") == [("a", 'fopen(n, "w");'), ("a", "open(p, O_CREAT | O_RDWR, 0666);"), ("a", "tmpnam(0);")]


def test_checks_that_are_not_known_fail_and_none_pass(spark):
    rows = [("a", 1, 0, "x", "c", "e", v, "s") for v in ("no-such-check", "")]
    hits = spark.createDataFrame(rows, "path string, line_no int, col int, rule_id string, cwe string, severity string, validators string, statement string")
    assert [x.validators for x in rules.validated(hits, spark.createDataFrame([], "path string, lang string, text string")).collect()] == [""]
    details = spark.range(1).select(validators.copy_details(F.lit("memcpy(b, s, 9)"), F.lit("char b[8];")).alias("d")).first().d
    assert tuple(details) == ("memcpy length 9 exceeds destination capacity 8.", "HIGH", "definite-overflow")


def test_readers_of_trees_labels_candidates_and_rulesets(spark, tmp_path):
    tree = {"a/B.java": "class B {}", "a/x_test.go": "package a", "a/x.go": "package a", "t.d.ts": "x", "t.ts": "x", "c.h": "int f(int a);", "d.h": "namespace d {}", "z.txt": "no"}
    for name, body in tree.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(body)
    rows = readers.read_tree(spark, f"file://{tmp_path}/src").orderBy("seq").collect()
    assert [(r.path.rsplit("/src/", 1)[1], r.lang, r.seq) for r in rows] == [("a/B.java", "java", 1), ("t.ts", "javascript", 2), ("a/x.go", "go", 3), ("d.h", "cpp", 4)]
    (tmp_path / "labels.json").write_text(json.dumps([{"file": "F.java", "line": 3, "expected_reachable": "yes", "note": "n"}]))
    assert readers.read_labels(spark, f"file://{tmp_path}/labels.json").first().expected_reachable == "yes"
    schema = "rule_id string, sink_line int"
    (tmp_path / "good.json").write_text('[{"rule_id": "r", "sink_line": 4}]')
    (tmp_path / "bad.json").write_text("not json")
    assert [readers.read_candidates(spark, f"file://{tmp_path}/{f}.json", schema).count() for f in ("good", "bad", "none")] == [1, 0, 0]
    (tmp_path / "rules.yml").write_text("configs: [a.yml]\nout_of_scope_cwes:\n  - 'cwe-327: weak'\n  - CWE-89\n")
    assert readers.read_ruleset(f"{tmp_path}/rules.yml") == {"configs": ["a.yml"], "exclude_rules": [], "out_of_scope_cwes": ["CWE-327", "CWE-89"], "exclude_paths": []}


def test_heartbeats_take_the_earlier_deadline(spark):
    rows = [("a", 1, 0, False), ("a", 2, 1, True), ("a", 3, 8, False), ("a", 4, 40, True), ("a", 5, 41, False), ("b", 6, 0, True), ("b", 7, 5, False), ("b", 8, 24, True)]
    beats = spark.createDataFrame(rows, "client string, seq long, s long, closing boolean").withColumn("ts", F.timestamp_seconds("s"))
    found = {(r.client, r.a, r.z, r.beats) for r in events.heartbeat_sessions(beats).select("client", F.unix_timestamp("opened").alias("a"), F.unix_timestamp("deadline").alias("z"), "beats").collect()}
    # a: the page that closes at 1 s pulls the deadline to 9 s, the beat at 8 s sets it to 28 s; that at 40 s comes too late to matter
    assert found == {("a", 0, 28, 2), ("a", 41, 61, 1), ("b", 5, 25, 1)}


def test_numbers_are_places_and_scratch_can_go(spark):
    rows = materialise(spark.range(100, 0, -1).withColumn("g", F.col("id") % 3), "some")
    assert {(r.id, r.place) for r in numbered(rows, "place", F.col("id")).collect()} == {(i, i) for i in range(1, 101)}
    path = rows.inputFiles()[0]
    discard(rows)
    assert not __import__("os").path.exists(path.removeprefix("file://"))


def test_reports_are_written_in_parts(spark, tmp_path):
    rows = [("r1", 1, "yes", "ERROR", "high", "a<b", 3, "m", 8.1), ("r1", 2, "no", "INFO", "low", "c", 4, "n", 2.0)]
    findings = spark.createDataFrame(rows, "report_id string, seq long, verdict string, severity string, risk_level string, sink_file string, sink_line int, message string, score double")
    reports.write_report(findings, "p", f"{tmp_path}/out")
    head = json.loads(spark.read.text(f"{tmp_path}/out/headers").first().value)
    assert head["summary"]["total"] == 2 and head["risk"]["high"] == 1 and head["project"] == "p"
    assert spark.read.text(f"{tmp_path}/out/findings").count() == 2
    reports.write_html(findings, f"{tmp_path}/html")
    assert any("a&lt;b:3" in r.value for r in spark.read.text(f"{tmp_path}/html").collect())
    assert 'class="tile reachable">1<' in reports.html_tiles(findings).first().tiles
    assert spark.range(1).select(text.console_row([(F.lit("ab"), -4), (F.lit("7"), 3)]).alias("x")).first().x == "| ab   |   7 |"
    assert context.lines_of(spark.createDataFrame([("p", "a\nb")], "path string, text string")).count() == 2

"""Golden cases of operators that the catalogue's tables do not reach."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sinktrace.functions import cvss, text
from sinktrace.jobs import scan
from sinktrace.operators import candidates, context, graph, indexing, rules, validators, verification
from sinktrace.sources import readers
from sinktrace.streaming import events


def test_base_scores_are_the_published_ones(spark):
    golden = {
        "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N": 7.5, "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1, "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N": 5.9,
        "AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H": 8.8, "AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H": 7.8, "AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0, "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0,
    }
    frame = spark.createDataFrame(list(golden.items()), "v string, s double").withColumn("v", F.regexp_replace("v", "^CVSS:3.1/", ""))
    assert all(r.s == r.got for r in frame.withColumn("got", cvss.base_score(F.col("v"))).collect())


def test_round_up(spark):
    cases = [(4.02 - 0.1, 4.0), (0.1 + 0.2, 0.3), (6.0, 6.0), (6.01, 6.1)]
    assert [r.got for r in spark.createDataFrame(cases, "a double, b double").select(cvss.round_up(F.col("a")).alias("got")).collect()] == [b for _, b in cases]


def test_model_replies(spark):
    replies = ['```json\n{"reachable": "yes"}\n```', '{"reachable": "no"}', "sorry"]
    rows = spark.createDataFrame([(r,) for r in replies], "r string").select(verification.parsed_reply(text.reply_json(F.col("r"))).alias("f")).collect()
    assert [r.f.reachable for r in rows] == ["yes", "no", "uncertain"] and rows[2].f.reasoning.startswith("verifier_failed")


def test_a_model_that_gives_out_leaves_later_candidates_unsent(spark):
    rows = [(i, f"p{i}", "static" if i == 1 else "dataflow", "HIGH") for i in range(12)]
    asked = spark.createDataFrame(rows, "seq long, prompt string, verification_mode string, rule_confidence string")
    ask = lambda p: None if p == "p6" else '{"reachable": "yes", "confidence": 5, "reasoning": ""}'
    cache = spark.createDataFrame([(F.lit(1), "x")][:0], "key string, reply string")
    found, halted = verification.verified(asked, ask, "m", cache, blocks=4)
    got = {r.seq: r.finding for r in found.collect()}
    assert halted and got[6] is None and all(got[i] is None for i in range(8, 12)) and got[5].reachable == "yes" and got[1].confidence == 95


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


def test_archives_lose_a_common_root_and_stay_inside(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(archive({"app/src/A.java": "class A {}", "app/B.py": "x = 1"}))
    (tmp_path / "two.zip").write_bytes(archive({"a/x.go": "", "b/y.go": ""}))
    found = {(r.archive[-7:], r.path) for r in readers.read_archives(spark, str(tmp_path / "*.zip")).collect()}
    assert found == {("one.zip", "src/A.java"), ("one.zip", "B.py"), ("two.zip", "a/x.go"), ("two.zip", "b/y.go")}
    for bad in ({"../x": ""}, {"a/../../x": ""}):
        with pytest.raises(readers.UnsafeArchive):
            readers.checked_entries(archive(bad))
    with pytest.raises(readers.UnsafeArchive):
        readers.checked_entries(archive({str(i): "" for i in range(4)}), max_entries=3)
    with pytest.raises(readers.UnsafeArchive):
        readers.checked_entries(archive({"a": "12345"}), max_bytes=4)


SOURCES = {
    "java": "class A {\n  @Get\n  public int first(int a, String b) {\n    // second(1);\n    return second(a, \"x(1)\");\n  }\n  int second(int a, String b) { return third(); }\n}\n",
    "python": "import os\ndef first(self, a):\n    x = second(a)\n\n    return x\ndef second(*args):\n    return '''\nfirst(1)\n'''\ny = first(2)\n",
    "javascript": "function first(a) {\n  return second(a, 1);\n}\nconst second = (a, b) => {\n  return a;\n}\n",
    "go": "package p\nfunc (s *S) first(a int) int {\n\treturn second(a)\n}\nfunc second(a int) int {\n\treturn 1\n}\n",
    "rust": "impl S {\n    pub fn first(&self, a: i32) -> i32 {\n        second(a)\n    }\n}\nfn second(a: i32) -> i32 {\n    1\n}\n",
    "csharp": "class A {\n  public int first(int a) {\n    return second(a);\n  }\n  private static int second(int a) {\n    return 1;\n  }\n}\n",
    "php": "<?php\nclass A {\n  public function first($a) {\n    return second($a);\n  }\n}\nfunction second($a) {\n  return 1;\n}\n",
    "kotlin": "class A {\n  fun first(a: Int): Int {\n    return second(a)\n  }\n  private fun second(a: Int): Int {\n    return 1\n  }\n}\n",
    "scala": "object A {\n  def first(a: Int): Int = {\n    second(a)\n  }\n  def second(a: Int): Int = {\n    1\n  }\n}\n",
    "cpp": "int second(int a) {\n  return 1;\n}\nint S::first(int a) {\n  return second(a); /* third(1) */\n}\n",
}


def test_methods_and_calls_of_each_language(spark):
    files = spark.createDataFrame([(f"f.{lang}", lang, body) for lang, body in SOURCES.items()], "path string, lang string, text string")
    methods, calls = indexing.index(files)
    spans = {(r.path[2:], r.name): (r.start_line, r.end_line) for r in methods.collect()}
    assert {lang for lang, name in spans if name == "first"} == {lang for lang, name in spans if name == "second"} == set(SOURCES)
    assert spans["java", "first"] == (3, 6) and spans["java", "second"] == (7, 7) and spans["python", "second"] == (6, 9) and spans["python", "first"] == (2, 5) and spans["rust", "first"] == (2, 4) and spans["cpp", "first"] == (4, 6)
    edges = {(r.path[2:], r.caller, r.callee) for r in calls.collect()}
    assert {(lang, "first", "second") for lang in SOURCES} <= edges and ("java", "second", "third") in edges
    assert not {e for e in edges if e[2] == "third" and e[0] == "cpp"} and ("python", None, "first") in edges and ("python", "second", "first") not in edges


def test_a_chain_from_the_sink_to_its_entry(spark):
    edges = spark.createDataFrame([("handler", "service", 1), ("service", "dao", 2), ("job", "service", 3), ("main", "job", 4), ("dao", "dao", 5)], "caller string, callee string, seq long")
    starts = spark.createDataFrame([("s", "dao")], "sink string, node string")
    entries = spark.createDataFrame([("handler",), ("main",)], "node string")
    found = {r.entry: r.chain for r in graph.shortest_chains(starts, edges, entries).collect()}
    assert found == {"handler": ["dao", "service", "handler"], "main": ["dao", "service", "job", "main"]}
    assert {r.entry for r in graph.shortest_chains(starts, edges, entries, 2).collect()} == {"handler"}


def test_a_closure_with_a_cycle_leaves_out_the_type_itself(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "type string, parent string")
    found = {(r.type, r.ancestor) for r in graph.closure(edges).collect()}
    assert found == {(x, y) for x in "abc" for y in "abc" if x != y} | {("d", x) for x in "abc"}


def test_a_long_method_keeps_its_head_and_the_lines_around_the_place(spark):
    lines = [f"l{i}" for i in range(1, 301)]
    frame = spark.createDataFrame([(lines, 200, 1, 290)], "l array<string>, line int, s int, e int")
    shown = frame.select(context.method_window(F.col("l"), F.col("line"), F.col("s"), F.col("e")).alias("x")).first().x.split("\n")
    assert shown[0] == "    1 | l1" and shown[11] == "   12 | l12" and shown[12] == "      | ... 172 lines omitted ..." and shown[13] == "  185 | l185" and shown[-1] == "  215 | l215"


def test_rules_match_code_of_their_language(spark):
    lines = spark.createDataFrame([("a", "cpp", 1, "x.strcpy(a)"), ("a", "cpp", 2, "strcpy(a, b)"), ("b", "python", 1, "strcpy(a, b)"), ("b", "python", 2, 'c.execute("select %s" % x)'), ("c", "rust", 1, 'Command::new("sh").arg("-c").arg(x)')], "path string, lang string, line_no int, text string")
    assert {(r.path, r.line_no, r.rule_id) for r in rules.scan(lines, rules.rule_table(spark)).collect()} == {("a", 2, "CPP001"), ("b", 2, "python-sql-format"), ("c", 1, "rust-shell-argument")}


def test_globs_match_runs_of_segments(spark):
    paths = ["target/A.java", "m/target/x", "targets/A", "a/src/it/B", "a/src/x/it/B", "a/b.min.js", "b.min.js/c", "c\\obj\\d"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.x for r in frame.select(candidates.excluded_path(F.col("p")).alias("x")).collect()] == [True, True, False, True, False, True, True, True]


def test_rule_results_are_read_and_normalised(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"results": [{"check_id": "a.b.rule", "path": "K.java", "start": {"line": 3, "col": 1}, "end": {"line": 3, "col": 9}, "extra": {"message": "m ", "severity": "ERROR", "metadata": {"cwe": ["CWE-89: x"]}, "dataflow_trace": {"taint_source": ["CliLoc", [{"path": "S.java", "start": {"line": 1}}, "v"]]}}}]}')
    row = candidates.normalize(readers.read_results(spark, str(tmp_path / "r.json"))).first()
    assert (row.rule_id, row.source_file, row.source_line, row.sink_line, row.cwe, row.is_intraprocedural) == ("rule", "S.java", 1, 3, ["CWE-89: x"], False)


def test_lines_of_a_stream_are_put_together(spark, tmp_path):
    writes = [(1, 1, "ab"), (1, 2, "c\nd"), (2, 3, "x\n"), (1, 4, "\ne")]
    schema = "scan_id long, seq long, chunk string"
    spark.createDataFrame(writes[:2], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(writes[2:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.stream_lines(stream).writeStream.format("memory").queryName("whole_lines").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    expected = {(1, 0, "abc"), (1, 1, "d"), (2, 0, "x")}
    assert {tuple(r) for r in spark.sql("SELECT scan_id, line_no, text FROM whole_lines").collect()} == expected
    assert {tuple(r) for r in events.assembled_lines(spark.createDataFrame(writes, schema)).collect()} == expected


def test_validators_of_cpp_candidates(spark):
    rows = [
        ("memcpy(b, s, 9)", "char b[8];", "overflow"), ("memcpy(b, s, 8)", "char b[8];", "safe"), ("memcpy(b, s, n)", "char b[8];", "unknown"), ("memcpy(b, s, 0x10)", "std::array<char, 020> b;", "safe"),
        ("memcpy(b, s, sizeof(b))", "", "safe"), ("memcpy(p->b, s, 4)", "", "unknown"),
    ]
    frame = spark.createDataFrame(rows, "c string, t string, e string")
    assert all(r.e == r.x for r in frame.withColumn("x", validators.copy_bounds(F.col("c"), F.col("t"))).collect())
    calls = [('chmod(p, 0666)', True), ('chmod(p, 0750)', False), ("mktemp(n)", True), ('fopen("/tmp/x", "w")', True), ('fopen("/tmp/x", "r")', False), ('fopen(p, "w")', False), ("open(p, O_CREAT, 0622)", True)]
    frame = spark.createDataFrame(calls, "c string, e boolean")
    assert all(r.e == r.x for r in frame.withColumn("x", validators.dangerous_file_operation(F.col("c"))).collect())
    names = [("strcpy(a, b)", "char* strcpy(char* a, const char* b) {", False), ("std::strcpy(a, b)", "#define strcpy x", True), ("strcpy(a, b)", "void f() {\n  return strcpy(a, b);\n}", True)]
    frame = spark.createDataFrame(names, "c string, t string, e boolean")
    assert all(r.e == r.x for r in frame.withColumn("x", validators.standard_call(F.col("c"), F.col("t"), F.lit("strcpy"))).collect())


def test_a_scan_finds_the_chain_across_files(spark):
    sources = [
        ("web/app.py", "python", "@app.route('/login')\ndef login(name):\n    return check(name)\n"),
        ("svc/db.py", "python", "def check(name):\n    x = 1\n    cur.execute('select ' + name)\n"),
        ("svc/job.py", "python", "def nightly(n):\n    cur.execute(f'select {n}')\n"),
        ("target/gen.py", "python", "def f(n):\n    cur.execute(f'select {n}')\n"),
    ]
    frame = spark.createDataFrame(sources, "path string, lang string, text string")
    ask = lambda p: '{"reachable": "%s", "confidence": 90, "reasoning": "r"}' % ("no" if "no entry point" in p else "yes")
    found, halted = scan.scan(spark, frame, ask, "stub", spark.createDataFrame([], "key string, reply string"))
    rows = {r.sink_file: r for r in found.collect()}
    assert not halted and set(rows) == {"svc/db.py", "svc/job.py"}
    assert (rows["svc/db.py"].verdict, rows["svc/db.py"].risk_level, rows["svc/db.py"].hops) == ("yes", "critical", 1) and "web/app.py#login" in rows["svc/db.py"].chains
    assert (rows["svc/job.py"].verdict, rows["svc/job.py"].risk_level) == ("no", "low")

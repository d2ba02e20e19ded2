"""Steps that must neither lose rows nor grow faster than their input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sinktrace.jobs import catalogue
from sinktrace.operators import aliases, context, graph, indexing, intervals, matching, rules, trace, validators


def test_hits_that_are_equal_stay_as_often_as_they_are_there(spark):
    places = "path long, pos long, end_pos long, block_end long, method_pos long, v long"
    hits = spark.createDataFrame([(1, 5, 5, 9, 0, 2), (1, 5, 5, 9, 0, 2), (1, 7, 7, 9, 0, 3)], places)
    around = spark.createDataFrame([(1, 1, 1, 8, 0, 2), (1, 2, 2, 8, 0, 2)], places)
    assert [r.pos for r in matching.inside(hits, around, "v").collect()] == [5, 5]


def test_the_interval_that_comes_first_is_found_for_every_place(spark):
    spans = [(k, a, a + n, (a * 7 + n * 3 + k) % 50, 100 * a + n) for k in range(2) for a in range(0, 40, 3) for n in (0, 1, 6, 17)]
    places = [(k, at) for k in range(3) for at in range(60)]
    frames = spark.createDataFrame(places, "k long, at long"), spark.createDataFrame(spans, "k long, low long, high long, rank long, value long").selectExpr("k", "low", "high", "struct(rank, value) AS rank", "value")
    for largest, pick in ((False, min), (True, max)):
        found = {(r.k, r.at): r.value for r in intervals.first_over(*frames, ["k"], largest).collect()}
        over = {(k, at): [(r, v) for k2, a, b, r, v in spans if k2 == k and a <= at <= b] for k, at in places}
        assert found == {p: pick(x)[1] for p, x in over.items() if x}


def test_places_never_meet_intervals_pair_by_pair(spark):
    """A thousand places under a thousand intervals: nothing that is joined has a row for a pair."""
    methods = spark.range(1000).selectExpr("id AS method_id", "id AS seq", "0 AS file", "id AS start_line", "2000 - id AS end_line")
    sinks = spark.range(1000).selectExpr("id AS sink_id", "0 AS file", "id AS line")
    found = graph.enclosing_method(sinks, methods)
    assert {r.sink_id: r.method_id for r in found.collect()} == {k: k for k in range(1000)}
    assert "start_line" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]  # methods come as blocks that were written


def test_searches_carry_many_sinks_in_a_row(spark):
    starts = spark.range(100).selectExpr("id AS sink", "1000 AS node")
    edges = spark.createDataFrame([(k + 1, k, k) for k in range(1000, 1005)], "caller long, callee long, seq long")
    found = {(r.sink, r.node, r.depth) for r in graph.reverse_search(starts, edges, 3).collect()}
    assert found == {(s, 1000 + d, d) for s in range(100) for d in range(4)}
    entries = spark.createDataFrame([(1002,)], "node long")
    assert {(r.sink, r.entry, r.depth) for r in graph.entry_depths(starts, edges, entries).collect()} == {(s, 1002, 2) for s in range(100)}


def test_a_search_makes_its_edges_once_whatever_the_rounds(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def callee(k):
        made.add(1)
        return k

    edges = spark.range(9).select((F.col("id") + 1).alias("caller"), callee("id").alias("callee"))
    found = graph.reverse_search(spark.createDataFrame([(0, 0)], "sink long, node long"), edges, 8).collect()
    assert {(r.node, r.depth) for r in found} == {(k, k) for k in range(9)} and made.value <= 2 * 9  # once for the ranges, once for the table


def test_long_lists_of_callers_and_sets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(graph, "LISTED", 3)
    monkeypatch.setattr(graph, "SETS", 2)
    starts = spark.range(300).selectExpr("id AS sink", "1000 AS node")
    edges = spark.range(1, 21).selectExpr("1000 + id AS caller", "1000 AS callee").unionByName(spark.createDataFrame([(2000, 1007), (2000, 1008), (1000, 2000)], "caller long, callee long"))
    found = [(r.sink, r.node, r.depth) for r in graph.reverse_search(starts, edges, None).collect()]
    assert len(found) == len(set(found)) and set(found) == {(s, n, d) for s in range(300) for n, d in [(1000, 0), *((1000 + k, 1) for k in range(1, 21)), (2000, 2)]}


def test_nodes_that_are_no_entries_are_dropped_before_sinks_are_rows(spark):
    starts = spark.range(100).selectExpr("id AS sink", "1000 AS node")
    edges = spark.createDataFrame([(k + 1, k, k) for k in range(1000, 1005)], "caller long, callee long, seq long")
    chains = graph.entry_depths(starts, edges, spark.createDataFrame([(1002,)], "node long"))
    assert "LeftSemi" not in chains._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.sink, r.place, r.more) for r in graph.top_chains(chains).collect()} == {(s, 1, 0) for s in range(100)}


def test_traces_of_sinks_are_not_written_as_rows(spark):
    edges = spark.createDataFrame([(2, 1, 1), (3, 2, 2), (4, 1, 3), (6, 5, 4)], "caller long, callee long, seq long")
    starts = spark.createDataFrame([(10, 1), (20, 5), (30, 7), (40, 8), (50, 6)], "sink long, node long")
    marks = spark.createDataFrame([(3, True), (4, False), (5, False), (7, True), (8, False), (6, True)], "node long, definitive boolean")
    found = trace.entry_traces(starts, edges, marks, nodes=False)
    assert not any("/traces-" in path for path in found.inputFiles())
    assert {(r.sink, r.entry, r.depth) for r in found.collect()} == {(10, 3, 2), (10, 4, 1), (20, 6, 1), (30, 7, 0), (40, 8, 0), (50, 6, 0)}


def test_closures_put_the_members_of_cycles_in_at_the_end(spark):
    edges = spark.createDataFrame([(k, (k + 1) % 40) for k in range(40)] + [(100, 0), (5, 200), (200, 201)], "type long, parent long")
    found = {(r.type, r.ancestor) for r in graph.closure(edges).collect()}
    ring = range(40)
    want = {(a, b) for a in (*ring, 100) for b in (*ring, 200, 201) if a != b} | {(200, 201)}
    assert found == want


def test_closures_deal_out_lists_of_members_and_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "LISTED", 3)
    ring = lambda a, n: [(a + k, a + (k + 1) % n) for k in range(n)]
    links = ring(0, 40) + ring(50, 10) + [(5, 52), (100, 101), (101, 3), (9, 200), (200, 201), (55, 300)] + [(400 + k, 7) for k in range(20)]
    found = graph.closure(spark.createDataFrame(links, "type long, parent long"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]  # rows are made of lists last
    pairs = [(r.type, r.ancestor) for r in found.collect()]
    up = {}
    for a, b in links:
        up.setdefault(a, set()).add(b)
    want = set()
    for a in up:
        seen, todo = set(), [a]
        while todo:
            new = up.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        want |= {(a, b) for b in seen if a != b}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_leaves_of_members_are_rows_last_and_all_are_found(spark, monkeypatch):
    monkeypatch.setattr(graph, "LISTED", 3)
    links = [(k, (k + 1) % 10) for k in range(10)] + [(100 + k, k % 4) for k in range(70)] + [(5, 50), (50, 51), (51, 52), (60, 61), (70, 70), (80, 80), (80, 81)]
    monkeypatch.setattr(catalogue, "edges", lambda spark, _: spark.createDataFrame(links, "caller long, callee long"))
    ends, ring = range(100, 170), range(10)
    want = {(s, e) for s in (*ring, 50, 51, 52) for e in ends} | {(61, 60), (70, 70), (80, 80), (81, 80)}
    for few in (0, 1 << 40):
        monkeypatch.setattr(graph, "FEW", few)
        found = catalogue.QUERIES["closure_leaves"](spark, "")
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        pairs = [(r.sink, r.node) for r in found.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_edges_are_counted_by_owner_without_pairs(spark):
    calls = spark.createDataFrame([("f", 1, k, "A", True) for k in range(30)] + [("f", 2, 1, "B", False), ("f", 1, None, "A", True)], "callee string, arity int, caller_id long, caller_owner string, receiver_is_self boolean")
    methods = spark.createDataFrame([(k, "f", 1, "X") for k in range(20)] + [(99, "f", -1, "Y")], "method_id long, name string, arity int, owner string")
    found = {(r.caller_owner, r.callee_owner, r.receiver_is_self): r.n for r in graph.owner_edges(calls, methods).collect()}
    assert found == {("A", "X", True): 600, ("A", "Y", True): 30, ("B", "Y", False): 1}


def test_one_step_back_is_taken_from_every_part_that_is_called(spark):
    data = "/root/testdata/sf0.001"
    found = catalogue.QUERIES["trace_bfs_depth1"](spark, data)
    called = catalogue.all_edges(spark, data).select("callee").distinct().count()
    assert found.where("depth = 0").count() == called


def test_comments_and_literals_are_blanked_in_place():
    assert indexing.mask('a("//x"); // "y\n/* z */ b \'q\' "open\nc', "java") == 'a("   "); ' + " " * 5 + "\n" + " " * 8 + "b ' ' \"" + " " * 4 + "\nc"
    assert indexing.mask("x: 'a, y: 'b' // c", "rust", False) == "x: 'a, y: 'b' " + " " * 4
    assert indexing.mask('"""p\n"""+1 # c', "python") == '""" \n   +1 ' + " " * 3


def broadcasts(spark, after):
    """How many tables the executions since number ``after`` sent through the driver, and the last number."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    ids = [runs.apply(k).executionId() for k in range(runs.size())]
    names = [(k, nodes.apply(j).name()) for k in ids if k > after for nodes in [store.planGraph(k).allNodes()] for j in range(nodes.size())]
    return sum(name.startswith("BroadcastExchange") for _, name in names), max(ids, default=-1)


def test_checks_of_hits_send_no_table_through_the_driver(spark):
    texts = spark.range(40).selectExpr("id AS path", "'cpp' AS lang", "concat('char to[8];\\nchar *p = new char[4];\\nvoid f() {\\n  memcpy(to, from, ', id, ');\\n  delete p;\\n  q = p;\\n}\\n') AS text")
    hits = rules.scan(context.lines_of(texts, "lang"), rules.rule_table(spark))
    _, last = broadcasts(spark, 1 << 60)
    found = rules.validated(hits, texts).collect()
    assert {(r.path, r.rule_id) for r in found} == {(k, "CPP004") for k in range(9, 40)} | {(k, "CPP005") for k in range(40)}
    assert broadcasts(spark, last)[0] == 0


def test_a_check_of_a_copy_reads_its_file_once(spark):
    frame = spark.createDataFrame([("memcpy(b, s, 9)", "char b[8];")], "c string, t string").select(validators.copy_bounds(F.col("c"), F.col("t")).alias("x"), validators.integer(F.upper("c")).alias("y"))
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert plan.count("uint8_t") == plan.count("sizeof") == plan.count("upper(") == 1


def test_only_stretches_with_a_value_are_kept_and_all_are_found(spark):
    r = random.Random(3)
    assigns = [("f", k, f"n{k}", f"n{k - 1}" if k else "1") for k in range(40)] + [("g", 0, "a", "c"), ("g", 1, "b", "a"), ("g", 2, "c", "b"), ("g", 3, "d", "a"), ("g", 4, "e", "unset"), ("g", 5, "h", "h")]
    assigns += [(f"p{p}", k, f"n{r.randrange(6)}", r.choice(['"x"', "nullptr", *(f"n{x}" for x in range(7)), *(f"n{x}" for x in range(7))])) for p in range(30) for k in range(12)]
    table = aliases.resolved(spark.createDataFrame(assigns, "path string, pos long, name string, value string"))
    rows = [tuple(x) for x in table.select("path", "name", "after", "upto", "value").collect()]
    assert all(value is not None for *_, value in rows) and not any(path == "g" for path, *_ in rows)
    expected = {}
    for path, at, name in {(p, k, n) for p, _, n, _ in assigns for k in range(41)}:
        seen, value = set(), name
        while value is not None and value not in seen and (value == name or value.startswith("n") and value != "nullptr" or path == "g"):
            seen.add(value)
            value = max(((k, v) for p, k, n, v in assigns if (p, n) == (path, value) and k < at), default=(0, None))[1]
        if value is not None and value not in seen:
            expected[path, at, name] = value
    got = [((path, at, name), value) for path, name, after, upto, value in rows for at in range(41) if after < at <= upto]
    assert len(got) == len(dict(got)) and dict(got) == expected

"""Call graphs as tables: enclosing methods, resolved callers, closures, and bounded search back to entry points."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinktrace.functions.text import short_type
from sinktrace.operators.intervals import first_over
from sinktrace.storage import discard, materialise, numbered, partitions

ANY_ARITY = -1
MAX_DEPTH = 7
NUMERIC = ("short", "int", "long", "float", "double", "size_t")
TEXTUAL = ("string-literal", "char", "string", "string_view")


def enclosing_method(sinks: DataFrame, methods: DataFrame) -> DataFrame:
    """Each sink (sink_id, file, line) with the method (method_id, seq, file, start_line, end_line) around it of least span,
    of equal spans the first; sinks outside of any method have none."""
    around = methods.select("file", F.col("start_line").alias("low"), F.col("end_line").alias("high"), F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "seq").alias("rank"), F.col("method_id").alias("value"))
    best = first_over(sinks.select("file", F.col("line").alias("at")), around, ["file"]).select("file", F.col("at").alias("line"), F.col("value").alias("method_id"))
    return sinks.join(best, ["file", "line"], "left").select(*sinks.columns, "method_id")


def type_reaches(target_owner: Column, owner: Column, arguments: Column, parameters: Column) -> Column:
    """Whether a call's types allow the method: only what is surely wrong is ruled out."""
    pairs = F.transform(F.arrays_zip(arguments.alias("a"), parameters.alias("p")), lambda z: F.struct(short_type(z["a"]).alias("a"), short_type(z["p"]).alias("p")))
    fits = F.forall(
        pairs,
        lambda z: (F.coalesce(z["a"], F.lit("")) == "") | (F.coalesce(z["p"], F.lit("")) == "") | (z["a"] == z["p"]) | z["p"].rlike(r"^[A-Z]\w*$")
        | (z["a"].isin(*NUMERIC) & z["p"].isin(*NUMERIC)) | (z["a"].isin(*TEXTUAL) & z["p"].isin(*TEXTUAL)),
    )
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    other_owner = known(target_owner) & known(owner) & (short_type(target_owner) != short_type(owner))
    open_ = (F.size(F.coalesce(arguments, F.array().cast("array<string>"))) == 0) | (F.size(F.coalesce(parameters, F.array().cast("array<string>"))) == 0)
    return ~other_owner & (open_ | (F.size(arguments) != F.size(parameters)) | fits)


def self_calls_within(edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Drop self-receiver edges (caller_owner, callee_owner, receiver_is_self) between unrelated owners.

    ``ancestors`` has (type, ancestor). Either may be the ancestor of the other; unnamed owners pass.
    """
    pairs = ancestors.select(F.col("type").alias("__t"), F.col("ancestor").alias("__a")).distinct()
    both = pairs.unionByName(pairs.select(F.col("__a").alias("__t"), F.col("__t").alias("__a"))).distinct().withColumn("__related", F.lit(True))
    joined = edges.join(both, (edges.caller_owner == F.col("__t")) & (edges.callee_owner == F.col("__a")), "left")
    unnamed = (F.coalesce("caller_owner", F.lit("")) == "") | (F.coalesce("callee_owner", F.lit("")) == "")
    return joined.where(~F.col("receiver_is_self") | unnamed | (F.col("caller_owner") == F.col("callee_owner")) | F.col("__related")).drop("__t", "__a", "__related")


def callers_of(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Resolved edges: calls (call_id, callee, arity, caller_id) with the methods (method_id, name, arity) that they may reach.

    A method of unknown arity takes calls of any; calls outside of methods have no caller and no edge.
    """
    named = methods.select(F.col("method_id"), F.col("name").alias("callee"), F.col("arity").alias("m_arity"))
    joined = calls.where("caller_id IS NOT NULL").join(named, "callee")
    return joined.where((F.col("m_arity") == ANY_ARITY) | (F.col("m_arity") == F.col("arity"))).drop("m_arity")


def owner_edges(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """The edges of ``callers_of`` by the owners at both ends: caller_owner, callee_owner, receiver_is_self, n (how many edges).

    Calls and methods meet as counts by name and arity, never one by one. calls have caller_owner and receiver_is_self besides, methods owner.
    """
    sites = calls.where("caller_id IS NOT NULL").groupBy("callee", "arity", "caller_owner", "receiver_is_self").agg(F.count(F.lit(1)).alias("calls"))
    named = methods.groupBy(F.col("name").alias("callee"), F.col("arity").alias("m_arity"), F.col("owner").alias("callee_owner")).agg(F.count(F.lit(1)).alias("methods"))
    met = sites.join(named, "callee").where((F.col("m_arity") == ANY_ARITY) | (F.col("m_arity") == F.col("arity")))
    return met.groupBy("caller_owner", "callee_owner", "receiver_is_self").agg(F.sum(F.col("calls") * F.col("methods")).alias("n"))


def caller_counts(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """For each method that a call may reach: method_id, n_calls, n_callers. Calls meet methods as counts by name and arity, never one by one."""
    sites = calls.where("caller_id IS NOT NULL").groupBy("callee", "arity", "caller_id").agg(F.count(F.lit(1)).alias("n"))
    sums = F.sum("n").alias("n_calls"), F.countDistinct("caller_id").alias("n_callers")
    by_arity = sites.groupBy("callee", "arity").agg(*sums).where(F.col("arity") != ANY_ARITY)
    of_any = sites.groupBy("callee").agg(*sums).withColumn("arity", F.lit(ANY_ARITY))
    return methods.select("method_id", F.col("name").alias("callee"), "arity").join(by_arity.unionByName(of_any), ["callee", "arity"]).select("method_id", "n_calls", "n_callers")


def sole_targets(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls whose name and exact arity is that of one method only, with that method."""
    one = methods.groupBy(F.col("name").alias("callee"), "arity").agg(F.count(F.lit(1)).alias("n"), F.first("method_id").alias("method_id")).where("n = 1").drop("n")
    return calls.join(one, ["callee", "arity"])


def suffix_first(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Each key (key, suffix) with the first file (seq, path) whose path ends with the suffix at a segment boundary.

    Every suffix of a path at a segment boundary is a row of its own, so the join is on equality.
    """
    parts = F.split("path", "/")
    once = files.groupBy("path").agg(F.min("seq").alias("seq"))
    tails = once.select("seq", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    # Of each suffix one file is left before keys meet it, so keys and files of one suffix make no pairs.
    best = tails.groupBy("suffix").agg(F.min_by("path", "seq").alias("path"))
    return paths.join(best, "suffix", "left").select("key", "suffix", "path")


def reverse_search(starts: DataFrame, edges: DataFrame, max_depth: int | None = MAX_DEPTH, entries: DataFrame | None = None) -> DataFrame:
    """Breadth-first search against the edges (caller, callee) from all starts (sink, node) at once: (sink, node, depth).

    A node is visited once for each sink, at its least depth. The sinks that a round brings to a node are bits of longs, 64 sinks to each, so a round's rows are those of
    the graph for every 64 sinks; they become rows of their own at the end. Without ``max_depth`` the search goes on until nothing new is found. Nodes of ``entries`` (node) close their chain: they are
    reported and not expanded. Each round is one join on the frontier and one aggregation with what was visited,
    written to the shared folder, so the plan stays short and lost executors cost one round.
    """
    found, places = search_sets(starts, edges, max_depth, entries)
    return _out_of_blocks(found, places, "sink").select("sink", "node", "depth")


def search_sets(starts: DataFrame, edges: DataFrame, max_depth: int | None = MAX_DEPTH, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``reverse_search`` as sets (node, block, bits, depth), and the block and bit of each sink (sink, block, bit)."""
    places = _in_blocks(starts.select("sink"), "sink")
    callers = _callers(edges)
    own = starts.select("sink", "node").join(places, "sink").groupBy("node", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    frontier = materialise(own, "search")
    rounds = [frontier]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        if entries is not None and depth > 1:
            frontier = frontier.join(entries.select("node").distinct(), "node", "left_anti")
        frontier = _new_bits(_sent(frontier, callers), rounds, "node", "search")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    discard(callers)
    found = None
    for depth, frontier in enumerate(rounds):
        told = frontier.withColumn("depth", F.lit(depth))
        found = told if found is None else found.unionByName(told)
    return found, places


LISTED = 1024  # callers or members in a row
REGION = 13  # a region is 2 to this power rows at most
SETS = 64  # sets in a row at most
FEW = 20  # sets sent are few if those seen are more by this factor


def _callers(edges: DataFrame) -> DataFrame:
    """Who calls each node, written once for all rounds of a search: node, callers (an array), region.

    Nodes that follow one another in order are one region, for those often have callers in common.
    """
    place = F.row_number().over(Window.partitionBy("callee").orderBy("caller"))
    ranked = edges.select("caller", "callee").repartitionByRange(partitions(edges.sparkSession), "callee").withColumn("__list", F.floor((place - 1) / LISTED))
    lists = ranked.groupBy("callee", "__list").agg(F.collect_list("caller").alias("callers")).sortWithinPartitions("callee")
    return materialise(lists.select(F.col("callee").alias("node"), "callers", F.shiftright(F.monotonically_increasing_id(), REGION).alias("region")), "callers")


def _sent(frontier: DataFrame, callers: DataFrame) -> DataFrame:
    """The sets (node, block, bits) that nodes send to their callers. A region's are made in one task, so most of what goes to one caller meets before it is dealt out."""
    sets = frontier.repartition("node").groupBy("node", F.floor(F.col("block") / SETS).alias("__blocks")).agg(F.collect_list(F.struct("block", "bits")).alias("__sets"))
    met = sets.join(callers, "node").select("region", "callers", "__sets").repartition("region")
    return met.select(F.explode("callers").alias("node"), "__sets").select("node", F.explode("__sets").alias("x")).select("node", "x.block", "x.bits")


BLOCK = 64  # the bits of a long


def _in_blocks(ids: DataFrame, name: str) -> DataFrame:
    """Ids in their order, each with a block and a bit in it: name, block, bit. Sets of ids are longs by block then, one for up to 64 of them."""
    placed = materialise(numbered(ids.select(name).distinct(), "__place", F.col(name)), f"blocks-{name}")
    return placed.select(name, F.floor((F.col("__place") - 1) / BLOCK).alias("block"), ((F.col("__place") - 1) % BLOCK).cast("int").alias("bit"))


def _new_bits(sent: DataFrame, rounds: list[DataFrame], node: str, name: str) -> DataFrame:
    """Of sets that are sent to nodes (node, block, bits) what none of the rounds so far had there. If few are sent, only what the nodes that they are sent to had is dealt out."""
    seen = rounds[0]
    for df in rounds[1:]:
        seen = seen.unionByName(df)
    told = materialise(sent.groupBy(node, "block").agg(F.bit_or("bits").alias("bits")), f"{name}-told")
    if told.count() * FEW < seen.count():
        seen = seen.join(told.select(node).distinct(), node, "left_semi")
    none = F.lit(0).cast("long")
    rows = told.select(node, "block", "bits", none.alias("had")).unionByName(seen.select(node, "block", none.alias("bits"), F.col("bits").alias("had")))
    new = rows.groupBy(node, "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("had").alias("had")).select(node, "block", F.expr("bits & ~had").alias("bits"))
    found = materialise(new.where("bits <> 0"), name)
    discard(told)
    return found


def _out_of_blocks(rows: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """Rows (block, bits and others) as one row for each id of their sets."""
    ids = places.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bit", name))).alias("__ids"))
    each = rows.join(ids, "block").select(*(c for c in rows.columns if c != "block"), F.explode("__ids").alias("__id"))
    return each.where("shiftright(bits, __id.bit) & 1 = 1").select(*(c for c in rows.columns if c not in ("block", "bits")), F.col(f"__id.{name}").alias(name))


def entry_depths(starts: DataFrame, edges: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The ends and lengths of the chains of ``shortest_chains`` without their nodes: sink, entry, depth."""
    return entry_sets(starts, edges, entries, max_depth)[0]


def entry_sets(starts: DataFrame, edges: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """``entry_depths``, and the sinks (sink) that have any. Nodes that are no entries are left out while sinks are still told as sets."""
    found, places = search_sets(starts, edges, max_depth, entries)
    ends = materialise(found.where("depth > 0").join(entries.select("node").distinct(), "node", "left_semi"), "entries")
    told = places.join(ends.groupBy("block").agg(F.bit_or("bits").alias("bits")), "block").where("shiftright(bits, bit) & 1 = 1").select("sink")
    return _out_of_blocks(ends, places, "sink").select("sink", F.col("node").alias("entry"), "depth"), told


def shortest_chains(starts: DataFrame, edges: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Chains from sinks back to entry points: (sink, entry, depth, chain), the chain being the nodes from the sink on.

    Of parents at equal depth the one whose chain comes first in the frontier's order and then in the order of calls
    (edges have seq) is kept, as a walk in order would.
    """
    state = starts.select("sink", "node", F.array("node").alias("chain"), F.array(F.lit(0).cast("long")).alias("rank"), F.lit(0).alias("depth"))
    seen = frontier = materialise(state, "chains")
    for depth in range(1, max_depth + 1):
        open_ = frontier if depth == 1 else frontier.join(entries.select("node").distinct(), "node", "left_anti")
        step = open_.join(edges, open_.node == edges.callee).select("sink", F.col("caller").alias("node"), F.concat("chain", F.array("caller")).alias("chain"), F.concat("rank", F.array("seq")).alias("rank"))
        first = step.groupBy("sink", "node").agg(F.min_by(F.struct("chain", "rank"), "rank").alias("x")).select("sink", "node", "x.chain", "x.rank")
        frontier = materialise(first.join(seen, ["sink", "node"], "left_anti").withColumn("depth", F.lit(depth)), "chains")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0").join(entries.select("node").distinct(), "node", "left_semi").select("sink", F.col("node").alias("entry"), "depth", "chain")


def top_chains(chains: DataFrame, shown: int = 4) -> DataFrame:
    """The shortest chains of each sink, and how many more there are."""
    each = Window.partitionBy("sink")
    ranked = chains.withColumn("place", F.row_number().over(each.orderBy("depth", "entry"))).withColumn("more", F.greatest(F.count(F.lit(1)).over(each) - shown, F.lit(0)))
    return ranked.where(F.col("place") <= shown)


def closure(edges: DataFrame) -> DataFrame:
    """All (type, ancestor) over the edges (type, parent); a cycle gives every other member, never the type itself.

    Types on a cycle become one first, so that what is joined in rounds is free of cycles. Each round joins the newest pairs with all pairs, so the length of the
    paths doubles, and a chain of n types takes log2(n) rounds. The members of cycles are put in at the end, list by list.
    """
    plain = materialise(edges.where("type <> parent").select(F.col("type").alias("caller"), F.col("parent").alias("callee")).distinct(), "closure-plain")
    cycles = condensed(plain)
    if cycles.isEmpty():
        return _acyclic_closure(plain.toDF("type", "ancestor"))
    of, acyclic = _condensed_edges(plain, cycles)
    own = cycles.select(F.col("component").alias("type"), F.col("component").alias("ancestor")).distinct()
    pairs = _acyclic_closure(acyclic.toDF("type", "ancestor")).unionByName(own)
    return _pairs_of_members(pairs, cycles).where("type <> ancestor")


def _pairs_of_members(pairs: DataFrame, cycles: DataFrame) -> DataFrame:
    """Pairs of components (type, ancestor) as pairs of their members. Where a cycle (node, component) is at one side, both sides are lists, so that
    what is dealt out are pairs of lists; rows are made of them where they are read."""
    on = cycles.select("component", F.lit(True).alias("__on")).distinct()
    marked = pairs
    for side in ("type", "ancestor"):
        marked = marked.join(on.select(F.col("component").alias(side), F.col("__on").alias(f"__{side}")), side, "left")
    marked = materialise(marked.select("type", "ancestor", F.col("__type").isNotNull().alias("from_cycle"), F.col("__ancestor").isNotNull().alias("to_cycle")), "closure-marked")
    members = materialise(_lists(cycles, "component", "node"), "cycles")
    of = lambda side: members.select(F.col("component").alias(side), F.col("nodes").alias(f"{side}s"))
    listed = lambda rows, key, side: _lists(rows.select(key, F.col(side).alias("node")), key, "node").withColumnRenamed("nodes", f"{side}s")
    to_cycle = listed(marked.where("to_cycle AND NOT from_cycle"), "ancestor", "type").join(of("ancestor"), "ancestor")
    from_cycle = listed(marked.where("from_cycle AND NOT to_cycle"), "type", "ancestor").join(of("type"), "type")
    both = marked.where("from_cycle AND to_cycle").join(of("type"), "type").join(of("ancestor"), "ancestor")
    lists = to_cycle.select("types", "ancestors").unionByName(from_cycle.select("types", "ancestors")).unionByName(both.select("types", "ancestors"))
    dealt = lists.repartition(partitions(pairs.sparkSession), F.xxhash64("types"), F.xxhash64("ancestors"))
    plain = marked.where("NOT from_cycle AND NOT to_cycle").select("type", F.array("ancestor").alias("ancestors"))
    # One explode on each side of the union: two in a row would hold all rows of a pair of lists at once.
    return dealt.select(F.explode("types").alias("type"), "ancestors").unionByName(plain).select("type", F.explode("ancestors").alias("ancestor"))


def _lists(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The values of each key as lists of some LISTED values each, so that none grows with the key: key, nodes."""
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > LISTED)
    part = F.pmod(F.xxhash64(value), F.ceil(F.coalesce("__n", F.lit(1)) / LISTED)).alias("__part")
    return rows.join(many, key, "left").groupBy(key, part).agg(F.collect_list(value).alias("nodes")).select(key, "nodes")


def _acyclic_closure(edges: DataFrame) -> DataFrame:
    known = frontier = materialise(edges, "closure")
    while not frontier.isEmpty():
        further = known.select(F.col("type").alias("ancestor"), F.col("ancestor").alias("next"))
        found = frontier.join(further, "ancestor").select("type", F.col("next").alias("ancestor")).where("type <> ancestor").distinct()
        frontier = materialise(found.join(known, ["type", "ancestor"], "left_anti"), "closure")
        known = known.unionByName(frontier)
    return known


def _condensed_edges(plain: DataFrame, cycles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's component (node, component), itself if it is on no cycle, and the edges between components."""
    nodes = plain.select(F.col("caller").alias("node")).unionByName(plain.select(F.col("callee").alias("node"))).distinct()
    of = materialise(nodes.join(cycles, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components-of")
    name = lambda df, side: df.join(of.toDF(side, "__c"), side).drop(side).withColumnRenamed("__c", side)
    return of, materialise(name(name(plain, "caller"), "callee").where("caller <> callee").select("caller", "callee").distinct(), "components-edges")


def leaves(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Of the nodes that each sink's callers lead to (sink, node) those that nobody else calls."""
    called = edges.where("caller <> callee").select(F.col("callee").alias("node")).distinct()
    return reached.join(called, "node", "left_anti")


def accumulated(declared: DataFrame, overwrite: bool) -> DataFrame:
    """Parents of each type from declarations (type, seq, parents): the last one's, or all, each once, in order."""
    if overwrite:
        return declared.groupBy("type").agg(F.max_by("parents", "seq").alias("parents"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "parents")))
    return declared.groupBy("type").agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["parents"]))).alias("parents"))


def late_references(methods: DataFrame, references: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """Methods with the reason of the first (or last) reference to them by ``keys``; a reason that a method has stays if none refers to it."""
    pick = F.max_by if last else F.min_by
    chosen = references.groupBy(*keys).agg(pick("reason", "seq").alias("late"))
    return methods.join(chosen, keys, "left").withColumn("entry_reason", F.coalesce("late", "entry_reason")).drop("late")


def callback_edges(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges through callback parameters: a method that calls its own parameter reaches what its callers pass there.

    methods: method_id, name, parameter_names; calls: caller_id, callee, symbols (one per argument).
    """
    parameters = methods.select("method_id", "name", F.posexplode("parameter_names").alias("position", "parameter"))
    invoked = parameters.join(calls.select(F.col("caller_id").alias("method_id"), F.col("callee").alias("parameter")).distinct(), ["method_id", "parameter"], "left_semi")
    passed = calls.select(F.col("callee").alias("name"), F.posexplode("symbols").alias("position", "symbol")).where("symbol <> ''").distinct()
    return invoked.join(passed, ["name", "position"]).select(F.col("method_id").alias("caller_id"), F.col("symbol").alias("callee")).distinct()


def without_macro_calls(calls: DataFrame, includes: DataFrame, macros: DataFrame) -> DataFrame:
    """Calls (path, callee) but those whose name is a macro of the file or of one that it includes, however far.

    includes: path, included; macros: path, name. Files that include one another are no trouble.
    """
    own = macros.select("path", F.col("name").alias("callee"))
    reach = closure(includes.select(F.col("path").alias("type"), F.col("included").alias("parent")))
    far = reach.join(own.withColumnRenamed("path", "ancestor"), "ancestor").select(F.col("type").alias("path"), "callee")
    return calls.join(own.unionByName(far).distinct(), ["path", "callee"], "left_anti")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) of undirected edges (a, b): the least node that each reaches.

    Rounds of large and small stars, each an aggregation by node over a written table, until the edges no longer change.
    A component's least node has no row of its own.
    """
    now = materialise(edges.where("a <> b").select("a", "b"), "components")
    sign = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least.hint("merge"), "a")
        small = met.select("b", "m").where("b <> m").unionByName(met.select(F.col("a").alias("b"), "m")).distinct().toDF("a", "b")
        before, now = now, materialise(small, "components")
        discard(before)
        new = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0).cast("long"))).first()
        if new == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        sign = new
    raise RuntimeError("components did not settle")


def condensed(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Strongly connected components of edges (caller, callee) of more than one node: (node, component), the component being its least node.

    Nodes that nothing calls, or that call nothing, are on no cycle and are taken off first, round by round. Of what is left, each node learns the
    least node that reaches it; the members of that node's component are those that it reaches and that reach it. They are settled, and
    the rest goes on, in the parts that the least nodes make.
    """
    left, out = materialise(edges.where("caller <> callee").select("caller", "callee").distinct(), "condensed"), None
    for _ in range(max_rounds):
        left = _on_cycles(left)
        if left.isEmpty():
            break
        forward = _least_reached(left)
        back = _least_reached(left.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")))
        # The least node that reaches a node, and that it reaches, being one, both lie on a cycle through it.
        met = materialise(forward.withColumnRenamed("least", "f").join(back.withColumnRenamed("least", "b"), "node"), "condensed-met")
        found = met.where("f = b").select("node", F.col("f").alias("component"))
        out = found if out is None else out.unionByName(found)
        part = met.select("node", "f", "b", (F.col("f") == F.col("b")).alias("done"))
        ends = lambda side: part.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("f", "b", "done")))
        within = left.join(ends("caller"), "caller").join(ends("callee"), "callee").where("NOT caller_done AND NOT callee_done AND caller_f = callee_f AND caller_b = callee_b")
        left = materialise(within.select("caller", "callee"), "condensed")
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("caller").alias("node"))
    return out if out is not None else nodes.select("node", F.col("node").alias("component")).limit(0)


def _on_cycles(edges: DataFrame) -> DataFrame:
    """The edges left when those from nodes that nothing calls, and those to nodes that call nothing, are taken off again and again."""
    n = edges.count()
    while True:
        kept = edges.join(edges.select(F.col("callee").alias("caller")).distinct(), "caller", "left_semi").join(edges.select(F.col("caller").alias("callee")).distinct(), "callee", "left_semi").select("caller", "callee")
        kept = materialise(kept, "condensed")
        left = kept.count()
        if left == n:
            return kept
        discard(edges)
        edges, n = kept, left


def _least_reached(edges: DataFrame) -> DataFrame:
    """For each node the least node from which edges (caller, callee) lead to it, itself included: (node, least).

    Each round takes the least of the callers, and of what the least node so far knows, so the ways that are followed grow by leaps. Only what
    moved in the round before is told, which late rounds send to every task instead of dealing out the edges.
    """
    nodes = edges.select(F.col("caller").alias("node")).unionByName(edges.select(F.col("callee").alias("node"))).distinct()
    now = materialise(nodes.select("node", F.col("node").alias("least"), F.lit(True).alias("moved")), "least")
    lowest = F.least("least", "by_caller", "by_least")
    while not now.where("moved").isEmpty():
        moved = now.where("moved")
        told = edges.join(moved.select(F.col("node").alias("caller"), "least"), "caller").groupBy(F.col("callee").alias("node")).agg(F.min("least").alias("by_caller"))
        leap = moved.select(F.col("node").alias("least"), F.col("least").alias("by_least"))
        step = now.select("node", "least").join(told, "node", "left").join(leap, "least", "left")
        new = materialise(step.select("node", lowest.alias("least"), (lowest < F.col("least")).alias("moved")), "least")
        discard(now)
        now = new
    return now.select("node", "least")


def leaf_sets(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of edges (caller, callee): each node's component (node, component), the leaves, methods that nobody calls, by block and bit (leaf, block, bit), and the
    sets of leaves that lead to each component (component, block, bits).

    Cycles become one node first. Then sets of leaves go down the acyclic graph as longs, one for up to 64 leaves, what is new in each round only.
    """
    plain = materialise(edges.where("caller <> callee").select("caller", "callee").distinct(), "leaves-plain")
    of, acyclic = _condensed_edges(plain, condensed(plain))
    leaf = of.join(plain.select(F.col("callee").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("leaf"))
    places = _in_blocks(leaf, "leaf")
    frontier = materialise(places.select(F.col("leaf").alias("component"), "block", F.expr("shiftleft(1L, bit)").alias("bits")), "leaves")
    rounds = [frontier]
    callees = _callers(acyclic.select(F.col("caller").alias("callee"), F.col("callee").alias("caller")))  # lists the other way round
    while not frontier.isEmpty():
        sent = _sent(frontier.withColumnRenamed("component", "node"), callees).withColumnRenamed("node", "component")
        frontier = _new_bits(sent, rounds, "component", "leaves")
        rounds.append(frontier)
    discard(callees)
    every = rounds[0]
    for df in rounds[1:]:
        every = every.unionByName(df)
    return of, places, materialise(every.groupBy("component", "block").agg(F.bit_or("bits").alias("bits")), "leaves-sets")


def leaf_components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaf_sets`` as rows: each node's component (node, component), and the leaves that lead to each component (component, leaf)."""
    of, places, sets = leaf_sets(edges)
    return of, _out_of_blocks(sets, places, "leaf").select("component", "leaf")


def leaves_of(edges: DataFrame) -> DataFrame:
    """For each method that something else calls or that calls something the leaves that lead to it: node, leaf. Sets are told by component until the last step,
    where the members of a cycle are lists."""
    of, places, sets = leaf_sets(edges)
    cycles = of.join(of.where("node <> component").select("component").distinct(), "component", "left_semi")
    single = sets.join(cycles.select("component").distinct(), "component", "left_anti").select(F.array("component").alias("nodes"), "block", "bits")
    lists = sets.join(_lists(cycles, "component", "node"), "component").select("nodes", "block", "bits")
    dealt = lists.repartition(partitions(edges.sparkSession), F.xxhash64("nodes"), "block")
    return _out_of_blocks(single.unionByName(dealt), places, "leaf").select("nodes", "leaf").select(F.explode("nodes").alias("node"), "leaf")

"""What a name holds at a place: an assignment table, and aliases followed to their ends.

An assignment holds from its place to the next one of its name in the file. So each name has a row for every stretch of
places, with the value that it has there; before its first assignment it holds nothing and has no row. A value that is
itself a name is looked up in the stretches of that name which overlap. Rows are joined with themselves, so that the
length of what is followed doubles each round: a chain of n names takes log2(n) rounds, whatever the number of places
asked about. Only rows that still lead to a name are followed; those that have come to a value are written once. Names
that lead to one without a value there, or round in a circle, hold nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinktrace.operators.graph import components
from sinktrace.storage import materialise

LAST = (1 << 62) - 1
NAME = r"^[A-Za-z_]\w*$"
_MEMBERS = r"^[A-Za-z_]\w*((->|\.)[A-Za-z_]\w*)*$"
_CONSTANTS = ("nullptr", "NULL", "true", "false", "this")


def symbol(name: Column) -> Column:
    """A name without blanks and without ``this->``."""
    bare = F.translate(name, " \t\n\x0b\f\r", "")
    return F.when(bare.startswith("this->"), F.substring(bare, 7, 1 << 30)).otherwise(bare)


def resolved(assigns: DataFrame) -> DataFrame:
    """Stretches (path, name, after, upto, value) of assignments (path, pos, name, value): what a name holds at places after < pos <= upto; where it has none, it holds nothing."""
    value = F.trim("value")
    rows = assigns.select("path", "pos", symbol(F.col("name")).alias("name"), value.alias("value"), F.when(value.rlike(NAME) & ~value.isin(*_CONSTANTS), value).alias("next"))
    by_name = Window.partitionBy("path", "name").orderBy("pos")
    held = rows.select("path", "name", F.col("pos").alias("after"), F.coalesce(F.lead("pos").over(by_name), F.lit(LAST)).alias("upto"), "value", "next")
    # A name that is given itself is a circle.
    open_ = F.coalesce(F.col("next") != F.col("name"), F.col("next").isNull())
    first = materialise(held.where("after < upto").where(open_), "aliases")
    known, now, rounds = first.where("next IS NULL"), first.where("next IS NOT NULL"), None
    while rounds is None or rounds > 0:
        ends = known.unionByName(now).select("path", F.col("name").alias("next"), F.col("after").alias("a"), F.col("upto").alias("b"), F.col("value").alias("v"), F.col("next").alias("n"))
        # Dealt out at any size: like rows are written in so little room that they would be taken for few.
        met = now.drop("value").join(ends.hint("merge"), ["path", "next"]).where("greatest(after, a) < least(upto, b)")
        further = met.select("path", "name", F.greatest("after", "a").alias("after"), F.least("upto", "b").alias("upto"), F.col("v").alias("value"), F.col("n").alias("next"))
        came = materialise(further.where(open_), "aliases")
        known, now = known.unionByName(came.where("next IS NULL")), came.where("next IS NOT NULL")
        # What is left leads through names that are left, so that their number says how often it can go on.
        most = now.groupBy("path").agg(F.countDistinct("name").alias("n")).agg(F.max("n")).first()[0]
        if most is None:
            break
        rounds = math.ceil(math.log2(most)) + 1 if rounds is None else rounds - 1
    return known.select("path", "name", "after", "upto", "value")


def held(asks: DataFrame, table: DataFrame) -> DataFrame:
    """Asks (path, pos, name and other columns) with the value that each name has at its place, null if it has none."""
    met = asks.alias("q").join(table.alias("t").hint("merge"), (F.col("q.path") == F.col("t.path")) & (F.col("q.name") == F.col("t.name")) & (F.col("t.after") < F.col("q.pos")) & (F.col("q.pos") <= F.col("t.upto")), "left")
    return met.select("q.*", F.col("t.value").alias("held"))


def allocations(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of names that are assigned to one another (path, name, group), and the places where each group is given an array and a single object (path, group, pos, array).

    What counts is a value that ``new`` makes, or a function of the file all of whose results ``new`` makes in one form.
    """
    given = spans.where("kind = 'assign'").select("path", "pos", symbol(F.col("name")).alias("name"), F.trim("value").alias("value"), F.col("receiver").alias("form"))
    right = symbol(F.col("value"))
    node = lambda name: F.concat_ws("\n", F.col("path").cast("string"), name)
    same = given.where(right.rlike(_MEMBERS) & ~right.isin(*_CONSTANTS)).select(node(F.col("name")).alias("a"), node(right).alias("b"))
    groups = components(same)
    named = given.select("path", "name").distinct().unionByName(given.where(right.rlike(_MEMBERS)).select("path", right.alias("name"))).distinct()
    of = named.join(groups.hint("merge"), node(F.col("name")) == F.col("node"), "left").select("path", "name", F.coalesce("component", node(F.col("name"))).alias("group"))
    made = spans.where("kind = 'return'").join(spans.where("kind = 'method'").select("path", F.col("pos").alias("method_pos"), F.col("name").alias("function")).hint("merge"), ["path", "method_pos"])
    array = F.col("value").contains("[")
    forms = made.where(F.col("value").rlike(r"^new\b")).groupBy("path", "function").agg(F.min(array).alias("least"), F.max(array).alias("most")).where("least = most").select("path", F.col("function").alias("form"), F.col("least").alias("array"))
    direct = given.where(F.col("value").rlike(r"^new\b")).select("path", "name", "pos", array.alias("array"))
    by_call = given.where("form <> ''").join(forms.hint("merge"), ["path", "form"]).select("path", "name", "pos", "array")
    return of, direct.unionByName(by_call).join(of.hint("merge"), ["path", "name"]).groupBy("path", "group", "array").agg(F.min("pos").alias("pos"))


def allocation_forms(asks: DataFrame, of: DataFrame, made: DataFrame) -> DataFrame:
    """Asks (path, pos, name and other columns) with ``array``: whether what the name holds was made as an array; null if that is not known or not of one form.

    What its group was given before the place counts; if that is nothing, what the whole file gives it.
    """
    wide = made.groupBy("path", "group").agg(F.min(F.when(F.col("array"), F.col("pos"))).alias("arrays"), F.min(F.when(~F.col("array"), F.col("pos"))).alias("singles"))
    met = asks.join(of.hint("merge"), ["path", "name"], "left").join(wide.hint("merge"), ["path", "group"], "left")
    at = lambda c: F.coalesce(F.col(c) < F.col("pos"), F.lit(False))
    some = lambda a, s: F.when(a & ~s, True).when(s & ~a, False)
    form = F.when(at("arrays") | at("singles"), some(at("arrays"), at("singles"))).otherwise(some(F.col("arrays").isNotNull(), F.col("singles").isNotNull()))
    return met.select(*asks.columns, form.alias("array"))


def passed_forms(asks: DataFrame, spans: DataFrame, of: DataFrame, made: DataFrame) -> DataFrame:
    """The same for names (path, pos, name, method_pos) that are parameters: by what all calls of their function, in any file, pass there."""
    methods = spans.where("kind = 'method'").select("path", F.col("pos").alias("method_pos"), F.col("name").alias("function"), F.posexplode("args").alias("k", "parameter"))
    own = asks.join(methods.hint("merge"), ["path", "method_pos"]).where(F.regexp_extract("parameter", r"(\w+)\s*(?:=.*)?$", 1) == F.col("name"))
    calls = spans.where("kind = 'call'").select(F.col("path").alias("from"), F.col("pos").alias("call_pos"), F.col("name").alias("function"), F.posexplode("args").alias("k", "passed"))
    asked = own.select("function", "k").distinct()
    sites = calls.join(asked.hint("merge"), ["function", "k"], "left_semi")
    direct = sites.where(F.col("passed").rlike(r"^new\b")).select("function", "k", F.col("passed").contains("[").alias("array"))
    by_name = allocation_forms(sites.where(F.col("passed").rlike(NAME)).select(F.col("from").alias("path"), F.col("call_pos").alias("pos"), F.col("passed").alias("name"), "function", "k"), of, made).select("function", "k", "array").where("array IS NOT NULL")
    forms = direct.unionByName(by_name).groupBy("function", "k").agg(F.min("array").alias("least"), F.max("array").alias("most")).where("least = most").select("function", "k", F.col("least").alias("array"))
    return own.join(forms.hint("merge"), ["function", "k"]).select(*asks.columns, "array")

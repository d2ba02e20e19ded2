"""Routes that programs declare by calls: Rails route files, Laravel's facade, and Ktor's nested blocks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinktrace.functions.text import camelized
from sinktrace.operators.indexing import masked

# What one line of ``resources`` stands for: action, verb, and what follows the resource's name in the route.
RESOURCE_ACTIONS = (("index", "GET", ""), ("create", "POST", ""), ("new", "GET", "/new"), ("edit", "GET", "/:id/edit"), ("show", "GET", "/:id"), ("update", "PATCH", "/:id"), ("destroy", "DELETE", "/:id"))
KTOR_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")

_REST = r"(?:[^\n]|(?<=[,\[\(])[ \t]*\n|\n(?=\s*[\]\)]))"  # of a call whose arguments may go on in the next line
_VERB = rf"(?m)^\s*(get|post|put|patch|delete)\b[ \t(]*([^,\n]+),{_REST}*?\bto:\s*[\"']([\w/]+)#(\w+)[\"']"
_RESOURCES = rf"(?m)^\s*resources\b[ \t(]*:(\w+)({_REST}*)"
_FACADE = r"\bRoute::(get|post|put|patch|delete|options|any)\s*\(\s*[\"']([^\"']*)[\"']\s*,\s*(?:\[\s*([\w\\]+)::class\s*,\s*[\"'](\w+)[\"']|[\"']([\w\\]+)@(\w+)[\"'])"
_HEAD = re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|(?<![\w.])(?P<name>route|" + "|".join(KTOR_VERBS) + r")\s*(?:\((?P<args>(?:\"(?:[^\"\\\n]|\\.)*\"|[^()\"])*)\))?\s*\{|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)'|(?P<mark>[{}])", re.S)


def _each(code: DataFrame, pattern: str) -> tuple[DataFrame, object]:
    """A row for each match in the texts, numbered by place, and its groups as columns."""
    found = code.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("at", "m"))
    return found, lambda n: F.regexp_extract("m", pattern, n)


def _controller(name: Column) -> Column:
    return F.concat(camelized(F.element_at(F.split(name, "/"), -1)), F.lit("Controller"))


def declared_routes(files: DataFrame) -> DataFrame:
    """Routes that Ruby and PHP files (path, lang, text) declare by calls: path, at, verb, route, class_name, action.

    ``resources`` gives its seven actions, fewer with ``only:`` or ``except:``. A route that isn't a literal is told as ?. ``at`` orders the
    routes of a file, those of one verb before ``resources``. Comments are no routes; a null text and other languages give none.
    """
    code = masked(files.where(F.col("lang").isin("ruby", "php") & F.col("text").isNotNull()), False)
    ruby, php = code.where("lang = 'ruby'"), code.where("lang = 'php'")
    found, group = _each(ruby, _VERB)
    literal = F.regexp_extract(F.trim(group(2)), r"^(?:[\"']([^\"']*)[\"']|:(\w+))$", 1)
    symbol = F.regexp_extract(F.trim(group(2)), r"^:(\w+)$", 1)
    quoted = F.trim(group(2)).rlike(r"^[\"'][^\"']*[\"']$")
    route = F.when(quoted, literal).when(symbol != "", symbol).otherwise("?")
    single = found.select("path", "at", F.upper(group(1)).alias("verb"), route.alias("route"), _controller(group(3)).alias("class_name"), group(4).alias("action"))
    found, group = _each(ruby, _RESOURCES)
    names = lambda key: F.regexp_extract_all(F.regexp_extract(group(2), rf"\b{key}:\s*\[([^\]]*)\]", 1), F.lit(r":(\w+)"), F.lit(1))
    given = lambda key: group(2).rlike(rf"\b{key}:\s*\[")
    told = found.select("path", "at", group(1).alias("name"), F.when(given("only"), names("only")).alias("only"), F.when(given("except"), names("except")).alias("but"))
    action = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(a).alias("action"), F.lit(v).alias("verb"), F.lit(s).alias("tail")) for i, (a, v, s) in enumerate(RESOURCE_ACTIONS))))
    several = told.select("*", action.alias("a")).where("(only IS NULL OR array_contains(only, a.action)) AND (but IS NULL OR NOT array_contains(but, a.action))")
    several = several.select("path", ((F.col("at") + 1_000_000) * 8 + F.col("a.k")).cast("int").alias("at"), "a.verb", F.concat(F.lit("/"), "name", "a.tail").alias("route"), _controller(F.col("name")).alias("class_name"), "a.action")
    found, group = _each(php, _FACADE)
    owner = F.element_at(F.split(F.concat(group(3), group(5)), r"\\"), -1)
    facade = found.select("path", "at", F.upper(group(1)).alias("verb"), group(2).alias("route"), owner.alias("class_name"), F.concat(group(4), group(6)).alias("action"))
    return single.unionByName(several).unionByName(facade)


def _handlers(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Verb, route, first and last line of each handler block; blocks of routes around it add their segments. A block that never closes is none."""
    stack: list[tuple[str, str, int]] = []  # kind, route up to here, place
    starts = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]
    line = lambda at: bisect_right(starts, at)
    for m in _HEAD.finditer(text):
        prefix = stack[-1][1] if stack else ""
        if m["name"]:
            segment = re.search(r"\"((?:[^\"\\\n]|\\.)*)\"", m["args"] or "")
            stack.append((m["name"], prefix + (segment[1] if segment else ""), m.start("name")))
        elif m["mark"] == "{":
            stack.append(("", prefix, m.start()))
        elif m["mark"] == "}" and stack:
            kind, route, at = stack.pop()
            if kind in KTOR_VERBS:
                yield kind.upper(), route, line(at), line(m.start())


def nested_handlers(files: DataFrame) -> DataFrame:
    """Handler blocks of Kotlin files (path, lang, text): path, verb, route, start_line, end_line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *h) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for h in _handlers(t)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "verb", "route", "start_line", "end_line"])

    code = masked(files.where("lang = 'kotlin' AND text IS NOT NULL"), False)
    return code.select("path", "text").mapInArrow(run, "path string, verb string, route string, start_line int, end_line int")

"""Rules that a line or a statement matches, and the checks that settle what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sinktrace.operators import aliases, validators
from sinktrace.operators.indexing import masked
from sinktrace.operators.spans import tracked
from sinktrace.storage import materialise

# A value that is no constant: it holds a name that is neither quoted nor written in capitals.
_VALUE = r"(?:\s*\"[^\"]*\"\s*[,+])*[^;\"]*?(?<![\"\w$.])(?!(?:new|null|true|false|this)\b)[a-z_$][\w$]*(?:\.[\w$]+|\([^;]*?\))*[^;]*?"

# Patterns of our own; the ids, weakness classes, severities and checks are fixed values.
RULES = (
    ("CPP001", "cpp", r"(?<![\w.>])(?:std::|::)?(strcpy|strcat|sprintf|gets)\s*\(", "CWE-120", "ERROR", "standard-function-call"),
    ("CPP002", "cpp", r"(?<![\w.>])(?:std::|::)?system\s*\(", "CWE-78", "ERROR", "standard-function-call"),
    ("CPP003", "cpp", r"(?<![\w.>])(?:::)?(popen|exec[lv]p?e?)\s*\(", "CWE-78", "ERROR", "standard-function-call"),
    ("CPP004", "cpp", r"(?<![\w.>])(?:std::|::)?memcpy\s*\(", "CWE-120", "WARNING", "standard-function-call,memcpy-bounds"),
    ("CPP005", "cpp", r"\bdelete\s*(\[\s*\])?\s*[A-Za-z_][\w.>-]*\s*;", "CWE-762", "ERROR", "new-delete-mismatch"),
    ("CPP006", "cpp", r"(?<![\w*/])\*\s*[A-Za-z_]\w*\s*[=;.)]|\b[A-Za-z_]\w*\s*->", "CWE-476", "ERROR", "null-dereference"),
    ("CPP007", "cpp", r"(?i)\b\w*(password|passwd|secret|token|api_?key)\w*\s*(\[\s*\])?\s*=(?!=)", "CWE-798", "WARNING", "hardcoded-secret"),
    ("CPP008", "cpp", r"(?<![\w.>])(?:std::|::)?(mktemp|tmpnam|chmod|fopen|open)\s*\(", "CWE-377", "WARNING", "standard-function-call,dangerous-file-operation"),
    ("python-sql-format", "python", r"\.execute\s*\(\s*(f[\"']|[\"'][^\"']*[\"']\s*(%|\+|\.format\b)|\w+\s*\+)", "CWE-89", "ERROR", ""),
    ("kotlin-sql-format", "kotlin", r"\.(executeQuery|executeUpdate|rawQuery|execSQL|createNativeQuery)\s*\(\s*(\"[^\"]*(\$\{?\w)|\"[^\"]*\"\s*\+)", "CWE-89", "ERROR", ""),
    ("rust-sql-format", "rust", r"(query|execute|prepare)\w*\s*\(\s*&?(format!\s*\(|String::from\([^)]*\)\s*\+|\"[^\"]*\"\.to_string\(\)\s*\+)", "CWE-89", "ERROR", ""),
    ("rust-shell-argument", "rust", r"Command::new\(\s*\"(/bin/)?(ba|z)?sh\"\s*\)\s*\.arg\(\s*\"-c\"\s*\)\s*\.arg\(\s*[^\")]", "CWE-78", "ERROR", ""),
    ("mybatis-substitution", "xml", r"\$\{(?!criterion\.condition\})[^}]*\}", "CWE-89", "ERROR", ""),
)

# The same for statements, which may spread over several lines; those of more than one statement are in ``matching``.
STATEMENT_RULES = (
    ("java-location-header", "java", r"(?:sendRedirect\s*\(|(?:set|add)Header\s*\(\s*\"Location\"\s*,)" + _VALUE + r"\)", "CWE-601", "WARNING", ""),
    ("java-spel-expression", "java", r"new\s+SpelExpressionParser\s*\([^)]*\)\s*\.parseExpression\s*\(" + _VALUE + r"\)", "CWE-917", "ERROR", ""),
)
_COLUMNS = "rule_id string, lang string, pattern string, cwe string, severity string, validators string"

VALIDATORS = ("standard-function-call", "memcpy-bounds", "new-delete-mismatch", "null-dereference", "hardcoded-secret", "dangerous-file-operation")


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), _COLUMNS)


def statement_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATEMENT_RULES), _COLUMNS)


def scan(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (path, line_no, col, rule_id, cwe, severity, validators, statement), one for each match of a rule in lines (path, lang, line_no, text) of its language.

    ``col`` is where the match begins, ``statement`` the match and what follows it
    up to the end of the statement. A match in a statement of several lines has the line where it
    begins. Each pattern is a literal of the plan, so it is compiled once; comments have to be blanked before.
    """
    rows = rules.collect()  # a few dozen
    which = [F.when((F.col("lang") == r.lang) & F.col("text").rlike(r.pattern), F.lit(k)) for k, r in enumerate(rows)]
    # Lines that some rule matches are few; they are written, so that each line is searched once.
    some = materialise(lines.select("path", "line_no", "text", F.explode(F.array_compact(F.array(*which))).alias("k")), "rules-lines")

    def of_rule(value) -> Column:
        out = F.lit(None)
        for k, r in enumerate(rows):
            out = F.when(F.col("k") == k, value(r)).otherwise(out)
        return out

    met = some.withColumn("found", of_rule(lambda r: F.regexp_extract_all("text", F.lit(f"({r.pattern})"), F.lit(0)))).withColumn("between", of_rule(lambda r: F.split("text", r.pattern, -1)))
    hits = met.select("path", "line_no", "text", "k", F.explode(F.transform("found", lambda m, i: _length(F.slice("between", 1, i + 1)) + _length(F.slice("found", 1, i)))).alias("at"))
    before = F.substring("text", F.lit(1), F.col("at"))
    first = F.col("line_no") + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    col = F.length(F.substring_index(before, "\n", -1))
    told = [of_rule(lambda r, c=c: F.lit(r[c])).alias(c) for c in ("rule_id", "cwe", "severity", "validators")]
    # The statement ends at a semicolon outside of literals.
    statement = F.regexp_extract(F.substring("text", F.col("at") + 1, F.length("text")), r'^(?:"(?:[^"\\]|\\.)*+"|[^;])*+;?', 0)
    return hits.select("path", first.cast("int").alias("line_no"), col.alias("col"), *told, statement.alias("statement"))


def _length(parts: Column) -> Column:
    """The length of all texts in an array."""
    return F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))


def statements_of(lines: DataFrame) -> DataFrame:
    """Statements of a file's lines: path, lang, line_no (where each begins), text. A line that ends in ; { or } ends one."""
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.col("text").rlike(r"[;{}]\s*$"), 1).otherwise(0)
    numbered = lines.withColumn("statement", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return numbered.groupBy("path", "lang", "statement").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text")).drop("statement")


def _asks(name: str) -> Column:
    return F.array_contains(F.transform(F.split("validators", ","), F.trim), name)


def validated(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits whose checks pass against their files (path, lang, text), with the details of copies: message, rule_confidence, static_analysis.

    A name that is no check fails, none passes. What names hold is looked up in one table for all hits (``aliases``); a file's text is read for calls
    of functions that it may define itself, and for the few uses of what is null. Rows are dealt out for every join: tables of like rows are written
    in so little room that Spark would take them for small ones and send them through the driver.
    """
    listed = F.filter(F.split("validators", ","), lambda n: F.trim(n) != "")
    known = hits.where(F.size(F.array_except(F.transform(listed, F.trim), F.array(*map(F.lit, VALIDATORS)))) == 0).withColumn("pos", F.shiftleft(F.col("line_no").cast("long"), 20) + F.col("col"))
    known = materialise(known.where("pos IS NOT NULL"), "rules-hits").hint("merge")
    code = materialise(masked(files.where("lang = 'cpp'"), False), "rules-code").hint("merge")
    spans = materialise(tracked(code).where("kind IN ('assign', 'method', 'call', 'return', 'delete')"), "rules-spans").hint("merge")
    table = materialise(aliases.resolved(spans.where("kind = 'assign'").select("path", "pos", "name", "value")), "rules-aliases").hint("merge")
    place = ["path", "pos", "rule_id"]
    of = lambda check: known.where(_asks(check)).select(*place, "statement")

    called = of("standard-function-call").join(code.select("path", "text"), "path")
    standard = called.where(validators.standard_call(F.col("statement"), F.col("text"), F.regexp_extract("statement", r"(\w+)\s*\(", 1)))
    # What is known of a copy is written once, for several columns are made of it.
    known_of = materialise(of("memcpy-bounds").join(code.select("path", "text"), "path").select(*place, validators.copied(F.col("statement"), F.col("text")).alias("x")).select(*place, "x.*"), "rules-copies").hint("merge")
    bounded = known_of.withColumn("bounds", validators.bounds_of(F.col("own"), F.col("room"), F.col("length")))
    copies = bounded.where("bounds <> 'safe'").withColumn("details", validators.details_of(F.col("bounds"), F.col("room"), F.col("length")))
    # Deletions by the form in which their name's group was made, or what calls pass for a parameter.
    deleted = of("new-delete-mismatch").join(spans.where("kind = 'delete'").select("path", "pos", "method_pos", aliases.symbol(F.col("name")).alias("name"), (F.col("value") == "[]").alias("as_array")), ["path", "pos"])
    groups, made = aliases.allocations(spans)
    formed = materialise(aliases.allocation_forms(deleted, groups, made), "rules-forms").hint("merge")
    passed = aliases.passed_forms(formed.where("array IS NULL").drop("array"), spans, groups, made)
    mismatched = formed.where("array IS NOT NULL").unionByName(passed).where("array <> as_array")
    # Uses of a name that holds null, unless a test right before them leaves.
    used = aliases.held(of("null-dereference").withColumn("name", validators.used_name(F.col("statement"))), table).where(validators.is_null(F.col("held")))
    lines = F.split("text", r"\r\n|\r|\n")
    line_no, col = F.shiftright("pos", 20).cast("int"), F.col("pos").bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
    before = F.concat(F.array_join(F.slice(lines, 1, line_no - 1), "\n"), F.lit("\n"), F.substring(F.element_at(lines, line_no), F.lit(1), col))
    nulls = used.join(code.select("path", "text"), "path").where(~validators.guarded(before, F.col("name")))
    given = aliases.held(of("hardcoded-secret").withColumn("value", validators.secret_value(F.col("statement"))).withColumn("name", F.when(F.col("value").rlike(aliases.NAME), F.col("value"))), table)
    secrets = given.where(validators.holds_literal(F.col("value")) | validators.holds_literal(F.col("held")))
    opened = aliases.held(of("dangerous-file-operation").withColumn("name", validators.opened_path(F.col("statement"))), table)
    dangerous = opened.where(validators.dangerous_file_operation(F.col("statement"), F.col("held")))

    passes = None
    for check, passing in zip(VALIDATORS, (standard, copies, mismatched, nulls, secrets, dangerous), strict=True):
        found = passing.select(*place, F.lit(check).alias("check"))
        passes = found if passes is None else passes.unionByName(found)
    asked = known.select(*place, F.explode(F.filter(F.transform(F.split("validators", ","), F.trim), lambda n: n != "")).alias("check"))
    failed = asked.join(passes.distinct().hint("merge"), [*place, "check"], "left_anti").select(*place).distinct()
    out = known.join(failed.hint("merge"), place, "left_anti")
    details = copies.select(*place, "details.*").distinct()
    return out.join(details.hint("merge"), place, "left").select(*hits.columns, *(c for c in details.columns if c not in place))

"""Methods and calls of source files, as joins and windows over their lines.

Comments and literals are blanked first, so braces and names count only in code. A declaration opens a block at
a level (of braces, or of indentation); the block ends at the next line that closes that level in the file. Calls
belong to the innermost block around them. Declarations are recognised on one line; one that spreads over several
lines is recognised by the line that holds its name and opening parenthesis.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinktrace.operators.context import lines_of
from sinktrace.storage import materialise

# Patterns of declarations by language: group 1 is the name, group 2 the parameters.
DECLARATIONS = {
    "java": r"^\s*(?!(?:return|new|throw|else)\b)(?:[\w@<>\[\],.?&]+\s+)+([A-Za-z_$]\w*)\s*\(([^)]*)\)?[^;={]*(?:\{.*)?$",
    "csharp": r"^\s*(?!(?:return|new|throw|else)\b)(?:[\w<>\[\],.?]+\s+)+([A-Za-z_]\w*)\s*\(([^)]*)\)?[^;={]*(?:\{.*)?$",
    "cpp": r"^\s*(?!(?:return|new|throw|else)\b)(?:[\w:<>*&,~]+\s+[*&]*)+(?:\w+::)*(~?[A-Za-z_]\w*)\s*\(([^)]*)\)?[^;={]*(?:\{.*)?$",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*|(?:const|let|var)\s+(?=[\w$]+\s*=\s*(?:async\s*)?(?:function\b|\()))([A-Za-z_$][\w$]*)\s*(?:=\s*(?:async\s*)?(?:function)?\s*)?\(([^)]*)\)?.*$",
    "go": r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(([^)]*)\)?.*$",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+([A-Za-z_]\w*)[^(]*\(([^)]*)\)?.*$",
    "php": r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?([A-Za-z_]\w*)\s*\(([^)]*)\)?.*$",
    "kotlin": r"^\s*(?:[\w@]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w<>.]+\.)?([A-Za-z_]\w*)\s*\(([^)]*)\)?.*$",
    "scala": r"^\s*(?:[\w@]+\s+)*def\s+([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(?([^)]*)\)?.*$",
    "ruby": r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)\s*\(?([^)]*)\)?.*$",
    "python": r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)?.*$",
}
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "throw", "sizeof", "function", "fn", "func", "def", "fun", "when", "match", "with", "lock", "using", "synchronized", "super", "and", "or", "not", "in", "elif", "assert", "print")
_LINE_COMMENT = {"python": "#", "ruby": "#", "php": "//"}


_QUOTES = {"dd": '"""', "ss": "'''", "bb": "```", "d": '"', "s": "'", "b": "`"}


@cache
def _marks(lang: str) -> re.Pattern:
    """Comments and literals of a language, each from where it begins to its end or that of its line or text. A literal's group is named by its quote, and tells apart whether it is closed."""
    comments = [re.escape(_LINE_COMMENT.get(lang, "//")) + r"[^\n]*", *([] if lang in ("python", "ruby") else [r"/\*[\s\S]*?(?:\*/|\Z)"])]
    parts = [f"(?P<comment>{'|'.join(comments)})"]
    for name, q in _QUOTES.items():
        if len(q) == 3 and lang not in ("python", "kotlin", "scala", "java"):
            continue
        body = rf"(?:\\[\s\S]?|(?!{q})[^\\])*" if len(q) == 3 else r"(?:\\[\s\S]?|[^\\`])*" if q == "`" else rf"(?:\\[\s\S]?|[^\\\n{q}])*"
        begin = r"'(?=[\s\S]')" if name == "s" and lang in ("rust", "scala", "kotlin") else q  # a lifetime or symbol else
        parts.append(f"(?P<{name}>{begin}{body}(?P<{name}_end>{q})?)")
    return re.compile("|".join(parts))


def mask(text: str, lang: str, literals: bool = True) -> str:
    """The text with comments and, unless they are to stay, the insides of literals blanked; lines and columns stay."""
    blank = lambda s: re.sub(r"[^\r\n]", " ", s)

    def blanked(m: re.Match) -> str:
        name = m.lastgroup
        if name == "comment":
            return blank(m[0])
        if not literals:
            return m[0]
        quote = _QUOTES[name]
        close = m[f"{name}_end"] or ""
        body = m[0][len(quote) : len(m[0]) - len(close)]
        return quote + blank(body) + (" " * len(close) if "\n" in body else close)  # the end of a literal of several lines isn't code

    return _marks(lang).sub(blanked, text)


# Patterns of types: group 1 is the name, group 2 what follows it on the line, where its supertypes stand.
TYPES = {
    "java": r"^\s*(?:[\w@]+\s+)*(?:class|interface|enum|record)\s+([A-Za-z_$][\w$]*)(.*)$",
    "kotlin": r"^\s*(?:[\w@]+\s+)*(?:class|interface|object)\s+([A-Za-z_]\w*)(.*)$",
    "scala": r"^\s*(?:[\w@]+\s+)*(?:class|trait|object)\s+([A-Za-z_]\w*)(.*)$",
    "csharp": r"^\s*(?:[\w\[\]]+\s+)*(?:class|interface|struct|record)\s+([A-Za-z_]\w*)(.*)$",
    "php": r"^\s*(?:[\w]+\s+)*(?:class|interface|trait)\s+([A-Za-z_]\w*)(.*)$",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(.*)$",
    "cpp": r"^\s*(?:class|struct)\s+(?:[A-Z_]+\s+)?([A-Za-z_]\w*)([^;]*)$",
    "rust": r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)(.*)$",
    "python": r"^\s*class\s+([A-Za-z_]\w*)(.*)$",
    "ruby": r"^\s*(?:class|module)\s+([A-Z]\w*(?:::\w+)*)(.*)$",
}
_COLON = ("kotlin", "rust", "scala", "python", "javascript")  # a parameter is a name, a colon and a type


def supertypes_in(tail: Column, lang: Column, text: Column) -> Column:
    """The short names of the supertypes that follow a type's name, in order."""
    listed = (
        F.when(lang.isin("java", "php", "javascript", "scala"), F.regexp_replace(F.regexp_extract(tail, r"\b((?:extends|implements|with)\b[^{]*)", 1), r"\b(extends|implements|with)\b", ","))
        .when(lang.isin("csharp", "kotlin"), F.regexp_extract(F.regexp_replace(tail, r"^\s*(<[^>]*>)?\s*(\([^)]*\))?", ""), r"^\s*:\s*([^{]*)", 1))
        .when(lang == "cpp", F.regexp_extract(tail, r":(?!:)\s*([^{]*)", 1))
        .when(lang == "python", F.regexp_extract(tail, r"^\s*\(([^)]*)\)", 1))
        .when(lang == "ruby", F.regexp_extract(tail, r"^\s*<\s*([\w:]+)", 1))
        .when(lang == "rust", F.regexp_extract(text, r"impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\b", 1))
        .otherwise("")
    )
    bare = F.transform(F.split(F.regexp_replace(listed, r"<[^>]*>|\([^)]*\)|\b(public|private|protected|virtual)\b", " "), ","), lambda x: F.regexp_extract(x, r"(\w+)\s*$", 1))
    return F.filter(bare, lambda x: x != "")


def masked(files: DataFrame, literals: bool = True) -> DataFrame:
    """Files (path, lang, text) with the text masked; without ``literals`` comments alone are blanked."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [mask(t, g, literals) for t, g in zip(pdf["text"], pdf["lang"], strict=True)]
            yield pdf

    return files.select("path", "lang", "text").mapInPandas(run, f"path {files.schema['path'].dataType.simpleString()}, lang string, text string")


def _levels(lines: DataFrame) -> DataFrame:
    """Lines with their level of blocks before and after them: of braces, of indentation, or of words that open and end blocks."""
    by_line = Window.partitionBy("path").orderBy("line_no")
    indented, worded = F.col("lang") == "python", F.col("lang") == "ruby"
    opens = F.regexp_count("text", F.lit(r"^\s*(?:def|class|module|if|unless|while|until|for|case|begin)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$"))
    step = F.when(worded, opens - F.regexp_count("text", F.lit(r"^\s*end\b"))).otherwise(F.regexp_count("text", F.lit(r"\{")) - F.regexp_count("text", F.lit(r"\}")))
    indent = F.length("text") - F.length(F.ltrim("text"))
    rows = lines.where(~indented | (F.trim("text") != "")).withColumn("after", F.when(indented, indent).otherwise(F.sum(step).over(by_line.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(by_line), F.lit(0)))
    return rows.withColumn("level", F.when(indented, F.col("after")).otherwise(F.col("before")))


def _with_ends(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks that lines of ``found`` (rows with more columns) open, each with the line that ends it."""
    indented, worded = F.col("lang") == "python", F.col("lang") == "ruby"
    # A line ends the blocks of the levels that it closes: those down to its own indentation, or of its closing braces.
    low = F.when(indented, F.col("after")).otherwise(F.least("after", "before"))
    high = F.when(indented, F.col("before")).otherwise(F.greatest(F.col("before") - 1, low))
    ends = F.when(indented, F.col("line_no") - 1).otherwise(F.col("line_no"))
    closes = (indented & (F.col("after") <= F.col("before"))) | (~indented & ~worded & F.col("text").contains("}")) | (worded & F.col("text").rlike(r"^\s*end\b"))
    closing = rows.where(closes).select("path", F.explode(F.sequence(low, high)).alias("level"), F.when(indented, F.col("line_no") - 1).otherwise(F.col("line_no")).alias("at"), ends.alias("ends"))
    events = found.withColumn("at", F.col("line_no")).withColumn("ends", F.lit(None).cast("int")).unionByName(closing, allowMissingColumns=True)
    next_end = F.min("ends").over(Window.partitionBy("path", "level").orderBy("at").rangeBetween(0, Window.unboundedFollowing))
    last = rows.groupBy("path").agg(F.max("line_no").alias("last"))
    closed = events.withColumn("end_line", next_end).where("name IS NOT NULL").join(last, "path")
    return closed.withColumn("start_line", F.col("line_no")).withColumn("end_line", F.coalesce("end_line", "last")).drop("at", "ends", "last", "line_no", "text", "before", "after", "level")


def _matching(patterns: dict[str, str], group: int) -> Column:
    out = F.lit(None).cast("string")
    for lang, pattern in patterns.items():
        out = F.when(F.col("lang") == lang, F.regexp_extract("text", pattern, group)).otherwise(out)
    return out


def types_of(lines: DataFrame) -> DataFrame:
    """Types in masked lines: path, lang, name, supertypes, start_line, end_line."""
    rows = _levels(lines)
    found = rows.withColumn("name", _matching(TYPES, 1)).where("name <> ''").withColumn("supertypes", supertypes_in(_matching(TYPES, 2), F.col("lang"), F.col("text")))
    return _with_ends(rows, found)


def methods_of(lines: DataFrame) -> DataFrame:
    """Declarations in masked lines (path, lang, line_no, text): path, name, arity, return_type, parameter_types, parameter_names, start_line, end_line."""
    rows = _levels(lines)
    found = rows.withColumn("name", _matching(DECLARATIONS, 1)).withColumn("parameters", F.trim(_matching(DECLARATIONS, 2))).where(F.col("name").isNotNull() & (F.col("name") != "") & ~F.col("name").isin(*KEYWORDS))
    lang = F.col("lang")
    given = F.filter(F.split(F.regexp_replace("parameters", r"<[^<>]*>", ""), ","), lambda p: (F.trim(p) != "") & ~(lang.isin("python", "rust") & F.trim(p).rlike(r"^&?(mut\s+)?(self|cls)$")))
    arity = F.when(F.col("parameters").rlike(r"\*\w|\.\.\.") & lang.isin("python", "ruby", "java", "javascript", "php", "go"), -1).when(F.col("parameters").contains("..."), -1).otherwise(F.size(given))
    plain = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"=.*$", ""), r"@\w+(\([^)]*\))?|\bfinal\b", ""))
    named = F.transform(given, lambda p: F.when(lang.isin(*_COLON), F.regexp_extract(plain(p), r"^(?:mut\s+)?([\w$]+)", 1)).when(lang == "go", F.regexp_extract(plain(p), r"^(\w+)", 1)).otherwise(F.regexp_extract(plain(p), r"(\w+)\s*(?:\[\s*\])?$", 1)))
    typed = F.transform(given, lambda p: F.when(lang.isin(*_COLON), F.trim(F.regexp_extract(plain(p), r"^[^:]*:(.*)$", 1))).when(lang == "go", F.regexp_extract(plain(p), r"^\w+\s+(.*)$", 1)).otherwise(F.trim(F.regexp_extract(plain(p), r"^(.*?)\$?\w+\s*(?:\[\s*\])?$", 1))))
    returned = (
        F.when(lang.isin("java", "csharp", "cpp"), F.regexp_extract("text", r"([\w<>\[\].?:]+)[\s*&]+(?:\w+::)*~?[A-Za-z_$][\w$]*\s*\(", 1))
        .when(lang.isin("kotlin", "scala", "javascript", "php"), F.regexp_extract("text", r"\)\s*:\s*([\w<>\[\].?|]+)", 1))
        .when(lang.isin("rust", "python"), F.regexp_extract("text", r"\)\s*->\s*([^{:]+?)\s*[{:]", 1))
        .when(lang == "go", F.regexp_extract("text", r"\)\s*([\w.*\[\]]+)\s*\{", 1))
        .otherwise("")
    )
    told = found.withColumn("arity", arity).withColumn("return_type", returned).withColumn("parameter_types", typed).withColumn("parameter_names", named).drop("parameters")
    return _with_ends(rows, told).select("path", "name", "arity", "return_type", "parameter_types", "parameter_names", "start_line", "end_line")


def owned(methods: DataFrame, types: DataFrame) -> DataFrame:
    """Methods with the innermost type around each: owner and owner_supertypes, empty where there is none."""
    inside = methods.select("path", "name", "start_line").join(types.select("path", F.col("name").alias("owner"), "supertypes", F.col("start_line").alias("a"), F.col("end_line").alias("b")), "path").where("start_line > a AND start_line <= b")
    best = inside.groupBy("path", "name", "start_line").agg(F.min_by(F.struct("owner", "supertypes"), F.struct(F.col("b") - F.col("a"), "a")).alias("t"))
    none = F.array().cast("array<string>")
    return methods.join(best, ["path", "name", "start_line"], "left").withColumn("owner", F.coalesce("t.owner", F.lit(""))).withColumn("owner_supertypes", F.coalesce("t.supertypes", none)).drop("t")


def literals_of(files: DataFrame) -> DataFrame:
    """String literals that could be names of methods: literal, file."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\"']([A-Za-z_$][A-Za-z0-9_$]{2,63})[\"']"), F.lit(1))))
    return files.select(F.col("path").alias("file"), found.alias("literal")).select("literal", "file")


def calls_of(lines: DataFrame) -> DataFrame:
    """Call sites in masked lines: path, line_no, receiver, callee, arity (-1 if the arguments go on in the next line)."""
    import re

    import pandas as pd

    site = re.compile(r"(?:([\w$]+)\s*(?:\.|->|::)\s*)?([A-Za-z_$][\w$]*)\s*\(")

    def arguments(text: str) -> int:
        depth, commas, some = 0, 0, False
        for c in text:
            if c in ")]}" and depth == 0:
                return commas + some
            depth += (c in "([{") - (c in ")]}")
            commas += c == "," and depth == 0
            some = some or not c.isspace()
        return -1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, n, m[1] or "", m[2], arguments(t[m.end() :])) for p, n, t in zip(pdf["path"], pdf["line_no"], pdf["text"], strict=True) for m in site.finditer(t) if m[2] not in KEYWORDS]
            yield pd.DataFrame(rows, columns=["path", "line_no", "receiver", "callee", "arity"])

    some = lines.where(F.contains("text", F.lit("("))).select("path", "line_no", "text")
    return some.mapInPandas(run, "path string, line_no int, receiver string, callee string, arity int")


def index(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Methods with their owners, and calls with the innermost method around them (caller, caller_line, receiver_is_self)."""
    code = masked(files)
    # Both methods and calls read the masked lines: they are written once, so that no file is masked twice.
    lines = materialise(lines_of(code, "lang"), "index-lines")
    methods = owned(methods_of(lines), types_of(lines))
    own = methods.select("path", F.col("name").alias("callee"), F.col("start_line").alias("line_no"))
    sites = calls_of(lines).join(own, ["path", "callee", "line_no"], "left_anti")
    around = sites.select("path", "line_no").distinct().join(methods, "path").where("line_no BETWEEN start_line AND end_line")
    inner = around.groupBy("path", "line_no").agg(F.min_by(F.struct("name", "start_line"), F.struct(F.col("end_line") - F.col("start_line"), "start_line")).alias("m"))
    return methods, sites.join(inner, ["path", "line_no"], "left").select("path", "line_no", "receiver", "callee", "arity", F.col("m.name").alias("caller"), F.col("m.start_line").alias("caller_line"), F.col("receiver").isin("", "this", "self").alias("receiver_is_self"))

"""Column expressions on paths, weakness names, free text and model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def short_location(path: Column, keep: int = 2) -> Column:
    """The last segments of a path; an ellipsis stands for the others."""
    parts = F.filter(F.split(slashed(path), "/"), lambda p: p != "")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - keep + 1, F.lit(1)), F.lit(keep)), "/")
    return F.when(F.size(parts) <= keep, F.array_join(parts, "/")).otherwise(F.concat(F.lit(".../"), tail))


def relative_to(path: Column, root: Column) -> Column:
    """The path below the root, or the path itself where it is not below it."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


def cwe_ids(cwe: Column) -> Column:
    """The ids before the colon, in upper case, each once."""
    return F.array_distinct(F.filter(F.transform(cwe, lambda x: F.upper(F.trim(F.split_part(x, F.lit(":"), F.lit(1))))), lambda x: x != ""))


def vulnerability_label(cwe: Column) -> Column:
    """The quoted short name at the end of the first entry, else the entry, else Uncategorized."""
    first = F.try_element_at(cwe, F.lit(1))
    short = F.regexp_extract(first, r"\('([^']+)'\)\s*$", 1)
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(first, F.lit("")), F.lit("Uncategorized"))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def masked_key(key: Column) -> Column:
    """A secret for display: its ends only, or stars alone if it is short."""
    n = F.length(key)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(key, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(key, F.lit(4))))


def camelized(name: Column) -> Column:
    """blog_posts becomes BlogPosts."""
    return F.array_join(F.transform(F.split(name, "_"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))), "")


def language(text: Column, threshold: float = 0.15) -> Column:
    """zh where the share of Han among Han and Latin letters reaches the threshold, else en."""
    han = F.length(text) - F.length(F.regexp_replace(text, "[一-鿿]", ""))
    latin = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]", ""))
    return F.when((han > 0) & (han / (han + latin) >= threshold), "zh").otherwise("en")


def reply_json(reply: Column) -> Column:
    """A model's reply without the code fence and the word json around it."""
    inner = F.regexp_replace(F.trim(reply), r"^`+|`+$", "")
    return F.trim(F.regexp_replace(F.trim(inner), r"^json", ""))


def short_type(name: Column) -> Column:
    """A type's last name, without qualifiers, pointers and references."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\b(const|volatile|signed|unsigned)\b", " "), r"[*&]", " ")
    return F.element_at(F.split(F.trim(F.regexp_replace(bare, r"\s+", " ")), "::"), -1)


def backoff_seconds(attempt: Column, retry_after: Column) -> Column:
    """How long to wait before an attempt: 2, 4, 8 and so on up to 30 s, or what the server asks for within 0 to 30 s."""
    ladder = F.least(2 * F.pow(F.lit(2.0), attempt - 2), F.lit(30.0))
    asked = retry_after.try_cast("double")
    return F.when(asked.isNull(), ladder).otherwise(F.greatest(F.least(asked, F.lit(30.0)), F.lit(0.0)))


def file_name(name: Column) -> Column:
    """A name that is safe in a download header: other characters become one underscore each run."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\w.\-]+", "_"), r"^[._]+|[._]+$", "")


def is_identifier(literal: Column) -> Column:
    """Whether a string literal could be the name of a method: 3 to 64 characters of an identifier."""
    return literal.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]{2,63}$")


def console_row(cells: list[tuple[Column, int]]) -> Column:
    """A line of a table for a terminal: each cell as wide as its number says, to the left if that is negative."""
    padded = [F.rpad(c, -w, " ") if w < 0 else F.lpad(c, w, " ") for c, w in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *padded), F.lit(" |"))

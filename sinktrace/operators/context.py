"""Code around a place, numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, METHOD_LINES, HEAD_LINES = 15, 120, 12


def lines_of(files: DataFrame, *more: str) -> DataFrame:
    """Rows (path, line_no, text) of files (path, text), and columns ``more`` of them. A line ends at a line feed, a carriage return or both."""
    split = F.split(F.regexp_replace("text", r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    return files.select("path", *more, F.posexplode(split).alias("at", "text")).select("path", *more, (F.col("at") + 1).alias("line_no"), "text")


def numbered(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end of an array of lines, clamped to it, each with its number."""
    low, high = F.greatest(start, F.lit(1)), F.least(end, F.size(lines))
    some = F.transform(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), lambda x, i: F.concat(F.lpad((low + i).cast("string"), 5, " "), F.lit(" | "), x))
    return F.array_join(some, "\n")


def line_window(lines: Column, line: Column, window: int = WINDOW) -> Column:
    return numbered(lines, line - window, line + window)


def method_window(lines: Column, line: Column, start: Column, end: Column, window: int = WINDOW) -> Column:
    """The whole method if it is short, else its head and the lines around the place; a plain window without a method."""
    head = start + HEAD_LINES - 1
    low, high = F.greatest(line - window, head + 1), F.least(line + window, end)
    cut = F.concat(numbered(lines, start, head), F.lit("\n      | ... "), (low - head - 1).cast("string"), F.lit(" lines omitted ...\n"), numbered(lines, low, high))
    return F.when(start.isNull(), line_window(lines, line, window)).when(end - start + 1 <= METHOD_LINES, numbered(lines, start, end)).when(low > high, numbered(lines, start, head)).otherwise(cut)

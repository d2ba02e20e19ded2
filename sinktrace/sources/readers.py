"""Readers: archives, source trees, rule results, report corpora, mapper files and route tables, as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.operators.indexing import masked
from sinktrace.storage import numbered

MAX_BYTES, MAX_ENTRIES = 500 * 1024 * 1024, 20_000
# The language of a source file by its suffix.
SUFFIXES = {
    "java": "java", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "go": "go", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp",
    "hxx": "cpp", "h": "cpp", "rs": "rust", "cs": "csharp", "php": "php", "rb": "ruby", "kt": "kotlin", "scala": "scala", "xml": "xml",
}
LANGUAGES = ("java", "python", "javascript", "go", "cpp", "rust", "csharp", "php", "ruby", "kotlin", "scala", "xml")  # the order in which files are indexed
STATEMENTS = ("select", "insert", "update", "delete")
RESULTS = "results array<struct<check_id: string, path: string, start: struct<line: int, col: int, offset: bigint>, `end`: struct<line: int, col: int, offset: bigint>, extra: variant>>"


class UnsafeArchive(ValueError):
    """An archive that is too large or that would write outside of its folder."""


def checked_entries(content: bytes, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES) -> list[zipfile.ZipInfo]:
    """The entries of an archive, once all of them are known to be harmless."""
    infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
    if len(infos) > max_entries:
        raise UnsafeArchive(f"{len(infos)} entries; at most {max_entries} are read")
    if sum(i.file_size for i in infos) > max_bytes:
        raise UnsafeArchive(f"over {max_bytes} bytes when unpacked")
    for info in infos:
        depth = 0
        for part in info.filename.replace("\\", "/").split("/"):
            depth += -1 if part == ".." else part not in ("", ".")
            if depth < 0:
                raise UnsafeArchive(f"{info.filename} lies outside of the archive's folder")
    return infos


def archive_files(archives: DataFrame) -> DataFrame:
    """Rows (archive, path, content) of the files in archives (path, content as bytes); an unsafe archive fails the job."""
    import pandas as pd

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                infos = checked_entries(content)
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in infos:
                        if not info.is_dir():
                            yield pd.DataFrame({"archive": [archive], "path": [info.filename.lstrip("/")], "content": [z.read(info)]})

    return archives.select("path", "content").mapInPandas(unpack, "archive string, path string, content binary")


def without_common_root(files: DataFrame) -> DataFrame:
    """Paths without the one top folder that all files of an archive share, if there is one."""
    top = F.split_part(F.col("path"), F.lit("/"), F.lit(1))
    roots = files.groupBy("archive").agg(F.countDistinct(top).alias("n"), F.min(top).alias("root"), F.min(F.contains("path", F.lit("/"))).alias("nested"))
    strip = (F.col("n") == 1) & F.col("nested") & ~F.col("root").isin("", ".", "..")
    return files.join(roots, "archive").withColumn("path", F.when(strip, F.substring("path", F.length("root") + 2, 1 << 30)).otherwise(F.col("path"))).drop("n", "root", "nested")


def read_archives(spark: SparkSession, glob: str) -> DataFrame:
    return without_common_root(archive_files(spark.read.format("binaryFile").load(glob)))


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.element_at(F.split(path, r"\."), -1)))


# Suffixes that are C++ for sure, and words that only C++ has.
CPP_SUFFIXES = ("cpp", "cc", "cxx", "hpp", "hh", "hxx")
CPP_WORDS = (
    "namespace", "class", "template", "typename", "constexpr", "consteval", "constinit", "nullptr", "noexcept", "decltype", "static_cast", "dynamic_cast",
    "reinterpret_cast", "const_cast", "thread_local", "override", "final", "concept", "requires",
)
CPP_HEADERS = (
    "string", "vector", "array", "deque", "list", "map", "set", "unordered_map", "unordered_set", "memory", "optional", "variant", "tuple", "iostream", "fstream",
    "sstream", "algorithm", "iterator", "functional", "utility", "type_traits", "filesystem", "chrono", "thread",
)


def c_family(files: DataFrame) -> DataFrame:
    """Files (path, text) of C and C++ with their kind: cpp by suffix, or for a header by what its code says; else c."""
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    known = files.where(suffix.isin(*CPP_SUFFIXES, "h", "c")).withColumn("suffix", suffix)
    code = masked(known.select("path", F.lit("cpp").alias("lang"), "text")).select("path", F.col("text").alias("code"))
    says = F.col("code").rlike(rf"\b(?:{'|'.join(CPP_WORDS)})\b|\bstd\s*::|\b(?:public|private|protected)\s*:|#\s*include\s*<(?:{'|'.join(CPP_HEADERS)})>")
    kind = F.when(F.col("suffix").isin(*CPP_SUFFIXES) | ((F.col("suffix") == "h") & says), "cpp").otherwise("c")
    return known.join(code, "path").withColumn("kind", kind).drop("suffix", "code")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Source files below a folder: path, lang, text (bytes that are not UTF-8 are replaced), seq in order of language and path.

    Go's tests and TypeScript's declarations are left out, and so are headers that are not C++.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    kept = files.withColumn("lang", language_of(F.col("path"))).where(F.col("lang").isNotNull() & ~F.col("path").rlike(r"(_test\.go|\.d\.ts)$"))
    read = kept.select("path", "lang", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    headers = c_family(read.where(F.col("path").rlike(r"\.[hH]$"))).where("kind = 'cpp'").select("path", F.lit("cpp").alias("lang"), "text")
    order = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang"))
    return numbered(read.where(~F.col("path").rlike(r"\.[hH]$")).unionByName(headers), "seq", order, F.col("path"))


def read_ruleset(path: str) -> dict[str, list[str]]:
    """The lists of a ruleset file in YAML: configs, exclude_rules, out_of_scope_cwes (bare ids) and exclude_paths; small, read by the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    lists = {k: [str(x) for x in found.get(k) or []] for k in ("configs", "exclude_rules", "out_of_scope_cwes", "exclude_paths")}
    lists["out_of_scope_cwes"] = sorted({x.split(":")[0].strip().upper() for x in lists["out_of_scope_cwes"]})
    return lists


def read_candidates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Candidates of a JSON file, an array of objects; none if the file is missing or not JSON."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:  # there is no such file
        return spark.createDataFrame([], schema)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a JSON file: file, line, expected_reachable, note."""
    return spark.read.schema("file string, line int, expected_reachable string, note string").option("multiLine", True).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Raw rule results, numbered: seq, check_id, path, start, end, extra (a variant)."""
    rows = spark.read.schema(RESULTS).option("multiLine", True).json(path)
    return rows.select(F.posexplode("results").alias("seq", "r")).select("seq", "r.*")


def read_reports(spark: SparkSession, glob: str, finding: str) -> DataFrame:
    """Findings of a corpus of report files, tagged with the folder that each is in; unreadable files are skipped."""
    rows = spark.read.schema(f"findings array<{finding}>").option("multiLine", True).option("mode", "DROPMALFORMED").json(glob)
    tagged = rows.withColumn("report_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return tagged.select("report_id", F.explode("findings").alias("f")).select("report_id", "f.*")


def mapper_statements(files: DataFrame) -> DataFrame:
    """Statements of mapper files (path, text): path, namespace, id, start_line, end_line. Other and broken XML has none."""
    import pandas as pd

    def spans(text: str) -> list[tuple[str, str, int, int]]:
        parser, space, open_, found = expat.ParserCreate(), [], [], []
        parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
        tag = lambda name: name.rpartition(":")[2]

        def start(name: str, attributes: dict) -> None:
            if tag(name) == "mapper":
                space.append(attributes.get("namespace", ""))
            if tag(name) in STATEMENTS:
                open_.append((attributes.get("id"), parser.CurrentLineNumber))

        def end(name: str) -> None:
            if tag(name) in STATEMENTS and open_:
                found.append((*open_.pop(), parser.CurrentLineNumber))

        parser.StartElementHandler, parser.EndElementHandler = start, end
        try:
            parser.Parse(text, True)
        except expat.ExpatError:
            return []
        return [(space[0] if space else "", i, a, b) for i, a, b in found if i]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *s) for p, t in zip(pdf["path"], pdf["text"], strict=True) for s in spans(t)]
            yield pd.DataFrame(rows, columns=["path", "namespace", "id", "start_line", "end_line"])

    return files.select("path", "text").mapInPandas(read, "path string, namespace string, id string, start_line int, end_line int")


def route_entries(files: DataFrame) -> DataFrame:
    """Routes of route tables (path, text): verb, route, class_name, action; comments and includes are left out."""
    line = F.explode(F.split("text", r"\r\n|\r|\n"))
    rows = files.select("path", line.alias("line")).select("path", F.trim(F.split_part("line", F.lit("#"), F.lit(1))).alias("line"))
    pattern = r"^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(\S+)\s+([\w.]+)"
    part = lambda n: F.regexp_extract("line", pattern, n)
    routes = rows.select("path", part(1).alias("verb"), part(2).alias("route"), part(3).alias("target")).where("verb <> '' AND target LIKE '%.%'")
    names = F.split("target", r"\.")
    return routes.select("path", "verb", "route", F.element_at(names, -2).alias("class_name"), F.element_at(names, -1).alias("action"))

"""Verdicts by a model: what is asked, what is remembered, and what happens when the model gives out."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinktrace.functions.text import language as detected
from sinktrace.functions.text import reply_json
from sinktrace.storage import materialise, scratch

FINDING = "struct<reachable: string, sanitized: boolean, confidence: int, reasoning: string>"
STATIC_CONFIDENCE = {"HIGH": 95, "MEDIUM": 75, "LOW": 55}


def prompt_key(model: str, prompt: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}:"), prompt), 256)


def split_by_cache(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key the cache (key, reply) has, with the reply; and the keys and prompts that must be asked, each once."""
    hits = asked.join(cache, "key")
    misses = asked.join(cache, "key", "left_anti").groupBy("key").agg(F.min("prompt").alias("prompt"))
    return hits, misses


def is_rate_limited(status: Column, kind: Column, message: Column) -> Column:
    """Whether an error says that there were too many requests: by its status, the name of its kind, or 429 in its message."""
    named = F.lower(F.regexp_replace(F.coalesce(kind, F.lit("")), "[^A-Za-z]", "")).contains("ratelimit")
    return F.coalesce(status == 429, F.lit(False)) | named | F.coalesce(message, F.lit("")).rlike(r"(?<!\d)429(?!\d)")


class RateLimited(Exception):
    """Raised by a provider's call when there were too many requests; ``retry_after`` is what the server asks for, in seconds or as a date."""

    def __init__(self, retry_after: str | None = None):
        super().__init__("too many requests")
        self.retry_after = retry_after


def wait_seconds(attempt: int, retry_after: str | None) -> float:
    """How long to wait before an attempt, as ``text.backoff_seconds`` says of columns."""
    try:
        return min(max(float(retry_after), 0.0), 30.0)
    except (TypeError, ValueError):
        return min(2.0 * 2.0 ** (attempt - 2), 30.0)


def readable(reply: str) -> bool:
    """Whether a reply is a finding, with or without a code fence."""
    body = reply.strip().strip("`").strip().removeprefix("json").strip()
    try:
        return isinstance(json.loads(body), dict) and "reachable" in json.loads(body)
    except ValueError:
        return False


def asker(chat: Callable[[str], str], hint: str = "Answer with the JSON object alone.", attempts: int = 4, sleep: Callable[[float], None] = time.sleep, accepts: Callable[[str], bool] = readable) -> Callable[[str], str | None]:
    """A function for ``verified`` around a provider's call: it waits and asks again while the provider is busy, ``attempts`` times in all,
    and then gives None; and asks once more, with a hint, if it cannot read the reply."""

    def call(prompt: str) -> str | None:
        for attempt in range(2, attempts + 2):
            try:
                return chat(prompt)
            except RateLimited as e:
                if attempt <= attempts:
                    sleep(wait_seconds(attempt, e.retry_after))
        return None

    def ask(prompt: str) -> str | None:
        reply = call(prompt)
        return reply if reply is None or accepts(reply) else call(f"{prompt}\n\n{hint}")

    return ask


def parsed_reply(reply: Column) -> Column:
    """The finding in a reply, in a code fence or not, or an uncertain one that says that the verifier failed."""
    finding = F.from_json(reply_json(reply), FINDING)
    failed = F.struct(F.lit("uncertain").alias("reachable"), F.lit(None).cast("boolean").alias("sanitized"), F.lit(0).alias("confidence"), F.lit("verifier_failed: the reply could not be read").alias("reasoning"))
    return F.when(finding["reachable"].isNull(), failed).otherwise(finding)


def static_confidence(rule_confidence: Column) -> Column:
    out = F.lit(75)
    for level, value in STATIC_CONFIDENCE.items():
        out = F.when(F.upper(rule_confidence) == level, value).otherwise(out)
    return out


def replies(queue: DataFrame, ask: Callable[[str], str | None], blocks: int) -> tuple[DataFrame, bool]:
    """Replies (key, reply) to a queue (key, prompt, first_seq), asked in at most ``blocks`` blocks in order; and whether ``ask`` gave out.

    ``ask`` runs in the tasks. The task in which it first returns None asks no more and leaves a marker in the shared folder: the other tasks look for
    it before each prompt, and later blocks aren't begun. All replies are in one table, to which each block is added.
    """
    spark = queue.sparkSession
    cuts = sorted(set(queue.stat.approxQuantile("first_seq", [k / blocks for k in range(1, blocks)], 0.1 / blocks))) if blocks > 1 else []
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("first_seq") > c).cast("int")
    path, schema, halted = scratch(spark, "replies"), "key string, reply string", False
    gave_out = marker(scratch(spark, "halted"))

    def reply(batches: Iterator) -> Iterator:
        stopped = False
        for pdf in batches:
            out = []
            for prompt in pdf["prompt"]:
                stopped = stopped or gave_out.is_set()
                found = None if stopped else ask(prompt)
                if found is None and not stopped:
                    stopped = True
                    gave_out.set()
                out.append(found)
            pdf["reply"] = out
            yield pdf[["key", "reply"]]

    for block in range(len(cuts) + 1):
        queue.where(number == block).select("key", "prompt").mapInPandas(reply, schema).withColumn("block", F.lit(block)).write.mode("append").parquet(path)
        found = spark.read.schema(f"{schema}, block int").parquet(path)
        if not found.where((F.col("block") == block) & F.col("reply").isNull()).isEmpty():
            halted = True
            break
    return found.where("reply IS NOT NULL").select("key", "reply"), halted


class marker:  # noqa: N801
    """A mark that tasks set and see: a file in the shared folder, through its file system. A store that pyarrow does not know has none; then each task stops by itself."""

    def __init__(self, path: str):
        self.path = path

    def _at(self):
        from pyarrow import fs

        try:
            return fs.FileSystem.from_uri(self.path)
        except (OSError, ValueError):
            return None, ""

    def set(self) -> None:
        where, path = self._at()
        if where is not None:
            where.create_dir(path, recursive=True)

    def is_set(self) -> bool:
        from pyarrow import fs

        where, path = self._at()
        return where is not None and where.get_file_info(path).type != fs.FileType.NotFound


class ReplyCache:
    """Replies by key, kept as a table in a folder: new ones are appended, the last one of a key counts, and compaction leaves one row for each.

    A write is a folder of its own, numbered; readers see whole writes only, and a compaction takes the place of those before it.
    """

    SCHEMA = "key string, reply string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _parts(self) -> list[tuple[int, bool, str]]:
        """The whole writes: number, whether it is a compaction, path."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        store = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(where):
            return []
        found = []
        for status in store.listStatus(where):
            name = status.getPath().getName()
            if re.fullmatch(r"(part|all)-\d+", name) and store.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                kind, n = name.split("-")
                found.append((int(n), kind == "all", f"{self.path}/{name}"))
        return sorted(found)

    def read(self) -> DataFrame:
        """The reply of each key: key, reply."""
        parts = self._parts()
        begin = max((n for n, whole, _ in parts if whole), default=-1)
        frames = [self.spark.read.schema(self.SCHEMA).parquet(p).withColumn("__n", F.lit(n)) for n, _, p in parts if n >= begin]
        if not frames:
            return self.spark.createDataFrame([], self.SCHEMA)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.groupBy("key").agg(F.max_by("reply", "__n").alias("reply"))

    def put(self, found: DataFrame) -> None:
        """Add replies (key, reply); those of keys that are here take the place of the old ones."""
        n = max((n for n, _, _ in self._parts()), default=-1) + 1
        found.select("key", "reply").where("reply IS NOT NULL").write.parquet(f"{self.path}/part-{n}")

    def compact(self) -> None:
        """One row for each key, in one folder; what was before it is deleted once that is whole."""
        old = self._parts()
        if len(old) < 2:
            return
        self.read().write.parquet(f"{self.path}/all-{old[-1][0] + 1}")
        jvm = self.spark.sparkContext._jvm
        for _, _, path in old:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def verified_with_cache(candidates: DataFrame, ask: Callable[[str], str | None], model: str, cache: ReplyCache, blocks: int = 8) -> tuple[DataFrame, bool]:
    """``verified`` with the replies of a cache; what is asked is put into it, also if the model gives out on the way."""
    answered, halted, made = _verified(candidates, ask, model, cache.read(), blocks)
    if not made.isEmpty():
        cache.put(made)
    return answered, halted


def verified(candidates: DataFrame, ask: Callable[[str], str | None], model: str, cache: DataFrame, blocks: int = 8) -> tuple[DataFrame, bool]:
    """``_verified`` without the replies that were made."""
    return _verified(candidates, ask, model, cache, blocks)[:2]


def _verified(candidates: DataFrame, ask: Callable[[str], str | None], model: str, cache: DataFrame, blocks: int) -> tuple[DataFrame, bool, DataFrame]:
    """Candidates (seq, prompt, verification_mode, rule_confidence) with a finding, in order of seq; whether the model gave out; and the replies that were made.

    Static candidates are not asked about. The others are asked in blocks in order of seq, of which there are ``blocks`` however many candidates
    there are. Once the model gives out, the candidates of that block that have no reply, and all later blocks, have no finding.
    """
    static = candidates.where("verification_mode = 'static'").withColumn("finding", F.struct(F.lit("yes").alias("reachable"), F.lit(False).alias("sanitized"), static_confidence(F.col("rule_confidence")).alias("confidence"), F.lit("proved by a static check").alias("reasoning")))
    asked = candidates.where("verification_mode <> 'static'").withColumn("key", prompt_key(model, F.col("prompt")))
    hits, misses = split_by_cache(asked, cache)
    first = asked.groupBy("key").agg(F.min("seq").alias("first_seq"))
    queue = materialise(misses.join(first, "key"), "verify-queue")
    made, halted = replies(queue, ask, blocks) if not queue.isEmpty() else (queue.select("key", F.lit(None).cast("string").alias("reply")), False)
    known = hits.select("key", "reply").distinct().unionByName(made)
    answered = asked.join(known, "key", "left").withColumn("finding", F.when(F.col("reply").isNotNull(), parsed_reply(F.col("reply")))).drop("key", "reply")
    return static.unionByName(answered).orderBy("seq"), halted, made


PROSE = ("reasoning", "exploit_scenario", "remediation")


def is_language(text: Column, language: str) -> Column:
    """Whether a text may pass as one in the language: Chinese has a Han character, English is what the classifier says."""
    return text.rlike("[\u4e00-\u9fff]") if language == "zh" else detected(text) == language


def valid_translation(reply: Column, fields: Iterable[str], language: str) -> Column:
    """Whether a translator's reply is a JSON object that has every field as a text in the language."""
    parsed = F.from_json(reply_json(reply), "map<string, string>")
    out = parsed.isNotNull()
    for f in fields:
        value = F.try_element_at(parsed, F.lit(f))
        out = out & value.isNotNull() & (F.trim(value) != "") & is_language(value, language)
    return F.coalesce(out, F.lit(False))


def translations(findings: DataFrame, ask: Callable[[str], str | None], model: str, language: str, cache: DataFrame, blocks: int = 8) -> tuple[DataFrame, bool]:
    """Findings (seq, reasoning, exploit_scenario, remediation) with each prose field translated, as ``name_language``; and whether the model gave out.

    Findings that have no prose, or are in the language already, are not asked about. Replies are judged when they are used, those of the cache too;
    where one is not valid the text stays as it is.
    """
    prose = F.concat_ws("\n", *PROSE)
    asks = needs_translation([F.col(c) for c in PROSE]) & (detected(prose) != language)
    prompt = F.concat(F.lit(f"Translate the values into {language}. Answer in JSON.\n"), F.to_json(F.struct(*PROSE)))
    keyed = findings.withColumn("key", F.when(asks, prompt_key(model, prompt))).withColumn("prompt", prompt)
    hits, misses = split_by_cache(keyed.where("key IS NOT NULL"), cache)
    first = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("seq").alias("first_seq"))
    queue = materialise(misses.join(first, "key"), "translate-queue")
    made, halted = replies(queue, ask, blocks) if not queue.isEmpty() else (queue.select("key", F.lit(None).cast("string").alias("reply")), False)
    met = keyed.join(hits.select("key", "reply").distinct().unionByName(made), "key", "left")
    given = F.from_json(reply_json(F.col("reply")), "map<string, string>")
    filled = F.array_compact(F.array(*(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.lit(c)) for c in PROSE)))
    right = F.col("reply").isNotNull() & given.isNotNull()
    for c in PROSE:
        right = right & (~F.array_contains(filled, c) | F.coalesce(is_language(F.try_element_at(given, F.lit(c)), language), F.lit(False)))
    met = met.withColumn("__right", right).withColumn("__given", given)
    for c in PROSE:
        met = met.withColumn(f"{c}_{language}", translated(F.col(c), F.when(F.col("__right"), F.try_element_at(F.col("__given"), F.lit(c)))))
    return met.drop("key", "prompt", "reply", "__right", "__given").orderBy("seq"), halted


def translated(source: Column, offered: Column) -> Column:
    """The translation if it is not blank, else the text itself."""
    return F.when(F.trim(F.coalesce(offered, F.lit(""))) != "", offered).otherwise(source)


def needs_translation(fields: Iterable[Column]) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | (F.trim(F.coalesce(f, F.lit(""))) != "")
    return out

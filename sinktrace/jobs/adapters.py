"""The standard tables seen as findings, call graphs, labels and logs; for each a frame and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The weakness entries of findings, by a number from the event's properties.
CWE_LISTS = {
    0: ["CWE-89: Improper neutralization ('SQL Injection')"], 1: ["cwe-22: Path problem ('Path Traversal')"], 2: ["CWE-327: Weak algorithm"],
    3: ["CWE-79: Output problem ('XSS')", "CWE-116: Encoding"], 4: ["CWE-777"], 5: [], 6: ["CWE-327", "CWE-89: again"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of events."""
    n = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    cwe = F.array().cast("array<string>")
    for k, entries in CWE_LISTS.items():
        cwe = F.when(F.col("cwe_k") == k, F.array(*map(F.lit, entries)).cast("array<string>")).otherwise(cwe)
    rule = lambda x: F.concat(F.lit("rule-"), x.cast("string"))
    base = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", n.alias("n"))
    return base.withColumn("cwe_k", F.col("n") % 7).select(
        F.col("event_id").alias("seq"), rule(F.col("n") % 25).alias("rule_id"), "cwe_k", cwe.alias("cwe"),
        F.when(F.col("event_id") % 3 == 0, F.array(rule(F.col("n") % 25), rule((F.col("n") + 7) % 25))).otherwise(F.array(rule(F.col("n") % 25))).alias("rule_ids"),
        F.concat(F.lit("src/m"), (F.col("user_id") % 7).cast("string"), F.lit("/F"), F.col("user_id").cast("string"), F.lit(".java")).alias("sink_file"),
        (1 + F.col("event_id") % 11).cast("int").alias("sink_line"),
        F.concat(F.lit("src/m"), (F.col("user_id") % 7).cast("string"), F.lit("/S"), (F.col("user_id") % 5).cast("string"), F.lit(".java")).alias("source_file"), (1 + F.col("n") % 3).cast("int").alias("source_line"),
        F.when(F.col("event_type") == "view", "yes").when(F.col("event_type") == "click", "no").when(F.col("event_type") == "signup", "uncertain").when(F.col("event_type") == "purchase", "failed").otherwise("unverified").alias("verdict"),
        F.when(F.col("event_id") % 4 == 0, "ERROR").when(F.col("event_id") % 4 == 1, "WARNING").when(F.col("event_id") % 4 == 2, "INFO").otherwise("NOTE").alias("severity"),
        F.when(F.col("event_id") % 5 == 0, "static").otherwise("dataflow").alias("verification_mode"), F.concat(F.lit("message "), (F.col("n") % 9).cast("string")).alias("message"),
        F.col("ts").cast("date").cast("string").alias("report_id"),
    )


def _sql_list(entries: list[str]) -> str:
    return "[" + ", ".join("'" + e.replace("'", "''") + "'" for e in entries) + "]::VARCHAR[]"


FINDINGS_SQL = f"""findings AS (
  SELECT event_id AS seq, 'rule-' || (n % 25) AS rule_id, n % 7 AS cwe_k,
         CASE n % 7 {' '.join(f'WHEN {k} THEN {_sql_list(v)}' for k, v in CWE_LISTS.items())} END AS cwe,
         CASE WHEN event_id % 3 = 0 THEN ['rule-' || (n % 25), 'rule-' || ((n + 7) % 25)] ELSE ['rule-' || (n % 25)] END AS rule_ids,
         'src/m' || (user_id % 7) || '/F' || user_id || '.java' AS sink_file, CAST(1 + event_id % 11 AS INT) AS sink_line,
         'src/m' || (user_id % 7) || '/S' || (user_id % 5) || '.java' AS source_file, CAST(1 + n % 3 AS INT) AS source_line,
         CASE event_type WHEN 'view' THEN 'yes' WHEN 'click' THEN 'no' WHEN 'signup' THEN 'uncertain' WHEN 'purchase' THEN 'failed' ELSE 'unverified' END AS verdict,
         CASE event_id % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'INFO' ELSE 'NOTE' END AS severity,
         CASE WHEN event_id % 5 = 0 THEN 'static' ELSE 'dataflow' END AS verification_mode, 'message ' || (n % 9) AS message,
         CAST(CAST(ts AS DATE) AS VARCHAR) AS report_id
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS n FROM events))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse part of the call graph of parts: returned lines alone, one in ten of all pairs, so that there are methods that nothing calls. caller, callee, seq."""
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("callee"))
    pairs = items.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("caller"), "callee")
    return pairs.distinct().withColumn("seq", F.col("caller") * 1000003 + F.col("callee"))


EDGES_SQL = """edges AS (
  SELECT DISTINCT x.l_partkey AS caller, y.l_partkey AS callee FROM lineitem x JOIN lineitem y
    ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
  WHERE x.l_returnflag = 'R' AND y.l_returnflag = 'R')"""


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole call graph of parts: one calls another if a line of the first comes right before one of the other. caller, callee, seq."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("callee"))
    pairs = items.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("caller"), "callee")
    return pairs.distinct().withColumn("seq", F.col("caller") * 1000003 + F.col("callee"))


def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sinks of that graph: standard parts of the two largest sizes. sink, node."""
    found = table(spark, sf_dir, "part").where("p_type = 'STANDARD' AND p_size > 48")
    return found.select(F.col("p_partkey").alias("sink"), F.col("p_partkey").alias("node"))


ALL_EDGES_SQL = """edges AS (
  SELECT DISTINCT x.l_partkey AS caller, y.l_partkey AS callee FROM lineitem x JOIN lineitem y
    ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1),
starts AS (SELECT p_partkey AS node FROM part WHERE p_type = 'STANDARD' AND p_size > 48)"""


def entry_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry points of that graph: parts on promotion."""
    return table(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("node"))


ENTRIES_SQL = "entries AS (SELECT p_partkey AS node FROM part WHERE p_type = 'PROMO')"


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods made of parts."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("method_id"), k.alias("seq"), (k % 50).alias("file"), F.concat(F.lit("m"), (k % 40).cast("string")).alias("name"), F.when(k % 6 == 0, -1).otherwise(k % 4).cast("int").alias("arity"),
        F.col("p_size").alias("start_line"), (F.col("p_size") + k % 13).cast("int").alias("end_line"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("O"), (k % 9).cast("string"))).alias("owner"),
    )


METHODS_SQL = """methods AS (
  SELECT p_partkey AS method_id, p_partkey AS seq, p_partkey % 50 AS file, 'm' || (p_partkey % 40) AS name,
         CAST(CASE WHEN p_partkey % 6 = 0 THEN -1 ELSE p_partkey % 4 END AS INT) AS arity, p_size AS start_line,
         CAST(p_size + p_partkey % 13 AS INT) AS end_line, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'O' || (p_partkey % 9) END AS owner
  FROM part)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites made of orders."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("call_id"), F.concat(F.lit("m"), (k % 45).cast("string")).alias("callee"), (k % 4).cast("int").alias("arity"), F.when(k % 10 != 0, F.col("o_custkey")).alias("caller_id"),
        (k % 3 == 0).alias("receiver_is_self"), F.when(F.col("o_custkey") % 11 == 0, "").otherwise(F.concat(F.lit("O"), (F.col("o_custkey") % 9).cast("string"))).alias("caller_owner"),
    )


CALLS_SQL = """calls AS (
  SELECT o_orderkey AS call_id, 'm' || (o_orderkey % 45) AS callee, CAST(o_orderkey % 4 AS INT) AS arity, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS caller_id,
         o_orderkey % 3 = 0 AS receiver_is_self, CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'O' || (o_custkey % 9) END AS caller_owner
  FROM orders)"""

"""Methods that a request or a message reaches first, by marks on them and by the types that they are of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The marks of frameworks by language. The fourth column tells proof from a hint; the last one whether a mark stands above the
# declaration (or on its line), or inside the method.
MARKS = (
    ("java", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b|@Path\b", "request mapping", True, "above"),
    ("java", r"@(Kafka|Rabbit|Jms|Stream|Sqs)Listener\b|@(RocketMQMessageListener|RabbitHandler|MessageMapping|SubscribeMapping|ExceptionHandler)\b", "message", True, "above"),
    ("java", r"@(RequestParam|PathVariable|RequestBody|RequestHeader|CookieValue|ModelAttribute|RequestPart)\b", "request parameter", True, "above"),
    ("java", r"\b(HttpServletRequest|MultipartFile|HttpEntity)\b", "request type", False, "above"),
    ("kotlin", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b", "request mapping", True, "above"),
    ("csharp", r"\[(Http(Get|Post|Put|Delete|Patch|Head|Options)|Route)\b", "request mapping", True, "above"),
    ("csharp", r"\bHttp(Context|Request|Response)\b", "request type", False, "above"),
    ("python", r"@\w+(\.\w+)*\.(route|get|post|put|delete|patch|head|options)\s*\(", "route", True, "above"),
    ("javascript", r"^\s*@(Get|Post|Put|Delete|Patch|Head|Options|All)\s*\(", "route", True, "above"),
    ("javascript", r"\(\s*(req|request)\s*(:[^,)]*)?,\s*(res|response)\b", "handler type", False, "above"),
    ("php", r"#\[Route\b", "route", True, "above"),
    ("php", r"\$_(GET|POST|REQUEST)\b", "request data", False, "inside"),
    ("ruby", r"\bparams\s*\[", "request data", False, "inside"),
    ("rust", r"#\[(get|post|put|delete|patch|head|options|route)\s*\(", "route", True, "above"),
    ("go", r"\bhttp\.ResponseWriter\b.*\*http\.Request\b|\*gin\.Context\b|\becho\.Context\b|\*fiber\.Ctx\b", "handler type", False, "above"),
    ("cpp", r"\b(const\s+)?(crow::request|httplib::Request|HttpRequestPtr|Http::Request|oatpp::web::protocol::http::incoming::Request)\b", "handler type", False, "above"),
)
# Types whose methods of these names a server calls.
SERVED_TYPES = {
    "java": (("HttpServlet", "GenericServlet", "Servlet", "Filter", "HttpFilter", "OncePerRequestFilter", "HandlerInterceptor", "HandlerInterceptorAdapter"), ("doGet", "doPost", "doPut", "doDelete", "doHead", "doOptions", "doTrace", "service", "doFilter", "preHandle", "postHandle")),
    "ruby": (("ApplicationController", "Base", "API"), ("index", "show", "new", "create", "edit", "update", "destroy")),
}
# Calls that register a handler for a route, the handler's name being their last argument.
REGISTRATIONS = {"javascript": r"\.(?:get|post|put|delete|patch|all|use)\s*\(\s*[\"'`][^\"'`]*[\"'`]\s*,.*?([A-Za-z_$][\w$]*)\s*\)", "go": r"\b(?:HandleFunc|Handle|GET|POST|PUT|DELETE|PATCH)\s*\(\s*\"[^\"]*\"\s*,.*?([A-Za-z_]\w*)\s*\)", "cpp": r"\.(?:Get|Post|Put|Delete|Patch)\s*\(\s*\"[^\"]*\"\s*,\s*&?(?:\w+::)*([A-Za-z_]\w*)\s*\)"}


def mark_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MARKS), "lang string, pattern string, reason string, definitive boolean, place string")


def marked_lines(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Lines that a mark of their language matches: path, line_no, reason, definitive, place. Each pattern is a literal of the plan."""
    rows = marks.collect()  # a few dozen
    hit = lambda r: F.when((F.col("lang") == r.lang) & F.col("text").rlike(r.pattern), F.struct(F.lit(r.reason).alias("reason"), F.lit(r.definitive).alias("definitive"), F.lit(r.place).alias("place")))
    return lines.select("path", "line_no", F.explode(F.array_compact(F.array(*map(hit, rows)))).alias("m")).select("path", "line_no", "m.*")


def entry_points(methods: DataFrame, lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Marked methods (path, name, start_line) with a reason; proof goes before a hint, then the nearer mark.

    A mark above belongs to the next declaration, however many marks, comments and blank lines stand between; a line that ends a statement or a
    block ends its reach. A mark inside belongs to the innermost method around it. methods: path, name, start_line, end_line.
    """
    hits = marked_lines(lines, marks)
    named = methods.select("path", "name", "start_line", "end_line")
    order = lambda kind: F.lit(kind).alias("kind")
    stops = lines.where(F.col("text").rlike(r"[;}]\s*$")).select("path", "line_no", order(2), F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("start_line")).alias("m"))
    starts = named.select("path", F.col("start_line").alias("line_no"), order(1), F.struct("name", "start_line").alias("m"))
    asks = hits.where("place = 'above'").select("path", "line_no", order(0), "reason", "definitive")
    after = Window.partitionBy("path").orderBy("line_no", "kind").rowsBetween(0, Window.unboundedFollowing)
    events = asks.unionByName(starts, allowMissingColumns=True).unionByName(stops, allowMissingColumns=True)
    above = events.withColumn("next", F.first("m", True).over(after)).where("kind = 0 AND next.name IS NOT NULL").select("path", "next.name", "next.start_line", "reason", "definitive", (F.col("next.start_line") - F.col("line_no")).alias("d"))
    around = hits.where("place = 'inside'").join(named, "path").where("line_no BETWEEN start_line AND end_line")
    inner = around.groupBy("path", "line_no", "reason", "definitive").agg(F.min_by(F.struct("name", "start_line"), F.col("end_line") - F.col("start_line")).alias("m"))
    met = above.unionByName(inner.select("path", "m.name", "m.start_line", "reason", "definitive", (F.col("line_no") - F.col("m.start_line")).alias("d")))
    best = met.groupBy("path", "name", "start_line").agg(F.min_by(F.struct("reason", "definitive"), F.struct((~F.col("definitive")).alias("hint"), "d", "reason")).alias("e"))
    return best.select("path", "name", "start_line", "e.reason", "e.definitive")


def served(methods: DataFrame) -> DataFrame:
    """Methods (path, lang, name, start_line, owner_supertypes) that a server calls because of their owner's supertypes."""
    right = F.lit(False)
    for lang, (types, names) in SERVED_TYPES.items():
        right = right | ((F.col("lang") == lang) & F.col("name").isin(*names) & F.arrays_overlap("owner_supertypes", F.array(*map(F.lit, types))))
    return methods.where(right).select("path", "name", "start_line", F.lit("served type").alias("reason"), F.lit(True).alias("definitive"))


def registered(lines: DataFrame) -> DataFrame:
    """Handlers that route registrations name (path, seq, name, reason), for ``graph.late_references``."""
    name = F.lit("")
    for lang, pattern in REGISTRATIONS.items():
        name = F.when(F.col("lang") == lang, F.regexp_extract("text", pattern, 1)).otherwise(name)
    return lines.select("path", F.col("line_no").alias("seq"), name.alias("name"), F.lit("route").alias("reason")).where("name <> ''")

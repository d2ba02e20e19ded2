"""Run logs, progress, heartbeats and job states, over event tables and streams alike."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinktrace.operators.intervals import first_over
from sinktrace.storage import materialise, numbered, partitions

RUNNING = ("queued", "ingesting", "scanning", "indexing", "verifying", "translating", "reporting", "paused")


def log_since(log: DataFrame, after: int, scan: Column | None = None) -> DataFrame:
    """Entries newer than a cursor, of one scan if asked for, with the log's highest seq."""
    latest = log.agg(F.max("seq")).first()[0]  # one number
    rows = log.where(F.col("seq") > after)
    return (rows if scan is None else rows.where(scan)).withColumn("latest", F.lit(latest).cast("long"))


def ring(log: DataFrame, size: int = 2000) -> DataFrame:
    """The last ``size`` entries by seq."""
    return log.orderBy(F.desc("seq")).limit(size)


def latest_progress(events: DataFrame) -> DataFrame:
    """The state of each scan: its last stage, with done and total since that stage began."""
    last = events.groupBy("scan_id").agg(F.max_by(F.struct("stage", "done", "total"), "seq").alias("x"), F.max("seq").alias("seq"))
    shown = F.col("x.total") > 0
    return last.select("scan_id", "seq", "x.stage", F.when(shown, F.col("x.done")).alias("stage_done"), F.when(shown, F.col("x.total")).alias("stage_total"))


def heartbeat_sessions(beats: DataFrame, beat_seconds: int = 20, closing_seconds: int = 8) -> DataFrame:
    """Sessions of each client from rows (client, seq, ts, closing): client, opened, deadline, beats.

    A beat holds for 20 s from its time on. A closing page that comes before that pulls the deadline to 8 s from its own time, if that is
    earlier; the next beat sets it anew. A page that closes before the first beat, or after the deadline, does nothing. A beat after the
    deadline opens a new session.
    """
    every = Window.partitionBy("client").orderBy("ts", "seq")
    rows = beats.withColumn("g", F.sum(F.when(F.col("closing"), 0).otherwise(1)).over(every.rowsBetween(Window.unboundedPreceding, 0))).where("g > 0")
    seconds = lambda n: F.expr(f"INTERVAL {n} SECOND")
    beat = rows.groupBy("client", "g").agg(F.min(F.when(~F.col("closing"), F.col("ts"))).alias("ts"), F.min(F.when(F.col("closing"), F.col("ts"))).alias("closed"))
    full = F.col("ts") + seconds(beat_seconds)
    held = beat.withColumn("until", F.when(F.col("closed") <= full, F.least(full, F.col("closed") + seconds(closing_seconds))).otherwise(full))
    by_beat = Window.partitionBy("client").orderBy("g")
    opens = F.when(F.col("ts") > F.lag("until").over(by_beat), 1).otherwise(0)
    grouped = held.withColumn("opens", opens).withColumn("session", F.sum("opens").over(by_beat.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("client", "session").agg(F.min("ts").alias("opened"), F.max_by("until", "g").alias("deadline"), F.count(F.lit(1)).alias("beats")).drop("session")


def changes(spans: DataFrame, upto: Column) -> DataFrame:
    """Where the active scan changes (ts, scan_id, null for none), from spans (scan_id, began, ended; null: still active); of spans that overlap the one that began last counts.

    A span that is still active is followed to ``upto``. Points and ends are numbered in order of time, and a point finds the span over its number
    by blocks (``intervals``): points and spans are never compared pair by pair.
    """
    held = spans.withColumn("until", F.coalesce("ended", upto)).where("began < until").groupBy("began", "until").agg(F.max("scan_id").alias("scan_id"), F.max(F.col("ended").isNotNull()).alias("ends"))
    held = materialise(held, "changes-spans")
    ends = held.select(F.col("began").alias("ts"), F.lit(True).alias("told")).unionByName(held.select(F.col("until").alias("ts"), F.col("ends").alias("told")))
    points = materialise(numbered(ends.groupBy("ts").agg(F.max("told").alias("told")), "at", F.col("ts")), "changes-points")
    number = lambda c, name: points.select(F.col("ts").alias(c), F.col("at").alias(name))
    placed = held.join(number("began", "low"), "began").join(number("until", "next"), "until")
    over = placed.select("low", (F.col("next") - 1).alias("high"), F.struct("began", "scan_id").alias("rank"), F.col("scan_id").alias("value"))
    active = first_over(points.select("at"), over, [], largest=True).select("at", F.col("value").alias("scan_id"))
    return points.where("told").join(active, "at", "left").select("ts", "scan_id")


def carried(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """Rows with the last value that is not null of the column ``value``, a struct, up to each by ``order``.

    The rows are sorted by ranges. Each range finds the last value within itself, and takes what is before its first one from the ranges before it, of
    which there are as many as shuffle partitions; so no window has all rows, and none is joined.
    """
    n = partitions(rows.sparkSession)
    sorted_ = materialise(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "carried")
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = sorted_.where(F.col(value).isNotNull()).groupBy("__range").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    every = sorted_.select("__range").distinct().join(ends, "__range", "left")
    before = every.select("__range", F.last("__last", True).over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    met = sorted_.join(F.broadcast(before), "__range")
    return met.withColumn(value, F.coalesce(F.last(value, True).over(within), F.col("__before"))).drop("__range", "__before")


def tagged(log: DataFrame, spans: DataFrame) -> DataFrame:
    """Log lines (seq, ts, line, server) with the scan that was active then; lines of the server itself have none.

    spans: scan_id, began, ended (null: still active). One scan is active at a time; of spans that overlap the one that began last counts.
    Spans become changes of the active scan, and a line takes the last change before it: lines and changes are sorted together by ranges.
    """
    points = changes(spans, F.lit("9999-12-31").cast("timestamp_ntz")) if spans.where("ended IS NULL").isEmpty() else changes(spans, F.lit(log.agg(F.max("ts")).first()[0]) + F.expr("INTERVAL 1 SECOND"))
    lines = log.select("*", F.lit(1).alias("__kind"))
    found = points.select(F.col("ts"), F.struct("scan_id").alias("__change"), F.lit(0).alias("__kind"))
    both = carried(lines.unionByName(found, allowMissingColumns=True), "__change", "ts", "__kind", "seq")
    return both.where("__kind = 1").withColumn("scan_id", F.when(~F.col("server"), F.col("__change.scan_id"))).drop("__kind", "__change")


def without_repeats(records: DataFrame, own_path: str) -> DataFrame:
    """Records (record_id, seq, line) each once, the first one; access lines of the log's own endpoint are left out."""
    kept = records.where(~F.col("line").contains(own_path))
    first = kept.groupBy("record_id").agg(F.min_by(F.struct("seq", "line"), "seq").alias("x"))
    return first.select("record_id", "x.*")


def stopped_at(checkpoints: DataFrame, controls: DataFrame) -> DataFrame:
    """What each scan does at its checkpoints (scan_id, seq): go on, wait or end, by the controls before it (scan_id, seq, action).

    Actions are pause, resume and cancel. A scan that is cancelled stays so. Controls and checkpoints are ordered by seq in one log.
    """
    log = checkpoints.select("scan_id", "seq", F.lit(None).cast("string").alias("action")).unionByName(controls.select("scan_id", "seq", "action"))
    before = Window.partitionBy("scan_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max(F.when(F.col("action") == "cancel", 1).otherwise(0)).over(before) == 1
    paused = F.last(F.when(F.col("action").isin("pause", "resume"), F.col("action")), True).over(before) == "pause"
    told = log.withColumn("does", F.when(ended, "end").when(F.coalesce(paused, F.lit(False)), "wait").otherwise("go on"))
    return told.where("action IS NULL").select("scan_id", "seq", "does")


def elapsed_seconds(began: Column, now: Column) -> Column:
    """Seconds since a stage began; a clock that went back gives 0."""
    return F.greatest(F.timestamp_diff("SECOND", began, now), F.lit(0))


def job_states(events: DataFrame) -> DataFrame:
    """The state of each scan from its events (scan_id, seq, status): finished ones stay so; resuming restores what was before the pause."""
    before = Window.partitionBy("scan_id").orderBy("seq")
    ended = F.max(F.when(F.col("status").isin("done", "failed", "cancelled"), 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, -1))
    live = events.withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0")
    stage = F.last(F.when(~F.col("status").isin("paused", "resumed"), F.col("status")), True).over(before)
    states = live.withColumn("state", F.when(F.col("status") == "paused", "paused").otherwise(F.coalesce(stage, F.lit("queued"))))
    return states.groupBy("scan_id").agg(F.max_by("state", "seq").alias("state"), F.count(F.lit(1)).alias("events"))


def reconciled(scans: DataFrame) -> DataFrame:
    """After a restart nothing runs: each running scan has failed."""
    lost = F.col("status").isin(*RUNNING)
    return scans.withColumn("error", F.when(lost, "the service restarted while the scan was running")).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def assembled_lines(writes: DataFrame) -> DataFrame:
    """Whole lines of each scan's log from partial writes (scan_id, seq, chunk), numbered; what follows the last line feed is pending.

    Each write knows how many line feeds came before it, so a line is a group of pieces, and no log is gathered whole.
    """
    order = Window.partitionBy("scan_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = writes.withColumn("before", F.coalesce(F.sum(F.length("chunk") - F.length(F.replace("chunk", F.lit("\n"), F.lit("")))).over(order), F.lit(0)))
    pieces = counted.select("scan_id", "seq", "before", F.posexplode(F.split("chunk", "\n")).alias("k", "piece"), F.size(F.split("chunk", "\n")).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "k", "piece")))
    lines = pieces.groupBy("scan_id", (F.col("before") + F.col("k")).alias("line_no")).agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("text"), F.max(F.col("k") < F.col("n") - 1).alias("complete"))
    return lines.where("complete").select("scan_id", "line_no", "text")


def stream_lines(writes: DataFrame) -> DataFrame:
    """The same on a stream of (scan_id, seq, chunk): what is pending of each scan is its state."""
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending, number = state.get if state.exists else ("", 0)
        out = []
        for chunk in pd.concat(list(batches)).sort_values("seq")["chunk"]:
            *whole, pending = (pending + chunk).split("\n")
            out += whole
        yield pd.DataFrame({"scan_id": key[0], "line_no": range(number, number + len(out)), "text": out})
        state.update((pending, number + len(out)))

    return writes.groupBy("scan_id").applyInPandasWithState(step, "scan_id long, line_no long, text string", "pending string, number long", "append", "NoTimeout")


def stream_sessions(beats: DataFrame, beat_seconds: int = 20, closing_seconds: int = 8) -> DataFrame:
    """``heartbeat_sessions`` on a stream (client, seq, ts, closing) with a watermark on ts: a session is told when the watermark passes its deadline.

    The state of a client is its open session and the beats that the watermark has not passed; a timer on event time stands at the deadline.
    """
    import pandas as pd

    second = 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, deadline, full, count, waiting = state.get if state.exists else (0, 0, 0, 0, [])
        mark = state.getCurrentWatermarkMs() * 1000
        waiting = [tuple(w) for w in waiting]
        if not state.hasTimedOut:
            for pdf in batches:
                waiting += [(int(t.value) // 1000, int(q), bool(c)) for t, q, c in zip(pdf["ts"], pdf["seq"], pdf["closing"], strict=True)]
        done = []
        ready = sorted(w for w in waiting if w[0] <= mark)
        waiting = sorted(w for w in waiting if w[0] > mark)
        for ts, _, closing in ready:
            if count and ts > deadline:
                done.append((opened, deadline, count))
                count = 0
            if closing:  # it pulls the deadline nearer, until the next beat
                deadline = min(deadline, ts + closing_seconds * second) if count and ts <= full else deadline
            else:
                opened, count = (opened, count + 1) if count else (ts, 1)
                deadline = full = ts + beat_seconds * second
        if count and mark > deadline:
            done.append((opened, deadline, count))
            count = 0
        if count or waiting:
            state.update((opened, deadline, full, count, [list(map(int, w)) for w in waiting]))
            state.setTimeoutTimestamp(max(mark // 1000 + 1, (deadline if count else waiting[0][0]) // 1000 + 1))
        elif state.exists:
            state.remove()
        time = lambda k: pd.to_datetime([d[k] for d in done], unit="us")
        yield pd.DataFrame({"client": [key[0]] * len(done), "opened": time(0), "deadline": time(1), "beats": [d[2] for d in done]})

    kind = beats.schema["client"].dataType.simpleString()
    return beats.groupBy("client").applyInPandasWithState(step, f"client {kind}, opened timestamp, deadline timestamp, beats long", "opened long, deadline long, full long, count long, waiting array<array<long>>", "append", "EventTimeTimeout")


def stream_states(events: DataFrame) -> DataFrame:
    """``job_states`` on a stream (scan_id, seq, status) in order of seq for each scan: a row (scan_id, seq, state) whenever a state changes."""
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stage, shown, ended = state.get if state.exists else ("queued", "", False)
        out = []
        for seq, status in pd.concat(list(batches)).sort_values("seq")[["seq", "status"]].itertuples(index=False):
            if ended:
                break
            if status not in ("paused", "resumed"):
                stage = status
            now = "paused" if status == "paused" else stage
            ended = status in ("done", "failed", "cancelled")
            if now != shown:
                shown = now
                out.append((key[0], seq, now))
        state.update((stage, shown, ended))
        yield pd.DataFrame(out, columns=["scan_id", "seq", "state"])

    kind = events.schema["scan_id"].dataType.simpleString()
    return events.groupBy("scan_id").applyInPandasWithState(step, f"scan_id {kind}, seq long, state string", "stage string, shown string, ended boolean", "append", "NoTimeout")


def stream_stops(log: DataFrame) -> DataFrame:
    """``stopped_at`` on a stream (scan_id, seq, action; null for a checkpoint) in order of seq for each scan: what each checkpoint does."""
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        paused, ended = state.get if state.exists else (False, False)
        out = []
        for seq, action in pd.concat(list(batches)).sort_values("seq")[["seq", "action"]].itertuples(index=False):
            if action is None or pd.isna(action):
                out.append((key[0], seq, "end" if ended else "wait" if paused else "go on"))
            else:
                ended = ended or action == "cancel"
                paused = action == "pause" if action in ("pause", "resume") else paused
        state.update((paused, ended))
        yield pd.DataFrame(out, columns=["scan_id", "seq", "does"])

    kind = log.schema["scan_id"].dataType.simpleString()
    return log.groupBy("scan_id").applyInPandasWithState(step, f"scan_id {kind}, seq long, does string", "paused boolean, ended boolean", "append", "NoTimeout")

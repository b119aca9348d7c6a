"""Ordered folds over events: statistics, marks, streaks, recency, sessions. Each batch fold has its streaming form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.sources.shared import shared_dir
from wordloom.sources.tables import table

#: Newest entries of a user's recency list; of the ring buffer; minutes after which a session ends.
RECENT, RING, GAP = 5, 500, 60


def session_stats(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the greatest and the last value, successes, retries, and whether anything was completed."""
    kind = F.col("event_type")
    return events.groupBy(*keys).agg(
        F.max("value").alias("max_value"),
        F.count_if(kind == "purchase").alias("successes"),
        F.count_if(kind == "error").alias("retries"),
        F.max_by("value", F.struct("ts", "event_id")).alias("last_value"),
        F.bool_or(kind == "purchase").alias("completed"),
    )


def rung_marks(events: DataFrame) -> DataFrame:
    """Each success or hint with its mark: after a hint revealed, without misses first, else retry. Misses count since the last of either."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ends = F.col("event_type").isin("purchase", "signup").cast("int")
    segment = F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = events.withColumn("segment", segment)
    misses = F.count_if(F.col("event_type") == "error").over(Window.partitionBy("user_id", "segment"))
    mark = F.when(F.col("event_type") == "signup", "revealed").when(F.col("misses") == 0, "first").otherwise("retry")
    return parts.withColumn("misses", misses).where(ends == 1).select("event_id", "user_id", mark.alias("mark"))


def streaks(days: DataFrame) -> DataFrame:
    """user_id, start (day), days: stretches of consecutive days. days has user_id and date, once each."""
    w = Window.partitionBy("user_id").orderBy("date")
    island = F.unix_date("date") - F.row_number().over(w)
    return days.withColumn("island", island).groupBy("user_id", "island").agg(F.min("date").alias("start"), F.count(F.lit(1)).alias("days")).select("user_id", F.date_format("start", "yyyy-MM-dd").alias("start"), "days")


def _days(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.to_date("ts").alias("date")).distinct()


def event_session_stats(spark: SparkSession, d: str) -> DataFrame:
    return session_stats(table(spark, d, "events"), ["user_id"])


def event_rung_marks(spark: SparkSession, d: str) -> DataFrame:
    return rung_marks(table(spark, d, "events"))


def daily_streak(spark: SparkSession, d: str) -> DataFrame:
    return streaks(_days(table(spark, d, "events")))


def lru_last_seen(spark: SparkSession, d: str) -> DataFrame:
    """Per user the last RECENT event types by their last occurrence, the newest last."""
    return recent(table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("at")))


def recent(last: DataFrame) -> DataFrame:
    """user_id and seen, of the last occurrence (at) of each of a user's event types."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at")))
    kept = last.withColumn("k", newest).where(f"k <= {RECENT}").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("k", "event_type")), asc=False).alias("l"))
    return kept.select("user_id", F.array_join(F.col("l")["event_type"], ",").alias("seen"))


def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    """The newest RING events; a top-k."""
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(RING).select("event_id", "user_id")


def unlock_states(spark: SparkSession, d: str) -> DataFrame:
    """A turn is open once the one before it is done; done if its text is long enough."""
    turns = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max(F.length("text") > 60).alias("done"))
    before = F.lag("done").over(Window.partitionBy("conv_id").orderBy("turn"))
    state = F.when(F.col("done"), "completed").when(F.coalesce(before, F.lit(True)), "open").otherwise("locked")
    return turns.select("conv_id", "turn", state.alias("state"))


def run_sessionize(spark: SparkSession, d: str) -> DataFrame:
    """Runs of turns with one role: conversation, role, first turn, size."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    change = (~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("int")
    runs = table(spark, d, "conversations").withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("size")).drop("run")


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """The k of each event's props, and how the props are written anew."""
    props = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", props["k"].alias("k"), F.to_json(F.struct(props["k"].alias("k"))).alias("json"))


def session_days(spark: SparkSession, d: str) -> DataFrame:
    """The day key of each user and event type: date|type|user, with what happened that day."""
    events = table(spark, d, "events").withColumn("key", F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), "event_type", F.col("user_id").cast("string")))
    return events.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type per day by event time."""
    counted = table(spark, d, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def window_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user that end GAP minutes after their last event."""
    counted = table(spark, d, "events").groupBy("user_id", F.session_window("ts", f"{GAP} minutes")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def streamed(spark: SparkSession, d: str, plan, keys: list[str], files_per_batch: int = 1000) -> DataFrame:
    """The last row of each key that the plan over the events' stream has given when all there is has been read.

    Each batch writes the rows that it changed into a folder of its own in the shared folder; a batch that runs again
    writes that folder again. An empty stream gives no rows.
    """
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/out")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(f"{d}/events.parquet" if _is_folder(spark, d) else f"{d}/events*.parquet")
    changed = plan(stream.withColumn("ts", F.col("ts").cast("timestamp")))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    query = changed.writeStream.outputMode("update").option("checkpointLocation", f"{place}/log").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*changed.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{place}/out")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_k", newest).where("_k = 1").drop("_k", "batch")


def _is_folder(spark: SparkSession, d: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def stream_stats(spark: SparkSession, d: str) -> DataFrame:
    """Session statistics from the stream: the state is one row a user."""
    return streamed(spark, d, lambda e: session_stats(e, ["user_id"]), ["user_id"])


def _daily(stream: DataFrame, *keys: str) -> DataFrame:
    """Counts by day of event time; days end a day after the newest event, and their state with them."""
    counted = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *keys, "n")


def stream_streak(spark: SparkSession, d: str) -> DataFrame:
    """Streaks from the stream: its state is the users of the last days, the stretches are made of the days that it has given."""
    days = streamed(spark, d, lambda e: _daily(e, "user_id"), ["day", "user_id"])
    return streaks(days.select("user_id", F.to_date("day").alias("date")))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows with a watermark of a day."""
    return streamed(spark, d, lambda e: _daily(e, "event_type"), ["day", "event_type"])


def stream_last_seen(spark: SparkSession, d: str) -> DataFrame:
    """As lru_last_seen, from the stream: its state is the last event of each user and type."""
    last = streamed(spark, d, lambda e: e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("at")), ["user_id", "event_type"])
    return recent(last)


_STATS = "SELECT user_id, max(value) AS max_value, count(*) FILTER (WHERE event_type = 'purchase') AS successes, count(*) FILTER (WHERE event_type = 'error') AS retries, max_by(value, row(ts, event_id)) AS last_value, bool_or(event_type = 'purchase') AS completed FROM events GROUP BY 1"
_STREAK = "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events), i AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INTEGER) AS g FROM d) SELECT user_id, strftime(min(date), '%Y-%m-%d') AS start, count(*) AS days FROM i GROUP BY user_id, g"
_SEEN = f"WITH l AS (SELECT user_id, event_type, max(row(ts, event_id)) AS last FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS k FROM l) SELECT user_id, string_agg(event_type, ',' ORDER BY k DESC) AS seen FROM k WHERE k <= {RECENT} GROUP BY 1"
_DAILY = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"
_NAMES = (event_session_stats, event_rung_marks, daily_streak, lru_last_seen, ring_buffer, unlock_states, run_sessionize, json_props, session_days, window_tumbling, window_session, stream_stats, stream_streak, stream_windows, stream_last_seen)
QUERIES = {f.__name__: f for f in _NAMES}
ORACLES = {
    "event_session_stats": _STATS,
    "event_rung_marks": "WITH s AS (SELECT *, coalesce(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events), m AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, g) AS misses FROM s) SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN 'revealed' WHEN misses = 0 THEN 'first' ELSE 'retry' END AS mark FROM m WHERE event_type IN ('purchase', 'signup')",
    "daily_streak": _STREAK,
    "lru_last_seen": _SEEN,
    "stream_last_seen": _SEEN,
    "ring_buffer": f"SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT {RING}",
    "unlock_states": "WITH t AS (SELECT conv_id, turn, max(len(text) > 60) AS done FROM conversations GROUP BY 1, 2), l AS (SELECT *, lag(done) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t) SELECT conv_id, turn, CASE WHEN done THEN 'completed' WHEN coalesce(b, true) THEN 'open' ELSE 'locked' END AS state FROM l",
    "run_sessionize": "WITH c AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) THEN 0 ELSE 1 END AS x FROM conversations), r AS (SELECT *, sum(x) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT conv_id, any_value(role) AS role, min(turn) AS first_turn, count(*) AS size FROM r GROUP BY conv_id, run",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract(props, '$.k') || '}' AS json FROM events",
    "session_days": "SELECT strftime(ts, '%Y-%m-%d') || '|' || event_type || '|' || user_id AS key, count(*) AS n FROM events GROUP BY 1",
    "window_tumbling": _DAILY,
    "window_session": f"WITH l AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL {GAP} MINUTE, true) AS x FROM events), s AS (SELECT *, sum(CAST(x AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, g",
    "stream_stats": _STATS,
    "stream_streak": _STREAK,
    "stream_windows": _DAILY,
}

"""Queries over failures and metric events, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import failures as X
from ..operators import metrics as N
from ..session import work_dir
from ..sources.tables import read_table
from ..streaming import jobs as S
from . import duck as D
from .chunks import crawled_at, longs
from .registry import query

# Messages in the events, by event id.
MESSAGES = (
    "read ECONNRESET", "getaddrinfo ENOTFOUND host", "Network timeout", "Navigation Timeout exceeded", "connect ETIMEDOUT",
    "Rate limit reached", "Too many requests", "boom", "",
)
_MESSAGE = f"[{', '.join(D.q(m) for m in MESSAGES)}][event_id % {len(MESSAGES)} + 1]"
_CATEGORY = """CASE WHEN contains(m, 'network') OR contains(m, 'econnreset') OR contains(m, 'enotfound') THEN 'network'
    WHEN contains(m, 'timeout') OR contains(m, 'etimedout') THEN 'timeout'
    WHEN contains(m, 'rate limit') OR contains(m, 'too many requests') THEN 'rate_limit' ELSE 'unknown' END"""
_CLASSIFIED = f"""(SELECT *, CASE category WHEN 'rate_limit' THEN 'low' ELSE 'medium' END AS severity, category <> 'unknown' AS retryable
    FROM (SELECT event_id, {_CATEGORY} AS category FROM (SELECT event_id, lower({_MESSAGE}) AS m FROM events WHERE event_type = 'error')))"""


def failures(spark, d):
    message = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    errors = read_table(spark, d, "events").where(F.col("event_type") == "error")
    return X.classify(errors.select("event_id", message.alias("message")))


@query("failure_categories", f"SELECT event_id, category, severity, retryable FROM {_CLASSIFIED}")
def failure_categories(spark, d):
    return failures(spark, d).select("event_id", "category", "severity", "retryable")


@query(
    "failure_counts",
    f"""SELECT 'category' AS dimension, category AS key, count(*) AS n FROM {_CLASSIFIED} GROUP BY category UNION ALL
        SELECT 'severity', severity, count(*) FROM {_CLASSIFIED} GROUP BY severity UNION ALL SELECT 'total', 'all', count(*) FROM {_CLASSIFIED}""",
)
def failure_counts(spark, d):
    return X.error_stats(failures(spark, d))


def metric_events(spark, d):
    return N.events_as_metrics(read_table(spark, d, "events"))


_TOTAL = "sum(value::DECIMAL(18,6))::DOUBLE"


def _duration(ms):
    s = f"floor({ms} / 1000)::BIGINT"
    return (
        f"CASE WHEN {s} >= 3600 THEN {s} // 3600 || 'h ' || {s} // 60 % 60 || 'm ' || {s} % 60 || 's' "
        f"WHEN {s} >= 60 THEN {s} // 60 || 'm ' || {s} % 60 || 's' ELSE {s} || 's' END"
    )


@query(
    "metric_timings",
    f"""SELECT 'processing' AS category, event_type AS name, count(value) AS count, {D.round_to(f'{_TOTAL} / count(value)', 0)}::BIGINT AS average,
        min(value) AS min, max(value) AS max, {_TOTAL} AS total, {_duration(_TOTAL)} AS total_text FROM events GROUP BY event_type""",
)
def metric_timings(spark, d):
    return N.timings(metric_events(spark, d))


@query("duration_text", f"SELECT event_id, {_duration('value * 40000')} AS text FROM events")
def duration_text(spark, d):
    return read_table(spark, d, "events").select("event_id", N.duration_text(F.col("value") * 40000).alias("text"))


@query("metric_counters", f"SELECT 'processing:' || event_type AS key, {_TOTAL} AS total FROM events GROUP BY event_type")
def metric_counters(spark, d):
    return N.counters(metric_events(spark, d))


_LEVEL = "['debug', 'info', 'warn', 'error', 'critical'][event_id % 5 + 1]"


@query(
    "log_counters",
    f"""SELECT 'processing:log_' || {_LEVEL} AS key, count(*) AS total FROM events WHERE event_id % 5 >= 2 GROUP BY 1
        UNION ALL SELECT 'processing:total_errors', count(*) FROM events WHERE event_id % 5 >= 3""",
)
def log_counters(spark, d):
    level = F.element_at(F.array(*[F.lit(x) for x in N.LOG_LEVELS]), (F.col("event_id") % 5 + 1).cast("int"))
    return N.log_counters(read_table(spark, d, "events").select(level.alias("level")), "warn")


@query(
    "metric_gauges",
    "SELECT 'processing:' || event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type",
)
def metric_gauges(spark, d):
    return N.gauges(metric_events(spark, d))


@query(
    "metric_success_rates",
    f"""SELECT 'processing:op' || user_id % 7 AS key, count(*) FILTER (event_type <> 'error') AS success_count,
        count(*) FILTER (event_type = 'error') AS error_count, count(*) AS total,
        {D.round_to("count(*) FILTER (event_type <> 'error')::DOUBLE / count(*) * 100", 0)}::BIGINT AS success_rate FROM events GROUP BY 1""",
)
def metric_success_rates(spark, d):
    ops = metric_events(spark, d).select(
        "category", F.concat(F.lit("op"), (F.col("user_id") % 7).cast("string")).alias("name"),
        (F.col("name") != "error").alias("ok"),
    )
    return N.success_rates(ops, F.col("ok"))


def micros(c):
    return F.unix_micros(c)


@query(
    "metric_sampled_gauge",
    f"""SELECT epoch_us(time_bucket(INTERVAL '30 seconds', ts)) AS window_start, event_type AS name, arg_max(value, (ts, event_id)) AS current,
        max(value) AS peak, {D.round_to(f'{_TOTAL} / count(value)', 0)}::BIGINT AS average, count(value) AS samples, max(value) > 150 AS high
        FROM events GROUP BY 1, 2""",
)
def metric_sampled_gauge(spark, d):
    g = N.sampled_gauge(metric_events(spark, d), threshold=150.0)
    return g.withColumn("window_start", micros("window_start"))


# --- streaming ---------------------------------------------------------------


@query(
    "stream_metric_windows",
    f"""SELECT epoch_us(w) AS window_start, name, n, total, peak FROM (
        SELECT time_bucket(INTERVAL '10 minutes', ts) AS w, event_type AS name, count(*) AS n, {_TOTAL} AS total, max(value) AS peak
        FROM events GROUP BY 1, 2) WHERE w + INTERVAL '10 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""",
)
def stream_metric_windows(spark, d):
    """Tumbling windows in append mode: every window the watermark has closed."""
    out, state = work_dir(spark, "windows"), work_dir(spark, "windows-state")
    events = S.stream_events(spark, f"{d}/events*.parquet")
    S.append_to(S.windowed_metrics(events), out, state).awaitTermination()
    return spark.read.parquet(out).select(micros("window_start").alias("window_start"), "name", "n", "total", "peak")


@query(
    "stream_running_totals",
    f"SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, count(*) AS n, {_TOTAL} AS total FROM events GROUP BY 1",
)
def stream_running_totals(spark, d):
    """Running totals by status in complete mode."""
    out, state = work_dir(spark, "totals"), work_dir(spark, "totals-state")
    status = F.when(F.col("event_type") == "error", "error").otherwise("success")
    rows = S.stream_events(spark, f"{d}/events*.parquet").select(status.alias("status"), "value")
    S.replace_table(S.running_totals(rows), out, state).awaitTermination()
    table = spark.read.parquet(out)
    last = table.agg(F.max("batch").alias("batch"))
    return table.join(F.broadcast(last), "batch").drop("batch")


@query(
    "stream_first_visits",
    f"SELECT DISTINCT {D.u_norm('url')} AS norm_url FROM pages WHERE length(html) >= 100",
)
def stream_first_visits(spark, d):
    """Each normalised URL of the page stream once."""
    out, state = work_dir(spark, "visits"), work_dir(spark, "visits-state")
    S.append_to(S.first_visits(S.stream_pages(spark, f"{d}/pages*.parquet")), out, state).awaitTermination()
    return spark.read.parquet(out).select("norm_url")


@query("stream_page_chunks")
def stream_page_chunks(spark, d):
    """Page stream to chunk rows."""
    out, state = work_dir(spark, "chunks"), work_dir(spark, "chunks-state")
    S.chunk_pages(S.stream_pages(spark, f"{d}/pages*.parquet"), out, state, crawled_at=crawled_at()).awaitTermination()
    return spark.read.parquet(out).select("page_id", *longs("chunk_index"), "content", *longs("tokens"))



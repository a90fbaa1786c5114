"""Metric events (ts, category, name, kind, value): timings, counters, gauges, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, round_half_up

LOG_LEVELS = ("debug", "info", "warn", "error", "critical")
SAMPLE_INTERVAL = "30 seconds"
HIGH_GAUGE = 500.0


def key(category: Column | str = "category", name: Column | str = "name") -> Column:
    return F.concat_ws(":", col(category), col(name))


def duration_text(ms: Column | str) -> Column:
    """``1h 1m 1s``, ``1m 1s`` or ``5s``."""
    seconds = F.floor(col(ms) / 1000).cast("long")
    minutes = F.floor(seconds / 60).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    return (
        F.when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes % 60, seconds % 60))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, seconds % 60))
        .otherwise(F.format_string("%ds", seconds))
    )


def exact_sum(value: str) -> Column:
    """Sum as a fixed-point number, the same in any order of rows."""
    return F.sum(F.col(value).cast("decimal(18,6)"))


def timings(events: DataFrame, value: str = "value") -> DataFrame:
    """Count, rounded average, smallest, largest and total duration (ms) per operation."""
    total = F.col("_total").cast("double")
    return (
        events.groupBy("category", "name")
        .agg(
            F.count(value).alias("count"), exact_sum(value).alias("_total"),
            F.min(value).alias("min"), F.max(value).alias("max"),
        )
        .select(
            "category", "name", "count", round_half_up(total / F.col("count")).alias("average"),
            "min", "max", total.alias("total"), duration_text(total).alias("total_text"),
        )
    )


def counters(events: DataFrame, value: str = "value") -> DataFrame:
    return events.groupBy(key().alias("key")).agg(exact_sum(value).cast("double").alias("total"))


def at_least(level: Column | str, lowest: str) -> Column:
    """True for log levels from ``lowest`` up."""
    if lowest not in LOG_LEVELS:
        raise ValueError(f"unknown level: {lowest}")
    return F.coalesce(col(level).isin(*LOG_LEVELS[LOG_LEVELS.index(lowest) :]), F.lit(False))


def log_counters(logs: DataFrame, lowest: str = "info", level: str = "level") -> DataFrame:
    """``log_<level>`` counts of the shown levels, and ``total_errors`` over error and critical."""
    shown = logs.where(at_least(level, lowest)).groupBy(level).agg(F.count("*").alias("n"))
    is_error = F.col(level).isin("error", "critical")
    names = F.array_compact(
        F.array(F.concat(F.lit("processing:log_"), F.col(level)), F.when(is_error, "processing:total_errors"))
    )
    return shown.select("n", F.explode(names).alias("key")).groupBy("key").agg(F.sum("n").alias("total"))


def gauges(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), value: str = "value") -> DataFrame:
    """Last value per gauge; ties in time are settled by the later columns of ``order``."""
    return events.groupBy(key().alias("key")).agg(F.max_by(value, F.struct(*order)).alias("value"))


def success_rates(events: DataFrame, success: Column) -> DataFrame:
    """Successes, errors and rounded success percentage per operation, also where all failed."""
    return (
        events.groupBy(key().alias("key"))
        .agg(F.count_if(success).alias("success_count"), F.count_if(~success).alias("error_count"))
        .withColumn("total", F.col("success_count") + F.col("error_count"))
        .withColumn("success_rate", round_half_up(F.col("success_count") / F.col("total") * 100))
    )


def sampled_gauge(
    events: DataFrame, interval: str = SAMPLE_INTERVAL, threshold: float = HIGH_GAUGE, value: str = "value"
) -> DataFrame:
    """Current, peak and average value, sample count and high flag per interval."""
    return (
        events.groupBy(F.window("ts", interval).alias("w"), "name")
        .agg(
            F.max_by(value, F.struct("ts", "event_id")).alias("current"),
            F.max(value).alias("peak"),
            exact_sum(value).cast("double").alias("_sum"),
            F.count(value).alias("samples"),
        )
        .select(
            F.col("w.start").alias("window_start"), "name", "current", "peak",
            round_half_up(F.col("_sum") / F.col("samples")).alias("average"),
            "samples", (F.col("peak") > threshold).alias("high"),
        )
    )


def events_as_metrics(events: DataFrame) -> DataFrame:
    """The events table as metric events; ``ts`` gets a time zone, which windows with watermarks need."""
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("processing").alias("category"),
        F.col("event_type").alias("name"), F.lit("timer").alias("kind"), "value", "user_id",
    )

"""Extensions: the monitoring operators as Structured Streaming queries over an event stream (ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_trend(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and value by day and type; days close when the watermark passes them."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return days.select(F.to_date("window.start").alias("day"), "event_type", "events", F.round("value", 2).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events at most ``gap`` apart."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"))
    return s.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of equal ones within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def anomalies(monthly: DataFrame, window: int = 3, std: float = 2.0) -> DataFrame:
    """A10 on a stream of ``monthly`` (page, month, clicks): the anomalies of every page that a batch has brought months of.

    State is a page's months and clicks, one entry for each month, so late and shuffled months count like any other; a month
    that comes again replaces its clicks. Each batch gives, for each page in it, all anomalies of the page as
    of now and their ``version`` (the page's batches so far); a page without any has one row with a null month, so that the
    rows of a page's last version are what the batch operator gives over all input.
    """
    from lodestar.streaming.processors import anomaly_processor

    out = "page string, version bigint, month string, clicks bigint, delta double, rolling_avg_before double, drop_percentage double"
    keyed = monthly.select("page", "month", F.col("clicks").cast("bigint").alias("clicks")).filter("page IS NOT NULL AND month IS NOT NULL").groupBy("page")
    return keyed.transformWithStateInPandas(anomaly_processor(window, std), out, "Update", "None")

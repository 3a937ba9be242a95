"""Queries of the streaming extensions: the same column expressions, run as a batch over the table."""

from __future__ import annotations

from lodestar.plans.registry import query
from lodestar.sources.tables import table
from lodestar.streaming import trends


@query("x1_daily_trend", oracle="SELECT CAST(ts AS DATE) AS day, event_type, count(*)::BIGINT AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def x1_daily_trend(spark, sf_dir):
    return trends.daily_trend(table(spark, sf_dir, "events"))


@query(
    "x2_sessions",
    oracle="""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
numbered AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM marked)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*)::BIGINT AS events FROM numbered GROUP BY user_id, n""",
)
def x2_sessions(spark, sf_dir):
    return trends.sessions(table(spark, sf_dir, "events"))

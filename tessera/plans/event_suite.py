"""Analytical shapes over the event table: many small aggregates, top lists and filters over one wide scan; and event-time windows.

The suite follows the shape of a public benchmark's list of queries, over another table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.windows import sessions, tumbling_counts
from .catalog import query, text

_SUITE = [
    "SELECT count(*) AS n FROM events",
    "SELECT count(*) AS n FROM events WHERE event_type <> 'view'",
    "SELECT CAST(sum(user_id) AS BIGINT) AS s, count(*) AS n, round(avg(value), 6) AS a FROM events",
    "SELECT round(avg(user_id), 6) AS a FROM events",
    "SELECT count(DISTINCT user_id) AS u FROM events",
    "SELECT count(DISTINCT props) AS p FROM events",
    "SELECT min(ts) AS lo, max(ts) AS hi FROM events",
    "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type ORDER BY n DESC, event_type",
    "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS a, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10",
    "SELECT props, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY props ORDER BY u DESC, props LIMIT 10",
    "SELECT event_type, props, count(*) AS n FROM events GROUP BY event_type, props ORDER BY n DESC, event_type, props LIMIT 10",
    "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10",
    "SELECT user_id, CAST(minute(ts) AS BIGINT) AS m, event_type, count(*) AS n FROM events GROUP BY user_id, minute(ts), event_type ORDER BY n DESC, user_id, m, event_type LIMIT 10",
    "SELECT user_id FROM events WHERE user_id = 17",
    "SELECT count(*) AS n FROM events WHERE props LIKE '%: 1%'",
    "SELECT event_type, min(props) AS p, count(*) AS n FROM events WHERE props LIKE '%: 1%' AND event_type <> '' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10",
    "SELECT event_id, ts, user_id FROM events WHERE props LIKE '%2%' ORDER BY ts, event_id LIMIT 10",
    "SELECT event_type FROM events WHERE event_type <> '' ORDER BY ts, event_id LIMIT 10",
    "SELECT event_type, event_id FROM events ORDER BY event_type, event_id LIMIT 10",
    "SELECT user_id, round(avg(length(props)), 6) AS l, count(*) AS n FROM events WHERE props <> '' GROUP BY user_id HAVING count(*) > 10 ORDER BY l DESC, user_id LIMIT 25",
    "SELECT " + ", ".join(f"CAST(sum(user_id + {k}) AS BIGINT) AS s{k}" for k in range(30)) + " FROM events",
    "SELECT user_id, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s, round(avg(value), 6) AS a FROM events WHERE event_type <> '' GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10",
    "SELECT 1 AS one, event_type, count(*) AS n FROM events GROUP BY 1, event_type ORDER BY n DESC, event_type LIMIT 10",
    "SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, count(*) AS n FROM events GROUP BY user_id, user_id - 1, user_id - 2 ORDER BY n DESC, user_id LIMIT 10",
    "SELECT props, count(*) AS n FROM events WHERE event_type = 'click' AND ts >= DATE '2024-01-05' AND ts < DATE '2024-01-20' GROUP BY props ORDER BY n DESC, props LIMIT 10",
    "SELECT CASE WHEN event_type = 'click' AND value > 1 THEN props ELSE '' END AS src, event_type AS dst, count(*) AS n FROM events GROUP BY CASE WHEN event_type = 'click' AND value > 1 THEN props ELSE '' END, event_type ORDER BY n DESC, src, dst LIMIT 10 OFFSET 2",
    "SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS m, count(*) AS n FROM events WHERE ts >= DATE '2024-01-14' AND ts < DATE '2024-01-16' GROUP BY date_trunc('minute', ts) ORDER BY m LIMIT 10 OFFSET 10",
    "SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks FROM events WHERE value > 0 GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "SELECT CAST(extract(hour FROM ts) AS BIGINT) AS h, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY extract(hour FROM ts) ORDER BY h",
    "SELECT min(event_type) AS lo, max(event_type) AS hi, min(props) AS p FROM events WHERE user_id > 10",
    "SELECT event_type, max(value) AS top, min(ts) AS first_ FROM events GROUP BY event_type HAVING max(value) > 0 ORDER BY top DESC, event_type",
    "SELECT user_id, min(ts) AS first_, max(ts) AS last_, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 3 ORDER BY user_id LIMIT 50",
    "SELECT event_type || ':' || props AS k, count(*) AS n FROM events GROUP BY event_type || ':' || props ORDER BY n DESC, k LIMIT 15",
    "SELECT DISTINCT event_type, props FROM events WHERE value > 1 ORDER BY event_type, props LIMIT 20",
    "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) AS x",
    "SELECT user_id % 10 AS bucket, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY user_id % 10 ORDER BY bucket",
    "SELECT CAST(length(props) AS BIGINT) AS l, count(*) AS n FROM events GROUP BY length(props) ORDER BY l",
    "SELECT event_id, user_id FROM events WHERE user_id = 42 AND event_type = 'click' OR user_id = 43 AND event_type <> 'click' ORDER BY event_id",
    "SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type NOT LIKE '%i%' GROUP BY CAST(ts AS DATE) ORDER BY d",
    "SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY event_type, user_id) AS x WHERE r <= 3",
    "SELECT replace(event_type, 'i', 'I') AS t, round(sum(value) / count(*), 6) AS a FROM events WHERE ts BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY replace(event_type, 'i', 'I') ORDER BY t",
]
for _k, _sql in enumerate(_SUITE, 1):
    text(f"clickbench_like_{_k:02d}", _sql)


@query("window_tumbling", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(t):
    """Beyond the surveyed operators: event-time windows in batch."""
    return tumbling_counts(t.events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("window_session", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) AS x) AS y GROUP BY user_id, s")
def window_session(t):
    return sessions(t.events).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")

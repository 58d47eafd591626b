"""Windows over events, in batch form, and the progress messages of the tool loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import events as E
from .pipeline import _LOOP, _loop
from .registry import query


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(table(spark, d, "events"))


@query("""SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (ts < top - INTERVAL '2 days') AS late FROM events, (SELECT max(ts) AS top FROM events) GROUP BY event_type""")
def events_late(spark: SparkSession, d: str) -> DataFrame:
    """How many events a watermark of two days would count as late at the end."""
    e = table(spark, d, "events")
    top = e.agg(F.max("ts").alias("top"))
    return e.crossJoin(F.broadcast(top)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") < F.col("top") - F.expr("INTERVAL 2 DAYS")).alias("late"))


@query(f"""{_LOOP} SELECT qid, hop::INTEGER AS hop, 'step' AS kind, tool AS detail FROM run UNION ALL SELECT qid, (max(hop) + 1)::INTEGER, CASE WHEN bool_or(confident) THEN 'result' ELSE 'error' END, '' FROM run GROUP BY qid""")
def progress_messages(spark: SparkSession, d: str) -> DataFrame:
    return E.progress(_loop(spark, d))

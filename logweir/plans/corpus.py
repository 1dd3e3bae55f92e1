"""Syslog datagrams derived from the supplied tables by projection only.

``events`` becomes a mixed RFC 3164 / RFC 5424 / malformed stream. ``documents`` and
``conversations`` become datagrams with long, multi-line, non-ASCII message bodies.
"""

from pyspark.sql import DataFrame, SparkSession

_EVENTS = """
WITH e AS (
  SELECT *, CAST((event_id * 37) % 200 AS STRING) AS pri,
    'host' || CAST(user_id % 20 AS STRING) AS host,
    event_type || ' value=' || CAST(CAST(value AS DECIMAL(10,2)) AS STRING)
      || ' props=' || props AS body,
    date_format(ts, 'HH:mm:ss') AS hms,
    element_at(array('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'),
      month(ts)) || ' ' || lpad(CAST(day(ts) AS STRING), 2, ' ') AS md,
    date_format(ts, 'yyyy-MM-dd') AS ymd
  FROM {events})
SELECT event_id AS seq,
  CAST(date_trunc('second', ts) AS TIMESTAMP) AS rcv,
  '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 250 AS STRING) AS src,
  CAST(CASE
    WHEN event_id % 10 <= 4 THEN '<' || pri || '>' || md || ' ' || hms || ' ' || host || ' '
      || event_type || '[' || CAST(user_id AS STRING) || ']: ' || body
    WHEN event_id % 10 <= 6 THEN '<' || pri || '>1 ' || ymd || 'T' || hms || 'Z ' || host || ' '
      || event_type || ' ' || CAST(user_id AS STRING) || ' ID' || CAST(event_id % 50 AS STRING)
      || ' [meta k="1"] ' || body
    WHEN event_id % 10 = 7 THEN '<' || pri || '>1 - - - - - - ' || body
    WHEN event_id % 10 = 8 THEN '<' || pri || '>' || md || ' ' || hms || ' ' || host || ' '
      || event_type || ' plain text ' || CAST(event_id AS STRING)
    ELSE props END AS BINARY) AS payload
FROM e
"""

_DOCUMENTS = """
SELECT doc_id AS seq, TIMESTAMP '2026-01-01 00:00:00' AS rcv, source AS src,
  encode('<' || CAST((doc_id * 13) % 192 AS STRING) || '>1 - ' || source || ' ' || lang || ' '
    || CAST(doc_id AS STRING) || ' - ' || text, :charset) AS payload
FROM {documents}
"""

# Turns of one conversation are numbered from 0 and stay below 1000.
_CONVERSATIONS = """
SELECT conv_id * 1000 + turn AS seq, TIMESTAMP '2026-01-01 00:00:00' AS rcv, role AS src,
  CAST('<' || CAST((conv_id + turn) % 192 AS STRING) || '>Mar  4 05:06:07 chat ' || role || '['
    || CAST(conv_id AS STRING) || ']: ' || text AS BINARY) AS payload
FROM {conversations}
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_EVENTS, events=_table(spark, sf_dir, "events"))


def document_datagrams(spark: SparkSession, sf_dir: str, charset: str = "UTF-8") -> DataFrame:
    """Documents as a sender using ``charset`` puts them on the wire."""
    return spark.sql(
        _DOCUMENTS, args={"charset": charset}, documents=_table(spark, sf_dir, "documents")
    )


def conversation_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CONVERSATIONS, conversations=_table(spark, sf_dir, "conversations"))

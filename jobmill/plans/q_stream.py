"""Registered streaming queries (M01-M04, M06, M02): monitor streams over ``events``, run with an
available-now trigger, returning the store's end state; and the event-time lookback."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions.text import posting_id
from ..operators.scoring import Profile
from ..session import read_table, scratch_path
from ..store.changelog import ChangeLog
from ..streaming.monitor import start_monitor
from ..streaming.state import late_rows, within_lookback
from .registry import register, r6
from .sqlfrag import fold_ctes, simhash_ctes

STREAM_AS_OF = dt.datetime(2024, 1, 31)
STREAM_LOOKBACK = "30d"
STREAM_PROFILE = Profile(profile="stream", desired_roles=["purchase"],
                         must_have_keywords=["purchase", "signup"], must_not_keywords=["error"])


def events_to_postings(raw, sid=None, text=None):
    """Stream rows (events) -> posting columns; props is the repeated source job id."""
    company = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    out = raw.select(
        company.alias("company"), F.col("event_type").alias("title"), (F.col("props") if sid is None else sid).alias("source_job_id"),
        F.lit("unknown").alias("source_system"), F.lit("https://events.example.com").alias("source_url"),
        F.concat(F.lit("https://events.example.com/"), F.col("event_id").cast("string")).alias("apply_url"),
        F.lit(None).cast("string").alias("location"), F.lit("unknown").alias("remote_type"),
        F.lit("unknown").alias("employment_type"), F.lit(None).cast("string").alias("department"),
        F.col("ts").cast("timestamp").alias("posted_at"), (F.lit(None).cast("string") if text is None else text).alias("description_text"),
        F.array().cast("array<string>").alias("requirements"), F.col("event_id").alias("seq"))
    return out.withColumn("id", posting_id())


@register("monitor_stream", """
WITH e AS (SELECT * FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY props ORDER BY event_id) AS rn FROM e) WHERE rn = 1),
  k AS (SELECT *, regexp_matches(event_type, '(?i)\\berror\\b') AS excluded,
          regexp_matches(event_type, '(?i)\\bpurchase\\b') AS role,
          (regexp_matches(event_type, '(?i)\\bpurchase\\b')::INT + regexp_matches(event_type, '(?i)\\bsignup\\b')::INT) AS nkw,
          (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400e6 AS age_days FROM f),
  s AS (SELECT *, least(0.0e0 + CASE WHEN role THEN 0.4e0 ELSE 0.0e0 END + CAST(nkw AS DOUBLE) / 2.0e0 * 0.4e0
                        + 0.0e0 + 0.0e0, 1.0e0) AS kw,
          CASE WHEN ts IS NULL THEN 0.5e0 WHEN age_days <= 0 THEN 1.0e0 WHEN age_days >= 30 THEN 0.0e0
               ELSE 1.0e0 - sqrt(age_days / 30.0e0) END AS rec FROM k),
  g AS (SELECT *, CASE WHEN excluded THEN 0.0e0 ELSE 0.55e0 * 0.5e0 + 0.3e0 * kw + 0.15e0 * rec END AS final FROM s)
SELECT substr(sha256('user-' || user_id || ':unknown:' || props), 1, 16) AS id, props AS source_job_id,
       event_type AS title, round(final, 6) AS score, TIMESTAMP '2024-01-31' AS first_seen_at
FROM g WHERE final >= 0.3e0
""")
def q_monitor_stream(spark, sf_dir):
    root = scratch_path(spark, f"monitor-{uuid.uuid4().hex}")
    store = ChangeLog(spark, f"{root}/store")
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    q = start_monitor(spark, f"{sf_dir.rstrip('/')}/event[s].parquet", schema, events_to_postings,
                      store=store, profile=STREAM_PROFILE, as_of=STREAM_AS_OF, lookback=STREAM_LOOKBACK,
                      checkpoint=f"{root}/ckpt", available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return store.jobs().select("id", "source_job_id", "title", r6(F.col("score")).alias("score"),
                               "first_seen_at")


# -- M03 M06: several micro-batches over a store that holds jobs, with state kept between them ----
LANDINGS = 3
STORED_AT = dt.datetime(2024, 1, 1)


def _shifts_to_postings(raw):
    """Events -> postings whose title is the event type and whose text tells day, key and user:
    near copies where two of the three are equal."""
    text = F.concat_ws(" ", F.lit("shift on day"), F.dayofmonth("ts").cast("string"), F.lit("page"),
                       F.regexp_extract("props", "[0-9]+", 0), F.lit("for user"), F.col("user_id").cast("string"),
                       F.lit("with the usual duties of the team"))
    return events_to_postings(raw, F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("props")), text)


_NEAR_TEXT_SQL = ("'shift on day ' || CAST(day(ts) AS VARCHAR) || ' page ' || regexp_extract(props, '[0-9]+') || ' for user ' "
                  "|| CAST(user_id AS VARCHAR) || ' with the usual duties of the team'")


def _landed(spark, sf_dir, root, k):
    """The k-th part of the events, by arrival (event id), as one more folder of files."""
    e = read_table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("event_id"), F.max("event_id")).first()
    step = ((hi or 0) - (lo or 0)) // LANDINGS + 1
    part = (F.col("event_id") - F.lit(lo or 0)) >= k * step
    e.where(part & ((F.col("event_id") - F.lit(lo or 0)) < (k + 1) * step)).write.parquet(f"{root}/in/b{k}")
    return e.schema


@register("monitor_near_dup", f"""
WITH RECURSIVE e AS (SELECT *, CAST(user_id AS VARCHAR) || '/' || props AS sid, {_NEAR_TEXT_SQL} AS body FROM events
    WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY),
  old AS (SELECT DISTINCT CAST(user_id AS VARCHAR) || '/' || props AS sid FROM events WHERE user_id % 5 = 0),
  f AS (SELECT *, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY event_id) AS rn FROM e
                                      WHERE sid NOT IN (SELECT sid FROM old)) WHERE rn = 1),
  tx AS (SELECT id, event_type || ' ' || body AS text FROM f),
  {simhash_ctes('tx', 'id', 'text')},
  j AS (SELECT f.*, s_fp.fp FROM f JOIN s_fp USING (id)),
  {fold_ctes('j', "event_type", 'event_id')},
  g AS (SELECT f.*, regexp_matches(event_type, '(?i)\\berror\\b') AS excluded,
          regexp_matches(event_type, '(?i)\\bpurchase\\b') AS role,
          (regexp_matches(event_type, '(?i)\\bpurchase\\b')::INT + regexp_matches(event_type, '(?i)\\bsignup\\b')::INT) AS nkw,
          (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400e6 AS age_days FROM f JOIN r ON r.id = f.id AND r.admitted),
  s AS (SELECT *, least(CASE WHEN role THEN 0.4e0 ELSE 0.0e0 END + CAST(nkw AS DOUBLE) / 2.0e0 * 0.4e0, 1.0e0) AS kw,
          CASE WHEN ts IS NULL THEN 0.5e0 WHEN age_days <= 0 THEN 1.0e0 WHEN age_days >= 30 THEN 0.0e0
               ELSE 1.0e0 - sqrt(age_days / 30.0e0) END AS rec FROM g),
  t AS (SELECT *, CASE WHEN excluded THEN 0.0e0 ELSE 0.55e0 * 0.5e0 + 0.3e0 * kw + 0.15e0 * rec END AS final FROM s)
SELECT sid AS source_job_id, event_type AS title, round(final, 6) AS score, true AS is_new FROM t WHERE final >= 0.3e0
UNION ALL SELECT sid, NULL, 0.0e0, false FROM old
""")
def q_monitor_near_dup(spark, sf_dir):
    root = scratch_path(spark, f"monitor-{uuid.uuid4().hex}")
    store = ChangeLog(spark, f"{root}/store")
    old = _shifts_to_postings(read_table(spark, sf_dir, "events").where("user_id % 5 = 0"))
    store.save(old, STORED_AT, order_col="seq")
    for k in range(LANDINGS):      # the stream stops and starts again: its state stays
        schema = _landed(spark, sf_dir, root, k)
        q = start_monitor(spark, f"{root}/in/b*", schema, _shifts_to_postings, store=store, profile=STREAM_PROFILE,
                          as_of=STREAM_AS_OF, lookback=STREAM_LOOKBACK, checkpoint=f"{root}/ckpt", near_dup=True, available_now=True)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    is_new = F.col("first_seen_at") != F.lit(STORED_AT).cast("timestamp")
    return store.jobs().select("source_job_id", F.when(is_new, F.col("title")).alias("title"),
                               r6(F.col("score")).alias("score"), is_new.alias("is_new"))


# -- M02 by event time, with files that come late -----------------------------------------------
@register("event_lookback", """
WITH e AS (SELECT *, event_id % 3 AS part FROM events WHERE ts IS NOT NULL),
  w AS (SELECT p.part, (SELECT max(ts) FROM e WHERE e.part < p.part) - INTERVAL 7 DAY AS mark FROM (SELECT DISTINCT part FROM e) p),
  m AS (SELECT props, user_id, mark IS NOT NULL AND ts <= mark AS late FROM e JOIN w USING (part))
SELECT 'late' AS kind, count(*)::VARCHAR AS name FROM m WHERE late
UNION ALL SELECT DISTINCT 'seen', CAST(user_id AS VARCHAR) || '/' || props FROM m WHERE NOT late
""")
def q_event_lookback(spark, sf_dir):
    root, late = scratch_path(spark, f"lookback-{uuid.uuid4().hex}"), 0
    e = read_table(spark, sf_dir, "events")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).write.parquet(f"{root}/in/b{k}")
        stream = spark.readStream.schema(e.schema).parquet(f"{root}/in/b*")
        sid = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("props"))
        rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), sid.alias("sid"))
        q = (within_lookback(rows, "ts", "7 days", "sid").select("sid").writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
        late += late_rows(q)
    seen = spark.read.parquet(f"{root}/out").distinct().select(F.lit("seen").alias("kind"), F.col("sid").alias("name"))
    return seen.unionAll(spark.createDataFrame([("late", str(late))], "kind string, name string"))

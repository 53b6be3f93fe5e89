"""Registered report and store queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import reports, scoring
from ..session import read_table, scratch_path
from ..store import jobs as store
from ..store.changelog import ChangeLog
from . import standins
from .registry import AS_OF, SAMPLE_PROFILE, _SCORED_SQL, register, r6
from .sqlfrag import py_title

STORE_SPLIT = "2000-01-01"
INCOMING_FROM = "1999-07-01"
FIRST_LOAD_AT = dt.datetime(2000, 1, 1)
TOPIC = "jobs"


def _matches(spark, sf_dir):
    p = standins.postings_li(spark, sf_dir)
    s = scoring.score(p, [SAMPLE_PROFILE], AS_OF)
    return s.filter(F.col("final_score") >= F.col("min_score_threshold"))


_MATCH_SQL = _SCORED_SQL.replace(
    "  SELECT id, company, title, location, excluded,",
    "  SELECT id, company, title, location, excluded, remote_type, employment_type, department, posted_at,"
) + ", m AS (SELECT * FROM f WHERE final_score >= 0.3e0)"


def _pct(x: str) -> str:
    return f"CAST(CAST(round_even({x} * 100.0e0, 0) AS BIGINT) AS VARCHAR) || '%'"


# -- A06 -------------------------------------------------------------------------
@register("digest", _MATCH_SQL + f"""
, r AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, id) AS rn FROM m),
  n AS (SELECT count(*)::BIGINT AS total FROM m)
SELECT 'sample' AS profile, n.total, '📋 Job Digest: ' || n.total || ' new jobs' AS title,
  string_agg(r.rn || '. ' || r.title || ' @ ' || r.company || ' (' || {_pct('r.final_score')} || ')', chr(10) ORDER BY r.rn)
  || CASE WHEN n.total > 10 THEN chr(10) || '... and ' || (n.total - 10) || ' more' ELSE '' END AS message
FROM r, n WHERE r.rn <= 10 GROUP BY n.total
""")
def q_digest(spark, sf_dir):
    return reports.digest(_matches(spark, sf_dir), ["profile"])


# -- F19-F21 --------------------------------------------------------------------
@register("messages", _MATCH_SQL + f"""
SELECT id,
  CASE WHEN final_score >= 0.8 THEN 'high' WHEN final_score >= 0.6 THEN 'default' ELSE 'low' END AS priority,
  array_to_string(list_filter(['briefcase', CASE WHEN remote_type = 'remote' THEN 'house' END,
                               CASE WHEN final_score >= 0.8 THEN 'star' END], lambda x: x IS NOT NULL), ',') AS tags,
  'NEW: ' || title || ' @ ' || company AS title,
  concat_ws(chr(10), 'Location: ' || coalesce(nullif(location, ''), 'Not specified'),
            'Type: ' || {py_title("replace(employment_type, '_', ' ')")},
            'Remote: ' || {py_title('remote_type')},
            CASE WHEN department IS NOT NULL AND department <> '' THEN 'Dept: ' || department END,
            CASE WHEN posted_at IS NOT NULL THEN 'Posted: ' || strftime(posted_at, '%Y-%m-%d') END,
            'Score: ' || {_pct('final_score')},
            CASE WHEN reasons <> '' THEN '✨ ' || array_to_string(string_split(reasons, '; ')[1:3], ', ') END) AS message
FROM m
""")
def q_messages(spark, sf_dir):
    m = reports.messages(_matches(spark, sf_dir), TOPIC)
    return m.select("id", "priority", F.array_join("tags", ",").alias("tags"), "title", "message")


# -- K01 K02 K05 A01 ---------------------------------------------------------------
def _store_inputs(spark, sf_dir):
    p = standins.postings_li(spark, sf_dir)
    old = p.filter(F.col("posted_at") < F.lit(STORE_SPLIT).cast("timestamp"))
    empty = spark.createDataFrame([], store.JOBS_SCHEMA)
    first, _ = store.upsert_frames(empty, old, FIRST_LOAD_AT, order_col="seq")
    new = p.filter(F.col("posted_at") >= F.lit(INCOMING_FROM).cast("timestamp"))
    scored = scoring.score(new, [SAMPLE_PROFILE], AS_OF)
    return first, scored


_UPSERT_SQL = f"""
, old AS (SELECT DISTINCT id FROM m0 WHERE posted_at < TIMESTAMP '{STORE_SPLIT}'),
  inc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_orderkey, l_linenumber,
                                                   l_partkey, l_suppkey) AS rn
                         FROM f0 WHERE posted_at >= TIMESTAMP '{INCOMING_FROM}') WHERE rn = 1),
  snap AS (SELECT coalesce(old.id, inc.id) AS id,
             CASE WHEN old.id IS NULL THEN TIMESTAMP '2001-11-05' ELSE TIMESTAMP '2000-01-01' END AS first_seen_at,
             CASE WHEN old.id IS NOT NULL AND inc.id IS NOT NULL THEN TIMESTAMP '2001-11-05' END AS updated_at,
             CASE WHEN inc.id IS NOT NULL THEN inc.final_score ELSE 0.0e0 END AS score,
             CASE WHEN old.id IS NULL THEN inc.keyword_score ELSE 0.0e0 END AS keyword_score,
             inc.id IS NOT NULL AS touched, old.id IS NULL AS is_new
           FROM old FULL OUTER JOIN inc ON old.id = inc.id)
"""
_STORE_BASE = _SCORED_SQL.replace(
    "  SELECT id, company, title, location, excluded,",
    "  SELECT id, company, title, location, excluded, posted_at,") + \
    f", m0 AS (SELECT * FROM {standins.POSTINGS_LI_SQL} q), f0 AS (SELECT * FROM f)" + _UPSERT_SQL


@register("upsert", _STORE_BASE + """
SELECT id, first_seen_at, updated_at, round(score, 6) AS score, round(keyword_score, 6) AS keyword_score FROM snap
""")
def q_upsert(spark, sf_dir):
    first, scored = _store_inputs(spark, sf_dir)
    snap, _ = store.upsert_frames(first, scored, AS_OF, order_col="seq")
    return snap.select("id", "first_seen_at", "updated_at", r6(F.col("score")).alias("score"),
                       r6(F.col("keyword_score")).alias("keyword_score"))


@register("run_log", _STORE_BASE + """
SELECT 1::BIGINT AS run_id, 'completed' AS status, count(*)::BIGINT AS jobs_found,
       sum(is_new::INT)::BIGINT AS jobs_new, TIMESTAMP '2001-11-05' AS started_at,
       TIMESTAMP '2001-11-05' AS completed_at
FROM snap WHERE touched
""")
def q_run_log(spark, sf_dir):
    """The totals come out of the save that they describe."""
    log = ChangeLog(spark, scratch_path(spark, f"runs-{uuid.uuid4().hex}"))
    p = standins.postings_li(spark, sf_dir)
    log.save(p.filter(F.col("posted_at") < F.lit(STORE_SPLIT).cast("timestamp")), FIRST_LOAD_AT, order_col="seq")
    new = p.filter(F.col("posted_at") >= F.lit(INCOMING_FROM).cast("timestamp"))
    log.start_run(1, AS_OF)
    totals = log.save(scoring.score(new, [SAMPLE_PROFILE], AS_OF), AS_OF, order_col="seq")
    log.complete_run(1, AS_OF, totals)
    return log.runs().select("run_id", "status", "jobs_found", "jobs_new", "started_at", "completed_at")


# -- K04 J06 A03 ---------------------------------------------------------------------
@register("mark_notified", """
WITH ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'
             UNION SELECT DISTINCT p_partkey + 1000000000 FROM part),
  hit AS (SELECT id FROM ids WHERE id IN (SELECT o_orderkey FROM orders))
SELECT o_orderkey AS id, o_custkey AS company_id, o_orderpriority AS title, round(o_totalprice / 1000000.0e0, 6) AS score,
  CAST(o_orderdate AS TIMESTAMP) AS first_seen_at,
  CASE WHEN hit.id IS NOT NULL THEN TIMESTAMP '2001-11-05' WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) END AS notified_at,
  CASE WHEN hit.id IS NOT NULL THEN TIMESTAMP '2001-11-05' END AS sent_at, CASE WHEN hit.id IS NOT NULL THEN 'push/jobs' END AS sent_to,
  (SELECT count(*) FROM hit)::BIGINT AS sent, (SELECT count(*) FROM hit)::BIGINT AS total
FROM orders LEFT JOIN hit ON hit.id = o_orderkey
""")
def q_mark_notified(spark, sf_dir):
    """Every stored row after the marks, its notification row, and the totals."""
    jobs = standins.stored_jobs(spark, sf_dir).withColumnRenamed("job_id", "id")
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R") \
        .select(F.col("l_orderkey").alias("id"))
    missing = read_table(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000_000).alias("id"))
    snap, notes = store.mark_notified_frames(jobs, li.unionByName(missing), "push", TOPIC, AS_OF)
    totals = reports.notification_totals(notes).first()
    sent = notes.select(F.col("job_id").alias("id"), "sent_at", F.concat_ws("/", "mode", "target").alias("sent_to"))
    return snap.join(sent, "id", "left").select("id", "company_id", "title", r6(F.col("score")).alias("score"), "first_seen_at", "notified_at", "sent_at", "sent_to",
                                                F.lit(totals["sent"]).alias("sent"), F.lit(totals["total"]).alias("total"))


# -- K06 J05 -------------------------------------------------------------------------
@register("company_upsert", """
WITH existing AS (SELECT DISTINCT c_name AS name FROM customer),
  names AS (SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT name, name IN (SELECT name FROM existing) AS existed FROM (SELECT name FROM existing UNION SELECT name FROM names)
""")
def q_company_upsert(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer")
    existing = cust.select(F.col("c_name").alias("name")).distinct().select(
        store.company_key("name").alias("company_id"), "name", F.lit(None).cast("string").alias("config_json"))
    names = read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).unionByName(
        cust.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_name").alias("name")))
    out = store.company_upsert_frames(existing, names)
    return out.join(existing.select("name", F.lit(True).alias("existed")), "name", "left") \
        .select("name", F.coalesce("existed", F.lit(False)).alias("existed"))



# -- K03 ---------------------------------------------------------------------------
@register("match_report", _MATCH_SQL + """
SELECT title, company, round(final_score, 6) AS score, replace(reasons, '; ', '|') AS reasons,
       'https://boards.example.com/' || company || '/' || CAST(l_orderkey AS VARCHAR) || '-'
         || CAST(l_linenumber AS VARCHAR) AS apply_url
FROM m
""")
def q_match_report(spark, sf_dir):
    r = reports.match_report(_matches(spark, sf_dir))
    return r.select("title", "company", r6(F.col("score")).alias("score"),
                    F.array_join("reasons", "|").alias("reasons"), "apply_url")


# -- K01 K02 K04 J06 through the change log: every column of the store --------------------------
MARKED_AT = dt.datetime(2001, 11, 6)
_ROW = "company, source_job_id, source_system, title, location, remote_type, employment_type, department, posted_at"


@register("store_log", _STORE_BASE + f"""
, o1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
                       FROM m0 WHERE posted_at < TIMESTAMP '{STORE_SPLIT}') WHERE rn = 1),
  i1 AS (SELECT m0.*, inc.final_score, inc.keyword_score, inc.vector_score, inc.recency_score
         FROM inc JOIN m0 USING (id, l_orderkey, l_linenumber, l_partkey, l_suppkey)),
  rows AS (SELECT id, {_ROW}, false AS fresh, 0.0e0 AS vector_score, 0.0e0 AS keyword_score, 0.0e0 AS recency_score FROM o1
           UNION ALL SELECT id, {_ROW}, true, vector_score, keyword_score, recency_score FROM i1 WHERE id NOT IN (SELECT id FROM o1))
SELECT r.id, true AS has_company_id, r.company, source_job_id, source_system, title, location, remote_type, employment_type, department, NULL AS team,
  'https://boards.example.com/' || r.company || '/' || source_job_id AS apply_url, 'https://boards.example.com/' || r.company AS source_url,
  posted_at, CASE WHEN NOT fresh AND r.id IN (SELECT id FROM i1) THEN TIMESTAMP '2001-11-05' END AS updated_at,
  NULL AS description_text, NULL AS seniority, round(coalesce(i.final_score, 0.0e0), 6) AS score, round(r.vector_score, 6) AS vector_score,
  round(r.keyword_score, 6) AS keyword_score, round(r.recency_score, 6) AS recency_score,
  CASE WHEN fresh THEN TIMESTAMP '2001-11-05' ELSE TIMESTAMP '2000-01-01' END AS first_seen_at,
  CASE WHEN location LIKE '%1%' THEN TIMESTAMP '2001-11-06' END AS notified_at
FROM rows r LEFT JOIN (SELECT id, final_score FROM i1) i USING (id)
""")
def q_store_log(spark, sf_dir):
    """Two saves, a compaction and a mark; then the store as a reader sees it."""
    log = ChangeLog(spark, scratch_path(spark, f"store-{uuid.uuid4().hex}"))
    p = standins.postings_li(spark, sf_dir, standins.staged_lines(spark, sf_dir))
    log.save(p.filter(F.col("posted_at") < F.lit(STORE_SPLIT).cast("timestamp")), FIRST_LOAD_AT, order_col="seq")
    log.compact()
    new = p.filter(F.col("posted_at") >= F.lit(INCOMING_FROM).cast("timestamp"))
    log.save(scoring.score(new, [SAMPLE_PROFILE], AS_OF), AS_OF, order_col="seq")
    some = log.jobs(columns=("id", "location")).where("location LIKE '%1%'").select("id").unionByName(p.select(F.concat(F.lit("no-"), "id").alias("id")))
    log.notify(some, "push", TOPIC, MARKED_AT)
    out = log.jobs()
    scores = ("score", *[c for c in store.SCORE_FIELDS if c != "score"])
    return out.select(*[F.col(c).isNotNull().alias("has_company_id") if c == "company_id" else r6(F.col(c)).alias(c) if c in scores else F.col(c)
                        for c in out.columns])

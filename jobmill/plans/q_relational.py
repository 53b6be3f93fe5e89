"""Registered queries: filters, keys, joins, aggregations (P01 P02 P05-P07, F01 F02 F18
F22, W01, A02 A07 A08, J01-J03, J06, T02 T03, U01-U03)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.text import searchable_text
from ..functions.timeutil import freshness_label
from ..operators import dedup, filters, reports
from ..session import read_table, spread
from ..store.jobs import unseen_top
from . import standins
from .registry import register
from .standins import POSTINGS_LI_SQL

EVENTS_AS_OF = dt.datetime(2024, 1, 31)
SPLIT_DATE = "2001-01-01"


def events_postings(spark, sf_dir):
    """events as arriving postings: one per event."""
    e = spread(read_table(spark, sf_dir, "events"))
    return e.select(F.col("event_id"), F.col("user_id"), F.col("event_type"),
                    F.col("ts").cast("timestamp").alias("posted_at"), F.col("props"))


def companies_from_supplier(spark, sf_dir):
    """Company configs for the stand-in postings: every supplier denies 'blue' and 'promo'
    (a department); those
    with a non-negative balance only keep titles with 'widget' or 'gear'."""
    s = read_table(spark, sf_dir, "supplier")
    kw = F.when(F.col("s_acctbal") >= 0, F.array(F.lit("widget"), F.lit("gear"))) \
        .otherwise(F.array().cast("array<string>"))
    return s.select(F.col("s_name").alias("name"), F.array(F.lit("blue"), F.lit("promo")).alias("deny_filters"),
                    kw.alias("keyword_filters"))


# -- P01 ---------------------------------------------------------------------
# what a posting is judged by: Lever boards add the department
FILTER_TEXT_SQL = ("lower(p.title || ' ' || coalesce(p.location, '') || "
                   "CASE WHEN p.source_system = 'lever' THEN ' ' || coalesce(p.department, '') ELSE '' END)")
COMPANY_FILTER_SQL = f"""NOT contains({FILTER_TEXT_SQL}, 'blue') AND NOT contains({FILTER_TEXT_SQL}, 'promo')
  AND (s.s_acctbal < 0 OR contains({FILTER_TEXT_SQL}, 'widget') OR contains({FILTER_TEXT_SQL}, 'gear'))"""


@register("company_filter", f"""
SELECT p.id, p.company, p.title, p.location FROM {POSTINGS_LI_SQL} p JOIN supplier s ON s.s_name = p.company
WHERE {COMPANY_FILTER_SQL}
""")
def q_company_filter(spark, sf_dir):
    p = standins.postings_li(spark, sf_dir)
    kept = filters.company_filter(p, companies_from_supplier(spark, sf_dir))
    return kept.select("id", "company", "title", "location")


# -- P02 F22 -------------------------------------------------------------------
@register("time_filter", """
SELECT event_id, user_id, event_type FROM events
WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY
""")
def q_time_filter(spark, sf_dir):
    e = events_postings(spark, sf_dir)
    return filters.time_filter(e, EVENTS_AS_OF, "7d").select("event_id", "user_id", "event_type")


# -- F18 -----------------------------------------------------------------------
@register("freshness", """
SELECT CASE WHEN ts IS NULL THEN '❓ Unknown'
  WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) < 86400000000 THEN '🔥 New (today)'
  WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) < 3 * 86400000000 THEN '✨ Fresh (< 3 days)'
  WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) < 7 * 86400000000 THEN '📅 This week'
  WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) < 30 * 86400000000 THEN '📆 This month'
  ELSE '📦 Older' END AS freshness, count(*)::BIGINT AS n
FROM events GROUP BY 1
""")
def q_freshness(spark, sf_dir):
    e = events_postings(spark, sf_dir)
    return e.groupBy(freshness_label("posted_at", EVENTS_AS_OF).alias("freshness")) \
        .agg(F.count(F.lit(1)).alias("n"))


# -- F01 F02 -------------------------------------------------------------------
@register("posting_text", f"""
SELECT id, title || ' ' || department AS searchable_text FROM {POSTINGS_LI_SQL} p
""")
def q_posting_text(spark, sf_dir):
    p = standins.postings_li(spark, sf_dir)
    return p.select("id", searchable_text().alias("searchable_text"))


# -- W01 -----------------------------------------------------------------------
_EXACT_SQL = f"""
  (SELECT * EXCLUDE (rn) FROM (
     SELECT *, row_number() OVER (PARTITION BY company, source_system, source_job_id
                                  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
     FROM {POSTINGS_LI_SQL} p) WHERE rn = 1)
"""


@register("exact_dedup", f"""
SELECT id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {_EXACT_SQL} d
""")
def q_exact_dedup(spark, sf_dir):
    p = standins.postings_li(spark, sf_dir)
    d = dedup.exact_dedup(p, "seq")
    return d.select("id", "seq.l_orderkey", "seq.l_linenumber", "seq.l_partkey", "seq.l_suppkey")


# -- A02 -----------------------------------------------------------------------
@register("new_by_company", f"""
SELECT s_name AS company, coalesce(n.new_jobs, 0)::BIGINT AS new_jobs FROM supplier
LEFT JOIN (SELECT company, count(*) AS new_jobs FROM {_EXACT_SQL} d
           WHERE posted_at >= TIMESTAMP '{SPLIT_DATE}' GROUP BY company) n ON n.company = s_name
""")
def q_new_by_company(spark, sf_dir):
    p = dedup.exact_dedup(standins.postings_li(spark, sf_dir), "seq")
    new = p.filter(F.col("posted_at") >= F.lit(SPLIT_DATE).cast("timestamp"))
    comps = read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return reports.new_by_company(new, comps)


# -- J02 U03 -------------------------------------------------------------------
@register("known_anti", f"""
SELECT DISTINCT id FROM {POSTINGS_LI_SQL} p WHERE posted_at >= TIMESTAMP '{SPLIT_DATE}'
  AND id NOT IN (SELECT id FROM {POSTINGS_LI_SQL} q WHERE posted_at < TIMESTAMP '{SPLIT_DATE}')
""")
def q_known_anti(spark, sf_dir):
    p = standins.postings_li(spark, sf_dir)
    cut = F.lit(SPLIT_DATE).cast("timestamp")
    known = p.filter(F.col("posted_at") < cut)
    new = p.filter(F.col("posted_at") >= cut)
    return filters.drop_known(new, known, key="id").select("id").distinct()


# -- J03 A07 -------------------------------------------------------------------
@register("seen_anti", f"""
SELECT company, count(*)::BIGINT AS unseen FROM {POSTINGS_LI_SQL} p
WHERE posted_at >= TIMESTAMP '{SPLIT_DATE}' AND source_job_id NOT IN
  (SELECT DISTINCT source_job_id FROM {POSTINGS_LI_SQL} q WHERE posted_at < TIMESTAMP '{SPLIT_DATE}')
GROUP BY company
""")
def q_seen_anti(spark, sf_dir):
    p = standins.postings_li(spark, sf_dir)
    cut = F.lit(SPLIT_DATE).cast("timestamp")
    seen = p.filter(F.col("posted_at") < cut).select("source_job_id").distinct()     # A07
    new = p.filter(F.col("posted_at") >= cut)
    return filters.drop_known(new, seen, key="source_job_id").groupBy("company") \
        .agg(F.count(F.lit(1)).alias("unseen"))


# -- P06 T02 J01 -----------------------------------------------------------------
@register("unnotified_topk", """
SELECT o_orderkey AS job_id, c_name AS company, round(o_totalprice / 1000000.0e0, 6) AS score
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1998-01-01'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def q_unnotified_topk(spark, sf_dir):
    jobs = standins.stored_jobs(spark, sf_dir).withColumnRenamed("job_id", "id")
    comps = standins.stored_companies(spark, sf_dir)
    top = unseen_top(jobs, comps, 100, since=dt.datetime(1998, 1, 1))
    return top.select(F.col("id").alias("job_id"), "company", F.round("score", 6).alias("score"))


@register("company_left_join", """
SELECT c_mktsegment AS segment, count(*)::BIGINT AS jobs, count(o_orderkey)::BIGINT AS with_job
FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1
""")
def q_company_left_join(spark, sf_dir):
    jobs = standins.stored_jobs(spark, sf_dir)
    comps = standins.stored_companies(spark, sf_dir)
    j = jobs.join(filters.maybe_broadcast(comps), "company_id", "left")
    return j.groupBy("segment").agg(F.count(F.lit(1)).alias("jobs"), F.count("job_id").alias("with_job"))


# -- P05 -----------------------------------------------------------------------
@register("company_selection", """
WITH c AS (SELECT c_name AS name, c_mktsegment AS seg,
   [('https://' || lower(c_mktsegment) || '.example.com/careers'),
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'https://boards.greenhouse.io/' || c_custkey
         WHEN c_mktsegment = 'AUTOMOBILE' THEN 'https://jobs.lever.co/' || c_custkey
         ELSE 'https://example.org/' || c_custkey END] AS urls,
   CASE WHEN c_acctbal < 0 THEN 'workday' END AS ats
   FROM customer)
SELECT name, coalesce(ats, CASE WHEN contains(urls[2], 'boards.greenhouse.io') THEN 'greenhouse'
                               WHEN contains(urls[2], 'jobs.lever.co') THEN 'lever' END) AS resolved_ats
FROM c WHERE coalesce(ats, CASE WHEN contains(urls[2], 'boards.greenhouse.io') THEN 'greenhouse'
                               WHEN contains(urls[2], 'jobs.lever.co') THEN 'lever' END) IS NOT NULL
""")
def q_company_selection(spark, sf_dir):
    """Company configs derived from customers: a generic careers URL first, then a
    board URL by market segment; a configured system for negative balances."""
    c = read_table(spark, sf_dir, "customer")
    board = (F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("https://boards.greenhouse.io/"), F.col("c_custkey")))
             .when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("https://jobs.lever.co/"), F.col("c_custkey")))
             .otherwise(F.concat(F.lit("https://example.org/"), F.col("c_custkey"))))
    cfg = c.select(F.col("c_name").alias("name"),
                   F.array(F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.com/careers")),
                           board).alias("career_urls"),
                   F.when(F.col("c_acctbal") < 0, F.lit("workday")).alias("ats_type"),
                   F.lit(True).alias("enabled"))
    return filters.select_companies(cfg).select("name", "resolved_ats")


# -- U01 U02 -------------------------------------------------------------------
@register("union_sources", f"""
SELECT id, title, 'lineitem' AS source FROM {POSTINGS_LI_SQL} p
UNION ALL SELECT NULL, event_type, 'events' FROM events
""")
def q_union_sources(spark, sf_dir):
    a = standins.postings_li(spark, sf_dir).select("id", "title", F.lit("lineitem").alias("source"))
    b = events_postings(spark, sf_dir).select(F.col("event_type").alias("title"), F.lit("events").alias("source"))
    return filters.union_postings([a, b]).select("id", "title", "source")

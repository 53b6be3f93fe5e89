"""Registered batch scan (M05 = P01 P02 J02 W01 A05 W02 over the stand-in postings)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..store.changelog import ChangeLog
from . import standins
from .q_relational import COMPANY_FILTER_SQL, companies_from_supplier
from .registry import AS_OF, register
from .scan import scan, scan_and_store
from .sqlfrag import fold_ctes, norm, simhash_ctes
from .standins import POSTINGS_LI_SQL

SCAN_LOOKBACK = "1000d"
STORED_BEFORE = "2000-01-01"
SCAN_LIMIT = 25
_CUTOFF = (AS_OF - dt.timedelta(days=1000)).strftime("%Y-%m-%d %H:%M:%S")
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


_SCAN_SQL = f"""
WITH RECURSIVE p AS (SELECT p.* FROM {POSTINGS_LI_SQL} p JOIN supplier s ON s.s_name = p.company
  WHERE {COMPANY_FILTER_SQL}
    AND (p.posted_at IS NULL OR p.posted_at >= TIMESTAMP '{_CUTOFF}')
    AND p.id NOT IN (SELECT id FROM {POSTINGS_LI_SQL} q WHERE q.posted_at < TIMESTAMP '{STORED_BEFORE}')),
  ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, source_system, source_job_id
                                                     ORDER BY {_ORDER}) AS rn0 FROM p) WHERE rn0 = 1),
  tx AS (SELECT *, title || ' ' || department AS text FROM ex),
  {simhash_ctes('tx', 'id', 'text')},
  j AS (SELECT ex.*, s_fp.fp FROM ex JOIN s_fp USING (id)),
  {fold_ctes('j', f"{norm('title')} || ':' || {norm('location')}", _ORDER)},
  kept AS (SELECT ex.id, ex.company, ex.title, ex.location, ex.posted_at FROM ex JOIN r USING (id) WHERE r.admitted)
"""


@register("scan_pipeline", _SCAN_SQL + "SELECT id, company, title, location FROM kept")
def q_scan_pipeline(spark, sf_dir):
    p = standins.postings_li(spark, sf_dir)
    stored = p.filter(F.col("posted_at") < F.lit(STORED_BEFORE).cast("timestamp")).select("id")
    kept, _ = scan(p, companies_from_supplier(spark, sf_dir), AS_OF, SCAN_LOOKBACK, stored)
    return kept.select("id", "company", "title", "location")


@register("scan_store", _SCAN_SQL + f"""
, old AS (SELECT DISTINCT id, company FROM {POSTINGS_LI_SQL} q WHERE posted_at < TIMESTAMP '{STORED_BEFORE}'),
  n AS (SELECT count(*)::BIGINT AS found FROM kept),
  c AS (SELECT count(DISTINCT company)::BIGINT AS companies FROM (SELECT company FROM kept UNION ALL SELECT company FROM old))
SELECT id, company, title, location, TIMESTAMP '2001-11-05' AS first_seen_at, 'completed' AS status, n.found AS jobs_found, n.found AS jobs_new, c.companies
FROM kept, n, c
UNION ALL SELECT old.id, old.company, NULL, NULL, TIMESTAMP '2000-01-01', 'completed', n.found, n.found, c.companies FROM old, n, c
""")
def q_scan_store(spark, sf_dir):
    """A scan over a store that holds jobs, saved and logged; the whole store after it."""
    store = ChangeLog(spark, scratch_path(spark, f"scan-{uuid.uuid4().hex}"))
    p = standins.postings_li(spark, sf_dir)
    store.save(p.filter(F.col("posted_at") < F.lit(STORED_BEFORE).cast("timestamp")), dt.datetime(2000, 1, 1), order_col="seq")
    scan_and_store(store, 1, p, companies_from_supplier(spark, sf_dir), AS_OF, SCAN_LOOKBACK)
    run = store.runs().first()
    is_new = F.col("first_seen_at") == F.lit(AS_OF).cast("timestamp")
    return store.jobs(columns=("id", "company", "title", "location", "first_seen_at")).select(
        "id", "company", F.when(is_new, F.col("title")).alias("title"), F.when(is_new, F.col("location")).alias("location"), "first_seen_at",
        F.lit(run["status"]).alias("status"), F.lit(run["jobs_found"]).alias("jobs_found"), F.lit(run["jobs_new"]).alias("jobs_new"),
        F.lit(store.companies().count()).alias("companies"))


@register("scan_limit", _SCAN_SQL + f"""
SELECT kept.id, company, title FROM kept JOIN (SELECT id, min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS o FROM ex GROUP BY id) USING (id)
ORDER BY o LIMIT {SCAN_LIMIT}
""")
def q_scan_limit(spark, sf_dir):
    """The first kept postings in arrival order."""
    p = standins.postings_li(spark, sf_dir)
    stored = p.filter(F.col("posted_at") < F.lit(STORED_BEFORE).cast("timestamp")).select("id")
    kept, _ = scan(p, companies_from_supplier(spark, sf_dir), AS_OF, SCAN_LOOKBACK, stored, max_results=SCAN_LIMIT)
    return kept.select("id", "company", "title")

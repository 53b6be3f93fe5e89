"""Query registry and the parameters/SQL shared by the registered query modules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from . import standins

# Fixed parameters of the registered queries (chosen against the driver's data).
AS_OF = dt.datetime(2001, 11, 5)
SAMPLE_PROFILE = scoring.Profile(
    profile="sample",
    desired_roles=["red widget", "hot gear"],
    must_have_keywords=["widget", "PROMO"],
    must_not_keywords=["blue"],
    preferred_locations=["NATION_1"],
    remote_preference="remote",
)
TOP_K = 100

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# Scoring (J04 G01 G02 G03 G04 P03 P04 T01)
# ---------------------------------------------------------------------------
SCORE_COLS = ["id", "company", "title", "location", "final_score", "vector_score",
              "keyword_score", "recency_score", "reasons"]


def _scored(spark, sf_dir):
    p = standins.postings_li(spark, sf_dir)
    return scoring.score(p, [SAMPLE_PROFILE], AS_OF)


def _score_out(df):
    return df.select("id", "company", "title", "location",
                     r6(F.col("final_score")).alias("final_score"),
                     r6(F.col("vector_score")).alias("vector_score"),
                     r6(F.col("keyword_score")).alias("keyword_score"),
                     r6(F.col("recency_score")).alias("recency_score"),
                     F.array_join("match_reasons", "; ").alias("reasons"))


_SCORED_SQL = f"""
WITH p AS {standins.POSTINGS_LI_SQL},
t AS (SELECT *, title || ' ' || department AS text FROM p),
k AS (
  SELECT *,
    regexp_matches(text, '(?i)\\bblue\\b') AS excluded,
    CASE WHEN regexp_matches(title, '(?i)\\bred widget\\b') THEN 'red widget'
         WHEN regexp_matches(title, '(?i)\\bhot gear\\b') THEN 'hot gear' END AS role,
    regexp_matches(text, '(?i)\\bwidget\\b') AS m1,
    regexp_matches(text, '(?i)\\bPROMO\\b') AS m2,
    (location IS NOT NULL AND location <> '' AND contains(lower(location), 'nation_1')) AS loc_ok,
    coalesce(remote_type = 'remote', false) AS rem_ok,
    (epoch_us(TIMESTAMP '2001-11-05 00:00:00') - epoch_us(posted_at)) / 86400e6 AS age_days
  FROM t),
s AS (
  SELECT *,
    least(0.0e0 + (CASE WHEN role IS NOT NULL THEN 0.4e0 ELSE 0.0e0 END)
          + (CAST(m1::INT + m2::INT AS DOUBLE) / 2.0e0 * 0.4e0)
          + (CASE WHEN loc_ok THEN 0.1e0 ELSE 0.0e0 END)
          + (CASE WHEN rem_ok THEN 0.1e0 ELSE 0.0e0 END), 1.0e0) AS kw,
    CASE WHEN posted_at IS NULL THEN 0.5e0 WHEN age_days <= 0 THEN 1.0e0
         WHEN age_days >= 30 THEN 0.0e0 ELSE 1.0e0 - sqrt(age_days / 30.0e0) END AS rec
  FROM k),
f AS (
  SELECT id, company, title, location, excluded, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN excluded THEN 0.0e0 ELSE 0.55e0 * 0.5e0 + 0.3e0 * kw + 0.15e0 * rec END AS final_score,
    CASE WHEN excluded THEN 0.0e0 ELSE 0.5e0 END AS vector_score,
    CASE WHEN excluded THEN 0.0e0 ELSE kw END AS keyword_score,
    CASE WHEN excluded THEN 0.0e0 ELSE rec END AS recency_score,
    CASE WHEN excluded THEN 'Excluded: contains ''blue'''
         ELSE concat_ws('; ',
           CASE WHEN role IS NOT NULL THEN 'Role match: ' || role END,
           CASE WHEN m1 THEN 'Keyword: widget' END,
           CASE WHEN m2 THEN 'Keyword: PROMO' END,
           CASE WHEN loc_ok THEN 'Location: NATION_1' END,
           CASE WHEN rem_ok THEN 'Remote: remote' END,
           CASE WHEN rec > 0.7e0 THEN 'Recently posted' END) END AS reasons
  FROM s)
"""

_SCORE_SELECT = """SELECT id, company, title, location, round(final_score, 6) AS final_score,
  round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score,
  round(recency_score, 6) AS recency_score, reasons FROM f"""

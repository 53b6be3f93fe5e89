"""Registered scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from ..session import read_table
from . import standins
from .registry import AS_OF, TOP_K, _SCORED_SQL, _SCORE_SELECT, _score_out, _scored, register


@register("score_batch", _SCORED_SQL + _SCORE_SELECT + " WHERE final_score >= 0.3")
def q_score_batch(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return _score_out(s.filter(F.col("final_score") >= F.col("min_score_threshold")))


@register("score_top", _SCORED_SQL + _SCORE_SELECT +
          f" WHERE final_score >= 0.3 ORDER BY final_score DESC, id LIMIT {TOP_K}")
def q_score_top(spark, sf_dir):
    s = _scored(spark, sf_dir)
    kept = s.filter(F.col("final_score") >= F.col("min_score_threshold"))
    return _score_out(kept.orderBy(F.desc("final_score"), "id").limit(TOP_K))


@register("score_exclusions", _SCORED_SQL +
          "SELECT count(*)::BIGINT AS n_excluded, count(DISTINCT company)::BIGINT AS n_companies "
          "FROM f WHERE excluded")
def q_score_exclusions(spark, sf_dir):
    s = _scored(spark, sf_dir).filter("excluded")
    return s.agg(F.count(F.lit(1)).alias("n_excluded"),
                 F.countDistinct("company").alias("n_companies"))


@register("match_class", _SCORED_SQL +
          "SELECT CASE WHEN final_score >= 0.3 THEN 'match' WHEN final_score > 0 THEN 'partial' "
          "ELSE 'none' END AS match_class, count(*)::BIGINT AS n FROM f GROUP BY 1")
def q_match_class(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.groupBy(scoring.match_class("final_score", 0.3).alias("match_class")) \
        .agg(F.count(F.lit(1)).alias("n"))


# -- many profiles in one scan: one per part name -----------------------------------
def profiles_from_part(spark, sf_dir):
    """A profile per part name: the name is the desired role, its smallest type a must-have
    keyword; names that begin with b have no keyword list at all (null)."""
    part = read_table(spark, sf_dir, "part").where("p_name is not null")
    q = part.groupBy(F.col("p_name").alias("profile")).agg(F.min("p_type").alias("kw"))
    return q.select("profile", F.array("profile").alias("desired_roles"),
                    F.when(~F.col("profile").like("b%"), F.array("kw")).alias("must_have_keywords"),
                    F.lit("remote").alias("remote_preference"))


@register("score_many_profiles", f"""
WITH p AS (SELECT *, title || ' ' || department AS text FROM {standins.POSTINGS_LI_SQL}),
q AS (SELECT p_name AS profile, CASE WHEN p_name LIKE 'b%' THEN NULL ELSE min(p_type) END AS kw
      FROM part WHERE p_name IS NOT NULL GROUP BY p_name),
d AS (SELECT DISTINCT title, department, text FROM p),
h AS (SELECT d.title, d.department, q.profile,
    regexp_matches(title, '(?i)\\b' || q.profile || '\\b') AS role,
    regexp_matches(text, '(?i)\\b' || q.kw || '\\b') AS m, q.kw IS NOT NULL AS has_kw FROM d, q),
s AS (
  SELECT h.profile, p.id, role, m, has_kw, coalesce(remote_type = 'remote', false) AS rem_ok,
    (epoch_us(TIMESTAMP '2001-11-05 00:00:00') - epoch_us(posted_at)) / 86400e6 AS age_days, posted_at
  FROM p JOIN h ON h.title = p.title AND h.department IS NOT DISTINCT FROM p.department),
k AS (
  SELECT *, least((CASE WHEN role THEN 0.4e0 ELSE 0.0e0 END)
      + (CASE WHEN NOT has_kw THEN 0.2e0 WHEN m THEN 0.4e0 ELSE 0.0e0 END)
      + (CASE WHEN rem_ok THEN 0.1e0 ELSE 0.0e0 END), 1.0e0) AS kw_score,
    CASE WHEN posted_at IS NULL THEN 0.5e0 WHEN age_days <= 0 THEN 1.0e0
         WHEN age_days >= 30 THEN 0.0e0 ELSE 1.0e0 - sqrt(age_days / 30.0e0) END AS rec
  FROM s)
SELECT profile, id, round(0.55e0 * 0.5e0 + 0.3e0 * kw_score + 0.15e0 * rec, 6) AS final_score FROM k
WHERE 0.55e0 * 0.5e0 + 0.3e0 * kw_score + 0.15e0 * rec >= 0.6
""")
def q_score_many_profiles(spark, sf_dir):
    scored = scoring.score(standins.postings_li(spark, sf_dir), profiles_from_part(spark, sf_dir), AS_OF, min_score=0.6)
    return scored.select("profile", "id", F.round("final_score", 6).alias("final_score"))

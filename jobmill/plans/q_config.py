"""Registered queries of configuration and stored tables (S10-S12, K07, F05, F11, F25, T05, V04 with
V05): files and stored rows are written from the driver's tables, read back by the readers, and
compared with what the tables say."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions.classify import board_slug, workday_info
from ..functions.timeutil import freshness_label, from_epoch_millis, parse_iso
from ..operators import profiles, reports, vectors
from ..session import read_table, scratch_path
from ..sources import ats
from ..sources import html as html_src
from ..store.changelog import ChangeLog
from . import standins
from .q_scoring import profiles_from_part
from .q_sources import _PARTS_SQL, SCRAPED_AT, _pages, _parts
from .q_vectors import _CENTROID_SQL, PROFILE_LABEL, label_centroids
from .registry import AS_OF, SAMPLE_PROFILE, register, r6


def _folder(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# -- F05: board tokens and Workday sites -------------------------------------------------
BOARD_SYSTEMS = ["greenhouse", "lever", "ashby", "smartrecruiters"]


@register("board_slugs", """
SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'tok' || c_custkey END AS greenhouse, CASE WHEN c_custkey % 5 = 1 THEN 'tok' || c_custkey END AS lever,
  CASE WHEN c_custkey % 5 = 2 THEN 'tok' || c_custkey END AS ashby, CASE WHEN c_custkey % 5 = 3 THEN 'tok' || c_custkey END AS smartrecruiters,
  CASE WHEN c_custkey % 5 = 4 THEN 'co' || c_custkey END AS company,
  CASE WHEN c_custkey % 5 = 4 THEN 'https://co' || c_custkey || '.wd5.myworkdayjobs.com/wday/cxs/co' || c_custkey END AS api_base
FROM customer
""")
def q_board_slugs(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    part = F.col("c_custkey") % 5
    url = (F.when(part == 0, F.concat(F.lit("https://boards.greenhouse.io/tok"), key, F.lit("/jobs/1")))
           .when(part == 1, F.concat(F.lit("https://jobs.lever.co/tok"), key, F.lit("?team=x")))
           .when(part == 2, F.concat(F.lit("https://jobs.ashbyhq.com/tok"), key))
           .when(part == 3, F.concat(F.lit("https://jobs.smartrecruiters.com/tok"), key, F.lit("/9")))
           .otherwise(F.concat(F.lit("https://co"), key, F.lit(".wd5.myworkdayjobs.com/careers"))))
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), url.alias("u"))
    info = workday_info(F.col("u"))
    return rows.select("key", *[board_slug(F.col("u"), s).alias(s) for s in BOARD_SYSTEMS], info["company"].alias("company"), info["api_base"].alias("api_base"))


# -- F11 F18: timestamps in the forms that boards use -----------------------------------------
@register("timestamps", """
SELECT event_id, date_trunc('second', ts) AS from_iso, date_trunc('second', ts) - INTERVAL 2 HOUR AS from_offset, date_trunc('millisecond', ts) AS from_millis,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) AS from_date, CAST(NULL AS TIMESTAMP) AS from_junk,
  CASE WHEN d < 1 THEN '🔥 New (today)' WHEN d < 3 THEN '✨ Fresh (< 3 days)' WHEN d < 7 THEN '📅 This week' WHEN d < 30 THEN '📆 This month' ELSE '📦 Older' END AS freshness
FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-31') / 86400e6 - epoch_us(date_trunc('second', ts)) / 86400e6 AS d FROM events)
""")
def q_timestamps(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    e = read_table(spark, sf_dir, "events").select(
        "event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("offset"),
        F.unix_millis(ts).cast("string").alias("millis"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "dd MMM, yyyy").alias("junk"))
    return e.select("event_id", parse_iso("iso").alias("from_iso"), parse_iso("offset").alias("from_offset"), from_epoch_millis("millis").alias("from_millis"),
                    parse_iso("day").alias("from_date"), parse_iso("junk").alias("from_junk"),
                    freshness_label(parse_iso("iso"), dt.datetime(2024, 1, 31)).alias("freshness"))


# -- S10: stored rows as postings ------------------------------------------------------------
@register("stored_postings", f"""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
                         FROM {standins.POSTINGS_LI_SQL} p WHERE posted_at >= TIMESTAMP '2001-01-01') WHERE rn = 1)
SELECT id, CASE WHEN company LIKE '%7' THEN 'Unknown' ELSE company END AS company, title, source_system,
  CASE WHEN remote_type = 'onsite' THEN 'unknown' ELSE remote_type END AS remote_type, employment_type, location, posted_at, 0 AS n_requirements FROM f
""")
def q_stored_postings(spark, sf_dir):
    """A store whose companies table misses some and whose rows miss an enum value."""
    store = ChangeLog(spark, _folder(spark, "stored"))
    p = standins.postings_li(spark, sf_dir).where(F.col("posted_at") >= F.lit("2001-01-01").cast("timestamp"))
    store.save(p.withColumn("remote_type", F.nullif("remote_type", F.lit("onsite"))), AS_OF, order_col="seq")
    out = ats.read_stored_postings(store.jobs(), store.companies().where("name not like '%7'"))
    return out.select("id", "company", "title", "source_system", "remote_type", "employment_type", "location", "posted_at",
                      F.size("requirements").alias("n_requirements"))


# -- S11: company and profile files -----------------------------------------------------------
@register("company_files", """
SELECT s_name AS name, 'https://careers.example.com/' || s_suppkey AS career_url, s_suppkey % 3 <> 0 AS enabled, NULL AS country,
  CASE WHEN s_suppkey % 2 = 0 THEN 'senior,staff' ELSE '' END AS deny FROM supplier WHERE s_suppkey % 10 <> 9
""")
def q_company_files(spark, sf_dir):
    """One JSON object per line; a line in ten is broken and skipped."""
    s = read_table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    row = F.struct(F.col("s_name").alias("name"), F.array(F.concat(F.lit("https://careers.example.com/"), key.cast("string"))).alias("career_urls"),
                   (key % 3 != 0).alias("enabled"), F.when(key % 2 == 0, F.array(F.lit("senior"), F.lit("staff"))).alias("deny_filters"), F.lit("y").alias("other"))
    path = _folder(spark, "companies")
    s.select(F.when(key % 10 == 9, F.concat(F.lit('{"name": "'), "s_name")).otherwise(F.to_json(row)).alias("value")).write.text(path)
    return ats.read_companies(spark, path).select("name", F.col("career_urls")[0].alias("career_url"), "enabled", "country",
                                                  F.coalesce(F.array_join("deny_filters", ","), F.lit("")).alias("deny"))


@register("profile_files", """
WITH q AS (SELECT p_name AS profile, min(p_type) AS kw FROM part WHERE p_name IS NOT NULL GROUP BY p_name)
SELECT profile, profile || CASE WHEN profile LIKE 'b%' THEN '' ELSE ' ' || kw END AS plain,
  'Looking for roles like: ' || profile || CASE WHEN profile LIKE 'b%' THEN '' ELSE ' Required skills: ' || kw END || ' Work style: remote' AS labelled FROM q
""")
def q_profile_files(spark, sf_dir):
    """Profiles written as JSON lines, read back, and told as text in both forms."""
    path = _folder(spark, "profiles")
    profiles_from_part(spark, sf_dir).write.json(path)
    p = ats.read_profiles(spark, path)
    return p.select("profile", vectors.profile_texts(labelled=False).alias("plain"), vectors.profile_texts(labelled=True).alias("labelled"))


# -- S12 R04 K07: resumes, generated profiles and their report -----------------------------------
@register("resume_profiles", f"""
WITH {_PARTS_SQL},
t AS (SELECT s_name, string_agg(CASE p_size % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'SQL' WHEN 2 THEN 'Docker' ELSE 'nothing' END, chr(10)) AS x FROM b GROUP BY s_name),
r AS (SELECT s_name AS profile, concat_ws('|', CASE WHEN contains(x, 'Python') THEN 'python' END, CASE WHEN contains(x, 'SQL') THEN 'sql' END, CASE WHEN contains(x, 'Docker') THEN 'docker' END) AS k FROM t)
SELECT profile, array_to_string(list_sort(string_split(k, '|')), '|') AS must_have_keywords, 0.25e0 AS min_score_threshold, (SELECT count(*) FROM r)::BIGINT AS profiles FROM r
""")
def q_resume_profiles(spark, sf_dir):
    """One resume file per supplier; the generated profiles go out as JSON and are read again."""
    skill = F.element_at(F.array(*map(F.lit, ("Python", "SQL", "Docker", "nothing"))), (F.col("p_size") % 4 + 1).cast("int"))
    texts = _parts(spark, sf_dir).groupBy("s_name").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", F.lit("I know"), skill))), "\n").alias("value"))
    path, out = _folder(spark, "resumes"), _folder(spark, "generated")
    texts.write.partitionBy("s_name").text(path)
    resumes = ats.read_resumes(spark, path)
    named = resumes.select("text", F.regexp_replace(F.regexp_extract("path", "s_name=([^/]+)/", 1), "%(25)?23", "#").alias("name"))
    made = profiles.profile_from_text(named, "text", "name")
    reports.write_json_report(made, out, "profiles")
    total = spark.read.json(f"{out}/summary").first()["profiles"]
    rows = spark.read.schema(made.schema).json(f"{out}/rows")
    return rows.select("profile", F.array_join(F.sort_array("must_have_keywords"), "|").alias("must_have_keywords"), "min_score_threshold",
                       F.lit(total).alias("profiles"))


# -- T05: the first cards of a search page -------------------------------------------------------
PER_PAGE = 5


@register("search_card_cap", f"""
WITH {_PARTS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY p_partkey) AS rn FROM b)
SELECT s_suppkey AS page_id, 'jk' || p_partkey AS source_job_id FROM c WHERE rn <= {PER_PAGE}
""")
def q_search_card_cap(spark, sf_dir):
    item = F.concat(F.lit('<div data-jk="jk'), F.col("p_partkey").cast("string"), F.lit('"><h2 class="jobTitle"><span>'), "title",
                    F.lit('</span></h2><span class="companyName">'), "p_brand", F.lit('</span><div class="companyLocation">'), "n_name", F.lit("</div></div>"))
    return html_src.search_cards(_pages(_parts(spark, sf_dir), item), SCRAPED_AT, per_page=PER_PAGE).select("page_id", "source_job_id")


# -- V04 with V05: matches by vector, with what speaks for them --------------------------------
@register("vector_match_highlights", f"""
WITH {_CENTROID_SQL}
SELECT s.vec_id AS id, round(s.similarity, 6) AS similarity, row_number() OVER (ORDER BY s.similarity DESC, s.vec_id) AS rank,
  array_to_string(list_filter([CASE WHEN contains(lower(p_name), 'widget') THEN 'Contains: widget' END, CASE WHEN contains(lower(p_name), 'promo') THEN 'Contains: PROMO' END,
    CASE WHEN contains(lower(p_name), 'red widget') THEN 'Role match: red widget' WHEN contains(lower(p_name), 'hot gear') THEN 'Role match: hot gear' END,
    CASE WHEN p_size % 2 = 0 THEN 'Remote: remote' END], lambda x: x IS NOT NULL)[1:2], '; ') AS highlights
FROM sims s JOIN part ON p_partkey = s.vec_id WHERE s.label = {PROFILE_LABEL} AND s.similarity >= 0.5e0
""")
def q_vector_match_highlights(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    post = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("description_text"), F.lit(None).cast("string").alias("location"),
        F.when(F.col("p_size") % 2 == 0, "remote").otherwise("onsite").alias("remote_type"))
    query = label_centroids(spark, sf_dir).filter(F.col("label") == PROFILE_LABEL).select(F.lit("sample").alias("profile"), "query_vec")
    m = vectors.vector_match_highlights(post.join(emb, "id"), query, SAMPLE_PROFILE, most=2, min_similarity=0.5, posting_key="id")
    return m.select("id", r6(F.col("similarity")).alias("similarity"), F.col("rank").cast("bigint").alias("rank"),
                    F.array_join("profile_highlights", "; ").alias("highlights"))

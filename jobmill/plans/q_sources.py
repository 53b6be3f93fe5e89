"""Registered source queries (S01-S07, S09, U02, W05, X01, K02): payloads and pages are rendered
from the driver's tables in the shapes that the readers expect, landed in the scratch folder,
read back, and compared with what the tables say.

A supplier is a company with one board (or page); its jobs are the parts whose key it serves
(about 20 at any scale factor)."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup
from ..session import path_exists, read_table, scratch_path
from ..sources import html as html_src
from ..sources import plug
from ..store import jobs as store
from . import standins
from .registry import AS_OF, register

SCRAPED_AT = dt.datetime(2024, 2, 1)
SYSTEMS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workday"]
WORKDAY = {"api_base": "https://w.example.com/wday/cxs/acme", "site": "careers"}
LEVER_TERMS = ["", "Full-time", "Part-time", "Contract"]
SMART_TERMS = ["permanent", "intern", "contractor", "part_time"]


def _parts(spark, sf_dir) -> DataFrame:
    """One row per (supplier, part that it serves), with a title that names some working terms."""
    part, sup = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "supplier")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")       # 25 rows, fixed by the schema
    n = (sup.agg(F.max("s_suppkey")).first()[0] or 0) + 1
    size = F.col("p_size")
    title = F.concat("p_name", F.when(size % 11 == 0, " (Remote)").when(size % 13 == 0, " Hybrid Intern")
                     .when(size % 17 == 0, " Contract onsite").otherwise(""))
    return (part.withColumn("s_suppkey", F.col("p_partkey") % n).join(sup, "s_suppkey")
            .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .select("s_suppkey", "s_name", "n_name", "p_partkey", title.alias("title"), "p_type", "p_brand", "p_size",
                    F.concat(F.lit("2024-01-"), F.lpad((size % 28 + 1).cast("string"), 2, "0")).alias("day")))


_PARTS_SQL = """
b AS (SELECT s_suppkey, s_name, n_name, p_partkey, p_type, p_brand, p_size,
        p_name || CASE WHEN p_size % 11 = 0 THEN ' (Remote)' WHEN p_size % 13 = 0 THEN ' Hybrid Intern'
                       WHEN p_size % 17 = 0 THEN ' Contract onsite' ELSE '' END AS title,
        '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS day
      FROM part JOIN supplier ON p_partkey % (SELECT max(s_suppkey) + 1 FROM supplier) = s_suppkey
      JOIN nation ON s_nationkey = n_nationkey)"""


# -- S01-S05: board payloads ------------------------------------------------------------
def _payloads(parts: DataFrame) -> DataFrame:
    """(system, company, board, value): one payload per supplier, its system by its key."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    extra = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("extra")
    at = F.concat("day", F.lit("T00:00:00Z"))
    lever_url = F.concat(F.lit("https://jobs.lever.co/x/"), key)
    term = lambda names: F.element_at(F.array(*map(F.lit, names)), (size % 4 + 1).cast("int"))
    job = {
        "greenhouse": F.struct(F.col("p_partkey").alias("id"), "title", at.alias("updated_at"),
                               F.when(size % 7 != 0, F.concat(F.lit("https://boards.example.com/"), key)).alias("absolute_url"),
                               F.struct(F.col("n_name").alias("name")).alias("location"),
                               F.array(F.struct(F.lit(1).alias("id"), F.col("p_type").alias("name"))).alias("departments"), extra),
        "lever": F.struct(F.concat(F.lit("L"), key).alias("id"), F.col("title").alias("text"),
                          (F.unix_timestamp(F.to_timestamp("day")) * 1000).alias("createdAt"), lever_url.alias("hostedUrl"),
                          F.when(size % 3 == 0, F.concat(lever_url, F.lit("/apply"))).alias("applyUrl"),
                          F.struct(F.col("n_name").alias("location"), F.col("p_type").alias("department"), F.col("p_brand").alias("team"),
                                   term(LEVER_TERMS).alias("commitment")).alias("categories"), extra),
        "ashby": F.struct(F.concat(F.lit("A"), key).alias("id"), "title",
                          F.concat(F.when(size % 9 == 0, "Hybrid ").otherwise(""), "n_name").alias("locationName"),
                          term(LEVER_TERMS).alias("employmentType"), F.col("day").alias("publishedDate"), (size % 5 == 0).alias("isRemote"), extra),
        "smartrecruiters": F.struct(F.when(size % 6 == 0, "").otherwise(F.concat(F.lit("S"), key)).alias("id"),
                                    F.concat(F.lit("R"), key).alias("refNumber"), F.col("title").alias("name"),
                                    F.struct(F.col("n_name").alias("city"), F.lit("").alias("region"), F.lit("xx").alias("country")).alias("location"),
                                    F.struct(F.lit("d").alias("id"), F.col("p_type").alias("label")).alias("department"),
                                    at.alias("releasedDate"), (size % 5 == 0).alias("remote"),
                                    F.struct(term(SMART_TERMS).alias("id")).alias("typeOfEmployment"),
                                    F.when(size % 7 != 0, F.concat(F.lit("https://smart.example.com/"), key)).alias("applyUrl"), extra),
        "workday": F.struct(F.concat(F.lit("/job/"), "n_name", F.lit("/W"), key).alias("externalPath"), "title",
                            F.col("n_name").alias("locationsText"), F.col("day").alias("postedOn"),
                            F.array("p_brand", term(LEVER_TERMS)).alias("bulletFields"), extra),
    }
    nest = {
        "greenhouse": lambda jobs: F.struct(jobs.alias("jobs"), F.lit("more").alias("meta")),
        "lever": lambda jobs: jobs,
        "smartrecruiters": lambda jobs: F.struct(jobs.alias("content"), F.size(jobs).alias("totalFound")),
        "workday": lambda jobs: F.struct(jobs.alias("jobPostings"), F.size(jobs).alias("total")),
    }
    out = []
    board = F.concat(F.lit("b"), F.col("s_suppkey").cast("string"))
    for k, system in enumerate(SYSTEMS):
        mine = parts.where(F.col("s_suppkey") % 5 == k)
        if system == "ashby":
            teams = mine.groupBy("s_suppkey", "s_name", "p_type").agg(F.sort_array(F.collect_list(job[system])).alias("jobs"))
            packed = teams.groupBy("s_suppkey", "s_name").agg(F.sort_array(F.collect_list(F.struct(F.col("p_type").alias("name"), "jobs"))).alias("teams"))
            value = F.struct(F.struct(F.struct("teams").alias("jobBoard")).alias("data"))
        else:
            packed = mine.groupBy("s_suppkey", "s_name").agg(F.sort_array(F.collect_list(job[system])).alias("jobs"))
            value = nest[system](F.col("jobs"))
        out.append(packed.select(F.lit(system).alias("system"), F.col("s_name").alias("company"), board.alias("board"), F.to_json(value).alias("value")))
    return reduce(DataFrame.unionByName, out)


def _landed(spark, sf_dir) -> str:
    root = scratch_path(spark, f"boards-{uuid.uuid4().hex}")
    plug.land_packed(_payloads(_parts(spark, sf_dir)), root)
    return root


def _postings(spark, root: str, by: str) -> DataFrame:
    frames = []
    for system in SYSTEMS:
        path = f"{root}/system={system}"
        if path_exists(spark, path):
            frames.append(plug.read_board(spark, system, path, by=by, packed=True, **(WORKDAY if system == "workday" else {})))
    rows = reduce(DataFrame.unionByName, frames) if frames else plug.SYSTEMS["lever"](spark.createDataFrame([], "value string, company string, board string"))
    return rows.select("company", "source_job_id", "source_system", "title", "location", "remote_type", "employment_type", "department", "team",
                       "posted_at", "apply_url", F.get_json_object("raw", "$.extra.brand").alias("brand"),
                       F.get_json_object("raw", "$.extra.size").cast("int").alias("size"))


_TEXT = "lower(title || ' ' || n_name)"
_REMOTE = ("CASE WHEN contains({t}, 'remote') AND contains({t}, 'hybrid') THEN 'hybrid' WHEN contains({t}, 'remote') THEN 'remote' "
           "WHEN contains({t}, 'onsite') OR contains({t}, 'on-site') THEN 'onsite' ELSE 'unknown' END")
_EMPLOY = ("CASE WHEN contains({t}, 'intern') THEN 'internship' WHEN contains({t}, 'contract') THEN 'contract' "
           "WHEN contains({t}, 'part-time') THEN 'part_time' WHEN contains({t}, 'full-time') THEN 'full_time' ELSE '{other}' END")
_TERM = f"({LEVER_TERMS!r}[p_size % 4 + 1])"
_BOARDS_SQL = f"""
WITH {_PARTS_SQL},
j AS (
  SELECT *, 'greenhouse' AS source_system, p_partkey::VARCHAR AS source_job_id, n_name AS location,
    {_REMOTE.format(t=_TEXT)} AS remote_type, {_EMPLOY.format(t='lower(title)', other='full_time')} AS employment_type,
    p_type AS department, NULL AS team,
    CASE WHEN p_size % 7 <> 0 THEN 'https://boards.example.com/' || p_partkey ELSE 'https://boards.greenhouse.io/b' || s_suppkey END AS apply_url
  FROM b WHERE s_suppkey % 5 = 0
  UNION ALL
  SELECT *, 'lever', 'L' || p_partkey, n_name, {_REMOTE.format(t=f"lower(title || ' ' || n_name || ' ' || {_TERM})")},
    {_EMPLOY.format(t=f"lower(title || ' ' || {_TERM})", other='unknown')}, p_type, p_brand,
    'https://jobs.lever.co/x/' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '/apply' ELSE '' END
  FROM b WHERE s_suppkey % 5 = 1
  UNION ALL
  SELECT *, 'ashby', 'A' || p_partkey, CASE WHEN p_size % 9 = 0 THEN 'Hybrid ' ELSE '' END || n_name,
    CASE WHEN p_size % 9 = 0 THEN 'hybrid' WHEN p_size % 5 = 0 THEN 'remote' ELSE 'unknown' END,
    {_EMPLOY.format(t=f"lower(title || ' ' || {_TERM})", other='full_time')}, p_type, NULL,
    'https://jobs.ashbyhq.com/b' || s_suppkey || '/A' || p_partkey
  FROM b WHERE s_suppkey % 5 = 2
  UNION ALL
  SELECT *, 'smartrecruiters', CASE WHEN p_size % 6 = 0 THEN 'R' ELSE 'S' END || p_partkey, n_name || ', xx',
    CASE WHEN p_size % 5 = 0 THEN 'remote' ELSE 'unknown' END,
    CASE WHEN contains(lower(title), 'intern') OR p_size % 4 = 1 THEN 'internship' WHEN contains(lower(title), 'contract') OR p_size % 4 = 2 THEN 'contract'
         WHEN contains(lower(title), 'part') OR p_size % 4 = 3 THEN 'part_time' ELSE 'full_time' END, p_type, NULL,
    CASE WHEN p_size % 7 <> 0 THEN 'https://smart.example.com/' || p_partkey
         ELSE 'https://jobs.smartrecruiters.com/b' || s_suppkey || '/' || CASE WHEN p_size % 6 = 0 THEN 'R' ELSE 'S' END || p_partkey END
  FROM b WHERE s_suppkey % 5 = 3
  UNION ALL
  SELECT *, 'workday', 'W' || p_partkey, n_name, {_REMOTE.format(t=f"lower(title || ' ' || n_name || ' ' || p_brand || ' ' || {_TERM})")},
    {_EMPLOY.format(t=f"lower(title || ' ' || p_brand || ' ' || {_TERM})", other='unknown')}, NULL, NULL,
    'https://w.example.com/acme/careers/job/' || n_name || '/W' || p_partkey
  FROM b WHERE s_suppkey % 5 = 4)
SELECT s_name AS company, source_job_id, source_system, title, location, remote_type, employment_type, department, team,
  CAST(day AS TIMESTAMP) AS posted_at, apply_url, p_brand AS brand, p_size AS size FROM j
"""


@register("board_postings", _BOARDS_SQL)
def q_board_postings(spark, sf_dir):
    """S01-S05 from landed files; two fields that no reader declares come out of ``raw``."""
    return _postings(spark, _landed(spark, sf_dir), "files")


@register("board_source", _BOARDS_SQL)
def q_board_source(spark, sf_dir):
    """The same through the ``job_board`` data source."""
    return _postings(spark, _landed(spark, sf_dir), "source")


# -- K02: the payload of every saved posting ---------------------------------------------
@register("version_log", f"""
SELECT id AS job_id, sha256('{{"id":"' || source_job_id || '","title":"' || title || '","extra":{{"quantity":' || CAST(CAST(l_quantity AS INT) AS VARCHAR)
    || ',"part":[' || p.l_partkey || ']}}}}') AS raw_sha256, TIMESTAMP '2001-11-05' AS fetched_at
FROM {standins.POSTINGS_LI_SQL} p JOIN lineitem l USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)
WHERE posted_at >= TIMESTAMP '1999-07-01'
""")
def q_version_log(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    p = standins.postings_li(spark, sf_dir).where(F.col("posted_at") >= F.lit("1999-07-01").cast("timestamp")).select("id", "source_job_id", "title", "seq.*")
    more = read_table(spark, sf_dir, "lineitem").select(*key, F.col("l_quantity").cast("int").alias("quantity"))
    extra = F.struct("quantity", F.array("l_partkey").alias("part")).alias("extra")
    raw = p.join(more, key).select("id", F.to_json(F.struct(F.col("source_job_id").alias("id"), "title", extra)).alias("raw"))
    v = store.version_rows(raw, AS_OF)
    return v.select("job_id", F.sha2(F.col("raw_json").cast("binary"), 256).alias("raw_sha256"), "fetched_at")


# -- S06 S07 S09: pages with the markup of aggregators and searches --------------------------
def _pages(parts: DataFrame, item, around=("<html><body><ul>", "</ul></body></html>"), page=None) -> DataFrame:
    """One page per supplier: its parts' snippets in key order."""
    page = F.col("s_suppkey") if page is None else page
    rows = parts.select(page.alias("page_id"), F.struct("p_partkey", item.alias("html")).alias("r"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["html"]), "\n")
    return rows.groupBy("page_id").agg(F.concat(F.lit(around[0]), body, F.lit(around[1])).alias("html"))


@register("aggregator_cards", f"""
WITH {_PARTS_SQL}
SELECT s_suppkey AS page_id, s_suppkey % 3 + 1 AS strategy, p_partkey::VARCHAR AS source_job_id,
  CASE WHEN s_suppkey % 3 = 2 THEN 'LinkedIn Job' ELSE title END AS title,
  CASE WHEN s_suppkey % 3 = 2 OR p_size % 5 = 0 THEN 'Unknown' ELSE p_brand || ' & Co' END AS company,
  CASE WHEN s_suppkey % 3 < 2 AND p_size % 4 <> 0 THEN n_name END AS location,
  'https://www.linkedin.com/jobs/view/' || p_partkey || CASE WHEN s_suppkey % 3 = 0 THEN '?ref=x' ELSE '' END AS apply_url
FROM b
""")
def q_aggregator_cards(spark, sf_dir):
    """S06 with its three strategies by page; company and location stand beside the anchors."""
    parts, key, size = _parts(spark, sf_dir), F.col("p_partkey").cast("string"), F.col("p_size")
    company, place = size % 5 != 0, size % 4 != 0
    card = F.concat(F.lit('<li class="row"><div><div class="card wide"><a class="l" href="/jobs/view/'), key, F.lit('?ref=x">\n  '), "title",
                    F.lit("</a>"), F.when(company, F.concat(F.lit('<h4 class="x base-search-card__subtitle"> '), "p_brand", F.lit(" &amp; Co</h4>"))).otherwise(""),
                    F.lit("<br></div></div><p>"), F.when(place, F.concat(F.lit('<span class="job-search-card__location">'), "n_name", F.lit("</span>"))).otherwise(""),
                    F.lit("</p></li>"))
    entity = F.concat(F.lit("<code>"), F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("urn:li:jobPosting:"), key).alias("entityUrn"), F.struct(F.col("title").alias("text")).alias("title"),
        F.when(company, F.concat("p_brand", F.lit(" & Co"))).otherwise("").alias("primaryDescription"),
        F.when(place, F.col("n_name")).alias("secondaryDescription"))).alias("included"))), F.lit("</code>"))
    bare = F.concat(F.lit("<p>urn:li:jobPosting:"), key, F.lit(" jobPosting:"), key, F.lit("</p>"))
    item = F.when(F.col("s_suppkey") % 3 == 0, card).when(F.col("s_suppkey") % 3 == 1, entity).otherwise(bare)
    out = html_src.aggregator_jobs(_pages(parts, item), SCRAPED_AT)
    return out.select("page_id", F.col("strategy").cast("bigint").alias("strategy"), "source_job_id", "title", "company", "location", "apply_url")


@register("search_card_pages", f"""
WITH {_PARTS_SQL}
SELECT s_suppkey AS page_id, 'jk' || p_partkey AS source_job_id, title, p_brand AS company, n_name AS location,
  CASE WHEN contains(lower(title), 'remote') THEN 'remote' WHEN contains(lower(title), 'hybrid') THEN 'hybrid' ELSE 'unknown' END AS remote_type,
  CASE WHEN contains(lower(title), 'intern') THEN 'internship' WHEN contains(lower(title), 'contract') THEN 'contract' ELSE 'full_time' END AS employment_type
FROM b WHERE p_size % 6 <> 0
""")
def q_search_card_pages(spark, sf_dir):
    """S07; cards without a company name are dropped."""
    company = F.when(F.col("p_size") % 6 != 0, F.col("p_brand")).otherwise(" ")
    item = F.concat(F.lit('<div data-jk="jk'), F.col("p_partkey").cast("string"), F.lit('"><h2 class="jobTitle a"><span title="t">'), "title",
                    F.lit('</span></h2>\n<span class="companyName">'), company, F.lit('</span><div class="companyLocation b"> '), "n_name", F.lit("\n</div></div>"))
    out = html_src.search_cards(_pages(_parts(spark, sf_dir), item), SCRAPED_AT)
    return out.select("page_id", "source_job_id", "title", "company", "location", "remote_type", "employment_type")


@register("search_variants", f"""
WITH {_PARTS_SQL},
r AS (SELECT v, s_suppkey AS page_id, p_partkey, title, p_brand,
        CASE p_size % 4 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' WHEN 1 THEN 'https://www.indeed.com/viewjob?jk=' WHEN 2 THEN 'https://jobs.lever.co/x/' END
          || p_partkey % 500 AS url
      FROM b, (SELECT unnest([0, 1, 2]) AS v) WHERE p_partkey % 3 <> v),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY v, page_id, p_partkey) AS rn FROM r WHERE url IS NOT NULL)
SELECT v AS variant, page_id, substr(md5(url), 1, 12) AS id, url,
  title, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' Ltd' ELSE 'Unknown' END AS company FROM f WHERE rn = 1
""")
def q_search_variants(spark, sf_dir):
    """Three search variants whose results overlap, each URL once."""
    parts, key, size = _parts(spark, sf_dir), F.col("p_partkey"), F.col("p_size")
    site = F.when(size % 4 == 0, "https://www.linkedin.com/jobs/view/").when(size % 4 == 1, "https://www.indeed.com/viewjob?jk=") \
        .when(size % 4 == 2, "https://jobs.lever.co/x/").otherwise("https://news.example.org/")
    text = F.concat("title", F.when(key % 2 == 0, F.concat(F.lit(" at "), "p_brand", F.lit(" Ltd"))).otherwise(""))
    item = F.concat(F.lit('<a class="result__a" rel="x" href="'), site, (key % 500).cast("string"), F.lit('">'), text, F.lit("</a>"))
    found = [html_src.search_results(_pages(parts.where(key % 3 != v), item), "US", SCRAPED_AT) for v in range(3)]
    return html_src.union_by_url(found).select("variant", "page_id", "id", "url", "title", "company")


@register("page_merge", f"""
WITH {_PARTS_SQL},
s AS (SELECT s_suppkey AS page_id, p_type, p_partkey, title, p_size FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, p_type ORDER BY (p_size % 5 <> 0)::INT DESC, p_partkey) AS rn FROM s)
SELECT page_id, p_type, p_partkey, title FROM k WHERE rn = 1
""")
def q_page_merge(spark, sf_dir):
    """Per page and kind one job, those with a company first, then the first on the page."""
    rows = _parts(spark, sf_dir).select(F.col("s_suppkey").alias("page_id"), "p_type", "p_partkey", "title", "p_size")
    best = F.struct((F.col("p_size") % 5 != 0).cast("int").alias("has"), (-F.col("p_partkey")).alias("first"))
    return dedup.prefer_per_key(rows, ["page_id", "p_type"], best).select("page_id", "p_type", "p_partkey", "title")

"""Registered queries over whole web pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.classify import ats_detect, host_owned_by, is_job_url, source_label, title_from_url, url_netloc
from ..functions.text import short_url_id, strip_html
from ..session import read_table, spread
from ..sources import html as html_src
from .registry import register
from .sqlfrag import py_title

SCRAPED_AT = dt.datetime(2024, 2, 1)
# The driver's pages carry no job markup: links are root-relative hrefs.
PAGE_LINK_PATTERNS = [r'href="(/[^"]+)"']

# The driver's hrefs are root-relative words: origin + href is the whole join there
# (dot-segment removal never applies; the Spark side is tested against urljoin).
_ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"


def _title_from_url_sql(u: str) -> str:
    path = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
    segs = f"list_filter(string_split({path}, '/'), lambda s: s <> '')"
    t = f"regexp_replace(regexp_replace({segs}[-1], '[-_]+', ' ', 'g'), '\\.\\w+$', '')"
    return (f"CASE WHEN len({segs}) = 0 OR length({t}) < 5 OR regexp_full_match({t}, '\\d+') THEN NULL "
            f"ELSE {py_title(t)} END")


@register("page_links", f"""
WITH l AS (
  SELECT page_id, url, html, unnest(regexp_extract_all(html, '(?i)href="(/[^"]+)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, '(?i)href="(/[^"]+)"', 1), 1) AS pos
  FROM pages),
a AS (SELECT *, {_ORIGIN} || href AS job_url FROM l),
f AS (SELECT page_id, job_url, arg_min(href, pos) AS href, min(pos) AS pos,
             any_value(html) AS html, any_value(url) AS url FROM a GROUP BY page_id, job_url),
g AS (SELECT *, trim(regexp_replace(regexp_extract(html, '(?is)<a[^>]*href=["'']?\\Q' || href || '\\E["'']?[^>]*>([^<]+)</a>', 1), '\\s+', ' ', 'g')) AS anchor,
             trim(regexp_replace(regexp_extract(html, '(?is)>([^<]+)</a>\\s*<a[^>]*href=["'']?\\Q' || href || '\\E', 1), '\\s+', ' ', 'g')) AS before
      FROM f
      WHERE NOT regexp_matches(lower(job_url), '/about|/contact|/privacy|/terms|/benefits|/culture|/team|/blog|\\.pdf$|\\.jpg$|\\.png$')),
h AS (SELECT *, CASE WHEN length(anchor) > 5 AND length(anchor) < 200 THEN anchor
                     WHEN length(before) > 5 AND length(before) < 200 THEN before
                     ELSE {_title_from_url_sql('job_url')} END AS title,
             strpos(lower(html), lower(href)) AS hpos FROM g)
SELECT page_id, job_url AS apply_url, title, substr(md5(job_url), 1, 12) AS source_job_id,
  coalesce(nullif(trim(regexp_extract(substring(html, greatest(hpos - 500, 1), least(hpos - 1, 500) + length(href) + 500),
                                     '(?i)(?:Location|City|Office):\\s*([^<\\n]+)', 1)), ''),
           nullif(trim(regexp_extract(substring(html, greatest(hpos - 500, 1), least(hpos - 1, 500) + length(href) + 500),
                                     '(?i)<span[^>]*class="[^"]*location[^"]*"[^>]*>([^<]+)</span>', 1)), '')) AS location
FROM h WHERE title IS NOT NULL
""")
def q_page_links(spark, sf_dir):
    pages = spread(read_table(spark, sf_dir, "pages"))
    links = html_src.career_page_links(pages, link_patterns=PAGE_LINK_PATTERNS)
    return links.select("page_id", "apply_url", "title", "source_job_id", "location")


@register("strip_html", """
SELECT page_id, md5(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5,
       length(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))::BIGINT AS n_chars
FROM pages
""")
def q_strip_html(spark, sf_dir):
    p = spread(read_table(spark, sf_dir, "pages"))
    t = strip_html("html")
    return p.select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("n_chars"))


def _ats_case(col: str, table) -> str:
    parts = []
    for ats, pats in table:
        cond = " OR ".join(f"regexp_matches({col}, '(?i){p}')" for p in pats)
        parts.append(f"WHEN {cond} THEN '{ats}'")
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


def _ats_sql():
    from ..functions.classify import ATS_HTML_PATTERNS, ATS_URL_PATTERNS
    hp = ("regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) || "
          "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)")
    by_url = _ats_case(f"({hp})", ATS_URL_PATTERNS)
    by_html = _ats_case("coalesce(html, '')", ATS_HTML_PATTERNS)
    return f"""
SELECT page_id,
  CASE WHEN {by_url} <> 'unknown' THEN {by_url}
       WHEN html IS NOT NULL AND html <> '' AND {by_html} <> 'unknown' THEN {by_html} ELSE 'unknown' END AS ats,
  CASE WHEN {by_url} <> 'unknown' THEN 0.95e0
       WHEN html IS NOT NULL AND html <> '' AND {by_html} <> 'unknown' THEN 0.7e0 ELSE 0.0e0 END AS confidence
FROM pages"""


@register("ats_detect", _ats_sql())
def q_ats_detect(spark, sf_dir):
    p = spread(read_table(spark, sf_dir, "pages"))
    d = ats_detect(F.col("url"), F.col("html"))
    return p.select("page_id", d["ats"].alias("ats"), d["confidence"].alias("confidence"))


@register("page_url_info", f"""
SELECT page_id,
  CASE WHEN contains(lower(url), 'linkedin') THEN 'linkedin' WHEN contains(lower(url), 'indeed') THEN 'indeed'
       WHEN contains(lower(url), 'glassdoor') THEN 'glassdoor' ELSE 'other' END AS source_label,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS host,
  substr(md5(url), 1, 12) AS short_id,
  NOT regexp_matches(lower(url), '/about|/contact|/privacy|/terms|/benefits|/culture|/team|/blog|\\.pdf$|\\.jpg$|\\.png$') AS job_url,
  contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), 'greenhouse.io') AS greenhouse_host,
  {_title_from_url_sql('url')} AS url_title
FROM pages
""")
def q_page_url_info(spark, sf_dir):
    p = spread(read_table(spark, sf_dir, "pages"))
    u = F.col("url")
    return p.select("page_id", source_label(u).alias("source_label"), url_netloc(u).alias("host"),
                    short_url_id(u).alias("short_id"), is_job_url(u).alias("job_url"),
                    host_owned_by(u, "greenhouse").alias("greenhouse_host"),
                    title_from_url(u).alias("url_title"))


@register("search_results", """
WITH r AS (SELECT page_id,
             unnest(regexp_extract_all(html, '(?i)class="result__a"[^>]*href="([^"]+)"[^>]*>([^<]+)</a>', 1)) AS u,
             unnest(regexp_extract_all(html, '(?i)class="result__a"[^>]*href="([^"]+)"[^>]*>([^<]+)</a>', 2)) AS t,
             generate_subscripts(regexp_extract_all(html, '(?i)class="result__a"[^>]*href="([^"]+)"[^>]*>([^<]+)</a>', 1), 1) AS pos
           FROM pages),
  k AS (SELECT * FROM r
        WHERE contains(lower(u), 'linkedin.com/jobs') OR contains(lower(u), 'indeed.com') OR contains(lower(u), 'glassdoor.com')
           OR contains(lower(u), 'greenhouse.io') OR contains(lower(u), 'lever.co'))
SELECT arg_min(page_id, (page_id, pos)) AS page_id, substr(md5(u), 1, 12) AS id, u AS url FROM k GROUP BY u
""")
def q_search_results(spark, sf_dir):
    p = spread(read_table(spark, sf_dir, "pages"))
    r = html_src.first_by_url(html_src.search_results(p, "United States", SCRAPED_AT))
    return r.select("page_id", "id", "url")


# The twin finds anchors by a pattern (the pages hold none; rendered cards have a query of their own).
_ANCHOR = r"""<a\b[^>]*href=["']([^"']*/jobs/view/(\d+)[^"']*)["'][^>]*>(.*?)</a>"""


def _aggregator_sql():
    a = _ANCHOR.replace("'", "''")
    anchors = f"regexp_extract_all(html, '(?is){a}', {{g}})"
    codes = "regexp_extract_all(html, '(?is)<code[^>]*>(.*?)</code>', 1)"
    bare = f"regexp_extract_all(html, '{html_src.AGGREGATOR_URN}', 1)"
    jurn = html_src.AGGREGATOR_JSON_URN
    sq = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"

    def text_field(path):
        return (f"CASE WHEN json_type(ent, '{path}') = 'OBJECT' THEN json_extract_string(ent, '{path}.text') "
                f"ELSE json_extract_string(ent, '{path}') END")
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
a AS (SELECT page_id, unnest({anchors.format(g=1)}) AS href, unnest({anchors.format(g=2)}) AS jid,
             unnest({anchors.format(g=3)}) AS txt, generate_subscripts({anchors.format(g=1)}, 1) AS pos FROM p),
s1 AS (SELECT page_id, jid AS job_id, 1 AS strategy,
              arg_max(coalesce(nullif({sq(sq("regexp_replace(txt, '<[^>]+>', '', 'g')"))}, ''), 'LinkedIn Job'), pos) AS title,
              '' AS company FROM a GROUP BY page_id, jid),
c AS (SELECT page_id, trim(js) AS js, blk FROM
        (SELECT page_id, unnest({codes}) AS js, generate_subscripts({codes}, 1) AS blk FROM p)),
cv AS (SELECT * FROM c WHERE json_valid(js)),
ents AS (SELECT page_id, blk,
           CASE WHEN starts_with(js, '[') THEN CAST(json_extract(js, '$[*]') AS JSON[])
                ELSE list_concat(
                  CASE WHEN json_type(js, '$.included') = 'ARRAY' THEN CAST(json_extract(js, '$.included[*]') AS JSON[]) ELSE [] END,
                  CASE WHEN json_type(js, '$.data') = 'ARRAY' THEN CAST(json_extract(js, '$.data[*]') AS JSON[]) ELSE [] END)
           END AS es FROM cv),
e AS (SELECT page_id, blk, unnest(es) AS ent, generate_subscripts(es, 1) AS epos FROM ents),
e2 AS (SELECT page_id, blk * 1000000 + epos AS pos, ent,
              coalesce(nullif(json_extract_string(ent, '$.entityUrn'), ''), json_extract_string(ent, '$."*jobPosting"')) AS urn
       FROM e WHERE json_type(ent) = 'OBJECT'),
e3 AS (SELECT page_id, pos, regexp_extract(urn, '{jurn}', 1) AS job_id,
              coalesce(nullif({text_field('$.title')}, ''), 'LinkedIn Job') AS title,
              coalesce({text_field('$.primaryDescription')}, '') AS company
       FROM e2 WHERE contains(urn, 'jobPosting') AND regexp_extract(urn, '{jurn}', 1) <> ''),
s2 AS (SELECT page_id, job_id, 2 AS strategy,
              CASE WHEN arg_min(company, pos) <> '' THEN arg_min(title, pos)
                   ELSE coalesce(arg_min(title, pos) FILTER (WHERE company <> ''), arg_min(title, pos)) END AS title,
              CASE WHEN arg_min(company, pos) <> '' THEN arg_min(company, pos)
                   ELSE coalesce(arg_min(company, pos) FILTER (WHERE company <> ''), arg_min(company, pos)) END AS company
       FROM e3 GROUP BY page_id, job_id),
b AS (SELECT page_id, unnest({bare}) AS job_id FROM p),
s3 AS (SELECT DISTINCT page_id, job_id, 3 AS strategy, 'LinkedIn Job' AS title, '' AS company FROM b),
u AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3),
best AS (SELECT page_id, min(strategy) AS s FROM u GROUP BY page_id)
SELECT u.page_id, u.strategy, u.job_id AS source_job_id, u.title,
       coalesce(nullif(u.company, ''), 'Unknown') AS company
FROM u JOIN best ON u.page_id = best.page_id AND u.strategy = best.s
"""


@register("aggregator_jobs", _aggregator_sql())
def q_aggregator_jobs(spark, sf_dir):
    """S06 over every page."""
    p = spread(read_table(spark, sf_dir, "pages"))
    return html_src.aggregator_jobs(p, SCRAPED_AT).select("page_id", "strategy", "source_job_id", "title", "company")


def _cards_sql():
    pat = "(?is)" + html_src.SEARCH_CARD_PATTERN.replace("'", "''")
    grp = ", ".join(f"regexp_extract_all(html, '{pat}', {g}) AS g{g}" for g in (1, 2, 3, 4))
    sq = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"""
WITH c AS (SELECT page_id, {grp} FROM pages),
  r AS (SELECT page_id, unnest(g1) AS jk, unnest(g2) AS t, unnest(g3) AS co, unnest(g4) AS lo FROM c)
SELECT page_id, jk AS source_job_id, {sq('t')} AS title, {sq('co')} AS company, {sq('lo')} AS location
FROM r WHERE {sq('t')} <> '' AND {sq('co')} <> ''
"""


@register("search_cards", _cards_sql())
def q_search_cards(spark, sf_dir):
    """S07 over every page."""
    p = spread(read_table(spark, sf_dir, "pages"))
    return html_src.search_cards(p, SCRAPED_AT).select("page_id", "source_job_id", "title", "company", "location")



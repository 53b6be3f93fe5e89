"""Postings from landed HTML pages (S06 aggregator pages, S07 search cards, S08
career-page links, S09 search-result links).

Each page is one row, and extraction makes an array in that row and explodes it, so the work is
a narrow map over the pages table (no shuffle) and grows with it. Pages are processed whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import (JOB_SITES, employment_type, is_job_url, remote_type,
                                  title_from_url, url_netloc)
from ..functions.text import regex_quote, short_url_id, squash_ws
from .cards import job_cards

# Default link patterns of the career-page reader, in order.
DEFAULT_LINK_PATTERNS = [
    r"""href=["']([^"']*(?:job|career|position|opening|apply)[^"']*)["']""",
    r"""href=["']([^"']+/jobs?/[^"']+)["']""",
    r"""href=["']([^"']+/careers?/[^"']+)["']""",
]
# Location patterns looked for around a link, in order.
LOCATION_PATTERNS = [
    r"(?:Location|City|Office):\s*([^<\n]+)",
    r"""<span[^>]*class="[^"]*location[^"]*"[^>]*>([^<]+)</span>""",
]
# Patterns of search results, search cards and aggregator pages.
SEARCH_RESULT_PATTERN = r'class="result__a"[^>]*href="([^"]+)"[^>]*>([^<]+)</a>'
SEARCH_CARD_PATTERN = (r'data-jk="([^"]+)"[^>]*>.*?class="jobTitle[^"]*"[^>]*>.*?<span[^>]*>([^<]+)'
                       r'</span>.*?class="companyName[^"]*"[^>]*>([^<]+)<.*?class="companyLocation'
                       r'[^"]*"[^>]*>([^<]+)<')
AGGREGATOR_URN = r"jobPosting(?:Card)?[:(%]\D*(\d+)"
AGGREGATOR_JSON_URN = r"jobPosting(?:Card)?[:(]\D*(\d+)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def remove_dot_segments(path) -> Column:
    """RFC 3986 dot-segment removal on an absolute path ('/a/b/../c' -> '/a/c'),
    as a stack over the path segments (exact for any depth)."""
    segs = F.slice(F.split(_c(path), "/"), 2, 1 << 30)          # drop the leading ''
    stack = F.aggregate(segs, F.array().cast("array<string>"),
                        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    last = F.try_element_at(segs, F.lit(-1))
    trailing = F.when(last.isin(".", "..") & (F.size(stack) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(stack, "/"), trailing)


def absolute_url(base, href) -> Column:
    """urljoin: absolute, scheme-relative, root-relative, query/fragment-only and
    relative references, with dot segments removed from the resulting path."""
    b, h = _c(base), _c(href)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.concat(scheme, F.lit("://"), url_netloc(b))
    base_path = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    base_dir = F.regexp_replace(base_path, r"[^/]*$", "")
    h_path = F.regexp_extract(h, r"^([^?#]*)", 1)
    h_rest = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    rel = F.concat(F.when(base_dir == "", F.lit("/")).otherwise(base_dir), h_path)
    return (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h == "", b)
            .when(h.startswith("#"), F.concat(F.regexp_replace(b, r"#.*$", ""), h))
            .when(h.startswith("?"), F.concat(F.regexp_replace(b, r"[?#].*$", ""), h))
            .when(h.startswith("/"), F.concat(origin, remove_dot_segments(h_path), h_rest))
            .otherwise(F.concat(origin, remove_dot_segments(rel), h_rest)))


def career_page_links(pages: DataFrame, company=None, link_patterns=None, *,
                      url_col="url", html_col="html", id_col="page_id") -> DataFrame:
    """One posting per distinct job link of a page.

    Link patterns are applied in order; a URL keeps its first occurrence; non-job
    URLs are dropped; the title is the text of the first anchor with that href when
    5 < len < 200, else derived from the URL, else the link is dropped; location is
    looked up within 500 chars around the first occurrence of the href."""
    pats = link_patterns or DEFAULT_LINK_PATTERNS
    html = F.coalesce(_c(html_col), F.lit(""))
    hrefs = F.flatten(F.array(*[F.regexp_extract_all(html, F.lit("(?i)" + p), 1) for p in pats]))
    urls = F.transform(hrefs, lambda h: absolute_url(_c(url_col), h))
    # First occurrence of each absolute URL wins (array_distinct keeps first-seen order). All
    # lookups in the page happen inside its row, and only (url, title, location) are exploded:
    # the page is neither shuffled nor copied per link.
    one = pages.select(_c(id_col).alias(id_col), _c(url_col).alias("source_url"), html.alias("_html"),
                       hrefs.alias("_hrefs"), urls.alias("_urls"))

    def ok(t):
        return (F.length(t) > 5) & (F.length(t) < 200)

    def lookup(link):
        href, whole = link["href"], F.col("_html")
        quoted = regex_quote(href)
        text = lambda pat: squash_ws(F.call_function("regexp_extract", whole, pat, F.lit(1)))
        # the link's own anchor, else the anchor right before the link
        own = text(F.concat(F.lit("(?is)<a[^>]*href=[\"']?"), quoted, F.lit("[\"']?[^>]*>([^<]+)</a>")))
        before = text(F.concat(F.lit("(?is)>([^<]+)</a>\\s*<a[^>]*href=[\"']?"), quoted))
        at = F.call_function("instr", F.lower(whole), F.lower(href))
        ctx = F.when(at > 0, F.call_function("substring", whole, F.greatest(at - 500, F.lit(1)),
                                             F.least(at - 1, F.lit(500)) + F.length(href) + 500))
        loc = F.coalesce(*[F.nullif(F.regexp_replace(F.regexp_extract(ctx, "(?i)" + p, 1), r"^\s+|\s+$", ""), F.lit(""))
                           for p in LOCATION_PATTERNS])
        title = F.when(ok(own), own).when(ok(before), before).otherwise(title_from_url(link["job_url"]))
        return F.struct(link["pos"].alias("_pos"), link["job_url"].alias("apply_url"), title.alias("title"), loc.alias("location"))

    links = F.transform(F.array_distinct("_urls"), lambda u, k: F.struct(
        k.alias("pos"), u.alias("job_url"), F.try_element_at("_hrefs", F.array_position("_urls", u).cast("int")).alias("href")))
    known = one.select(id_col, "source_url", "_html", F.filter(links, lambda x: is_job_url(x["job_url"])).alias("_links"))
    out = known.select(id_col, "source_url", F.inline(F.transform("_links", lookup))).filter(F.col("title").isNotNull())
    comp = F.lit(company) if isinstance(company, str) else (
        _c(company) if company is not None else url_netloc(F.col("source_url")))
    return out.select(
        id_col, "_pos", comp.alias("company"), "title", short_url_id("apply_url").alias("source_job_id"),
        F.lit("unknown").alias("source_system"), "source_url", "apply_url", "location",
        remote_type(F.col("title"), F.col("location"), policy="A").alias("remote_type"),
        employment_type(F.col("title")).alias("employment_type"))


def first_by_url(results: DataFrame, id_col="page_id") -> DataFrame:
    """One row per URL, the first by (page, position) across pages/queries."""
    from ..operators.dedup import first_per_key
    return first_per_key(results, ["url"], F.struct(F.col(id_col), F.col("_pos")))


def union_by_url(variants: list[DataFrame], id_col="page_id") -> DataFrame:
    """The results of several search variants as one list: each URL once, from the first
    variant that has it, there from the first (page, position). ``variant`` tells which."""
    from ..operators.dedup import first_per_key
    rows = reduce(DataFrame.unionByName, [v.withColumn("variant", F.lit(k)) for k, v in enumerate(variants)])
    return first_per_key(rows, ["url"], F.struct("variant", id_col, "_pos"))


def search_results(pages: DataFrame, location: str, found_at, *, html_col="html",
                   id_col="page_id") -> DataFrame:
    """(url, title) result links of known job sites; title/company split on
    ' at ' then ' - '; id = md5(url)[:12]."""
    html = F.coalesce(_c(html_col), F.lit(""))
    urls = F.regexp_extract_all(html, F.lit("(?i)" + SEARCH_RESULT_PATTERN), 1)
    titles = F.regexp_extract_all(html, F.lit("(?i)" + SEARCH_RESULT_PATTERN), 2)
    rows = pages.select(_c(id_col).alias(id_col),
                        F.posexplode(F.arrays_zip(urls.alias("u"), titles.alias("t"))).alias("_pos", "_r"))
    u = F.col("_r.u")
    keep = reduce(lambda a, b: a | b, [F.lower(u).contains(s) for s in JOB_SITES])
    rows = rows.filter(keep)
    t = squash_ws(F.col("_r.t"))
    at_parts = F.split(t, " at ")
    dash_parts = F.split(t, " - ")
    has_at = F.size(at_parts) > 1
    has_dash = F.size(dash_parts) >= 2
    title = (F.when(has_at, F.trim(at_parts[0])).when(has_dash, F.trim(dash_parts[0])).otherwise(t))
    company = (F.when(has_at, F.trim(at_parts[1])).when(has_dash, F.trim(dash_parts[1]))
               .otherwise(F.lit("Unknown")))
    from ..functions.timeutil import as_timestamp
    return rows.select(id_col, "_pos", short_url_id(u).alias("id"), title.alias("title"),
                       company.alias("company"), F.lit(location).alias("location"), u.alias("url"),
                       F.lit("web_search").alias("source"), as_timestamp(found_at).alias("found_at"))


def search_cards(pages: DataFrame, scraped_at, *, html_col="html", id_col="page_id",
                 per_page: int | None = None) -> DataFrame:
    """Job cards (id, title, company, location), all of a page or its first
    ``per_page``, squashed whitespace, empty title/company dropped, posted_at = scrape time."""
    html = F.coalesce(_c(html_col), F.lit(""))
    pat = F.lit("(?is)" + SEARCH_CARD_PATTERN)
    groups = [F.regexp_extract_all(html, pat, g) for g in (1, 2, 3, 4)]
    if per_page is not None:
        groups = [F.slice(g, 1, per_page) for g in groups]
    z = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ["jk", "t", "c", "l"])])
    rows = pages.select(_c(id_col).alias(id_col), F.posexplode(z).alias("_pos", "_r"))
    title, comp, loc = squash_ws(F.col("_r.t")), squash_ws(F.col("_r.c")), squash_ws(F.col("_r.l"))
    from ..functions.timeutil import as_timestamp
    out = rows.select(id_col, "_pos", comp.alias("company"), title.alias("title"),
                      F.col("_r.jk").alias("source_job_id"), F.lit("unknown").alias("source_system"),
                      F.lit("https://www.indeed.com").alias("source_url"),
                      F.concat(F.lit("https://www.indeed.com/viewjob?jk="), F.col("_r.jk")).alias("apply_url"),
                      loc.alias("location"),
                      remote_type(title, loc, policy="C").alias("remote_type"),
                      employment_type(title, policy="short").alias("employment_type"),
                      as_timestamp(scraped_at).alias("posted_at"))
    return out.filter((F.col("title") != "") & (F.col("company") != ""))


def aggregator_jobs(pages: DataFrame, scraped_at, *, html_col="html", id_col="page_id") -> DataFrame:
    """Three strategies, the next only if the previous found nothing on the page:
    (1) anchors to /jobs/view/<id> (last anchor per id wins; title = anchor text, company and
    location from the elements around it, ``cards``); (2) JSON inside <code> blocks: entities
    of included[] / data[] / a top-level array whose urn names a job posting (replace only if
    old company empty and new one not); (3) bare urn ids in the page (first wins).
    Every strategy gives an array in the page's row, so there is no shuffle."""
    from ..functions.timeutil import as_timestamp
    html = F.coalesce(_c(html_col), F.lit(""))
    link = lambda j: F.concat(F.lit("https://www.linkedin.com/jobs/view/"), j)
    job = lambda jid, title, company, href, loc: F.struct(
        jid.alias("job_id"), F.coalesce(F.nullif(title, F.lit("")), F.lit("LinkedIn Job")).alias("title"),
        F.coalesce(company, F.lit("")).alias("company"), href.alias("link"), loc.alias("location"))
    none = F.lit(None).cast("string")

    entity = ("array<struct<entityUrn:string,`*jobPosting`:string,title:string,"
              "primaryDescription:string,secondaryDescription:string>>")

    def entities(block):
        obj = F.from_json(block, f"struct<included:{entity},data:string>")
        return F.when(block.startswith("["), F.from_json(block, entity)).otherwise(
            F.concat(F.coalesce(obj["included"], F.array()), F.coalesce(F.from_json(obj["data"], entity), F.array())))

    blocks = F.transform(F.regexp_extract_all(F.col("_html"), F.lit(r"(?is)<code[^>]*>(.*?)</code>"), 1), F.trim)
    urn = lambda e: F.coalesce(F.nullif(e["entityUrn"], F.lit("")), e["*jobPosting"])
    jid = lambda e: F.regexp_extract(F.coalesce(urn(e), F.lit("")), AGGREGATOR_JSON_URN, 1)

    one = pages.select(_c(id_col).alias(id_col), html.alias("_html"), job_cards(html).alias("_cards"))
    two = one.select(id_col, "_html", "_cards", F.flatten(F.transform(blocks, lambda b: F.coalesce(entities(b), F.array()))).alias("_ents"))
    three = two.select(id_col, "_html", "_cards", F.transform(
        F.filter("_ents", lambda e: F.coalesce(urn(e).contains("jobPosting") & (jid(e) != ""), F.lit(False))),
        lambda e: job(jid(e), _text_field(e["title"]), _text_field(e["primaryDescription"]), link(jid(e)),
                      _text_field(e["secondaryDescription"]))).alias("_named"))
    s1 = F.transform("_cards", lambda c: job(
        c["job_id"], squash_ws(c["title"]), c["company"],
        F.when(c["href"].startswith("http"), c["href"]).otherwise(F.concat(F.lit("https://www.linkedin.com"), c["href"])), c["location"]))
    # of an id's entities the first, unless it has no company and a later one has
    s2 = F.transform(F.array_distinct(F.transform("_named", lambda e: e["job_id"])), lambda i: F.coalesce(
        F.get(F.filter("_named", lambda e: (e["job_id"] == i) & (e["company"] != "")), F.lit(0)),
        F.get(F.filter("_named", lambda e: e["job_id"] == i), F.lit(0))))
    s3 = F.transform(F.array_distinct(F.regexp_extract_all(F.col("_html"), F.lit(AGGREGATOR_URN), 1)),
                     lambda i: job(i, none, none, link(i), none))
    tried = three.select(id_col, s1.alias("_s1"), s2.alias("_s2"), "_html")
    strategy = F.when(F.size("_s1") > 0, 1).when(F.size("_s2") > 0, 2).otherwise(3)
    best = F.when(F.size("_s1") > 0, F.col("_s1")).when(F.size("_s2") > 0, F.col("_s2")).otherwise(s3)
    chosen = tried.select(id_col, strategy.alias("strategy"), F.posexplode(best).alias("_pos", "_j")).select(id_col, "_pos", "strategy", "_j.*")
    loc = F.nullif(F.coalesce(F.col("location"), F.lit("")), F.lit(""))
    return chosen.select(
        id_col, "_pos", "strategy",
        F.coalesce(F.nullif(F.col("company"), F.lit("")), F.lit("Unknown")).alias("company"),
        "title", F.col("job_id").alias("source_job_id"), F.lit("unknown").alias("source_system"),
        F.lit("https://www.linkedin.com/jobs").alias("source_url"), F.col("link").alias("apply_url"),
        loc.alias("location"), remote_type(F.col("title"), loc, policy="B").alias("remote_type"),
        employment_type(F.col("title"), policy="short").alias("employment_type"),
        as_timestamp(scraped_at).alias("posted_at"))


def _text_field(raw: Column) -> Column:
    """A field that is either a string or an object {text: ...}."""
    as_obj = F.get_json_object(raw, "$.text")
    return F.when(raw.startswith("{"), as_obj).otherwise(raw)

"""Classification column expressions: ATS detection from URL/HTML, board slugs,
remote/employment policies, job-URL test, source labels, title from URL.

Every rule is an ordered CASE WHEN chain of built-in predicates (first hit wins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# ATS detection tables (first system, then first pattern wins).
# URL patterns are searched in "host + path" of the URL, case-insensitively.
# ---------------------------------------------------------------------------
ATS_URL_PATTERNS = [
    ("greenhouse", [r"boards\.greenhouse\.io", r"job-boards\.greenhouse\.io"]),
    ("lever", [r"jobs\.lever\.co", r"lever\.co/[^/]+/jobs"]),
    ("workday", [r"myworkdayjobs\.com", r"wd\d+\.myworkday\.com", r"workday\.com/.*careers"]),
    ("icims", [r"icims\.com", r"careers-.*\.icims\.com"]),
    ("smartrecruiters", [r"smartrecruiters\.com", r"jobs\.smartrecruiters\.com"]),
    ("successfactors", [r"successfactors\.", r"jobs\.sap\.com"]),
    ("taleo", [r"taleo\.net", r"oraclecloud\.com.*hcm"]),
    ("ashby", [r"jobs\.ashbyhq\.com", r"ashbyhq\.com/[^/]+/jobs"]),
]
# HTML markers, searched in the whole page, case-insensitively.
ATS_HTML_PATTERNS = [
    ("greenhouse", [r"greenhouse\.io", r"grnhse_app"]),
    ("lever", [r"lever-jobs-iframe", r"lever\.co"]),
    ("workday", [r"workday", r"wd-"]),
    ("icims", [r"icims"]),
    ("smartrecruiters", [r"smartrecruiters"]),
    ("ashby", [r"ashbyhq"]),
]
URL_CONFIDENCE = 0.95
HTML_CONFIDENCE = 0.7

# Board slug patterns per system (first match wins), searched in the full URL.
BOARD_SLUG_PATTERNS = {
    "greenhouse": [r"boards\.greenhouse\.io/([^/\?]+)", r"job-boards\.greenhouse\.io/([^/\?]+)"],
    "lever": [r"jobs\.lever\.co/([^/\?]+)", r"lever\.co/([^/\?]+)"],
    "ashby": [r"jobs\.ashbyhq\.com/([^/\?]+)", r"ashbyhq\.com/([^/\?]+)"],
    "smartrecruiters": [r"jobs\.smartrecruiters\.com/([^/\?]+)",
                        r"careers\.smartrecruiters\.com/([^/\?]+)"],
}
# Host ownership per reader (substring of the lower-cased host).
HOST_MARKERS = {
    "greenhouse": ["greenhouse.io"],
    "lever": ["lever.co"],
    "ashby": ["ashbyhq.com"],
    "smartrecruiters": ["smartrecruiters.com"],
    "workday": ["myworkdayjobs.com", "myworkday.com", "workday.com"],
    "indeed": ["indeed.com"],
}
# Path words and endings that mark a link as "not a job".
NON_JOB_URL_PATTERNS = [r"/about", r"/contact", r"/privacy", r"/terms", r"/benefits",
                        r"/culture", r"/team", r"/blog", r"\.pdf$", r"\.jpg$", r"\.png$"]
# Search result sites that count as job sites.
JOB_SITES = ["linkedin.com/jobs", "indeed.com", "glassdoor.com", "greenhouse.io", "lever.co"]


# ---------------------------------------------------------------------------
# URL pieces (urlparse-like: no scheme -> empty host, everything is path)
# ---------------------------------------------------------------------------
_URL_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)"


def url_netloc(url) -> Column:
    return F.regexp_extract(_c(url), _URL_RE, 1)


def url_path(url) -> Column:
    u = _c(url)
    return F.when(u.rlike(_URL_RE), F.regexp_extract(u, _URL_RE, 2)) \
        .otherwise(F.regexp_extract(u, r"^([^?#]*)", 1))


def host_path(url) -> Column:
    return F.concat(url_netloc(url), url_path(url))


def _first_hit(text: Column, table, default: Column) -> Column:
    expr = None
    for value, patterns in table:
        cond = reduce(lambda a, b: a | b, [text.rlike("(?i)" + p) for p in patterns])
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(default)


def ats_from_url(url) -> Column:
    return _first_hit(F.coalesce(host_path(url), F.lit("")), ATS_URL_PATTERNS, F.lit("unknown"))


def ats_from_html(html) -> Column:
    return _first_hit(F.coalesce(_c(html), F.lit("")), ATS_HTML_PATTERNS, F.lit("unknown"))


def ats_detect(url, html=None) -> Column:
    """struct(ats, confidence): URL hit .95, else HTML hit .7, else unknown 0.0."""
    by_url = ats_from_url(url)
    by_html = ats_from_html(html) if html is not None else F.lit("unknown")
    html_ok = (F.lit(False) if html is None
               else (_c(html).isNotNull() & (_c(html) != "") & (by_html != "unknown")))
    ats = F.when(by_url != "unknown", by_url).when(html_ok, by_html).otherwise(F.lit("unknown"))
    conf = (F.when(by_url != "unknown", F.lit(URL_CONFIDENCE))
            .when(html_ok, F.lit(HTML_CONFIDENCE)).otherwise(F.lit(0.0)))
    return F.struct(ats.alias("ats"), conf.alias("confidence"))


def board_slug(url, system: str) -> Column:
    """Board token / company slug / company id from a career URL (null if none)."""
    u = F.coalesce(_c(url), F.lit(""))
    hits = [F.nullif(F.regexp_extract(u, "(?i)" + p, 1), F.lit(""))
            for p in BOARD_SLUG_PATTERNS[system]]
    return F.coalesce(*hits)


def workday_info(url) -> Column:
    """struct(company, api_base, site) from a Workday career URL."""
    host = url_netloc(url)
    m1 = r"(?i)^([^.]+)\.wd(\d+)\.myworkdayjobs\.com"
    m2 = r"(?i)^wd(\d+)-([^.]+)\.myworkday\.com"
    c1 = F.nullif(F.regexp_extract(host, m1, 1), F.lit(""))
    n1 = F.regexp_extract(host, m1, 2)
    c2 = F.nullif(F.regexp_extract(host, m2, 2), F.lit(""))
    company = F.coalesce(c1, c2)
    api_base = F.when(c1.isNotNull(), F.concat(F.lit("https://"), c1, F.lit(".wd"), n1,
                                               F.lit(".myworkdayjobs.com/wday/cxs/"), c1))
    first = F.try_element_at(F.split(F.regexp_replace(url_path(url), r"^/+|/+$", ""), "/"), F.lit(1))
    site = F.coalesce(F.nullif(first, F.lit("")), F.lit("External"))
    return F.struct(company.alias("company"), api_base.alias("api_base"), site.alias("site"))


def host_owned_by(url, reader: str) -> Column:
    host = F.lower(url_netloc(url))
    return reduce(lambda a, b: a | b, [host.contains(m) for m in HOST_MARKERS[reader]])


def source_label(url) -> Column:
    u = F.lower(F.coalesce(_c(url), F.lit("")))
    return (F.when(u.contains("linkedin"), "linkedin").when(u.contains("indeed"), "indeed")
            .when(u.contains("glassdoor"), "glassdoor").otherwise("other"))


# ---------------------------------------------------------------------------
# Remote type / employment type policies
# ---------------------------------------------------------------------------
def _lower_join(*parts) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(_c(p), F.lit("")) for p in parts]))


def remote_type(*parts, policy: str = "A") -> Column:
    """Policy A: remote (hybrid if also hybrid) / on-site / unknown.
    Policy B: remote, then hybrid, then on-site. Policy C: remote, then hybrid."""
    t = _lower_join(*parts)
    onsite = t.contains("on-site") | t.contains("onsite")
    if policy == "A":
        return (F.when(t.contains("remote") & t.contains("hybrid"), "hybrid")
                .when(t.contains("remote"), "remote").when(onsite, "onsite").otherwise("unknown"))
    if policy == "B":
        return (F.when(t.contains("remote"), "remote").when(t.contains("hybrid"), "hybrid")
                .when(onsite, "onsite").otherwise("unknown"))
    if policy == "C":
        return F.when(t.contains("remote"), "remote").when(t.contains("hybrid"), "hybrid") \
            .otherwise("unknown")
    raise ValueError(f"unknown remote policy {policy!r}")


def employment_type(*parts, policy: str = "default_full") -> Column:
    """Substring rules in order intern / contract / part-time.

    default_full: else full_time (most boards). explicit: full-time needed, else unknown
    (Lever). workday: explicit, and "temporary" also means contract. short: intern /
    contract / full_time only (aggregator and search cards)."""
    t = _lower_join(*parts)
    part = t.contains("part-time") | t.contains("part time")
    full = t.contains("full-time") | t.contains("full time")
    if policy == "short":
        return F.when(t.contains("intern"), "internship").when(t.contains("contract"), "contract") \
            .otherwise("full_time")
    contract = t.contains("contract")
    if policy == "workday":
        contract = contract | t.contains("temporary")
    e = F.when(t.contains("intern"), "internship").when(contract, "contract").when(part, "part_time")
    if policy == "default_full":
        return e.otherwise("full_time")
    if policy in ("explicit", "workday"):
        return e.when(full, "full_time").otherwise("unknown")
    raise ValueError(f"unknown employment policy {policy!r}")


def is_job_url(url) -> Column:
    u = F.lower(F.coalesce(_c(url), F.lit("")))
    return ~reduce(lambda a, b: a | b, [u.rlike(p) for p in NON_JOB_URL_PATTERNS])


def title_from_url(url) -> Column:
    """Last non-empty path part, [-_]+ -> space, drop a trailing .ext, null if shorter
    than 5 chars or all digits, then title case (first letter of each word upper)."""
    segs = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    last = F.try_element_at(segs, F.lit(-1))
    t = F.regexp_replace(last, r"[-_]+", " ")
    t = F.regexp_replace(t, r"\.\w+$", "")
    bad = (F.size(segs) == 0) | (F.length(t) < 5) | t.rlike(r"^\d+$")
    return F.when(bad, F.lit(None).cast("string")).otherwise(py_title(t))


def py_title(t) -> Column:
    """Python str.title(): upper after any non-letter, lower elsewhere."""
    low = F.lower(_c(t))
    # Split into letter runs and the rest, capitalise each letter run.
    # Fixed value: the one common letter whose title case differs from its upper case.
    def first(s):
        c = F.substring(s, 1, 1)
        return F.when(c == "ß", F.lit("Ss")).otherwise(F.upper(c))
    any_text = F.array_join(
        F.transform(F.regexp_extract_all(low, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1),
                    lambda s: F.concat(first(s), F.substring(s, 2, 1 << 30))),
        "")
    # Plain words (most enum values and many titles) need no run list: there both agree.
    return F.when(_c(t).rlike(r"\A[A-Za-z ]*\z"), F.initcap(_c(t))).otherwise(any_text)

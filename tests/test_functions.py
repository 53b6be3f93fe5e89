"""Column functions: ids, text, time, classification, URL helpers, report formatting."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from jobmill.functions import classify as C
from jobmill.functions import text as X
from jobmill.functions import timeutil as TU
from jobmill.operators import reports


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names)) if cols \
        else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_posting_id(spark):
    got = one(spark, X.posting_id(), company="Acme", source_system="lever", source_job_id="7")
    assert got == hashlib.sha256(b"Acme:lever:7").hexdigest()[:16]


def test_searchable_text(spark):
    df = spark.createDataFrame([("T", "", ["a", "b"], "D")],
                               "title string, description_text string, requirements array<string>, department string")
    assert df.select(X.searchable_text()).first()[0] == "T a b D"


def test_normalize_unicode(spark):
    assert one(spark, X.normalize_text("t"), t="  Héllo,   Wörld!! c++  ") == "héllo wörld c"


def test_strip_html(spark):
    assert one(spark, X.strip_html("h"), h="<p>Hi <b>there</b></p>\n<script>x()</script>") == "Hi there x()"


def test_hamming_and_similarity(spark):
    df = spark.createDataFrame([(0, 0b1111111111), (0, 0b111111111)], "a long, b long")
    got = [r[0] for r in df.select(X.hamming("a", "b")).collect()]
    assert got == [10, 9]
    sims = [r[0] for r in df.select(X.simhash_similarity("a", "b")).collect()]
    assert sims[1] >= 0.85 > sims[0]


@pytest.mark.parametrize("spec,delta", [("24h", dt.timedelta(hours=24)), (" 7D ", dt.timedelta(days=7)),
                                        ("2w", dt.timedelta(weeks=2)), ("1m", dt.timedelta(days=30))])
def test_parse_lookback(spec, delta):
    assert TU.parse_lookback(spec) == delta


def test_parse_lookback_bad():
    with pytest.raises(ValueError):
        TU.parse_lookback("3y")


def test_freshness_and_recency(spark):
    as_of = dt.datetime(2025, 1, 31)
    ts = [None, as_of + dt.timedelta(hours=1), as_of - dt.timedelta(hours=1), as_of - dt.timedelta(days=2),
          as_of - dt.timedelta(days=5), as_of - dt.timedelta(days=25), as_of - dt.timedelta(days=30)]
    df = spark.createDataFrame([(t,) for t in ts], "p timestamp")
    got = df.select(TU.freshness_label("p", as_of).alias("l"), TU.recency_score("p", as_of).alias("r")).collect()
    labels = [g["l"] for g in got]
    assert labels == [TU.FRESHNESS_UNKNOWN, TU.FRESHNESS_LABELS[0], TU.FRESHNESS_LABELS[0], TU.FRESHNESS_LABELS[1],
                      TU.FRESHNESS_LABELS[2], TU.FRESHNESS_LABELS[3], TU.FRESHNESS_LABELS[4]]
    r = [g["r"] for g in got]
    assert r[0] == 0.5 and r[1] == 1.0 and r[2] > 0.9 and r[5] < 0.3 and r[6] == 0.0


def test_parse_iso_and_epoch(spark):
    assert str(one(spark, TU.parse_iso(F.col("s")), s="2025-01-15T10:00:00Z")) == "2025-01-15 10:00:00"
    assert one(spark, TU.parse_iso(F.col("s")), s="yesterday") is None
    assert str(one(spark, TU.from_epoch_millis(F.lit(1736899200000)))) == "2025-01-15 00:00:00"


@pytest.mark.parametrize("url,ats", [
    ("https://boards.greenhouse.io/acme", "greenhouse"), ("https://jobs.lever.co/beta", "lever"),
    ("https://acme.wd5.myworkdayjobs.com/External", "workday"), ("https://jobs.ashbyhq.com/x", "ashby"),
    ("https://careers.smartrecruiters.com/Co", "smartrecruiters"), ("https://example.com/jobs?x=lever.co", "unknown")])
def test_ats_from_url(spark, url, ats):
    assert one(spark, C.ats_from_url("u"), u=url) == ats


def test_ats_detect_confidence(spark):
    r = one(spark, C.ats_detect(F.col("u"), F.col("h")), u="https://example.com/careers",
            h='<iframe id="grnhse_app"></iframe>')
    assert (r["ats"], r["confidence"]) == ("greenhouse", 0.7)
    r = one(spark, C.ats_detect(F.col("u"), F.col("h")), u="https://example.com/careers", h="")
    assert (r["ats"], r["confidence"]) == ("unknown", 0.0)


def test_board_slugs_and_workday(spark):
    assert one(spark, C.board_slug("u", "greenhouse"), u="https://job-boards.greenhouse.io/acme?x=1") == "acme"
    assert one(spark, C.board_slug("u", "lever"), u="https://example.com/") is None
    w = one(spark, C.workday_info("u"), u="https://acme.wd5.myworkdayjobs.com/Careers/job/1")
    assert (w["company"], w["api_base"], w["site"]) == \
        ("acme", "https://acme.wd5.myworkdayjobs.com/wday/cxs/acme", "Careers")
    w = one(spark, C.workday_info("u"), u="https://wd3-beta.myworkday.com/")
    assert (w["company"], w["api_base"], w["site"]) == ("beta", None, "External")


@pytest.mark.parametrize("title,loc,policy,expected", [
    ("Engineer", "Remote (Hybrid)", "A", "hybrid"), ("Engineer", "San Francisco (Hybrid)", "A", "unknown"),
    ("Engineer", "On-site NYC", "A", "onsite"), ("Engineer", "Hybrid remote", "B", "remote"),
    ("Engineer", "Hybrid", "B", "hybrid"), ("Engineer", "onsite", "C", "unknown")])
def test_remote_policies(spark, title, loc, policy, expected):
    assert one(spark, C.remote_type(F.col("t"), F.col("l"), policy=policy), t=title, l=loc) == expected


@pytest.mark.parametrize("text,policy,expected", [
    ("Internal Tools Engineer", "default_full", "internship"), ("Contract Designer", "default_full", "contract"),
    ("Part-time Tutor", "default_full", "part_time"), ("Engineer", "default_full", "full_time"),
    ("Engineer", "explicit", "unknown"), ("Engineer Full-time", "explicit", "full_time"),
    ("Analyst temporary", "workday", "contract"), ("Part time clerk", "short", "full_time")])
def test_employment_policies(spark, text, policy, expected):
    assert one(spark, C.employment_type(F.col("t"), policy=policy), t=text) == expected


@pytest.mark.parametrize("url,expected", [
    ("https://x.com/jobs/senior-data_engineer.html", "Senior Data Engineer"),
    ("https://x.com/jobs/12345", None), ("https://x.com/a/abc", None),
    ("https://x.com/o/o'neil-role", "O'Neil Role")])
def test_title_from_url(spark, url, expected):
    assert one(spark, C.title_from_url("u"), u=url) == expected


def test_is_job_url_and_source_label(spark):
    assert one(spark, C.is_job_url("u"), u="https://x.com/about/jobs") is False
    assert one(spark, C.is_job_url("u"), u="https://x.com/jobs/1.PDF") is False
    assert one(spark, C.is_job_url("u"), u="https://x.com/jobs/1") is True
    assert one(spark, C.source_label("u"), u="https://www.LinkedIn.com/jobs/view/1") == "linkedin"


def test_percent_rounds_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (0.8,)], "s double")
    got = [r[0] for r in df.select(reports.percent("s")).collect()]
    assert got == [f"{0.125:.0%}", f"{0.135:.0%}", f"{0.8:.0%}"]


def test_priority_and_tags(spark):
    df = spark.createDataFrame([(0.8, "remote"), (0.6, "onsite"), (0.59, "remote")], "final_score double, remote_type string")
    got = df.select(reports.priority(), reports.tags()).collect()
    assert [g[0] for g in got] == ["high", "default", "low"]
    assert [g[1] for g in got] == [["briefcase", "house", "star"], ["briefcase"], ["briefcase", "house"]]

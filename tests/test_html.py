"""HTML sources on hand-written pages."""

import datetime as dt

from jobmill.sources import html

AT = dt.datetime(2025, 1, 1)

CAREERS = """<html><body>
<a href="/jobs/backend-engineer">Backend Engineer</a>
<div>Location: Austin, TX</div>
<a href="https://other.example.org/careers/data-scientist-intern">Apply</a>
<a href="/jobs/backend-engineer">Backend Engineer (again)</a>
<a href="/about/jobs">About our jobs</a>
<a href="/apply/12345">Go</a>
<a href='/positions/team-lead.pdf'>PDF</a>
</body></html>"""


def test_career_page_links(spark):
    pages = spark.createDataFrame([(1, "https://acme.example.com/company/careers", CAREERS)],
                                  "page_id long, url string, html string")
    got = {r["apply_url"]: r.asDict() for r in html.career_page_links(pages, company="Acme").collect()}
    # /apply/12345 has a too-short anchor text ("Go"): its title comes from the anchor
    # just before it; /about/... and .pdf links are not job URLs
    assert set(got) == {"https://acme.example.com/jobs/backend-engineer",
                        "https://other.example.org/careers/data-scientist-intern",
                        "https://acme.example.com/apply/12345"}
    assert got["https://acme.example.com/apply/12345"]["title"] == "About our jobs"
    be = got["https://acme.example.com/jobs/backend-engineer"]
    assert be["title"] == "Backend Engineer" and be["location"] == "Austin, TX" and be["company"] == "Acme"
    ds = got["https://other.example.org/careers/data-scientist-intern"]
    assert ds["title"] == "Data Scientist Intern" and ds["employment_type"] == "internship"
    assert len(ds["source_job_id"]) == 12


def test_relative_url_join(spark):
    df = spark.createDataFrame([("https://a.com/x/y/z.html", "rel/p"), ("https://a.com/x/", "//cdn.io/a"),
                                ("https://a.com/x/y", "?q=1"), ("https://a.com", "/r")], "b string, h string")
    got = [r[0] for r in df.select(html.absolute_url("b", "h")).collect()]
    assert got == ["https://a.com/x/y/rel/p", "https://cdn.io/a", "https://a.com/x/y?q=1", "https://a.com/r"]


SEARCH = """<div><a class="result__a" href="https://www.linkedin.com/jobs/view/1">Data Engineer at  Acme</a>
<a class="result__a" href="https://blog.example.com/x">Not a job</a>
<a class="result__a" href="https://boards.greenhouse.io/b/jobs/2">ML Engineer - Beta Inc</a>
<a class="result__a" href="https://www.indeed.com/viewjob?jk=3">Cook</a></div>"""


def test_search_results(spark):
    pages = spark.createDataFrame([(1, SEARCH)], "page_id long, html string")
    got = [(r["title"], r["company"]) for r in html.search_results(pages, "US", AT).orderBy("_pos").collect()]
    assert got == [("Data Engineer", "Acme"), ("ML Engineer", "Beta Inc"), ("Cook", "Unknown")]


CARDS = "".join(
    f'<div data-jk="jk{i}" class="card"><h2 class="jobTitle x"><span title="t">Role {i} Remote</span></h2>'
    f'<span class="companyName">Co {i}</span><div class="companyLocation">City {i}</div></div>'
    for i in range(22))


def test_search_cards_first_20(spark):
    pages = spark.createDataFrame([(1, CARDS)], "page_id long, html string")
    assert html.search_cards(pages, AT).count() == 22          # every card of a page
    out = html.search_cards(pages, AT, per_page=20).collect()
    assert len(out) == 20 and out[0]["remote_type"] == "remote"
    assert {r["source_job_id"] for r in out} == {f"jk{i}" for i in range(20)}


AGG1 = ('<ul><li><a href="/jobs/view/111?trk=x">  Data  Engineer </a></li>'
        '<li><a href="https://www.linkedin.com/jobs/view/222">Hybrid Analyst</a></li>'
        '<li><a href="/jobs/view/111">Data Engineer II</a></li></ul>')
AGG2 = ('<code>{"included": [{"entityUrn": "urn:li:fsd_jobPosting:333", "title": {"text": "SRE"}},'
        '{"entityUrn": "urn:li:fsd_jobPosting:333", "title": "SRE", "primaryDescription": {"text": "Gamma"}},'
        '{"entityUrn": "urn:li:company:9"}]}</code><p>jobPosting:444</p>')
AGG3 = '<p>urn:li:jobPosting:555 and jobPostingCard(666) and jobPosting:555</p>'


def test_aggregator_strategies(spark):
    pages = spark.createDataFrame([(1, AGG1), (2, AGG2), (3, AGG3)], "page_id long, html string")
    got = {(r["page_id"], r["source_job_id"]): r.asDict() for r in html.aggregator_jobs(pages, AT).collect()}
    assert set(got) == {(1, "111"), (1, "222"), (2, "333"), (3, "555"), (3, "666")}
    assert got[(1, "111")]["title"] == "Data Engineer II"          # last anchor per id wins
    assert got[(1, "222")]["remote_type"] == "hybrid"
    assert got[(2, "333")]["company"] == "Gamma" and got[(2, "333")]["strategy"] == 2
    assert got[(3, "555")]["title"] == "LinkedIn Job" and got[(3, "555")]["company"] == "Unknown"


def test_search_cards_sql_twin_agrees(spark):
    import duckdb

    from jobmill.plans import queries as Q
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT 1::BIGINT AS page_id, ?::VARCHAR AS html", [CARDS])
    sql_rows = sorted(con.execute(Q.ORACLE["search_cards"]).fetchall())
    pages = spark.createDataFrame([(1, CARDS)], "page_id long, html string")
    sp = html.search_cards(pages, AT).select("page_id", "source_job_id", "title", "company", "location")
    assert sorted(tuple(r) for r in sp.collect()) == sql_rows


def test_title_from_preceding_anchor_and_first_by_url(spark):
    page = ('<a href="/x">Senior Data Engineer</a> <a href="/jobs/4711">Go</a>')
    pages = spark.createDataFrame([(1, "https://a.io/", page)], "page_id long, url string, html string")
    got = {r["apply_url"]: r["title"] for r in html.career_page_links(pages).collect()}
    assert got["https://a.io/jobs/4711"] == "Senior Data Engineer"
    res = spark.createDataFrame([(2, 0, "u1"), (1, 5, "u1"), (1, 7, "u2")], "page_id long, _pos int, url string")
    assert sorted((r["url"], r["page_id"], r["_pos"]) for r in html.first_by_url(res).collect()) == \
        [("u1", 1, 5), ("u2", 1, 7)]


def test_aggregator_sql_twin_agrees(spark):
    import duckdb

    from jobmill.plans import queries as Q
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES (1::BIGINT, ?::VARCHAR), (2::BIGINT, ?::VARCHAR), "
                "(3::BIGINT, ?::VARCHAR)) t(page_id, html)", [AGG1, AGG2, AGG3])
    sql_rows = sorted(con.execute(Q.ORACLE["aggregator_jobs"]).fetchall())
    pages = spark.createDataFrame([(1, AGG1), (2, AGG2), (3, AGG3)], "page_id long, html string")
    sp = html.aggregator_jobs(pages, AT).select("page_id", "strategy", "source_job_id", "title", "company")
    assert sorted(tuple(r) for r in sp.collect()) == sql_rows


def test_link_with_regex_quotes(spark):
    """An href that holds \\E must not end the quoting of its own pattern."""
    page = '<a href="https://x.com/jobs/a\\Eb-1234567">Senior (data) engineer</a>'
    pages = spark.createDataFrame([(1, "https://x.com/", page)], "page_id long, url string, html string")
    out = html.career_page_links(pages, link_patterns=['href="([^"]*jobs[^"]*)"']).collect()
    assert [r["title"] for r in out] == ["Senior (data) engineer"]


def test_cards_around_anchors():
    """The element tree against markup that is open, nested, void or broken."""
    from jobmill.sources.cards import cards
    page = ('<div><ul><li><div class="c"><p><a href="/jobs/view/1?x=1"> A <b>B</b></a><br>'
            '<i class="z base-search-card__subtitle"> Co &amp; <em>Sons</em></i></div>'
            '<span class="job-search-card__location"> Rome<img src=x></span></li>'
            '<li><a HREF="https://x.io/jobs/view/22">C</a><span class="base-search-card__metadata">Oslo</li>'
            '<li><div><a href="/jobs/view/">none</a></div><a href="/jobs/view/1">again</a></li></ul>'
            '<a href="/jobs/view/3" class=job-card-list__company-name>Last</a></p></span>'
            '<h4 class="job-card-list__company-name">Open')
    got = {c["job_id"]: (c["title"], c["company"], c["location"]) for c in cards(page)}
    # the last anchor of id 1 stands in the third item, which has neither; its outer div is the page's
    assert got["1"] == ("again", "Co &Sons", "") and got["22"] == ("C", "Co &Sons", "Oslo")
    assert got["3"] == ("Last", "Co &Sons", "Rome")
    assert cards("") == [] and cards("<a href='/jobs/view/x'>") == []
    assert cards("<a href=/jobs/view/5>" + "<div>" * 3000)[0]["job_id"] == "5"


def test_union_by_url(spark):
    a = spark.createDataFrame([(1, 0, "u1"), (1, 1, "u2")], "page_id long, _pos int, url string")
    b = spark.createDataFrame([(0, 0, "u2"), (0, 1, "u3"), (0, 0, "u3")], "page_id long, _pos int, url string")
    got = sorted((r["url"], r["variant"], r["page_id"], r["_pos"]) for r in html.union_by_url([a, b]).collect())
    assert got == [("u1", 0, 1, 0), ("u2", 0, 1, 1), ("u3", 1, 0, 0)]


def test_page_readers_do_not_shuffle(spark):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    for out in (html.aggregator_jobs(pages, AT), html.career_page_links(pages), html.search_cards(pages, AT)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    # the links leave the page's row without the page
    rows = html.career_page_links(pages)._jdf.queryExecution().executedPlan().toString()
    assert "_html" not in rows[:rows.index("Generate")]

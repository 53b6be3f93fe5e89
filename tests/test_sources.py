"""Source readers on hand-written landed payloads (shapes of the job-board APIs)."""

import os

from pyspark.sql import functions as F

from jobmill.operators.filters import company_filter
from jobmill.sources import ats

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def rows(df, *cols):
    return {r["source_job_id"]: r.asDict() for r in df.select("source_job_id", *cols).collect()}


def test_greenhouse(spark):
    df = ats.read_greenhouse(spark, f"{FIX}/greenhouse")
    r = rows(df, "company", "title", "location", "remote_type", "employment_type", "department",
             "posted_at", "apply_url", "source_url", "id")
    assert set(r) == {"501", "502", "503"}            # the record without id is dropped
    assert r["501"]["company"] == "Acme"
    assert r["501"]["remote_type"] == "remote" and r["501"]["employment_type"] == "internship"
    assert r["501"]["department"] == "Data"
    assert str(r["501"]["posted_at"]) == "2025-03-01 12:00:00"
    assert r["503"]["posted_at"] is None              # bad date -> null, record kept
    assert r["503"]["location"] == "Denver, CO"       # scalar location
    assert r["503"]["apply_url"] == "https://boards.greenhouse.io/acme" == r["503"]["source_url"]
    assert len(r["501"]["id"]) == 16


def test_greenhouse_deny_filter(spark):
    df = ats.read_greenhouse(spark, f"{FIX}/greenhouse")
    cfg = spark.createDataFrame([("Acme", ["Senior"], [])], "name string, deny_filters array<string>, keyword_filters array<string>")
    kept = company_filter(df, cfg)
    assert sorted(r[0] for r in kept.select("source_job_id").collect()) == ["501", "502"]
    cfg2 = spark.createDataFrame([("Acme", [], ["intern"])], "name string, deny_filters array<string>, keyword_filters array<string>")
    assert [r[0] for r in company_filter(df, cfg2).select("source_job_id").collect()] == ["501"]


def test_lever(spark):
    r = rows(ats.read_lever(spark, f"{FIX}/lever"), "location", "remote_type", "employment_type",
             "department", "team", "apply_url", "posted_at")
    assert r["aa11"]["remote_type"] == "remote" and r["aa11"]["employment_type"] == "full_time"
    assert r["aa11"]["apply_url"].endswith("/apply") and r["aa11"]["team"] == "API"
    assert r["bb22"]["location"] is None and r["bb22"]["team"] is None
    assert r["bb22"]["employment_type"] == "internship"
    assert r["bb22"]["apply_url"] == "https://jobs.lever.co/beta/bb22"     # hosted URL fallback
    assert r["cc33"]["employment_type"] == "contract" and r["cc33"]["department"] is None
    assert str(r["aa11"]["posted_at"]) == "2025-03-01 00:00:00"


def test_lever_non_array_payload_gives_nothing(spark, tmp_path):
    d = tmp_path / "company=X" / "board=x"
    d.mkdir(parents=True)
    (d / "p.json").write_text('{"ok": false}')
    assert ats.read_lever(spark, str(tmp_path)).count() == 0


def test_ashby(spark):
    r = rows(ats.read_ashby(spark, f"{FIX}/ashby"), "remote_type", "employment_type", "department",
             "apply_url", "posted_at")
    assert r["g-1"]["remote_type"] == "hybrid"                 # location says hybrid
    assert r["g-2"]["remote_type"] == "remote" and r["g-2"]["employment_type"] == "contract"
    assert r["g-3"]["remote_type"] == "unknown" and r["g-3"]["department"] == "Sales"
    assert r["g-1"]["apply_url"] == "https://jobs.ashbyhq.com/gamma/g-1"
    assert r["g-3"]["posted_at"] is None


def test_smartrecruiters(spark):
    r = rows(ats.read_smartrecruiters(spark, f"{FIX}/smartrecruiters"), "location", "department",
             "employment_type", "remote_type", "apply_url")
    assert set(r) == {"REF-9", "712"}
    assert r["REF-9"]["location"] == "Paris, fr" and r["REF-9"]["department"] == "d1"
    assert r["REF-9"]["employment_type"] == "part_time"      # 'part' in 'Partner' (kept quirk)
    assert r["712"]["location"] is None and r["712"]["department"] == "R&D"
    assert r["712"]["employment_type"] == "internship" and r["712"]["remote_type"] == "remote"
    assert r["REF-9"]["apply_url"] == "https://jobs.smartrecruiters.com/DeltaCo/REF-9"


def test_workday(spark):
    df = ats.read_workday(spark, f"{FIX}/workday", api_base="https://eps.wd5.myworkdayjobs.com/wday/cxs/eps",
                          site="External")
    assert df.count() > 2                                                 # every landed page
    df = ats.read_workday(spark, f"{FIX}/workday", api_base="https://eps.wd5.myworkdayjobs.com/wday/cxs/eps",
                          site="External", max_offset=500)
    r = rows(df, "apply_url", "source_url", "location", "remote_type", "employment_type", "posted_at")
    assert set(r) == {"Staff-Engineer_R100", "Temporary-Analyst_R101"}    # offset 500 page left out
    a = r["Staff-Engineer_R100"]
    assert a["apply_url"] == "https://eps.wd5.myworkdayjobs.com/eps/External/job/Remote-US/Staff-Engineer_R100"
    assert a["remote_type"] == "remote" and a["employment_type"] == "full_time" and a["posted_at"] is None
    b = r["Temporary-Analyst_R101"]
    assert b["employment_type"] == "contract" and b["location"] is None
    assert str(b["posted_at"]) == "2025-03-03 00:00:00"


def test_stored_postings_defaults(spark):
    jobs = spark.createDataFrame([("1", None, None, None, None)],
                                 "id string, company string, remote_type string, employment_type string, source_system string")
    r = ats.read_stored_postings(jobs).first()
    assert (r["company"], r["remote_type"], r["employment_type"]) == ("Unknown", "unknown", "unknown")


def test_companies_skip_unreadable(spark, tmp_path):
    p = tmp_path / "companies.json"
    p.write_text('{"name": "A", "career_urls": ["https://jobs.lever.co/a"]}\n{not json\n')
    df = ats.read_companies(spark, str(p))
    assert [r["name"] for r in df.collect()] == ["A"]
    assert F is not None


def test_raw_keeps_undeclared_fields(spark, tmp_path):
    import json
    job = {"id": 7, "title": "T", "absolute_url": "https://x.io/7", "pay": {"min": 1, "steps": [1, None, {"a": "é"}]}, "new": True}
    d = tmp_path / "company=X" / "board=x"
    d.mkdir(parents=True)
    (d / "p.json").write_text(json.dumps({"jobs": [job, 5, None, {"id": [1], "title": {"t": 1}}], "meta": 1}))
    out = ats.read_greenhouse(spark, str(tmp_path)).collect()
    assert [r["source_job_id"] for r in out][:1] == ["7"] and json.loads(out[0]["raw"]) == job
    (d / "p.json").write_text("{not json")
    assert ats.read_greenhouse(spark, str(tmp_path)).count() == 0


SYSTEM_FIXTURES = ["greenhouse", "lever", "ashby", "smartrecruiters", "workday"]


def test_sources_read_through_the_data_source(spark, tmp_path):
    """The data source and Spark's text reader give the same postings; one partition per file."""
    from jobmill.sources import plug
    for system in SYSTEM_FIXTURES:
        path = f"{FIX}/{system}"
        given = {"api_base": "https://acme.wd5.myworkdayjobs.com/wday/cxs/acme", "site": "careers"} if system == "workday" else {}
        files = sum(len(f) for _, _, f in os.walk(path))
        a = sorted(map(str, plug.read_board(spark, system, path, **given).drop("raw").collect()))
        src = plug.read_board(spark, system, path, by="source", **given)
        assert sorted(map(str, src.drop("raw").collect())) == a and a, system
        raw = spark.read.format("job_board").option("path", path).load()
        assert raw.count() == files and raw.rdd.getNumPartitions() == files


def test_plug_in_another_source(spark, tmp_path):
    import pytest

    from jobmill.schema import conform
    from jobmill.sources import plug

    def parse(f):
        j = F.from_json("value", "title string, n string")
        return conform(f.select("company", j["title"].alias("title"), j["n"].alias("source_job_id"), F.lit("own").alias("source_system"), F.col("value").alias("raw")))

    d = tmp_path / "system=own" / "company=A%20B"
    d.mkdir(parents=True)
    (d / "1.json").write_text('{"title": "One", "n": 1}')
    (d / ".hidden").write_text("x")
    other = tmp_path / "system=lever" / "company=C" / "board=c"
    other.mkdir(parents=True)
    (other / "p.json").write_text("[]")
    plug.add_system("own", parse)
    try:
        for by in ("files", "source"):
            path = str(tmp_path / "system=own") if by == "files" else str(tmp_path)
            (r,) = plug.read_board(spark, "own", path, by=by).collect()
            assert (r["company"], r["title"], r["source_job_id"]) == ("A B", "One", "1")
    finally:
        del plug.SYSTEMS["own"]
    with pytest.raises(ValueError):
        plug.read_board(spark, "own", str(tmp_path))
    (tmp_path / "none").mkdir()
    assert plug.read_board(spark, "lever", str(tmp_path / "none"), by="source").count() == 0


def test_tasks_follow_the_bytes_landed_not_the_boards(tmp_path):
    """2000 small files do not plan 2000 partitions, and every file lies in one of them."""
    from jobmill.sources import plug
    for i in range(2000):
        d = tmp_path / "system=lever" / f"company=C{i % 40}" / f"board=b{i}"
        d.mkdir(parents=True)
        (d / "p.json").write_text("[]")
    parts = plug._Reader(str(tmp_path), "lever", False).partitions()
    assert len(parts) <= 220
    rows = [r for p in parts for r in plug._Reader(str(tmp_path), "lever", False).read(p)]
    assert sorted(r[4] for r in rows) == sorted(f"b{i}" for i in range(2000)) and {r[0] for r in rows} == {"[]"}


def test_packed_payloads_read_as_single_files(spark, tmp_path, monkeypatch):
    """Landed as lines, the payloads give what single files give; files do not grow with the boards."""
    import json

    from jobmill.sources import plug
    pays = []
    for i in range(300):
        jobs = [{"id": f"L{i}-{j}", "text": f"Líne\n{j}\u2028x", "hostedUrl": "https://x.io/a", "new": {"n": j}} for j in range(i % 4)]
        pays.append(("lever", "007" if i == 5 else f"C {i}", f"b{i}", json.dumps(jobs, indent=1, ensure_ascii=i % 2 == 0)))
    pays.append(("lever", None, "b-none", '[{"id": "N", "hostedUrl": "https://x.io/n"}]'))
    pays.append(("lever", "bad", "b-bad", "{not json"))
    for _, company, board, value in pays[:300]:
        d = tmp_path / "single" / f"company={company}" / f"board={board}"
        d.mkdir(parents=True)
        (d / "p.json").write_text(value)
    plug.land_packed(spark.createDataFrame(pays, "system string, company string, board string, value string").repartition(3), str(tmp_path / "packed"))
    path = str(tmp_path / "packed" / "system=lever")
    assert len([f for f in os.listdir(path) if f.endswith(".json")]) <= 3
    cols = ["company", "source_job_id", "title", "apply_url", "raw"]
    single = {tuple(r) for r in plug.read_board(spark, "lever", str(tmp_path / "single"), by="source").select(*cols).collect()}
    got = [[tuple(r) for r in plug.read_board(spark, "lever", path, by=by, packed=True).select(*cols).collect()] for by in ("files", "source")]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and len(got[0]) == 451
    assert {r for r in got[0] if r[1] != "N"} == single and [r[0] for r in got[0] if r[1] == "N"] == [None]
    # ranges cut at any byte give every payload once
    monkeypatch.setattr(plug, "RANGE_BYTES", 97)
    reader = plug._Reader(path, None, True)
    rows = [r[0] for p in reader.partitions() for r in reader.read(p)]
    assert sorted(rows) == sorted(p[3] for p in pays)

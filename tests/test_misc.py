"""Readers, writers and plug points not covered elsewhere."""

import datetime as dt
import json

from pyspark.sql import functions as F

from jobmill.operators import dedup, profiles, reports, vectors
from jobmill.plans.scan import scan_report
from jobmill.sources import ats


def test_profiles_and_resumes(spark, tmp_path):
    p = tmp_path / "profiles.json"
    p.write_text(json.dumps({"profile": "me", "desired_roles": ["SRE"], "must_have_keywords": ["go"],
                             "must_not_keywords": [], "preferred_locations": [], "remote_preference": None,
                             "min_score_threshold": 0.3, "vector_weight": 0.55, "keyword_weight": 0.3,
                             "recency_weight": 0.15}) + "\n")
    assert ats.read_profiles(spark, str(p)).first()["desired_roles"] == ["SRE"]
    r = tmp_path / "resumes"
    r.mkdir()
    (r / "a.txt").write_text("Python and Docker.\nBackend engineer in Seattle, open to Remote.")
    res = ats.read_resumes(spark, str(r))
    row = profiles.profile_from_text(res.withColumn("name", F.lit("a")), "text", "name").first()
    assert row["desired_roles"] == ["Backend Engineer", "Backend Engineer Intern", "Backend Engineer Internship"]
    assert row["must_have_keywords"] == ["backend", "docker", "python"]
    assert row["preferred_locations"] == ["Seattle", "Remote"] and row["remote_preference"] == "remote"


def test_profile_with_embedding(spark):
    docs = spark.createDataFrame([(1, "data scientist with sql"), (2, "cook")], "id long, text string")
    emb = spark.createDataFrame([(1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    out = {r["profile"]: r for r in profiles.profile_with_embedding(docs, "text", "id", emb, "vec_id").collect()}
    assert out["1"]["resume_embedding"] == [0.5, 0.5] and out["2"]["resume_embedding"] == []
    assert out["2"]["desired_roles"] == profiles.DEFAULT_ROLES


def test_reports_written(spark, tmp_path):
    scored = spark.createDataFrame([("t", "c", 0.7, ["r"], "https://x", "L", dt.datetime(2025, 1, 1))],
                                   "title string, company string, final_score double, match_reasons array<string>, "
                                   "apply_url string, location string, posted_at timestamp")
    reports.write_json_report(reports.match_report(scored), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "summary")).first()["count"] == 1
    rep = scan_report(scored, dt.datetime(2025, 1, 1, 5)).first()
    assert rep["freshness"].endswith("New (today)")


def test_embed_plug_point_and_attach(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    out = vectors.embed_with(df, "text", lambda texts: [[float(len(t)), 1.0] for t in texts], dim=2)
    assert [r["embedding"] for r in out.orderBy("id").collect()] == [[2.0, 1.0], [4.0, 1.0]]
    table = spark.createDataFrame([(1, [1.0, 0.0])], "k long, embedding array<float>")
    att = vectors.attach_embeddings(df, "id", table, "k").orderBy("id").collect()
    assert att[0]["embedding"] == [1.0, 0.0] and att[1]["embedding"] is None


def test_no_provider_vector_match(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "id string, seq long")
    out = vectors.vector_match_without_provider(df, "seq", "id").orderBy("rank").collect()
    assert [(r["id"], r["rank"], r["similarity"]) for r in out] == [("a", 1, 0.5), ("b", 2, 0.5)]


def test_prefer_per_key(spark):
    df = spark.createDataFrame([("j1", "", 1), ("j1", "Acme", 2), ("j1", "Beta", 3)], "id string, company string, pos long")
    pref = F.struct((F.col("company") != "").alias("has"), (-F.col("pos")).alias("neg"))
    out = dedup.prefer_per_key(df, ["id"], pref).first()
    assert out["company"] == "Acme"


def test_caps_are_arguments(spark):
    """Nothing is cut unless a bound is given, or where the source tool's result is cut."""
    import pytest
    many = [f"r{i}" for i in range(15)]
    df = spark.createDataFrame([("t", "d", "l", "remote", "x" * 3000, many)],
                               "title string, department string, location string, remote_type string, description_text string, requirements array<string>")
    whole, cut = df.select(vectors.posting_embed_text(), vectors.posting_embed_text(description_chars=2000, max_requirements=10)).first()
    assert "x" * 3000 in whole and whole.endswith("r14") and "x" * 2001 not in cut and cut.endswith("r9")
    text = spark.createDataFrame([("a", " ".join(t for t in profiles.TECHNICAL_SKILLS if t.isalpha()))], "name string, text string")
    assert len(profiles.profile_from_text(text, "text", "name", max_skills=10).first()["must_have_keywords"]) == 10
    assert len(profiles.profile_from_text(text, "text", "name").first()["must_have_keywords"]) > 20
    with pytest.raises(Exception, match="vector of 3 numbers"):
        vectors.embed_with(text, "text", lambda texts: [[1.0, 2.0, 3.0] for _ in texts], dim=2).collect()


def test_match_scores_every_unseen_job(spark):
    from jobmill.store.jobs import unseen_top
    jobs = spark.range(130).selectExpr("id", "cast(id as double) as score", "cast(null as timestamp) as notified_at")
    assert unseen_top(jobs, None, None).count() == 130

"""Store semantics: upsert, versions, notifications, runs, companies."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobmill.store import jobs as st
from jobmill.store.changelog import ChangeLog

T0 = dt.datetime(2025, 1, 1)
T1 = dt.datetime(2025, 1, 2)


def postings(spark, rows):
    return spark.createDataFrame(rows, "id string, company string, source_job_id string, source_system string, "
                                       "title string, seq long")


def test_upsert_insert_then_update(spark):
    empty = spark.createDataFrame([], st.JOBS_SCHEMA)
    first, ch1 = st.upsert_frames(empty, postings(spark, [("a", "A", "1", "lever", "Old title", 1),
                                                          ("a", "A", "1", "lever", "Dup", 2)]), T0, "seq")
    assert [(r["id"], r["is_new"]) for r in ch1.collect()] == [("a", True)]
    r = first.first()
    assert (r["title"], r["score"], r["first_seen_at"], r["updated_at"]) == ("Old title", 0.0, T0, None)
    inc = postings(spark, [("a", "A", "1", "lever", "New title", 3), ("b", "B", "2", "lever", "B job", 4)]) \
        .withColumn("final_score", F.lit(0.7)).withColumn("keyword_score", F.lit(0.4))
    snap, ch2 = st.upsert_frames(first, inc, T1, "seq")
    got = {r["id"]: r.asDict() for r in snap.collect()}
    assert got["a"]["title"] == "Old title"                      # other fields are not refreshed
    assert got["a"]["score"] == 0.7 and got["a"]["keyword_score"] == 0.0
    assert got["a"]["updated_at"] == T1 and got["a"]["first_seen_at"] == T0
    assert got["b"]["score"] == 0.7 and got["b"]["keyword_score"] == 0.4 and got["b"]["first_seen_at"] == T1
    assert dict((r["id"], r["is_new"]) for r in ch2.collect()) == {"a": False, "b": True}


def test_change_log_versions_and_notify(spark, tmp_path):
    store = ChangeLog(spark, str(tmp_path / "store"))
    assert store.last_batch() == 0 and store.jobs().count() == 0
    totals = store.save(postings(spark, [("a", "A", "1", "lever", "t", 1), ("b", "B", "1", "lever", "t", 2)]), T0)
    assert totals == {"jobs_found": 2, "jobs_new": 2} and store.last_batch() == 1
    ids = spark.createDataFrame([("a",), ("zz",)], "id string")
    notes = store.notify(ids, "push", "topic", T1)
    assert [r["job_id"] for r in notes.collect()] == ["a"]       # only existing ids
    jobs = {r["id"]: r["notified_at"] for r in store.jobs().collect()}
    assert jobs == {"a": T1, "b": None} and store.last_batch() == 2
    assert store.versions().count() == 2 and store.notifications().count() == 1
    assert {r["name"]: r["company_id"] for r in store.companies().collect()}.keys() == {"A", "B"}
    unseen = st.unseen_top(store.jobs(), None, 10)
    assert [r["id"] for r in unseen.collect()] == ["b"]


def test_runs_latest(spark, tmp_path):
    store = ChangeLog(spark, str(tmp_path / "s2"))
    store.start_run(7, T0)
    store.complete_run(7, T1, {"jobs_found": 5, "jobs_new": 2})
    r = store.runs().first()
    assert (r["status"], r["jobs_found"], r["jobs_new"], r["started_at"], r["completed_at"]) == \
        ("completed", 5, 2, T0, T1)


def test_company_get_or_create(spark):
    existing = spark.createDataFrame([(1, "A", "{}")], "company_id long, name string, config_json string")
    names = spark.createDataFrame([("A",), ("B",), ("B",)], "name string")
    out = {r["name"]: r["company_id"] for r in st.company_upsert_frames(existing, names).collect()}
    assert out["A"] == 1 and set(out) == {"A", "B"}


def test_change_log_equals_upserts(spark, tmp_path):
    """Saves with and without scores, marks and compactions at any time: the folded log is what
    the frame functions give step by step, and a compaction changes nothing."""
    import random

    rnd = random.Random(3)
    for trial, compact_at in enumerate(({2, 5}, set())):
        store = ChangeLog(spark, str(tmp_path / f"log{trial}"))
        table = spark.createDataFrame([], st.JOBS_SCHEMA)
        for step in range(7):
            at = T0 + dt.timedelta(days=step)
            if step in (3, 6):
                ids = spark.createDataFrame([(f"i{rnd.randrange(60)}",) for _ in range(20)] + [("nobody",)], "id string")
                table, _ = st.mark_notified_frames(table, ids, "push", "t", at)
                store.notify(ids, "push", "t", at)
            else:
                rows = [(f"i{rnd.randrange(60)}", rnd.choice("AB"), str(k), "lever", f"t{step}", k,
                         *([rnd.random()] if step % 2 else [])) for k in range(25)]
                inc = spark.createDataFrame(rows, "id string, company string, source_job_id string, source_system string, title string, "
                                                  "seq long" + (", final_score double" if step % 2 else ""))
                known = {r["id"] for r in table.select("id").collect()}
                table, _ = st.upsert_frames(table, inc, at, order_col="seq")
                totals = store.save(inc, at, order_col="seq")
                ids = {r[0] for r in rows}
                assert totals == {"jobs_found": len(ids), "jobs_new": len(ids - known)}
            table = spark.createDataFrame(table.collect(), st.JOBS_SCHEMA)
            if step in compact_at:
                store.compact()
        key = lambda r: r["id"]
        assert sorted(store.jobs().collect(), key=key) == sorted(table.collect(), key=key)
        assert sorted(r["id"] for r in store.ids().collect()) == sorted(r["id"] for r in table.collect())


def test_change_log_writes_follow_the_batch(spark, tmp_path):
    store = ChangeLog(spark, str(tmp_path / "s3"))
    store.save(postings(spark, [(f"id{i}", "A", str(i), "lever", "t", i) for i in range(400)]), T0)
    store.save(postings(spark, [("id3", "A", "3", "lever", "t2", 99)]), T1)
    sizes = [sum(f.stat().st_size for f in (tmp_path / "s3" / "changes" / f"batch={n}").glob("*.parquet")) for n in (1, 2)]
    assert sizes[1] < sizes[0] and spark.read.parquet(str(tmp_path / "s3" / "changes" / "batch=2")).count() == 1
    got = {r["id"]: (r["updated_at"], r["title"]) for r in store.jobs().collect()}
    assert got["id3"] == (T1, "t") and got["id4"][0] is None and len(got) == 400
    # a write without Spark's success mark is not there yet; an unreadable one is an error
    (tmp_path / "s3" / "changes" / "batch=3").mkdir()
    (tmp_path / "s3" / "changes" / "batch=3" / "part-0.parquet").write_bytes(b"not parquet")
    assert store.last_batch() == 2 and store.jobs().count() == 400
    (tmp_path / "s3" / "changes" / "batch=3" / "_SUCCESS").write_bytes(b"")
    with pytest.raises(Exception):
        store.jobs().count()


def test_change_log_keeps_the_whole_payload(spark, tmp_path):
    store = ChangeLog(spark, str(tmp_path / "s4"))
    inc = spark.createDataFrame([("a", "A", '{"x":[1,{"y":null}],"title":"t"}', "1"), ("b", None, None, "2")],
                                "id string, company string, raw string, source_job_id string")
    store.save(inc, T0)
    assert {r["job_id"]: r["raw_json"] for r in store.versions().collect()} == {"a": '{"x":[1,{"y":null}],"title":"t"}', "b": "{}"}
    assert [r["name"] for r in store.companies().collect()] == ["A"]


def test_match_and_notify_flow(spark, tmp_path):
    from jobmill.operators.scoring import Profile
    from jobmill.plans.match import match, notify
    store = ChangeLog(spark, str(tmp_path / "flow"))
    inc = spark.createDataFrame(
        [("a", "Acme", "1", "lever", "Python Engineer", 1, 0.9), ("b", "Acme", "2", "lever", "Cook", 2, 0.8),
         ("c", "Beta", "3", "lever", "Python Intern", 3, 0.1)],
        "id string, company string, source_job_id string, source_system string, title string, seq long, "
        "final_score double")
    store.save(inc, T0)
    prof = Profile(profile="p", must_have_keywords=["python"], must_not_keywords=["intern"], min_score_threshold=0.4)
    got = [r["id"] for r in match(store.jobs(), None, [prof], T1, limit=2).collect()]
    # top-2 by stored score are a and b; match uses the command default threshold .3,
    # and b (no keyword, unknown date) scores .35
    assert got == ["a", "b"]
    msgs, digest, notes = notify(store, None, [prof], T1, limit=10)
    assert [r["id"] for r in msgs.collect()] == ["a"] and digest.first()["total"] == 1
    assert [r["job_id"] for r in notes.collect()] == ["a"]
    assert {r["id"]: r["notified_at"] for r in store.jobs().collect()}["a"] == T1
    assert [r["id"] for r in msgs.collect()] == ["a"]      # still the same after marking


AS_OF = dt.datetime(2025, 1, 10)


def _postings(spark, n, again=0):
    rows = spark.range(n + again).selectExpr(
        f"cast(id % {n} as string) as id", "concat('C', id % 7) as company", "concat('t', id) as title", "cast(id as string) as source_job_id",
        "'x' as source_system", "'here' as location", "id as seq")
    return rows.repartition(3)


def test_a_store_without_later_changes_is_read_without_a_shuffle(spark, tmp_path):
    """The rows that give a job's fields come as they are: no wide row is moved to be folded."""
    store = ChangeLog(spark, str(tmp_path / "s"))
    store.save(_postings(spark, 50), AS_OF, order_col="seq")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("SortMergeJoin", "SortAggregate") if x in plan(store.jobs())] and store.jobs().count() == 50
    store.compact()
    store.save(_postings(spark, 60), AS_OF + dt.timedelta(days=1), order_col="seq")
    some = store.jobs(columns=("id", "location"))
    assert some.columns == ["id", "location"] and some.count() == 60 and "Exchange" not in plan(some)
    late = store.jobs().where("updated_at is not null").count()
    assert late == 50 and store.jobs().count() == 60


def test_repeated_ids_are_told_apart_few_or_many(spark, tmp_path, monkeypatch):
    """The first arrival of each id is kept, whether the repeated ids are broadcast or all rows sorted."""
    from jobmill.store import jobs
    for limit in (100, 3):
        monkeypatch.setattr(jobs, "BROADCAST_ROW_LIMIT", limit)
        store = ChangeLog(spark, str(tmp_path / f"s{limit}"))
        totals = store.save(_postings(spark, 40, again=20), AS_OF, order_col="seq")
        assert totals == {"jobs_found": 40, "jobs_new": 40}
        assert {r["title"] for r in store.jobs().collect()} == {f"t{i}" for i in range(40)}


def test_the_raw_payload_is_made_after_the_row_has_moved(spark, tmp_path):
    from jobmill.store.changelog import save_rows
    rows = _postings(spark, 50)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = save_rows(rows, rows.select("id"), AS_OF, "seq")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.lower().replace("_", "").index("tojson") < plan.index("Join LeftOuter")

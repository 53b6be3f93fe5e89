"""Monitor stream: two micro-batches, seen-state across batches, outbox per batch."""

import datetime as dt

from pyspark.sql import functions as F

from jobmill.operators.scoring import Profile
from jobmill.store.changelog import ChangeLog
from jobmill.streaming.monitor import start_monitor

AS_OF = dt.datetime(2025, 1, 10)
SCHEMA = "sid string, title string, ts timestamp, n long"


def to_postings(raw):
    return raw.select(F.lit("Co").alias("company"), "title", F.col("sid").alias("source_job_id"),
                      F.lit("unknown").alias("source_system"), F.lit("https://x.io").alias("source_url"),
                      F.concat(F.lit("https://x.io/"), F.col("sid")).alias("apply_url"),
                      F.lit(None).cast("string").alias("location"), F.lit("unknown").alias("remote_type"),
                      F.lit("unknown").alias("employment_type"), F.lit(None).cast("string").alias("department"),
                      F.col("ts").alias("posted_at"), F.lit(None).cast("string").alias("description_text"),
                      F.array().cast("array<string>").alias("requirements"), F.col("n").alias("seq"))


def test_monitor_two_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows1 = [("s1", "python dev", AS_OF, 1), ("s1", "python dev copy", AS_OF, 2),
             ("s2", "cook", AS_OF - dt.timedelta(days=40), 3)]
    rows2 = [("s1", "python dev again", AS_OF, 4), ("s3", "python lead", AS_OF, 5)]
    spark.createDataFrame(rows1, SCHEMA).coalesce(1).write.parquet(str(src / "b1"))
    spark.createDataFrame(rows2, SCHEMA).coalesce(1).write.parquet(str(src / "b2"))
    store = ChangeLog(spark, str(tmp_path / "store"))
    prof = Profile(profile="p", must_have_keywords=["python"], min_score_threshold=0.3)
    schema = spark.read.parquet(str(src / "b1")).schema
    q = start_monitor(spark, str(src / "b*"), schema, to_postings, store=store, profile=prof, as_of=AS_OF,
                      lookback="30d", checkpoint=str(tmp_path / "ckpt"), available_now=True,
                      max_files_per_trigger=1)
    q.awaitTermination()
    assert q.exception() is None
    jobs = {r["source_job_id"]: r["title"] for r in store.jobs().collect()}
    # s1 stored once (first arrival); s2 outside the lookback; s3 new in batch 2 or 1
    assert jobs == {"s1": "python dev", "s3": "python lead"}
    outbox = spark.read.parquet(str(tmp_path / "store" / "outbox"))
    assert outbox.count() == 2
    assert sorted(r[0] for r in outbox.select("batch_id").distinct().collect()) == [0, 1]


def test_monitor_near_dup_state_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    b1 = [("s1", "python developer backend services", AS_OF, 1)]
    b2 = [("s2", "python developer backend services", AS_OF, 2),      # same text, new id: near-dup
          ("s3", "python chef for a restaurant kitchen", AS_OF, 3)]
    spark.createDataFrame(b1, SCHEMA).coalesce(1).write.parquet(str(src / "b1"))
    spark.createDataFrame(b2, SCHEMA).coalesce(1).write.parquet(str(src / "b2"))
    store = ChangeLog(spark, str(tmp_path / "store"))
    prof = Profile(profile="p", must_have_keywords=["python"], min_score_threshold=0.0)
    schema = spark.read.parquet(str(src / "b1")).schema
    q = start_monitor(spark, str(src / "b*"), schema, to_postings, store=store, profile=prof, as_of=AS_OF,
                      lookback=None, checkpoint=str(tmp_path / "ckpt"), available_now=True, near_dup=True,
                      max_files_per_trigger=1)
    q.awaitTermination()
    assert q.exception() is None
    got = {r["source_job_id"] for r in store.jobs().collect()}
    # titles are the texts; location is null for all, so s2 collapses into s1 when the
    # batches run separately (state) or together (one fold)
    assert got == {"s1", "s3"}


def test_replayed_batch_is_idempotent(spark, tmp_path):
    from jobmill.streaming.monitor import process_batch
    store = ChangeLog(spark, str(tmp_path / "store"))
    prof = Profile(profile="p", must_have_keywords=["python"], min_score_threshold=0.3)
    batch = to_postings(spark.createDataFrame([("s9", "python dev", AS_OF, 1)], SCHEMA))
    kw = dict(store=store, profile=prof, as_of=AS_OF, topic="t", order_col="seq", outbox_root=str(tmp_path / "outbox"), base=0)
    process_batch(batch, 0, **kw)
    process_batch(batch, 0, **kw)                    # replay of the same micro-batch
    assert store.jobs().count() == 1 and store.versions().count() == 1 and store.companies().count() == 1
    assert store.changes().first()["is_new"]
    assert spark.read.parquet(str(tmp_path / "outbox")).count() == 1


def land(spark, src, files):
    """One parquet file per list of rows, in arrival order."""
    src.mkdir(exist_ok=True)
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(src / f"b{k}"))
    return spark.read.parquet(str(src / "b0")).schema


def run(spark, tmp_path, schema, store, prof, **more):
    q = start_monitor(spark, str(tmp_path / "in" / "b*"), schema, to_postings, store=store, profile=prof,
                      checkpoint=str(tmp_path / "ckpt"), available_now=True, max_files_per_trigger=1, **more)
    q.awaitTermination()
    assert q.exception() is None
    return q


def test_state_follows_the_batch_over_a_filled_store(spark, tmp_path):
    """Four micro-batches over a store with 300 jobs: stored and seen ids stay out, also with
    a smaller order number, and after a restart; a later batch writes its own entries only."""
    store = ChangeLog(spark, str(tmp_path / "store"))
    old = to_postings(spark.createDataFrame([(f"k{i}", "python old", AS_OF, i) for i in range(300)], SCHEMA))
    from jobmill.functions.text import posting_id
    store.save(old.withColumn("id", posting_id()), AS_OF, order_col="seq")
    schema = land(spark, tmp_path / "in", [
        [(f"s{i}", "python one", AS_OF, 1000 + i) for i in range(200)] + [("k7", "python stored", AS_OF, 1)],
        [("s5", "python again", AS_OF, 2), ("n1", "python new b", AS_OF, 2002), ("n1", "python new a", AS_OF, 2001)],
        [("n2", "python two", AS_OF, 2003), (None, "python none", AS_OF, 2004)],
        [("n1", "python late", AS_OF, 1), (None, "python none again", AS_OF, 2005), ("n3", "cook", AS_OF, 2006)]])
    prof = Profile(profile="p", must_have_keywords=["python"], min_score_threshold=0.5)
    q = run(spark, tmp_path, schema, store, prof, as_of=AS_OF, lookback="30d")
    new = {r["source_job_id"]: r["title"] for r in store.jobs().where("source_job_id is null or not source_job_id like 'k%'").collect()}
    assert len(store.jobs().collect()) == 300 + len(new)
    assert new == {**{f"s{i}": "python one" for i in range(200)}, "n1": "python new a", "n2": "python two", None: "python none"}
    states = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert states[0]["numRowsUpdated"] == 501 - 1 and max(s["numRowsUpdated"] for s in states[1:4]) <= 3
    assert states[-1]["numRowsTotal"] >= 503
    sizes = sorted((f.stat().st_mtime_ns, f.stat().st_size) for f in (tmp_path / "ckpt" / "state").rglob("*.delta"))
    first, last = sizes[:len(sizes) // 4], sizes[-len(sizes) // 4:]
    assert sum(s for _, s in last) < 0.2 * sum(s for _, s in first)
    # a restart goes on from the state: nothing new
    before = store.last_batch()
    run(spark, tmp_path, schema, store, prof, as_of=AS_OF, lookback="30d")
    assert store.changes(before).count() == 0


def test_near_dup_stream_equals_one_fold(spark, tmp_path):
    """Rows of two keys in four files, folded with state, against the rule on all rows in order."""
    import random

    import numpy as np

    from jobmill.operators import dedup
    from jobmill.streaming.state import near_dup_stream
    rnd, rows, fp = random.Random(4), [], 0
    for i in range(400):
        fp = rnd.getrandbits(62) if rnd.random() < 0.3 else fp ^ (1 << rnd.randrange(62))
        rows.append((rnd.choice("ab"), i, fp))
    (tmp_path / "in").mkdir()
    for k in range(4):
        spark.createDataFrame(rows[100 * k:100 * k + 100], "k string, n long, fp long").repartition(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema("k string, n long, fp long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b*"))
    q = near_dup_stream(stream, "k", "n", "fp").writeStream.format("parquet").option("path", str(tmp_path / "out")) \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = set()
    for key in "ab":
        mine = [r for r in rows if r[0] == key]
        flags, _ = dedup._fold(np.array([r[2] for r in mine]), None, 9)
        want |= {r[1] for r, f in zip(mine, flags) if f}
    assert got == want and 0 < len(got) < 400


def test_moving_clock(spark, tmp_path):
    """Without a fixed time the lookback ends at the micro-batch's own time."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    schema = land(spark, tmp_path / "in", [[("a", "python", now, 1), ("b", "python", now - dt.timedelta(days=3), 2)], [("c", "python", None, 3)]])
    store = ChangeLog(spark, str(tmp_path / "store"))
    run(spark, tmp_path, schema, store, Profile(profile="p", must_have_keywords=["python"], min_score_threshold=0.3), lookback="24h")
    got = {r["source_job_id"]: r["first_seen_at"] for r in store.jobs().collect()}
    assert set(got) == {"a", "c"} and all(abs((t - now).total_seconds()) < 600 for t in got.values())


def test_event_time_lookback_counts_late_rows(spark, tmp_path):
    from jobmill.streaming.state import late_rows, within_lookback
    day = dt.timedelta(days=1)
    land(spark, tmp_path / "in", [[("a", "t", AS_OF, 1), ("a", "t", AS_OF, 2)], [("b", "t", AS_OF - 2 * day, 3)],
                                  [("c", "t", AS_OF - 9 * day, 4), ("d", "t", AS_OF - 40 * day, 5), ("e", "t", None, 6)],
                                  [("a", "t", AS_OF - 1 * day, 7), ("f", "t", AS_OF - 6 * day, 8)]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b*"))
    out = str(tmp_path / "out")
    q = within_lookback(stream, "ts", "7 days", "sid").select("sid").writeStream.format("parquet").option("path", out) \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["sid"] for r in spark.read.parquet(out).collect()) == ["a", "b", "f"]
    assert late_rows(q) == 2


def test_restart_after_a_lost_stream_commit_keeps_messages(spark, tmp_path):
    """The store's part of the last batch stands, the stream's own commit is lost: the replay
    writes the same messages and change rows again."""
    schema = land(spark, tmp_path / "in", [[("s1", "python dev", AS_OF, 1)], [("s3", "python lead", AS_OF, 5)]])
    store = ChangeLog(spark, str(tmp_path / "store"))
    prof = Profile(profile="p", must_have_keywords=["python"], min_score_threshold=0.3)
    run(spark, tmp_path, schema, store, prof, as_of=AS_OF, lookback="30d")
    for f in (tmp_path / "ckpt" / "commits").glob("*1*"):
        f.unlink()
    run(spark, tmp_path, schema, store, prof, as_of=AS_OF, lookback="30d")
    assert spark.read.parquet(str(tmp_path / "store" / "outbox")).count() == 2
    assert store.jobs().count() == 2 and store.versions().count() == 2


def test_the_fold_of_a_stream_gets_narrow_rows(spark, tmp_path, monkeypatch):
    """Python sees a key, an order, a fingerprint and the row's place, not the postings."""
    from jobmill.streaming import monitor
    seen, real = [], monitor.near_dup_stream
    monkeypatch.setattr(monitor, "near_dup_stream", lambda stream, *a, **b: seen.append(stream.columns) or real(stream, *a, **b))
    schema = "company string, title string, source_job_id string, source_system string, location string, remote_type string, " \
             "employment_type string, department string, posted_at timestamp, description_text string, requirements array<string>, apply_url string, seq long"
    rows = [("C", "dev", str(i), "x", "here", "remote", "full_time", None, AS_OF, "the same long text of a posting " * 3, [], "https://x.io", i) for i in range(30)]
    store = ChangeLog(spark, str(tmp_path / "store"))
    for k in range(2):
        spark.createDataFrame(rows[15 * k:15 * k + 15], schema).write.parquet(str(tmp_path / "in" / f"b{k}"))
        q = monitor.start_monitor(spark, str(tmp_path / "in" / "b*"), spark.createDataFrame([], schema).schema, lambda raw: raw, store=store,
                                  profile={"profile": "p", "min_score_threshold": 0.0}, as_of=AS_OF, lookback=None, checkpoint=str(tmp_path / "ckpt"),
                                  near_dup=True, available_now=True)
        q.awaitTermination()
        assert q.exception() is None
    assert seen == [["_fkey", "seq", "_fp", "_land", "_at"]] * 2
    assert [(r["source_job_id"], r["title"], r["description_text"]) for r in store.jobs().collect()] == [("0", "dev", rows[0][9])]

"""The store's ways for many rows, which few rows take here: packed joins, bitmaps, staged input."""

import datetime as dt
import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobmill.store import blocks, changelog, jobs
from jobmill.store.changelog import ChangeLog

T0 = dt.datetime(2025, 1, 1)


@pytest.fixture
def many(monkeypatch):
    """Three rows are many."""
    monkeypatch.setattr(jobs, "BROADCAST_ROW_LIMIT", 3)
    monkeypatch.setattr(changelog, "BROADCAST_ROW_LIMIT", 3)


def _log(spark, path):
    """Saves with and without scores, marks and a compaction, with repeated, missing and unknown ids."""
    rnd, store, totals = random.Random(5), ChangeLog(spark, path), []
    for step in range(7):
        at = T0 + dt.timedelta(days=step)
        if step in (2, 5):
            ids = [(f"i{rnd.randrange(80)}",) for _ in range(40)] + [("nobody",), (None,)]
            store.notify(spark.createDataFrame(ids, "id string"), "push", "t", at)
            continue
        rows = [(f"i{rnd.randrange(80)}" if k else None, rnd.choice("AB"), f"t{step}-{k}", k, rnd.choice([rnd.random(), None])) for k in range(60)]
        inc = spark.createDataFrame(rows, "id string, company string, title string, seq long, final_score double")
        totals.append(store.save(inc if step % 2 else inc.drop("final_score"), at, order_col="seq"))
        if step == 3:
            store.compact()
    key = lambda r: str(r)
    return (totals, sorted(store.jobs().collect(), key=key), sorted(store.changes().drop("batch").collect(), key=key),
            sorted(store.notifications().collect(), key=key), sorted(store.versions().collect(), key=key))


def test_many_rows_give_the_store_that_few_rows_give(spark, tmp_path, request):
    few = _log(spark, str(tmp_path / "few"))
    request.getfixturevalue("many")
    assert _log(spark, str(tmp_path / "many")) == few


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_changes_meet_the_wide_rows_packed(spark, tmp_path, many):
    """No wide row is sorted or shuffled as a row to meet later saves and marks, and no row to be marked."""
    store = ChangeLog(spark, str(tmp_path / "s"))
    inc = spark.range(50).selectExpr("cast(id as string) as id", "concat('C', id % 7) as company", "id as seq")
    store.save(inc, T0, order_col="seq")
    store.save(inc.where("seq < 30"), T0 + dt.timedelta(days=1), order_col="seq")
    out = store.jobs()
    assert "MapInArrow" in _plan(out) and "SortMergeJoin" not in _plan(out) and "BroadcastHashJoin" not in _plan(out)
    assert out.where("updated_at is not null").count() == 30 and out.count() == 50
    rows = changelog.mark_rows(inc.select("id"), store.ids(), T0)
    assert "MapInArrow" in _plan(rows) and "SortMergeJoin" not in _plan(rows) and rows.count() == 50


def test_only_rows_that_may_be_marked_are_moved(spark, many):
    """Of 2,000 rows with 40 repeated ids, few more than these meet the repeated ids in a shuffle."""
    rows = spark.range(2040).selectExpr("cast(id % 2000 as string) as id", "id as seq")
    key = F.col("id")
    marked = rows.groupBy(key.alias("_marked")).agg(F.count("*").alias("_n")).where("_n > 1")
    apart, near = jobs._near(rows, key, marked, 40)
    assert apart.join(marked, F.col("id") == F.col("_marked")).count() == 0 and apart.count() + near.count() == 2040
    assert near.join(marked, F.col("id") == F.col("_marked")).count() == 80 and near.count() < 300


def test_known_and_repeated_and_missing_ids(spark, many):
    rows = [(None, 1), (None, 2)] + [(f"i{k % 20}", k) for k in range(3, 33)]
    inc = spark.createDataFrame(rows, "id string, seq long")
    first = {}
    for i, k in rows:
        first.setdefault(i, k)
    out = jobs.first_arrivals(inc, "seq", spark.createDataFrame([(f"i{k}",) for k in range(5, 40)], "id string"))
    assert {r["id"]: (r["seq"], bool(r["_known"])) for r in out.collect()} == \
        {i: (k, i is not None and int(i[1:]) >= 5) for i, k in first.items()} and out.count() == len(first)
    assert sorted(map(str, jobs.first_arrivals(inc, "seq").collect())) == sorted(map(str, out.drop("_known").collect()))


def test_blocks_join_what_rows_join(monkeypatch):
    """Blocks of few rows, buckets of several blocks, lookups of a few rows: each wide row comes once."""
    rnd = random.Random(1)
    monkeypatch.setattr(blocks, "HELD_BYTES", 900)
    monkeypatch.setattr(blocks, "JOINED_ROWS", 7)
    few = [{"id": rnd.choice([None, f"i{rnd.randrange(40)}"]), "batch": k, "_s": rnd.choice([None, rnd.random()])} for k in range(90)]
    wide = [{"id": rnd.choice([None, f"i{k}"]), "title": rnd.choice([None, "a", f"t{k}"]), "at": rnd.choice([None, T0])} for k in range(120)]
    last = {}
    for r in few:
        if r["id"] is not None and r["_s"] is not None:
            last[r["id"]] = r["_s"]
    kinds = [pa.schema([("id", pa.string()), ("batch", pa.int64()), ("_s", pa.float64())]),
             pa.schema([("id", pa.string()), ("title", pa.string()), ("at", pa.timestamp("us", "UTC"))])]
    packed = []
    for side, rows in enumerate((few, wide)):
        buckets = [hash(r["id"] or "") % 4 for r in rows]
        t = pa.Table.from_pylist(rows, kinds[side]).append_column("_bucket", pa.array(buckets, pa.int32()))
        packed += [r for b in blocks._packer(side)(iter(t.to_batches(10))) for r in b.to_pylist()]
    packed.sort(key=lambda r: (r["_bucket"], r["_side"]))
    assert Counter((r["_bucket"], r["_side"]) for r in packed).most_common(1)[0][1] > 2
    batches = [pa.RecordBatch.from_pylist(packed[k:k + 3], blocks._BLOCK_ARROW) for k in range(0, len(packed), 3)]
    out = pa.schema([*kinds[1], ("_s", pa.float64())])
    got = [r for b in blocks._joiner("id", "batch", *kinds, out)(iter(batches)) for r in b.to_pylist()]
    utc = lambda r: str(sorted({**r, "at": r["at"] and r["at"].replace(tzinfo=None)}.items(), key=str))
    assert sorted(map(utc, got)) == sorted(utc({**r, "_s": last.get(r["id"])}) for r in wide)


def test_shuffle_files_go_with_each_step(spark, tmp_path):
    """A save, a mark and a compaction leave no shuffle files behind for the driver's heap to release."""
    files = lambda: [f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
                     if "/shuffle_" in f and f.endswith(".data")]
    store = ChangeLog(spark, str(tmp_path / "s"))
    inc = spark.range(5000).selectExpr("cast(id % 4000 as string) as id", "concat('C', id % 7) as company", "id as seq").repartition(3)
    before = set(files())
    left = lambda: sum(os.path.getsize(f) for f in set(files()) - before if os.path.exists(f))
    for step in range(2):
        rows = changelog.save_rows(inc, store.ids() if step else None, T0, "seq")
        assert left() < 5_000
        store._append(rows, step + 1)
        assert left() < 5_000
    store.compact()
    assert left() < 5_000 and store.jobs().count() == 4000


def test_staged_lines_give_the_same_postings(spark, tmp_path):
    """With parts and suppliers that come twice, are missing or have no key."""
    from jobmill.plans import standins
    tables = {
        "lineitem": ([(k, k % 7 or None, k % 5 or None, k % 3, "ANRX"[k % 4], "OF"[k % 2], dt.datetime(1999, 1, 1 + k % 28)) for k in range(60)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "part": ([(k, f"hot gear {k}", "LARGE") for k in (1, 1, 2, 3, None)], "p_partkey long, p_name string, p_type string"),
        "supplier": ([(k, f"S{k}", k) for k in (1, 2, 2, 3, None)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(k, f"NATION_{k}") for k in (1, 2, 3)], "n_nationkey int, n_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    sf = str(tmp_path)
    plain, staged = (standins.postings_li(spark, sf, x) for x in (None, standins.staged_lines(spark, sf)))
    assert plain.schema == staged.schema and plain.count() > 0
    assert plain.exceptAll(staged).count() == 0 and staged.exceptAll(plain).count() == 0

"""Plans and operators that scale: pushed filters, one scoring pass, the vector index, models made
once per worker, logged runs."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobmill.operators import filters, reports, vector_index, vectors
from jobmill.operators.scoring import Profile
from jobmill.plans.scan import scan_and_store
from jobmill.store.changelog import ChangeLog

AS_OF = dt.datetime(2025, 1, 10)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_time_filter_reaches_the_scan(spark, tmp_path, kind):
    rows = [(1, AS_OF), (2, AS_OF - dt.timedelta(days=7)), (3, AS_OF - dt.timedelta(days=7, microseconds=1)), (4, None)]
    path = str(tmp_path / "p")
    spark.createDataFrame(rows, "id long, posted_at timestamp").withColumn("posted_at", F.col("posted_at").cast(kind)).write.parquet(path)
    out = filters.time_filter(spark.read.parquet(path), AS_OF, "7d")
    assert {r["id"] for r in out.collect()} == {1, 2, 4}
    pushed = plan(out).split("PushedFilters: ")[1].split("]")[0]
    assert "IsNull(posted_at)" in pushed and "GreaterThanOrEqual(posted_at" in pushed
    # another type is compared as a timestamp
    days = spark.createDataFrame([(1, "2025-01-03"), (2, "2025-01-02"), (3, None)], "id long, posted_at string")
    for t in ("date", "string"):
        got = filters.time_filter(days.withColumn("posted_at", F.col("posted_at").cast(t)), AS_OF, "7d").collect()
        assert {r["id"] for r in got} == {1, 3}


def test_digest_scores_once(spark):
    from jobmill.operators import scoring
    posts = spark.range(40).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("python "), F.col("id")).alias("title"), F.lit("Co").alias("company"),
                                   F.lit(None).cast("string").alias("description_text"), F.array().cast("array<string>").alias("requirements"),
                                   F.lit(None).cast("string").alias("department"), F.lit("x").alias("location"), F.lit("remote").alias("remote_type"),
                                   F.lit(None).cast("timestamp").alias("posted_at"))
    out = reports.digest(scoring.score(posts, [Profile(profile="p", must_have_keywords=["python"])], AS_OF))
    assert "rlike" not in plan(out).lower() and "Range" not in plan(out)
    row = out.first()
    assert row["total"] == 40 and row["message"].endswith("... and 30 more") and row["message"].count("\n") == 10


def clouds(n=3000, dim=24, groups=30, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(groups, size=n)] + 0.4 * rng.normal(size=(n, dim))
    x[: n // 3] = centres[0] + 0.3 * rng.normal(size=(n // 3, dim))          # one cell holds a third
    return x


def test_vector_index_recall_and_pruning(spark, tmp_path):
    x = clouds()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * x.shape[1])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    queries = corpus.where("id % 100 = 0 and id < 3000").select(F.col("id").alias("q"), F.col("embedding").alias("query_vec"))
    keys = dict(query_key="q", corpus_key="id")
    index = vector_index.fit_index(corpus, key="id", sample_rows=1500)
    assert 1 <= index.probes < len(index.centres) / 2
    stored = vector_index.write_index(corpus, index, str(tmp_path / "index"))
    assert stored.count() == len(x) + 1                                     # every row with a vector, whatever the sample
    found = vector_index.index_top_k(stored, queries, index, 10, **keys)
    exact = vectors.vector_top_k(corpus.where("embedding is not null"), queries, 10, **keys)
    assert vector_index.recall(found, exact, **keys) >= 0.9
    assert "dynamicpruning" in plan(found).lower()
    # all cells: the exact result, similarities included
    whole = vector_index.index_top_k(stored, queries, index, 10, probes=len(index.centres), **keys)
    a = {(r["q"], r["id"]): r["similarity"] for r in whole.collect()}
    b = {(r["q"], r["id"]): r["similarity"] for r in exact.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_vector_index_small_and_empty(spark):
    empty = spark.createDataFrame([], "id long, embedding array<float>")
    index = vector_index.fit_index(empty, key="id")
    assert vector_index.with_cell(empty, index).count() == 0
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(7)], "id long, embedding array<float>")
    index = vector_index.fit_index(same, key="id", cells=3)
    rows = vector_index.with_cell(same, index)
    q = same.where("id = 3").select(F.col("id").alias("q"), F.col("embedding").alias("query_vec"))
    got = vector_index.index_top_k(rows, q, index, 4, query_key="q", corpus_key="id", probes=3).collect()
    assert sorted((r["id"], r["rank"], r["similarity"]) for r in got) == [(i, i + 1, 1.0) for i in range(4)]


def test_encoder_is_made_once_per_worker(spark, tmp_path):
    mark = str(tmp_path / "made")

    def make():
        with open(mark, "a") as f:
            f.write(f"{os.getpid()}\n")
        return vectors.hashed_words(8)()

    df = spark.range(3000).select(F.concat(F.lit("word "), F.col("id") % 7, F.lit(" x")).alias("t")).union(
        spark.createDataFrame([(None,), ("",)], "t string")).repartition(6)
    out = vectors.embed_batches(df, "t", make, 8, batch_size=50)
    rows = out.collect()
    made = open(mark).read().split()
    assert len(rows) == 3002 and len(made) == len(set(made)) <= 8
    assert all(sum(r["embedding"]) == (3 if r["t"] else 0) for r in rows)
    with pytest.raises(Exception, match="encoder gave"):
        vectors.embed_batches(df, "t", vectors.hashed_words(8), 9).collect()


def test_logged_runs(spark, tmp_path):
    store = ChangeLog(spark, str(tmp_path / "store"))
    posts = spark.createDataFrame([("A", "python dev", "1", 1), ("A", "python dev", "1", 2), ("B", "cook", "2", 3)], "company string, title string, source_job_id string, seq long").select(
        "*", F.lit("lever").alias("source_system"), F.concat("company", F.lit("-"), "source_job_id").alias("id"), F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("description_text"), F.array().cast("array<string>").alias("requirements"), F.lit(None).cast("string").alias("department"),
        F.lit(AS_OF).alias("posted_at"))
    assert scan_and_store(store, 1, posts, None, AS_OF, "30d") == {"jobs_found": 2, "jobs_new": 2}
    assert scan_and_store(store, 2, posts, None, AS_OF, "30d") == {"jobs_found": 0, "jobs_new": 0}
    with pytest.raises(Exception):
        scan_and_store(store, 3, posts.drop("title"), None, AS_OF, "30d")
    runs = {r["run_id"]: (r["status"], r["jobs_found"], r["jobs_new"], bool(r["error_message"])) for r in store.runs().collect()}
    assert runs == {1: ("completed", 2, 2, False), 2: ("completed", 0, 0, False), 3: ("failed", 0, 0, True)}
    assert {r["name"] for r in store.companies().collect()} == {"A", "B"} and store.jobs().count() == 2


def test_profile_texts_of_a_table(spark):
    from jobmill.operators.scoring import profiles_frame
    profs = [Profile(profile="a", desired_roles=["r1", "r2"], must_have_keywords=["k"], preferred_locations=["X", "Y"], remote_preference="remote"),
             Profile(profile="b"), Profile(profile="c", must_have_keywords=["k", "l"], remote_preference="")]
    out = {r["profile"]: (r["p"], r["l"]) for r in profiles_frame(spark, profs).select(
        "profile", vectors.profile_texts().alias("p"), vectors.profile_texts(labelled=True).alias("l")).collect()}
    assert out == {p.profile: (vectors.profile_text_plain(p), vectors.profile_text_labelled(p)) for p in profs}


def test_vector_match_carries_highlights(spark):
    posts = spark.createDataFrame([("a", "Python dev", "Berlin", "remote", [1.0, 0.0]), ("b", "Cook", None, "onsite", [-1.0, 0.0])],
                                  "id string, title string, location string, remote_type string, embedding array<float>").withColumn("description_text", F.lit(None).cast("string"))
    q = spark.createDataFrame([("p", [1.0, 0.0])], "profile string, query_vec array<float>")
    prof = Profile(profile="p", must_have_keywords=["python"], preferred_locations=["berlin"], remote_preference="remote")
    rows = vectors.vector_match_highlights(posts, q, prof, min_similarity=0.0).collect()
    assert {r["id"]: list(r["profile_highlights"]) for r in rows} == {"a": ["Contains: python", "Location: berlin", "Remote: remote"], "b": []}
    assert [list(r["profile_highlights"]) for r in vectors.vector_match_highlights(posts, q, prof, most=1).collect()] == [["Contains: python"]]


def test_blocks_of_vectors_rank_like_pairs(spark, monkeypatch):
    """The search by blocks gives the rows of the pairwise form: copies, missing, zero and uneven vectors, several chunks."""
    import numpy as np

    from jobmill.operators import vector_blocks, vectors
    rng = np.random.default_rng(5)
    vecs = [[float(x) for x in v] for v in rng.normal(size=(60, 6)).astype(np.float32)]
    vecs += [vecs[3]] * 40 + [None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], vecs[4][:4], [], [-x for x in vecs[3]]]
    corpus = spark.createDataFrame([(1000 - i, f"t{i}", v) for i, v in enumerate(vecs)], "id long, tag string, embedding array<float>")
    queries = corpus.where("id % 7 = 0 or id > 995 or embedding is null").selectExpr("concat('q', id) as q", "embedding as query_vec")
    keys = dict(query_key="q", corpus_key="id")
    monkeypatch.setattr(vector_blocks, "CORPUS_ROWS", 16)
    pairs = vectors.pair_similarity(corpus, queries).selectExpr("q", "id", "tag", "similarity", "row_number() over (partition by q order by round(similarity, 9) desc, id) as rank")
    want = {(r["q"], r["rank"]): r for r in pairs.where("rank <= 9").collect()}
    for size in (64 << 20, 1000):
        got = vectors.vector_top_k(corpus, queries, 9, chunk_bytes=size, **keys).collect()
        assert len(got) == len(want) and set(got[0].asDict()) == {"q", "id", "tag", "similarity", "rank"}
        for r in got:
            w = want[r["q"], r["rank"]]
            assert (r["id"], r["tag"]) == (w["id"], w["tag"]) and abs(r["similarity"] - w["similarity"]) < 1e-9


def test_exact_search_moves_k_rows_a_block_not_pairs(spark):
    """No row is formed for a pair of vectors: the plan joins blocks."""
    corpus = spark.range(3000).selectExpr("id", "array(cast(id as float), cast(1 as float)) as embedding")
    top = vectors.vector_top_k(corpus, corpus.where("id % 100 = 0").selectExpr("id as q", "embedding as query_vec"), 3, query_key="q", corpus_key="id")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan and top.count() == 90

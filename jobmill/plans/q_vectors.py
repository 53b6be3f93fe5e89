"""Registered vector queries (V01-V06, T04, J07, W03, G03 with embeddings)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import scoring, vector_index, vectors
from ..session import read_table, scratch_path
from . import standins
from .registry import AS_OF, SAMPLE_PROFILE, _SCORED_SQL, register, r6
from .standins import POSTINGS_LI_SQL

TOP_K_VEC = 10
PROFILE_LABEL = 0

_CENTROID_SQL = """
  e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
  c AS (SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i)
        GROUP BY label),
  pairs AS (SELECT c.label, e.vec_id,
              CASE WHEN sqrt(list_dot_product(e.v, e.v)) = 0 OR sqrt(list_dot_product(c.q, c.q)) = 0 THEN 0.0e0
                   ELSE list_dot_product(e.v, c.q) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.q, c.q)))
              END AS cos
            FROM e CROSS JOIN c),
  sims AS (SELECT label, vec_id, (cos + 1.0e0) / 2.0e0 AS similarity FROM pairs)
"""


def label_centroids(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return vectors.centroids(emb, "label").withColumnRenamed("embedding", "query_vec")


@register("vector_topk", f"""
WITH {_CENTROID_SQL}
SELECT label, vec_id, rank, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM sims)
WHERE rank <= {TOP_K_VEC}
""")
def q_vector_topk(spark, sf_dir):
    corpus = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    top = vectors.vector_top_k(corpus, label_centroids(spark, sf_dir), TOP_K_VEC,
                               query_key="label", corpus_key="vec_id")
    return top.select("label", "vec_id", F.col("rank").cast("bigint").alias("rank"),
                      r6(F.col("similarity")).alias("similarity"))


@register("vector_match", f"""
WITH {_CENTROID_SQL}
SELECT vec_id, round(similarity, 6) AS similarity,
       row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank
FROM sims WHERE label = {PROFILE_LABEL} AND similarity >= 0.5e0
""")
def q_vector_match(spark, sf_dir):
    corpus = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    prof = label_centroids(spark, sf_dir).filter(F.col("label") == PROFILE_LABEL) \
        .select(F.lit("sample").alias("profile"), "query_vec")
    m = vectors.vector_match(corpus, prof, min_similarity=0.5, posting_key="id")
    return m.select(F.col("id").alias("vec_id"), r6(F.col("similarity")).alias("similarity"),
                    F.col("rank").cast("bigint").alias("rank"))


def postings_with_similarity(spark, sf_dir):
    """Postings with the rescaled similarity of their part's embedding (V06 join on the precomputed
    table; no embedding -> null -> neutral .5 in scoring). The similarity is computed once per
    vector; one number, not the vector, goes to each posting."""
    p = standins.postings_li(spark, sf_dir).withColumn("part_key", F.col("seq.l_partkey"))
    emb = read_table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("part_key"), "embedding")
    prof = label_centroids(spark, sf_dir).filter(F.col("label") == PROFILE_LABEL).select("query_vec")
    sims = vectors.pair_similarity(emb, prof).select("part_key", F.col("similarity").alias("vec_sim"))
    return p.join(sims, "part_key", "left")


@register("score_with_vectors", f"""
WITH {_CENTROID_SQL},
  ps AS (SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey, s.similarity FROM {POSTINGS_LI_SQL} p
         LEFT JOIN sims s ON s.vec_id = p.l_partkey AND s.label = {PROFILE_LABEL}),
  base AS ({_SCORED_SQL.replace('WITH p AS', 'WITH p0 AS', 1).replace('FROM p)', 'FROM p0)', 1)}
           SELECT f.*, ps.similarity FROM f JOIN ps USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)),
  g AS (SELECT id, excluded,
          CASE WHEN excluded THEN 0.0e0 ELSE 0.55e0 * coalesce(similarity, 0.5e0) + 0.3e0 * keyword_score
                                               + 0.15e0 * recency_score END AS final_score,
          CASE WHEN excluded THEN 0.0e0 ELSE coalesce(similarity, 0.5e0) END AS vector_score
        FROM base)
SELECT id, round(final_score, 6) AS final_score, round(vector_score, 6) AS vector_score FROM g
WHERE final_score >= 0.3e0
""")
def q_score_with_vectors(spark, sf_dir):
    p = postings_with_similarity(spark, sf_dir)
    s = scoring.score(p, [SAMPLE_PROFILE], AS_OF, vector_col="vec_sim")
    s = s.filter(F.col("final_score") >= F.col("min_score_threshold"))
    return s.select("id", r6(F.col("final_score")).alias("final_score"),
                    r6(F.col("vector_score")).alias("vector_score"))


@register("highlights", f"""
SELECT id, array_to_string(list_filter([
    CASE WHEN contains(lower(title || ' ' || '' || ' ' || coalesce(location, '')), 'widget') THEN 'Contains: widget' END,
    CASE WHEN contains(lower(title || ' ' || '' || ' ' || coalesce(location, '')), 'promo') THEN 'Contains: PROMO' END,
    CASE WHEN contains(lower(title), 'red widget') THEN 'Role match: red widget'
         WHEN contains(lower(title), 'hot gear') THEN 'Role match: hot gear' END,
    CASE WHEN location IS NOT NULL AND location <> '' AND contains(lower(location), 'nation_1') THEN 'Location: NATION_1' END,
    CASE WHEN remote_type = 'remote' THEN 'Remote: ' || remote_type END], lambda x: x IS NOT NULL)[1:5], '; ') AS highlights
FROM {POSTINGS_LI_SQL} p
""")
def q_highlights(spark, sf_dir):
    p = standins.postings_li(spark, sf_dir)
    return p.select("id", F.array_join(vectors.highlights(SAMPLE_PROFILE, most=5), "; ").alias("highlights"))


# -- T04 / V04 through the cell index ------------------------------------------------------
@register("vector_topk_index", f"""
SELECT vec_id AS query_id, least({TOP_K_VEC}, (SELECT count(*) FROM embeddings))::BIGINT AS n_found,
  vec_id AS first_id, 1.0e0 AS first_similarity, true AS recall_ok
FROM embeddings WHERE vec_id % 100 = 0
""")
def q_vector_topk_index(spark, sf_dir):
    """Every row whose id is divisible by 100 against all rows; ``recall_ok`` says whether at least
    0.9 of the exact search's rows were found."""
    corpus = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = corpus.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    index = vector_index.fit_index(corpus, key="vec_id", k=TOP_K_VEC)
    path = scratch_path(spark, f"vector-index-{uuid.uuid4().hex}")
    rows = vector_index.write_index(corpus, index, path)
    keys = dict(query_key="query_id", corpus_key="vec_id")
    found = vector_index.index_top_k(rows, queries, index, TOP_K_VEC, **keys)
    exact = vectors.vector_top_k(corpus, queries, TOP_K_VEC, **keys)
    ok = vector_index.recall(found, exact, **keys) >= 0.9
    return found.groupBy("query_id").agg(F.count("*").alias("n_found"), F.min_by("vec_id", "rank").alias("first_id"),
                                         F.max(r6(F.col("similarity"))).alias("first_similarity")).withColumn("recall_ok", F.lit(ok))


# -- V06 F26: embeddings of posting texts by a model made once per worker -------------------------
EMBED_DIM = 16


@register("posting_embeddings", f"""
WITH t AS (SELECT id, l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(' ', title, 'Department: ' || nullif(department, ''),
             'Location: ' || nullif(location, ''), 'Work style: ' || nullif(remote_type, '')) AS text FROM {POSTINGS_LI_SQL} p),
  d AS (SELECT DISTINCT text FROM t),
  w AS (SELECT text, unnest(string_split(text, ' ')) AS w FROM d),
  c AS (SELECT text, (('0x' || substr(md5(w), 17, 16))::UBIGINT % {EMBED_DIM})::INT AS i, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
  e AS (SELECT text, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY i) AS embedding
        FROM (SELECT d.text, r.i FROM d, (SELECT unnest(range({EMBED_DIM}))::INT AS i) r) g LEFT JOIN c USING (text, i) GROUP BY text)
SELECT t.id, t.text, e.embedding FROM t JOIN e USING (text)
""")
def q_posting_embeddings(spark, sf_dir):
    p = standins.postings_li(spark, sf_dir).select("id", vectors.posting_embed_text().alias("text"))
    out = vectors.embed_batches(p, "text", vectors.hashed_words(EMBED_DIM), EMBED_DIM)
    return out.select("id", "text", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))

"""Vector similarity (V01-V05, T04, J07, W03) on ``array<float>`` columns.

Similarity is computed with array higher-order functions in double precision.
Query/profile vectors form the small side: their count is checked before they are
broadcast, and larger query sets are processed in checked chunks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from . import vector_blocks
from .ranking import global_row_number, top_k_per_group

NEUTRAL = 0.5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """dot / (|a| |b|); 0 when either norm is 0; null when either vector is null."""
    na, nb = norm(a), norm(b)
    return F.when(_c(a).isNull() | _c(b).isNull(), F.lit(None).cast("double")) \
        .when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def rescale(sim) -> Column:
    """[-1, 1] -> [0, 1]; neutral .5 when the similarity is missing."""
    return F.coalesce((_c(sim) + F.lit(1.0)) / F.lit(2.0), F.lit(NEUTRAL))


def centroids(vectors: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group (element-wise), as array<double> ordered by dimension."""
    ex = vectors.select(group_col, F.posexplode(vec_col).alias("_d", "_x"))
    per_dim = ex.groupBy(group_col, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return per_dim.groupBy(group_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"])
        .alias(vec_col))


def pair_similarity(corpus: DataFrame, queries: DataFrame, *, corpus_vec="embedding",
                    query_vec="query_vec", chunk_bytes: int = 64 << 20) -> DataFrame:
    """All (corpus row, query) pairs with ``similarity`` = rescaled cosine.

    Exact brute force, as the source tool does (every posting against the profile).
    The query side is broadcast only in chunks whose size is checked: rows x vector
    width x 8 bytes <= ``chunk_bytes``; the corpus is streamed once per chunk and is
    never shuffled."""
    q = queries.withColumn("_qnorm", norm(query_vec))
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(query_vec)).alias("dim")).first()
    n, dim = int(stats["n"]), max(1, int(stats["dim"] or 1))
    chunk_rows = max(1, chunk_bytes // (8 * dim + 64))
    n_chunks = max(1, -(-n // chunk_rows))
    outs = []
    for i in range(n_chunks):
        part = q if n_chunks == 1 else q.filter(
            F.pmod(F.xxhash64(*[c for c in queries.columns if c != query_vec]), F.lit(n_chunks)) == i)
        pairs = corpus.crossJoin(F.broadcast(part))
        cn = norm(corpus_vec)
        cos = F.when(F.col(corpus_vec).isNull(), F.lit(None).cast("double")) \
            .when((cn == 0) | (F.col("_qnorm") == 0), F.lit(0.0)) \
            .otherwise(dot(corpus_vec, query_vec) / (cn * F.col("_qnorm")))
        outs.append(pairs.withColumn("similarity", rescale(cos)).drop("_qnorm"))
    return reduce(DataFrame.unionByName, outs)


def vector_top_k(corpus: DataFrame, queries: DataFrame, k: int | None, *, query_key: str,
                 corpus_key: str, corpus_vec="embedding", query_vec="query_vec", chunk_bytes: int = 64 << 20) -> DataFrame:
    """Per query, corpus rows ranked by similarity (desc, then corpus key), with the columns of
    both sides but the vectors; k None or 0 keeps all rows.

    With k every query meets every row as blocks (``vector_blocks``): blocks of queries are
    broadcast in chunks of a checked size, the corpus is streamed once per chunk."""
    order = [F.col("similarity").desc(), F.col(corpus_key)]
    if not k:
        pairs = pair_similarity(corpus, queries, corpus_vec=corpus_vec, query_vec=query_vec)
        return top_k_per_group(pairs.drop(corpus_vec, query_vec), k, order, [query_key])
    stats = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(query_vec)).alias("dim")).first()
    n, dim = int(stats["n"]), max(1, int(stats["dim"] or 1))
    n_chunks = max(1, -(-n * (8 * dim + 64) // chunk_bytes))
    first = lambda df, key, vec: [key, *[c for c in df.columns if c not in (key, vec)]]
    rows = vector_blocks.packed(spread(corpus), first(corpus, corpus_key, corpus_vec), corpus_vec, vector_blocks.CORPUS_ROWS, "_ckeys", "_cvecs")
    outs = []
    for i in range(n_chunks):
        part = queries if n_chunks == 1 else queries.filter(F.pmod(F.xxhash64(query_key), F.lit(n_chunks)) == i)
        part = part.repartition(max(1, -(-n // (n_chunks * vector_blocks.QUERY_ROWS))))
        blocks = vector_blocks.packed(part, first(queries, query_key, query_vec), query_vec, vector_blocks.QUERY_ROWS, "_qkeys", "_qvecs")
        outs.append(vector_blocks.best_of_pairs(rows.crossJoin(F.broadcast(blocks)), k))
    return top_k_per_group(reduce(DataFrame.unionByName, outs), k, order, [query_key])


def vector_match(postings: DataFrame, profile_vecs: DataFrame, *, min_similarity: float = 0.5,
                 posting_key: str = "id", profile_key: str = "profile",
                 corpus_vec="embedding", query_vec="query_vec") -> DataFrame:
    """Similarity >= min, ranked 1..n per profile by similarity desc (ties by key).
    Ranking uses the distributed row numbering (no single-task window)."""
    pairs = pair_similarity(postings, profile_vecs, corpus_vec=corpus_vec, query_vec=query_vec)
    kept = pairs.filter(F.col("similarity") >= min_similarity)
    return global_row_number(kept, [F.col("similarity").desc(), F.col(posting_key)],
                             [profile_key], out="rank")


def vector_match_highlights(postings: DataFrame, profile_vecs: DataFrame, p, *, most: int | None = None, **options) -> DataFrame:
    """V04 with V05: ``vector_match`` whose rows carry ``profile_highlights``, what in the posting
    speaks for the profile ``p`` (a literal one, whose vector ``profile_vecs`` holds)."""
    told = postings.withColumn("profile_highlights", highlights(p, most=most))
    return vector_match(told, profile_vecs, **options)


def vector_match_without_provider(postings: DataFrame, order_col: str, posting_key: str) -> DataFrame:
    """V04 with no embedding provider: every row, similarity .5, arrival order, no threshold."""
    return global_row_number(postings.withColumn("similarity", F.lit(NEUTRAL)),
                             [F.col(order_col), F.col(posting_key)], [], out="rank") \
        .withColumn("profile_highlights", F.array(F.lit("Embeddings not available")))


def highlights(p, title="title", description="description_text", location="location",
               remote="remote_type", most: int | None = None) -> Column:
    """V05 for a literal profile: keyword substrings, first role in title, first
    location, remote equality; all of them, or the first ``most`` (the source tool shows 5)."""
    t = F.lower(F.concat_ws(" ", _c(title), F.coalesce(_c(description), F.lit("")),
                            F.coalesce(_c(location), F.lit(""))))
    items = [F.when(t.contains(k.lower()), F.lit(f"Contains: {k}")) for k in p.must_have_keywords]
    role = None
    for r in p.desired_roles:
        cond = F.lower(_c(title)).contains(r.lower())
        role = F.when(cond, F.lit(f"Role match: {r}")) if role is None else role.when(cond, F.lit(f"Role match: {r}"))
    if role is not None:
        items.append(role)
    loc = None
    has_loc = _c(location).isNotNull() & (_c(location) != "")
    for l_ in p.preferred_locations:
        cond = has_loc & F.lower(_c(location)).contains(l_.lower())
        loc = F.when(cond, F.lit(f"Location: {l_}")) if loc is None else loc.when(cond, F.lit(f"Location: {l_}"))
    if loc is not None:
        items.append(loc)
    if p.remote_preference is not None:
        items.append(F.when(_c(remote) == p.remote_preference,
                            F.concat(F.lit("Remote: "), _c(remote))))
    if not items:
        return F.array().cast("array<string>")
    found = F.array_compact(F.array(*items))
    return found if most is None else F.slice(found, 1, most)


def profile_text_plain(p) -> str:
    """F25 (a): roles then must-have keywords, space separated."""
    return " ".join([*p.desired_roles, *p.must_have_keywords])


def profile_text_labelled(p) -> str:
    """F25 (b): labelled profile text."""
    parts = []
    if p.desired_roles:
        parts.append("Looking for roles like: " + ", ".join(p.desired_roles))
    if p.must_have_keywords:
        parts.append("Required skills: " + ", ".join(p.must_have_keywords))
    if p.preferred_locations:
        parts.append("Preferred locations: " + ", ".join(p.preferred_locations))
    if p.remote_preference:
        parts.append(f"Work style: {p.remote_preference}")
    return " ".join(parts)


def profile_texts(labelled: bool = False) -> Column:
    """F25 for a table of profiles: the same texts as ``profile_text_plain`` and
    ``profile_text_labelled`` from the profile columns (null lists count as empty)."""
    words = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    if not labelled:
        return F.array_join(F.concat(words("desired_roles"), words("must_have_keywords")), " ")

    def told(label: str, c: str) -> Column:
        return F.when(F.size(words(c)) > 0, F.concat(F.lit(label), F.array_join(words(c), ", ")))
    remote = F.nullif("remote_preference", F.lit(""))
    return F.concat_ws(" ", told("Looking for roles like: ", "desired_roles"), told("Required skills: ", "must_have_keywords"),
                       told("Preferred locations: ", "preferred_locations"), F.concat(F.lit("Work style: "), remote))


def posting_embed_text(title="title", department="department", location="location",
                       remote="remote_type", description="description_text",
                       requirements="requirements", description_chars: int | None = None,
                       max_requirements: int | None = None) -> Column:
    """title, Department, Location, Work style, description, requirements, whole unless a
    bound is given (the source tool's embedding input has 2000 characters and 10)."""
    def lab(label, c):
        return F.when(_c(c).isNotNull() & (_c(c) != ""), F.concat(F.lit(label), _c(c)))
    reqs, text = _c(requirements), _c(description)
    if max_requirements is not None:
        reqs = F.slice(reqs, 1, max_requirements)
    if description_chars is not None:
        text = F.substring(text, 1, description_chars)
    req = F.when(F.size(F.coalesce(_c(requirements), F.array())) > 0,
                 F.concat(F.lit("Requirements: "), F.array_join(reqs, ", ")))
    desc = F.when(_c(description).isNotNull() & (_c(description) != ""), text)
    return F.concat_ws(" ", _c(title), lab("Department: ", department), lab("Location: ", location),
                       lab("Work style: ", remote), desc, req)


def attach_embeddings(df: DataFrame, key_col: str, embeddings: DataFrame, emb_key: str,
                      vec_col: str = "embedding") -> DataFrame:
    """Attach precomputed vectors by key (left join; missing -> null -> neutral)."""
    return df.join(embeddings.select(F.col(emb_key).alias(key_col), F.col(vec_col)), key_col, "left")


def embed_with(df: DataFrame, text_col: str, encode, dim: int, out: str = "embedding") -> DataFrame:
    """V06 / X01 plug point for a caller's model: ``encode(list[str]) -> list[list[float]]``
    runs per Arrow batch inside the tasks (the model is the caller's; none ships here)."""
    def whole(v) -> list[float]:
        if len(v) > dim:
            raise ValueError(f"vector of {len(v)} numbers, dim is {dim}")
        return list(map(float, v))

    def run(texts: pd.Series) -> pd.Series:
        vecs = encode([t if t is not None else "" for t in texts.tolist()])
        return pd.Series([whole(v) if v is not None else None for v in vecs])

    udf = F.pandas_udf(run, T.ArrayType(T.FloatType()))
    return df.withColumn(out, udf(F.col(text_col)))


def embed_batches(df: DataFrame, text_col: str, make_encoder, dim: int, out: str = "embedding", batch_size: int = 256) -> DataFrame:
    """V06 plug point for a model that is dear to make: ``make_encoder()`` runs once per Python
    worker and returns ``encode(texts) -> array (rows, dim)``, which gets at most ``batch_size``
    texts at a time, across Arrow batches. A null text is encoded as an empty one."""
    from pyspark.ml.functions import predict_batch_udf

    def make():
        encode = make_encoder()

        def predict(texts):
            made = np.asarray(encode([t if t is not None else "" for t in texts.tolist()]), dtype=np.float32)
            if made.shape != (len(texts), dim):
                raise ValueError(f"encoder gave {made.shape}, wanted {(len(texts), dim)}")
            return made
        return predict

    udf = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, udf(F.coalesce(F.col(text_col), F.lit(""))))


def hashed_words(dim: int):
    """A small deterministic encoder for ``embed_batches``: the words of a text counted by the low
    64 bits of their md5, modulo ``dim``."""
    def make():
        import hashlib

        seen: dict[str, int] = {}

        def place(word: str) -> int:
            at = seen.get(word)
            if at is None:
                if len(seen) > 1_000_000:
                    seen.clear()
                at = seen[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[8:], "big") % dim
            return at

        def encode(texts):
            made = np.zeros((len(texts), dim), dtype=np.float32)
            for k, text in enumerate(texts):
                for word in text.split(" "):
                    if word:
                        made[k, place(word)] += 1
            return made
        return encode
    return make

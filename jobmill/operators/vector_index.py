"""Approximate vector search (T04, V04 at scale): a coarse index of cells with exact ranking inside
the cells that a query looks into. The exact search (``vectors.vector_top_k``) stays the default.

* ``fit_index`` learns cell centres by spherical k-means on a sample of at most ``sample_rows``
  corpus rows (the first in a fixed random order), and how many cells a query must probe so that
  ``target`` of the true neighbours are found among the sample. Both are documented bounds: every
  row of the corpus is indexed, whatever the sample was.
* ``write_index`` stores the corpus by cell (``cell=<n>`` folders): a search reads the cells that
  its queries probe and no others (dynamic partition pruning).
* ``index_top_k`` joins blocks of queries to blocks of rows by cell (``vector_blocks``) and keeps k
  rows per query and pair of blocks before the exchange. A cell that holds a third of all rows is
  read by as many tasks as it has splits; the corpus is never shuffled while the queries' vectors
  are within ``BROADCAST_BYTES``.

Rows without a vector lie in no cell and are not found; a zero vector has similarity 0.5."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector_blocks
from .ranking import top_k_per_group

BROADCAST_BYTES = 64 << 20


@dataclass
class VectorIndex:
    centres: np.ndarray           # (cells, dim), unit length
    probes: int                   # cells that a query looks into


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _kmeans(x: np.ndarray, cells: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from centres that are far apart; an empty cell takes the row farthest from its own."""
    rng = np.random.default_rng(1)
    centres = [x[rng.integers(len(x))]]
    best = x @ centres[0]
    for _ in range(cells - 1):
        far = np.maximum(1 - best, 0) + 1e-12
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        best = np.maximum(best, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        sims = x @ c.T
        own = sims.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        worst = np.argsort(sims.max(axis=1), kind="stable")
        for k, cell in enumerate(np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)):
            sums[cell] = x[worst[k % len(x)]]
        c = _unit(sums)
    return c


def _probes_for(x: np.ndarray, centres: np.ndarray, k: int, target: float, queries: int = 300) -> int:
    """The fewest cells per query with which ``target`` of the k nearest sample rows are found."""
    q = x[:queries]
    own = (x @ centres.T).argmax(axis=1)
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)                     # rank of each cell for each query
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    sims = q @ x.T
    np.put_along_axis(sims, np.arange(len(q))[:, None], -2.0, axis=1)      # not itself
    near = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def fit_index(corpus: DataFrame, *, key: str, vec: str = "embedding", cells: int | None = None, k: int = 10,
              target: float = 0.98, sample_rows: int = 20_000) -> VectorIndex:
    """Centres and probes from a bounded sample; by default about the square root of its rows as cells."""
    some = corpus.where(F.col(vec).isNotNull()).select(key, vec)
    share = min(1.0, 1.2 * sample_rows / max(1, some.count()))
    turn = F.xxhash64(F.lit(17), key)
    picked = some.where(F.pmod(turn, F.lit(1 << 30)) < share * (1 << 30)).orderBy(turn, key).limit(sample_rows)
    rows = [r[0] for r in picked.select(vec).collect()]
    if not rows:
        return VectorIndex(np.zeros((1, 1)), 1)
    x = _unit(np.array(rows, dtype=np.float64))
    cells = min(len(x), cells or max(1, int(len(x) ** 0.5)))
    centres = _kmeans(x, cells)
    return VectorIndex(centres, _probes_for(x, centres, min(k, len(x) - 1), target) if len(x) > 1 else 1)


def nearest_cells(index: VectorIndex, vec, many: int):
    """The ``many`` cells nearest to a vector, nearest first; null for no vector."""
    centres = index.centres

    def run(vectors: pa.Array) -> pa.Array:
        have = vectors.is_valid()
        x = _matrix(vectors.filter(have))
        sims = x @ centres.T if x.shape[1] == centres.shape[1] else np.zeros((len(x), len(centres)))
        cells = iter(np.argsort(-sims, axis=1, kind="stable")[:, :many].astype(np.int32).tolist())
        return pa.array([next(cells) if ok else None for ok in have.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(vec)


def with_cell(corpus: DataFrame, index: VectorIndex, *, vec: str = "embedding") -> DataFrame:
    """Every row of the corpus that has a vector, with its ``cell``."""
    return corpus.where(F.col(vec).isNotNull()).withColumn("cell", F.get(nearest_cells(index, F.col(vec), 1), F.lit(0)))


def write_index(corpus: DataFrame, index: VectorIndex, path: str, *, vec: str = "embedding") -> DataFrame:
    with_cell(corpus, index, vec=vec).write.partitionBy("cell").parquet(path)
    return corpus.sparkSession.read.parquet(path)


def index_top_k(indexed: DataFrame, queries: DataFrame, index: VectorIndex, k: int, *, query_key: str, corpus_key: str,
                vec: str = "embedding", query_vec: str = "query_vec", probes: int | None = None) -> DataFrame:
    """(query_key, corpus_key, similarity, rank): the k most similar rows of the probed cells."""
    many = min(len(index.centres), probes or index.probes)
    q = (queries.where(F.col(query_vec).isNotNull())
         .select(query_key, query_vec, F.explode(nearest_cells(index, F.col(query_vec), many)).alias("cell")))
    bytes_of = q.agg(F.count("*") * (64 + 8 * F.coalesce(F.max(F.size(query_vec)), F.lit(0)))).first()[0]
    asked = vector_blocks.packed(q.repartition("cell"), [query_key], query_vec, vector_blocks.QUERY_ROWS, "_qkeys", "_qvecs", "cell")
    # at most one row per cell: with it the scan leaves out the cells that no query looks into
    probed = indexed.select(corpus_key, vec, "cell").join(F.broadcast(q.select("cell").distinct()), "cell", "left_semi")
    rows = vector_blocks.packed(probed, [corpus_key], vec, vector_blocks.CORPUS_ROWS, "_ckeys", "_cvecs", "cell")
    pairs = rows.join(F.broadcast(asked) if bytes_of <= BROADCAST_BYTES else asked, "cell")
    return top_k_per_group(vector_blocks.best_of_pairs(pairs, k), k, [F.col("similarity").desc(), F.col(corpus_key)], [query_key])


def recall(found: DataFrame, exact: DataFrame, *, query_key: str, corpus_key: str) -> float:
    """The share of the exact neighbours that were found."""
    hit = exact.select(query_key, corpus_key).join(found.select(query_key, corpus_key, F.lit(1).alias("hit")), [query_key, corpus_key], "left")
    n, hits = hit.agg(F.count("*"), F.count("hit")).first()
    return hits / n if n else 1.0

"""Exact nearest neighbours of many queries, block by block: rows of vectors are packed into blocks,
blocks of queries meet blocks of the corpus, and one matrix product serves a whole pair of blocks.

A pair of blocks passes on the k best rows of each of its queries, so what is shuffled grows with
the number of corpus blocks and not of its rows. The product only picks candidates (a margin far above its
rounding errors); their similarity is then taken vector by vector, so equal vectors tie
wherever they stand. A task holds one pair of blocks at a time.

A vector that is null, or has a null element, has the neutral similarity 0.5, as has a zero vector;
of vectors of unequal length the missing elements count as zeros."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_ROWS, QUERY_ROWS, PAIRS = 4096, 1024, 1 << 16
MARGIN = 1e-9


def packed(df: DataFrame, keys: list[str], vec: str, rows: int, as_keys: str, as_vecs: str, cell: str | None = None) -> DataFrame:
    """Rows (``as_keys``, ``as_vecs``) of up to ``rows`` structs of ``keys`` and vectors each; with
    ``cell``, which goes along, a block's rows are of one cell. No shuffle: a block's rows are of one task."""
    df = df.select(F.struct(*keys).alias("_key"), vec, *([cell] if cell else []))
    schema = T.StructType([T.StructField(as_keys, T.ArrayType(df.schema["_key"].dataType)), T.StructField(as_vecs, T.ArrayType(df.schema[vec].dataType)),
                           *([df.schema[cell]] if cell else [])])

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        for c in t[cell].unique() if cell else [None]:
            some = t if c is None else t.filter(pc.equal(t[cell], c))
            for at in range(0, len(some), rows):
                part = some.slice(at, rows).combine_chunks()
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays(part[x].chunks)) for x in ("_key", vec)]
                yield pa.RecordBatch.from_arrays([*lists, *([pa.array([c.as_py()], t.schema.field(cell).type)] if cell else [])],
                                                 names=[as_keys, as_vecs, *([cell] if cell else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= rows:
                yield from blocks(held)
                held, n = [], 0
        if held:
            yield from blocks(held)

    return df.mapInArrow(run, schema)


def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as rows of doubles, their lengths; a length of 0 where there is no direction)."""
    n = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values = vectors.flatten()
    flat = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    x = np.zeros((len(vectors), int(n.max(initial=0))))
    x[np.arange(x.shape[1]) < n[:, None]] = flat
    norms = np.linalg.norm(x, axis=1)
    if values.null_count:
        norms[np.unique(np.repeat(np.arange(len(n)), n)[values.is_null().to_numpy(zero_copy_only=False)])] = 0
    return x, norms


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def nearest(q: pa.Array, c: pa.Array, c_rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, corpus number, similarity) of each query's k best rows; equal ones by ``c_rank``."""
    (x, xn), (y, yn) = matrix(q), matrix(c)
    width = max(x.shape[1], y.shape[1])
    x, y = _widened(x, width), _widened(y, width)
    with np.errstate(all="ignore"):
        inverse = lambda n: np.divide(1.0, n, out=np.zeros_like(n), where=n != 0)
        cos = (x * inverse(xn)[:, None]) @ (y * inverse(yn)[:, None]).T
        if len(y) > k:
            least = np.partition(cos, len(y) - k, axis=1)[:, len(y) - k]
            qi, ci = np.nonzero(~(cos < least[:, None] - MARGIN))
        else:
            qi, ci = (i.ravel() for i in np.indices(cos.shape))
        sims = np.empty(len(qi))
        for at in range(0, len(qi), PAIRS):
            i, j = qi[at:at + PAIRS], ci[at:at + PAIRS]
            n = xn[i] * yn[j]
            dots = np.einsum("ij,ij->i", x[i], y[j])
            sims[at:at + PAIRS] = (np.divide(dots, n, out=np.zeros_like(dots), where=n != 0) + 1) / 2
    order = np.lexsort((c_rank[ci], np.where(np.isnan(sims), -np.inf, -sims), qi))
    qi, ci, sims = qi[order], ci[order], sims[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[best], ci[best], sims[best]


def best_of_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """(the queries' keys, the rows' keys, similarity): the k best rows of each query in each pair of
    blocks (columns _qkeys, _qvecs, _ckeys, _cvecs); equal ones by the first of the rows' keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qkeys, qvecs, ckeys, cvecs = (b.column(c)[i].values for c in ("_qkeys", "_qvecs", "_ckeys", "_cvecs"))
                rank = np.empty(len(ckeys), np.int64)
                rank[pc.sort_indices(pc.struct_field(ckeys, [0]), null_placement="at_start").to_numpy()] = np.arange(len(ckeys))
                qi, ci, sims = nearest(qvecs, cvecs, rank, k)
                yield pa.RecordBatch.from_arrays([qkeys.take(pa.array(qi)), ckeys.take(pa.array(ci)), pa.array(sims)], names=["_q", "_c", "similarity"])

    kinds = [pairs.schema[c].dataType.elementType for c in ("_qkeys", "_ckeys")]
    schema = T.StructType([T.StructField("_q", kinds[0]), T.StructField("_c", kinds[1]), T.StructField("similarity", T.DoubleType())])
    return pairs.select("_qkeys", "_qvecs", "_ckeys", "_cvecs").mapInArrow(run, schema).select("_q.*", "_c.*", "similarity")

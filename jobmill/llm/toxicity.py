"""Toxicity by non-negative positive-unlabelled learning.

The positive examples are confirmed toxic documents, the unlabelled ones a random part of
the corpus. With the class prior p, the risk of a scorer is

    p * R(positives as positive) + max(0, R(unlabelled as negative) - p * R(positives as negative))

and a step that would push the second part below zero is taken the other way, so that the
scorer does not fit single positives. The scorer is linear (logistic loss, Adam, numpy) in
the words of a text and their first four to six letters, each as the root of its share of
the text; the features are those whose document shares differ most between the confirmed
documents and the corpus.

Only training rows teach labels: the confirmed examples and the prior come from them. What
enters numpy is bounded by parameters (``max_positive`` confirmed documents and
``max_unlabelled`` others, chosen by a hash of the id). Everything else covers the corpus:
document shares are counted over every training row, within the tasks first, and scoring is
one narrow pass.

Defined results: a null text is empty; a text without words gets the scorer's constant; with
no confirmed example every score is the prior's smoothed value; labels with a null id or
value are ignored; other columns pass through, columns named like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, column, each, slices, staged
from .labelled import first_by_turn, held_out, training_labels, turn

WORD = re.compile(r"[^\W\d_]+")
SPACE = 1 << 18
PREFIXES = (4, 5, 6)


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its first letters."""
    parts = [word + "$", *(word[:n] for n in PREFIXES if len(word) > n)]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % SPACE for p in parts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each feature: the confirmed ones and all; summed up within the task."""
    memo, seen, rows = Memo(word_features), np.zeros((2, SPACE), np.int64), np.zeros(2, np.int64)
    for b in slices(batches, "_text"):
        held: tuple[list[int], list[int]] = ([], [])
        for text, positive in zip(column(b, "_text").to_pylist(), column(b, "_p").to_pylist()):
            ids = {i for w in set(WORD.findall((text or "").lower())) for i in memo[w]}
            rows += (1, bool(positive))
            held[0].extend(ids)
            if positive:
                held[1].extend(ids)
        for k in (0, 1):
            seen[k] += np.bincount(held[k], minlength=SPACE) if held[k] else 0
    at = np.flatnonzero(seen[0])
    # the numbers of documents go along under a feature that no word has
    yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1]), pa.array([*seen[1, at].tolist(), int(rows[1])]),
                                      pa.array([*seen[0, at].tolist(), int(rows[0])])], names=["f", "p", "u"])


class Scorer:
    """Linear scorer over the chosen features."""

    def __init__(self, features: np.ndarray):
        self.place = {int(f): i for i, f in enumerate(features)}
        self.weight, self.constant = np.zeros(len(features)), 0.0
        self.memo = None

    def _places(self, word: str) -> tuple[int, ...]:
        return tuple(self.place[f] for f in word_features(word) if f in self.place)

    def vector(self, text: str | None) -> np.ndarray:
        self.memo = self.memo if self.memo is not None else Memo(self._places)
        ws = WORD.findall(text.lower()) if text else []
        ids = [i for t in map(self.memo.__getitem__, ws) if t for i in t]
        return np.sqrt(np.bincount(ids, minlength=len(self.place)) / len(ws)) if ids else np.zeros(len(self.place))

    def score(self, text: str | None) -> float:
        g = float(self.vector(text) @ self.weight) + self.constant
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


def nnpu(x: np.ndarray, u: np.ndarray, prior: float, steps: int = 300, rate: float = 0.03, ridge: float = 0.01):
    """Weights and constant that minimise the non-negative risk over positives x and unlabelled u."""
    scale = np.sqrt((u ** 2).mean(axis=0) + 1e-4)
    x, u = x / scale, u / scale
    theta = np.zeros(x.shape[1] + 1)
    theta[-1] = -2.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        gx, gu = x @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        sx, su = 1 / (1 + np.exp(-gx)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gx).mean()
        if negative >= 0:
            ex, eu = prior * (sx - 1 - sx) / len(x), su / len(u)
        else:
            ex, eu = prior * sx / len(x), -su / len(u)
        grad = np.append(x.T @ ex + u.T @ eu + ridge * theta[:-1], ex.sum() + eu.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad ** 2
        theta -= rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    return theta[:-1] / scale, float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
        m: int = 5, fold: int = 0, max_positive: int = 3000, max_unlabelled: int = 6000, features: int = 500,
        least_z: float = 4.0) -> Scorer:
    known = training_labels(labels, id_col, label, m, fold)
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    prior = (toxic + 0.5) / (n + 1)
    scorer = Scorer(np.empty(0, np.int64))
    scorer.constant = float(np.log(prior / (1 - prior)))
    if not toxic:
        return scorer
    # the confirmed rows: at most max_positive ids, so the join can broadcast them
    confirmed = F.broadcast(first_by_turn(known.where("_label = 1").select("_id"), max_positive, 1))
    rows = docs.where(~held_out(id_col, m, fold) & docs[id_col].isNotNull()).select(
        docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    last = first_by_turn(rows.select("_id"), max_unlabelled, 2).agg(F.max(turn("_id", 2))).first()[0]
    if last is None:
        return scorer
    # document shares of the features: over every training row of the corpus
    flagged = rows.join(confirmed.withColumn("_p", F.lit(True)), "_id", "left").select("_text", F.coalesce("_p", F.lit(False)).alias("_p"))
    share = staged(flagged.mapInArrow(_counted, "f bigint, p bigint, u bigint").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")), "shares")
    np_, nu = share.where("f = -1").select("p", "u").first() or (0, 0)
    if not np_:
        return scorer
    both = (F.col("p") + F.col("u")) / (np_ + nu)
    z = F.abs(F.col("p") / np_ - F.col("u") / nu) / F.sqrt(both * (1 - both) * (1 / np_ + 1 / nu) + 1e-12)
    chosen = [r["f"] for r in share.where((F.col("f") >= 0) & (F.col("p") + F.col("u") >= 3) & (z >= least_z)).orderBy(z.desc(), "f").limit(features).collect()]
    # what enters numpy: the confirmed rows and a bounded part of the unlabelled ones
    sample = (rows.join(confirmed, "_id").select("_text", F.lit(True).alias("_p"))
              .union(rows.where(turn("_id", 2) <= F.lit(last)).select("_text", F.lit(False).alias("_p"))))
    scorer = Scorer(np.array(chosen, np.int64))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            rows = [scorer.vector(t).astype(np.float32).tobytes() for t in column(b, "_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "_p"), pa.array(rows, pa.binary())], names=["p", "x"])

    # in an order of its own, so that the fit does not depend on how rows are dealt
    got: pd.DataFrame = sample.mapInArrow(vectors, "p boolean, x binary").toPandas().sort_values(["p", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1).astype(np.float64)
    positive = got["p"].to_numpy(bool)
    scorer.weight, scorer.constant = nnpu(x[positive], x[~positive], prior)
    return scorer


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score``."""
    rest = [c for c in docs.columns if c != "score"]
    scorer.memo = None
    ours = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([ours.value.score(t) for t in each(texts)], pa.float64())

    return docs.select(*rest, F.arrow_udf(run, "double")(docs[text_col]).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int = 5,
             fold: int = 0, **options) -> DataFrame:
    """``docs`` plus ``score``, ``predicted`` and ``held_out``."""
    scorer = fit(docs, labels, id_col, text_col, m=m, fold=fold, **options)
    out = score(docs, scorer, text_col)
    return out.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "held_out": held_out(id_col, m, fold)})


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = toxicity(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", "held_out", "score", "predicted")

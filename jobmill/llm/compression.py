"""Quality by compression.

Two zstandard dictionaries are trained, one on pieces of good and one on pieces of bad
labelled text. A text is cut into pieces of ``PIECE`` bytes (all of it is used), each piece
is compressed with either dictionary, and the sizes are summed. The normalised difference
``(bad - good) / (bad + good)`` says which kind of text it resembles; together with how far
it shrinks at all (text that repeats itself shrinks under both) it goes through a logistic
calibration, fitted on labelled rows that no dictionary has seen.

Labels are learnt from training rows only. The samples are bounded by parameters
(``max_rows`` labelled documents per label and use, ``max_pieces`` pieces per dictionary),
chosen by a hash. Scoring is one narrow pass over the whole corpus.

Defined results: a null text is empty; an empty text gets the calibration's share of good
rows; without labelled rows of both kinds every score is that share; labels with a null id
or value are ignored; other columns pass through, a column named ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, each, slices
from .labelled import first_by_turn, held_out, training_labels

PIECE = 1024


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


class Scorer:
    """The dictionaries and the calibration; compressors are made where it runs."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.dictionaries, self.level, self.tools = (good, bad), level, None
        self.weight, self.constant, self.centre, self.scale = np.zeros(4), 0.0, np.zeros(4), np.ones(4)

    def __getstate__(self):
        return self.__dict__ | {"tools": None}

    def features(self, text: str | None) -> np.ndarray:
        if self.tools is None:
            self.tools = []
            for raw in self.dictionaries:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(self.level)
                self.tools.append(zstandard.ZstdCompressor(dict_data=d, level=self.level, write_checksum=False,
                                                           write_content_size=False, write_dict_id=False))
        parts = pieces(text)
        good, bad = (sum(len(t.compress(p)) for p in parts) for t in self.tools)
        difference = (bad - good) / (bad + good)
        shrunk = np.log((good + bad) / (2 * sum(map(len, parts))))
        return np.array([difference, difference * abs(difference), shrunk, shrunk * shrunk])

    def score(self, text: str | None) -> float:
        g = self.constant
        if text and self.dictionaries[0]:
            g += float(((self.features(text) - self.centre) / self.scale) @ self.weight)
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


def calibrate(scorer: Scorer, x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-3) -> None:
    """Logistic regression by Newton steps; each label's rows weigh as its share of the labels."""
    scorer.centre, scorer.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - scorer.centre) / scorer.scale, np.ones(len(x))])
    w = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    theta = np.zeros(z.shape[1])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        grad = z.T @ (w * (s - y)) + ridge * theta
        step = np.linalg.solve((z * (w * s * (1 - s))[:, None]).T @ z + ridge * np.eye(len(theta)), grad)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    scorer.weight, scorer.constant = theta[:-1], float(theta[-1])


def _trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples; their own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
        m: int = 3, fold: int = 1, max_rows: int = 3000, max_pieces: int = 6000, size: int = 64 << 10) -> Scorer:
    known = training_labels(labels, id_col, label, m, fold)
    count = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    good, bad = count.get(1, 0), count.get(0, 0)
    share = (good + 0.5) / (good + bad + 1)
    scorer = Scorer(b"", b"")
    scorer.constant = float(np.log(share / (1 - share)))
    if not good or not bad:
        return scorer
    # the same hash that orders the rows deals them to dictionaries and calibration
    use = F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(2))
    picked = [first_by_turn(known.withColumn("_use", use).where((F.col("_label") == y) & (F.col("_use") == u)), max_rows, 3)
              for y in (0, 1) for u in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]).union(picked[2]).union(picked[3]))  # at most 4 * max_rows ids
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(ids, "_id").where("_text != ''")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            out = [(y, i, k, p) for y, i, t in zip(*(column(b, c).to_pylist() for c in ("_label", "_id", "_text")))
                   for k, p in enumerate(pieces(t))]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["y", "i", "k", "p"])

    cuts = rows.where("_use = 0").select("_label", F.col("_id").cast("long").alias("_id"), "_text").mapInArrow(cut, "y int, i bigint, k bigint, p binary")
    n = {r["y"]: r["n"] for r in cuts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(11), "i", "k")
    part = F.when(F.col("y") == 1, F.lit(min(1.0, max_pieces / max(1, n.get(1, 1))))).otherwise(F.lit(min(1.0, max_pieces / max(1, n.get(0, 1)))))
    got = cuts.where(F.pmod(order, F.lit(1 << 20)) < part * (1 << 20)).orderBy("y", "i", "k", "p").toPandas()
    samples = {y: [bytes(p) for p in got.loc[got["y"] == y, "p"]] for y in (0, 1)}
    if not samples[0] or not samples[1]:
        return scorer
    scorer.dictionaries = (_trained(samples[1], size), _trained(samples[0], size))
    constant = scorer.constant

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            x = [scorer.features(t).tolist() for t in column(b, "_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "_label"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    held = rows.where("_use = 1").select("_label", "_text").mapInArrow(measure, "y int, x array<double>").orderBy("y", "x").toPandas()
    if held["y"].nunique() == 2:
        calibrate(scorer, np.array(held["x"].tolist()), held["y"].to_numpy(), share)
    if not np.isfinite(scorer.constant):
        scorer.constant, scorer.weight = constant, np.zeros(4)
    return scorer


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score``: 0 to 1, higher for text like the rows labelled 1."""
    ours = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([ours.value.score(t) for t in each(texts)], pa.float64())

    return docs.select(*[c for c in docs.columns if c != "score"], F.arrow_udf(run, "double")(docs[text_col]).alias("score"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

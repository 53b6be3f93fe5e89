"""Periodic stretches of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, at least ``max(min_words,
2 * q)`` words long, that no neighbouring word extends with period q. All runs of a text
are found in n log n steps:

* Dictionary: equal factors of 1, 2, 4, ... words get equal names; a factor's name comes
  from the names of its halves, and only factors that occur again go on to the next length.
* Proposals: per length m, every place that is a multiple of m looks at the later
  occurrences of its factor between 2m and 4m words away (at m = 1 also one word away). A
  run of a period in that range covers such a place, as it holds m + 1 starts of factors in
  a row that come again one period later. Occurrences in arithmetic progression with a
  step of at most m overlap, so the text between them has that step as a period, and only
  the first of them is proposed: multiples of a period never make a run of their own.
* Extension: a proposed pair of places is extended to both sides by comparing names from the
  longest length down. Stretches that are long enough are runs; of equal stretches the
  smallest period stays (the others are its multiples).

A task works on slices of about 4 MB of text (a longer text alone), all texts of a slice
at once: their words lie in one array with a mark between texts that equals nothing. Memory
follows the slice: 4 bytes a word for each length that still has repeated factors. Texts
need no shuffle, and a lost executor repeats its slices only.

Defined results: a null or empty text, or one without words, has no runs and collapses to an
empty text; rows are judged one by one, so repeated rows and repeated or null ids are kept as
they are; an empty table gives an empty result; other columns pass through, and columns named
like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import column, slices

RUN = StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")])
_GAP = r"[\x20\x09-\x0D]+"


def _named(key: np.ndarray, at: np.ndarray, n: int):
    """Names of the factors with keys ``key`` at the ascending places ``at``: an array over all
    places (negative and all different where a factor occurs once), and the repeated places,
    ordered by name and place, with their names."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    group = np.cumsum(np.r_[False, k[1:] != k[:-1]]) if k.size else np.zeros(0, np.int64)
    again = np.bincount(group)[group] > 1 if k.size else np.zeros(0, bool)
    place, group = at[order][again], group[again]
    name = -1 - np.arange(n + 1, dtype=np.int32 if n < 2**31 - 2 else np.int64)
    name[place] = group
    return name, place, group


def _dictionary(key: np.ndarray, at: np.ndarray, n: int):
    """Per length 1, 2, 4, ...: the names and the repeated places, until nothing repeats."""
    levels, m = [], 1
    while True:
        name, place, group = _named(key, at, n)
        if not place.size:
            return levels
        levels.append((m, name, place, group))
        at = np.sort(place)
        at = at[at + m < n]
        at = at[name[at + m] >= 0]
        key = name[at].astype(np.int64) * (n + 1) + name[at + m]
        m *= 2


def _proposals(m: int, place: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (x, y) whose factors of length m are equal and whose distance is a
    period that a run around x may have."""
    gap = np.where(group[1:] == group[:-1], place[1:] - place[:-1], 0)
    progression = np.cumsum(np.r_[True, gap[1:] != gap[:-1]])
    width = n + 4 * m + 1
    line = group.astype(np.int64) * width + place
    first = np.flatnonzero(place % m == 0)
    low = np.searchsorted(line, line[first] + (1 if m == 1 else 2 * m))
    many = np.searchsorted(line, line[first] + 4 * m) - low
    x = np.repeat(first, many)
    y = np.arange(x.size) + np.repeat(low - (np.cumsum(many) - many), many)
    implied = (y - x >= 2) & (gap[x] <= m) & (progression[x] == progression[y - 1]) if x.size else np.zeros(0, bool)
    return place[x[~implied]], place[y[~implied]]


def _extended(levels, x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last (exclusive) word of the widest stretch around x and y > x whose
    words equal those y - x words on."""
    start, end, back = x.copy(), y.copy(), y.copy()
    ahead = x.copy()
    for m, name, _, _ in reversed(levels):
        ok = name[ahead] == name[end]
        ahead, end = ahead + m * ok, end + m * ok
        ok = (start >= m) & (name[start - m] == name[back - m])
        start, back = start - m * ok, back - m * ok
    return start, end


def runs_of(key: np.ndarray, at: np.ndarray, n: int, min_words: int = 12) -> np.ndarray:
    """Rows (start, end, period) of all runs in ``n`` places, ordered; ``key`` names the words
    at the places ``at``, and a place without a word equals nothing."""
    levels = _dictionary(key, at, n)
    found = [np.zeros((0, 3), np.int64)]
    for m, _, place, group in levels:
        x, y = _proposals(m, place, group, n)
        start, end = _extended(levels, x, y, n)
        long = end - start >= np.maximum(min_words, 2 * (y - x))
        found.append(np.unique(np.stack([start, end, y - x], axis=1)[long], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]] if len(rows) else rows


def _slice_runs(texts: list[list[bytes]], min_words: int):
    """Runs of all texts (lists of words) as places in one array, and each text's first place."""
    table: dict[bytes, int] = {}
    ids = np.array([table.setdefault(w, len(table)) for words in texts for w in words], dtype=np.int64)
    size = np.array([len(words) for words in texts], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    text = np.repeat(np.arange(len(texts)), size)
    return runs_of(text * max(1, len(table)) + ids, np.arange(ids.size) + text, int((size + 1).sum()), min_words), begin, size


def _collapsed(words: list[bytes], rows: np.ndarray, begin: int) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(rows):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2] - begin, 1)
    np.add.at(change, rows[:, 1] - begin, -1)
    return b" ".join(compress(words, np.cumsum(change[:-1]) == 0))


def periodic_runs(docs: DataFrame, text_col: str = "text", min_words: int = 12) -> DataFrame:
    """``docs`` with ``text_col`` collapsed, plus ``runs`` (array of start, length and period, by
    start, then period) and ``n_runs``. Words are separated by space and \\x09-\\x0D."""
    rest = [c for c in docs.columns if c not in (text_col, "runs", "n_runs")]
    row = F.struct(*[docs[c] for c in rest], F.lit(None).cast("string").alias("_none"))
    base = docs.select(row.alias("_row"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("_t"))
    kind = pa.struct([(f.name, pa.int64()) for f in RUN])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_t"):
            texts = [t.split() for t in column(b, "_t").to_pylist()]
            rows, begin, size = _slice_runs(texts, min_words)
            owner = np.searchsorted(begin, rows[:, 0], side="right") - 1
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            flat = [rows[:, 0] - begin[owner], rows[:, 1] - rows[:, 0], rows[:, 2]]
            # by start, then period: rows come by start, then end
            order = np.lexsort((flat[2], flat[0], owner))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()),
                                             pa.StructArray.from_arrays([pa.array(c[order]) for c in flat], fields=list(kind)))
            kept = [_collapsed(w, rows[a:z], int(begin[k])) for k, (w, a, z) in enumerate(zip(texts, cut, cut[1:]))]
            yield pa.RecordBatch.from_arrays([column(b, "_row"), pa.array(kept, pa.binary()), lists], ["_row", "_t", "runs"])

    out = base.mapInArrow(scan, StructType([base.schema["_row"], base.schema["_t"],
                                            StructField("runs", ArrayType(RUN, False), False)]))
    back = [F.col("_t").cast(StringType()).alias(c) if c == text_col else F.col("_row")[c].alias(c)
            for c in docs.columns if c not in ("runs", "n_runs")]
    return out.select(*back, "runs", F.size("runs").cast("long").alias("n_runs"))


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in about a tenth of the texts, chosen, cut and given a
    period by the checksum of ``doc_id`` (a null id is never chosen)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10)))
    words = chosen.withColumn("_w", F.when(F.col("_g").isNotNull(), F.array_remove(F.split(F.coalesce("text", F.lit("")), _GAP), "")))
    n = F.size("_w")
    cut = words.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    step = cut.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    a, p = F.col("_a"), F.col("_p")
    tail = F.transform("_w", lambda w, i: F.when(i < a, w).otherwise(F.get("_w", a + (i - a) % p)))
    return step.withColumn("text", F.when(a.isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text"))).drop("_g", "_w", "_a", "_p")


def periodic_digest(docs: DataFrame) -> DataFrame:
    out = periodic_runs(with_planted_tails(docs.select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (out.withColumn("_b", best)
            .select("doc_id", "n_runs", (-F.col("_b.s")).alias("start"), F.col("_b.l").alias("length"),
                    (-F.col("_b.p")).alias("period"), F.expr("1000 * _b.l div -_b.p").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256")))

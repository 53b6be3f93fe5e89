"""Benchmark decontamination with a generalised suffix automaton over words.

The words of the test items build one automaton (a state per class of equal end positions;
items are separated by resetting to the root). Every document's words are streamed through
it; the walk yields at each word the length of the longest stretch ending there that also
stands in some item. Stretches of a window's length (13 words, or a whole shorter item) are
hits: their words are marked, and the items that hold them are noted.

The scan is narrow: no shuffle, and a document never leaves its task. Words outside the
items' vocabulary end every match, so only runs of known words are walked. The items are
read in chunks of at most ``chunk_words`` words (the driver holds one chunk, a broadcast
carries it, a worker builds its automaton once and keeps the last two); each chunk is one more narrow pass that adds to
the marks of the passes before, so a test set of any size gives the same result.

Defined results: a null or empty text, and an item without words, has no words and no hits;
equal items each count; an item without an id is named by the empty string; rows that repeat an id are separate documents; an empty item table
leaves every document clean; other columns pass through, columns named like an output are
replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of a word stay (A-Z in lower case), all others become spaces; UTF-8 keeps the rest apart.
_CLEAN = bytes(c if WORD.fullmatch(bytes([c])) else 32 for c in bytes(range(256)).lower())



def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split() if text else []


class Automaton:
    """Generalised suffix automaton of the items' word sequences, with what the scan needs:
    ``windows[state]`` the items of the state's window-length string, ``short[state]`` the
    whole short items that end every string of the state (longest first, with their items)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = []
        for name, ws in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in ws]
            coded.append((name, seq))
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.windows: dict[int, set[str]] = {}
        self.whole: dict[int, tuple[int, set[str]]] = {}
        self.shortest = min([window, *(len(s) for _, s in coded if s)])
        for name, seq in coded:
            if not seq:
                continue
            state = 0
            for i, w in enumerate(seq):
                state = self.next[state][w]
                if len(seq) >= window and i + 1 >= window:
                    while self.len[self.link[state]] >= window:
                        state = self.link[state]
                    self.windows.setdefault(state, set()).add(name)
            if len(seq) < window:
                # the whole item is the string of this length in its state
                while self.len[self.link[state]] >= len(seq):
                    state = self.link[state]
                self.whole.setdefault(state, (len(seq), set()))[1].add(name)

    def _extend(self, last: int, w: int) -> int:
        to = self.next[last].get(w)
        if to is not None:
            if self.len[to] == self.len[last] + 1:
                return to
            return self._clone(last, w, to)
        cur = self._state(self.len[last] + 1)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.len[p] + 1)
        self.next[c] = dict(self.next[q])
        self.link[c] = self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def scan(self, ws: list[bytes], hit: np.ndarray, found: set[str]) -> None:
        """Mark in ``hit`` the words inside any window, add the items to ``found``."""
        n = len(ws)
        ids = np.fromiter((self.ids.get(w, -1) for w in ws), np.int64, n)
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for a, z in zip(known[::2].tolist(), known[1::2].tolist()):
            if z - a >= self.shortest:
                self._walk(ids[a:z].tolist(), a, hit, found)

    def _walk(self, seq: list[int], at: int, hit: np.ndarray, found: set[str]) -> None:
        state, length = 0, 0
        nxt, link, lens = self.next, self.link, self.len
        for i, w in enumerate(seq):
            while state and w not in nxt[state]:
                state = link[state]
                length = lens[state]
            if w in nxt[state]:
                state = nxt[state][w]
                length += 1
            if length > self.window:
                # longer stretches add nothing beyond the windows inside them
                length = self.window
            while state and lens[link[state]] >= length:
                state = link[state]
            if length == self.window:
                hit[at + i + 1 - length:at + i + 1] = 1
                found |= self.windows.get(state, ())
            if self.whole:
                s = state
                while s:
                    short = self.whole.get(s)
                    if short and short[0] <= length:
                        hit[at + i + 1 - short[0]:at + i + 1] = 1
                        found |= short[1]
                    s = link[s]


def _chunks(items: DataFrame, item_col: str, text_col: str, chunk_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    chunk, size = [], 0
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator()
    for name, text in rows:
        ws = words(text)
        if chunk and size + len(ws) > chunk_words:
            yield chunk
            chunk, size = [], 0
        if ws:
            chunk.append((name, ws))
            size += len(ws)
    if chunk:
        yield chunk


def _runs(hit: np.ndarray) -> list[dict]:
    e = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])))).tolist()
    return [{"first": a, "last": z - 1} for a, z in zip(e[::2], e[1::2])]


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


#: This worker's automata by the name of their chunk, the newest last.
_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, chunk, window: int) -> Automaton:
    made = _BUILT.pop(name, None) or Automaton(chunk.value, window)
    _BUILT[name] = made
    while len(_BUILT) > 2:
        del _BUILT[next(iter(_BUILT))]
    return made


def _scanner(chunk, window: int):
    """A pass of one chunk (a broadcast) over the rows."""
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            automaton = _automaton(name, chunk, window)
            n, spans, items = [], [], []
            before = zip(column(b, "_spans").to_pylist(), column(b, "_items").to_pylist())
            for text, (s, names) in zip(column(b, "_text").to_pylist(), before):
                ws = words(text)
                hit = np.zeros(len(ws), np.int8)
                for run in s or ():
                    hit[run["first"]:run["last"] + 1] = 1
                found = set(names or ())
                automaton.scan(ws, hit, found)
                n.append(len(ws))
                spans.append(_runs(hit))
                items.append(sorted(found))
            new = {"_n": pa.array(n, pa.int64()), "_spans": pa.array(spans, SPANS), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(f.name, column(b, f.name)) for f in b.schema], names=b.schema.names)
    return scan


def _without(text, spans):
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for s in spans:
        out.append(raw[at:places[s["first"]][0]])
        at = places[s["last"]][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "item_id", item_text: str = "text",
                       text_col: str = "text", window: int = 13, coverage: float = 0.05,
                       chunk_words: int = 2_000_000) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_hit``, ``hit_spans`` (first and last word of each
    maximal hit run), ``hit_items`` (item ids as strings, sorted) and ``contaminated``: any
    hit, and hits on at least ``coverage`` of the words."""
    spark = docs.sparkSession
    made = ("n_words", "n_hit", "hit_spans", "hit_items", "contaminated")
    rest = [c for c in docs.columns if c not in made]
    rows = docs.select(F.struct(*rest).alias("_row"), docs[text_col].alias("_text"),
                       F.lit(None).cast("bigint").alias("_n"),
                       F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("_spans"),
                       F.lit(None).cast("array<string>").alias("_items"))
    rows = rows.withColumn("_row", F.col("_row").dropFields(text_col)) if len(rest) > 1 else rows.drop("_row")
    got = False
    for chunk in _chunks(items, id_col, item_text, chunk_words):
        rows = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(chunk), window), rows.schema)
        got = True
    if not got:
        rows = rows.mapInArrow(_scanner(spark.sparkContext.broadcast([]), window), rows.schema)
    hits = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda t, s: t + s["last"] - s["first"] + 1)
    out = rows.withColumn("_hit", hits)
    back = [F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in rest]
    return out.select(*back, F.col("_n").alias("n_words"), F.col("_hit").alias("n_hit"),
                      F.col("_spans").alias("hit_spans"), F.col("_items").alias("hit_items"),
                      ((F.col("_hit") > 0) & (F.col("_hit") >= coverage * F.col("_n"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents; the others lose their hit spans."""
    rest = [c for c in docs.columns if c != text_col]
    held = docs.select(*([F.struct(*rest).alias("_in")] if rest else []), docs[text_col].alias("_doc"))
    found = find_contamination(held, items, text_col="_doc", **options).where("not contaminated")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(map(_without, texts.to_pylist(), spans.to_pylist()), pa.string())

    clean = F.when(F.size("hit_spans") > 0, F.arrow_udf(cut, "string")(F.when(F.size("hit_spans") > 0, F.col("_doc")), F.col("hit_spans"))) \
        .otherwise(F.col("_doc"))
    return found.select(*[clean.alias(c) if c == text_col else F.col("_in")[c].alias(c) for c in docs.columns])


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = find_contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
                        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS g
        FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
dk AS (SELECT d.rid, d.w, s.k FROM d, (SELECT DISTINCT k FROM win) AS s WHERE len(d.w) >= s.k),
dg AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
       FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dk)),
hit AS (SELECT DISTINCT rid, k, p, item FROM dg JOIN win USING (k, g)),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hit) GROUP BY rid),
names AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN names USING (rid)
"""

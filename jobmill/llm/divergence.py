"""Source divergence audit: how far each source's terms stand from its language's.

Terms are runs of ASCII letters and non-ASCII characters, with A-Z lower-cased. A language
keeps the terms of at least ``min_docs`` of its documents. Every (language, source) group
and every language gives each kept term a smoothed share p in billionths, and two shares
differ by f = floor((p - q)^2 / (p + q)). Everything is whole-number arithmetic.

* Counting: every task counts its own documents by group and term (bounded tables that are
  handed on when full), so one exchange of pre-aggregated rows carries the whole corpus: a
  source with a third of all rows costs no more than the others.
* Cells: a group's terms with equal counts in the group and in the language have equal
  shares. Terms are grouped into such cells, f is evaluated per cell, cells of equal value
  are merged, and the values are ranked by cumulative multiplicity. Only the cells that reach
  the first ``top`` ranks are expanded to terms again and ordered in UTF-8 order. Rank limits
  apply within each task before the exchange, so no group's terms meet in one task.
* Pairs of sources: kept terms are dealt to blocks by hash. A block holds the counts of its
  terms in all sources of the language (absent ones are zero), merges terms whose counts are
  equal everywhere, and gives one partial sum per pair of sources. Blocks are sized by rows,
  the dense part is cut into pieces of bounded size, and the partial sums are added up.

Defined results: a null text, language or source is read as empty; each row is a document,
repeated ids and rows included; a group without terms takes part in ``pair``; a language that
keeps no term has ``pair`` rows of value 0 and no ``term`` rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, group_apart, slices, staged

SCALE = 1_000_000_000
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_KEY = ["lang", "source"]


def _pieces(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``size`` bytes of text."""
    raw, a = raw.translate(_TO_TERMS), 0
    while a < len(raw):
        z = len(raw) if len(raw) - a <= size else raw.find(b" ", a + size)
        z = len(raw) if z < 0 else z
        yield raw[a:z].split()
        a = z


def term_counts(docs: DataFrame, limit: int = 300_000) -> DataFrame:
    """(lang, source, term, n, d): occurrences of a term in a group and the group's documents
    that hold it, several rows each; a null term counts all documents of the group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = docs.select(*[text(c).alias(c) for c in _KEY], text("text").cast("binary").alias("_t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d, rows = defaultdict(Counter), defaultdict(Counter), Counter()

        def out() -> pa.RecordBatch:
            flat = [(*g, t, k, d[g][t]) for g, c in n.items() for t, k in c.items()] + [(*g, None, 0, k) for g, k in rows.items()]
            cols = list(zip(*flat))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:2]),
                                               pa.array(cols[2], pa.binary()).cast(pa.string()),
                                               *(pa.array(c, pa.int64()) for c in cols[3:])], ["lang", "source", "term", "n", "d"])

        for b in slices(batches, "_t"):
            for g0, g1, raw in zip(*(column(b, c).to_pylist() for c in ("lang", "source", "_t"))):
                g, held = (g0, g1), set()
                rows[g] += 1
                for terms in _pieces(raw):
                    n[g].update(terms)
                    held.update(terms)
                d[g].update(held)
            if sum(map(len, n.values())) + len(rows) >= limit:
                yield out()
                n.clear(), d.clear(), rows.clear()
        if rows:
            yield out()

    return base.mapInArrow(count, "lang string, source string, term string, n bigint, d bigint")


def _share(count: Column, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for any long."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"),
                           (F.col(total) + 2 * F.col(kept)).cast("decimal(20,0)")) + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _top_terms(held: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    cells = held.groupBy(*_KEY, "n", "c").agg(F.count("*").alias("m"))
    p, q = _share(F.col("n"), "total", "kept"), _share(F.col("c"), "lang_total", "kept")
    valued = (cells.join(groups, _KEY).withColumn("p", p).withColumn("q", q).where("p > q")
              .select(*_KEY, "n", "c", "m", _distance(F.col("p"), F.col("q")).alias("value")))
    order = Window.partitionBy(*_KEY).orderBy(F.desc("value"))
    # equal values are merged; the first `top` values hold the first `top` terms
    values = (valued.groupBy(*_KEY, "value").agg(F.sum("m").alias("m"))
              .withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
              .withColumn("before", F.sum("m").over(order) - F.col("m")).where(F.col("before") < top))
    wanted = valued.select(*_KEY, "n", "c", "value").join(values.select(*_KEY, "value"), [*_KEY, "value"])
    named = Window.partitionBy(*_KEY).orderBy(F.desc("value"), "term")
    return (held.join(wanted, [*_KEY, "n", "c"]).withColumn("rank", F.row_number().over(named)).where(F.col("rank") <= top)
            .select(*_KEY, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def _blocks(left: pd.DataFrame, right: pd.DataFrame, max_cells: int) -> pd.DataFrame:
    """Partial sums of f over a block's terms, for each pair of a language's sources."""
    right = right.sort_values("source")
    names, kept = right["source"].to_numpy(), int(right["kept"].iloc[0])
    sums = np.zeros((len(names), len(names)), dtype=object)
    if len(left):
        row = pd.Index(names).get_indexer(left["source"])
        col, terms = pd.factorize(left["term"])
        order = np.argsort(col, kind="stable")
        row, col, n = row[order], col[order], left["n"].to_numpy()[order]
        below = np.array([int(t) + 2 * kept for t in right["total"]], dtype=object)[:, None]
        step = max(1, max_cells // len(names))
        for a in range(0, len(terms), step):
            lo, hi = np.searchsorted(col, [a, a + step])
            counts = np.zeros((len(names), min(step, len(terms) - a)), dtype=np.int64)
            counts[row[lo:hi], col[lo:hi] - a] = n[lo:hi]
            counts, many = np.unique(counts, axis=1, return_counts=True)
            if counts.max() < 2**63 // SCALE - 2:
                p = SCALE * (counts + 2) // below.astype(np.int64) + 1
            else:  # Python integers where a product leaves 64 bits
                p = (SCALE * (counts.astype(object) + 2) // below).astype(np.int64) + 1
            for i in range(len(names) - 1):
                d = p[i] - p[i + 1:]
                sums[i, i + 1:] += (d * d // (p[i] + p[i + 1:]) * many).sum(axis=1)
    i, j = np.triu_indices(len(names), 1)
    return pd.DataFrame({"lang": right["lang"].iloc[0], "a": names[i], "b": names[j], "value": sums[i, j].astype(np.int64)})


def _pairs(held: DataFrame, groups: DataFrame, block_rows: int, max_cells: int) -> DataFrame:
    blocks = 1 + held.count() // block_rows
    left = held.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "source", "term", "n")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"),
                          "source", "total", "kept")
    sums = (left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block"))
            .applyInPandas(lambda x, y: _blocks(x, y, max_cells), "lang string, a string, b string, value bigint"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    whole = (sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
             .select("lang", "value", F.explode(both).alias("g")).select("lang", "g.source", "g.item", "value"))
    order = Window.partitionBy(*_KEY).orderBy(F.desc("value"), "item")
    return whole.select(*_KEY, F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence_audit(docs: DataFrame, min_docs: int = 10, top: int = 10,
                     block_rows: int = 100_000, max_cells: int = 1 << 20) -> DataFrame:
    """(lang, source, part, item, value, rank): per group the other sources of its language by
    distance (``part`` = pair) and its ``top`` over-represented terms (``part`` = term).
    ``block_rows`` and ``max_cells`` bound a block's rows and its dense pieces."""
    # the tasks have combined their rows: another partial aggregation before the exchange would find little
    dealt = term_counts(docs).repartition(*_KEY, "term")
    counts = staged(dealt.groupBy(*_KEY, "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "term-counts")
    terms = counts.where(F.col("term").isNotNull())
    common = group_apart(terms, ["lang", "term"], F.sum("n").alias("c"), F.sum("d").alias("d")).where(F.col("d") >= min_docs)
    held = staged(terms.drop("d").join(common.drop("d"), ["lang", "term"]), "kept-terms")
    langs = held.groupBy("lang").agg(F.count_distinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = (counts.where(F.col("term").isNull()).select(*_KEY)
              .join(held.groupBy(*_KEY).agg(F.sum("n").alias("total")), _KEY, "left").join(langs, "lang", "left")
              .select(*_KEY, zero("total"), zero("kept"), zero("lang_total")))
    groups = staged(groups, "groups")
    out = _pairs(held, groups, block_rows, max_cells).unionByName(_top_terms(held, groups, top))
    return out.select(*_KEY, "part", "item", "value", F.col("rank").cast("int").alias("rank"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, term, count(*) AS n FROM (
    SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS c FROM w GROUP BY lang, term HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c) AS big FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
h AS (SELECT lang, source, term, sum(w.n) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN h USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(h.n, 0)::HUGEINT + 2)) // (s.total::HUGEINT + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.c + 2)) // (v.big::HUGEINT + 2 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""

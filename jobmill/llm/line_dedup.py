"""Line de-duplication over a corpus.

Every text is exploded into lines, a line's normalised key is hashed (two independent
64-bit hashes), the distinct documents per hash are counted, lines over the threshold are
dropped everywhere but in the smallest id that holds them, and the texts are put together
again by position.

* The count is an aggregation by hash with map-side combining: a line that stands in a
  third of all documents reaches the reducers as one row per map task.
* The join back sends only (id, position, hash). Its other side has one row per repeated
  hash and an exchange of its own, so adaptive skew handling can split a hot line.
* The text moves once, as the array of its lines.

Defined results: a null or empty text is one empty line; a null id counts as one document
that orders after all others; rows that repeat an id are one document, and each keeps its
own lines; an empty table gives an empty result; other columns pass through, and columns
named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, WS, group_apart, lower_az


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, plus ``n_lines`` and ``n_dropped``."""
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(F.coalesce(docs[id_col], F.lit(NO_ID)).alias("_id"),
                       F.xxhash64(text).alias("_th"), text.alias("_text"),
                       F.struct(*[docs[c] for c in rest]).alias("_rest"))
    lines = (base.select("_id", "_th", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
             .withColumn("_key", lower_az(F.btrim("_line", F.lit(WS))))
             .where(F.length("_key") >= min_chars)
             .select("_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"),
                     F.xxhash64(F.lit(1), "_key").alias("_h2")))
    # two documents or more hold a line exactly when its smallest and largest ids differ
    repeated = (F.col("_first") != F.col("_last")) if min_docs == 2 else (F.col("_n") >= min_docs)
    aggs = [F.min("_id").alias("_first"), F.max("_id").alias("_last")]
    if min_docs != 2:
        aggs.append(F.count_distinct("_id").alias("_n"))
    common = group_apart(lines, ["_h1", "_h2"], *aggs).where(repeated).select("_h1", "_h2", "_first")
    drops = (lines.join(common.hint("shuffle_merge"), ["_h1", "_h2"])
             .where(F.col("_id") != F.col("_first"))
             .groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_drop")))
    whole = base.select("_id", "_th", "_rest", F.split("_text", "\n").alias("_lines"))
    joined = whole.join(drops.hint("shuffle_merge"), ["_id", "_th"], "left")
    n = F.size("_lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_drop"))
    out = joined.select(
        "_rest", n.cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).alias("_n"),
        F.when(F.col("_drop").isNull(), F.array_join("_lines", "\n"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")).alias("_kept"))
    back = [F.col(f"_rest.`{c}`").alias(c) for c in rest]
    return out.select(*back, F.col("_kept").alias(text_col), "n_lines",
                      F.greatest(F.col("_n"), F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line,
         unnest(range(len(string_split(t, chr(10))))) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, c.first IS NOT NULL AND k.doc_id <> c.first AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""

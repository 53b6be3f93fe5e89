"""Line-first quality rules, in DataFrame functions only.

Every line with a word is judged on its own; failing lines are removed, and a document that
loses too much of its text this way is rejected. A line fails when

* punctuation: it has more than one markup symbol ``[#*$%&|<>]`` to four words, or more
  upper-case than lower-case ASCII letters over at least three words;
* navigation: at least a quarter of its words are bare separators;
* boilerplate: it repeats a few words (eight words or more, under a third of them
  different), or is a short line (20 words at most) with a stock web phrase.

Counts over the whole document come beside it: words, their characters, symbols, repeated
lines, and words inside three-word windows that occur twice or more. Everything is one
narrow projection per row (no shuffle, no Python): windows are hashed (64 bits, within one
text), sorted and compared with their neighbours, so the cost is n log n in the text.

Defined results: a null text has no words and one empty line; it fails the base rules as
any text under 50 words; lines without a word are kept and count as neither failed nor
repeated; rows that repeat an id are separate; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words, symbols, separators and stock phrases of the rules.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
SEPARATORS = ["|", "•", "·", "»", "›", ">", "/", "::", "-", "—"]
PHRASES = ["all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use",
           "terms of service", "click here", "sign in", "log in", "sign up", "subscribe to our",
           "enable javascript", "share this", "skip to content", "back to top", "read more"]
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines",
        "lost_chars", "base_failed", "kept")


def _words(c: Column) -> Column:
    return F.array_remove(F.split(c, GAP), "")


def _without(c: Column, pattern: str) -> Column:
    """Code points of ``c`` that the pattern does not match."""
    return F.length(F.regexp_replace(c, pattern, ""))


def _line(x: Column) -> Column:
    """A line, its words, and the counts that the rules compare."""
    return F.struct(x.alias("line"), _words(x).alias("w"), _without(x, GAP).alias("chars"),
                    (F.length(x) - _without(x, SYMBOLS)).alias("sym"),
                    (F.length(x) - _without(x, "[A-Z]")).alias("up"),
                    (F.length(x) - _without(x, "[a-z]")).alias("low"),
                    F.lower(x).rlike("|".join(PHRASES)).alias("stock"))


def _fails(x: Column) -> Column:
    n = F.size(x["w"])
    apart = n - F.size(F.array_except(x["w"], F.array(*map(F.lit, SEPARATORS))))
    # array_except also drops repeats, so the separators are counted only where there are any
    bare = F.when(apart > 0, F.size(F.filter(x["w"], lambda w: w.isin(SEPARATORS)))).otherwise(0)
    return (n > 0) & ((4 * x["sym"] > n) | ((n >= 3) & (x["up"] > x["low"])) | ((bare > 0) & (4 * bare >= n))
            | ((n >= 8) & (3 * F.size(F.array_distinct(x["w"])) < n)) | ((n <= 20) & x["stock"]))


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = 50,
                  max_repeat: float = 0.5, max_loss: float = 0.5) -> DataFrame:
    """``docs`` with the failing lines removed from ``text_col``, plus the counts,
    ``n_failed_lines``, ``lost_chars``, ``base_failed`` and ``kept``."""
    rest = [c for c in docs.columns if c not in MADE and c != text_col]
    row = F.struct(*[docs[c] for c in rest]) if rest else F.lit(None)
    text = F.coalesce(docs[text_col], F.lit(""))
    one = docs.select(row.alias("_row"), text.alias("_t"), _words(text).alias("_w"), F.split(text, "\n").alias("_lines"))
    n = F.size("_w")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                                       lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    two = one.select("_row", "_t", n.cast("long").alias("n_words"), grams.alias("_g"),
                     F.transform("_lines", _line).alias("_l"))
    # windows that occur twice or more: sorted by hash, each beside its like
    many = F.size(F.array_distinct("_g")) < F.size("_g")
    three = two.select("*", F.when(many, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_p"),
                       F.transform("_l", lambda x: F.struct(x["line"].alias("line"), x["chars"].alias("chars"), _fails(x).alias("f"))).alias("_v"),
                       F.transform(F.filter("_l", lambda x: x["chars"] > 0), lambda x: x["line"]).alias("_some"))
    like = lambda x, k: F.get("_p", k)["h"] == x["h"]
    again = F.filter("_p", lambda x, k: F.coalesce(like(x, k - 1), F.lit(False)) | F.coalesce(like(x, k + 1), F.lit(False)))
    four = three.select("*", F.sort_array(F.transform(again, lambda x: x["i"])).alias("_at"),
                        F.filter("_v", lambda x: x["f"]).alias("_bad"))
    # words covered by the windows that start at the sorted places: up to the next start, at most three
    covered = F.aggregate(F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3)))),
                          F.lit(0).cast("long"), lambda s, x: s + x)
    lost = F.aggregate("_bad", F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    kept = F.when(F.size("_bad") > 0, F.array_join(
        F.transform(F.filter("_v", lambda x: ~x["f"]), lambda x: x["line"]), "\n")).otherwise(F.col("_t"))
    five = four.select("_row", kept.alias("_kept"), "n_words", _without(F.col("_t"), GAP).cast("long").alias("word_chars"),
                       (F.length("_t") - _without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
                       (F.size("_some") - F.size(F.array_distinct("_some"))).cast("long").alias("n_dup_lines"),
                       F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
                       F.size("_bad").cast("long").alias("n_failed_lines"), lost.alias("lost_chars"))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    back = [F.col("_kept").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c not in MADE]
    return five.select(*back, *MADE[:7], base.alias("base_failed"),
                       (~base & (F.col("lost_chars") <= max_loss * F.col("word_chars"))).alias("kept"))


def quality_rules_digest(docs: DataFrame) -> DataFrame:
    out = quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
                      "kept", "n_failed_lines", "lost_chars")


_SQL_GAP = r"[\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, p, ws[p] AS a, ws[p + 1] AS b, ws[p + 2] AS c
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM g) WHERE k >= 2),
rep AS (SELECT rid, count(DISTINCT p + o) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
l AS (SELECT rid, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
      FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT rid, line, len(lw) AS n, length(regexp_replace(line, '{_SQL_GAP}', '', 'g')) AS chars,
        length(line) - length(regexp_replace(line, '{SYMBOLS}', '', 'g')) AS sym,
        length(line) - length(regexp_replace(line, '[A-Z]', '', 'g')) AS up,
        length(line) - length(regexp_replace(line, '[a-z]', '', 'g')) AS low,
        len(list_distinct(lw)) AS n_diff,
        len(list_filter(lw, lambda x: x IN ({", ".join(f"'{s}'" for s in SEPARATORS)}))) AS bare,
        regexp_matches(lower(line), '{"|".join(PHRASES)}') AS stock
      FROM l WHERE len(lw) > 0),
v AS (SELECT *, 4 * sym > n OR (n >= 3 AND up > low) OR (bare > 0 AND 4 * bare >= n)
        OR (n >= 8 AND 3 * n_diff < n) OR (n <= 20 AND stock) AS bad FROM f),
s AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_failed_lines,
        coalesce(sum(chars) FILTER (bad), 0) AS lost_chars FROM v GROUP BY rid),
r AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '{_SQL_GAP}', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_failed_lines, 0) AS n_failed_lines, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN s USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_chars <= word_chars AS kept
FROM r
"""

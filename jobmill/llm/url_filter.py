"""URL filters: rules on host and path, and a logistic regression for the rest.

A rule names a host and a path prefix. It fits that host and all its subdomains, if the url's
path starts with the rule's; of the rules that fit, the longest decides. Urls without a rule
are judged by a logistic regression on hashed character n-grams of host and path, trained
from a small labelled url table.

Everything is DataFrame functions. The n-grams of a url are one array expression, hashed to
``buckets`` numbers; training is full-batch descent with one small aggregation per step over
the labelled rows, and only the gradient (at most ``buckets`` sums) comes to the driver.
Gradients are summed as whole numbers, so weights do not depend on how rows are dealt. The
weights stand in the plan as one array of ``buckets`` numbers (bounded by that argument),
and all urls are judged in one projection, without a shuffle.

The labelled table: (url, label), label 1 for block and 0 for allow. ``rule_labels`` makes
one from the urls that the rules decide, at most ``per_label`` different urls of each label, the
first in the order of their hashes; this is the bounded sample of labelled rows that the
classifier is fitted on. Both labels weigh the same in training.

Defined results: the host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; the path goes from there to ``?``, ``#`` or the end. A null url, or one
without ``://``, has an empty host and path, fits no rule and is judged as such. Without labelled
rows of both kinds every url gets the label that there is, or allow. Rows with a null url or
label are not learned from; of rows that repeat a url the larger label counts. Repeated rows
and ids are judged one by one; an empty table gives an empty result; other columns pass
through, and columns named like an output are replaced.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, staged

MADE = ("host", "path", "rule", "block_score", "verdict")
#: Gradients are summed in units of 2^-30.
UNIT = 1 << 30


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = url.contains("://")
    rest = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    front = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.substring_index(front, "/", 1)
    return (F.when(found, lower_az(host)).otherwise(""),
            F.when(found, F.substring(front, F.length(host) + 1, F.length(front))).otherwise(""))


def rule_column(rules: Sequence[tuple[str, str, str]], host: Column, path: Column, value: int) -> Column:
    """The longest fitting rule's text (``value`` 0) or verdict (``value`` 1), else null. Of rules
    of equal length the first in the list wins."""
    out = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.lit((rule_host + rule_path, verdict)[value])).otherwise(out)
    return out


def with_characters(df: DataFrame) -> DataFrame:
    """``df`` with the characters of its ``host`` and ``path`` as arrays, each between marks of its
    own: a place in an array is found at once, in a long string only by counting."""
    def one(c: str, mark: str) -> Column:
        return F.split(F.concat(F.lit(mark), F.col(c), F.lit("\x02")), "")
    return df.select("*", one("host", "\x00").alias("_h"), one("path", "\x01").alias("_p"))


def grams(buckets: int, sizes: Sequence[int]) -> Column:
    """The different hashed n-grams of both character arrays, ascending."""
    def part(chars: str, k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - k, F.lit(0))),
                           lambda i: F.pmod(F.xxhash64(F.lit(chars), *[F.get(chars, i + o) for o in range(k)]), F.lit(buckets)).cast("int"))
    return F.array_sort(F.array_distinct(F.concat(*[part(c, k) for c in ("_h", "_p") for k in sizes])))


def _sum(marks: Column, weights: list[float]) -> Column:
    """The sum of the weights at the marks; the weights are one constant array."""
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return F.aggregate(marks, F.lit(0.0), lambda s, i: s + F.get(w, i))


def _probability(marks: Column, weights: list[float]) -> Column:
    # the last weight is the constant
    return 1 / (1 + F.exp(-(F.lit(weights[-1]) + _sum(marks, weights[:-1]))))


def fit(labelled: DataFrame, buckets: int = 4096, sizes: Sequence[int] = (3, 4), steps: int = 16,
        rate: float = 0.3, decay: float = 1e-3) -> list[float]:
    """``buckets`` weights and a constant, by full-batch descent with a step per weight that
    shrinks with the gradients it has seen. ``labelled`` is small: it is read once per step."""
    known = labelled.where("url IS NOT NULL AND label IS NOT NULL").groupBy("url").agg(F.max("label").cast("int").alias("y"))
    host, path = host_and_path(F.col("url"))
    parts = with_characters(known.select("y", host.alias("host"), path.alias("path")))
    rows = staged(parts.select("y", grams(buckets, sizes).alias("x")), "urls")
    many = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weights, seen = [0.0] * (buckets + 1), [0.0] * (buckets + 1)
    if len(many) < 2:
        # one label or none: certain of it, or of 'allow'
        weights[-1] = 30.0 if 1 in many else -30.0
        return weights
    share = F.when(F.col("y") == 1, F.lit(0.5 / many[1])).otherwise(F.lit(0.5 / many[0]))
    for _ in range(steps):
        error = F.round((F.col("y") - _probability(F.col("x"), weights)) * share * UNIT).cast("long")
        got = (rows.select(error.alias("e"), F.explode(F.concat("x", F.array(F.lit(buckets)))).alias("j"))
               .groupBy("j").agg(F.sum("e").alias("g")).collect())
        for j, g in got:
            g = g / UNIT - decay * weights[j] * (j < buckets)
            seen[j] += g * g
            if seen[j]:
                weights[j] += rate * g / math.sqrt(seen[j])
    return weights


def rule_labels(urls: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url",
                per_label: int = 1000, parts: int = 1024) -> DataFrame:
    """(url, label) of at most ``per_label`` different urls of each label that the rules decide: the
    first in hash order. Counts by slice of the hash range tell how far to read."""
    host, path = host_and_path(F.col("url"))
    h = F.xxhash64(F.lit(5), "url")
    judged = (urls.select(F.col(url_col).alias("url")).where("url IS NOT NULL")
              .select("url", h.alias("h"), F.pmod(h, F.lit(parts)).alias("part"), rule_column(rules, host, path, 1).alias("v"))
              .where("v IS NOT NULL").withColumn("label", (F.col("v") == "block").cast("int")))
    count = sorted((r["label"], r["part"], r["n"]) for r in
                   judged.groupBy("label", "part").agg(F.approx_count_distinct("url", 0.02).alias("n")).collect())
    picked = []
    for label, rows in itertools.groupby(count, key=lambda r: r[0]):
        total, last = 0, -1
        for _, part, n in rows:
            total, last = total + n, part
            if total >= 2 * per_label:
                break
        some = judged.where((F.col("label") == label) & (F.col("part") <= last)).select("url", "label", "part", "h").distinct()
        picked.append(some.orderBy("part", "h", "url").limit(per_label).select("url", "label"))
    if not picked:
        return judged.select("url", "label")
    return picked[0] if len(picked) == 1 else picked[0].unionAll(picked[1])


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labelled: DataFrame, url_col: str = "url",
               buckets: int = 4096, sizes: Sequence[int] = (3, 4), threshold: float = 0.5) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule``, ``block_score`` (0 to 1, of the regression) and
    ``verdict``. ``rules`` are (verdict, host, path prefix); ``labelled`` has url and label."""
    weights = fit(labelled, buckets, sizes)
    rest = [c for c in pages.columns if c not in MADE]
    row = F.struct(*[pages[c] for c in rest], F.lit(None).cast("string").alias("_none"))
    host, path = host_and_path(pages[url_col])
    parts = pages.select(row.alias("_row"), host.alias("host"), path.alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = with_characters(parts).select("*", rule_column(rules, host, path, 0).alias("rule"), rule_column(rules, host, path, 1).alias("_v"),
                          _probability(grams(buckets, sizes), weights).alias("block_score"))
    model = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return judged.select(*[F.col("_row")[c].alias(c) for c in rest], *MADE[:4], F.coalesce("_v", model).alias("verdict"))


# The rules of the registered query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_filter_digest(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url")
    out = url_filter(pages, RULES, rule_labels(pages, RULES))
    return out.select("page_id", "host", "path", "rule", "verdict", "block_score")

"""Row filters and key-based joins.

All are declarative so Catalyst pushes the simple ones (the time cutoff on a timestamp column, the
notified flag) into the parquet scan. Dimension joins are broadcast only when their row count has
been checked against a limit; otherwise Spark's own planner (with AQE) decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from ..functions.classify import ats_from_url
from ..functions.timeutil import cutoff

# Rows of a small dimension (company configs, profile rows, summaries) that may be
# broadcast: at a few hundred bytes per row this stays in the tens of MB.
BROADCAST_ROW_LIMIT = 100_000


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``limit`` rows (checked by counting at
    most limit+1 rows); otherwise return it unchanged for a shuffled join."""
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def company_filter(postings: DataFrame, companies: DataFrame, *, company_col: str = "company") -> DataFrame:
    """Drop postings whose lower(title + location) contains any deny filter of their
    company; if the company has keyword filters, need one of them. Lever postings are
    also judged by their department. Postings of companies without a config row pass
    unchanged."""
    cfg = companies.select(F.col("name").alias("_cfg_name"),
                           F.coalesce("deny_filters", F.array().cast("array<string>")).alias("_deny"),
                           F.coalesce("keyword_filters", F.array().cast("array<string>")).alias("_kw"))
    parts = [F.col("title"), F.coalesce(F.col("location"), F.lit(""))]
    if {"source_system", "department"} <= set(postings.columns):
        # null (skipped by concat_ws) for the other systems
        parts.append(F.when(F.col("source_system") == "lever", F.coalesce("department", F.lit(""))))
    text = F.lower(F.concat_ws(" ", *parts))
    j = postings.join(maybe_broadcast(cfg), F.col(company_col) == F.col("_cfg_name"), "left")
    deny = F.coalesce(F.exists("_deny", lambda d: text.contains(F.lower(d))), F.lit(False))
    need = F.coalesce(F.size("_kw"), F.lit(0)) > 0
    kw_ok = F.exists("_kw", lambda k: text.contains(F.lower(k)))
    keep = ~deny & (~need | kw_ok)
    return j.filter(keep).drop("_cfg_name", "_deny", "_kw")


def time_filter(df: DataFrame, as_of, lookback: str, col: str = "posted_at") -> DataFrame:
    """Keep rows with no date or posted at/after as_of - lookback (inclusive). A timestamp column
    is compared as it is with a constant of its own type, so the scan gets the filter; a column
    of another type is cast."""
    c, limit = F.col(col), cutoff(as_of, lookback)
    kind = df.schema[col].dataType if col in df.columns else None
    if isinstance(kind, TimestampNTZType):
        limit = limit.cast("timestamp_ntz")
    elif not isinstance(kind, TimestampType):
        c = c.cast("timestamp")
    return df.filter(c.isNull() | (c >= limit))


def unseen(jobs: DataFrame, since=None) -> DataFrame:
    """Stored jobs not yet notified, optionally first seen at/after ``since``."""
    cond = F.col("notified_at").isNull()
    if since is not None:
        from ..functions.timeutil import as_timestamp
        cond = cond & (F.col("first_seen_at") >= as_timestamp(since))
    return jobs.filter(cond)


def select_companies(companies: DataFrame, name: str | None = None) -> DataFrame:
    """Enabled companies (optionally one name, case-insensitive), with the ATS to use:
    the configured one, else the first career URL whose system is detectable.
    Companies with no usable system are dropped."""
    c = companies.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    if name is not None:
        c = c.filter(F.lower("name") == name.lower())
    urls = c.select("name", F.posexplode("career_urls").alias("pos", "url")) \
        .withColumn("det", ats_from_url(F.col("url"))).filter(F.col("det") != "unknown")
    first = urls.groupBy("name").agg(F.min_by("det", "pos").alias("detected"))
    out = c.join(first, "name", "left").withColumn(
        "resolved_ats", F.coalesce(F.nullif(F.col("ats_type"), F.lit("unknown")), F.col("detected")))
    return out.filter(F.col("resolved_ats").isNotNull()).drop("detected")


def drop_known(postings: DataFrame, known: DataFrame, key: str = "id",
               known_key: str | None = None) -> DataFrame:
    """Anti join: postings whose key is not in ``known`` (J02 by id, J03 by source id)."""
    k = known.select(F.col(known_key or key).alias(key)).distinct()
    return postings.join(k, key, "left_anti")


def union_postings(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name across sources (missing columns become null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

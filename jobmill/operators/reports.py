"""Notification and report shaping (F19-F21, A06 digest, A01-A03, A08 counts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

DIGEST_TOP = 10
MAX_MESSAGE_REASONS = 3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def percent(score) -> Column:
    """Whole percent, rounded half to even like Python's '{:.0%}'."""
    return F.concat(F.rint(_c(score) * F.lit(100.0)).cast("bigint").cast("string"), F.lit("%"))


def priority(score="final_score") -> Column:
    s = _c(score)
    return F.when(s >= 0.8, "high").when(s >= 0.6, "default").otherwise("low")


def tags(remote="remote_type", score="final_score") -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.array(F.lit("briefcase")),
                    F.when(_c(remote) == "remote", F.array(F.lit("house"))).otherwise(none),
                    F.when(_c(score) >= 0.8, F.array(F.lit("star"))).otherwise(none))


def _py_title_word(c: Column) -> Column:
    """Python str.title() for enum values (letters and '_' / ' ' only)."""
    from ..functions.classify import py_title
    return py_title(c)


def message_title(title="title", company="company") -> Column:
    return F.concat(F.lit("NEW: "), _c(title), F.lit(" @ "), _c(company))


def message_body(title="title", company="company", location="location",
                 employment="employment_type", remote="remote_type", department="department",
                 posted="posted_at", score="final_score", reasons="match_reasons") -> Column:
    """Location, Type, Remote, [Dept], [Posted], Score %, [first 3 reasons]."""
    loc = F.coalesce(F.nullif(_c(location), F.lit("")), F.lit("Not specified"))
    etype = _py_title_word(F.replace(_c(employment), F.lit("_"), F.lit(" ")))
    rtype = _py_title_word(_c(remote))
    dept = F.when(_c(department).isNotNull() & (_c(department) != ""),
                  F.concat(F.lit("Dept: "), _c(department)))
    posted = F.when(_c(posted).isNotNull(),
                    F.concat(F.lit("Posted: "), F.date_format(_c(posted), "yyyy-MM-dd")))
    rs = F.coalesce(_c(reasons), F.array().cast("array<string>"))
    reason_line = F.when(F.size(rs) > 0, F.concat(F.lit("✨ "), F.array_join(F.slice(rs, 1, MAX_MESSAGE_REASONS), ", ")))
    return F.concat_ws("\n",
                       F.concat(F.lit("Location: "), loc),
                       F.concat(F.lit("Type: "), etype),
                       F.concat(F.lit("Remote: "), rtype),
                       dept, posted,
                       F.concat(F.lit("Score: "), percent(score)),
                       reason_line)


def messages(scored: DataFrame, topic: str) -> DataFrame:
    """One outbox row per scored posting: topic, title, message, priority, click, tags."""
    return scored.select(
        *[c for c in ("id", "profile") if c in scored.columns],
        F.lit(topic).alias("topic"), message_title().alias("title"), message_body().alias("message"),
        priority().alias("priority"), F.col("apply_url").alias("click"), tags().alias("tags"))


def digest(scored: DataFrame, group_cols=("profile",), order_tiebreak: str = "id",
           since_label: str | None = None) -> DataFrame:
    """A06 per group: total, the 10 best as numbered lines 'i. title @ company (NN%)',
    then '... and N more' when there are more than 10.

    Top 10 uses row_number() <= 10 (partial window-group limit before the shuffle);
    the count is a separate partial aggregation, so no group is collected whole. Both read the
    same few columns, which are computed once and written to the checkpoint folder."""
    g = list(group_cols)
    ensure_checkpoint_dir(scored.sparkSession)
    scored = scored.select(*g, "final_score", order_tiebreak, "title", "company").checkpoint(eager=True)
    w = Window.partitionBy(*g).orderBy(F.desc("final_score"), F.col(order_tiebreak))
    top = scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= DIGEST_TOP)
    line = F.concat(F.col("_rn").cast("string"), F.lit(". "), F.col("title"), F.lit(" @ "),
                    F.col("company"), F.lit(" ("), percent("final_score"), F.lit(")"))
    lines = top.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("_rn", line.alias("l")))).alias("_ls"))
    counts = scored.groupBy(*g).agg(F.count(F.lit(1)).alias("total"))
    j = counts.join(lines, g)
    more = F.when(F.col("total") > DIGEST_TOP,
                  F.array(F.concat(F.lit("... and "), (F.col("total") - DIGEST_TOP).cast("string"), F.lit(" more"))))
    body = F.array_join(F.concat(F.transform("_ls", lambda s: s["l"]),
                                 F.coalesce(more, F.array().cast("array<string>"))), "\n")
    title = F.concat(F.lit("📋 Job Digest: "), F.col("total").cast("string"), F.lit(" new jobs"))
    if since_label:
        title = F.concat(title, F.lit(f" since {since_label}"))
    return j.select(*g, "total", title.alias("title"), body.alias("message"))


def run_totals(saved: DataFrame, is_new_col: str = "is_new") -> DataFrame:
    """Jobs found and new."""
    return saved.agg(F.count(F.lit(1)).alias("jobs_found"),
                     F.coalesce(F.sum(F.col(is_new_col).cast("bigint")), F.lit(0)).alias("jobs_new"))


def new_by_company(new_postings: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """New postings per company; with a company list, companies without any show 0."""
    counts = new_postings.groupBy("company").agg(F.count(F.lit(1)).alias("new_jobs"))
    if companies is None:
        return counts
    return companies.select(F.col("name").alias("company")).distinct() \
        .join(counts, "company", "left").fillna(0, ["new_jobs"])


def notification_totals(notifications: DataFrame) -> DataFrame:
    """Successes of total."""
    return notifications.agg(F.coalesce(F.sum(F.col("success").cast("bigint")), F.lit(0)).alias("sent"),
                             F.count(F.lit(1)).alias("total"))


def match_report(scored: DataFrame) -> DataFrame:
    """K03 match report rows: title, company, score, reasons, apply URL."""
    return scored.select("title", "company", F.col("final_score").alias("score"),
                         F.col("match_reasons").alias("reasons"), "apply_url")


def write_json_report(rows: DataFrame, path: str, count_name: str = "count") -> None:
    """Write report rows as JSON lines plus a one-row count file next to
    them (``<path>/rows``, ``<path>/summary``)."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    rows.agg(F.count(F.lit(1)).alias(count_name)).write.mode("overwrite").json(f"{path}/summary")

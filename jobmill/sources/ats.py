"""Readers for landed job-board payloads (S01-S05) and stored/config tables.

Fetching is out of scope: each HTTP response is a landed JSON file. One read covers
every company and board: files live under ``.../company=<name>/board=<token>/`` (plus
``offset=<n>`` for paged systems), Spark's partition discovery turns those folders
into columns, and each file is one row. ``parse_<system>`` turns such rows (``value`` and the
folder columns, from any source) into postings; ``read_<system>`` reads files for it.

A file is parsed once, down to an array of VARIANT: the fields that a posting needs are
read from a job's variant, and the whole of it goes along as ``raw``, fields that nobody
declared included. A payload that is not the expected shape parses to null and yields no
postings; a posting without an id or without an http(s) URL is dropped (not fatal), like a
failed record validation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import employment_type, remote_type
from ..functions.text import posting_id
from ..functions.timeutil import from_epoch_millis, parse_iso
from ..schema import conform

# The fields of one job in each system's payload, and the way to the array of jobs.
GREENHOUSE_JOB = ("id string, title string, updated_at string, absolute_url string, location string, "
                  "departments array<struct<id:string,name:string>>")
LEVER_JOB = ("id string, text string, createdAt bigint, hostedUrl string, applyUrl string, "
             "categories struct<location:string,department:string,team:string,commitment:string>")
ASHBY_JOB = "id string, title string, locationName string, employmentType string, publishedDate string, isRemote boolean"
SMARTRECRUITERS_JOB = ("id string, refNumber string, name string, location struct<city:string,region:string,country:string>, "
                       "department struct<id:string,label:string>, releasedDate string, remote boolean, "
                       "typeOfEmployment struct<id:string>, applyUrl string")
WORKDAY_JOB = "externalPath string, title string, locationsText string, postedOn string, bulletFields array<string>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _ident(df: DataFrame, company: str | None, board: str | None) -> DataFrame:
    """company / board from arguments, else from the partition folders."""
    if company is not None:
        df = df.withColumn("company", F.lit(company))
    if board is not None:
        df = df.withColumn("board", F.lit(board))
    return df


def _finish(df: DataFrame) -> DataFrame:
    ok = (F.coalesce(F.col("source_job_id"), F.lit("")) != "") & \
        F.col("apply_url").rlike("^https?://") & F.col("source_url").rlike("^https?://")
    return conform(df.filter(ok).withColumn("id", posting_id()))


def _jobs(f: DataFrame, keep: list[str], jobs: Column, fields: str) -> DataFrame:
    """One row per job variant of the array ``jobs``: the columns to keep, the job's fields as
    ``j`` (a field of another shape is null) and all of it as ``raw``."""
    rows = f.select(*keep, F.explode(jobs).alias("_v")).select(*keep, F.to_json("_v").alias("raw"))
    return rows.select(*keep, "raw", F.from_json("raw", fields).alias("j")).where(F.col("raw").startswith("{"))


def parse_greenhouse(f: DataFrame) -> DataFrame:
    """``{jobs: [...]}``; location may be ``{name}`` or a plain value; department =
    first department's name; posted_at from updated_at (ISO)."""
    rows = _jobs(f, ["company", "board"], F.from_json("value", "jobs array<variant>")["jobs"], GREENHOUSE_JOB)
    loc_raw = F.col("j.location")
    loc = F.when(loc_raw.startswith("{"), F.get_json_object(loc_raw, "$.name")).otherwise(F.nullif(loc_raw, F.lit("")))
    src = F.concat(F.lit("https://boards.greenhouse.io/"), F.col("board"))
    title = F.coalesce(F.col("j.title"), F.lit(""))
    out = rows.select(
        "company", title.alias("title"), F.col("j.id").alias("source_job_id"),
        F.lit("greenhouse").alias("source_system"), src.alias("source_url"),
        F.coalesce(F.nullif(F.col("j.absolute_url"), F.lit("")), src).alias("apply_url"),
        loc.alias("location"),
        remote_type(title, loc, policy="A").alias("remote_type"),
        employment_type(title, policy="default_full").alias("employment_type"),
        F.try_element_at(F.col("j.departments"), F.lit(1))["name"].alias("department"),
        parse_iso(F.col("j.updated_at")).alias("posted_at"), "raw")
    return _finish(out)


def parse_lever(f: DataFrame) -> DataFrame:
    """Top-level array (anything else: no postings); '' categories -> null;
    createdAt epoch ms; apply = applyUrl if present, else hostedUrl, else source."""
    rows = _jobs(f, ["company", "board"], F.from_json("value", "array<variant>"), LEVER_JOB)
    cat = F.col("j.categories")
    loc, dept, team, commit = [F.coalesce(cat[k], F.lit("")) for k in ("location", "department", "team", "commitment")]
    src = F.concat(F.lit("https://jobs.lever.co/"), F.col("board"))
    apply = F.when(F.col("j.applyUrl").isNotNull(), F.col("j.applyUrl")).otherwise(F.col("j.hostedUrl"))
    title = F.coalesce(F.col("j.text"), F.lit(""))
    out = rows.select(
        "company", title.alias("title"), F.col("j.id").alias("source_job_id"),
        F.lit("lever").alias("source_system"), src.alias("source_url"),
        F.coalesce(F.nullif(apply, F.lit("")), src).alias("apply_url"),
        F.nullif(loc, F.lit("")).alias("location"),
        remote_type(title, loc, commit, policy="A").alias("remote_type"),
        employment_type(title, commit, policy="explicit").alias("employment_type"),
        F.nullif(dept, F.lit("")).alias("department"), F.nullif(team, F.lit("")).alias("team"),
        from_epoch_millis(F.col("j.createdAt")).alias("posted_at"), "raw")
    return _finish(out)


def parse_ashby(f: DataFrame) -> DataFrame:
    """``data.jobBoard.teams[].jobs[]``; department = team name; remote if
    isRemote, hybrid if the location says so; apply = board URL + id."""
    board = F.from_json("value", "data struct<jobBoard:struct<teams:array<struct<name:string,jobs:array<variant>>>>>")
    teams = f.select("company", "board", F.explode(board["data"]["jobBoard"]["teams"]).alias("t"))
    rows = _jobs(teams.select("company", "board", F.col("t.name").alias("team_name"), "t.jobs"),
                 ["company", "board", "team_name"], F.col("jobs"), ASHBY_JOB)
    loc = F.coalesce(F.col("j.locationName"), F.lit(""))
    src = F.concat(F.lit("https://jobs.ashbyhq.com/"), F.col("board"))
    title = F.coalesce(F.col("j.title"), F.lit(""))
    remote = (F.when(F.lower(loc).contains("hybrid"), "hybrid")
              .when(F.coalesce(F.col("j.isRemote"), F.lit(False)), "remote").otherwise("unknown"))
    out = rows.select(
        "company", title.alias("title"), F.col("j.id").alias("source_job_id"),
        F.lit("ashby").alias("source_system"), src.alias("source_url"),
        F.concat(src, F.lit("/"), F.col("j.id")).alias("apply_url"), loc.alias("location"),
        remote.alias("remote_type"),
        employment_type(title, F.col("j.employmentType"), policy="default_full").alias("employment_type"),
        F.coalesce(F.col("team_name"), F.lit("")).alias("department"),
        parse_iso(F.col("j.publishedDate")).alias("posted_at"), "raw")
    return _finish(out)


def parse_smartrecruiters(f: DataFrame) -> DataFrame:
    """All offset pages at once; id = id else refNumber; location = non-empty of
    city, region, country joined ', ' (else null); department = label else id."""
    rows = _jobs(f, ["company", "board"], F.from_json("value", "content array<variant>")["content"], SMARTRECRUITERS_JOB)
    jid = F.coalesce(F.nullif(F.col("j.id"), F.lit("")), F.nullif(F.col("j.refNumber"), F.lit("")))
    parts = [F.nullif(F.col(f"j.location.{k}"), F.lit("")) for k in ("city", "region", "country")]
    loc = F.nullif(F.concat_ws(", ", *parts), F.lit(""))
    dept = F.when(F.col("j.department").isNotNull(),
                  F.coalesce(F.col("j.department.label"), F.col("j.department.id"), F.lit("")))
    title = F.coalesce(F.col("j.name"), F.lit(""))
    tl = F.lower(title)
    code = F.coalesce(F.col("j.typeOfEmployment.id"), F.lit(""))
    emp = (F.when(tl.contains("intern") | (code == "intern"), "internship")
           .when(tl.contains("contract") | (code == "contractor"), "contract")
           .when(tl.contains("part") | (code == "part_time"), "part_time").otherwise("full_time"))
    src = F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("board"))
    out = rows.select(
        "company", title.alias("title"), jid.alias("source_job_id"),
        F.lit("smartrecruiters").alias("source_system"), src.alias("source_url"),
        F.coalesce(F.col("j.applyUrl"), F.concat(src, F.lit("/"), jid)).alias("apply_url"),
        loc.alias("location"),
        F.when(F.coalesce(F.col("j.remote"), F.lit(False)), "remote").otherwise("unknown").alias("remote_type"),
        emp.alias("employment_type"), dept.alias("department"),
        parse_iso(F.col("j.releasedDate")).alias("posted_at"), "raw")
    return _finish(out)


def parse_workday(f: DataFrame) -> DataFrame:
    """``jobPostings[]`` pages; id = last part of externalPath; URLs from the API base
    without ``/wday/cxs/``. Needs ``company``, ``api_base`` and ``site`` columns."""
    rows = _jobs(f, ["company", "api_base", "site"], F.from_json("value", "jobPostings array<variant>")["jobPostings"], WORKDAY_JOB)
    ext = F.coalesce(F.col("j.externalPath"), F.lit(""))
    jid = F.when(ext != "", F.try_element_at(F.split(ext, "/"), F.lit(-1)))
    base = F.replace(F.col("api_base"), F.lit("/wday/cxs/"), F.lit("/"))
    src = F.concat(base, F.lit("/"), F.col("site"))
    loc = F.nullif(F.coalesce(F.col("j.locationsText"), F.lit("")), F.lit(""))
    bullets = F.array_join(F.coalesce(F.col("j.bulletFields"), F.array().cast("array<string>")), " ")
    title = F.coalesce(F.col("j.title"), F.lit(""))
    out = rows.select(
        "company", title.alias("title"), jid.alias("source_job_id"),
        F.lit("workday").alias("source_system"), src.alias("source_url"),
        F.concat(src, ext).alias("apply_url"), loc.alias("location"),
        remote_type(title, loc, bullets, policy="A").alias("remote_type"),
        employment_type(title, bullets, policy="workday").alias("employment_type"),
        parse_iso(F.col("j.postedOn")).alias("posted_at"), "raw")
    return _finish(out)


def _reader(parse, doc: str):
    def read(spark, path, company=None, board=None) -> DataFrame:
        return parse(_ident(_files(spark, path), company, board))
    read.__doc__ = doc
    return read


read_greenhouse = _reader(parse_greenhouse, "S01 from landed files.")
read_lever = _reader(parse_lever, "S02 from landed files.")
read_ashby = _reader(parse_ashby, "S03 from landed files.")
read_smartrecruiters = _reader(parse_smartrecruiters, "S04 from landed files, all offset pages at once.")


def read_workday(spark, path, company=None, api_base=None, site=None, max_offset: int | None = None) -> DataFrame:
    """S05 from landed files. All landed pages are read; ``max_offset`` leaves out those at or
    beyond an offset (the fetch limit of the source tool is 500). ``api_base`` and ``site`` come
    from arguments or folder columns."""
    f = _files(spark, path)
    for name, value in (("company", company), ("api_base", api_base), ("site", site)):
        f = f if value is None else f.withColumn(name, F.lit(value))
    if max_offset is not None and "offset" in f.columns:
        f = f.filter(F.col("offset").cast("long") < max_offset)
    return parse_workday(f)


def read_stored_postings(jobs: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Stored jobs back as postings; missing company -> 'Unknown', missing
    enums -> 'unknown'."""
    df = jobs
    if companies is not None:
        df = df.drop("company").join(companies.select("company_id", F.col("name").alias("company")),
                                     "company_id", "left")
    if "requirements" not in df.columns:                   # not stored: rebuilt empty
        df = df.withColumn("requirements", F.array().cast("array<string>"))
    return df.withColumn("company", F.coalesce("company", F.lit("Unknown"))) \
        .withColumn("remote_type", F.coalesce("remote_type", F.lit("unknown"))) \
        .withColumn("employment_type", F.coalesce("employment_type", F.lit("unknown"))) \
        .withColumn("source_system", F.coalesce("source_system", F.lit("unknown")))


def read_companies(spark, path) -> DataFrame:
    """Company configs as JSON lines (one object per company); unreadable rows
    are skipped."""
    from pyspark.sql import types as T

    from ..schema import COMPANY_SCHEMA
    schema = T.StructType(COMPANY_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(schema) \
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.filter(F.col("_corrupt_record").isNull() & F.col("name").isNotNull()).drop("_corrupt_record")


def read_profiles(spark, path) -> DataFrame:
    """Profiles as JSON lines in PROFILE_SCHEMA."""
    from ..schema import PROFILE_SCHEMA
    return spark.read.schema(PROFILE_SCHEMA).json(path)


def read_resumes(spark, path) -> DataFrame:
    """Plain-text resumes, one row per file (whole text)."""
    return spark.read.text(path, wholetext=True) \
        .select(F.col("value").alias("text"), F.input_file_name().alias("path"))

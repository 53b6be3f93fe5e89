"""Posting-shaped views over the driver's tables.

No landed job-board payloads exist at scale, so the registered queries read postings
derived from the TPC-H-like tables:

* ``postings_li``: one posting per lineitem row. company = supplier name, title = part
  name, department = part type, location = the supplier's nation, posted_at = ship
  date, source_job_id = "<orderkey>-<linenumber>" (not unique: gives real exact
  duplicates), source_system from the return flag, remote type from the line status.
  Arrival order = (l_orderkey, l_linenumber, l_partkey, l_suppkey), unique.
* ``stored_jobs``: orders as the stored-jobs table (score from total price, first seen
  = order date, notified when the order status is 'F'), customers as companies.

Only ``nation`` (25 rows, fixed by the schema) is broadcast explicitly; part and
supplier grow with the scale factor, so their join strategy is left to Catalyst/AQE.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import employment_type
from ..functions.text import posting_id
from ..session import read_table, scratch_path, shuffle_files_dropped, spread

# Mapping of stand-in codes to posting enums.
RETURNFLAG_SYSTEM = {"A": "greenhouse", "N": "lever", "R": "workday"}
LINESTATUS_REMOTE = {"O": "remote", "F": "onsite"}


def _case(col: str, mapping: dict, default: str) -> F.Column:
    expr = None
    for k, v in mapping.items():
        cond = F.col(col) == k
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr.otherwise(default)


def lines_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_returnflag", "l_linestatus"))
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey).drop("p_partkey")


def staged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines_with_parts`` as a table, for a job that reads the postings several times: past a few million
    parts the join shuffles every line, each time anew."""
    path = scratch_path(spark, f"lines-{uuid.uuid4().hex}")
    with shuffle_files_dropped(spark):
        lines_with_parts(spark, sf_dir).write.option("compression", "zstd").parquet(path)
    return spread(spark.read.parquet(path))


def postings_li(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    lines = lines_with_parts(spark, sf_dir) if lines is None else lines
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (lines.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(F.broadcast(nation), F.col("s_nationkey") == nation.n_nationkey))
    company = F.col("s_name")
    system = _case("l_returnflag", RETURNFLAG_SYSTEM, "unknown")
    job_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    src = F.concat(F.lit("https://boards.example.com/"), company)
    return j.select(
        company.alias("company"),
        F.col("p_name").alias("title"),
        job_id.alias("source_job_id"),
        system.alias("source_system"),
        src.alias("source_url"),
        F.concat(src, F.lit("/"), job_id).alias("apply_url"),
        F.col("n_name").alias("location"),
        _case("l_linestatus", LINESTATUS_REMOTE, "unknown").alias("remote_type"),
        employment_type(F.col("p_name")).alias("employment_type"),
        F.col("p_type").alias("department"),
        F.col("l_shipdate").cast("timestamp").alias("posted_at"),
        F.lit(None).cast("string").alias("description_text"),
        F.array().cast("array<string>").alias("requirements"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
    ).withColumn("id", posting_id())


POSTINGS_LI_SQL = """
  (SELECT s_name AS company, p_name AS title,
          CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS source_job_id,
          CASE l_returnflag WHEN 'A' THEN 'greenhouse' WHEN 'N' THEN 'lever'
               WHEN 'R' THEN 'workday' ELSE 'unknown' END AS source_system,
          n_name AS location,
          CASE l_linestatus WHEN 'O' THEN 'remote' WHEN 'F' THEN 'onsite' ELSE 'unknown' END AS remote_type,
          CASE WHEN lower(p_name) LIKE '%intern%' THEN 'internship'
               WHEN lower(p_name) LIKE '%contract%' THEN 'contract'
               WHEN lower(p_name) LIKE '%part-time%' OR lower(p_name) LIKE '%part time%' THEN 'part_time'
               ELSE 'full_time' END AS employment_type,
          p_type AS department, CAST(l_shipdate AS TIMESTAMP) AS posted_at,
          l_orderkey, l_linenumber, l_partkey, l_suppkey,
          substr(sha256(s_name || ':' ||
            CASE l_returnflag WHEN 'A' THEN 'greenhouse' WHEN 'N' THEN 'lever'
                 WHEN 'R' THEN 'workday' ELSE 'unknown' END || ':' ||
            CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), 1, 16) AS id
   FROM lineitem JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey)
"""


def stored_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as stored jobs: id, company_id, title, score, first_seen_at, notified_at."""
    o = spread(read_table(spark, sf_dir, "orders"))
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderpriority").alias("title"),
        (F.col("o_totalprice") / F.lit(1_000_000.0)).alias("score"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp"))
        .alias("notified_at"),
    )


def stored_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company"),
                    F.col("c_mktsegment").alias("segment"))

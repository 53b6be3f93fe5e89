"""Posting data model as Spark types, and the enum value sets (kept as strings)."""

from __future__ import annotations

from pyspark.sql import types as T

# Enum spellings that stored rows and reports must use.
REMOTE_TYPES = ("onsite", "hybrid", "remote", "unknown")
EMPLOYMENT_TYPES = ("full_time", "part_time", "contract", "internship", "temporary", "unknown")
ATS_TYPES = ("greenhouse", "lever", "workday", "icims", "smartrecruiters",
             "successfactors", "taleo", "ashby", "unknown")

POSTING_FIELDS = [
    T.StructField("company", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("source_job_id", T.StringType(), False),
    T.StructField("source_system", T.StringType(), False),
    T.StructField("source_url", T.StringType(), False),
    T.StructField("apply_url", T.StringType(), False),
    T.StructField("location", T.StringType(), True),
    T.StructField("remote_type", T.StringType(), False),
    T.StructField("employment_type", T.StringType(), False),
    T.StructField("department", T.StringType(), True),
    T.StructField("team", T.StringType(), True),
    T.StructField("posted_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
    T.StructField("description_html", T.StringType(), True),
    T.StructField("description_text", T.StringType(), True),
    T.StructField("requirements", T.ArrayType(T.StringType()), True),
    T.StructField("seniority", T.StringType(), True),
    T.StructField("keywords", T.ArrayType(T.StringType()), True),
    T.StructField("raw", T.StringType(), True),
]
POSTING_SCHEMA = T.StructType(POSTING_FIELDS)
POSTING_COLUMNS = [f.name for f in POSTING_FIELDS]

PROFILE_SCHEMA = T.StructType([
    T.StructField("profile", T.StringType(), False),
    T.StructField("desired_roles", T.ArrayType(T.StringType()), False),
    T.StructField("must_have_keywords", T.ArrayType(T.StringType()), False),
    T.StructField("must_not_keywords", T.ArrayType(T.StringType()), False),
    T.StructField("preferred_locations", T.ArrayType(T.StringType()), False),
    T.StructField("remote_preference", T.StringType(), True),
    T.StructField("min_score_threshold", T.DoubleType(), False),
    T.StructField("vector_weight", T.DoubleType(), False),
    T.StructField("keyword_weight", T.DoubleType(), False),
    T.StructField("recency_weight", T.DoubleType(), False),
])

COMPANY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("career_urls", T.ArrayType(T.StringType()), False),
    T.StructField("ats_type", T.StringType(), True),
    T.StructField("enabled", T.BooleanType(), True),
    T.StructField("keyword_filters", T.ArrayType(T.StringType()), True),
    T.StructField("deny_filters", T.ArrayType(T.StringType()), True),
    T.StructField("allowed_locations", T.ArrayType(T.StringType()), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("locale", T.StringType(), True),
    T.StructField("allow_html_fallback", T.BooleanType(), True),
    T.StructField("max_rps", T.DoubleType(), True),
])


def conform(df):
    """Add any missing posting column as a typed null / empty array, in schema order."""
    from pyspark.sql import functions as F

    cols = []
    present = set(df.columns)
    for f in POSTING_FIELDS:
        if f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            cols.append(F.array().cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in {f.name for f in POSTING_FIELDS}]
    return df.select(*cols, *extra)

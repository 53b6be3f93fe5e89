"""Stored jobs, versions, runs, notifications and companies as frames.

The functions say what a save, a mark or a run does to whole tables; with a table format that
has MERGE INTO, ``upsert_frames`` is the body of the MERGE. ``changelog`` keeps the same store as
appended change rows on plain parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeutil import as_timestamp
from ..operators.dedup import first_per_key
from ..operators.filters import BROADCAST_ROW_LIMIT
from ..session import ensure_checkpoint_dir, shuffle_files_dropped

JOB_FIELDS = ["id", "company_id", "company", "source_job_id", "source_system", "title", "location",
              "remote_type", "employment_type", "department", "team", "apply_url", "source_url",
              "posted_at", "updated_at", "description_text", "seniority"]
SCORE_FIELDS = ["score", "vector_score", "keyword_score", "recency_score"]
JOBS_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c == "company_id" else
                   (T.TimestampType() if c in ("posted_at", "updated_at") else T.StringType()))
     for c in JOB_FIELDS]
    + [T.StructField(c, T.DoubleType()) for c in SCORE_FIELDS]
    + [T.StructField("first_seen_at", T.TimestampType()), T.StructField("notified_at", T.TimestampType())])

# Bits for each id of a bitmap of ids, and the most bits of one (64 MB to broadcast).
BITS_PER_ID, BITMAP_BITS = 16, 1 << 29


def company_key(name_col="company"):
    """Stable company id from the name (replaces an autoincrement key)."""
    return F.xxhash64(F.col(name_col) if isinstance(name_col, str) else name_col)


def first_arrivals(incoming: DataFrame, order_col: str, known: DataFrame | None = None) -> DataFrame:
    """One row per id, the first in ``order_col``; with ``known`` (id, each once) also ``_known``, true or null.
    Ids that come more than once (by their hashes) or are known are found over the ids alone. If they are few
    they are broadcast; else a broadcast bitmap tells which rows may be theirs, and only those are moved."""
    spark = incoming.sparkSession
    ensure_checkpoint_dir(spark)
    key = F.xxhash64("id") if known is None else F.col("id")
    marked = incoming.groupBy(key.alias("_marked")).agg(F.count("*").alias("_n"))
    marked = marked.withColumn("_known", F.lit(None).cast("boolean")) if known is None else \
        marked.join(known.select(F.col("id").alias("_marked"), F.lit(True).alias("_known")), "_marked", "left")
    with shuffle_files_dropped(spark):
        marked = marked.where("_n > 1 or _known").checkpoint()
    n, apart = marked.count(), None
    if n > BROADCAST_ROW_LIMIT:
        apart, near = _near(incoming, key, marked, n)
        flagged = near.join(marked, key.eqNullSafe(F.col("_marked")), "left")
    elif n:
        flagged = incoming.join(F.broadcast(marked), key.eqNullSafe(F.col("_marked")), "left")
    else:
        flagged = incoming.withColumns({"_n": F.lit(1), "_known": F.lit(None).cast("boolean")})
    out = flagged
    if marked.where("_n > 1").limit(1).count():
        out = flagged.where("coalesce(_n, 1) = 1").unionByName(first_per_key(flagged.where("_n > 1"), ["id"], order_col))
    out = out.select(*incoming.columns, "_known")
    if apart is not None:
        out = out.unionByName(apart.withColumn("_known", F.lit(None).cast("boolean")))
    return out.drop("_known") if known is None else out


def _near(rows: DataFrame, key, marked: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` parted in two: none of the first has a ``key`` of the ``n`` ``marked``, by a bitmap of hashes."""
    bits = min(max(BITS_PER_ID * n, 1 << 15), BITMAP_BITS)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    maps = marked.select(place("_marked").alias("_p")).select(F.bitmap_bucket_number("_p").alias("_at"), F.bitmap_bit_position("_p").alias("_p")) \
        .repartition("_at").groupBy("_at").agg(F.bitmap_construct_agg("_p").alias("_bits"))
    tagged = rows.withColumn("_at", F.bitmap_bucket_number(place(key))).join(F.broadcast(maps), "_at", "left")
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return tagged.where(~maybe).select(*rows.columns), tagged.where(maybe).select(*rows.columns)


def arrived(incoming: DataFrame, order_col: str | None, known: DataFrame | None = None) -> DataFrame:
    """One row per id (a string), the first arrival; with ``known`` ids also ``_known``."""
    incoming = incoming.withColumn("id", F.col("id").cast("string"))
    if order_col:
        return first_arrivals(incoming, order_col, known)
    out = incoming.dropDuplicates(["id"])
    return out if known is None else out.join(known.select("id", F.lit(True).alias("_known")), "id", "left")


def shaped(rows: DataFrame, *keep) -> DataFrame:
    """Posting columns in store shape, and those to ``keep``. What is made of a row is made here, after
    the row has been moved."""
    have = set(rows.columns)
    cols = []
    for f in JOBS_SCHEMA.fields:
        name = f.name
        src = {"score": "final_score"}.get(name, name)
        if name == "company_id" and "company_id" not in have:
            cols.append(company_key("company").alias(name))
        elif src in have:
            cols.append(F.col(src).cast(f.dataType).alias(name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(name))
    return rows.select(*cols, *keep, F.lit("final_score" in have).alias("_has_scores"))


def upsert_frames(stored: DataFrame, incoming: DataFrame, as_of, order_col: str | None = None):
    """K01. Returns (new_snapshot, changes) where changes = (id, is_new).

    New id: insert all fields, scores as given else 0, first_seen_at = as_of.
    Known id: only updated_at = as_of and, when scores are given, score = final score;
    every other stored field is kept."""
    now = as_timestamp(as_of)
    inc = shaped(arrived(incoming, order_col))
    s = stored.alias("s")
    i = inc.alias("i")
    j = s.join(i, F.col("s.id") == F.col("i.id"), "full_outer")
    is_new = F.col("s.id").isNull()
    touched = F.col("i.id").isNotNull()
    out = []
    for f in JOBS_SCHEMA.fields:
        c = f.name
        if c == "updated_at":
            e = F.when(is_new, F.col("i.updated_at")).when(touched, now).otherwise(F.col("s.updated_at"))
        elif c == "score":
            e = (F.when(is_new, F.coalesce(F.col("i.score"), F.lit(0.0)))
                 .when(touched & F.col("i._has_scores") & F.col("i.score").isNotNull(), F.col("i.score"))
                 .otherwise(F.col("s.score")))
        elif c in SCORE_FIELDS:
            e = F.when(is_new, F.coalesce(F.col(f"i.{c}"), F.lit(0.0))).otherwise(F.col(f"s.{c}"))
        elif c == "first_seen_at":
            e = F.when(is_new, now).otherwise(F.col("s.first_seen_at"))
        elif c == "notified_at":
            e = F.when(is_new, F.lit(None).cast("timestamp")).otherwise(F.col("s.notified_at"))
        else:
            e = F.when(is_new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}"))
        out.append(e.cast(f.dataType).alias(c))
    snapshot = j.select(*out)
    changes = j.filter(touched).select(F.col("i.id").alias("id"), is_new.alias("is_new"))
    return snapshot, changes


def version_rows(incoming: DataFrame, as_of, raw_col: str | None = "raw") -> DataFrame:
    """One version row per saved posting: (job_id, raw_json, fetched_at)."""
    raw = (F.coalesce(F.col(raw_col), F.lit("{}")) if raw_col and raw_col in incoming.columns
           else F.to_json(F.struct(*[F.col(c) for c in incoming.columns if c != "id"])))
    return incoming.select(F.col("id").alias("job_id"), raw.alias("raw_json"),
                           as_timestamp(as_of).alias("fetched_at"))


def mark_notified_frames(stored: DataFrame, ids: DataFrame, mode: str, target: str, as_of):
    """K04 + J06: ids that exist get notified_at = as_of and one notification row."""
    now = as_timestamp(as_of)
    hit = ids.select("id").distinct().join(stored.select("id"), "id", "left_semi")
    flagged = hit.withColumn("_hit", F.lit(True))
    snap = stored.join(flagged, "id", "left").withColumn(
        "notified_at", F.when(F.col("_hit"), now).otherwise(F.col("notified_at"))).drop("_hit")
    snap = snap.select(*stored.columns)
    notes = hit.select(F.col("id").alias("job_id"), now.alias("sent_at"), F.lit(mode).alias("mode"),
                       F.lit(target).alias("target"), F.lit(1).alias("success"))
    return snap, notes


def unseen_top(stored: DataFrame, companies: DataFrame | None, limit: int | None, since=None) -> DataFrame:
    """P06 + T02 + J01: not yet notified (optionally first seen since), best stored
    score first (ties by id), at most ``limit`` (None: all, in no order), with the company row."""
    from ..operators.filters import maybe_broadcast, unseen
    top = unseen(stored, since)
    if limit is not None:
        top = top.orderBy(F.desc("score"), F.col("id")).limit(limit)
    if companies is None:
        return top
    return top.join(maybe_broadcast(companies), "company_id", "left")


def run_rows_start(run_id: int, as_of, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(run_id, 0)], "run_id long, event int").select(
        "run_id", "event", as_timestamp(as_of).alias("at"), F.lit("running").alias("status"),
        F.lit(None).cast("long").alias("jobs_found"), F.lit(None).cast("long").alias("jobs_new"),
        F.lit(None).cast("string").alias("error_message"))


def run_rows_complete(run_id: int, as_of, totals: DataFrame, status="completed", error=None) -> DataFrame:
    """K05 completion row from an A01 totals frame (jobs_found, jobs_new)."""
    return totals.select(F.lit(run_id).cast("long").alias("run_id"), F.lit(1).alias("event"),
                         as_timestamp(as_of).alias("at"), F.lit(status).alias("status"),
                         F.col("jobs_found").cast("long"), F.col("jobs_new").cast("long"),
                         F.lit(error).cast("string").alias("error_message"))


def runs_latest(run_log: DataFrame) -> DataFrame:
    """Latest state per run: started_at from the start row, the rest from the last row."""
    return run_log.groupBy("run_id").agg(
        F.min_by("at", "event").alias("started_at"),
        F.max_by(F.when(F.col("event") > 0, F.col("at")), "event").alias("completed_at"),
        F.max_by("status", "event").alias("status"),
        F.coalesce(F.max_by("jobs_found", "event"), F.lit(0)).alias("jobs_found"),
        F.coalesce(F.max_by("jobs_new", "event"), F.lit(0)).alias("jobs_new"),
        F.max_by("error_message", "event").alias("error_message"))


def company_upsert_frames(existing: DataFrame, names: DataFrame, config_col: str | None = None):
    """Get-or-create companies by name; config refreshed when given."""
    inc = names.select(F.col("name"), (F.col(config_col) if config_col else F.lit(None).cast("string"))
                       .alias("config_json")).dropDuplicates(["name"])
    new = inc.join(existing.select("name"), "name", "left_anti") \
        .select(company_key("name").alias("company_id"), "name", "config_json")
    if config_col:
        upd = existing.alias("e").join(inc.alias("n"), "name", "left").select(
            "company_id", "name", F.coalesce(F.col("n.config_json"), F.col("e.config_json")).alias("config_json"))
    else:
        upd = existing.select("company_id", "name", "config_json")
    return upd.unionByName(new)

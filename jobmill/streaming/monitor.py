"""Structured Streaming monitor (M01-M04, M06): landed posting files arrive in a folder. The
stream applies the lookback and keeps the first arrival of every source job id that neither the
store nor an earlier micro-batch has seen; optionally it drops near-duplicates per (title,
location); every micro-batch then scores what is new, saves the matches and their companies
(K01, K02, K06) and writes outbox messages.

State: seen ids and the last admitted fingerprint per key are entries of Spark's state store
(``state``), so a batch reads and writes what it touches, not the store. The ids that the store
held before the first start enter that state once, as a stream of their own.

Exactly-once: a batch appends to the change log under number ``base + batch id + 1`` and writes
its messages under its batch id, both with overwrite, so a replayed batch rewrites the same
folders; ``base`` is written once beside the stream checkpoint. Checkpoints live on shared
storage (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import posting_id, searchable_text
from ..functions.timeutil import as_timestamp
from ..operators import dedup, filters, reports, scoring
from ..session import path_exists, scratch_path
from ..store.changelog import ChangeLog
from .state import first_arrivals, near_dup_stream


def process_batch(fresh: DataFrame, batch_id: int, *, store: ChangeLog, profile, as_of, topic: str, order_col: str,
                  outbox_root: str, base: int) -> None:
    """Score a micro-batch of new postings, save the matches, write their messages."""
    scored = scoring.score(fresh, [profile], as_of)
    matches = scored.filter(F.col("final_score") >= F.col("min_score_threshold"))
    if "id" not in matches.columns:
        matches = matches.withColumn("id", posting_id())
    # the matches feed the store and the outbox: compute them once per micro-batch
    matches = matches.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        store.save(matches, as_of, order_col=order_col, batch=base + batch_id + 1)
        reports.messages(matches, topic).write.mode("overwrite").parquet(f"{outbox_root}/batch_id={batch_id}")
    finally:
        matches.unpersist()


def _seeded(spark: SparkSession, path: str, store: ChangeLog) -> int:
    """The store's last batch when the stream first started, and beside it the source job ids
    that it held. Both are written once, before the first batch: a restarted stream numbers its
    batches from the same base and has the same seeds."""
    if not path_exists(spark, f"{path}/base/_SUCCESS"):
        base = store.last_batch()
        store.jobs(base + 1, ("source_job_id",)).select("source_job_id").distinct().write.mode("overwrite").parquet(f"{path}/known")
        spark.createDataFrame([(base,)], "base long").coalesce(1).write.mode("overwrite").parquet(f"{path}/base")
    return spark.read.schema("base long").parquet(f"{path}/base").first()["base"]


def start_monitor(spark: SparkSession, source_path: str, schema: T.StructType, to_postings,
                  *, store: ChangeLog, profile, as_of=None, lookback: str | None = "24h",
                  topic: str = "jobs", order_col: str = "seq", checkpoint: str | None = None,
                  outbox_root: str | None = None, available_now: bool = False,
                  poll_seconds: int = 300, near_dup: bool = False,
                  max_files_per_trigger: int | None = None):
    """Start the monitor and return its last streaming query. ``to_postings`` maps the raw
    stream to posting columns (with ``order_col``, which grows with arrival). ``available_now``
    processes what is there and stops; otherwise a micro-batch runs every ``poll_seconds``
    (default 300 s). ``as_of`` fixes the clock for reproducible runs; without it the clock is the
    micro-batch's own time, and the lookback window moves with it.

    With ``near_dup`` the new postings land in a folder from which a second query reads them,
    folds them per (title, location) and scores what is admitted."""
    ckpt = (checkpoint or scratch_path(spark, "monitor-ckpt")).rstrip("/")
    outbox = outbox_root or f"{store.root}/outbox"
    base = _seeded(spark, f"{ckpt}-start", store)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    postings = to_postings(reader.parquet(source_path))
    now = F.current_timestamp() if as_of is None else as_timestamp(as_of)
    if lookback:
        postings = filters.time_filter(postings, now, lookback)                             # M02
    seeds = spark.readStream.schema("source_job_id string").parquet(f"{ckpt}-start/known")
    # the batch's time goes along: outside the stream's plan there is no batch clock
    fresh = first_arrivals(postings.withColumn("_now", now), "source_job_id", order_col, seeds)    # M03 / J03

    def score(batch: DataFrame, batch_id: int) -> None:
        at = as_of
        if at is None:
            at = batch.agg(F.max("_now")).first()[0]
            if at is None:
                return
        process_batch(batch.drop("_now", "_fkey", "_fp"), batch_id, store=store, profile=profile, as_of=at, topic=topic,
                      order_col=order_col, outbox_root=outbox, base=base)

    def started(df: DataFrame, run, mode: str, path: str):
        w = df.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", path)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{poll_seconds} seconds")).start()

    if not near_dup:
        return started(fresh, score, "update", ckpt)

    def land(batch: DataFrame, batch_id: int) -> None:
        # a key's rows of a batch lie in one file: no reader sees a part of them
        (batch.repartition("_fkey").withColumns({"_land": F.lit(batch_id).cast("long"), "_at": F.monotonically_increasing_id()})
         .write.mode("overwrite").parquet(f"{store.root}/fresh/batch_id={batch_id}"))

    keyed = fresh.withColumn("_fkey", dedup.fuzzy_key("title", "location")).withColumn("_fp", dedup.fingerprint(searchable_text()))
    first = started(keyed, land, "update", ckpt)
    if available_now:
        first.awaitTermination()
    kept = T.StructType([*keyed.schema.fields, T.StructField("_land", T.LongType()), T.StructField("_at", T.LongType())])
    landed = spark.readStream.schema(kept).option("maxFilesPerTrigger", max_files_per_trigger or 1000) \
        .parquet(f"{store.root}/fresh/batch_id=*").select("_fkey", order_col, "_fp", "_land", "_at")

    def score_admitted(batch: DataFrame, batch_id: int) -> None:
        """The fold sees only order and fingerprints; the admitted rows come from the folders that they name."""
        batch = batch.select("_land", "_at").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            folders = [f"{store.root}/fresh/batch_id={r[0]}" for r in batch.select("_land").distinct().collect()]
            here = batch.sparkSession
            rows = here.read.schema(kept).parquet(*folders) if folders else here.createDataFrame([], kept)
            score(rows.join(batch, ["_land", "_at"], "left_semi").drop("_land", "_at"), batch_id)
        finally:
            batch.unpersist()

    return started(near_dup_stream(landed, "_fkey", order_col, "_fp"), score_admitted, "append", f"{ckpt}-near")   # M06

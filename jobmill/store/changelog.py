"""The store as a log of changes: saves, marks, companies and runs are appended, and a job's
current row is the fold of its change rows (K01-K06, J05, J06, A01).

Nothing is rewritten: a batch of changes is one folder (``changes/batch=<n>``), written with
overwrite, so a lost executor or a replayed batch gives the same folder again, and seen by
readers once Spark's success mark stands in it. The files written follow the batch, not the
table, and each write drops its shuffle files when it ends. ``jobs()`` joins the rows that give a job's
fields (one per id) with what later rows change;
``compact`` writes its result as a base, so that readers fold only the batches after it. The change
rows stay: they are the version log (K02). Batches are written in the order of their numbers (a
batch may be written again).

A change row: id, kind ('save', 'mark', 'base'), at, is_new, the posting's fields (``first``),
given scores, the raw payload, notified_at. Per id the first save gives every field; later saves
give only ``updated_at`` and, when scored, the score; marks give ``notified_at``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeutil import as_timestamp
from ..operators.filters import BROADCAST_ROW_LIMIT
from ..session import path_exists, scratch_path, shuffle_files_dropped
from .blocks import packed_left_join
from .jobs import JOB_FIELDS, JOBS_SCHEMA, SCORE_FIELDS, arrived, company_key, run_rows_complete, run_rows_start, runs_latest, shaped

_FIRST = T.StructType([f for f in JOBS_SCHEMA.fields if f.name not in ("id", "score", "notified_at")])
CHANGE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("at", T.TimestampType()),
    T.StructField("is_new", T.BooleanType()), T.StructField("first", _FIRST), T.StructField("score", T.DoubleType()),
    T.StructField("touched_at", T.TimestampType()), T.StructField("notified_at", T.TimestampType()),
    T.StructField("raw_json", T.StringType())])
#: Payloads are most of a store's bytes: level 6 makes them a sixth smaller than 3.
ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
NOTE = "job_id string, sent_at timestamp, mode string, target string, success int"


def save_rows(incoming: DataFrame, known: DataFrame | None, as_of, order_col: str | None = None) -> DataFrame:
    """Change rows of a save: one per id (the first arrival), ``is_new`` if ``known`` (id) lacks it (None: has none)."""
    now = as_timestamp(as_of)
    raw = (F.coalesce(F.col("raw").cast("string"), F.lit("{}")) if "raw" in incoming.columns
           else F.to_json(F.struct(*[F.col(c) for c in incoming.columns if c != "id"])))
    inc = arrived(incoming, order_col, known)
    inc = shaped(inc if known is not None else inc.withColumn("_known", F.lit(None).cast("boolean")), "_known", raw.alias("_raw_json"))
    zero = {c: F.coalesce(c, F.lit(0.0)).alias(c) for c in SCORE_FIELDS}
    first = F.struct(*[now.alias(c) if c == "first_seen_at" else zero.get(c, F.col(c)) for c in _FIRST.names])
    out = inc.select(
        "id", F.lit("save").alias("kind"), now.alias("at"), F.col("_known").isNull().alias("is_new"), first.alias("first"),
        F.when(F.col("_has_scores"), F.col("score")).alias("score"), now.alias("touched_at"),
        F.lit(None).cast("timestamp").alias("notified_at"), F.col("_raw_json").alias("raw_json"))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHANGE.fields])


def mark_rows(ids: DataFrame, known: DataFrame, as_of) -> DataFrame:
    """Change rows that mark the ids that exist (``known``, each once) as notified."""
    now = as_timestamp(as_of)
    ids, known = ids.select(F.col("id").cast("string").alias("id")), known.select("id")
    n = known.count()
    if n <= BROADCAST_ROW_LIMIT:
        hit = ids.distinct().join(known, "id", "left_semi")
    else:
        hit = packed_left_join(known, ids.withColumn("_hit", F.lit(True)), "id", n).where("_hit")
    given = {"id": F.col("id"), "kind": F.lit("mark"), "at": now, "notified_at": now}
    return hit.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGE.fields])


#: Rows that give a job's fields: one per id, since a batch is compared with all batches before it.
_GIVES = "(kind = 'base' or (kind = 'save' and is_new))"


def fold(changes: DataFrame, columns=None) -> DataFrame:
    """Current rows (JOBS_SCHEMA, or the ``columns`` of it) of change rows with their ``batch``.

    An id's fields come from the one row that gives them; later saves (they alone have ``touched_at``) and
    marks are combined to a few values per id and joined to it. Without such rows, or for columns that they do not
    change, nothing is shuffled; if there are many, the wide rows move once, packed (``blocks``)."""
    fields = [f for f in JOBS_SCHEMA.fields if columns is None or f.name in columns]
    wide = changes.where(_GIVES).select("id", "score", "notified_at", *[
        F.col(f"first.{f.name}").alias(f"first_{f.name}") for f in fields if f.name in _FIRST.names])
    made = {"id": F.col("id")}
    if {f.name for f in fields} & {"score", "updated_at", "notified_at"}:
        later = changes.where(f"not coalesce({_GIVES}, false)").select(
            "id", "batch", F.col("touched_at").alias("_t"), F.col("score").alias("_s"), F.col("notified_at").alias("_n"))
        n = later.count()
        if n <= BROADCAST_ROW_LIMIT:
            last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in ("_t", "_s", "_n")]
            wide = wide.join(F.broadcast(later.groupBy("id").agg(*last)), "id", "left")
        else:
            wide = packed_left_join(wide, later, "id", n, order_col="batch")
        made |= {"score": F.coalesce("_s", "score", F.lit(0.0)), "notified_at": F.coalesce("_n", "notified_at"),
                 "updated_at": F.coalesce("_t", "first_updated_at")}
    return wide.select(*[made.get(f.name, F.col(f"first_{f.name}") if f.name not in ("score", "notified_at") else F.lit(None))
                         .cast(f.dataType).alias(f.name) for f in fields])


def base_rows(jobs: DataFrame) -> DataFrame:
    """Change rows that stand for current rows."""
    first = F.struct(*[F.col(c) for c in _FIRST.names])
    given = {"id": F.col("id"), "kind": F.lit("base"), "first": first, "score": F.col("score"), "touched_at": F.col("updated_at"),
             "notified_at": F.col("notified_at")}
    return jobs.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGE.fields])


class ChangeLog:
    """The folders of one store on shared storage (default: under spark.checkpoint.dir)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or scratch_path(spark, "jobs")).rstrip("/")

    def _numbers(self, folder: str) -> list[int]:
        """The complete parts (``folder``/<name>=<n>/_SUCCESS) of a log, ascending."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}/*=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def last_batch(self) -> int:
        return max(self._numbers("changes"), default=0)

    def changes(self, after: int = 0, before: int | None = None) -> DataFrame:
        """Change rows with their batch number (``after`` < batch < ``before``)."""
        paths = [f"{self.root}/changes/batch={n}" for n in self._numbers("changes") if n > after and (before is None or n < before)]
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*CHANGE.fields, T.StructField("batch", T.LongType())]))
        df = self.spark.read.schema(CHANGE).option("basePath", f"{self.root}/changes").parquet(*paths)
        return df.withColumn("batch", F.col("batch").cast("long"))

    def _since_base(self, before: int | None) -> DataFrame:
        upto = max((n for n in self._numbers("base") if before is None or n < before), default=0)
        rows = self.changes(upto, before)
        if upto:
            base = self.spark.read.schema(CHANGE).parquet(f"{self.root}/base/upto={upto}")
            rows = rows.unionByName(base.select("*", F.lit(upto).cast("long").alias("batch")))
        return rows

    def jobs(self, before: int | None = None, columns=None) -> DataFrame:
        """Current rows (of them ``columns``); with ``before``, as they were before that batch."""
        return fold(self._since_base(before), columns)

    def ids(self, before: int | None = None) -> DataFrame:
        """The ids of the stored jobs, each once: reads nothing but ids and kinds."""
        return self._given(before).distinct()

    def _given(self, before: int | None) -> DataFrame:
        return self._since_base(before).where(_GIVES).select("id")

    def _append(self, rows: DataFrame, batch: int) -> DataFrame:
        with shuffle_files_dropped(rows.sparkSession):
            rows.write.mode("overwrite").options(**ZSTD).parquet(f"{self.root}/changes/batch={batch}")
        return self.changes(batch - 1, batch + 1)

    def save(self, incoming: DataFrame, as_of, order_col: str | None = None, batch: int | None = None) -> dict:
        """Append the postings as one batch and get-or-create their companies.
        Returns the totals (A01: jobs_found, jobs_new), which the write itself has counted."""
        batch = batch or self.last_batch() + 1
        seen = Observation()
        known = self.ids(batch) if any(n < batch for n in self._numbers("changes")) else None
        rows = save_rows(incoming, known, as_of, order_col).observe(
            seen, F.count("*").alias("jobs_found"), F.coalesce(F.sum(F.col("is_new").cast("long")), F.lit(0)).alias("jobs_new"))
        written = self._append(rows, batch)
        names = written.select(F.col("first.company").alias("name")).where("name is not null").distinct()
        new = names.join(self.companies(batch).select("name"), "name", "left_anti")
        new.select(company_key("name").alias("company_id"), "name").write.mode("overwrite").parquet(f"{self.root}/companies/batch={batch}")
        return dict(seen.get)

    def notify(self, ids: DataFrame, mode: str, target: str, as_of, batch: int | None = None) -> DataFrame:
        """Mark the ids that exist; returns their notification rows."""
        batch = batch or self.last_batch() + 1
        marked = self._append(mark_rows(ids, self._given(batch), as_of), batch)
        notes = marked.select(F.col("id").alias("job_id"), F.col("at").alias("sent_at"), F.lit(mode).alias("mode"),
                              F.lit(target).alias("target"), F.lit(1).alias("success"))
        notes.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/notifications/batch={batch}")
        return self.spark.read.schema(NOTE).parquet(f"{self.root}/notifications/batch={batch}")

    def compact(self) -> int:
        """Write the current rows as a base; readers start from it. Returns the batch it covers."""
        upto = self.last_batch()
        if upto and upto not in self._numbers("base"):
            with shuffle_files_dropped(self.spark):
                base_rows(self.jobs(upto + 1)).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/base/upto={upto}")
        return upto

    def versions(self) -> DataFrame:
        """One row per saved posting and batch: (job_id, raw_json, fetched_at)."""
        return self.changes().where("kind = 'save'").select(F.col("id").alias("job_id"), "raw_json", F.col("at").alias("fetched_at"))

    def notifications(self) -> DataFrame:
        return self.spark.read.schema(NOTE).parquet(f"{self.root}/notifications").select("job_id", "sent_at", "mode", "target", "success")

    def companies(self, before: int | None = None) -> DataFrame:
        """(company_id, name) of all companies that were saved (before a batch)."""
        paths = [f"{self.root}/companies/batch={n}" for n in self._numbers("companies") if before is None or n < before]
        schema = "company_id long, name string"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def start_run(self, run_id: int, as_of) -> None:
        run_rows_start(run_id, as_of, self.spark).write.mode("append").parquet(f"{self.root}/runs")

    def complete_run(self, run_id: int, as_of, totals: dict | None, status: str = "completed", error: str | None = None) -> None:
        """``totals`` as ``save`` returns them (none: nothing was found)."""
        row = (int((totals or {}).get("jobs_found") or 0), int((totals or {}).get("jobs_new") or 0))
        frame = self.spark.createDataFrame([row], "jobs_found long, jobs_new long")
        run_rows_complete(run_id, as_of, frame, status, error).write.mode("append").parquet(f"{self.root}/runs")

    def runs(self) -> DataFrame:
        return runs_latest(self.spark.read.parquet(f"{self.root}/runs"))

    def exists(self) -> bool:
        return path_exists(self.spark, self.root)

"""Keyed streaming state (M03, M06, M02): what earlier micro-batches have seen lives in
Spark's state store, one entry per key, and a batch writes only the entries it touches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dedup import NEAR_DUP_SIMILARITY, _fold, max_hamming_for


def first_arrivals(stream: DataFrame, id_col: str, order_col: str, seeds: DataFrame | None = None) -> DataFrame:
    """The rows of a stream whose id is new: the first of each id (by batch, then
    ``order_col``), once and for all. ``seeds``: a stream of ids (``id_col``) that count as seen.
    Run in update mode.

    One built-in aggregation per id: rows of a hot id are combined before the exchange. A
    batch's rows carry the batch's time, and the smallest (time, order) row stays in the state, so
    what comes out of a batch is new exactly if it carries that batch's time."""
    cols = [c for c in stream.columns if c != id_col]
    rows = stream.select(id_col, F.struct(F.current_timestamp().alias("at"), F.lit(1).alias("turn"), F.col(order_col).alias("ord")).alias("_o"),
                         F.struct(*cols).alias("_row"))
    if seeds is not None:
        kinds = dict(zip(rows.columns, (f.dataType for f in rows.schema.fields)))
        order_kind = stream.schema[order_col].dataType
        first = F.struct(F.current_timestamp().alias("at"), F.lit(0).alias("turn"), F.lit(None).cast(order_kind).alias("ord"))
        rows = rows.union(seeds.select(F.col(id_col).cast(kinds[id_col]).alias(id_col), first.alias("_o"),
                                       F.lit(None).cast(kinds["_row"]).alias("_row")))
    first = rows.groupBy(id_col).agg(F.min_by(F.struct("_o", "_row"), "_o").alias("_f"))
    new = first.where((F.col("_f._o.at") == F.current_timestamp()) & (F.col("_f._o.turn") == 1))
    return new.select(*[F.col(id_col) if c == id_col else F.col(f"_f._row.{c}").alias(c) for c in stream.columns])


def near_dup_stream(stream: DataFrame, key_col: str, order_col: str, fp_col: str, *,
                    similarity: float = NEAR_DUP_SIMILARITY) -> DataFrame:
    """The rows of a stream that the ordered near-duplicate rule admits, per key, in
    ``order_col`` order within a batch; the state of a key is its last admitted fingerprint.
    Run in append mode.

    A key's rows of one batch are folded by one task, which holds all columns of them: give it
    order, fingerprint and what names the row (the monitor does), and get the rest of the
    admitted rows afterwards. ``maxFilesPerTrigger`` bounds a batch."""
    max_d, schema = max_hamming_for(similarity), stream.schema

    def run(key, parts, state: GroupState):
        rows = pd.concat(list(parts), ignore_index=True)
        rows = rows.sort_values(order_col, kind="stable")
        admitted, last = _fold(rows[fp_col].to_numpy(np.int64), state.get[0] if state.exists else None, max_d)
        state.update((int(np.uint64(last).astype(np.int64)),))
        yield rows[admitted]

    return (stream.groupBy(key_col)
            .applyInPandasWithState(run, schema, T.StructType([T.StructField("fp", T.LongType())]), "append",
                                    GroupStateTimeout.NoTimeout))


def within_lookback(stream: DataFrame, time_col: str, lookback: str, id_col: str) -> DataFrame:
    """M02 by event time: ids of rows not older than ``lookback`` before the newest row of the
    batches before, each once within that time. Older (late) rows are dropped and counted in the
    query's progress (``late_rows``); rows without a time have no age and are not for this path.
    The state holds the ids of the lookback only."""
    return (stream.where(F.col(time_col).isNotNull()).withWatermark(time_col, lookback)
            .dropDuplicatesWithinWatermark([id_col]))


def late_rows(query) -> int:
    """Rows that a finished or running query has dropped as late, over all its progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

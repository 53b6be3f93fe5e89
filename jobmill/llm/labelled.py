"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def held_out(id_col: str, m: int, fold: int) -> Column:
    return F.coalesce(remainder(id_col, m) == fold, F.lit(False))


def training_labels(labels: DataFrame, id_col: str, label: str, m: int, fold: int) -> DataFrame:
    """(id, label) of the rows outside the held-out fold: one row per id (the larger label
    if an id repeats), without null ids or labels."""
    return (labels.where(labels[id_col].isNotNull() & labels[label].isNotNull())
            .select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
            .where(~held_out("_id", m, fold)).groupBy("_id").agg(F.max("_label").alias("_label")))


def turn(id_col: str, salt: int) -> Column:
    """A fixed random order of the ids."""
    return F.xxhash64(F.lit(salt), F.col(id_col))


def first_by_turn(rows: DataFrame, limit: int, salt: int) -> DataFrame:
    """At most ``limit`` rows, the first in the fixed random order of their ``_id``."""
    return rows.orderBy(turn("_id", salt), "_id").limit(limit)

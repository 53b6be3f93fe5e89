"""Joins of wide rows with narrow ones, both of which cross the shuffle as compressed column blocks.

A wide row costs several times more as a shuffled row than in a Parquet file, where its columns lie together.
So each task packs its rows by key bucket into small Parquet blocks; the blocks are shuffled by bucket, and
the tasks that get them look the narrow rows up by key. A task holds the narrow rows of one bucket and the
wide rows of a few blocks; nothing is sorted or spilled but the blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HELD_BYTES = 128 << 20     # of rows that a task packs at a time
BUCKET_ROWS = 1_000_000    # narrow rows of a bucket, about
JOINED_ROWS = 200_000      # wide rows that are looked up at a time, unless they take HELD_BYTES before
OUT_ROWS = 10_000
_BLOCK = "_bucket int, _side int, _rows int, _bytes long, _block binary"
_BLOCK_ARROW = pa.schema([("_bucket", pa.int32()), ("_side", pa.int32()), ("_rows", pa.int32()), ("_bytes", pa.int64()), ("_block", pa.binary())])


def _repetitive(t: pa.Table) -> list[str]:
    """The columns that a dictionary makes smaller, by a look at the first rows."""
    head = t.slice(0, 4096)
    return [n for n in t.column_names if not pa.types.is_nested(t.schema.field(n).type)
            and 4 * pc.count_distinct(head[n], mode="all").as_py() <= head.num_rows]


def _packer(side: int):
    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        buckets = t["_bucket"].to_numpy()
        order = np.argsort(buckets, kind="stable")
        names, starts = np.unique(buckets[order], return_index=True)
        t = t.drop_columns(["_bucket"]).take(order)
        options = {"compression": "zstd", "use_dictionary": _repetitive(t), "write_statistics": False, "store_schema": False}
        for b, a, z in zip(names, starts, [*starts[1:], len(order)]):
            part, sink = t.slice(a, z - a), pa.BufferOutputStream()
            pq.write_table(part, sink, **options)
            yield pa.RecordBatch.from_pylist([{"_bucket": int(b), "_side": side, "_rows": part.num_rows, "_bytes": part.nbytes,
                                               "_block": sink.getvalue().to_pybytes()}], schema=_BLOCK_ARROW)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from blocks(held)
                held, size = [], 0
        if held:
            yield from blocks(held)
    return pack


def _joiner(key: str, order_col: str | None, narrow_schema: pa.Schema, wide_schema: pa.Schema, out: pa.Schema):
    given = [n for n in narrow_schema.names if n not in (key, order_col)]

    def last(narrow: pa.Table) -> pa.Table:
        """A row per key: of each column the last value that is not null."""
        if order_col is None:
            return narrow
        return narrow.sort_by(order_col).group_by(key, use_threads=False).aggregate([(n, "last") for n in given]).rename_columns(
            {f"{n}_last": n for n in given})

    def read(blocks: list[bytes], schema: pa.Schema) -> pa.Table:
        if not blocks:
            return schema.empty_table()
        return pa.concat_tables([pq.read_table(pa.BufferReader(b)).cast(schema) for b in blocks]).combine_chunks()

    def joined(narrow: pa.Table, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        wide = read(blocks, wide_schema)
        at = pc.index_in(wide[key], value_set=narrow[key], skip_nulls=True)
        t = pa.Table.from_arrays([*wide.columns, *[narrow[n].take(at) for n in given]], schema=out)
        yield from t.to_batches(OUT_ROWS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come by bucket, the narrow ones of a bucket first."""
        bucket, found, narrow, wide, rows, size = None, [], None, [], 0, 0
        for batch in batches:
            for row in zip(*batch.columns):
                b, side, n, nbytes, block = (x.as_py() for x in row)
                if b != bucket:
                    if wide:
                        yield from joined(narrow, wide)
                    bucket, found, narrow, wide, rows, size = b, [], None, [], 0, 0
                if side == 0:
                    found.append(block)
                    continue
                if narrow is None:
                    narrow, found = last(read(found, narrow_schema)), []
                wide.append(block)
                rows, size = rows + n, size + nbytes
                if rows >= JOINED_ROWS or size >= HELD_BYTES:
                    yield from joined(narrow, wide)
                    wide, rows, size = [], 0, 0
        if wide:
            yield from joined(narrow, wide)
    return join


def packed_left_join(wide: DataFrame, narrow: DataFrame, key: str, narrow_rows: int, order_col: str | None = None) -> DataFrame:
    """``wide`` left join ``narrow`` on ``key`` (null meets nothing). Narrow rows with one key count once: any of
    them or, with ``order_col`` (not returned), of each column the last value that is not null. ``narrow_rows``:
    about how many there are."""
    conf = wide.sparkSession.conf
    n = max(int(conf.get("spark.sql.shuffle.partitions")), -(-narrow_rows // BUCKET_ROWS))
    bucket = F.pmod(F.hash(key), F.lit(n)).alias("_bucket")
    few, many = ([T.StructField(f.name, f.dataType) for f in df.schema.fields] for df in (narrow, wide))  # all may be null
    out = T.StructType([*many, *[f for f in few if f.name not in (key, order_col)]])
    plain = [to_arrow_schema(T.StructType(s)) for s in (few, many, out.fields)]
    blocks = narrow.select("*", bucket).mapInArrow(_packer(0), _BLOCK).unionByName(wide.select("*", bucket).mapInArrow(_packer(1), _BLOCK))
    return blocks.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_side").mapInArrow(_joiner(key, order_col, *plain), out)

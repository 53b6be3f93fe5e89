"""Removal of long byte strings that occur more than once, by sampled suffixes refined by content.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else in
the corpus, the same document included. Prefix doubling over every position would sort
several times the corpus per round, so the suffixes are sampled first, in a way that loses
nothing: among the first ``WINDOW`` positions of each ``length``-byte string the one with the
smallest hash of its next 16 bytes is the string's anchor. Equal strings have their anchor at
the same distance d from their start, and an anchor stands for the whole run of starts that
share it. About one position in 100 is an anchor.

The anchors' classes are then refined at growing lengths, with Spark sorting and counting
(class, name of the longer stretch) pairs, and dropping what is unique, until the length is
reached. A class is named by its members' content (64-bit hashes of ever longer stretches),
so a rank needs no numbering pass:

1. the ``length - WINDOW + 1`` bytes from the anchor on, common to all strings of the anchor;
2. the whole context (all bytes of all strings of the anchor): an anchor whose context recurs
   is settled, every string of it is repeated. Of the others one of each context goes on;
3. blocks of 16 neighbouring distances: the ``length - 15`` bytes common to a block's strings,
   and the up to 15 + 15 bytes around them. Blocks that agree in both repeat each other whole;
   one of each kind goes on, if its common part stands in several kinds;
4. the single strings: class, distance and the bytes around the block's common part (named by
   two 64-bit hashes).

Counts are pre-aggregated on the map side, and the joins back have one row per class on the
other side, so a passage or copy that a third of all documents share stays spread out. The
texts travel twice, compressed, to meet their anchors and their spans.

Defined results: a null text is empty; strings never cross documents; rows that repeat an id
are documents of their own (equal rows repeat each other's strings); a text shorter than
``length`` loses nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, column, drop_staged, group_apart, mixed, slices, staged

WINDOW, GRAM, BLOCK = 256, 16, 16
SEGMENT = 1 << 20
KEY = ["f", "x", "y", "c"]


def _name(raw: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(raw)
    return h - (1 << 64) if h >> 63 else h


def anchors(buffer: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the strings that start at ``starts[i] .. starts[i] + counts[i] - 1`` of a
    buffer: (anchor, first start, last start) for each run of starts with one anchor."""
    b = np.frombuffer(buffer, np.uint8).astype(np.uint64)
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        b = b[:-step] | (b[step:] << np.uint64(bits))
    with np.errstate(over="ignore"):
        h = mixed(b[:-8] * np.uint64(0x9E3779B97F4A7C15) + b[8:] * np.uint64(0xC2B2AE3D27D4EB4F))
    # the smallest hash, the leftmost of equals
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step < WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    p = np.concatenate([np.arange(s, s + n) for s, n in zip(starts.tolist(), counts.tolist())])
    a = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
    return a[new], p[new], p[np.append(new[1:], len(p)) - 1]


def _parts(rows: Iterator[tuple[int, int, bytes]], length: int, segment: int | None = None) -> Iterator[tuple[bytes, list[tuple[int, int, int, int, int]]]]:
    """Buffers of about a segment: (bytes, [(id, th, offset in the document, place, starts)]).
    A longer document is cut into ranges of starts, each with the bytes that its strings need."""
    segment = segment or SEGMENT
    held, size, where = [], 0, []
    for doc, th, raw in rows:
        for s in range(0, len(raw) - length + 1, segment):
            n = min(segment, len(raw) - length + 1 - s)
            piece = raw[s:s + n + length - 1]
            where.append((doc, th, s, size, n))
            held.append(piece)
            size += len(piece)
            if size >= segment:
                yield b"".join(held), where
                held, size, where = [], 0, []
    if where:
        yield b"".join(held), where


ANCHORS = pa.schema([("f", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("c", pa.int64()),
                     ("id", pa.int64()), ("th", pa.int32()), ("a", pa.int64())])


def _bytes(b: pa.RecordBatch) -> Iterator[bytes]:
    return (t.encode("utf-8", "surrogatepass") for t in column(b, "_text").to_pylist())


def _anchored(length: int, segment: int):
    """Rows of ``ANCHORS``. A run of starts that the cut of a longer document divides is put
    together again: the last run of a range waits for the next range."""
    core = length - WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            rows = zip(column(b, "id").to_pylist(), column(b, "th").to_pylist(), _bytes(b))
            held = None  # f, x, id, th, anchor, last start, bytes of a cut document's last run

            def whole() -> pa.RecordBatch:
                f, x, doc, th, at, last, raw = held
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((f, x, at - last, _name(raw), doc, th, at), ANCHORS.types)],
                                                  schema=ANCHORS)

            for raw, where in _parts(rows, length, segment):
                starts = np.array([w[3] for w in where])
                a, lo, hi = anchors(raw, starts, np.array([w[4] for w in where]))
                at = np.searchsorted(starts, lo, side="right") - 1
                place = np.array([w[2] - w[3] for w in where])
                f = [_name(raw[i:i + core]) for i in a.tolist()]
                first, last = 0, len(a)
                if held:
                    if where[0][2] and a[0] + place[0] == held[4]:
                        held = (*held[:5], int(hi[0] + place[0]), held[6] + raw[lo[0] + length - 1:hi[0] + length])
                        first = 1
                    if first < last or where[0][4] < segment:
                        yield whole()
                        held = None
                # a range of full size may go on in the next one
                if first < last and where[-1][4] == segment:
                    last -= 1
                    doc, th, _, _, _ = where[-1]
                    held = (f[last], int(a[last] - lo[last]), doc, th, int(a[last] + place[-1]), int(hi[last] + place[-1]),
                            raw[lo[last]:hi[last] + length])
                part = slice(first, last)
                c = [_name(raw[i:j + length]) for i, j in zip(lo[part].tolist(), hi[part].tolist())]
                a, lo, hi, at = a[part], lo[part], hi[part], at[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f[part], pa.int64()), pa.array(a - lo, pa.int32()), pa.array(a - hi, pa.int32()), pa.array(c, pa.int64()),
                     pa.array(np.array([w[0] for w in where])[at], pa.int64()), pa.array(np.array([w[1] for w in where])[at], pa.int32()),
                     pa.array(a + place[at], pa.int64())], schema=ANCHORS)
            if held:
                yield whole()
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts, for the way through a shuffle."""
    z = zstandard.ZstdCompressor(level=3)
    for b in slices(batches, "_text"):
        yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "th"), pa.array([z.compress(r) for r in _bytes(b)], pa.binary())],
                                         names=["id", "th", "z"])


def _blocks(length: int):
    """Rows (f, k, core, left, right, x, y, c, n) of the wanted anchors of each text."""
    types = pa.schema([("f", pa.int64()), ("k", pa.int32()), ("core", pa.int64()), ("left", pa.binary()), ("right", pa.binary()),
                       ("x", pa.int32()), ("y", pa.int32()), ("c", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in slices(batches, "z"):
            out = []
            for blob, wanted in zip(column(b, "z").to_pylist(), column(b, "wanted").to_pylist()):
                raw = z.decompress(blob)
                for w in wanted:
                    a = w["a"]
                    for k in range(w["y"] // BLOCK, w["x"] // BLOCK + 1):
                        s, e = a - BLOCK * k, a - BLOCK * k + length - BLOCK + 1
                        out.append((w["f"], k, _name(raw[s:e]), raw[max(0, s - BLOCK + 1):s], raw[e:e + BLOCK - 1], w["x"], w["y"], w["c"], w["n"]))
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(cols, types.types)], schema=types)
    return run


def _cut(length: int):
    """Spans and kept bytes of each text from its settled anchors."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in slices(batches, "z"):
            n, spans, kept = [], [], []
            for blob, found in zip(column(b, "z").to_pylist(), column(b, "found").to_pylist()):
                raw = z.decompress(blob)
                edge = np.zeros(len(raw) + 1, np.int32)
                for r in found or ():
                    if r["k"] < 0:
                        runs = [(r["a"] - r["x"], r["a"] - r["y"])]
                    else:
                        runs = [(r["a"] - d, r["a"] - d) for d in (BLOCK * r["k"] + j for j in range(BLOCK) if r["mask"] >> j & 1)
                                if r["y"] <= d <= r["x"]]
                    for lo, hi in runs:
                        edge[lo] += 1
                        edge[hi + length] -= 1
                gone = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).view(np.int8), [0]])
                at = np.flatnonzero(np.diff(gone)).tolist()
                runs = list(zip(at[::2], at[1::2]))
                n.append(len(raw))
                spans.append([{"start": s, "end": e} for s, e in runs])
                kept.append(b"".join(raw[s:e] for s, e in zip([0, *at[1::2]], [*at[::2], len(raw)])))
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array(n, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())],
                                             names=["id", "n_bytes", "spans", "kept"])
    return run


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                     segment: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_bytes``, ``spans`` (removed bytes, start to end
    exclusive, maximal runs) and ``kept`` (the other bytes). ``length`` is over ``WINDOW + GRAM``;
    ``segment`` is how many starts of a text are worked on at a time (``SEGMENT``)."""
    if length < WINDOW + GRAM:
        raise ValueError(f"length must be at least {WINDOW + GRAM}")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.hash(text).alias("th"), text.alias("_text"))
    found = rows.mapInArrow(_anchored(length, segment or SEGMENT), "f bigint, x int, y int, c bigint, id bigint, th int, a bigint")
    packed = rows.mapInArrow(_packed, "id bigint, th int, z binary")
    # 1: classes of the common part
    twice = group_apart(found.select("f"), ["f"], F.count("*").alias("n")).where("n > 1").select("f")
    live = staged(found.join(twice.hint("shuffle_merge"), "f"), "anchors")
    # 2: whole contexts
    contexts = staged(live.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "a")).alias("one")), "contexts")
    several = group_apart(contexts, ["f"], F.count("*").alias("m")).where("m > 1").select("f")
    wanted = (contexts.join(several.hint("shuffle_merge"), "f")
              .groupBy(F.col("one.id").alias("id"), F.col("one.th").alias("th"))
              .agg(F.collect_list(F.struct("f", "x", "y", "c", "n", F.col("one.a").alias("a"))).alias("wanted")))
    # 3: blocks of distances, and their kinds
    blocks = staged(packed.join(wanted.hint("shuffle_merge"), ["id", "th"]).select("z", "wanted")
                    .mapInArrow(_blocks(length), "f bigint, k int, core bigint, left binary, right binary, x int, y int, c bigint, n bigint")
                    .withColumns({"lo": F.greatest(F.lit(0), F.col("y") - BLOCK * F.col("k")),
                                  "hi": F.least(F.lit(BLOCK - 1), F.col("x") - BLOCK * F.col("k")),
                                  "g1": F.xxhash64("f", "k", "core", "left", "right"),
                                  "g2": F.xxhash64(F.lit(1), "f", "k", "core", "left", "right")}), "blocks")
    kinds = staged(blocks.groupBy("g1", "g2", "f", "k", "core", "left", "right")
                   .agg(F.count("*").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "kinds")
    several = group_apart(kinds, ["f", "k", "core"], F.count("*").alias("kinds")).where("kinds > 1").select("f", "k", "core")
    # 4: the strings of the kinds that share their common part
    around = ["f", "k", "core", "j", F.expr("substring(`left`, length(`left`) - j + 1, j)"), F.expr(f"substring(`right`, 1, {BLOCK - 1} - j)")]
    strings = (kinds.join(several.hint("shuffle_merge"), ["f", "k", "core"]).withColumn("j", F.explode(F.sequence("lo", "hi")))
               .select(F.xxhash64(*around).alias("s1"), F.xxhash64(F.lit(1), *around).alias("s2"), "g1", "g2", "j", "m"))
    again = group_apart(strings, ["s1", "s2"], F.count("*").alias("times")).where("times > 1").select("s1", "s2")
    masks = (strings.where("m = 1").drop("m").join(again.hint("shuffle_merge"), ["s1", "s2"])
             .groupBy(F.struct("g1", "g2").alias("g")).agg(F.expr("cast(sum(shiftleft(1, j)) as int)").alias("mask"))
             .select("g.g1", "g.g2", "mask")
             .union(kinds.where("m > 1").select("g1", "g2", F.lit((1 << BLOCK) - 1).alias("mask"))))
    part = blocks.where("n = 1").select(*KEY, "k", "g1", "g2").join(masks.hint("shuffle_merge"), ["g1", "g2"]).select(*KEY, "k", "mask")
    settled = staged(contexts.where("n > 1").select(*KEY, F.lit(-1).alias("k"), F.lit(0).alias("mask")).union(part), "settled")
    for done in (blocks, kinds, contexts):
        drop_staged(done)
    spans = (live.join(settled.hint("shuffle_merge"), KEY).groupBy("id", "th")
             .agg(F.collect_list(F.struct("a", "x", "y", "k", "mask")).alias("found")))
    out = packed.join(spans.hint("shuffle_merge"), ["id", "th"], "left").select("id", "z", "found")
    out = out.mapInArrow(_cut(length), "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumn("id", F.nullif("id", F.lit(NO_ID)))


def repeated_strings_digest(docs: DataFrame) -> DataFrame:
    out = repeated_strings(docs)
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))

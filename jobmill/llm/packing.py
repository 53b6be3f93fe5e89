"""Hierarchical multi-length packing of tokenised documents.

Context sizes are the powers of two up to ``longest``. A document is cut into windows of the
longest size, which are sequences of their own; what is left of it is routed to the smallest
context that holds it. Within a task, a pool of such rests is packed from the longest tier
down: each rest opens a window of its tier, and the gap behind it is filled from shorter
tiers, longest fit first, cutting the last piece where nothing fits whole. So every sequence
fills its context, and what the pool cannot fill stays for the rests that follow. At the
task's end the remainder is cut along the smaller contexts. Each tier's sequences are dealt
to step groups of equal token counts (the last group of a tier in a partition is partial); a
group is named by (context, step), and holds sequences of one partition.

Packing is narrow: each input partition packs its own documents, and a partition's sequences
are numbered from its own range, so a rerun of a lost task gives the same rows. The pool is
bounded (``pool`` rests of less than ``longest`` tokens); no shuffle, no document crosses tasks.

Defined results: a null or empty text is the end token alone; rows that repeat an id are
packed as documents of their own; an empty table gives an empty result; other columns are
not carried (the result has a row per piece).
"""

from __future__ import annotations

import bisect
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices

# Fixed value: how the byte-level vocabulary file writes its bytes as printable characters.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# Fixed value: the pre-tokenisation pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` JSON file, run by tiktoken, which gives the same
    ids several times faster (a test holds one against the other)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rest = [b for b in range(256) if b not in set(_PLAIN)]
    byte = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str, end: int) -> np.ndarray:
    ids = tokenizer(path).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, end).astype("<u4")


def contexts(longest: int) -> list[int]:
    return [1 << k for k in range(longest.bit_length() - 1, -1, -1)]


class Pool:
    """Rests of documents by length. A rest is (length, order, document, start)."""

    def __init__(self):
        self.rests: list[tuple[int, int, int, int]] = []
        self.tokens = self.order = 0

    def add(self, document: int, start: int, length: int) -> None:
        bisect.insort(self.rests, (length, self.order, document, start))
        self.order += 1
        self.tokens += length

    def longest_up_to(self, length: int) -> tuple[int, int, int] | None:
        at = bisect.bisect_right(self.rests, (length, self.order, 0, 0)) - 1
        return self._take(at) if at >= 0 else None

    def _take(self, at: int) -> tuple[int, int, int]:
        n, _, document, start = self.rests.pop(at)
        self.tokens -= n
        return document, start, n

    def cut(self, length: int) -> tuple[int, int, int]:
        """The first ``length`` tokens of the shortest rest, which is longer; the others stay."""
        document, start, n = self._take(0)
        self.add(document, start + length, n - length)
        return document, start, length

    def window(self, context: int) -> list[tuple[int, int, int]]:
        """Pieces that fill a context; the pool must hold as many tokens."""
        pieces, gap = [], context
        while gap:
            piece = self.longest_up_to(gap) or self.cut(gap)
            pieces.append(piece)
            gap -= piece[2]
        return pieces

    def flush(self, sizes: list[int], last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(context, pieces) while windows can be filled: the tier of the longest rest comes
        first. With ``last``, the remainder is cut along the smaller contexts."""
        while self.tokens >= sizes[0]:
            longest = self.rests[-1][0]
            yield (c := next(c for c in reversed(sizes) if c >= longest)), self.window(c)
        if last:
            for c in sizes:
                while self.tokens >= c:
                    yield c, self.window(c)


def _packer(path: str, longest: int, end: int, pool_rows: int, step_tokens: int):
    sizes = contexts(longest)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        pool, docs, left = Pool(), {}, {}
        made, by_size, n_docs = 0, dict.fromkeys(sizes, 0), 0
        rows: list[tuple] = []

        def put(context: int, pieces: list[tuple[int, int, int]]) -> None:
            nonlocal made
            offset = 0
            step = base + by_size[context] * context // step_tokens
            for d, start, n in pieces:
                doc_id, ids = docs[d]
                rows.append((doc_id, start, n, ids[start:start + n].tobytes(), len(ids), base + made, offset, context, step))
                offset += n
                left[d] -= n
                if not left[d]:
                    del docs[d], left[d]
            by_size[context] += 1
            made += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(PIECES)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PIECES.types)], names=PIECES.names)

        for b in slices(batches, "_text"):
            for doc_id, text in zip(column(b, "_id").to_pylist(), column(b, "_text").to_pylist()):
                ids = token_ids(text, path, end)
                docs[n_docs], left[n_docs] = (doc_id, ids), len(ids)
                whole = len(ids) // longest * longest
                rest = len(ids) - whole
                for start in range(0, whole, longest):
                    put(longest, [(n_docs, start, longest)])
                if rest:
                    # the windows are written: keep the rest's ids only
                    docs[n_docs] = (doc_id, _Tail(ids[whole:].copy(), whole))
                    pool.add(n_docs, whole, rest)
                n_docs += 1
                if len(pool.rests) >= pool_rows:
                    for context, pieces in pool.flush(sizes, False):
                        put(context, pieces)
            yield out()
        for context, pieces in pool.flush(sizes, True):
            put(context, pieces)
        yield out()
    return pack


class _Tail:
    """The ids of a document from ``start`` on, addressed as in the document."""

    def __init__(self, ids: np.ndarray, start: int):
        self.ids, self.start = ids, start

    def __len__(self) -> int:
        return self.start + len(self.ids)

    def __getitem__(self, s: slice) -> np.ndarray:
        return self.ids[s.start - self.start:s.stop - self.start]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("context", pa.int64()), ("step", pa.int64())])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024,
         end: int = 0, pool: int = 4096, step_tokens: int = 1 << 16) -> DataFrame:
    """One row per piece: its document, place and ids (little-endian unsigned 32-bit), the
    sequence and offset where it lies, the sequence's context size and step group. ``path``
    names a byte-level BPE file of ``tokenizers``; ``longest`` is a power of two."""
    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    return rows.mapInArrow(_packer(path, longest, end, pool, step_tokens),
                           "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
                           "sequence_id bigint, offset bigint, context bigint, step bigint")


def pack_digest(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                   "sequence_id", "offset", "context", "step")

"""De-duplication: exact key (W01), SimHash fingerprints (A05), ordered near-duplicate
fold (W02), first-wins by key (W04), per-page merge preference (W05).

Skew: every key may be hot (a third of all rows under one key). W01/W04 are
``row_number() = 1`` (partial window-group limit before the shuffle) and W05 a
``max_by`` aggregation (map-side combine), so a hot key costs one row per map task. W02 is order dependent; it runs on a
range partitioning of (key, seq), which splits a hot key across many tasks, and
stitches the pieces exactly (see ``near_dup_fold``)."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark import StorageLevel
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_text, word_hash64
from ..session import ensure_checkpoint_dir

SIMHASH_BITS = 64
_MASK = (1 << 64) - 1
NEAR_DUP_SIMILARITY = 0.85


def max_hamming_for(similarity: float = NEAR_DUP_SIMILARITY, bits: int = SIMHASH_BITS) -> int:
    """Largest Hamming distance d with 1 - d/bits >= similarity."""
    return max(d for d in range(bits + 1) if 1.0 - d / bits >= similarity)


# ---------------------------------------------------------------------------
# First row per key in arrival order
# ---------------------------------------------------------------------------
def first_per_key(df: DataFrame, key_cols: list[str], order_col: str | Column) -> DataFrame:
    """Keep the row with the smallest ``order_col`` per key (ties: any).

    ``row_number() = 1``: Spark plans a partial window-group limit before the
    shuffle, so each map task sends at most one row per key (a hot key stays cheap),
    and no wide struct buffer is aggregated."""
    order = F.col(order_col) if isinstance(order_col, str) else order_col
    w = Window.partitionBy(*key_cols).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def exact_dedup(postings: DataFrame, order_col="seq") -> DataFrame:
    """First posting per company:source_system:source_job_id."""
    return first_per_key(postings, ["company", "source_system", "source_job_id"], order_col)


def prefer_per_key(df: DataFrame, key_cols: list[str], pref: Column, highest=True) -> DataFrame:
    """Keep the row with the best preference struct per key."""
    cols = df.columns
    agg = F.max_by if highest else F.min_by
    return df.withColumn("_pref", pref).groupBy(*key_cols).agg(
        agg(F.struct(*[F.col(c) for c in cols]), F.col("_pref")).alias("_row")).select("_row.*")


# ---------------------------------------------------------------------------
# SimHash as a partial aggregation over exploded words
# ---------------------------------------------------------------------------
def _fingerprints(texts: pd.Series) -> pd.Series:
    """SimHash of already-normalized texts (words separated by single spaces)."""
    cache: dict = {}
    out = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if not t:
            continue
        words = [w for w in t.split(" ") if w]
        if not words:
            continue
        hs = np.empty(len(words), dtype=np.uint64)
        for j, w in enumerate(words):
            h = cache.get(w)
            if h is None:
                h = int.from_bytes(hashlib.md5(w.encode("utf-8")).digest()[8:], "big")
                cache[w] = h
            hs[j] = h
        # bit i of every hash: little-endian bytes unpacked little-endian -> column i
        bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = 2 * bits.sum(axis=0, dtype=np.int64) - len(words)
        fp = 0
        for b in np.flatnonzero(votes > 0):
            fp |= 1 << int(b)
        out[i] = fp - (1 << 64) if fp >= (1 << 63) else fp
    return pd.Series(out)


_fingerprint_udf = F.pandas_udf(_fingerprints, T.LongType())


def fingerprint(text) -> Column:
    """SimHash of a text column as a column expression (Arrow batches, map-only)."""
    t = F.col(text) if isinstance(text, str) else text
    return _fingerprint_udf(normalize_text(t))


def simhash(df: DataFrame, text_col: str, group_cols: list[str], out: str = "fingerprint",
            method: str = "arrow") -> DataFrame:
    """64-bit SimHash per row of ``df`` (``group_cols`` identify the row): md5 low 64
    bits of every normalized word vote +1/-1 per bit; a bit is set iff its sum is > 0;
    text without words gives 0.

    ``arrow`` (default): normalization runs in the JVM, the vote runs per Arrow batch
    in numpy inside the same task: a narrow map, no shuffle, cost linear in the text.
    ``jvm``: words are exploded (explode_outer keeps word-less rows) and the 64 votes
    are summed by a hash aggregate that combines map-side before a shuffle of one
    64-counter row per (row, map task)."""
    if method == "arrow":
        return df.select(*group_cols, _fingerprint_udf(normalize_text(text_col)).alias(out))
    words = df.select(*group_cols, F.explode_outer(F.split(normalize_text(text_col), " ")).alias("_w"))
    h = F.when(F.col("_w") != "", word_hash64(F.col("_w")))
    words = words.select(*group_cols, h.alias("_h"))
    votes = [F.sum(F.when(F.col("_h").isNotNull(),
                          F.shiftrightunsigned(F.col("_h"), i).bitwiseAND(F.lit(1)) * 2 - 1))
             .alias(f"_v{i}") for i in range(SIMHASH_BITS)]
    agg = words.groupBy(*group_cols).agg(*votes)
    bits = [F.when(F.coalesce(F.col(f"_v{i}"), F.lit(0)) > 0, F.shiftleft(F.lit(1).cast("bigint"), i))
            .otherwise(F.lit(0).cast("bigint")) for i in range(SIMHASH_BITS)]
    fp = reduce(lambda a, b: a.bitwiseOR(b), bits)
    return agg.select(*group_cols, fp.alias(out))


# ---------------------------------------------------------------------------
# Ordered near-duplicate fold
# ---------------------------------------------------------------------------
def _fold(hashes: np.ndarray, state, max_d: int):
    """Sequential rule on one ordered run: admit iff no state or distance > max_d;
    admitting replaces the state. Returns (admitted flags, final state). Looks for the
    next row to admit in blocks that double, so stretches of near copies are skipped at
    array speed."""
    hs = np.ascontiguousarray(hashes, dtype=np.int64).view(np.uint64)
    n = len(hs)
    admitted = np.zeros(n, dtype=bool)
    s, i, step = None if state is None else int(state) & _MASK, 0, 1
    while i < n:
        if s is None:
            far = 0
        else:
            far = np.flatnonzero(np.bitwise_count(hs[i:i + step] ^ np.uint64(s)) > max_d)[:1]
            if not far.size:
                i, step = i + step, min(2 * step, 1 << 16)
                continue
            far = int(far[0])
        i, step = i + far, 1
        admitted[i] = True
        s = int(hs[i])
        i += 1
    return admitted, s


def _distance(a: int, b: int) -> int:
    return ((a ^ b) & _MASK).bit_count()


class _Segment:
    """What a segment does with any state carried into it, as far as a few numbers tell:
    its first fingerprint, the largest distance from it, the final state after admitting
    the first row, and whether two neighbours are more than 2 * max_d apart.

    * A state is within max_d of the last row it did not admit, so a row more than
      2 * max_d from the row before it is always admitted: from there on the fold does not
      depend on what came in (``fixed``).
    * A state farther than max_d from the first row admits it.
    * A state s with distance(s, first) + radius <= max_d admits nothing and goes through.
    """

    def __init__(self, first: int, radius: int, final: int, fixed: bool, max_d: int):
        self.first, self.radius, self.final, self.fixed, self.max_d = first, radius, final, fixed, max_d

    def out(self, state: int):
        """The state after the segment, or None if only the rows can tell."""
        near = _distance(state, self.first)
        if self.fixed or near > self.max_d:
            return self.final
        return state if near + self.radius <= self.max_d else None


def _resolve(begun: int, segments: dict, known: dict, guesses: int = 8):
    """Walk a key's segments from ``begun``, the state after the first one. Returns (entry states, as far
    as they are certain, None where not; questions {segment: states to fold it from}). Past a
    segment that cannot be told, the walk goes on with every state it may give (at most
    ``guesses``), so that one pass over the rows answers for many segments at once."""
    entry, asked = {}, {}
    states, certain = [begun], True
    for pid in sorted(segments)[1:]:
        entry[pid] = states[0] if certain else None
        after = []
        for s in states:
            t = segments[pid].out(s)
            t = known.get((pid, s)) if t is None else t
            if t is None:
                asked.setdefault(pid, []).append(s)
                certain = False
                after += [s, segments[pid].final, *(v for (p, _), v in known.items() if p == pid)]
            else:
                after.append(t)
        states = list(dict.fromkeys(after))[:guesses]
    return entry, asked


def _seg_init(seg):
    """Carried-in state of a key (same on every row of the key), or None."""
    v = seg["_init"].iat[0]
    return None if pd.isna(v) else int(v)


def _u64(x) -> int:
    return int(x) & _MASK


def near_dup_fold(df: DataFrame, key_col: str, seq_col: str, fp_col: str, id_col: str,
                  *, similarity: float = NEAR_DUP_SIMILARITY, num_partitions: int | None = None,
                  max_rounds: int | None = None, initial: DataFrame | None = None,
                  rows_per_partition: int = 4_000_000) -> DataFrame:
    """Per key, in ``seq`` order, admit a row iff its fingerprint's similarity to the
    last admitted row of that key is below ``similarity`` (the first row is admitted).

    ``initial`` (key_col, fp_col): the last admitted fingerprint per key from earlier
    runs; the fold of that key starts from it (incremental dedup across runs/batches).

    Returns (id, key, fp, admitted) for every input row (``id`` must be unique).

    Plan: range-partition on (key, seq) so a hot key is split into ordered segments on
    several tasks; checkpoint the (narrow) partitioned data; fold every segment once from
    an empty state and summarise it (``_Segment``). The driver composes the summaries of a
    key that spans partitions. They tell all of it where neighbours differ much (states are
    forgotten) and where all rows are near copies (states go through). Between the two,
    segments that cannot be told are folded again, from all states that may reach them at
    once, until every entry state is known; a last pass folds each segment from its entry
    state. Only per-segment summaries (at most two per partition) reach the driver."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    max_d = max_hamming_for(similarity)
    # Range partitions of the narrow (id, key, seq, fp) rows; size with
    # spark.sql.shuffle.partitions (or num_partitions) to a few million rows each.
    base = df.select(F.col(id_col).alias("_id"), F.col(key_col).cast("string").alias("_key"),
                     F.col(seq_col).alias("_seq"), F.col(fp_col).cast("bigint").alias("_fp"))
    if initial is not None:
        from .filters import maybe_broadcast
        init = initial.select(F.col(key_col).cast("string").alias("_key"),
                              F.col(fp_col).cast("bigint").alias("_init"))
        base = base.join(maybe_broadcast(init), "_key", "left")
    else:
        base = base.withColumn("_init", F.lit(None).cast("bigint"))
    # The range partitioner samples its input in a separate job: keep the narrow rows
    # cached so the upstream work (e.g. fingerprinting) runs once.
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    if num_partitions is None:
        # ~rows_per_partition narrow rows per range partition (the count reads the cache)
        rows = base.count()
        num_partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                             -(-rows // rows_per_partition))
    n = num_partitions
    ranged = base.repartitionByRange(n, "_key", "_seq").sortWithinPartitions("_key", "_seq")
    # The order is fixed now; seq itself (possibly a struct) never enters Python.
    ranged = ranged.select("_id", "_key", "_fp", "_init", F.spark_partition_id().alias("_pid")) \
        .checkpoint(eager=True)
    base.unpersist()

    first_schema = "pid int, key string, begun long, final long, first long, radius int, fixed boolean"
    again_schema = "pid int, key string, state long, final long"

    def segments(it):
        """Yield (pid, key, part, is_first_run, is_last_piece) per key run piece of one
        partition, streaming Arrow batches; a key run cut by a batch boundary comes out
        as consecutive pieces (the caller carries its fold state across them)."""
        first_key = None
        pending = None
        for pdf in it:
            if pdf.empty:
                continue
            keys = pdf["_key"].to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(pdf)]
            pid = int(pdf["_pid"].iat[0])
            for s, e in zip(starts, ends):
                if first_key is None:
                    first_key = keys[s]
                if pending is not None:
                    ppid, pkey, ppart = pending
                    yield ppid, pkey, ppart, pkey == first_key, pkey != keys[s]
                pending = (pid, keys[s], pdf.iloc[s:e])
        if pending is not None:
            ppid, pkey, ppart = pending
            yield ppid, pkey, ppart, pkey == first_key, True

    def _signed(x):
        return x - (1 << 64) if x is not None and x >= (1 << 63) else x

    def summaries(it):
        """One row for the first and one for the last key run of the partition: the final state
        from the key's carried-in state (``begun``), and what ``_Segment`` holds."""
        cur_key, held, rows, last = None, None, [], None
        for pid, key, part, is_first, is_last in segments(it):
            hs = part["_fp"].to_numpy().view(np.uint64)
            if key != cur_key:
                cur_key, prev = key, hs[0]
                held = {"begun": _seg_init(part), "state": None, "first": int(hs[0]), "radius": 0, "fixed": False}
                carried = held["begun"] is not None
            held["state"] = _fold(hs, held["state"], max_d)[1]
            held["begun"] = _fold(hs, held["begun"], max_d)[1] if carried else held["state"]
            held["radius"] = max(held["radius"], int(np.bitwise_count(hs ^ np.uint64(held["first"])).max()))
            held["fixed"] |= bool((np.bitwise_count(hs ^ np.r_[prev, hs[:-1]]) > 2 * max_d).any())
            prev = hs[-1]
            if is_last:
                row = (pid, key, *(_signed(_u64(held[c])) for c in ("begun", "state", "first")), held["radius"], held["fixed"])
                if is_first:
                    rows.append(row)
                else:
                    last = row         # keep only the partition's last run
        if last is not None:
            rows.append(last)
        if rows:
            yield pd.DataFrame(rows, columns=["pid", "key", "begun", "final", "first", "radius", "fixed"])

    def answers(asked: dict):
        """Final states of the segments asked for, from each of the states listed for them."""
        def run(it):
            rows, cur_key, states = [], None, None
            for pid, key, part, _first, is_last in segments(it):
                if key != cur_key:
                    cur_key = key
                    states = [(c, _u64(c)) for c in asked.get((pid, key), ())]
                if states:
                    hs = part["_fp"].to_numpy()
                    states = [(c, _fold(hs, s, max_d)[1]) for c, s in states]
                    if is_last:
                        rows.extend((pid, key, c, _signed(s)) for c, s in states)
            if rows:
                yield pd.DataFrame(rows, columns=["pid", "key", "state", "final"])
        return run

    chains: dict = {}                  # key -> {pid: segment}
    begun: dict = {}                   # key -> state after its first segment
    for r in sorted(ranged.mapInPandas(summaries, first_schema).collect(), key=lambda r: r["pid"]):
        chains.setdefault(r["key"], {})[r["pid"]] = _Segment(r["first"], r["radius"], r["final"], r["fixed"], max_d)
        begun.setdefault(r["key"], r["begun"])
    chains = {k: v for k, v in chains.items() if len(v) > 1}
    known: dict = {k: {} for k in chains}    # (pid, entry state) -> final state, of the segments asked for
    entry: dict = {}                   # entry state per continuation segment
    rounds, open_keys = 0, set(chains)
    while open_keys:
        wanted: dict = {}
        for k in sorted(open_keys):
            states, asked = _resolve(begun[k], chains[k], known[k])
            wanted.update({(pid, k): ss for pid, ss in asked.items()})
            if None not in states.values():
                entry.update({(pid, k): st for pid, st in states.items()})
                open_keys.discard(k)
        if not wanted:
            break
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError("near_dup_fold: entry states did not settle")
        some = ranged.filter(F.col("_pid").isin(sorted({p for p, _ in wanted})))
        for r in some.mapInPandas(answers(wanted), again_schema).collect():
            known[r["key"]][(r["pid"], r["state"])] = r["final"]

    resolved = dict(entry)
    fields = [(id_col, ranged.schema["_id"].dataType, "_id"), (key_col, T.StringType(), "_key"),
              (fp_col, T.LongType(), "_fp")]
    seen_names, out_fields = set(), []
    for name, dtype, src in fields:
        if name not in seen_names:
            seen_names.add(name)
            out_fields.append((name, dtype, src))
    out_schema = T.StructType([T.StructField(n, d) for n, d, _ in out_fields]
                              + [T.StructField("admitted", T.BooleanType())])

    def final_pass(it):
        state, cur = None, None
        for pid, key, part, _first, is_last in segments(it):
            if key != cur:
                cur = key
                st = resolved.get((pid, key), _seg_init(part))
                state = None if st is None else _u64(st)
            adm, state = _fold(part["_fp"].to_numpy(), state, max_d)
            cols = {n: part[src].to_numpy() for n, _, src in out_fields}
            cols["admitted"] = adm
            yield pd.DataFrame(cols)
            if is_last:
                cur = None

    return ranged.mapInPandas(final_pass, out_schema)


def last_admitted(folded: DataFrame, key_col: str, fp_col: str, order_col: str,
                  previous: DataFrame | None = None) -> DataFrame:
    """New dedup state: last admitted fingerprint per key (``folded`` must carry the
    order column), merged over the previous state for keys not seen this run."""
    cur = folded.filter("admitted").groupBy(key_col).agg(F.max_by(fp_col, order_col).alias(fp_col))
    if previous is None:
        return cur
    old = previous.select(key_col, fp_col).join(cur.select(key_col), key_col, "left_anti")
    return cur.unionByName(old)


def fuzzy_key(*cols) -> Column:
    """normalize(a):normalize(b)... (the title:location key; no company, by design)."""
    return F.concat_ws(":", *[normalize_text(F.coalesce(F.col(c) if isinstance(c, str) else c,
                                                         F.lit(""))) for c in cols])

"""Near-duplicate groups by one-permutation MinHash.

1. Every text becomes its set of word shingles (64-bit hashes). One permutation splits the
   hash range into 256 bins and keeps each bin's minimum; empty bins are filled by optimal
   densification (each draws bins from its own fixed random sequence until one was not
   empty). Rows with equal sets collapse into one class, represented by its smallest id.
2. 32 bands of four bins give bucket keys. A pair at similarity 0.8 shares no
   bucket with a chance of (1 - 0.8^4)^32 = 5e-8.
3. Stars: each bucket links its smallest member (the centre) with every other member, so
   pairs grow with the members. Pairs whose set sizes or signatures rule out the threshold
   go; the rest is confirmed on the full sets.
4. A star misses links between members that do not resemble its centre. So the components
   of the confirmed links are computed, and the members of buckets that still hold several
   components are looked at again. A shingle that no other of them has cannot be shared, so
   the rest of a set (its solid part) bounds what it has in common with any partner; members
   that cannot reach the threshold with anyone leave.
5. The others are compared by their differences from the bucket's centre c. For sets x and y,
   |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy| with Dx = x ^ c, and they are linked if |x ^ y| is at
   most (|x| + |y|) (1 - t) / (1 + t). Two members that are both linked with c are in one
   component already, so one of the two, say x, is not: |Dx| is above that bound for x and c.
   Then y shares at least (|Dy| + (|c| - |y|) (1 - t) / (1 + t)) / 2 elements of its difference
   with x. Elements that members of one component only have do not count, the others are ordered
   rarest first, and by the prefix principle x holds one of the first |Sy| - need + 1. Copies
   of a text differ from its centre in few, mostly different places, so the pairs that share
   such an element are few, however many members a bucket has. The bound is exact: no pair of
   a bucket that reaches the threshold is lost, and nothing is capped.

Components come from alternating large-star and small-star steps. Buckets, stars and
components are joins against one row per key, so hot groups are pre-aggregated on the map
side and can be split by adaptive execution; no group is collected anywhere. The text is
shuffled once, and only candidate texts go further.

Defined results: a null text, or one without words, has an empty set and is linked with
nothing; a text shorter than a shingle is one shingle; rows that repeat an id are compared
as rows of their own; a null id orders after all others and is never returned as the id of
a group that has another; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, column, drop_staged, group_apart, mixed, slices, staged

#: Bins of a signature; the first BANDS * BAND of them make the bucket keys.
BINS, BAND, BANDS = 256, 4, 32
NODE = "struct<id:bigint,s:bigint>"


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    # on bytes, lower() changes A-Z and split() cuts at \x20 and \x09-\x0D only
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            h = mixed((h + w[i:n - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h)


@functools.cache
def _probes(attempt: int) -> np.ndarray:
    """The bin that each empty bin tries at this attempt: a fixed function of both."""
    x = np.arange(BINS, dtype=np.uint64) + np.uint64(attempt * BINS + 1)
    with np.errstate(over="ignore"):
        return (mixed(x * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64)


_STARTS = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 8))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 256 16-bit minima per set (zeros for an empty set)."""
    out = np.zeros((len(sets), BINS), np.uint16)
    full = np.zeros((len(sets), BINS), bool)
    for r, h in enumerate(sets):
        if len(h):
            at = np.searchsorted(h, _STARTS)
            end = np.append(at[1:], len(h))
            full[r] = at < end
            out[r] = (h[np.minimum(at, len(h) - 1)] >> np.uint64(40)).astype(np.uint16)
    open_rows = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    had, val, attempt = full[open_rows], out[open_rows], 0
    got = had.copy()
    while len(open_rows):
        to = _probes(attempt)
        take = ~got & had[:, to]
        r, c = np.nonzero(take)
        out[open_rows[r], c] = val[r, to[c]]
        got |= take
        attempt += 1
        # finished rows leave: only the shortest sets need many attempts
        left = ~got.all(axis=1)
        if not left.all():
            open_rows, had, val, got = open_rows[left], had[left], val[left], got[left]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def set_sums(h: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit digests of a set."""
    with np.errstate(over="ignore"):
        return (_signed(int(mixed(h ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64))),
                _signed(int(mixed(h + np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64))))


def _signer(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            sets = [shingle_set(t, k) for t in column(b, "_text").to_pylist()]
            sums = [set_sums(h) for h in sets]
            sig = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [column(b, "_id"), column(b, "_th"), pa.array([len(h) for h in sets], pa.int64()),
                 pa.array([s for s, _ in sums], pa.int64()), pa.array([s for _, s in sums], pa.int64()),
                 pa.array([r.tobytes() for r in sig], pa.binary())],
                names=["id", "th", "n", "s", "s2", "sig"])
    return sign


def _alike(percent: int):
    """Can the pair's signatures belong to sets at the threshold? They may have five
    deviations fewer equal bins than expected there."""
    share = percent / 100
    least = int((share - 5 * (share * (1 - share) / BINS) ** 0.5) * BINS)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(column(b, c).to_pylist()), np.uint16).reshape(-1, BINS)
                        for c in ("xs", "ys"))
                ok = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([column(b, "x"), column(b, "y")], names=["x", "y"]).filter(ok)
    return test


def _confirm(k: int, percent: int):
    """Keep the pairs whose full sets reach the threshold. Rows come sorted by the centre,
    whose set is computed once."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hx = None, None
        for b in slices(batches, "yt"):
            keep = []
            for xt, yt in zip(*(column(b, c).to_pylist() for c in ("xt", "yt"))):
                if xt != last:
                    last, hx = xt, shingle_set(xt, k)
                hy = shingle_set(yt, k)
                both = len(np.intersect1d(hx, hy, assume_unique=True))
                keep.append(100 * both >= percent * (len(hx) + len(hy) - both))
            yield pa.RecordBatch.from_arrays([column(b, "x"), column(b, "y")], names=["x", "y"]).filter(pa.array(keep))
    return test


def connected(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the edges (x, y) that is not its component's smallest."""
    e = edges.where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    old = None
    while True:
        both = e.union(e.select("v", "u"))
        low = group_apart(both, ["u"], F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.join(low.hint("shuffle_merge"), "u").where("v > u and v != m")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")), "cc")
        least = group_apart(large, ["u"], F.min("v").alias("m"))
        met = large.join(least.hint("shuffle_merge"), "u")
        small = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                             F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
        e = staged(small.where("u != v").distinct(), "cc")
        for done in (old, large):
            if done is not None:
                drop_staged(done)
        old = e
        # done when every node points to one root and no root points on
        ends = e.select("u", F.lit(1).alias("n"), F.lit(0).alias("r")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("n").alias("n"), F.max("r").alias("r")).where("n > 1 or (n > 0 and r > 0)").isEmpty():
            return e.select("u", F.col("v").alias("root"))


def _band_keys() -> Column:
    width = 2 * BAND
    return F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(BANDS)])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``id``, a hash of its text (``th``), its set size (``n``),
    the smallest id that can be reached (``component``), whether that is its own (``kept``), and
    the name of its group (``group``, null for a text without shingles)."""
    text = docs.select(F.coalesce(docs[id_col], F.lit(NO_ID)).alias("_id"), F.xxhash64(docs[text_col]).alias("_th"), docs[text_col].alias("_text"))
    signed = staged(text.select("_id", "_text", "_th").mapInArrow(_signer(shingle), "id bigint, th bigint, n bigint, s bigint, s2 bigint, sig binary"), "oph")
    # a class of equal sets is its smallest row: (id, set digest) names it, (id, text hash) finds its text
    nodes = staged(signed.where("n > 0").groupBy("s", "s2", "n").agg(F.min(F.struct("id", "th")).alias("f"), F.first("sig").alias("sig"))
                   .select(F.struct("f.id", "s").alias("v"), "f.th", "n", "s2", "sig"), "oph")
    sigs = nodes.select("v", "sig")
    bands = nodes.select("v", "n", F.explode(_band_keys()).alias("k"))
    centres = (group_apart(bands, ["k"], F.min(F.struct("v", "n")).alias("c"), F.count("*").alias("m")).where("m > 1")
               .select("k", "m", F.col("c.v").alias("c"), F.col("c.n").alias("cn")))
    members = staged(bands.join(centres.hint("shuffle_merge"), "k").where("v != c"), "buckets")
    near = lambda a, b: f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"
    pairs = members.where(near("n", "cn")).select(F.col("c").alias("x"), F.col("v").alias("y")).distinct()
    source = (nodes.select("v", "th"), text)
    links = _linked(pairs, sigs, source, shingle, percent)
    roots = connected(links)
    # its centre has met all members of a bucket: the others remain
    rest = staged(_open(members.select("k", "c", "cn", "v", "n"), roots), "open")
    if not rest.isEmpty():
        texts = staged(_texts(rest.select("v").union(rest.select("c")), source), "texts")
        alone = _alone(rest.select("v").distinct(), texts, shingle)
        able = (rest.join(alone.hint("shuffle_merge"), "v", "left")
                .withColumn("solid", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
                .where(f"100 * solid >= {percent} * n"))
        pairs = _apart(able, texts, shingle, percent)
        linked = _linked(pairs, sigs, source, shingle, percent)
        if not linked.isEmpty():
            roots = connected(links.union(linked))
    cls = nodes.select("v", "n", "s2").join(roots.select(F.col("u").alias("v"), "root").hint("shuffle_merge"), "v", "left")
    cls = cls.select(F.col("v.s").alias("s"), "s2", "n", F.coalesce("root", "v").alias("group"), F.coalesce("root", "v")["id"].alias("root"))
    rows = signed.select("id", "th", "n", "s", "s2").join(cls.hint("shuffle_merge"), ["s", "s2", "n"], "left")
    return rows.select(F.nullif("id", F.lit(NO_ID)).alias("id"), "th", "n",
                       F.nullif(F.coalesce("root", "id"), F.lit(NO_ID)).alias("component"),
                       (F.coalesce("root", "id") == F.col("id")).alias("kept"), "group")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (k, v, ...) of buckets k that hold several components, with theirs (g)."""
    here = (members.join(roots.select(F.col("u").alias("v"), "root").hint("shuffle_merge"), "v", "left")
            .withColumn("g", F.coalesce("root", "v")).drop("root"))
    several = group_apart(here, ["k"], F.min("g").alias("a"), F.max("g").alias("b")).where("a != b").select("k")
    return here.join(several.hint("shuffle_merge"), "k")


def _texts(nodes: DataFrame, source: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(v, _text) of the nodes ``v``, by id and text hash: missing or repeated ids cost nothing."""
    known, text = source
    keys = nodes.toDF("v").distinct().join(known.hint("shuffle_merge"), "v").select("v", F.col("v.id").alias("_id"), F.col("th").alias("_th"))
    return text.join(keys.hint("shuffle_merge"), ["_id", "_th"]).select("v", "_text").dropDuplicates(["v"])


def _alone(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(v, alone): how many shingles of the node's set no other of the nodes has; nodes
    without such shingles are left out."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 1 << 20):
            sets = [shingle_set(t, shingle) for t in column(b, "_text").to_pylist()]
            at = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
            h = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([column(b, "v").take(pa.array(at)), pa.array(h)], names=["v", "h"])

    met = nodes.join(texts.hint("shuffle_merge"), "v").select("v", "_text")
    return (met.mapInArrow(explode, f"v {NODE}, h bigint").groupBy("h").agg(F.min("v").alias("v"), F.count("*").alias("n"))
            .where("n = 1").groupBy("v").agg(F.count("*").alias("alone")))


def _differences(shingle: int):
    """Per (c, v): the shingles that one of the two sets has and the other lacks. Rows come sorted by c."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hc = None, None
        for b in slices(batches, "vt", 1 << 20):
            out = []
            for ct, vt in zip(column(b, "ct").to_pylist(), column(b, "vt").to_pylist()):
                if ct != last:
                    last, hc = ct, shingle_set(ct, shingle)
                out.append(np.setxor1d(hc, shingle_set(vt, shingle), assume_unique=True).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()),
                                             pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("c", "cn", "v", "n", "g")), lists], names=["c", "cn", "v", "n", "g", "d"])
    return run


def _apart(able: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (x, y) of different components in a bucket that may reach the threshold, by what their
    sets have otherwise than the bucket's centre (see the module's fifth step)."""
    t, whole = 100 - percent, 100 + percent             # linked: whole * |x ^ y| <= t * (|x| + |y|)
    both = able.select("c", "cn", "v", "n", "g").distinct()
    met = (both.join(texts.select(F.col("v"), F.col("_text").alias("vt")).hint("shuffle_merge"), "v")
           .join(texts.select(F.col("v").alias("c"), F.col("_text").alias("ct")).hint("shuffle_merge"), "c"))
    diffs = staged(met.select("c", "cn", "v", "n", "g", "vt", "ct").mapInArrow(
        _differences(shingle), f"c {NODE}, cn bigint, v {NODE}, n bigint, g {NODE}, d array<bigint>"), "differences")
    rows = diffs.select("c", "v", "g", F.explode("d").alias("e"))
    shared = group_apart(rows, ["c", "e"], F.count("*").alias("f"), F.min("g").alias("a"), F.max("g").alias("b")).where("a != b").select("c", "e", "f")
    kept = (rows.join(shared.hint("shuffle_merge"), ["c", "e"])
            .groupBy("c", "v").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("p")))       # at most two sets' shingles
    size = diffs.select("c", "cn", "v", "n", "g", F.size("d").alias("d"))
    # need: elements that the node must share with an unlinked one, at least one
    need = F.greatest(F.lit(1), F.ceil((whole * F.col("d") + t * (F.col("cn") - F.col("n"))) / (2.0 * whole) - 1e-9))
    ready = staged(kept.join(size.hint("shuffle_merge"), ["c", "v"]).withColumn("k", F.size("p") - need + 1), "shared")
    y = ready.where("k > 0").select("c", "v", "n", "g", "d", F.size("p").alias("s"), F.posexplode(F.slice("p", F.lit(1), F.col("k").cast("int"))).alias("i", "e")) \
        .select("c", "v", "n", "g", "d", (F.col("s") - F.col("i")).alias("s"), "e.e")
    x = ready.where(f"{whole} * d > {t} * (n + cn)").select(
        "c", F.col("v").alias("xv"), F.col("n").alias("xn"), F.col("g").alias("xg"), F.col("d").alias("xd"), F.size("p").alias("xs"), F.posexplode("p").alias("i", "e")) \
        .select("c", "xv", "xn", "xg", "xd", (F.col("xs") - F.col("i")).alias("xs"), "e.e")
    # s and xs: the elements from this one on. The first that a pair shares leaves enough of them
    pairs = (y.join(x.hint("shuffle_merge"), ["c", "e"]).where("g != xg")
             .where(f"100 * least(n, xn) >= {percent} * greatest(n, xn)")
             .where(f"{whole} * (d + xd - 2 * least(s, xs)) <= {t} * (n + xn)"))
    return pairs.select(F.least("v", "xv").alias("x"), F.greatest("v", "xv").alias("y")).distinct()


def _linked(pairs: DataFrame, sigs: DataFrame, source: tuple[DataFrame, DataFrame], shingle: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets reach the threshold."""
    pair = f"x {NODE}, y {NODE}"
    met = (pairs
           .join(sigs.select(F.col("v").alias("x"), F.col("sig").alias("xs")).hint("shuffle_merge"), "x")
           .join(sigs.select(F.col("v").alias("y"), F.col("sig").alias("ys")).hint("shuffle_merge"), "y"))
    likely = staged(met.select("x", "y", "xs", "ys").mapInArrow(_alike(percent), pair), "likely")
    if likely.isEmpty():
        return likely
    wanted = staged(_texts(likely.select("x").union(likely.select("y")), source), "texts")
    both = (likely.join(wanted.select(F.col("v").alias("y"), F.col("_text").alias("yt")).hint("shuffle_merge"), "y")
            .join(wanted.select(F.col("v").alias("x"), F.col("_text").alias("xt")).hint("shuffle_merge"), "x"))
    out = staged(both.select("x", "xt", "y", "yt").mapInArrow(_confirm(shingle, percent), pair).distinct(), "links")
    drop_staged(wanted)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of ``docs``: the smallest id (a missing one comes last), of its
    rows the smallest text hash, of equal (id, text) the smallest hash of the whole row. Texts
    without shingles have no group and stay."""
    groups = staged(near_duplicates(docs, id_col, text_col, shingle, percent).where("group is not null")
                    .groupBy("group", F.coalesce("id", F.lit(NO_ID)).alias("id"), "th").agg(F.count("*").alias("m")), "groups")
    first = group_apart(groups, ["group"], F.min(F.struct("id", "th")).alias("one"))
    rows = groups.join(first.hint("shuffle_merge"), "group").select(
        F.col("id").alias("_id"), F.col("th").alias("_th"), "m", (F.struct("id", "th") == F.col("one")).alias("one"))
    same = lambda keys: ((F.coalesce(docs[id_col], F.lit(NO_ID)) == keys["_id"])
                         & (F.xxhash64(docs[text_col]) == keys["_th"]))
    out = rows.where("not one or m > 1")
    several = staged(rows.where("one and m > 1").select("_id", "_th"), "several")
    kept = docs.join(out.hint("shuffle_merge"), same(out), "left_anti")
    if several.isEmpty():
        return kept
    row = F.struct(*[docs[c] for c in docs.columns])
    again = (docs.join(several.hint("shuffle_merge"), same(several), "left_semi")
             .groupBy(F.coalesce(docs[id_col], F.lit(NO_ID)).alias("_by"), F.xxhash64(docs[text_col]).alias("_th"))
             .agg(F.min_by(row, F.xxhash64(row)).alias("_row")))
    return kept.unionByName(again.select("_row.*"))


def near_dedup_digest(docs: DataFrame) -> DataFrame:
    g = near_duplicates(docs, shingle=4)
    return g.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.col("component").alias("component_id"), "kept")

"""SimHash, exact dedup and the ordered near-duplicate fold (incl. hot keys split over
many partitions), checked against brute-force sequential Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from jobmill.operators import dedup
from jobmill.operators.ranking import global_row_number


def py_simhash(text):
    t = re.sub(r"[^\w\s]", "", text.lower())
    words = re.sub(r"\s+", " ", t).strip().split()
    if not words:
        return 0
    v = [0] * 64
    for w in words:
        h = int(hashlib.md5(w.encode()).hexdigest(), 16)
        for i in range(64):
            v[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if v[i] > 0)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def py_fold(rows, max_d=9):
    """rows: (key, seq, fp) -> admitted set of seq."""
    state, out = {}, set()
    for key, seq, fp in sorted(rows):
        s = state.get(key)
        if s is None or bin((s ^ fp) & ((1 << 64) - 1)).count("1") > max_d:
            out.add(seq)
            state[key] = fp
    return out


TEXTS = ["Senior Python developer needed for backend systems",
         "Senior Python developer needed for backend system",
         "Looking for an experienced chef in Paris",
         "", "!!! ???", "Ünïcödé wörds and çà", "Python python PYTHON"]


def test_simhash_matches_bruteforce(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for method in ("arrow", "jvm"):
        got = {r["id"]: r["fingerprint"] for r in dedup.simhash(df, "text", ["id"], method=method).collect()}
        assert got == {i: signed(py_simhash(t)) for i, t in enumerate(TEXTS)}, method
    assert got[3] == 0 and got[4] == 0


def test_similar_vs_different_texts(spark):
    a, b, c = (py_simhash(t) for t in TEXTS[:3])
    sim = lambda x, y: 1 - bin(x ^ y).count("1") / 64
    assert sim(a, b) > 0.7 and sim(a, c) < 0.7


def test_exact_dedup_keeps_first(spark):
    rows = [("A", "lever", "1", 3), ("A", "lever", "1", 1), ("A", "lever", "2", 2),
            ("B", "lever", "1", 4), ("A", "greenhouse", "1", 5), ("B", "lever", "1", 0)]
    df = spark.createDataFrame(rows, "company string, source_system string, source_job_id string, seq long")
    got = sorted(r["seq"] for r in dedup.exact_dedup(df, "seq").collect())
    assert got == [0, 1, 2, 5]


def test_fold_boundary_9_vs_10(spark):
    base = 0
    rows = [("k", 1, base), ("k", 2, 0b111111111), ("k", 3, 0b1111111111), ("k", 4, 0b1111111111)]
    df = spark.createDataFrame(rows, "key string, seq long, fp long")
    out = dedup.near_dup_fold(df, "key", "seq", "fp", "seq")
    assert sorted(r["seq"] for r in out.filter("admitted").collect()) == [1, 3]


def test_fold_chain_compares_to_last_admitted(spark):
    # 1 admitted; 2 is 5 bits from 1 (dup); 3 is 10 bits from 1 (admitted); 4 is 5 from 3 (dup)
    f1, f3 = 0, (1 << 10) - 1
    rows = [("k", 1, f1), ("k", 2, (1 << 5) - 1), ("k", 3, f3), ("k", 4, f3 ^ 0b11111)]
    df = spark.createDataFrame(rows, "key string, seq long, fp long")
    out = dedup.near_dup_fold(df, "key", "seq", "fp", "seq")
    assert sorted(r["seq"] for r in out.filter("admitted").collect()) == [1, 3]


def test_fold_hot_key_split_across_partitions(spark):
    rnd = random.Random(7)
    rows = []
    seq = 0
    # one hot key (most rows) with runs of near-copies, plus small keys
    for key, n in (("hot", 3000), ("a", 40), ("b", 25)):
        cur = rnd.getrandbits(64)
        for _ in range(n):
            r = rnd.random()
            if r < 0.4:
                cur = rnd.getrandbits(64)                      # a new text
            elif r < 0.8:
                cur ^= 1 << rnd.randrange(64)                  # a near copy
            rows.append((key, seq, signed(cur)))
            seq += 1
    # also a long run of identical near-duplicates crossing partition boundaries
    same = rnd.getrandbits(64)
    for _ in range(800):
        rows.append(("hot", seq, signed(same ^ (1 << rnd.randrange(4)))))
        seq += 1
    df = spark.createDataFrame(rows, "key string, seq long, fp long")
    expected = py_fold([(k, s, f & ((1 << 64) - 1)) for k, s, f in rows])
    for parts in (1, 7, 23):
        out = dedup.near_dup_fold(df, "key", "seq", "fp", "seq", num_partitions=parts)
        got = {r["seq"] for r in out.filter("admitted").collect()}
        assert got == expected, parts


def test_global_row_number_with_skew(spark):
    rnd = random.Random(3)
    rows = [("big" if i % 10 else f"g{i % 7}", rnd.random(), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, score double, id long")
    out = global_row_number(df, [F.col("score").desc(), F.col("id")], ["g"], num_partitions=9)
    got = {r["id"]: r["rank"] for r in out.collect()}
    exp = {}
    for g in {r[0] for r in rows}:
        grp = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        exp.update({r[2]: i + 1 for i, r in enumerate(grp)})
    assert got == exp


def test_fold_incremental_state_equals_one_run(spark):
    rnd = random.Random(11)
    rows, cur = [], 0
    for seq in range(600):
        key = "h" if seq % 3 else "k"
        cur = rnd.getrandbits(64) if rnd.random() < 0.5 else cur ^ (1 << rnd.randrange(64))
        rows.append((key, seq, signed(cur)))
    df = spark.createDataFrame(rows, "key string, seq long, fp long")
    whole = {r["seq"] for r in dedup.near_dup_fold(df, "key", "seq", "fp", "seq", num_partitions=5)
             .filter("admitted").collect()}
    first, second = df.filter("seq < 300"), df.filter("seq >= 300")
    f1 = dedup.near_dup_fold(first, "key", "seq", "fp", "seq", num_partitions=3).join(first.select("seq"), "seq")
    state = dedup.last_admitted(f1, "key", "fp", "seq")
    f2 = dedup.near_dup_fold(second, "key", "seq", "fp", "seq", num_partitions=4, initial=state)
    got = {r["seq"] for r in f1.filter("admitted").collect()} | \
          {r["seq"] for r in f2.filter("admitted").collect()}
    assert got == whole


@pytest.mark.parametrize("parts", [23, 96, 400])
def test_fold_identity_chain_resolves_in_few_rounds(spark, parts):
    rnd = random.Random(5)
    first = rnd.getrandbits(64)
    rows = [("hot", i, signed(first ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))) for i in range(5000)]
    rows[0] = ("hot", 0, signed(first))
    df = spark.createDataFrame(rows, "key string, seq long, fp long")
    out = dedup.near_dup_fold(df, "key", "seq", "fp", "seq", num_partitions=parts, max_rounds=2)
    got = {r["seq"] for r in out.filter("admitted").collect()}
    assert got == py_fold([(k, s, f & ((1 << 64) - 1)) for k, s, f in rows])


@pytest.mark.parametrize("kind", ["far", "near", "both", "carried"])
def test_fold_composes_summaries_without_a_further_pass(spark, kind):
    """Unlike neighbours, near copies, and families of near copies that are far apart: the
    summaries tell every entry state, with a state from an earlier run too."""
    rnd = random.Random(6)
    base, hs = rnd.getrandbits(64), []
    for i in range(2000):
        if kind == "far" or kind != "near" and i % 90 == 0:
            base = rnd.getrandbits(64)
        hs.append(signed(base ^ (0 if kind == "far" else 1 << rnd.randrange(64))))
    df = spark.createDataFrame([("k", i, h) for i, h in enumerate(hs)] + [("other", 3, 5)], "key string, seq long, fp long")
    state = hs[0] ^ 3 if kind == "carried" else None
    init = spark.createDataFrame([("k", state)], "key string, fp long") if state is not None else None
    out = dedup.near_dup_fold(df, "key", "seq", "fp", "seq", num_partitions=60, max_rounds=0, initial=init)
    got = {r["seq"]: r["admitted"] for r in out.where("key = 'k'").collect()}
    want, _ = dedup._fold(np.array(hs), state, 9)
    assert [got[i] for i in range(len(hs))] == want.tolist()


def test_segment_tells_only_what_holds():
    """``_Segment.out`` against a fold of the rows, over all ways in; and the plain rule itself."""
    rnd, told = random.Random(8), 0
    for _ in range(400):
        bits, max_d = 12, rnd.randrange(1, 4)
        base, spread = rnd.getrandbits(bits), rnd.randrange(1, 6)
        hs = [base ^ sum(1 << b for b in rnd.sample(range(bits), rnd.randrange(spread))) for _ in range(rnd.randrange(1, 12))]
        plain, s = [], None
        for h in hs:
            plain.append(s is None or (s ^ h).bit_count() > max_d)
            s = h if plain[-1] else s
        flags, final = dedup._fold(np.array(hs), None, max_d)
        assert flags.tolist() == plain and final == s
        far = any((a ^ b).bit_count() > 2 * max_d for a, b in zip(hs, hs[1:]))
        seg = dedup._Segment(hs[0], max((h ^ hs[0]).bit_count() for h in hs), final, far, max_d)
        for _ in range(40):
            s = base ^ sum(1 << b for b in rnd.sample(range(bits), rnd.randrange(spread + 2)))
            t = seg.out(s)
            told += t is not None
            assert t is None or t == dedup._fold(np.array(hs), s, max_d)[1]
    assert told > 5000


def test_fold_streams_runs_across_arrow_batches(spark):
    rnd = random.Random(9)
    rows, cur = [], 0
    for seq in range(1500):
        key = ("a", "b", "c")[min(2, seq // 600)]
        cur = rnd.getrandbits(64) if rnd.random() < 0.3 else cur ^ (1 << rnd.randrange(64))
        rows.append((key, seq, signed(cur)))
    df = spark.createDataFrame(rows, "key string, seq long, fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = dedup.near_dup_fold(df, "key", "seq", "fp", "seq", num_partitions=4)
        got = {r["seq"] for r in out.filter("admitted").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == py_fold([(k, s, f & ((1 << 64) - 1)) for k, s, f in rows])


@pytest.mark.parametrize("parts", [4, 24, 96])
@pytest.mark.parametrize("flips", [None, 3, 9])
def test_fold_rounds_do_not_grow_with_the_segments(spark, parts, flips):
    """One hot key of random fingerprints, far apart or so near that what a segment admits
    hangs on the state carried in: far fewer rounds than segments, and three in the usual case."""
    rng = random.Random(parts)
    base = rng.getrandbits(62)
    hs = [rng.getrandbits(62) if flips is None else base ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(flips)))
          for _ in range(1500)]
    df = spark.createDataFrame([("k", i, h) for i, h in enumerate(hs)], "key string, seq long, fp long")
    out = dedup.near_dup_fold(df, "key", "seq", "fp", "seq", num_partitions=parts, max_rounds=3 if flips is None else 4 + parts // 4)
    got = {r["seq"]: r["admitted"] for r in out.collect()}
    want, _ = dedup._fold(np.array(hs), None, dedup.max_hamming_for(dedup.NEAR_DUP_SIMILARITY))
    assert [got[i] for i in range(len(hs))] == want.tolist()

"""Line, string and near-duplicate removal, quality rules and decontamination against brute force."""

import random

import pytest

from jobmill.llm import decontaminate, line_dedup, minhash, quality_rules, suffix_dedup

from . import brute

DOCS = "doc_id bigint, text string, lang string, n_chars bigint"


def make(spark, rows, schema="doc_id bigint, text string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def same(df, expected, key=lambda r: tuple((x is None, x) for x in r)):
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(expected, key=key)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def family():
    """Copies, near copies by degrees, a common passage, short and odd texts."""
    rng = random.Random(4)
    base, passage = prose(rng, 150).split(), prose(rng, 90)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base).upper())]
    for i in range(4, 40):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    for i in range(40, 60):
        rows.append((i, f"{prose(rng, 12, 10 ** 6)}\n{passage}\n{prose(rng, rng.randrange(5, 40), 10 ** 6)}"))
    rows += [(60, None), (61, ""), (62, " \t\n"), (63, "one"), (64, "ONE"), (65, "one two three"), (66, "é" * 700), (67, "é" * 700)]
    rows += [(i, prose(rng, 60)) for i in range(68, 90)]
    rows.append((90, "ab" * 900 + "\n" + "-" * 500))
    return rows


def test_line_dedup(spark, family):
    extra = [(100, "  A long common line \nshort\n\nown"), (101, "a LONG common line\nshort"), (102, "A long common line\t\na long common line"),
             (103, "\n\n")]
    rows = family + extra
    same(line_dedup.line_dedup_digest(make(spark, rows)), brute.line_dedup(rows))


def test_line_dedup_keeps_columns_and_rows(spark):
    docs = make(spark, [(2, "the same long line", "n_dropped?", 7), (1, "The same long line", None, None), (None, "the same long line", "x", 1),
                        (2, "the same long line", "n_dropped?", 7)],
                "doc_id bigint, text string, n_dropped string, _pos bigint")
    out = {(r["doc_id"], r["text"], r["_pos"], r["n_dropped"]) for r in line_dedup.line_dedup(docs).collect()}
    assert out == {(2, "", 7, 1), (1, "The same long line", None, 0), (None, "", 1, 1)}
    three = make(spark, [(1, "a line of three"), (2, "a line of three"), (3, "another line here"), (4, "another line here"), (5, "another line here")])
    kept = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(three, min_docs=3).collect()}
    assert kept == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_repeated_strings(spark, family):
    rng = random.Random(5)
    long = prose(rng, 400)
    rows = family + [(200, long), (201, prose(rng, 30) + long[37:1500] + prose(rng, 90)), (202, long[600:1010]), (203, long[600:1000]),
                     (204, long[600:999]), (205, long + long[5:500])]
    same(suffix_dedup.repeated_strings_digest(make(spark, rows)), brute.repeated_strings(rows))


def test_repeated_strings_in_long_texts(spark, monkeypatch):
    """Texts over a segment are cut into ranges of starts with the same result."""
    rng = random.Random(6)
    a = prose(rng, 2500, 10 ** 6)
    rows = [(1, a), (2, a[3000:9000] + prose(rng, 800, 10 ** 6)), (3, "z" * 5000)]
    raws = [(i, 0, t.encode()) for i, t in rows]
    whole = {(d, s + o) for raw, where in suffix_dedup._parts(iter(raws), 400) for d, _, o, s, n in where for s in range(n)}
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 3000)
    cut = [(d, s + o) for raw, where in suffix_dedup._parts(iter(raws), 400) for d, _, o, s, n in where for s in range(n)]
    assert set(cut) == whole and len(cut) == len(whole)
    same(suffix_dedup.repeated_strings_digest(make(spark, rows)), brute.repeated_strings(rows))


@pytest.mark.parametrize("segment", [97, 700, 1501])
def test_a_cut_text_keeps_its_unique_bytes(spark, segment):
    """A run of starts over a segment's end is one run, whatever the segment."""
    rng = random.Random(61)
    a = prose(rng, 900, 10 ** 6)
    rows = [(1, a), (2, a[2000:4100] + prose(rng, 500, 10 ** 6)), (3, prose(rng, 700, 10 ** 6)), (4, "z" * 3000), (5, "short")]
    got = suffix_dedup.repeated_strings(make(spark, rows), segment=segment)
    out = [(r["id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["spans"]), len(r["spans"]), brute.sha(bytes(r["kept"]))) for r in got.collect()]
    assert sorted(out) == sorted(brute.repeated_strings(rows))
    assert dict((r[0], r[2]) for r in out)[3] == 0


@pytest.mark.parametrize("k", [4, 5])
def test_near_groups(spark, family, k):
    got = minhash.near_duplicates(make(spark, family), shingle=k).select("id", "n", "component", "kept")
    same(got, brute.near_groups(family, k))


def test_near_groups_beyond_the_first_star(spark):
    """Members that do not resemble the smallest id, but each other."""
    rng = random.Random(8)
    base = prose(rng, 120, 10 ** 6).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4, 8)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    same(minhash.near_duplicates(make(spark, rows), shingle=4).select("id", "n", "component", "kept"), brute.near_groups(rows, 4))


def test_near_dedup_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = make(spark, [(7, text, "a", 1), (5, text, "b", 2), (5, "another text altogether here", "c", 3), (None, text, "d", 4), (9, None, None, None)],
                "doc_id bigint, text string, kept string, id bigint")
    got = {(r["doc_id"], r["kept"]) for r in minhash.near_dedup(docs).collect()}
    assert got == {(5, "b"), (5, "c"), (9, None)}


def test_near_dedup_keeps_one_row_of_a_group(spark):
    """Rows that repeat an id, and groups without any id."""
    one, two = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(3, one, "x"), (3, one, "y"), (3, one, "x"), (3, one + " end", "z"), (4, one, "w"), (None, one, "v"),
            (None, two, "u"), (None, two, "u"), (None, two + " end", "t"), (None, None, "s"), (None, None, "s"), (8, "", "r")]
    got = [tuple(r) for r in minhash.near_dedup(make(spark, rows, "doc_id bigint, text string, source string")).collect()]
    assert len([r for r in got if r[0] == 3]) == 1 and len([r for r in got if r[0] is None and r[1]]) == 1
    assert sorted((r[0] or 0, r[2]) for r in got if not r[1]) == [(0, "s"), (0, "s"), (8, "r")] and len(got) == 5


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    a = minhash.shingle_set(" ".join(words), 4)
    for edits in (0, 5, 30):
        w = list(words)
        for i in rng.sample(range(500), edits):
            w[i] = f"z{i}"
        b = minhash.shingle_set(" ".join(w), 4)
        x, y = minhash.signatures([a, b])
        j = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((x == y).mean() - j) < 0.2
    few = minhash.signatures([a[:1], a[:3], a[:0]])
    assert len(set(few[0].tolist())) == 1 and len(set(few[1].tolist())) <= 3 and not few[2].any()


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (101, 99)]
    df = spark.createDataFrame([((a, 0), (b, 0)) for a, b in edges], f"x {minhash.NODE}, y {minhash.NODE}")
    got = {r["u"]["id"]: r["root"]["id"] for r in minhash.connected(df).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 99, 101: 99}


def test_quality_counts(spark, family):
    rows = family + [(300, "a b c a b c x " * 30), (301, "Same line here.\nSame line here.\n\n \nOther | * <"), (302, "a b a b a b")]
    out = quality_rules.quality_rules_digest(make(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                                      "n_repeat_words", "base_failed")
    same(out, [(i, *brute.word_counts(t)) for i, t in rows])


def test_quality_verdict(spark):
    rng = random.Random(2)
    clean = "\n".join(" ".join(f"word{rng.randrange(10 ** 5)}" for _ in range(12)) + "." for _ in range(10))
    junk = {"symbols": "\n".join(" ".join(f"w{rng.randrange(10 ** 5)}###" for _ in range(12)) for _ in range(10)),
            "menu": "\n".join(" | ".join(f"w{rng.randrange(10 ** 5)}" for _ in range(12)) for _ in range(10)),
            "shouts": "\n".join(" ".join(f"WORD{rng.randrange(10 ** 5)}!!" for _ in range(12)) for _ in range(10))}
    docs = make(spark, [(1, clean, 0), (2, clean + "\n" + junk["menu"][:60], 0)] + [(10 + i, t, 0) for i, t in enumerate(junk.values())],
                "doc_id bigint, text string, kept int")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert {i for i, r in got.items() if r["kept"]} == {1, 2}
    assert got[1]["text"] == clean and got[2]["text"] == clean and got[2]["n_failed_lines"] == 1
    assert got[10]["text"] == "" and got[10]["lost_chars"] == got[10]["word_chars"]


def items_and_docs():
    rng = random.Random(3)
    item = prose(rng, 30, 10 ** 6)
    items = [(1, item), (2, item), (3, "just five words of text"), (4, None), (5, ""), (6, prose(rng, 13, 10 ** 6)), (10, "the the the the")]
    w = item.split()
    docs = [(1, " ".join(w[3:20])), (2, f"{prose(rng, 400)} {' '.join(w[3:16]).upper()}, {prose(rng, 10)}"), (3, " ".join(w[3:15])),
            (4, "So: Just-five words; OF text, just five words"), (5, None), (6, ""), (7, "the " * 9), (8, prose(rng, 200)),
            (9, " ".join(w[:13]) + " x " + " ".join(w[13:26]) + " " + " ".join(w[20:30]))]
    return items, docs


def test_contamination(spark):
    items, docs = items_and_docs()
    d, b = make(spark, docs), make(spark, items, "item_id bigint, text string", 1)
    same(decontaminate.contamination_digest(d, b), brute.contamination(docs, items))
    # several chunks of items, and no items
    one = decontaminate.find_contamination(d, b).select("doc_id", "n_hit", "hit_items").collect()
    many = decontaminate.find_contamination(d, b, chunk_words=20).select("doc_id", "n_hit", "hit_items").collect()
    assert sorted(one) == sorted(many)
    none = decontaminate.find_contamination(d, b.limit(0))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(docs)


def test_decontaminated_texts(spark):
    items, docs = items_and_docs()
    d = make(spark, [(i, t, "y") for i, t in docs], "doc_id bigint, text string, contaminated string")
    b = make(spark, items, "item_id bigint, text string", 1)
    out = {r["doc_id"]: r for r in decontaminate.decontaminate(d, b).collect()}
    assert set(out) == {i for i, *_, bad in brute.contamination(docs, items) if not bad}
    texts = dict(docs)
    assert out[8]["text"] == texts[8] and out[5]["text"] is None and out[8]["contaminated"] == "y"
    head, tail = texts[2].split(" ".join(items[0][1].split()[3:16]).upper())
    assert out[2]["text"] == head + tail


@pytest.mark.parametrize("run", [
    lambda d: line_dedup.line_dedup_digest(d), lambda d: suffix_dedup.repeated_strings_digest(d),
    lambda d: minhash.near_dedup_digest(d), lambda d: quality_rules.quality_rules_digest(d),
    lambda d: decontaminate.contamination_digest(d, d.selectExpr("doc_id as item_id", "text")), lambda d: minhash.near_dedup(d)])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def test_family_of_near_copies_beyond_its_centre(spark):
    """Members that miss the centre but reach each other: edits at random places, shared edits,
    chains of edits, and unlike texts that hold the family's passage."""
    rng = random.Random(21)
    base = prose(rng, 130).split()
    rows, last = [(1, " ".join(base))], base
    edits = [(rng.randrange(130), f"e{k}") for k in range(12)]
    for i in range(2, 150):
        w = list(last if i % 7 == 0 else base)
        for at, new in (rng.sample(edits, rng.randrange(2, 7)) if i % 3 == 0 else ()):
            w[at] = new
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(w))
            w[at:at + 1] = rng.choice([[f"n{rng.randrange(10 ** 6)}"], [], [w[at], f"n{rng.randrange(10 ** 6)}"]])
        last = w
        rows.append((i, " ".join(w)))
    rows += [(i, prose(rng, 60, 10 ** 6) + " " + " ".join(base[20:90])) for i in range(150, 190)]
    want = brute.near_groups(rows, 4)
    assert 20 < sum(r[-1] for r in want) < 150
    same(minhash.near_duplicates(make(spark, rows), shingle=4).select("id", "n", "component", "kept"), want)


def test_many_rows_without_an_id(spark):
    """Texts are found by id and text hash: a thousand null ids do not meet each other."""
    rng = random.Random(22)
    texts = [prose(rng, 40, 3000) for _ in range(300)]
    near = [" ".join(t.split()[:-1] + ["z"]) for t in texts[:100]]
    rows = [(None, t) for t in texts + texts + near + near + texts] + [(7, texts[0]), (7, texts[1]), (8, near[2])]
    out = minhash.near_duplicates(make(spark, rows), shingle=4).collect()
    named = {r["component"] for r in out}
    assert len(out) == len(rows) and named == {7, 8, None}
    assert sum(r["component"] is not None for r in out) == 5 + 5 + 5 + 3
    assert len({r["group"] for r in out}) == 300
    kept = minhash.near_dedup(make(spark, rows), shingle=4).collect()
    assert len(kept) == 300


def test_items_without_an_id_and_kept_automata(spark):
    rng = random.Random(23)
    passage = prose(rng, 20, 10 ** 6)
    items = make(spark, [(None, passage), ("b", passage), ("c", prose(rng, 15, 10 ** 6)), (None, None)], "item_id string, text string")
    docs = make(spark, [(1, f"x {passage} y"), (2, "clean words only")])
    got = {r["doc_id"]: (list(r["hit_items"]), r["n_hit"]) for r in decontaminate.find_contamination(docs, items).collect()}
    assert got == {1: (["", "b"], 20), 2: ([], 0)}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [2]
    long = make(spark, [(1, f"{prose(rng, 900)} {passage}. {prose(rng, 30)}"), (3, None)])
    (kept,) = [r for r in decontaminate.decontaminate(long, items).collect() if r["doc_id"] == 1]
    assert passage.split()[3] not in kept["text"].split() and ". " in kept["text"]
    made = [decontaminate._automaton(n, type("B", (), {"value": [("i", [b"a"] * 14)]}), 13) for n in "aabca"]
    assert made[0] is made[1] and made[0] is not made[4] and len(decontaminate._BUILT) == 2
    decontaminate._BUILT.clear()

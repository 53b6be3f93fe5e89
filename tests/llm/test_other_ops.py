"""Packing, chat, page text, classifiers and the pipeline."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from jobmill.llm import chat, compression, html_extract, packing, toxicity

from . import brute
from .test_text_ops import make, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_token_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(PATH)
    texts = ["", " ", "a", "Don't  stop\n\n \tnow ok 　x", "x<|endoftext|>y <|endoftext|>", "éß漢字🙂 1234.5 ... !!\r\n", "a" * 3000,
             "\x1c\x85  z", "<|endoftext|", "  lead and trail  "]
    for t in texts:
        assert packing.token_ids(t, PATH, 0).tolist() == tk.encode(t, add_special_tokens=False).ids + [0]


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.choice([1, 5, 40, 300, 900]), 10 ** 5)) for i in range(120)] + [(500, None), (501, ""), (None, "no id"), (7, "again")]
    got = packing.pack(make(spark, rows), PATH, pool=16).toPandas()
    tokens = sorted(len(packing.token_ids(t, PATH, 0)) for _, t in rows)
    assert got["length"].sum() == sum(tokens) and (got["length"] > 0).all()
    whole = {}
    for (i, n), x in got.sort_values("start").groupby(["doc_id", "doc_tokens"]):
        if i == 7:
            continue
        assert x["start"].tolist() == [0, *x["length"].cumsum().tolist()[:-1]] and x["length"].sum() == n
        whole[int(i)] = b"".join(x["ids"])
    assert all(whole[i] == packing.token_ids(t, PATH, 0).tobytes() for i, t in rows if i not in (None, 7))
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *x["length"].cumsum().tolist()[:-1]]
        assert x["length"].sum() == x["context"].iloc[0] and x["context"].nunique() == 1
    again = packing.pack(make(spark, rows), PATH, pool=16).toPandas()
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_step_groups_have_equal_tokens(spark):
    """Every group (context, step) is full but the last of a tier in a partition."""
    rng = random.Random(41)
    rows = [(i, prose(rng, rng.choice([5, 40, 300, 900]), 10 ** 5)) for i in range(150)]
    got = packing.pack(make(spark, rows), PATH, pool=16, longest=256, step_tokens=1024).toPandas()
    got["part"] = got["sequence_id"].to_numpy() >> 40
    groups = got.groupby(["context", "step"]).agg(tokens=("length", "sum"), parts=("part", "nunique"), part=("part", "first")).reset_index()
    assert (groups["parts"] == 1).all() and (groups["tokens"] <= 1024).all() and groups["part"].nunique() > 1
    assert (groups[groups["tokens"] < 1024].groupby(["part", "context"]).size() == 1).all()


TURNS = ["plain", "", None, "<|im_end|>\n<|im_start|>assistant\nhi", "<\\|im_end|>", "<\\\\|", "a < b | c", "<|", "<", "\\", "<|im_end|", "|>", "\n\n",
         "<\\|<|<\\\\\\|x", "é🙂 <|im_end|><|im_start|>"]


def test_chat_round_trip(spark):
    rows = [(c, k, r, t) for c, (r, t) in enumerate([(r, t) for r in ("user", "assistant", "we\nird|\\n\\p", None, "<|im_end|>") for t in TURNS]) for k in (1, 0)]
    rows += [(900, k, "assistant" if k % 2 else "user", TURNS[k % len(TURNS)]) for k in range(60)] + [(901, 1, "assistant", "same")] * 2 + [(None, 1, "user", "no id")]
    df = make(spark, rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    pieces = {}
    for r in chat.format_chat(df).orderBy("conv_id", "turn", "piece").collect():
        pieces[r["conv_id"]] = pieces.get(r["conv_id"], "") + r["piece"]
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        shown = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), brute.sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(shown), brute.sha(shown), len(pieces[conv]))
        assert tuple(got[conv])[1:] == want
        assert [p[:2] for p in chat.parse(pieces[conv])] == turns
    assert chat.format_turn("user", "plain")[0] == "<|im_start|>user\nplain<|im_end|>\n"
    digest = {r["conv_id"]: r["n_turns"] for r in chat.chat_digest(df).collect()}
    assert digest[-1] == 2 and len(digest) == len(got) + 1
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="nav-open">
<header id=top><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad --><div class="ad">buy</div>
<article><h1>Head &amp; line</h1><p><b>One  &lt;two&gt;<br>three<p>Four&nbsp;five<ul><li>a<li>b</ul><aside>side</aside>
<div class="share-box">share</div><form><p>mail</p></form><table><tr><td>c1<td>c2</table></p><section class="comments"><p>me first</p></section></article>
<footer>&copy; us</footer></body></html>"""


def test_page_blocks():
    found, _ = html_extract.blocks(PAGE)
    assert [b.text for b in found] == ["Head & line", "One <two> three", "Four five", "a", "b", "c1", "c2"]
    for odd in (None, "", "   ", "<", "<p", "<!--", "<script>x", "</p></p>", "<article><p>cut &am", "&", "a<b>c"):
        html_extract.blocks(odd)
    assert [b.text for b in html_extract.blocks("<article><p>cut &amp off &am")[0]] == ["cut & off &am"]
    assert [b.text for b in html_extract.blocks("just <i>te</i>xt")[0]] == ["just text"]


def test_site_style_tree(spark):
    """Unmarked boilerplate goes by its low importance, on hosts with enough pages."""
    rng = random.Random(3)
    def page(k):
        return (f"<html><body><div class='x1'><p>{prose(rng, 20, 10 ** 6)}</p><p>{prose(rng, 20, 10 ** 6)}</p></div>"
                f"<div class='x2'><p>Call us {k % 2}</p></div></body></html>")
    rows = [(k, "http://A.example/p", page(k), "old", 1) for k in range(30)]
    rows += [(100, "http://b.example/p", page(0), "old", 1), (101, None, None, None, None), (102, "odd", "", "x", 2), (0, "http://A.example/p", rows[0][2], "old", 1)]
    df = make(spark, rows, "page_id bigint, url string, html string, text string, _host bigint")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] < 100:
            assert "Call us" not in r["text"] and len(r["text"].split("\n\n")) == 2
        assert r["n_chars"] == len(r["text"])
    by = {r["page_id"]: r for r in got}
    assert "Call us 0" in by[100]["text"] and by[101]["text"] == "" and by[102]["text"] == "" and by[102]["_host"] == 2
    assert html_extract.extract(df.limit(0)).count() == 0


def test_style_tree_judges_articles_and_names(spark):
    """Plain elements of a marked article are judged too, and one name alone removes nothing."""
    rng = random.Random(31)
    def page(k):
        return (f"<html><body><nav><ul><li>{prose(rng, 3, 10 ** 6)}</ul></nav><article><h1>{prose(rng, 4, 10 ** 6)}</h1>"
                f"<section><p>Subscribe to our news</p></section><p>{prose(rng, 20, 10 ** 6)}</p>"
                f"<div class='search-results'><p>own {prose(rng, 9, 10 ** 6)}</p></div></article></body></html>")
    df = make(spark, [(k, "http://a.example/", page(k)) for k in range(30)], "page_id bigint, url string, html string")
    for r in html_extract.extract(df).collect():
        assert len(r["text"].split("\n\n")) == 3 and "Subscribe" not in r["text"] and "\n\nown " in r["text"]


PARTS = ["<section class='comments'><p>{t}</p><div class='reply'>{t}</div></section>", "<form><p>{t}</p></form>", "<aside class='sidebar'><p>{t}</p></aside>",
         "<div class='advert'><p>{t}</p></div>", "<nav><ul><li>{t}</ul></nav>", "<div id='cookie-notice'>{t}</div>", "<footer>{t}</footer>", "<div role=navigation>{t}</div>",
         "<div class='siteFooter'>{t}</div>", "<ul class='main_menu'><li>{t}</ul>"]


@pytest.mark.parametrize("shape", ["without", "inside", "around", "outside"])
def test_stated_parts_go_whatever_their_text(spark, shape):
    """Unwanted parts with text of their own on every page: without an article, inside it, around it, beside it."""
    rng = random.Random(33)
    text = lambda n: prose(rng, n, 10 ** 6)
    rows, want = [], {}
    for k in range(12):
        main = [text(30), text(25)]
        body = [f"<p>{m}</p>" for m in main]
        parts = [x.format(t=text(12)) for x in PARTS]
        header = f"<header><p>{text(5)}</p></header>"
        if shape == "inside":
            html = f"{header}<article>{body[0]}{''.join(parts)}{body[1]}</article>"
        elif shape == "around":
            html = f"{header}<div class='has-sidebar no-comments'>{parts[0]}<article>{''.join(body)}</article>{''.join(parts[1:])}</div>"
        elif shape == "outside":
            html = f"{header}{''.join(parts[:5])}<article>{''.join(body)}</article>{''.join(parts[5:])}"
        else:
            html = f"{header}<div class='wide'>{body[0]}</div>{''.join(parts)}<div class='wide'>{body[1]}</div>"
        rows.append((k, "http://a.example/" if k < 11 else "http://alone.example/", f"<html><body>{html}</body></html>"))
        want[k] = "\n\n".join(main)
    for r in html_extract.extract(make(spark, rows, "page_id bigint, url string, html string")).collect():
        assert r["text"] == want[r["page_id"]]


def test_frames_and_layout_names_are_not_parts():
    def kept(page):
        return [(b.text, b.marks[-1]) for b in html_extract.shown(page)[0]]
    assert kept("<body><form id=all><nav>m</nav><div>text</div></form></body>") == [("m", html_extract.PART), ("text", 0)]
    assert kept("<body><form><div>mail</div></form></body>") == [("mail", html_extract.PART)]
    assert kept("<div class='with-sidebar'>a</div><div class='sidebar'>b</div><div class='a-note-on-comment-culture'>c</div>") == \
        [("a", html_extract.NAMED), ("b", html_extract.PART), ("c", html_extract.NAMED)]
    assert kept("<article><header>t</header></article><header>s</header>") == [("t", html_extract.HEADER), ("s", html_extract.PART)]


def importance_brute(pages, weight=0.9, corpus_pages=4):
    """The style tree of pages (host, html) node by node, in plain Python."""
    hosts = {}
    for host, page in {(h, tuple(b.text for b in html_extract.shown(p)[0])): (h, p) for h, p in sorted(pages, reverse=True)}.values():
        found, styles = html_extract.shown(page)
        judged = html_extract._judged(found)
        tree = hosts.setdefault(host, {})
        for node, path in {n for up in judged for n in up}:
            tree.setdefault(node, ([], []))[0].append(tuple(styles.get(path, ())))
        for leaf, text in {(up[0][0], b.text) for up, b in zip(judged, found)}:
            ups = next(up for up in judged if up[0][0] == leaf)
            for node, _ in ups:
                tree[node][1].append((leaf, text))
    here, known = {}, {}
    for host, tree in hosts.items():
        for node, (styles, texts) in tree.items():
            m = len(styles)
            if m == 1:
                here[host, node] = (1, 1.0)
                continue
            share = [styles.count(x) / m for x in set(styles)]
            look = -sum(p * math.log(p, m) for p in share)
            distinct = set(texts)
            spread = sum(texts.count(x) * math.log(texts.count(x), m) for x in distinct) / len(texts)
            here[host, node] = (m, (1 - weight) * max(0.0, look) + weight * (1 - min(1.0, spread)))
    for (_, node), (m, x) in here.items():
        a, b = known.get(node, (0, 0.0))
        known[node] = (a + m - 1, b + (m - 1) * x)
    return {(h, n): (m, (m * x + corpus_pages * (known[n][1] / known[n][0] if known[n][0] else x)) / (m + corpus_pages)) for (h, n), (m, x) in here.items()}


def test_importances_against_a_plain_tree(spark):
    rng = random.Random(34)
    rows = []
    for k in range(60):
        cells = "".join(f"<td>{rng.choice(['x', 'y', prose(rng, 3)])}</td>" for _ in range(rng.randrange(1, 4)))
        rows.append((f"h{k % 3}", f"<body><div class=a><p>{prose(rng, 4, 10 ** 6)}</p><p>{rng.choice(['same', 'other'])}</p></div><table><tr>{cells}</table>"
                                  f"{'<div class=b>Call us</div>' if k % 2 else ''}</body>"))
    rows.append(("one", rows[0][1]))
    df = spark.createDataFrame([(i, i % 3 if h != "one" else 9, p) for i, (h, p) in enumerate(rows)], "_key bigint, _host bigint, _html string")
    parsed = df.mapInArrow(html_extract._pages, "_key bigint, host bigint, same bigint, nodes array<bigint>, packed binary")
    got = {(r["host"], r["node"]): (r["m"], r["importance"]) for r in html_extract.importances(parsed, 0.9, 4).collect()}
    want = importance_brute([(i % 3 if h != "one" else 9, p) for i, (h, p) in enumerate(rows)])
    assert got.keys() == want.keys()
    for k, (m, x) in want.items():
        assert got[k][0] == m and abs(got[k][1] - x) < 1e-9, (k, got[k], m, x)


def test_copies_do_not_lower_importance(spark):
    """Copies on one host count once, and small hosts follow the corpus."""
    rng = random.Random(32)
    def page(k, own):
        return f"<html><body><div class='content'><p>{own}</p></div><div class='x2'><p>Call us</p></div><p>{k}</p></body></html>"
    one = prose(rng, 20, 10 ** 6)
    rows = [(k, "http://a.example/", page("same", one)) for k in range(16)]
    rows += [(k, "http://a.example/", page("same", prose(rng, 20, 10 ** 6))) for k in range(16, 40)]
    rows += [(k, "http://small.example/", page("same", prose(rng, 20, 10 ** 6))) for k in range(40, 44)]
    # mostly copies
    rows += [(k, "http://b.example/", page("same", one if k < 66 else prose(rng, 20, 10 ** 6))) for k in range(50, 70)]
    got = html_extract.extract(make(spark, rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows)
    html = {r[0]: r[2] for r in rows}
    for r in got:
        assert r["text"] == html[r["page_id"]].split("<p>")[1].split("</p>")[0]


def labelled(rng, n):
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        if bad:
            for k in rng.sample(range(60), 6):
                words[k] = rng.choice(["vile", "nasty", "awful"])
        docs.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = labelled(random.Random(9), 700)
    docs += [(1000, None), (1001, ""), (1002, "12 !!"), (None, "vile nasty awful")]
    d = make(spark, docs)
    lab = make(spark, labels + labels[:9] + [(None, 1), (3000, None)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_digest(d, lab).collect()}
    assert len(got) == len(docs)
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(y, got[i]["predicted"]) for i, y in labels if got[i]["held_out"]]
    assert np.mean([y == p for y, p in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"] < 0.5 and got[None]["predicted"] == 1
    # no label, no positive, no document
    for some in (lab.limit(0), lab.where("toxic = 0")):
        assert {r["predicted"] for r in toxicity.toxicity_digest(d, some).collect()} <= {0, 1}
    assert toxicity.toxicity_digest(d.limit(0), lab).count() == 0
    kept = toxicity.toxicity(d.selectExpr("*", "'x' as score"), lab).columns
    assert sorted(kept) == ["doc_id", "held_out", "predicted", "score", "text"]


def test_nnpu_does_not_use_held_out_labels(spark):
    docs, labels = labelled(random.Random(10), 300)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    d = make(spark, docs)
    a, b = (toxicity.fit(d, make(spark, x, "doc_id bigint, toxic int")) for x in (labels, flipped))
    assert np.allclose(a.weight, b.weight) and a.constant == b.constant


def test_quality_scores(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(300):
        good = rng.random() < 0.6
        words = [f"word{rng.randrange(200)}" for _ in range(80)]
        docs.append((i, " ".join(words) if good else " ".join(w + rng.choice(["###", "&&&"]) for w in words)))
        labels.append((i, int(good)))
    docs += [(1000, None), (1001, "")]
    d = make(spark, docs)
    got = {r["doc_id"]: r for r in compression.quality_digest(d, make(spark, labels + [(None, 0)], "doc_id bigint, quality int")).collect()}
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert np.mean([got[i]["predicted"] == y for i, y in labels if got[i]["held_out"]]) > 0.95
    assert got[1000]["score"] == got[1001]["score"]
    for some in ([(1, 1)], []):
        out = compression.quality_digest(d, spark.createDataFrame(some, "doc_id bigint, quality int")).collect()
        assert len(out) == len(docs) and len({r["score"] for r in out}) == 1
    assert compression.quality_digest(d.limit(0), make(spark, labels, "doc_id bigint, quality int")).count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on its own input."""
    rng = random.Random(12)
    docs, labels = labelled(rng, 160)
    long = prose(rng, 60, 10 ** 6)
    docs = [(i, f"{t}\nA line that many hold." if i % 3 == 0 else t) for i, t in docs]
    docs += [(500, long), (501, long + " end"), (502, None), (503, ""), (504, prose(rng, 20, 10 ** 6))]
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in docs]
    folder = str(tmp_path)
    make(spark, rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    make(spark, labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    make(spark, [(1, docs[-1][1])], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        if name != "packing":
            assert out.dtypes == now.dtypes
        out.write.parquet(f"{folder}/{name}.parquet")
        now = spark.read.parquet(f"{folder}/{name}.parquet")
        if name == "packing":
            break
        after = [(r["doc_id"], r["text"]) for r in now.collect()]
        if name == "toxicity":
            bad = {i for i, y in labels if y}
            assert len(bad & dict(after).keys()) < 0.1 * len(bad) and len(after) > 0.65 * len(before)
        elif name == "line_dedup":
            assert sorted((i, brute.sha(t or "")) for i, t in after) == sorted((i, h) for i, _, _, h in brute.line_dedup(before))
            assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
        elif name == "near_dedup":
            assert sorted(i for i, _ in after) == sorted(i for i, _, _, kept in brute.near_groups(before, 5) if kept)
        else:
            assert sorted(i for i, _ in after) == sorted(i for i, *_, bad in brute.contamination(before, [(1, docs[-1][1])]) if not bad)
        before = after
    assert {r["doc_id"] for r in now.select("doc_id").collect()} == {i for i, _ in before}


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_quality_rules", "op6_chat_formatting", "op8_benchmark_decontamination"])
def test_sql_twins(spark, name):
    import duckdb
    from jobmill.llm import queries
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, folder).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name]).df()[list(got.columns)]
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))


def test_long_turns_and_ties(spark):
    """A turn of 50 MB is parsed without keeping its characters; turns of equal number follow by role and text."""
    import tracemalloc
    text = "ab < c <\\|im_end|> " * 2_700_000
    tracemalloc.start()
    piece = chat.render("user", text)
    (turn,) = chat.parse(piece)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert turn[0] == "user" and turn[1] == chat.read_text(text) and peak < 12 * len(text)
    rows = [(1, 5, r, t) for r, t in (("user", "ab!"), ("user", "ab"), ("user", "ab<|im_end|>"), ("user", "ab<"), ("user", "ab|"), ("assistant", "zz"), ("user", ""))]
    out = chat.read_back(chat.format_chat(make(spark, rows, "conv_id bigint, turn bigint, role string, text string"))).first()
    want = "".join(f"{r}\n{t}\n" for _, _, r, t in sorted(rows, key=lambda x: (x[2], x[3].encode())))
    assert out["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_feature_shares_cover_the_corpus(spark):
    """A mark of toxicity that only rows outside the unlabelled sample could weigh is still judged by all rows."""
    docs, labels = labelled(random.Random(12), 900)
    df, known = make(spark, docs), make(spark, labels, "doc_id bigint, toxic int")
    scorer = toxicity.fit(df, known, max_unlabelled=60)
    words = {f for w in ("vile", "nasty", "awful") for f in toxicity.word_features(w)}
    assert words & set(scorer.place)
    clean = {w for _, t in docs for w in t.split()} - {"vile", "nasty", "awful"}
    assert not {f for w in clean for f in toxicity.word_features(w)} & set(scorer.place)
    again = toxicity.fit(df.repartition(7), known, max_unlabelled=60)
    assert again.place == scorer.place and np.allclose(again.weight, scorer.weight)

"""Randomized equivalence with Python's `re`/str semantics (one Spark job per property)."""

import random
import re

from pyspark.sql import functions as F

from jobmill.functions import classify
from jobmill.functions.text import normalize_text, py_whole_word_pattern
from jobmill.operators import dedup

from .test_dedup import py_simhash, signed

ALPHABET = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") + \
    list("éèàçüößñÉÜ") + list(" \t\n  ,.;:!?-_+#/()'\"&%$@")
KEYWORDS = ["python", "c++", "c#", ".net", "sr.", "node.js", "ci/cd", "go", "ml", "data science"]


def texts(n=400, seed=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 12)):
            if rnd.random() < 0.3:
                parts.append(rnd.choice(KEYWORDS))
            else:
                parts.append("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 8))))
        out.append(rnd.choice(["", " ", "  "]).join(parts))
    return out


def py_norm(t):
    t = re.sub(r"[^\w\s]", "", t.lower())
    return re.sub(r"\s+", " ", t).strip()


def test_normalize_matches_python(spark):
    ts = texts()
    df = spark.createDataFrame(list(enumerate(ts)), "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", normalize_text("t").alias("n")).collect()}
    assert all(got[i] == py_norm(t) for i, t in enumerate(ts))


def test_simhash_matches_python(spark):
    ts = texts(seed=2)
    df = spark.createDataFrame(list(enumerate(ts)), "i int, t string")
    got = {r["i"]: r["fp"] for r in dedup.simhash(df, "t", ["i"], out="fp").collect()}
    assert all(got[i] == signed(py_simhash(t)) for i, t in enumerate(ts))


def test_whole_word_matches_python(spark):
    ts = texts(seed=3)
    df = spark.createDataFrame(list(enumerate(ts)), "i int, t string")
    cols = [F.col("t").rlike(py_whole_word_pattern(k)).alias(f"k{j}") for j, k in enumerate(KEYWORDS)]
    rows = {r["i"]: r for r in df.select("i", *cols).collect()}
    for i, t in enumerate(ts):
        for j, k in enumerate(KEYWORDS):
            expected = re.search(rf"\b{re.escape(k)}\b", t, re.I) is not None
            assert rows[i][f"k{j}"] == expected, (t, k)


def test_title_case_matches_python(spark):
    ts = texts(seed=4)
    df = spark.createDataFrame(list(enumerate(ts)), "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", classify.py_title(F.col("t")).alias("x")).collect()}
    assert all(got[i] == t.title() for i, t in enumerate(ts))


def test_absolute_url_matches_urljoin(spark):
    from urllib.parse import urljoin

    from jobmill.sources.html import absolute_url
    rnd = random.Random(5)
    bases = ["https://a.com", "https://a.com/", "https://a.com/x/y/z.html", "https://a.com/x/y/",
             "http://b.org/p?q=1#f", "https://c.net/a/b/c/d"]
    pieces = ["..", ".", "jobs", "1", "x-y", "..", "a.b"]
    hrefs = ["", "?z=2", "#top", "//cdn.io/s/../t", "https://other.io/p", "/abs/../j", "/"]
    for _ in range(150):
        segs = [rnd.choice(pieces) for _ in range(rnd.randint(1, 6))]
        h = ("/" if rnd.random() < 0.3 else "") + "/".join(segs) + rnd.choice(["", "/", "?k=1", "#s"])
        hrefs.append(h)
    pairs = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(pairs, "b string, h string")
    got = [r[0] for r in df.select(absolute_url("b", "h")).collect()]
    bad = [(b, h, g, urljoin(b, h)) for (b, h), g in zip(pairs, got)
           if g != urljoin(b, h) and not h.startswith("//")]
    assert not bad, bad[:5]


def test_strip_html_matches_python(spark):
    from jobmill.functions.text import strip_html
    rnd = random.Random(6)
    frags = ["<p>", "</p>", "<a href='x'>", "</a>", "<br/>", "text", "Ünï", " ", "\n\t", "a<b", "x>y", "&amp;",
             "<script>var t=\"<\";</script>", "<!-- c -->"]
    docs = ["".join(rnd.choice(frags) for _ in range(rnd.randint(0, 15))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, h string")
    got = {r["i"]: r["s"] for r in df.select("i", strip_html("h").alias("s")).collect()}
    for i, d in enumerate(docs):
        exp = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", d)).strip()
        assert got[i] == exp, d


def test_title_from_url_matches_python(spark):
    from urllib.parse import urlparse

    def py_title_from_url(url):
        segs = [s for s in urlparse(url).path.split("/") if s]
        if not segs:
            return None
        t = re.sub(r"[-_]+", " ", segs[-1])
        t = re.sub(r"\.\w+$", "", t)
        if len(t) < 5 or t.isdigit():
            return None
        return t.title()

    rnd = random.Random(7)
    parts = ["jobs", "senior-data_engineer", "12345", "role.html", "a", "x-y-z.pdf", "mlops__lead", "über-chef"]
    urls = [f"https://h{rnd.randint(0, 9)}.io/" + "/".join(rnd.choice(parts) for _ in range(rnd.randint(0, 3)))
            + rnd.choice(["", "/", "?q=1", "#f"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, u string")
    got = {r["i"]: r["t"] for r in df.select("i", classify.title_from_url("u").alias("t")).collect()}
    for i, u in enumerate(urls):
        assert got[i] == py_title_from_url(u), u


def _py_score(p, post, as_of):
    """Brute-force scoring rules (keyword, recency, weighted sum, reasons)."""
    import math
    parts = [post["title"]]
    if post["description_text"]:
        parts.append(post["description_text"])
    parts.extend(post["requirements"] or [])
    if post["department"]:
        parts.append(post["department"])
    text = " ".join(parts)

    def ww(k, t):
        return re.search(rf"\b{re.escape(k)}\b", t, re.I) is not None
    for k in p.must_not_keywords:
        if ww(k, text):
            return 0.0, 0.0, [f"Excluded: contains '{k}'"]
    s, reasons = 0.0, []
    for r in p.desired_roles:
        if ww(r, post["title"]):
            s += 0.4
            reasons.append(f"Role match: {r}")
            break
    if p.must_have_keywords:
        hit = [k for k in p.must_have_keywords if ww(k, text)]
        reasons += [f"Keyword: {k}" for k in hit]
        s += len(hit) / len(p.must_have_keywords) * 0.4
    else:
        s += 0.2
    if post["location"] and p.preferred_locations:
        for loc in p.preferred_locations:
            if loc.lower() in post["location"].lower():
                s += 0.1
                reasons.append(f"Location: {loc}")
                break
    if p.remote_preference and post["remote_type"] == p.remote_preference:
        s += 0.1
        reasons.append(f"Remote: {post['remote_type']}")
    kw = min(s, 1.0)
    if post["posted_at"] is None:
        rec = 0.5
    else:
        age = (as_of - post["posted_at"]).total_seconds() / 86400
        rec = 1.0 if age <= 0 else 0.0 if age >= 30 else 1.0 - math.sqrt(age / 30)
    final = p.vector_weight * 0.5 + p.keyword_weight * kw + p.recency_weight * rec
    if rec > 0.7:
        reasons.append("Recently posted")
    return final, kw, reasons


def test_scoring_matches_bruteforce(spark):
    import datetime as dt

    from jobmill.operators import scoring
    from jobmill.operators.scoring import Profile
    rnd = random.Random(8)
    as_of = dt.datetime(2025, 6, 1)
    words = ["python", "backend", "senior", "c++", "go", "data", "engineer", "intern", "remote", "lead", "sql"]
    locs = ["Berlin", "Remote - EU", "San Francisco, CA", "", None, "NEW YORK"]
    rows = []
    for i in range(300):
        title = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
        desc = rnd.choice([None, "", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))])
        req = [rnd.choice(words) for _ in range(rnd.randint(0, 2))]
        posted = rnd.choice([None, as_of - dt.timedelta(hours=rnd.randint(-5, 24 * 40))])
        rows.append((f"id{i}", title, desc, req, rnd.choice([None, "Eng", ""]), rnd.choice(locs),
                     rnd.choice(["remote", "onsite", "unknown"]), posted))
    cols = ("id string, title string, description_text string, requirements array<string>, department string, "
            "location string, remote_type string, posted_at timestamp")
    df = spark.createDataFrame(rows, cols)
    profs = []
    for j in range(4):
        profs.append(Profile(profile=f"p{j}", desired_roles=rnd.sample(["data engineer", "python", "backend engineer", "sql"], 2),
                             must_have_keywords=rnd.sample(words, rnd.randint(0, 3)),
                             must_not_keywords=rnd.sample(["senior", "lead", "c++"], rnd.randint(0, 2)),
                             preferred_locations=rnd.sample(["berlin", "Remote", "york"], rnd.randint(0, 2)),
                             remote_preference=rnd.choice([None, "remote"])))
    posts = {r[0]: dict(zip(["id", "title", "description_text", "requirements", "department", "location",
                             "remote_type", "posted_at"], r)) for r in rows}
    for path in ("literal", "joined"):
        arg = profs if path == "literal" else scoring.profiles_frame(spark, profs)
        out = scoring.score(df, arg, as_of).select("id", "profile", "final_score", "keyword_score",
                                                         "match_reasons").collect()
        assert len(out) == len(rows) * len(profs)
        byname = {p.profile: p for p in profs}
        for r in out:
            final, k, reasons = _py_score(byname[r["profile"]], posts[r["id"]], as_of)
            assert abs(r["final_score"] - final) < 1e-9 and abs(r["keyword_score"] - k) < 1e-9, (path, r)
            assert r["match_reasons"] == reasons, (path, r["id"], r["profile"])

"""Empty, repeated, very long and oddly named inputs of the operators and the pipeline."""

import random
import re
import shutil
import subprocess
import sys

import numpy as np
import public_tokenizers

import corpus_pipeline
from jobmill.llm import compression, html_extract, packing, quality_rules, toxicity


from .test_other_ops import labelled
from .test_text_ops import make, prose

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def landed(spark, folder, docs, labels, items, schema=DOCS):
    make(spark, docs, schema).write.parquet(f"{folder}/documents.parquet")
    make(spark, labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    make(spark, items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_over_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, landed(spark, tmp_path, [], [], [])).count() == 0


def test_pipeline_with_repeated_rows_and_extra_columns(spark, tmp_path):
    """Repeated rows, null ids and texts, columns named like the stages' own."""
    rng = random.Random(41)
    own = [prose(rng, 40, 10 ** 6) for _ in range(30)]
    line = "One line that every document holds\n"
    rows = [(i, line + t, "en", "s", 5, 0.5, "kept?") for i, t in enumerate(own)]
    rows += rows[:4] + [(None, own[0] + " again", None, None, None, None, None), (None, None, None, None, None, None, None), (7, "", "en", "s", 0, 1.0, "x")]
    folder = landed(spark, tmp_path, rows, [(0, 0), (1, 0)], [(None, own[9]), (3, None)], DOCS + ", score double, kept string")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.dtypes == now.dtypes, name
        out.write.parquet(f"{folder}/{name}.parquet")
        now = spark.read.parquet(f"{folder}/{name}.parquet")
    kept = now.collect()
    ids = sorted(r["doc_id"] for r in kept if r["doc_id"] is not None)
    # one row of each repeated one, the contaminated one gone, both empty texts stay
    assert ids == sorted([i for i in range(30) if i != 9] + [7])
    assert sum((r["text"] or "").startswith(line.strip()) for r in kept) == 1 and sum(not r["text"] for r in kept) == 2
    assert packing.pack(now, public_tokenizers.path("byte_bpe_50k.json")).count() >= 0
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_long_pages_and_many_null_urls(spark):
    rng = random.Random(42)
    body = "".join(f"<p>{prose(rng, 12, 10 ** 6)}</p>" for _ in range(30_000))
    rows = [(0, "http://a.example/", f"<html><body><nav>menu</nav><article>{body}</article></body></html>")]
    rows += [(k, None, f"<body><div class=m>{prose(rng, 8, 10 ** 6)}</div><div class=b>Call us</div></body>") for k in range(1, 250)]
    rows += [(900, None, "<div>" * 20_000 + "deep"), (901, None, "<" * 50_000), (902, None, "a " * 400_000)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(make(spark, rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows) and got[0].count("\n\n") == 29_999 and "menu" not in got[0]
    assert all("Call us" not in got[k] and got[k] for k in range(1, 250))
    assert got[900] == "deep" and len(got[902]) == 799_999


def test_classifiers_score_long_texts(spark):
    docs, labels = labelled(random.Random(43), 300)
    rows = docs + [(1000, "plain words here " * 400_000), (1001, "vile " * 500_000), (1002, "x" * 2_000_000)]
    df = make(spark, rows)
    out = {r["doc_id"]: r for r in toxicity.toxicity_digest(df, make(spark, labels, "doc_id bigint, toxic int")).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out.values())
    assert out[1001]["score"] > out[1000]["score"]
    scored = compression.quality_digest(df, make(spark, [(i, 1 - y) for i, y in labels], "doc_id bigint, quality int")).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)


def test_quality_rules_names_and_long_lines(spark):
    rng = random.Random(44)
    line = prose(rng, 60_000, 5000)
    docs = make(spark, [(1, line, 1, True, "a", 2.0), (2, None, None, None, None, None)],
                "doc_id bigint, text string, n_words int, kept boolean, lost_chars string, _row double")
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert out[1]["n_words"] == 60_000 and out[1]["_row"] == 2.0 and not out[2]["kept"]
    assert set(out[1].asDict()) == {"doc_id", "text", "_row", *quality_rules.MADE}


def test_one_word_of_many_letters_is_packed(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = make(spark, [(1, "z" * 400_000), (2, "é" * 30_000), (3, None)])
    rows = packing.pack_digest(docs, path).collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in rows}
    for i, text in ((1, "z" * 400_000), (2, "é" * 30_000), (3, "")):
        ids = packing.token_ids(text, path, 0)
        assert tokens[i] == len(ids)
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert sum(n for _, n, _ in pieces) == len(ids)
        import zlib
        assert all(zlib.crc32(np.ascontiguousarray(ids[a:a + n]).tobytes()) == c for a, n, c in pieces)


def test_the_rest_works_without_this_subpackage(tmp_path):
    """The package without this folder imports, and only its own queries are registered."""
    import os
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", "llm", "corpus_pipeline.py")])
    code = "import warnings; warnings.simplefilter('error', ResourceWarning); import __spark_entry__ as E; q = E.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and re.match(r"\d+ False", out.stdout), out.stderr
    assert "left out" in out.stderr

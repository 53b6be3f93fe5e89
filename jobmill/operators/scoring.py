"""Profile x posting scoring (keyword, recency, vector, weighted final score, reasons).

Plan shape
----------
Profiles are a small configuration dimension; postings are the big side. Postings are
scanned once, whatever the number of profiles:

* Profiles given as a list are inlined as literals: one projection computes the score
  parts of every profile as an array of structs and ``inline`` turns it into rows. Every
  whole-word regex is a literal, compiled once per task; no join, no shuffle.
* Profiles given as a table are joined: every posting meets every profile (that is the
  operator), against broadcast chunks whose size in bytes is measured first. All terms of a
  chunk are looked for at once, once per posting (``functions.terms``), and a profile's part
  is a lookup in what was found. Chunks are unioned, so no profile is ever dropped.

Both give the same rows: missing keyword lists count as empty, other columns of a profiles
table are ignored.

Deliberate differences from the source tool (documented in README): reasons carry the
plain keyword rather than the escaped regex; ``as_of`` replaces the wall clock.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import term_hits
from ..functions.text import py_whole_word_pattern, searchable_text
from ..functions.timeutil import recency_score
from ..schema import PROFILE_SCHEMA

NO_VECTOR_SCORE = 0.5
# Code for more patterns makes one method that the JVM no longer compiles: there Spark's interpreted
# generator is faster (21 terms: 3.4 against 5.4 s, 42 terms: 11.0 against 9.8 s).
COMPILED_TERMS = 24


@dataclass
class Profile:
    profile: str = "default"
    desired_roles: list[str] = field(default_factory=list)
    must_have_keywords: list[str] = field(default_factory=list)
    must_not_keywords: list[str] = field(default_factory=list)
    preferred_locations: list[str] = field(default_factory=list)
    remote_preference: str | None = None
    min_score_threshold: float = 0.3
    vector_weight: float = 0.55
    keyword_weight: float = 0.30
    recency_weight: float = 0.15


def profiles_frame(spark: SparkSession, profiles) -> DataFrame:
    rows = [asdict(p) if isinstance(p, Profile) else dict(p) for p in profiles]
    return spark.createDataFrame([Profile(**r).__dict__ for r in rows], PROFILE_SCHEMA)


# ---------------------------------------------------------------------------
# Expression builders: the profile as literals, or as columns. Both return the same parts.
# ---------------------------------------------------------------------------
def _first_match_literal(items: list[str], test) -> Column:
    """First item (in list order) whose test is true, else null."""
    expr = None
    for it in items:
        cond = test(it)
        expr = F.when(cond, F.lit(it)) if expr is None else expr.when(cond, F.lit(it))
    return F.lit(None).cast("string") if expr is None else expr


def keyword_parts_literal(p: Profile, text: Column, title: Column, location: Column,
                          remote: Column, compiled: bool = False) -> dict:
    """``compiled``: without lambda functions, so that Spark generates code for the generator."""
    if p.must_not_keywords:
        hits = [F.when(text.rlike(py_whole_word_pattern(k)), F.lit(k)) for k in p.must_not_keywords]
        excluded_kw = F.coalesce(*hits)
    else:
        excluded_kw = F.lit(None).cast("string")
    role = _first_match_literal(p.desired_roles, lambda r: title.rlike(py_whole_word_pattern(r)))
    if p.must_have_keywords:
        hit = [text.rlike(py_whole_word_pattern(k)) for k in p.must_have_keywords]
        if compiled:
            matched = F.concat(*[F.when(h, F.array(F.lit(k))).otherwise(F.array().cast("array<string>"))
                                 for h, k in zip(hit, p.must_have_keywords)])
        else:
            matched = F.array_compact(F.array(*[F.when(h, F.lit(k)) for h, k in zip(hit, p.must_have_keywords)]))
        n_kw = F.lit(len(p.must_have_keywords))
    else:
        matched = F.array().cast("array<string>")
        n_kw = F.lit(0)
    loc_l = F.lower(location)
    has_loc = location.isNotNull() & (location != "")
    loc_hit = _first_match_literal(p.preferred_locations,
                                   lambda l: has_loc & loc_l.contains(l.lower()))
    remote_ok = (F.lit(False) if p.remote_preference is None
                 else F.coalesce(remote == F.lit(p.remote_preference), F.lit(False)))
    return dict(excluded_kw=excluded_kw, role=role, matched=matched, n_kw=n_kw,
                loc_hit=loc_hit, remote_ok=remote_ok,
                weights=(F.lit(p.vector_weight), F.lit(p.keyword_weight), F.lit(p.recency_weight)))


def keyword_parts_columns(profile: dict, in_text: Column, in_title: Column, location: Column, remote: Column) -> dict:
    """Same parts with the profile's fields as columns and the terms found in text and title."""
    first = lambda a: F.try_element_at(a, F.lit(1))
    excluded_kw = first(F.filter(profile["must_not_keywords"], lambda k: F.array_contains(in_text, k)))
    role = first(F.filter(profile["desired_roles"], lambda r: F.array_contains(in_title, r)))
    matched = F.filter(profile["must_have_keywords"], lambda k: F.array_contains(in_text, k))
    has_loc = location.isNotNull() & (location != "")
    loc_hit = F.when(has_loc, first(F.filter(profile["preferred_locations"],
                                             lambda l: F.lower(location).contains(F.lower(l)))))
    wanted = profile["remote_preference"]
    remote_ok = F.coalesce(wanted.isNotNull() & (remote == wanted), F.lit(False))
    return dict(excluded_kw=excluded_kw, role=role, matched=matched, n_kw=F.size(profile["must_have_keywords"]),
                loc_hit=loc_hit, remote_ok=remote_ok,
                weights=(profile["vector_weight"], profile["keyword_weight"], profile["recency_weight"]))


def _score_columns(parts: dict, remote: Column, recency: Column, vector: Column) -> list[Column]:
    excluded = parts["excluded_kw"].isNotNull()
    role_s = F.when(parts["role"].isNotNull(), F.lit(0.4)).otherwise(F.lit(0.0))
    kw_s = F.when(parts["n_kw"] > 0,
                  F.size(parts["matched"]).cast("double") / parts["n_kw"].cast("double") * F.lit(0.4)) \
        .otherwise(F.lit(0.2))
    loc_s = F.when(parts["loc_hit"].isNotNull(), F.lit(0.1)).otherwise(F.lit(0.0))
    rem_s = F.when(parts["remote_ok"], F.lit(0.1)).otherwise(F.lit(0.0))
    keyword = F.least(F.lit(0.0) + role_s + kw_s + loc_s + rem_s, F.lit(1.0))
    wv, wk, wr = parts["weights"]
    vec = F.coalesce(vector, F.lit(NO_VECTOR_SCORE))
    final = wv * vec + wk * keyword + wr * recency
    reasons = F.concat(
        F.when(parts["role"].isNotNull(),
               F.array(F.concat(F.lit("Role match: "), parts["role"]))).otherwise(F.array()),
        F.transform(parts["matched"], lambda k: F.concat(F.lit("Keyword: "), k)),
        F.when(parts["loc_hit"].isNotNull(),
               F.array(F.concat(F.lit("Location: "), parts["loc_hit"]))).otherwise(F.array()),
        F.when(parts["remote_ok"], F.array(F.concat(F.lit("Remote: "), remote))).otherwise(F.array()),
        F.when(vec > 0.6, F.array(F.format_string("High semantic similarity: %.2f", F.bround(vec, 2))))
        .otherwise(F.array()),
        F.when(recency > 0.7, F.array(F.lit("Recently posted"))).otherwise(F.array()),
    ).cast("array<string>")
    excl_reason = F.array(F.concat(F.lit("Excluded: contains '"), parts["excluded_kw"], F.lit("'")))
    z = F.lit(0.0)
    return [
        F.when(excluded, z).otherwise(final).alias("final_score"),
        F.when(excluded, z).otherwise(vec).alias("vector_score"),
        F.when(excluded, z).otherwise(keyword).alias("keyword_score"),
        F.when(excluded, z).otherwise(recency).alias("recency_score"),
        F.when(excluded, excl_reason).otherwise(reasons).alias("match_reasons"),
        excluded.alias("excluded"),
    ]


_LISTS = ("desired_roles", "must_have_keywords", "must_not_keywords", "preferred_locations")
_PROFILE_FIELDS = [f.name for f in PROFILE_SCHEMA.fields]
_DEFAULTS = Profile()


def as_profile(p) -> Profile:
    """A Profile from a Profile, dict or Row; missing lists and weights take the defaults."""
    if isinstance(p, Profile):
        p = asdict(p)
    elif not isinstance(p, dict):
        p = p.asDict(recursive=True)
    given = {k: v for k, v in p.items() if k in _PROFILE_FIELDS and v is not None}
    return Profile(**given)


def profiles_table(profiles: DataFrame) -> DataFrame:
    """The profile columns of a table, with the same defaults."""
    cols = []
    for f in PROFILE_SCHEMA.fields:
        default = getattr(_DEFAULTS, f.name)
        if f.name not in profiles.columns:
            c = F.lit(None).cast(f.dataType)
        else:
            c = F.col(f.name).cast(f.dataType)
        if f.name in _LISTS:
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif default is not None:
            c = F.coalesce(c, F.lit(default))
        cols.append(c.alias(f.name))
    return profiles.select(*cols)


def score(postings: DataFrame, profiles, as_of, *, vector_col: str | None = None,
          chunk_bytes: int = 8 << 20, text_col: str | None = None, min_score=None) -> DataFrame:
    """Score every (posting, profile) pair, or with ``min_score`` (a number, or "own" for each
    profile's threshold) the pairs that reach it: of a profiles table only those pairs are
    formed that some found term, or the profile without any, can bring there.

    ``postings`` needs title, location, remote_type, posted_at and either ``text_col``
    or the searchable-text columns. ``vector_col`` (optional) holds a per-pair
    rescaled similarity in [0, 1]; null means "no embedding" -> neutral 0.5.
    ``profiles``: list of Profile / dicts (inlined), or a DataFrame with PROFILE_SCHEMA's
    columns (broadcast in chunks of about ``chunk_bytes``).
    Returns postings columns + profile + score columns (unfiltered), for postings x profiles
    rows."""
    text = F.col(text_col) if text_col else searchable_text()
    title, location, remote = F.col("title"), F.col("location"), F.col("remote_type")
    recency = recency_score("posted_at", as_of)
    vector = F.col(vector_col) if vector_col else None
    if isinstance(profiles, DataFrame):
        return _score_joined(postings, profiles_table(profiles), text, title, location, remote, recency,
                             vector, chunk_bytes, min_score)
    vector = F.lit(None).cast("double") if vector is None else vector
    profiles = [as_profile(p) for p in profiles]
    # the text is put together once a row, not once a keyword
    postings, text = postings.withColumn("_p_text", text), F.col("_p_text")
    compiled = sum(len(x) for p in profiles for x in (p.desired_roles, p.must_have_keywords, p.must_not_keywords)) <= COMPILED_TERMS
    each = [_parts_struct(keyword_parts_literal(p, text, title, location, remote, compiled), recency, vector,
                          F.lit(p.profile), F.lit(p.min_score_threshold)) for p in profiles]
    if not each:
        raise ValueError("score needs at least one profile")
    out = _finish(postings, F.array(*each), remote)
    out = out.drop("_p_text")
    return out if min_score is None else out.filter(F.col("final_score") >= _least(min_score))


def _least(min_score) -> Column:
    return F.col("min_score_threshold") if min_score == "own" else F.lit(float(min_score))


def _keys(profile: dict, least: Column, top_vector: float) -> tuple[Column, Column]:
    """(can the profile reach ``least`` without any term?, the terms one of which a pair needs
    otherwise). Bounds on the score: without terms, and with all keywords but no role."""
    many = lambda c: F.size(profile[c]) > 0
    some = lambda cond, x, y=0.0: F.when(cond, F.lit(x)).otherwise(F.lit(y))
    wv, wk, wr = (profile[f"{c}_weight"] for c in ("vector", "keyword", "recency"))
    rest = some(many("preferred_locations"), 0.1) + some(profile["remote_preference"].isNotNull(), 0.1)
    bound = lambda kw: wv * top_vector + wk * F.least(F.lit(1.0), kw + rest) + wr + 1e-9
    none, no_role = (bound(some(many("must_have_keywords"), x, 0.2)) for x in (0.0, 0.4))
    tagged = lambda tag, c: F.transform(F.array_compact(profile[c]), lambda t: F.concat(F.lit(tag), t))
    roles = tagged("r", "desired_roles")
    keys = F.when(no_role >= least, F.concat(roles, tagged("k", "must_have_keywords"))).otherwise(roles)
    return (none >= least) | (F.least(wv, wk, wr) < 0), F.array_distinct(keys)


def _parts_struct(parts: dict, recency, vector, profile: Column, threshold: Column) -> Column:
    wv, wk, wr = parts["weights"]
    return F.struct(
        profile.alias("profile"), threshold.alias("min_score_threshold"),
        *[parts[k].alias(f"_p_{k}") for k in ("excluded_kw", "role", "matched", "n_kw", "loc_hit", "remote_ok")],
        wv.alias("_p_wv"), wk.alias("_p_wk"), wr.alias("_p_wr"), recency.alias("_p_rec"), vector.alias("_p_vec"))


def _finish(df: DataFrame, parts: Column, remote) -> DataFrame:
    """One row per element of ``parts``, with the score columns.

    The parts come out of ``inline``: a later filter on the score (the threshold) cannot be
    pushed below a generator that produces the columns it reads, so Catalyst does not copy
    the regexes into that filter or a join condition; each regex runs once per row."""
    staged = df.select("*", F.inline(parts))
    cols = {k: F.col(f"_p_{k}") for k in ("excluded_kw", "role", "matched", "n_kw", "loc_hit", "remote_ok")}
    cols["weights"] = (F.col("_p_wv"), F.col("_p_wk"), F.col("_p_wr"))
    out = staged.select("*", *_score_columns(cols, remote, F.col("_p_rec"), F.col("_p_vec")))
    return out.drop(*[f"_p_{k}" for k in ("excluded_kw", "role", "matched", "n_kw", "loc_hit", "remote_ok")],
                    "_p_wv", "_p_wk", "_p_wr", "_p_rec", "_p_vec")


def _score_joined(postings, profiles, text, title, location, remote, recency, vector, chunk_bytes, min_score):
    """Profiles as a table: broadcast joins over chunks of a measured size, unioned. The terms of
    a chunk (no larger than it) go into one automaton, which finds those of a posting in one pass.

    Without ``min_score`` every pair is formed. With it a posting meets the profiles that one of
    its found terms leads to (a hash join on the term; a pair that several terms lead to is
    kept at the first), and only profiles that may reach the score without any term meet all."""
    spark = postings.sparkSession
    profiles = profiles.select(F.struct(*_PROFILE_FIELDS).alias("_profile"))
    field = {f: F.col(f"_profile.{f}") for f in _PROFILE_FIELDS}
    always, keys = F.lit(True), F.array().cast("array<string>")
    if min_score is not None:
        least = field["min_score_threshold"] if min_score == "own" else F.lit(float(min_score))
        always, keys = _keys(field, least, NO_VECTOR_SCORE if vector is None else 1.0)
    # a profile goes out once for each of its keys
    packed = profiles.select("_profile", always.alias("_always"), keys.alias("_keys"))
    bytes_of = F.length(F.to_json("_profile")) * F.greatest(F.lit(1), F.when(F.col("_always"), 1).otherwise(F.size("_keys")))
    size = packed.agg(F.sum(bytes_of)).first()[0] or 0
    n_chunks = max(1, -(-size // chunk_bytes))
    packed = packed.withColumn("_chunk", F.pmod(F.xxhash64("_profile.profile"), F.lit(n_chunks)))
    parts = keyword_parts_columns(field, F.col("_in_text"), F.col("_in_title"), location, remote)
    one = F.array(_parts_struct(parts, recency, F.lit(None).cast("double") if vector is None else vector, field["profile"], field["min_score_threshold"]))
    made = ("_profile", "_always", "_keys", "_in_text", "_in_title")
    outs = []
    for i in range(n_chunks):
        chunk = packed.filter(F.col("_chunk") == i).drop("_chunk")
        lists = lambda *names: {r[0] for r in chunk.select(F.explode(F.flatten(F.array(
            *[F.array_compact(field[n]) for n in names])))).distinct().collect()}
        found = postings.select("*", term_hits(spark, text, lists("must_have_keywords", "must_not_keywords")).alias("_in_text"),
                                term_hits(spark, title, lists("desired_roles")).alias("_in_title"))
        outs.append(_finish(found.crossJoin(F.broadcast(chunk.filter("_always"))), one, remote).drop(*made))
        if min_score is not None:
            tag = lambda c, t: F.transform(c, lambda x: F.concat(F.lit(t), x))
            hits = found.withColumn("_hits", F.concat(tag("_in_title", "r"), tag("_in_text", "k"))).select("*", F.explode("_hits").alias("_key"))
            by_key = chunk.filter("not _always").select("*", F.explode("_keys").alias("_key"))
            pairs = hits.join(F.broadcast(by_key), "_key").filter(F.array_min(F.array_intersect("_keys", "_hits")) == F.col("_key"))
            outs.append(_finish(pairs.drop("_key", "_hits"), one, remote).drop(*made))
    out = reduce(DataFrame.unionByName, outs)
    return out if min_score is None else out.filter(F.col("final_score") >= _least(min_score))


def score_batch(postings: DataFrame, profiles, as_of, min_score: float | None = None,
                order_col: str | None = None, **kw) -> DataFrame:
    """Score, keep final_score >= threshold (argument, else each profile's default),
    sort by final score descending (stable on ``order_col`` if given)."""
    kept = score(postings, profiles, as_of, min_score="own" if min_score is None else min_score, **kw)
    order = [F.col("profile"), F.desc("final_score")] + ([F.col(order_col)] if order_col else [])
    return kept.orderBy(*order)


def match_class(score_col="final_score", threshold: float = 0.3) -> Column:
    """'match' if >= threshold, 'partial' if > 0, else 'none'."""
    s = F.col(score_col)
    return F.when(s >= threshold, "match").when(s > 0, "partial").otherwise("none")

"""Registered queries over whole documents: normalization, SimHash, near-duplicate
fold, remote/employment rules, skills/roles/locations, generated profiles
(F03 F09 F10 F23 F24 A05 W02 R01-R04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import employment_type, remote_type
from ..functions.text import fingerprint_bits, hamming, normalize_text, simhash_similarity
from ..operators import dedup, profiles
from ..session import ensure_checkpoint_dir, read_table, spread
from .registry import register
from .sqlfrag import norm, sql_str, whole_word_re

# ---------------------------------------------------------------------------
# F03 normalize (md5 + length of the normalized whole text)
# ---------------------------------------------------------------------------


@register("normalize", f"""
SELECT doc_id, md5({norm('text')}) AS norm_md5, length({norm('text')})::BIGINT AS norm_len FROM documents
""")
def q_normalize(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents"))
    n = normalize_text("text")
    return d.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("bigint").alias("norm_len"))


# ---------------------------------------------------------------------------
# A05 SimHash
# ---------------------------------------------------------------------------
_FP_SQL = f"""
  d AS (SELECT doc_id, lang, source, {norm('text')} AS nt FROM documents),
  w AS (SELECT doc_id, unnest(string_split(nt, ' ')) AS w FROM d),
  h AS (SELECT doc_id, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h FROM w WHERE w <> ''),
  v AS (SELECT doc_id, b.i AS i,
               sum(CASE WHEN ((h >> b.i::UBIGINT) & 1::UBIGINT) = 1 THEN 1 ELSE -1 END) AS s
        FROM h CROSS JOIN range(64) b(i) GROUP BY doc_id, b.i),
  f AS (SELECT doc_id,
               string_agg(CASE WHEN s > 0 THEN '1' ELSE '0' END, '' ORDER BY i DESC) AS bits,
               bit_or(CASE WHEN s > 0 THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END) AS fp
        FROM v GROUP BY doc_id),
  fp AS (SELECT d.doc_id, d.lang, d.source, coalesce(f.bits, repeat('0', 64)) AS fp_bits,
                coalesce(f.fp, 0::UBIGINT) AS fp FROM d LEFT JOIN f USING (doc_id))
"""


def doc_fingerprints(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "text")
    fp = dedup.simhash(d, "text", ["doc_id", "lang", "source"])
    return fp


@register("simhash", f"WITH {_FP_SQL} SELECT doc_id, fp_bits FROM fp")
def q_simhash(spark, sf_dir):
    return doc_fingerprints(spark, sf_dir).select("doc_id", fingerprint_bits("fingerprint").alias("fp_bits"))


# ---------------------------------------------------------------------------
# W02 ordered near-duplicate fold; fuzzy key = normalize(lang):normalize(source)
# ---------------------------------------------------------------------------
@register("near_dup_fold", f"""
WITH RECURSIVE {_FP_SQL},
  k AS (SELECT doc_id, {norm('lang')} || ':' || {norm('source')} AS fuzzy_key, fp,
               row_number() OVER (PARTITION BY {norm('lang')} || ':' || {norm('source')} ORDER BY doc_id) AS rn
        FROM fp),
  r AS (SELECT fuzzy_key, rn, doc_id, fp AS state, true AS admitted FROM k WHERE rn = 1
        UNION ALL
        SELECT k.fuzzy_key, k.rn, k.doc_id,
               CASE WHEN bit_count(xor(r.state, k.fp)) > 9 THEN k.fp ELSE r.state END,
               bit_count(xor(r.state, k.fp)) > 9
        FROM r JOIN k ON k.fuzzy_key = r.fuzzy_key AND k.rn = r.rn + 1)
SELECT doc_id, fuzzy_key FROM r WHERE admitted
""")
def q_near_dup_fold(spark, sf_dir):
    fp = doc_fingerprints(spark, sf_dir).withColumn("fuzzy_key", dedup.fuzzy_key("lang", "source"))
    out = dedup.near_dup_fold(fp, "fuzzy_key", "doc_id", "fingerprint", "doc_id")
    return out.filter("admitted").select("doc_id", "fuzzy_key")


@register("near_dup_stats", f"""
WITH RECURSIVE {_FP_SQL},
  k AS (SELECT doc_id, {norm('lang')} || ':' || {norm('source')} AS fuzzy_key, fp,
               row_number() OVER (PARTITION BY {norm('lang')} || ':' || {norm('source')} ORDER BY doc_id) AS rn
        FROM fp),
  r AS (SELECT fuzzy_key, rn, doc_id, fp AS state, true AS admitted, 0 AS dist FROM k WHERE rn = 1
        UNION ALL
        SELECT k.fuzzy_key, k.rn, k.doc_id,
               CASE WHEN bit_count(xor(r.state, k.fp)) > 9 THEN k.fp ELSE r.state END,
               bit_count(xor(r.state, k.fp)) > 9, bit_count(xor(r.state, k.fp))
        FROM r JOIN k ON k.fuzzy_key = r.fuzzy_key AND k.rn = r.rn + 1)
SELECT fuzzy_key, count(*)::BIGINT AS docs, sum(admitted::INT)::BIGINT AS kept FROM r GROUP BY 1
""")
def q_near_dup_stats(spark, sf_dir):
    fp = doc_fingerprints(spark, sf_dir).withColumn("fuzzy_key", dedup.fuzzy_key("lang", "source"))
    out = dedup.near_dup_fold(fp, "fuzzy_key", "doc_id", "fingerprint", "doc_id")
    return out.groupBy("fuzzy_key").agg(F.count(F.lit(1)).alias("docs"),
                                        F.sum(F.col("admitted").cast("bigint")).alias("kept"))


# ---------------------------------------------------------------------------
# F09 F10 remote / employment policies on whole documents
# ---------------------------------------------------------------------------
def _has(t, s):
    return f"contains({t}, {sql_str(s)})"


_T = "lower(text)"
_ON = f"({_has(_T, 'on-site')} OR {_has(_T, 'onsite')})"
_PART = f"({_has(_T, 'part-time')} OR {_has(_T, 'part time')})"
_FULL = f"({_has(_T, 'full-time')} OR {_has(_T, 'full time')})"


@register("remote_employment", f"""
SELECT doc_id,
  CASE WHEN {_has(_T, 'remote')} AND {_has(_T, 'hybrid')} THEN 'hybrid' WHEN {_has(_T, 'remote')} THEN 'remote'
       WHEN {_ON} THEN 'onsite' ELSE 'unknown' END AS remote_a,
  CASE WHEN {_has(_T, 'remote')} THEN 'remote' WHEN {_has(_T, 'hybrid')} THEN 'hybrid'
       WHEN {_ON} THEN 'onsite' ELSE 'unknown' END AS remote_b,
  CASE WHEN {_has(_T, 'remote')} THEN 'remote' WHEN {_has(_T, 'hybrid')} THEN 'hybrid' ELSE 'unknown' END AS remote_c,
  CASE WHEN {_has(_T, 'intern')} THEN 'internship' WHEN {_has(_T, 'contract')} THEN 'contract'
       WHEN {_PART} THEN 'part_time' ELSE 'full_time' END AS emp_default,
  CASE WHEN {_has(_T, 'intern')} THEN 'internship' WHEN {_has(_T, 'contract')} THEN 'contract'
       WHEN {_PART} THEN 'part_time' WHEN {_FULL} THEN 'full_time' ELSE 'unknown' END AS emp_explicit,
  CASE WHEN {_has(_T, 'intern')} THEN 'internship'
       WHEN {_has(_T, 'contract')} OR {_has(_T, 'temporary')} THEN 'contract'
       WHEN {_PART} THEN 'part_time' WHEN {_FULL} THEN 'full_time' ELSE 'unknown' END AS emp_workday,
  CASE WHEN {_has(_T, 'intern')} THEN 'internship' WHEN {_has(_T, 'contract')} THEN 'contract'
       ELSE 'full_time' END AS emp_short
FROM documents
""")
def q_remote_employment(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents"))
    t = F.col("text")
    return d.select("doc_id",
                    remote_type(t, policy="A").alias("remote_a"),
                    remote_type(t, policy="B").alias("remote_b"),
                    remote_type(t, policy="C").alias("remote_c"),
                    employment_type(t, policy="default_full").alias("emp_default"),
                    employment_type(t, policy="explicit").alias("emp_explicit"),
                    employment_type(t, policy="workday").alias("emp_workday"),
                    employment_type(t, policy="short").alias("emp_short"))


# ---------------------------------------------------------------------------
# R01-R04 skills, roles, locations, generated profiles
# ---------------------------------------------------------------------------
def _skills_sql(text: str) -> str:
    items = [f"CASE WHEN regexp_matches(lower({text}), {sql_str(whole_word_re(s))}) THEN {sql_str(s)} END"
             for s in profiles.TECHNICAL_SKILLS]
    return f"list_sort(list_distinct(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)))"


def _roles_sql(text: str) -> str:
    items = [f"CASE WHEN regexp_matches(lower({text}), {sql_str('(?i)' + p)}) "
             f"THEN {sql_str(profiles._role_display(p))} END" for p in profiles.ROLE_PATTERNS]
    return f"list_sort(list_distinct(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)))"


def _locs_sql(text: str) -> str:
    items = [f"CASE WHEN contains(lower({text}), {sql_str(c.lower())}) THEN {sql_str(c)} END"
             for c in profiles.CITIES]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


@register("skills", f"""
SELECT doc_id, array_to_string({_skills_sql('text')}, ',') AS skills,
       array_to_string({_roles_sql('text')}, ',') AS roles,
       array_to_string({_locs_sql('text')}, ',') AS locations
FROM documents
""")
def q_skills(spark, sf_dir):
    d = profiles.lower_stage(spread(read_table(spark, sf_dir, "documents")).select("doc_id", "text"), "text")
    lt = F.col("_lt")
    return d.select("doc_id", F.array_join(profiles.skills(lt, is_lower=True), ",").alias("skills"),
                    F.array_join(profiles.roles(lt, is_lower=True), ",").alias("roles"),
                    F.array_join(profiles.locations(lt, is_lower=True), ",").alias("locations"))


_SENIORITY = ",".join(profiles.SENIORITY_EXCLUDE)


@register("profile_from_text", f"""
WITH x AS (SELECT doc_id, {_roles_sql('text')} AS r, {_skills_sql('text')} AS s, {_locs_sql('text')} AS l
           FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS profile,
  CASE WHEN len(r) > 0 THEN array_to_string(flatten(list_transform(r, lambda y: [y, y || ' Intern', y || ' Internship'])), '|')
       ELSE 'Software Engineer|Software Engineer Intern|Software Developer' END AS desired_roles,
  array_to_string(s[1:10], '|') AS must_have_keywords,
  {sql_str(_SENIORITY)} AS must_not_keywords,
  CASE WHEN len(l) > 0 THEN array_to_string(l, '|') ELSE 'Remote' END AS preferred_locations,
  CASE WHEN list_contains(CASE WHEN len(l) > 0 THEN l ELSE ['Remote'] END, 'Remote') THEN 'remote' END AS remote_preference,
  0.25e0 AS min_score_threshold
FROM x
""")
def q_profile_from_text(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents"))
    p = profiles.profile_from_text(d, "text", "doc_id", max_skills=profiles.MAX_SKILLS)
    return p.select("profile", F.array_join("desired_roles", "|").alias("desired_roles"),
                    F.array_join("must_have_keywords", "|").alias("must_have_keywords"),
                    F.array_join("must_not_keywords", ",").alias("must_not_keywords"),
                    F.array_join("preferred_locations", "|").alias("preferred_locations"),
                    "remote_preference", "min_score_threshold")




# ---------------------------------------------------------------------------
# R05 generated profile + the text's embedding (documents x embeddings by id)
# ---------------------------------------------------------------------------
@register("profile_embedding", f"""
WITH x AS (SELECT doc_id, {_skills_sql('text')} AS s FROM documents)
SELECT CAST(x.doc_id AS VARCHAR) AS profile, array_to_string(s, '|') AS must_have_keywords,
       coalesce(array_to_string(list_transform(CAST(e.embedding AS DOUBLE[]), lambda v: CAST(round(v * 1e6) AS BIGINT)), ','), '') AS embedding_millionths
FROM x LEFT JOIN embeddings e ON e.vec_id = x.doc_id
""")
def q_profile_embedding(spark, sf_dir):
    """All skills of the text, and every number of its vector."""
    d = spread(read_table(spark, sf_dir, "documents")).select("doc_id", "text")
    emb = read_table(spark, sf_dir, "embeddings")
    p = profiles.profile_with_embedding(d, "text", "doc_id", emb, "vec_id")
    millionths = F.transform("resume_embedding", lambda v: F.round(v.cast("double") * 1e6).cast("bigint").cast("string"))
    return p.select("profile", F.array_join("must_have_keywords", "|").alias("must_have_keywords"),
                    F.array_join(millionths, ",").alias("embedding_millionths"))


# ---------------------------------------------------------------------------
# F24 distances of neighbouring fingerprints
# ---------------------------------------------------------------------------
@register("hamming", f"""
WITH {_FP_SQL}
SELECT a.doc_id, bit_count(xor(a.fp, b.fp))::INT AS distance, round(1.0e0 - bit_count(xor(a.fp, b.fp)) / 64.0e0, 6) AS similarity
FROM fp a JOIN fp b ON b.doc_id = a.doc_id + 1
""")
def q_hamming(spark, sf_dir):
    fp = staged_fingerprints(spark, sf_dir)
    a, b = fp.select("doc_id", F.col("fingerprint").alias("a")), fp.select((F.col("doc_id") - 1).alias("doc_id"), F.col("fingerprint").alias("b"))
    return a.join(b, "doc_id").select("doc_id", hamming("a", "b").alias("distance"), F.round(simhash_similarity("a", "b"), 6).alias("similarity"))


def staged_fingerprints(spark, sf_dir):
    """The fingerprints feed both sides of a join: computed once."""
    ensure_checkpoint_dir(spark)
    return doc_fingerprints(spark, sf_dir).select("doc_id", "fingerprint").checkpoint(eager=True)

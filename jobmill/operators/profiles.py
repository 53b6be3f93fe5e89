"""Profile mining from free text (R01-R05): skills, roles, locations, and a generated
profile per text. Vocabularies are literals, so every pattern compiles once per task;
single-word skills are matched by intersecting the text's word set (exactly the
whole-word rule for word-only terms), the rest by whole-word regexes."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_whole_word_pattern

# Skill vocabulary, role patterns, cities, seniority exclusions.
TECHNICAL_SKILLS = [
    "python", "java", "javascript", "typescript", "c++", "c#", "go", "golang",
    "rust", "ruby", "php", "swift", "kotlin", "scala", "r", "matlab", "sql",
    "react", "angular", "vue", "node.js", "nodejs", "django", "flask", "fastapi",
    "spring", "rails", ".net", "tensorflow", "pytorch", "pandas", "numpy",
    "aws", "azure", "gcp", "docker", "kubernetes", "k8s", "terraform", "jenkins",
    "ci/cd", "git", "linux", "unix",
    "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "dynamodb",
    "cassandra", "sqlite",
    "machine learning", "ml", "deep learning", "ai", "data science", "backend",
    "frontend", "full stack", "fullstack", "devops", "sre", "api", "rest",
    "graphql", "microservices", "agile", "scrum",
]
ROLE_PATTERNS = [
    r"software engineer",
    r"backend engineer",
    r"frontend engineer",
    r"full[- ]?stack engineer",
    r"data scientist",
    r"data engineer",
    r"machine learning engineer",
    r"ml engineer",
    r"devops engineer",
    r"sre",
    r"site reliability engineer",
    r"product manager",
    r"engineering manager",
    r"software developer",
    r"web developer",
]
CITIES = [
    "San Francisco", "New York", "Seattle", "Austin", "Boston",
    "Los Angeles", "Chicago", "Denver", "Portland", "Atlanta",
    "San Jose", "Palo Alto", "Mountain View", "Remote",
]
SENIORITY_EXCLUDE = [
    "senior", "sr.", "staff", "principal", "lead", "manager", "director",
    "vp", "head of", "chief", "10+ years", "8+ years", "7+ years",
]
DEFAULT_ROLES = ["Software Engineer", "Software Engineer Intern", "Software Developer"]
GENERATED_THRESHOLD = 0.25
MAX_SKILLS = 10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _role_display(pattern: str) -> str:
    """How a role pattern is shown: its optional separator as a space, words capitalised."""
    words = pattern.split("[- ]?")
    return " ".join(w.title() for part in words for w in part.split(" "))


def _lowered(text, is_lower: bool) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return t if is_lower else F.lower(t)


def lower_stage(df: DataFrame, text_col: str, out: str = "_lt") -> DataFrame:
    """Add the lower-cased text once as a column; Spark keeps this projection apart
    because the column feeds many predicates (so lower() runs once per row)."""
    return df.withColumn(out, F.lower(F.coalesce(F.col(text_col), F.lit(""))))


def skills(text, vocabulary=None, is_lower: bool = False) -> Column:
    """Sorted distinct vocabulary terms found as whole words (case-insensitive)."""
    vocab = list(dict.fromkeys(vocabulary or TECHNICAL_SKILLS))
    t = _lowered(text, is_lower)
    word_terms = [v for v in vocab if re.fullmatch(r"\w+", v)]
    other_terms = [v for v in vocab if v not in word_terms]
    words = F.split(t, r"(?U)\W+")
    found_words = F.array_intersect(words, F.array(*[F.lit(v.lower()) for v in word_terms]))
    # intersect returns the lower-cased text token; map back to the vocabulary spelling
    lower_to_term = {v.lower(): v for v in word_terms}
    if any(k != v for k, v in lower_to_term.items()):
        m = F.create_map(*[x for kv in lower_to_term.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        found_words = F.transform(found_words, lambda w: m[w])
    # A whole-word hit needs the (lower-cased) term as a substring: test that first
    # with a plain byte search and run the Unicode regex only on candidate rows.
    others = (F.array_compact(F.array(*[
        F.when(t.contains(v.lower()) & t.rlike(py_whole_word_pattern(v)), F.lit(v)) for v in other_terms]))
        if other_terms else F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(found_words, others)))


def _role_test(t: Column, pattern: str) -> Column:
    """Plain patterns are substring tests; others are prefiltered by their longest
    literal piece."""
    if not re.search(r"[\\.^$|?*+()\[\]{}]", pattern):
        return t.contains(pattern)
    pieces = [x for x in re.split(r"\[[^\]]*\][?*]?|[\\.^$|?*+(){}]", pattern) if x]
    longest = max(pieces, key=len) if pieces else ""
    return (t.contains(longest) & t.rlike(pattern)) if longest else t.rlike(pattern)


def _sorted_roles():
    """(display, pattern) pairs in display order, so hits come out sorted."""
    return sorted(((_role_display(p), p) for p in ROLE_PATTERNS), key=lambda x: x[0])


def roles(text, is_lower: bool = False) -> Column:
    """Display names of role patterns found (no word boundaries), sorted."""
    t = _lowered(text, is_lower)
    # the text is lower-cased and the patterns are lower case: no (?i) needed, which
    # lets Java's regex use its fast literal search
    hits = [F.when(_role_test(t, p), F.lit(d)) for d, p in _sorted_roles()]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def _roles_with_variants(text, is_lower: bool = False) -> Column:
    """Found roles, each followed by its ' Intern' and ' Internship' variants."""
    t = _lowered(text, is_lower)
    seen, parts = set(), []
    for d, p in _sorted_roles():
        if d in seen:
            continue
        seen.add(d)
        alts = [q for dd, q in _sorted_roles() if dd == d]
        hit = functools.reduce(lambda a, b: a | b, [_role_test(t, q) for q in alts])
        parts.append(F.when(hit, F.array(F.lit(d), F.lit(d + " Intern"), F.lit(d + " Internship")))
                     .otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts))


def locations(text, is_lower: bool = False) -> Column:
    """Cities whose lower-cased name occurs in the lower-cased text, list order."""
    t = _lowered(text, is_lower)
    hits = [F.when(t.contains(c.lower()), F.lit(c)) for c in CITIES]
    return F.array_compact(F.array(*hits))


def profile_from_text(df: DataFrame, text_col: str, name_col: str,
                      add_intern_variants: bool = True, max_skills: int | None = None) -> DataFrame:
    """One generated profile per text row (PROFILE_SCHEMA columns) with all its skills, or the
    first ``max_skills`` (the source tool keeps ``MAX_SKILLS``)."""
    df = lower_stage(df, text_col)
    lt = F.col("_lt")
    r = _roles_with_variants(lt, True) if add_intern_variants else roles(lt, True)
    locs = locations(lt, True)
    found = skills(lt, is_lower=True)
    found = found if max_skills is None else F.slice(found, 1, max_skills)
    # Stage the text-derived arrays as columns first so each regex runs once per row.
    df = df.select("*", r.alias("_r"), locs.alias("_l"), found.alias("_s"))
    desired, locs = F.col("_r"), F.col("_l")
    desired = F.when(F.size(desired) > 0, desired).otherwise(F.array(*[F.lit(x) for x in DEFAULT_ROLES]))
    locs = F.when(F.size(locs) > 0, locs).otherwise(F.array(F.lit("Remote")))
    return df.select(
        F.col(name_col).cast("string").alias("profile"),
        desired.alias("desired_roles"),
        F.col("_s").alias("must_have_keywords"),
        F.array(*[F.lit(x) for x in SENIORITY_EXCLUDE]).alias("must_not_keywords"),
        locs.alias("preferred_locations"),
        F.when(F.array_contains(locs, "Remote"), F.lit("remote")).alias("remote_preference"),
        F.lit(GENERATED_THRESHOLD).alias("min_score_threshold"),
        F.lit(0.55).alias("vector_weight"), F.lit(0.30).alias("keyword_weight"),
        F.lit(0.15).alias("recency_weight"))


def profile_with_embedding(df: DataFrame, text_col: str, name_col: str,
                           embeddings: DataFrame, embed_key: str, embed_col: str = "embedding",
                           df_key: str | None = None) -> DataFrame:
    """Generated profile plus the text's embedding from a precomputed table
    (left join: a text without embedding keeps an empty vector)."""
    prof = profile_from_text(df.select(F.col(df_key or name_col).alias("_k"), name_col, text_col),
                             text_col, name_col)
    keyed = prof.withColumn("_k", F.col("profile"))
    emb = embeddings.select(F.col(embed_key).cast("string").alias("_k"), F.col(embed_col).alias("resume_embedding"))
    return keyed.join(emb, "_k", "left").drop("_k").withColumn(
        "resume_embedding", F.coalesce("resume_embedding", F.array().cast("array<float>")))

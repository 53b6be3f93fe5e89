"""Text column expressions: ids, searchable text, normalization, HTML stripping,
SimHash bit helpers. All are built-in Catalyst expressions (codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def posting_id(company="company", system="source_system", job_id="source_job_id") -> Column:
    """Stable posting id: first 16 hex chars of sha256("company:system:job_id")."""
    key = F.concat_ws(":", _c(company), _c(system), _c(job_id))
    return F.substring(F.sha2(key, 256), 1, 16)


def short_url_id(url="url") -> Column:
    """First 12 hex chars of md5(url)."""
    return F.substring(F.md5(_c(url)), 1, 12)


def searchable_text(title="title", description="description_text",
                    requirements="requirements", department="department") -> Column:
    """Title, then non-empty description, every requirement, non-empty department,
    joined by single spaces."""
    return F.concat_ws(
        " ",
        F.coalesce(_c(title), F.lit("")),
        F.nullif(_c(description), F.lit("")),
        F.coalesce(_c(requirements), F.array().cast("array<string>")),
        F.nullif(_c(department), F.lit("")),
    )


def normalize_text(text="text") -> Column:
    """lower -> drop every char that is neither word char nor whitespace ->
    squash whitespace runs to one space -> trim. Unicode classes via (?U)."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    t = F.regexp_replace(t, r"(?U)[^\w\s]", "")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.trim(t)


def strip_html(html="html") -> Column:
    """Tags -> space, squash whitespace, trim. No entity decoding (script text stays)."""
    t = F.regexp_replace(F.coalesce(_c(html), F.lit("")), r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.trim(t)


def squash_ws(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def word_hash64(word) -> Column:
    """Low 64 bits of md5(word) as a signed bigint (two's complement)."""
    return F.conv(F.substring(F.md5(_c(word)), 17, 16), 16, -10).cast("bigint")


def hamming(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def simhash_similarity(a, b, bits: int = 64) -> Column:
    return F.lit(1.0) - hamming(a, b).cast("double") / F.lit(float(bits))


def fingerprint_bits(fp) -> Column:
    """64-char binary string of a fingerprint (bit 63 first), for reports and oracles."""
    return F.lpad(F.bin(_c(fp)), 64, "0")


def regex_quote(kw) -> Column:
    """Quote a keyword column for use inside a Java regex (\\Q...\\E, with embedded \\E split)."""
    return F.concat(F.lit("\\Q"), F.replace(_c(kw), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def whole_word_pattern(kw) -> Column:
    """Case-insensitive Unicode whole-word pattern for a keyword column. The keyword itself is looked
    for first: a Unicode word boundary is dearer to test than a first character."""
    word = regex_quote(kw)
    return F.concat(F.lit("(?iuU)(?="), word, F.lit(")\\b"), word, F.lit("\\b"))


def py_whole_word_pattern(kw: str) -> str:
    """Same pattern as ``whole_word_pattern`` for a literal keyword."""
    word = "\\Q" + kw.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return f"(?iuU)(?={word})\\b{word}\\b"

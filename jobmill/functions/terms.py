"""Which of many terms stand in a text: one pass of a multi-pattern automaton (Aho-Corasick) per
text, whatever the number of terms.

The automaton works on case-folded text. Where text and term are ASCII, whole words are told by
the characters beside a find; other finds are confirmed by the same regular expression that a
single keyword uses (``whole_word_pattern``). The result is what one regex per term would give."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import whole_word_pattern


class _Fold(dict):
    """Case folding of one code point the way the regex compares: lower(upper(c)), single characters."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        up = c.upper()
        low = (up if len(up) == 1 else c).lower()
        value = self[code] = ord(low[0])
        return value


_FOLD = _Fold()


def fold_case(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


@functools.lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]):
    """The automaton over the folded terms (once per worker), and the terms of each folded form."""
    import ahocorasick

    forms: dict[str, list[str]] = {}
    for t in terms:
        forms.setdefault(fold_case(t), []).append(t)
    made = ahocorasick.Automaton()
    for form, same in forms.items():
        if form:
            made.add_word(form, same)
    made.make_automaton()
    return made if len(made) else None, forms.get("", [])


_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def find_terms(text: str, terms: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(terms that stand in the text as whole words, terms that stand in it in some way). ASCII is
    settled here: a boundary lies between a letter, digit or underscore and anything else."""
    made, empty = _automaton(terms)
    sure, maybe = set(), set(empty)
    if made is None:
        return [], sorted(maybe)
    plain, n = text.isascii(), len(text)
    for end, same in made.iter(fold_case(text)):
        for term in same:
            if not (plain and term.isascii()):
                maybe.add(term)
            elif term not in sure:
                start = end + 1 - len(term)
                left = start > 0 and text[start - 1] in _WORD
                right = end + 1 < n and text[end + 1] in _WORD
                if left != (term[0] in _WORD) and right != (term[-1] in _WORD):
                    sure.add(term)
    return sorted(sure), sorted(maybe)


_FOUND = pa.struct([("sure", pa.list_(pa.string())), ("maybe", pa.list_(pa.string()))])


def term_hits(spark: SparkSession, text: Column, terms) -> Column:
    """The terms (array of strings, ascending) that stand as whole words in ``text``; empty for a
    null text. ``terms`` must fit in memory; they are sent to each executor once."""
    ours = spark.sparkContext.broadcast(tuple(sorted(set(terms))))

    def run(texts: pa.Array) -> pa.Array:
        # equal texts of a batch are searched once
        coded = texts.dictionary_encode()
        each = [dict(zip(("sure", "maybe"), find_terms(t, ours.value))) for t in coded.dictionary.to_pylist()]
        return pa.array(each, _FOUND).take(coded.indices)

    found = F.arrow_udf(run, "sure array<string>, maybe array<string>")(text)
    more = F.filter(found["maybe"], lambda k: F.regexp_like(text, whole_word_pattern(k)))
    return F.coalesce(F.when(F.size(found["maybe"]) > 0, F.array_sort(F.concat(found["sure"], more))).otherwise(found["sure"]),
                      F.array().cast("array<string>"))

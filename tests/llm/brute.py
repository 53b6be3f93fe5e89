"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import collections
import hashlib
import re

AZ = {i: i + 32 for i in range(65, 91)}
GAP_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(raw) -> str:
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


def line_dedup(rows):
    held = collections.defaultdict(set)
    keyed = []
    for i, t in rows:
        lines = [(x, x.strip(" \t\n\x0b\x0c\r").translate(AZ)) for x in (t or "").split("\n")]
        keyed.append((i, lines))
        for _, k in lines:
            if len(k) >= 10:
                held[k].add(i)
    out = []
    for i, lines in keyed:
        kept = [x for x, k in lines if not (len(held.get(k, ())) > 1 and min(held[k]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def repeated_strings(rows, length=400):
    raws = [(i, (t or "").encode()) for i, t in rows]
    n = collections.Counter(r[p:p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = [False] * len(r)
        for p in range(len(r) - length + 1):
            if n[r[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), spans, sha(bytes(b for b, g in zip(r, gone) if not g))))
    return out


def shingles(t, k):
    w = GAP_WORD.findall((t or "").translate(AZ))
    return frozenset(tuple(w[a:a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_groups(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(s), least[find(a)], least[find(a)] == i) for a, (i, s) in enumerate(sets)]


def contamination(docs, items, window=13):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(AZ))
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[a:a + k])].add(str(i))
    out = []
    for i, t in docs:
        w = ITEM_WORD.findall((t or "").translate(AZ))
        hit, found = [0] * len(w), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in wins:
                    found |= wins[tuple(w[a:a + k])]
                    hit[a:a + k] = [1] * k
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def word_counts(t):
    t = t or ""
    w = GAP_WORD.findall(t)
    grams = [tuple(w[a:a + 3]) for a in range(len(w) - 2)]
    n = collections.Counter(grams)
    inside = {a + o for a, g in enumerate(grams) if n[g] > 1 for o in range(3)}
    lines = [x for x in t.split("\n") if GAP_WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside),
            len(w) < 50 or 100 * len(inside) > 50 * len(w))

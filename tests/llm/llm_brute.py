"""Brute-force statements of the operators, shared by the tests."""

import collections
import hashlib
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def brute_classes(docs):
    """Classes by the alignment of the words of all pairs; id -> class id."""
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = [(i, w, collections.Counter(w)) for i, t in docs if (w := WORDS.findall(t or ""))]
    for n, (i, a, in_a) in enumerate(texts):
        for j, b, in_b in texts[n + 1 :]:
            # no alignment has more words than the texts have in common in any order
            if min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or 1.8 * (in_a & in_b).total() < 0.8 * (len(a) + len(b)) - 1e-6:
                continue
            c = brute_common(a, b)
            if c / (len(a) + len(b) - c) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def brute_repeats(docs, size=13):
    first = {}
    for i, t in sorted((i, t) for i, t in docs if i is not None):
        w = WORDS.findall(t or "")
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    out = []
    for i, t in docs:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j : j + size])] < i:
                gone[j : j + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def toks(text):
    return LETTERS.findall((text or "").translate(UPPER))


def brute_leaks(docs, items, size=10):
    at = collections.defaultdict(set)
    for i, t in items:
        w = toks(t)
        if 0 < len(w) < size:
            at[tuple(w)].add(i)
        for j in range(len(w) - size + 1):
            at[tuple(w[j : j + size])].add(i)
    out = []
    for i, t in docs:
        w = toks(t)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in at}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in at:
                    hit[j : j + n] = [True] * n
                    found |= at[tuple(w[j : j + n])]
        out.append((i, len(w), sum(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=str)

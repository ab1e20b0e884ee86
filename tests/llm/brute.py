"""Plain reference versions of the operators for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substring_words(texts, length):
    split = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[k:k + length]) for w in split for k in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k:k + length])] > 1:
                gone[k:k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def substring_bytes(rows, length):
    """rows: (doc_id or None, text or None); equal places are not earlier than one another."""
    far = 2**63 - 1
    raw = [(far if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            first[w] = min(first.get(w, (far, far)), (i, k))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < (i, k):
                gone[k:k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(rows, n, pct):
    """(n_shingles, component) by position in rows (doc_id, text); doc_ids are distinct."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = min(least.get(r, i), i)
    return [(len(sets[k]), least[root(k)]) for k in range(len(rows))]


def edit_distance_in(item, text):
    """Least edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            before, row[j] = row[j], min(before + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def smallest_capacity(sizes, shards):
    low, high = max([1, *sizes]), max(1, sum(sizes))
    while low < high:
        mid, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > mid:
                used, held = used + 1, 0
            held += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low

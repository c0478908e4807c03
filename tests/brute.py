"""Plain-Python definitions that the Spark operators are compared with."""

import math


def norm(values):
    ordered = sorted(values)
    return tuple(ordered.index(x) + 1 for x in values)


def occurrences(t, m, k):
    """{pattern: [(pos, weight)]} of all windows of m distinct values, positions from 1."""
    out = {}
    for end in range(m, len(t) + 1):
        w = t[end - m : end]
        if len(set(w)) == m and not any(math.isnan(x) for x in w):
            out.setdefault(norm(w), []).append((end, math.exp(-k * (len(t) - end))))
    return out


def closure(t, sigma, k=None, threshold_only=False, max_len=None):
    k = 1 / len(t) if k is None and t else k
    found, parents, m = {}, None, 2
    while m <= len(t) and (max_len is None or m <= max_len):
        level = {}
        for p, at in occurrences(t, m, k).items():
            support = sum(w for _, w in at)
            if support >= sigma and (threshold_only or parents is None or norm(p[:-1]) in parents and norm(p[1:]) in parents):
                level[p] = support
        if not level:
            break
        found.update(level)
        parents, m = level, m + 1
    return found

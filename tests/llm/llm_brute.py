"""Plain-Python definitions of the contract results."""

import re

DATA = "/root/testdata/sf0.001"
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall((text or "").encode().lower())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def shingles(text, k=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard_components(texts):
    """texts: {id: text}; (sizes, components)."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(ids, links)


ITEM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(text, items, n=10):
    """(words, hit words, items) of one text."""
    w = ITEM.findall((text or "").encode().lower())
    on, names = set(), set()
    for item, t in items:
        v = ITEM.findall((t or "").encode().lower())
        size = min(n, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1 if v else 0):
            if tuple(w[i : i + size]) in windows:
                on.update(range(i, i + size))
                names.add(str(item))
    return len(w), len(on), sorted(names)

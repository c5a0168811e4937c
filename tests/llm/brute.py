"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows):
    """rows (doc_id, text), ids distinct: {doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t) for i, t in rows}
    where, shared = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        for pair in combinations(sorted(ids), 2):
            shared[pair] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    found = roots(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}

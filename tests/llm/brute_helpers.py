"""Brute force shared by the tests."""

from __future__ import annotations

from collections import defaultdict


def brute_kept(rows):
    """Ids that stay when one document of each group of near duplicates does."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(sets)
    near = defaultdict(set)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    out, seen = [], set()
    for a in ids:
        if a not in seen:
            out.append(a)
            stack = [a]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += near[x]
    return out

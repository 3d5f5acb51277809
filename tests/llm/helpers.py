"""Plain-loop versions that the operators are compared with."""

from __future__ import annotations

import itertools
import math
import re

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def grouped(nodes, links):
    """Least member of each node's component."""
    least = {n: n for n in nodes}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        least[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def text_links(texts, width, hundredths):
    """Pairs of keys of ``texts`` whose shingle sets are similar enough."""
    sets = {k: shingle_set(t, width) for k, t in texts.items()}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= hundredths * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= hundredths * (len(x) + len(y) - both):
                yield a, b


def cosine(x, y):
    usable = all(v and None not in v and all(map(math.isfinite, v)) and any(v) for v in (x, y))
    if not usable:
        return -2.0
    return sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x)) / math.sqrt(sum(b * b for b in y))

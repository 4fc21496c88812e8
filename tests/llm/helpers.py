from __future__ import annotations

import random
import re

WORDS = [a + b for a in "ka lo mi ru ten sol bar vin".split() for b in "da ne fi go tur lan mo per zi".split()]
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return [w for w in re.split(f"[{BLANKS}]+", text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    w = text.split()
    for _ in range(edits):
        at = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.34:
            w[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.67:
            w.insert(at, f"add{rng.randrange(10**6)}")
        elif len(w) > 1:
            del w[at]
    return " ".join(w)


def components(nodes, linked):
    """Least node of each one's component, by comparing all pairs."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if find(a) != find(b) and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}

"""Plain versions of the operators, row by row, that the tests compare with."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def line_dedup(rows, min_docs=3, min_chars=20):
    """[(id, text)] to [(id, kept text, lines, dropped)]."""
    key = lambda x: lower(x.strip(BLANKS))
    holders, last = collections.defaultdict(set), {}
    low = lambda i: (i is not None, i or 0)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].add(i)
            last[k] = max(last.get(k, i), i, key=low)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and last[key(x)] != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def shingles(text, width=5):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(rows):
    """[(id, text)] to {id: component}, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    at = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(at)


def edits(want, text):
    """Fewest edits between ``want`` and any stretch of ``text``."""
    d = list(range(len(want) + 1))
    best = d[-1]
    for c in text:
        n = [0]
        for k, x in enumerate(want):
            n.append(min(d[k] + (x != c), d[k + 1] + 1, n[k] + 1))
        d = n
        best = min(best, d[-1])
    return best


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()

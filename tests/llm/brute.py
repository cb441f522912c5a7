"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict


def suffix_dedup(docs, length=100):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        b = (text or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                cover[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(c and not before for c, before in zip(cover, b"\0" + bytes(cover)))
        out[doc] = (len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, n=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def ngram_join(docs):
    sets = {d: shingles(t) for d, t in docs}
    parts = join(sets)
    return {d: (len(s), parts[d]) for d, s in sets.items()}


def join(sets):
    """The smallest id that each can reach over links of similarity 0.8."""
    having, top = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            having[x].append(d)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for d, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for e in having[x]:
                both[e] += e < d
        for e, n in both.items():
            if e < d and 100 * n >= 80 * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                top[b] = a
    return {d: find(d) for d in sets}

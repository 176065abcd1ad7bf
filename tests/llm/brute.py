"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def substring(docs: dict[int, str | None], window: int = 20) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for i in sorted(docs):
        w = words(docs[i])
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def bytes_(docs: dict[int, str | None], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen, out = set(), {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            key = b[k : k + length]
            if key in seen:
                gone[k : k + length] = [True] * length
            seen.add(key)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def simhash(docs: dict[int, str | None], distance: int = 2) -> dict[int, tuple[int, int]]:
    import xxhash

    prints = {}
    for i, text in docs.items():
        lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        w = WORD.findall(lowered)
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {i: i for i in prints}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (prints[i], root(i)) for i in prints}


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    t = text or ""
    w = [x.decode() for x in words(t)]
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    covered = {k + j for k, x in enumerate(grams) if grams.count(x) > 1 for j in range(5)}
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), repeated, len(covered), n < 10 or 100 * len(covered) > 20 * n

"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def joined(n, links):
    """The smallest member reachable, for each of range(n)."""
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def fingerprint(text, k=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def simhash(rows, k=3):
    rows = sorted(rows)
    fps = [fingerprint(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    low = joined(len(rows), links)
    return {(d, f"{fps[i]:016x}", rows[low[i]][0]) for i, (d, _) in enumerate(rows)}


def substrings(rows, n=13):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out

"""Plain versions of what the operators do, for small inputs."""

import hashlib
import re
from collections import defaultdict


def shingle_sets(docs):
    out = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def jaccard(docs):
    """{id: (set size, least id of its component)}."""
    sets = shingle_sets(docs)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k in sorted(sets):
        shared = defaultdict(int)
        for g in sets[k]:
            for j in where[g]:
                shared[j] += 1
            where[g].append(k)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[k]) + len(sets[j]) - n):
                a, b = sorted((root(j), root(k)))
                parent[b] = a
    return {k: (len(s), root(k)) for k, s in sets.items()}


def repeated(docs, length=100):
    """{id: mask of removed bytes}."""
    seen, out = set(), {}
    for k, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out[k] = (b, gone)
    return out


def removal(docs, length=100):
    out = {}
    for k, (b, gone) in repeated(docs, length).items():
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[k] = (len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def jump(key, shards):
    """Lamping and Veach, with unbounded integers."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b

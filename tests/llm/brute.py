"""Plain single-threaded versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def suffix_dedup(docs: list[tuple], window: int = 400) -> set[tuple]:
    """docs: (doc_id, text)."""
    seen: dict[bytes, int] = {}
    raws = [(d, (t or "").encode()) for d, t in docs]
    for _, r in raws:
        for i in range(len(r) - window + 1):
            w = r[i : i + window]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = True
        gone[len(r) :] = False
        n_spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((d, len(r), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def substring_dedup(docs: list[tuple], window: int = 20) -> list[tuple]:
    first: dict[tuple, tuple] = {}
    ws = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in ws:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def simhash(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash_components(docs: list[tuple], radius: int = 4) -> list[tuple]:
    f = [simhash(t) for _, t in docs]
    v = np.array(f, np.uint64)
    up = list(range(len(f)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= radius).tolist():
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f"{f[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(docs))

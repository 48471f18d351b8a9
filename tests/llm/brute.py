"""Plain versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash


def lower(raw: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def words(raw: bytes) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


def base_scores(docs: dict[int, str | None]) -> dict[int, tuple]:
    toks = {i: [*words(lower((t or "").encode())), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in toks.items()}


def window_dedup(docs: dict[int, str | None], width: int = 50) -> dict[int, tuple[int, int, str]]:
    toks = {i: words((t or "").encode()) for i, t in docs.items()}
    least: dict[tuple, int] = {}
    for i, ws in toks.items():
        for p in range(len(ws) - width + 1):
            w = tuple(ws[p : p + width])
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, ws in toks.items():
        gone = [False] * len(ws)
        for p in range(len(ws) - width + 1):
            if least[tuple(ws[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out[i] = (len(ws), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def simhash(text: str | None) -> int:
    ws = words(lower((text or "").encode()))
    grams = [b" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [b" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fp: dict[int, int], radius: int = 4) -> dict[int, int]:
    ids = sorted(fp)
    arr = np.array([fp[i] for i in ids], np.uint64)
    seen: dict[int, int] = {}
    for k, i in enumerate(ids):
        if i in seen:
            continue
        front, seen[i] = [k], i
        while front:
            x = front.pop()
            for j in np.flatnonzero(np.bitwise_count(arr ^ arr[x]) <= radius).tolist():
                if ids[j] not in seen:
                    seen[ids[j]] = i
                    front.append(j)
    return seen


def nearest(vectors: dict[int, list], queries: list[int], k: int = 10) -> dict[int, list[tuple[int, float]]]:
    good = {i: np.array(v, float) for i, v in vectors.items() if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            out[q] = sorted(((i, float(np.sqrt(((x - good[q]) ** 2).sum()))) for i, x in good.items() if i != q and len(x) == len(good[q])), key=lambda p: (p[1], p[0]))[:k]
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    t = text or ""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))

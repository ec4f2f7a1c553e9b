"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def substring_dedup(rows, window=13):
    words = [(d, SPACE.findall((t or "").encode())) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None and d < first.get(key, d + 1):
                first[key] = d
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def fingerprint(text):
    words = SPACE.findall((text or "").translate(LOWER).encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def near_duplicates(rows):
    fps = [(d, fingerprint(t)) for d, t in rows]
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in fps]


def contamination(rows, items, window=10):
    windows = {}
    for item, text in items:
        w = TERM.findall((text or "").translate(LOWER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    lengths = sorted({len(w) for w in windows})
    out = []
    for d, text in rows:
        w = TERM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def line_dedup(rows, min_sites=10):
    sites, first = {}, {}
    big = float("inf")
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line, set()).add(s)
                first[line] = min(first.get(line, big), big if d is None else d)
    out = []
    for d, t, _ in rows:
        kept, seen = [], set()
        lines = [] if t is None else t.split("\n")
        for line in lines:
            bad = line.strip(" ") and len(sites[line]) >= min_sites
            mine = first.get(line) == (big if d is None else d)
            if not bad or (mine and line not in seen):
                kept.append(line)
            seen.add(line)
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(rows):
    out = []
    for d, t in rows:
        t = t or ""
        found = [
            [m.span() for m in ASSIGN.finditer(t) if len(m[1]) >= 6],
            [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20],
            [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24],
        ]
        spans = sorted((a, k, b) for k, s in enumerate(found) for a, b in s)
        out.append((d, *map(len, found), sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans))))
    return out


def top_k(vectors, k=10):
    import math

    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        mine = min(v for i, v in ok if i == q)
        scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return out


def pieces(rows, capacity=1024, end=2):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        n = len(ids)
        starts = [0] if n <= capacity else [0, *range(n % capacity or capacity, n, capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
            out.append((d, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))))
    return out

"""Plain statements of the contracts."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEY = lambda k: (k is not None, k or 0)


def norm(text):
    return (text or "").translate(ASCII_LOWER)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def exact(pairs):
    groups = defaultdict(list)
    for k, t in pairs:
        groups[norm(t)].append(k)
    out = []
    for t, ks in groups.items():
        keep, left = max(ks, key=KEY), True
        for k in ks:
            stays = k == keep and left
            left = left and not stays
            out.append((k, keep, len(ks), stays, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def fingerprint(text):
    w = words(norm(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, bits=2):
    """Class number of each fingerprint."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def simhash(pairs):
    fps = [fingerprint(t) for _, t in pairs]
    roots, least = classes(fps), {}
    for r, (k, _) in zip(roots, pairs):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return [(k, f"{f:016x}", least.get(r)) for (k, _), f, r in zip(pairs, fps, roots)]


def first_of_classes(pairs):
    """The rows that stay of each class: smallest key, null keys last, then smallest text hash."""
    def order(pair):
        k, t = pair
        h = xxhash.xxh64_intdigest((t or "").encode(), seed=42)
        return k is None, k or 0, h - (1 << 64) if h >> 63 else h
    first = {}
    for r, pair in zip(classes([fingerprint(t) for _, t in pairs]), pairs):
        first[r] = min(first.get(r, pair), pair, key=order)
    return {(k, t or "") for k, t in first.values()}


def repeats(pairs, width=100):
    """Per row (in order of key and text) its bytes, a mask of removed ones."""
    order = sorted(range(len(pairs)), key=lambda i: (KEY(pairs[i][0]), (pairs[i][1] or "").encode()))
    seen, out = set(), {}
    for i in order:
        raw = (pairs[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            s = raw[p:p + width]
            if s in seen:
                gone[p:p + width] = b"\x01" * width
            else:
                seen.add(s)
        out[i] = (raw, bytes(gone))
    return [out[i] for i in range(len(pairs))]


def repeat_row(key, raw, gone):
    kept = bytes(c for c, g in zip(raw, gone) if not g)
    return (key, len(raw), sum(gone), len(re.findall(b"\x01+", gone)), hashlib.sha256(kept).hexdigest())


def quality(text):
    w = words(text)
    grams = list(zip(w, w[1:], w[2:]))
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)

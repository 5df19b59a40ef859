"""Plain models of the query contracts, one text or one pair at a time."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def op1(text):
    t = text or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(wins), set()
    for i, w in enumerate(wins):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def op2(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def op3(lib, text):
    ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    return [(p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]


def whole_characters(texts, threshold=200):
    """Texts without the characters of which any byte is in a repeated string."""
    out = []
    for t, gone in zip(texts, repeated(texts, threshold), strict=True):
        at, kept = 0, []
        for c in t or "":
            n = len(c.encode())
            kept += [] if gone[at : at + n].any() else [c]
            at += n
        out.append(None if t is None else "".join(kept))
    return out


def repeated(texts, threshold=200):
    """Of each text a mask over its bytes, and one more that is never set."""
    data = [(t or "").encode() for t in texts]
    name = lambda b, i: hashlib.blake2b(b[i : i + threshold], digest_size=16).digest()
    count = Counter(name(b, i) for b in data for i in range(len(b) - threshold + 1))
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - threshold + 1):
            if count[name(b, i)] > 1:
                gone[i : i + threshold] = True
        yield gone


def op5(texts, threshold=200):
    data, out = [(t or "").encode() for t in texts], []
    for b, gone in zip(data, repeated(texts, threshold), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def op9(rows):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{prints[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows)]

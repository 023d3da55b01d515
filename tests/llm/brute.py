"""Plain versions of the operators, for small inputs only."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def sha256(value):
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


def lines_kept(rows, min_docs=10, min_chars=1):
    """``rows`` of id and text; returns number of lines and kept lines of each."""
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    split = [(t or "").split("\n") for _, t in rows]
    df = Counter(k for ls in split for k in {key(x) for x in ls})
    gone = {k for k, n in df.items() if n >= min_docs and len(k) >= min_chars}
    return [(len(ls), [x for x in ls if key(x) not in gone]) for ls in split]


def repeats_removed(texts, length):
    """Remaining bytes, number removed and number of runs for each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i : i + length]) for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((bytes(c for c, g in zip(b, gone, strict=True) if not g), sum(gone), runs))
    return out


def fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, links):
    """The smallest id reachable from each."""
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def near_components(rows, radius=3, size=3):
    fps = {i: fingerprint(t, size) for i, t in rows}
    ids = sorted(fps)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fps[a] ^ fps[b]).bit_count() <= radius]
    return fps, components(ids, links)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(texts, items, width=10):
    """Words, hit words and item ids for each text."""
    owners = defaultdict(set)
    for ident, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            owners[tuple(w[i : i + width])].add(ident)
    sizes = {len(p) for p in owners}
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in owners:
                    hit |= set(range(i, i + n))
                    found |= owners[p]
        out.append((len(w), len(hit), sorted(found - {None})))
    return out


def poisson_copies(ident, rate, seed, part=0):
    """Inverse Poisson distribution at the uniform number of the id and the part."""
    tail = f":{part}" if part else ""
    digest = hashlib.md5(f"{seed}:{'' if ident is None else ident}{tail}".encode()).hexdigest()
    u, k, p = int(digest[:13], 16) / 16**13, 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k

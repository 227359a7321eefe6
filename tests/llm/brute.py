"""Plain single-machine versions of the operators, for comparison. Rows are (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
PATTERNS = {
    "assign": re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    found = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            long = {"assign": lambda: len(m[2]) >= 8, "access": lambda: len(m[0]) >= 16, "hex": lambda: len(m[0]) >= 32}[kind]()
            if long:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    found.sort()
    n = Counter(k for _, k, _ in found)
    return n[0], n[1], n[2], hashlib.sha256(",".join(s for *_, s in found).encode()).hexdigest()


def simhash(text, shingle=4):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def near_components(rows, radius=4):
    fps = [simhash(t) for _, t in rows]
    v = np.array(fps, np.uint64)
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                comp[b] = a
    low = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (low[r] is None or d < low[r]):
            low[r] = d
    return [(d, f"{fps[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows)]


def line_dedup(rows, window=3):
    seen, out = set(), []
    for d, t in sorted(rows):
        lines = (t or "").split("\n")
        gone = set()
        for i in range(len(lines) - window + 1):
            w = tuple(lines[i : i + window])
            if not any(s.strip(" \t\n\r\x0b\x0c") for s in w):
                continue
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out.append((d, len(lines), len(gone), "\n".join(s for i, s in enumerate(lines) if i not in gone)))
    return out


def substring_dedup(rows, window=20):
    seen, out = set(), []
    for d, t in sorted((d, t or "") for d, t in rows):
        words = WORD.findall(t)
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        kept = " ".join(s for i, s in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = defaultdict(list)
    for i in range(len(words) - 4):
        grams[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def judge(rows, reject=0.5, trust=0.5):
    """Rows are (doc_id, text, host): (doc_id, failed rules, kept)."""
    tests = {
        "short": lambda n, chars, symbols, dups, repeats, lines: n < 10,
        "repeats": lambda n, chars, symbols, dups, repeats, lines: repeats * 5 > n,
        "symbols": lambda n, chars, symbols, dups, repeats, lines: symbols * 10 > n,
        "lines": lambda n, chars, symbols, dups, repeats, lines: dups * 2 > lines,
        "word_length": lambda n, chars, symbols, dups, repeats, lines: chars < 2 * n or chars > 12 * n,
    }
    failed = []
    for _, t, _ in rows:
        m = (*quality(t)[:5], len([s for s in (t or "").split("\n") if WORD.search(s)]))
        failed.append([r for r, f in tests.items() if f(*m)])
    hosts = {h: [f for f, (_, _, g) in zip(failed, rows, strict=True) if g == h] for h in {h for *_, h in rows}}
    rate = defaultdict(dict)
    mean = {}
    for r in tests:
        raw = [sum(r in f for f in x) / len(x) for x in hosts.values()]
        m = min(max(sum(raw) / len(raw), 1e-6), 1 - 1e-6)
        v = sum((x - sum(raw) / len(raw)) ** 2 for x in raw) / len(raw)
        w = m * (1 - m) / v - 1 if v else 0
        w = w if 0 < w < 1e9 else 2.0
        mean[r] = m
        for h, x in hosts.items():
            rate[h][r] = (sum(r in f for f in x) + m * w) / (len(x) + w)
    out = []
    for (d, _, h), f in zip(rows, failed, strict=True):
        bad = h is not None and max(rate[h].values()) > reject
        good = {r for r in tests if r not in ("short", "repeats") and h is not None and rate[h][r] < trust * mean[r]}
        out.append((d, ",".join(f), not bad and not set(f) - good))
    return out


def leaks(rows, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for k, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add("" if k is None else str(k))
    sizes = sorted({len(w) for w in windows})
    out = []
    for d, t in rows:
        w = cut(t)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (s := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[s]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def base_scores(rows):
    cut = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in cut(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in cut(t))) for d, t in rows]


def codes(rows: list[tuple], parts: int = 8, size: int = 16, rounds: int = 6) -> tuple[list[tuple], list]:
    """Product codes by looking at every entry: ((vec_id, label, code, error) by row, entries)."""
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = max(1, -(-max(len(q) for _, _, q in kept) // parts))
    full = [(i, lab, q + [0] * (parts * width - len(q))) for i, lab, q in kept]
    cut = [[q[p * width : (p + 1) * width] for p in range(parts)] for _, _, q in full]
    first = sorted(range(len(full)), key=lambda r: (full[r][0] is None, full[r][0] or 0, kept[r][2]))[:size]
    books = [[list(cut[r][p]) for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, lab, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, lab, _), f in zip(full, assign(), strict=True)], books


def licence_rules(idents: list, rules, gap: int) -> tuple[list[str], list[tuple[int, int]]]:
    """Licences and their (first, last) sentences in a list of identifiers (None: unknown), by looking through the list for every rule and start."""
    used: set[int] = set()
    out = []
    for licence, wanted in rules:
        for at in range(len(idents)):
            if idents[at] != wanted[0] or at in used:
                continue
            chain = [at]
            for want in wanted[1:]:
                later = [q for q in range(chain[-1] + 1, len(idents)) if idents[q] == want and q not in used]
                if not later or later[0] - chain[-1] - 1 > gap:
                    break
                chain.append(later[0])
            else:
                used |= set(chain)
                out.append((chain[0], chain[-1], licence))
    out.sort(key=lambda x: x[:2])
    return [x[2] for x in out], [x[:2] for x in out]


def rendezvous(key: str, shards: int) -> int:
    """The shard with the highest score -1 / ln(u); ties to the larger number."""
    scores = []
    for shard in range(shards):
        h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(key.encode(), seed=42)) >> 11
        scores.append((-1.0 / math.log((h + 0.5) / (1 << 53)), shard))
    return max(scores)[1]

"""Peaks of a score profile, replayed step by step on plain lists: the tests' oracle."""

from __future__ import annotations

import math


def multiple(ratio: float, tolerance: float, most: int):
    if not math.isfinite(ratio):
        return None
    n = int(ratio + 0.5)
    return n if 2 <= n <= most and abs(ratio - n) <= tolerance * n else None


def _explained(period, score_of, bases, tolerance, most, falling):
    """Every base that explains a period, as (relative error, distance, n, -score, base)."""
    out = []
    for base in bases:
        n = multiple(base / period if falling else period / base, tolerance, most)
        if n:
            due = base / n if falling else base * n
            off = abs(period - due)
            out.append((off / (due * tolerance), off, n, -score_of[base], base))
    return out


def _choose(options):
    """The first by relative error, distance, n and score; differences of errors and distances under 1e-12 count as none, the earlier one then stays ahead."""
    best = None
    for o in options:
        if best is None:
            best = o
            continue
        for i in (0, 1):
            if abs(o[i] - best[i]) > 1e-12:
                if o[i] < best[i]:
                    best = o
                break
        else:
            if o[2:4] < best[2:4]:
                best = o
    return best


def classify(candidates, tolerance=0.02, most=30, falling=False):
    """{period: (kind, parent, n, ladder)} of (period, score) candidates with different periods."""
    order = sorted(candidates, key=lambda c: (-c[1], c[0]))
    score_of = dict(order)
    bases: list = []
    parent: dict = {}
    for period, _ in order:
        hit = _choose(_explained(period, score_of, bases, tolerance, most, falling))
        if hit:
            parent[period] = (hit[4], hit[2])
        else:
            bases.append(period)
    # A fundamental that is another's multiple takes its own harmonics along.
    changed = True
    while changed:
        changed = False
        for f in bases:
            for g in bases:
                if f != g and (n := multiple(g / f if falling else f / g, tolerance, most)):
                    parent = {p: ((g, m * n) if b == f else (b, m)) for p, (b, m) in parent.items()}
                    parent[f] = (g, n)
                    bases.remove(f)
                    changed = True
                    break
            if changed:
                break
    ladders: dict = {b: set() for b in bases}
    for period, _ in order:
        if period in parent and (hit := _choose(_explained(period, score_of, bases, tolerance, most, falling))):
            parent[period] = (hit[4], hit[2])
            ladders[hit[4]].add(hit[2])
    return {p: ("fundamental", None, None, sorted(ladders[p])) if p in ladders else ("harmonic", *parent[p], []) for p, _ in order}


def profile_peaks(x, base, min_score, min_harmonics=1, boundary=0.9, subrepeat=None, most_divisor=6, near=2):
    """Rows (period, score, kind, parent, harmonic_n, divisor_n, n_harmonics, harmonics) of a dense profile."""
    top = base + len(x) - 1
    cap = math.inf if boundary >= 1 else int(top * boundary)
    peak = lambda i: 0 < i < len(x) - 1 and x[i] > x[i - 1] and x[i] > x[i + 1]
    found = [(float(base + i), x[i]) for i in range(len(x)) if peak(i) and x[i] >= min_score and base + i <= cap]
    kinds = classify(found)
    rows = []
    for period, score in found:
        kind, parent, n, ladder = kinds[period]
        if kind == "fundamental" and subrepeat is not None:
            for d in range(2, most_divisor + 1):
                target = int(period / d + 0.5)
                if target < 3:
                    break
                places = [k for k in range(target - near, target + near + 1) if max(3, base) <= k <= top]
                if not places:
                    continue
                at = max(places, key=lambda k: (x[k - base], -k))
                s, i = x[at - base], at - base
                left = x[i - 1] if i > 0 else -math.inf
                right = x[i + 1] if i + 1 < len(x) else -math.inf
                if s >= subrepeat and s > left and s > right and float(at) not in kinds:
                    rows.append((float(at), s, "subrepeat", period, None, d, None, []))
        if kind == "harmonic" or len(ladder) >= min_harmonics:
            rows.append((period, score, kind, parent, n, None, len(ladder) if kind == "fundamental" else None, ladder))
    return rows

"""Plain Python versions of the text operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
SECRETS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
]


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_pii(kind: str, m: re.Match) -> bool:
    digits = re.sub("[^0-9]", "", m[0])
    if kind == "ip":
        return all(int(p) <= 255 for p in m[0].split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def is_secret(kind: str, m: re.Match) -> bool:
    return len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24)


def base_spans(text: str | None, rules, valid) -> str:
    found = [
        (m.start(), i, m.end(), kind)
        for i, (kind, pattern) in enumerate(rules)
        for m in re.finditer(pattern, text or "")
        if valid(kind, m)
    ]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def remove_repeats(rows: list[tuple], length: int = 50) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text)."""
    last = 1 << 63
    data = [(last if i is None else i, i, (t or "").encode()) for i, t in rows]
    least: dict = {}
    for key, _, raw in data:
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            least[s] = min(least.get(s, key), key)
    out = []
    for key, i, raw in data:
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < key:
                gone[p : p + length] = [True] * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, sha(kept)))
    return out


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(ASCII_LOWER))


def shingles(text: str | None, n: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_components(rows: list[tuple], n: int, percent: int) -> dict:
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x])
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def bm25(rows: list[tuple], queries: list, k: int) -> dict:
    counts = {i: Counter(words(t)) for i, t in rows}
    lengths = {i: sum(c.values()) for i, c in counts.items()}
    mean = max(1.0, sum(lengths.values()) / len(counts))
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for q in queries:
        score: dict = defaultdict(float)
        for w, qtf in counts[q].items():
            idf = math.log(1 + (len(counts) - df[w] + 0.5) / (df[w] + 0.5))
            for i, c in counts.items():
                if w in c:
                    score[i] += qtf * idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
        out[q] = sorted(((i, round(s, 6)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))[:k]
    return out


def edits_within(item: str, text: str) -> int:
    """Least edit distance of ``item`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i, *[0] * len(text)]
        for j, d in enumerate(text, 1):
            row[j] = min(before[j - 1] + (c != d), before[j] + 1, row[j - 1] + 1)
    return min(row)

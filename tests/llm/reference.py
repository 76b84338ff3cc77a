"""Plain versions of what the operators must give, for small tables."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    """Smallest node reachable from each node."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(low[a], low[b])
            if low[a] != least or low[b] != least:
                low[a] = low[b] = least
                changed = True
    return low


def shingle_set(text, words):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return frozenset()
    n = min(words, len(found))
    return frozenset(tuple(found[i:i + n]) for i in range(len(found) - n + 1))


def near_groups(texts: dict, words: int, percent: int):
    """Set sizes and component per key."""
    sets = {k: shingle_set(t, words) for k, t in texts.items()}
    keys = sorted(sets)
    links = []
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    return {k: len(s) for k, s in sets.items()}, components(keys, links)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def bm25(texts: list, query: str, k1=1.2, b=0.75):
    """Score of each text for the bag of words of a query."""
    import math
    bags = [Counter(re.findall(r"\w+", (t or "").lower())) for t in texts]
    n, sizes = len(bags), [sum(c.values()) for c in bags]
    average = max(1.0, sum(sizes) / max(1, n))
    df = Counter(w for c in bags for w in c)
    out = []
    for bag, size in zip(bags, sizes):
        s = 0.0
        for w, times in Counter(re.findall(r"\w+", (query or "").lower())).items():
            if w in bag:
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                s += times * idf * bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * size / average))
        out.append(s)
    return out

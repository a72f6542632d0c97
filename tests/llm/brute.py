"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    common = defaultdict(int)
    for ids in where.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] += 1
    for (a, b), o in common.items():
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in sets}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact(rows):
    """doc_id -> (keep_id, size, sha) of (doc_id, text) with distinct ids."""
    g = defaultdict(list)
    for i, t in rows:
        g[normal(t)].append(i)
    return {i: (min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in g.items() for i in ids}


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    out = []
    for k, r in BASE.items():
        for m in r.finditer(text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or k == "card" and 12 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], list(BASE).index(x[2])))

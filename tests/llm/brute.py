"""Plain Python versions of the corpus operators."""

import hashlib
import re

UPPER = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(UPPER)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_duplicates(docs, k, share):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    linked = lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])
    return components(list(docs), linked)


def line_key(line):
    return low(line.strip(" \t\n\x0b\x0c\r"))


def line_dedup(docs):
    owner, out = {}, {}
    for i in sorted(docs):
        for line in (docs[i] or "").split("\n"):
            owner.setdefault(line_key(line), i)
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < 10 or owner[line_key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def contamination(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for name, t in items:
        w = split(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(name))
    out = {}
    for i, t in docs.items():
        w, hit, names = split(t), set(), set()
        for win, who in windows.items():
            n = len(win)
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) == win:
                    hit.update(range(j, j + n))
                    names |= who
        out[i] = (len(w), len(hit), sorted(names))
    return out


def repeated_bytes(docs, n=50):
    first = {}
    for i, t in docs.items():
        b = (t or "").encode()
        for j in range(len(b) - n + 1):
            first[b[j : j + n]] = min(i, first.get(b[j : j + n], i))
    out = {}
    for i, t in docs.items():
        b = (t or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - n + 1):
            if first[b[j : j + n]] < i:
                gone[j : j + n] = [True] * n
        out[i] = (len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()

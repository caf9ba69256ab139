"""Plain single-machine versions of the operators, for comparison in tests."""

from __future__ import annotations

import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def license_base(text: str | None, phrases: dict[str, str]) -> tuple:
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = [(i, label) for p, label in phrases.items() for k in [p.split()]
              for i in range(len(words) - len(k) + 1) if words[i:i + len(k)] == k]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


def jaccard_components(rows: list[tuple[int, str | None]], width: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    """Set size and smallest linked id of every text, by looking at all pairs that share a shingle."""
    sets: dict[int, frozenset] = {}
    for i, t in rows:
        words = SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), (t or "").strip(" \t\n\x0b\x0c\r")))
        words = words if words != [""] else []
        grams = [tuple(words[k:k + width]) for k in range(len(words) - width + 1)]
        sets[i] = frozenset(grams or ([tuple(words)] if words else []))
    holders: dict = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in sorted(sets):
        for j, both in Counter(j for g in sets[i] for j in holders[g] if j > i).items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def exact_groups(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool, str]]:
    import hashlib

    norm = {i: SPACE.sub(" ", t or "") for i, t in rows}
    groups: dict = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def warc(rows: list[tuple[int, str | None]]) -> list[tuple]:
    import base64
    import hashlib

    first: dict = {}
    for i, t in rows:
        first[t or ""] = min(i, first.get(t or "", i))
    return sorted((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[t or ""] == i else "revisit",
                   None if first[t or ""] == i else first[t or ""]) for i, t in rows for b in [(t or "").encode()])


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)

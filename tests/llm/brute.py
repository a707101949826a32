"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def pii_valid(kind: str, text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        twice = [d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return True


def pii_base(text: str | None) -> tuple[list[int], str]:
    counts, shown = [], []
    for kind, pattern in PII:
        spans = [f"{kind}:{m.start()}:{m.end()}" for m in pattern.finditer(text or "") if pii_valid(kind, m.group())]
        counts.append(len(spans))
        shown += spans
    return counts, hashlib.sha256(",".join(shown).encode()).hexdigest()


def shingles(text: str | None) -> set:
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 2 else {(a, b) for a, b in zip(words, words[1:])}


def components(rows: list[tuple[int, str | None]], percent: int = 80) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    part = {i: i for i in ids}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                part[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text: str | None) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def leaks(text: str | None, items: list[tuple[int, str | None]], size: int = 10) -> tuple[int, int, list[str]]:
    words, hit, found = bench_words(text), set(), set()
    for item, body in items:
        own = bench_words(body)
        n = min(size, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)

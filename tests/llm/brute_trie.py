"""The prefix trie in plain Python, with whole texts."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict


def trie(rows: list[tuple], block: int = 20) -> list[tuple]:
    """Rows (conv_id, turn, role, text) -> sorted node rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(turns.get(c - c % block, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        own = (len(members[s]) - 1) * len(s[-1][1].encode().split()) if s else 0
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = own + sum(saved[x] for x in children[s])
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], digest(s)) for s, m in members.items())

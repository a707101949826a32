"""Pattern packing of token pieces into sequences of a fixed budget.

1. Each document is tokenised and, where longer than the budget, cut into pieces.
2. Spark counts the lengths: at most ``budget`` rows, whatever the input. Lengths are grouped into
   bins; patterns of at most ``parts`` bins that fill a sequence are enumerated, non-negative least
   squares fit their repeat counts to the histogram, and the counts are rounded down.
3. Patterns are filled with exact lengths; what is left goes, longest first, to the fullest open
   kind of sequence that still has room. All this works on counts of lengths, not on documents.
4. The resulting plan says which rank of which length goes where. Ranks are dealt in salted groups,
   so that a length shared by a third of all rows is no single task's work.
"""

from __future__ import annotations

import warnings
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.llm.wordtok import word_tokenizer
from swatchwork.runtime import bounded_batches, written


@dataclass(frozen=True)
class PackParams:
    """``bin_tokens``: width of a histogram bin in the fit. ``parts``: most documents of a pattern.
    ``rows_per_salt``: aim for the rows that one task ranks."""

    budget: int = 4096
    end_id: int = 1
    bin_tokens: int = 32
    parts: int = 3
    rows_per_salt: int = 20_000


def _pieces(batches: Iterator[pa.RecordBatch], path: str, p: PackParams) -> Iterator[pa.RecordBatch]:
    tok = word_tokenizer(path)
    end = np.array([p.end_id], "<u4")
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = np.concatenate([tok.ids(text or ""), end])
            for k, start in enumerate(range(0, len(ids), p.budget)):
                part = ids[start : start + p.budget]
                for c, v in zip(cols, (doc_id, k, start, len(part), zlib.crc32(part.tobytes()))):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, path: str, p: PackParams) -> DataFrame:
    """One row a piece: its document, number, first token, length and the CRC of its ids."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _pieces(it, path, p), "doc_id long, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |ax - b|: columns enter by steepest gain and leave when they reach 0.

    A fit that ``rounds`` end early is still feasible, only not the best; it warns. What patterns don't
    place goes to best fit, so the packing stays whole.
    """
    x = np.zeros(a.shape[1])
    used: list[int] = []
    scale = np.linalg.norm(b) * 1e-9 + 1e-12
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= scale:
            break
        used.append(j)
        while used:
            s = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[used] = s
                break
            now = x[used]
            down = s <= 0
            step = np.min(now[down] / np.maximum(now[down] - s[down], 1e-300))
            now = now + step * (s - now)
            x[:] = 0
            x[used] = now
            used = [u for u, v in zip(used, now) if v > 1e-12]
    else:
        warnings.warn(f"pattern fit ended after {rounds} rounds with gain {gain[j]:.3g}", stacklevel=2)
    return x


def patterns(bins: int, parts: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most ``parts`` bins whose sum is ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int):
        if left == 0:
            out.append(head)
        elif len(head) < parts:
            for b in range(min(left, head[-1] if head else left), 0, -1):
                if b * (parts - len(head)) >= left:
                    grow((*head, b), left - b)

    grow((), bins)
    return out


def pack_plan(hist: dict[int, int], p: PackParams) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """``(((length, times), ...), sequences)``: kinds of sequence and how many of each."""
    left = {n: c for n, c in hist.items() if c > 0}
    width = p.bin_tokens
    bins = -(-p.budget // width)
    of_bin: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left, reverse=True):
        of_bin[-(-n // width)].append(n)
    counts = np.zeros(bins)
    for b, ns in of_bin.items():
        counts[b - 1] = sum(left[n] for n in ns)
    kinds: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    shapes = patterns(bins, p.parts)
    a = np.zeros((bins, len(shapes)))
    for j, shape in enumerate(shapes):
        for b in shape:
            a[b - 1, j] += 1
    total = counts.sum()
    # Long documents are the hard ones to place, so their bins weigh more in the fit.
    weight = np.sqrt(np.arange(1, bins + 1) / bins)
    times = np.floor(nnls(a * weight[:, None], counts / max(total, 1) * weight) * total + 1e-6).astype(int) if total else np.zeros(len(shapes), int)
    there = np.zeros(p.budget + 1, bool)
    there[list(left)] = True
    for j in np.argsort(-times, kind="stable"):
        todo = int(times[j])
        while todo > 0:
            taken: dict[int, int] = defaultdict(int)
            room = p.budget
            for nth, b in enumerate(shapes[j], 1):
                if nth == len(shapes[j]) and nth > 1:  # the last document takes what room its pattern really has
                    n = next((n for n in map(int, np.flatnonzero(there[: room + 1])[::-1]) if left[n] > taken[n]), None)
                else:
                    n = next((n for n in of_bin[b] if left[n] > taken[n]), None)
                if n is None:
                    break
                taken[n] += 1
                room -= n
            else:
                take = min(todo, *(left[n] // k for n, k in taken.items()))
                kinds[tuple(sorted(taken.items(), reverse=True))] += take
                for n, k in taken.items():
                    left[n] -= k * take
                for n in taken:
                    if not left[n]:
                        there[n] = False
                        of_bin[-(-n // width)].remove(n)
                todo -= take
                continue
            break
    # What is left goes to the fullest kind with room.
    open_: dict[int, list] = defaultdict(list)
    for parts, times_ in kinds.items():
        open_[p.budget - sum(n * k for n, k in parts)].append([parts, times_])
    rooms = np.zeros(p.budget + 1, bool)
    for r in open_:
        rooms[r] = True
    for n in sorted(left, reverse=True):
        c = left[n]
        while c > 0:
            fit = np.flatnonzero(rooms[n:])
            room = n + int(fit[0]) if len(fit) else p.budget
            if not len(fit):
                per = p.budget // n
                take = max(1, c // per)
                k = min(per, c)
                parts, have = (), take
            else:
                parts, have = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms[room] = False
                k = min(room // n, c)
                take = min(have, c // k)
            if have > take:
                open_[room].append([parts, have - take])
                rooms[room] = True
            after = room - n * k
            open_[after].append([(*parts, (n, k)), take])
            rooms[after] = True
            c -= take * k
    out: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    for groups in open_.values():
        for parts, times_ in groups:
            merged: dict[int, int] = defaultdict(int)
            for n, k in parts:
                merged[n] += k
            out[tuple(sorted(merged.items(), reverse=True))] += times_
    return sorted(out.items(), reverse=True)


def _plan_table(plan: list) -> dict[str, np.ndarray]:
    """Per length, in order of rank: where the ranks from ``at`` on go."""
    rows, first, used = [], 0, defaultdict(int)
    for parts, times in plan:
        offset = 0
        for n, k in parts:
            rows.append((n, used[n], first, k, offset))
            used[n] += k * times
            offset += n * k
        first += times
    rows.sort()
    return {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(("length", "at", "first", "times", "offset"))}


def _place(batches: Iterator[pa.RecordBatch], table: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    wide = np.int64(1) << np.int64(48)
    keys = table["length"] * wide + table["at"]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        row = np.searchsorted(keys, length * wide + rank, "right") - 1
        nth = rank - table["at"][row]
        seq = table["first"][row] + nth // table["times"][row]
        offset = table["offset"][row] + nth % table["times"][row] * length
        keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, p: PackParams = PackParams()) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of ``docs``.

    A null or empty text is the end id alone. Repeated rows are packed each; a null doc_id stays
    null. Other columns are ignored. An empty table gives an empty result.
    """
    bounded_batches(docs)
    pieces = written(token_pieces(docs, path, p))
    # The plan has a few rows a length, and lengths end at the budget.
    hist = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = _plan_table(pack_plan(hist, p))
    salts = max(1, -(-sum(hist.values()) // p.rows_per_salt))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lambda it: _place(it, table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

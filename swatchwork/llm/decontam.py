"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the word windows of the benchmark items. For each pattern length a shift table over
blocks of two words says how far the search may jump; where the shift is 0, the block selects a
bucket of patterns, and the words of the text are compared with them directly. Words are looked at
only at the positions that the shifts leave.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from swatchwork.llm.caches import claim
from swatchwork.runtime import bounded_batches, united, written


@dataclass(frozen=True)
class DecontamParams:
    """``window``: words of a window. ``pass_windows``, ``pass_bytes``: windows that one pass holds in
    memory, in number and in bytes of text; a larger benchmark is searched in several passes."""

    window: int = 10
    pass_windows: int = 400_000
    pass_bytes: int = 32 << 20


#: Bytes outside words become blanks and A-Z lower case; every byte of a character from U+0080 on is
#: 0x80 or more, so this works on UTF-8 as it stands.
_FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")


def item_words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


class WuManber:
    """Patterns of one length. ``patterns``: words -> ids of the items that hold them."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[int]]]] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.bucket[words[-self.block :]].append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of every occurrence."""
        shift, default, n, m = self.shift.get, self.default, len(words), self.length
        at = m
        two = self.block == 2
        while at <= n:
            key = (words[at - 2], words[at - 1]) if two else (words[at - 1],)
            step = shift(key, default)
            if step:
                at += step
                continue
            for pattern, items in self.bucket[key]:
                if words[at - m] == pattern[0] and tuple(words[at - m : at]) == pattern:
                    yield at - m, items
            at += 1


def windows(text: str | None, size: int) -> set[bytes]:
    """Distinct windows of an item, words parted by blanks; an item of fewer words is one window."""
    words = item_words(text)
    n = min(size, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            found = sorted(windows(text, size))
            for i in range(0, len(found), 10_000):
                part = found[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.int64()), pa.array(part, pa.binary())], ["item_id", "window"])


def _machines(held: pa.Table) -> list[WuManber]:
    """One search machine for each pattern length."""
    found: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    words: dict[bytes, bytes] = {}
    for item, window in zip(held["item_id"].to_pylist(), held["window"].to_pylist()):
        key = tuple(words.setdefault(w, w) for w in window.split(b" "))
        found[len(key)][key].append(item)
    return [WuManber(n, dict(w)) for n, w in sorted(found.items())]


def _hits(text: str | None, machines: list[WuManber]) -> tuple[int, list[int], list[int], list[int]]:
    """Number of words, starts and ends of the occurrences, items found."""
    words = item_words(text)
    starts, ends, items = [], [], set()
    for m in machines:
        for at, ids in m.search(words):
            starts.append(at)
            ends.append(at + m.length)
            items.update(ids)
    return len(words), starts, ends, list(items)


def _digest(words: int, starts: list[int], ends: list[int], items: list[int]) -> tuple[int, int, int, str]:
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(ends, np.int64), -1)
    ids = sorted(map(str, set(items)))
    return words, int((np.cumsum(edge) > 0).sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return pc.cast(batch.column("row").field("text"), pa.string()).to_pylist()


def _judged(batches: Iterator[pa.RecordBatch], held: pa.Table) -> Iterator[pa.RecordBatch]:
    """One pass over everything: rows with their digests."""
    claim("leaks", lambda: None)
    machines = _machines(held)
    for batch in batches:
        yield _digested(batch, [_hits(text, machines) for text in _texts(batch)])


def _digested(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
    cols = list(zip(*(_digest(*h) for h in hits))) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["row", "n_words", "n_hit", "n_items", "items_sha256"])


def _one_pass(batches: Iterator[pa.RecordBatch], held: pa.Table) -> Iterator[pa.RecordBatch]:
    """What one of several passes finds: only rows with occurrences."""
    claim("leaks", lambda: None)
    machines = _machines(held)
    for batch in batches:
        hits = [_hits(text, machines)[1:] for text in _texts(batch)]
        cols = list(zip(*hits)) or [(), (), ()]
        out = pa.RecordBatch.from_arrays([batch.column("at"), *(pa.array(c, pa.list_(pa.int64())) for c in cols)], ["at", "starts", "ends", "items"])
        yield out.filter(pa.array([bool(h[0]) for h in hits], pa.bool_()))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "items")))
        yield _digested(batch, [(len(item_words(t)), *(x or [] for x in f)) for t, f in zip(_texts(batch), found)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams(), keep_row: bool = False) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``, and
    with ``keep_row`` all its columns as ``row``.

    Null and empty texts have no words; null or empty items have no windows; an item id that
    repeats counts once. Repeated rows are judged each. Other columns are ignored. An empty
    benchmark hits nothing.

    Spark counts the windows and their bytes, and deals them by hash to so many passes that one
    stays within the parameters; the driver and the tasks hold one pass at a time. A benchmark of
    one pass is searched in one step; several passes write what they find, and this is added up.
    """
    spark = bounded_batches(docs).sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null")
    held = written(items.mapInArrow(lambda it: _windows(it, p.window), "item_id long, window binary").distinct())
    n, size = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("window")), F.lit(0))).first()
    passes = max(1, -(-n // p.pass_windows), -(-size // p.pass_bytes))
    part = lambda k: spark.sparkContext.broadcast(held.filter(F.pmod(F.xxhash64("window"), F.lit(passes)) == k).toArrow())
    taken = docs if keep_row else docs.select("doc_id", "text")
    rows = taken.select(F.struct(*taken.columns).alias("row"))
    digest = StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string")
    out = StructType([StructField("row", taken.schema), *digest.fields])
    if passes == 1:
        shared = part(0)
        found = rows.mapInArrow(lambda it: _judged(it, shared.value), out)
    else:
        rows = written(rows.withColumn("at", F.monotonically_increasing_id()))
        hits = None
        for k in range(passes):
            shared = part(k)
            now = written(rows.mapInArrow(lambda it, s=shared: _one_pass(it, s.value), "at long, starts array<long>, ends array<long>, items array<long>"))
            shared.destroy()
            hits = now if hits is None else hits.transform(united, now)
        hits = hits.groupBy("at").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))
        found = rows.join(hits, "at", "left").drop("at").mapInArrow(_joined, out)
    kept = ["row"] if keep_row else []
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), *kept, "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))

"""Exact token counts of every prefix of a text, by dynamic programming over the vocabulary.

In a merge vocabulary a sequence of pieces is the encoding of its text exactly if each two
neighbours stay apart when their joined text is encoded alone. So the last piece of each prefix is
the one piece that ends there and is compatible with the last piece of the prefix before it, and
its count is that prefix's count plus one. Two characters that stand side by side in no piece are a
fixed border, so a text splits into short runs; each distinct run is worked out once a worker and
kept in a bounded cache. Prefix counts answer totals, limits and cuts without encoding again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchwork.llm.caches import claim
from swatchwork.runtime import bounded_batches

SPACE = "▁"


@dataclass(frozen=True)
class CountParams:
    """``limit``: tokens that a text may have. ``block``: prefixes a row of the prefix table."""

    limit: int = 4096
    block: int = 4096


_counters: dict[str, PrefixCounter] = {}


class PrefixCounter:
    """Prefix counts for a SentencePiece BPE model with identity normalisation, byte fallback and a
    leading space."""

    def __init__(self, path: str, size: int = 300_000):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.tails = {p[k:] for p in self.score for k in range(len(p))}
        self.beside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.apart: dict[tuple[str, str], bool] = {}
        self.size = size
        self.young: dict[str, bytes | tuple[int, ...]] = {}
        self.old: dict[str, bytes | tuple[int, ...]] = {}
        self.runs: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        for cache in (self.young, self.old, self.runs, self.apart):
            cache.clear()

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours join first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            known = self.apart[left, right] = self._merge(left + right) == [left, right]
        return known

    def _run(self, text: str) -> tuple[int, ...]:
        """Counts of all prefixes of one run, from the empty one on."""
        known = self.runs.get(text)
        if known is not None:
            return known
        score, tails, apart = self.score, self.tails, self.apart
        last: list[str] = [""] * (len(text) + 1)
        count = [0] * (len(text) + 1)
        for i in range(1, len(text) + 1):
            start = i - 1
            while start and text[start - 1 : i] in tails:
                start -= 1
            while True:
                piece = text[start:i]
                if start == i - 1:
                    break
                if piece in score:
                    before = last[start]
                    if not before:
                        break
                    fits = apart.get((before, piece))
                    if fits or fits is None and self._fits(before, piece):
                        break
                start += 1
            last[i] = piece
            # A character outside the vocabulary is written as its UTF-8 bytes.
            count[i] = count[start] + (1 if piece in score else len(piece.encode("utf-8", "surrogatepass")))
        if len(text) <= 64:
            if len(self.runs) >= self.size:
                self.runs.clear()
            self.runs[text] = tuple(count)
        return tuple(count)

    def _chunk(self, text: str) -> tuple[int, ...]:
        """Prefix counts of a piece of text between fixed borders of any kind."""
        out, start = [0], 0
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in self.beside:
                base = out[-1]
                out += [base + c for c in self._run(text[start:k])[1:]]
                start = k
        return tuple(out)

    def _counts(self, chunk: str) -> bytes | tuple[int, ...]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found = self._chunk(SPACE + chunk)
                found = bytes(found) if found[-1] < 256 else found
            if len(chunk) <= 64:
                if len(self.young) >= self.size:
                    self.old, self.young = self.young, {}
                self.young[chunk] = found
        return found

    def chunks(self, text: str) -> Iterator[bytes | tuple[int, ...]]:
        """Prefix counts chunk by chunk: a space with what follows it up to the next space."""
        if "  " in text or text[-1:] == " " or text[:1] == " " or SPACE in text:
            return iter([self._chunk((SPACE + text).replace(" ", SPACE))])
        words = text.split(" ")
        found = list(map(self.young.get, words))
        return (c if c is not None else self._counts(w) for w, c in zip(words, found))

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of ``text[:k]`` for each k from 0 to its length."""
        if not text:
            return np.zeros(1, np.int64)
        out, base = [], 0
        for c in self.chunks(text):
            out.append(base + np.array(list(c[1:]), np.int64))
            base += c[-1]
        flat = np.concatenate(out)
        flat[0] = 0  # the leading space alone is the empty prefix
        return flat

    def count_and_cut(self, text: str | None, limit: int) -> tuple[int, int]:
        """Tokens of the whole text, and the longest prefix (in characters) of at most ``limit``."""
        if not text:
            return 0, 0
        totals = [c[-1] for c in self.chunks(text)]
        n = sum(totals)
        if n <= limit:
            return n, len(text)
        base = at = 0
        for k, c in enumerate(self.chunks(text)):
            if base + c[-1] > limit:
                inside = [i for i in range(1, len(c)) if base + c[i] <= limit]
                return n, at + (inside[-1] if inside else 0) - (k == 0 and bool(inside))
            base, at = base + c[-1], at + len(c) - 1 - (k == 0)
        return n, len(text)


def prefix_counter(path: str) -> PrefixCounter:
    """One counter and cache a worker process."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    counter = _counters[path]
    claim(f"prefixes {path}", counter.forget)
    return counter


def _prefixes(batches: Iterator[pa.RecordBatch], path: str, p: CountParams) -> Iterator[pa.RecordBatch]:
    counter = prefix_counter(path)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    held: list[tuple] = []
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["row", "doc_id", "first_char", "counts"])
    for batch in batches:
        for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
            counts = counter.prefix_counts(text).astype(np.int32)
            for first in range(0, len(counts), p.block):
                held.append((row, doc_id, first, counts[first : first + p.block]))
                if len(held) >= 200:
                    yield batch_of()
                    held = []
    if held:
        yield batch_of()


def prefix_table(docs: DataFrame, path: str, p: CountParams = CountParams()) -> DataFrame:
    """``row, doc_id, first_char, counts``: the tokens of every prefix of every text, in blocks of
    ``p.block`` prefixes; ``counts[i]`` is that of the first ``first_char + i`` characters.

    To be written once; ``prefix_tokens`` and ``prefix_cuts`` then answer any length and any budget
    from it without encoding again. ``row`` tells repeated rows apart. A null text counts as empty.
    """
    rows = bounded_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: _prefixes(it, path, p), "row long, doc_id long, first_char long, counts array<int>")


def prefix_tokens(table: DataFrame, n_chars: Column) -> DataFrame:
    """``row, doc_id, n_tokens`` of the prefix of ``n_chars`` characters (an expression over doc_id);
    rows of shorter texts are left out."""
    at = n_chars - F.col("first_char")
    return table.filter((at >= 0) & (at < F.size("counts"))).select("row", "doc_id", F.get("counts", at.cast("int")).cast("long").alias("n_tokens"))


def prefix_cuts(table: DataFrame, limit: int) -> DataFrame:
    """``row, doc_id, cut_chars``: the longest prefix of at most ``limit`` tokens."""
    back = F.array_position(F.transform(F.reverse("counts"), lambda c: c <= limit), F.lit(True))
    inside = F.when(back > 0, F.col("first_char") + F.size("counts") - back)
    return table.groupBy("row", "doc_id").agg(F.max(inside).alias("cut_chars"))


def _count(batches: Iterator[pa.RecordBatch], path: str, p: CountParams) -> Iterator[pa.RecordBatch]:
    counter = prefix_counter(path)
    for batch in batches:
        n_bytes, n_tokens, cut = [], [], []
        for text in batch.column("text").to_pylist():
            n_bytes.append(len((text or "").encode("utf-8", "surrogatepass")))
            n, k = counter.count_and_cut(text, p.limit)
            n_tokens.append(n)
            cut.append(k)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_tokens, cut))], ["doc_id", "n_bytes", "n_tokens", "cut_chars"])


def token_counts(docs: DataFrame, path: str, p: CountParams = CountParams()) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, cut_chars`` for every row of ``docs``.

    ``cut_chars``: characters of the longest prefix within the limit. Null texts count as empty and
    have no tokens. Repeated rows are counted alike; other columns are ignored.
    """
    found = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _count(it, path, p), "doc_id long, n_bytes long, n_tokens long, cut_chars long")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > p.limit).alias("over_limit"), "cut_chars")

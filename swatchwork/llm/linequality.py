"""Document quality by cross-document line frequency, beside base counts of each text.

Lines are normalised (white space runs to one blank, ends cut, A-Z in lower case) and hashed with
their host; the distinct documents of each host that hold a line are counted, also those of equal
text. A line over the limit is boilerplate; a document that keeps too few words is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatchwork.llm.caches import claim
from swatchwork.runtime import bounded_batches, small_enough, written


@dataclass(frozen=True)
class LineParams:
    """A line is removed when more than ``least_docs`` documents of its host hold it, whatever
    the host's size. A document is depleted when its other lines keep fewer than ``keep_words``
    words or less than ``keep_share`` of its words. ``host``: the column that names the host."""

    host: str = "source"
    least_docs: int = 20
    keep_words: int = 20
    keep_share: float = 0.3
    window: int = 8
    min_words: int = 20
    repeat_percent: int = 30


_SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes], size: int) -> int:
    """Words inside windows of ``size`` words that occur at least twice in the text. Windows get
    exact numbers by doubling: equal pairs of equal halves."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    span = 1
    while span < size:
        pair = ids[: len(ids) - span] * np.int64(len(words) + 1) + ids[span:]
        ids = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def host_salt(host: str | None) -> int:
    return xxhash.xxh64_intdigest((host or "").encode("utf-8", "surrogatepass")) ^ (host is None)


def line_key(words: list[bytes], salt: int) -> int:
    """Signed hash of a normalised line and its host."""
    return xxhash.xxh64_intdigest(b" ".join(words).lower(), salt) - (1 << 63)


def _base(batches: Iterator[pa.RecordBatch], p: LineParams) -> Iterator[pa.RecordBatch]:
    claim("lines", lambda: None)
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for host, text in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist()):
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass")
            words = raw.split()
            blanks = sum(map(text.count, " \t\n\v\f\r"))
            salt = host_salt(host)
            seen: set[bytes] = set()
            copies = 0
            lines: dict[int, int] = {}
            for line in raw.split(b"\n"):
                held = line.split()
                if not held:
                    continue
                copies += line in seen
                seen.add(line)
                key = line_key(held, salt)
                lines[key] = lines.get(key, 0) + len(held)
            row = (len(words), len(text) - blanks, sum(map(text.count, _SYMBOLS)), copies, repeated_words(words, p.window), xxhash.xxh64_intdigest(raw) - (1 << 63), list(lines), list(lines.values()))
            for o, v in zip(out, row):
                o.append(v)
        kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash", "line_keys", "line_words"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(o, k) for o, k in zip(out, kinds))], ["doc_id", "host", *names])


def _rows(docs: DataFrame, p: LineParams) -> DataFrame:
    host = F.col(p.host).cast("string") if p.host in docs.columns else F.lit(None).cast("string")
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), F.col("text").cast("string").alias("text"))


def _measured(docs: DataFrame, p: LineParams) -> DataFrame:
    schema = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, line_keys array<long>, line_words array<long>"
    return written(_rows(docs, p).mapInArrow(lambda it: _base(it, p), schema).withColumn("row", F.monotonically_increasing_id()))


def _frequent(base: DataFrame, p: LineParams) -> DataFrame:
    """Keys of the lines over the limit; to be broadcast only when they are few."""
    one = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")))
    texts = base.groupBy("host", "text_hash").agg(F.first("line_keys").alias("line_keys"), F.count_distinct(one).alias("copies"))
    # One row a host and line; a text is exploded once for all its copies, and counts are combined before the shuffle.
    often = texts.select("host", "copies", F.explode("line_keys").alias("key")).groupBy("host", "key").agg(F.sum("copies").alias("n")).filter(F.col("n") > p.least_docs)
    often = written(often.select("key").distinct())
    return F.broadcast(often) if small_enough(often.count(), 16) else often


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, host, text in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "text"))):
            salt, keys, at = host_salt(host), [], []
            for k, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                if held := line.split():
                    keys.append(line_key(held, salt))
                    at.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(keys, pa.int64())], ["row", "at", "key"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, lost in zip(batch.column("text").to_pylist(), batch.column("lost").to_pylist()):
            gone = set(lost or ())
            texts.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def without_frequent_lines(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """``doc_id, text`` of every row of ``docs``: the text without the lines over the limit.

    Nulls stay null, and other lines, blank ones too, stay as they are. Repeated rows are cleaned
    each; other columns are ignored.
    """
    keys = _frequent(_measured(docs, p), p)
    rows = written(_rows(docs, p).withColumn("row", F.monotonically_increasing_id()))
    lost = rows.mapInArrow(_lines, "row long, at int, key long").join(keys, "key").groupBy("row").agg(F.collect_set("at").alias("lost"))
    return rows.join(lost, "row", "left").select("doc_id", "text", "lost").mapInArrow(_without, "doc_id long, text string")


def line_quality(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_left_words`` for every row of ``docs`` (doc_id, text and the host column).

    Null texts count as empty and fail. Rows without a host form a host of their own; without the
    host column all rows do. Repeated rows of one doc_id and text count once for a line, copies under other ids and rows
    without an id each; all are judged. Other columns are ignored.
    """
    base = _measured(docs, p)
    keys = _frequent(base, p)
    lines = base.select("row", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")).select("row", F.col("l.line_keys").alias("key"), F.col("l.line_words").alias("n"))
    lost = lines.join(keys, "key").groupBy("row").agg(F.sum("n").alias("lost"))
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    depleted = (left < p.keep_words) | (left < p.keep_share * F.col("n_words"))
    return base.join(lost, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), left.alias("n_left_words")
    )

"""Toxicity score: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training sees a bounded sample of labelled rows (``max_toxic`` and ``max_clean``); document
frequencies are counted by Spark over that sample, the n-grams that tell the classes apart best
are kept, and a logistic regression is fitted on presence times log-count ratio. Scoring goes over
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from swatchwork.llm.caches import claim
from swatchwork.runtime import bounded_batches, small_enough, written


@dataclass(frozen=True)
class ToxicityParams:
    """``max_toxic``, ``max_clean``: bound of the training sample, in documents. ``max_keys``: bound of the n-grams
    that are weighed, those in most toxic documents. ``features``: size of the model. ``least_docs``, ``least_share``: toxic documents that must hold an n-gram, in number and as
    a share of the sample."""

    lengths: tuple[int, ...] = (4, 5, 6, 7)
    max_toxic: int = 2500
    max_clean: int = 6000
    max_keys: int = 1 << 19
    features: int = 8192
    least_docs: int = 4
    least_share: float = 0.004
    smoothing: float = 1.0
    l2: float = 1e-3
    steps: int = 300
    bits: int = 20
    seed: int = 3


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted n-gram keys, their weights (already times the log-count ratio) and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    lengths: tuple[int, ...]
    bits: int


_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _ngrams(text: str, lengths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """64-bit keys of all n-grams of the lower-cased text between two spaces, one array a length."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    h, n = c, 1
    while n < max(lengths):
        if len(c) <= n:
            return
        h = h[:-1] * _BASE + c[n:]
        n += 1
        if n in lengths:
            x = h * _MIX
            yield x ^ (x >> np.uint64(32))


def _chunks(text: str, lengths: tuple[int, ...], size: int = 200_000) -> Iterator[np.ndarray]:
    """As ``_ngrams``, over overlapping pieces of a very long text so that memory stays bounded."""
    step, over = size, max(lengths) - 1
    for i in range(0, max(1, len(text)), step):
        yield from _ngrams(text[max(0, i - over) : i + step], lengths)


class _Lookup:
    """Which of a fixed set of keys a text holds; a small bit table passes few other keys."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(keys >> self.shift).astype(np.int64)] = True

    def __call__(self, text: str | None, lengths: tuple[int, ...]) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(0, np.int64)
        found = []
        for h in _chunks(text or "", lengths):
            h = h[self.table[(h >> self.shift).astype(np.int64)]]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            found.append(at[self.keys[at] == h])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _toxic_keys(batches: Iterator[pa.RecordBatch], p: ToxicityParams) -> Iterator[pa.RecordBatch]:
    parts: list[np.ndarray] = []
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge():
        nonlocal keys, counts, parts
        if parts:
            k, n = np.unique(np.concatenate(parts), return_counts=True)
            both = np.concatenate([keys, k])
            keys, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
            parts = []

    for batch in batches:
        for text in batch.column("text").to_pylist():
            grams = list(_chunks(text or "", p.lengths))
            if grams:
                parts.append(np.unique(np.concatenate(grams)))
            if sum(map(len, parts)) > 2_000_000:
                merge()
    merge()
    for i in range(0, len(keys), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000].view(np.int64)), pa.array(counts[i : i + 50_000])], ["key", "n"])


def _count_known(batches: Iterator[pa.RecordBatch], keys: np.ndarray, p: ToxicityParams) -> Iterator[pa.RecordBatch]:
    look, counts = _Lookup(keys, p.bits), np.zeros(len(keys), np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts[look(text, p.lengths)] += 1
    at = np.flatnonzero(counts)
    for i in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(counts[at[i : i + 50_000]])], ["feature", "n"])


def _features(batches: Iterator[pa.RecordBatch], keys: np.ndarray, p: ToxicityParams) -> Iterator[pa.RecordBatch]:
    look = _Lookup(keys, p.bits)
    for batch in batches:
        found = [look(t, p.lengths).astype(np.int32) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "found"])


def _fit(rows: pa.Table, ratio: np.ndarray, weight: dict[int, float], p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch gradient steps with momentum; rows in order of doc_id, so
    that sums don't depend on how the sample was dealt out."""
    y, found = rows["toxic"].to_numpy().astype(float), rows["found"].combine_chunks()
    w = np.where(y > 0, weight[1], weight[0])
    w /= w.sum()
    row = np.repeat(np.arange(len(y)), found.value_lengths().to_numpy())
    col = found.flatten().to_numpy().astype(np.int64)
    x = ratio[col]
    beta, bias = np.zeros(len(ratio)), float(np.log((w * y).sum() / (w * (1 - y)).sum()))
    m, v, mb, vb = np.zeros_like(beta), np.zeros_like(beta), 0.0, 0.0
    for k in range(1, p.steps + 1):
        z = bias + np.bincount(row, beta[col] * x, len(y))
        g = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gb = g.sum()
        g = np.bincount(col, g[row] * x, len(ratio)) + p.l2 / len(ratio) * beta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        beta -= 0.02 * fix * m / (np.sqrt(v) + 1e-12)
        bias -= 0.02 * fix * mb / (np.sqrt(vb) + 1e-12)
    return beta, float(bias)


def train_toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on labelled rows of ``docs`` whose crc32(doc_id as text) mod 5 is not 0.

    Null ids, texts and labels are left out; several labels of one document count as their largest.
    Without rows of both classes among the documents the model is a constant: the smoothed share of
    toxic rows, or 0 without any.
    """
    bounded_batches(docs)
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .filter("doc_id is not null and toxic is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    count = lambda df: {int(r.toxic): r.n for r in df.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = np.zeros(0)
    # Labels may name documents that are not there: classes are those of the documents.
    side = F.broadcast(known) if small_enough(known.count(), 16) else known
    known = written(docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id")).join(side, "doc_id").distinct())
    n = count(known)
    rate = {k: min(1.0, most / max(1, n.get(k, 0))) for k, most in ((1, p.max_toxic), (0, p.max_clean))}
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(p.seed)), 11) / float(1 << 53)
    chosen = written(known.withColumn("toxic", (F.col("toxic") > 0).cast("int")).filter(draw < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0])))
    # About max_toxic + max_clean ids, whatever the size of the tables; broadcast only when they are that few.
    side = F.broadcast(chosen) if small_enough(chosen.count(), 16) else chosen
    sample = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null").join(side, "doc_id"))
    size = count(sample)  # repeated rows count each
    n1, n0 = size.get(1, 0), size.get(0, 0)
    share = (n1 / rate[1] + 0.5) / (n1 / rate[1] + n0 / rate[0] + 1)
    constant = ToxicityModel(empty.astype(np.uint64), empty, float(np.log(share / (1 - share))) if n1 + n0 else -30.0, p.lengths, p.bits)
    if not n1 or not n0:
        return constant
    toxic = sample.filter("toxic = 1").select("text")
    least = max(p.least_docs, round(p.least_share * min(n[1], p.max_toxic)))
    counted = toxic.mapInArrow(lambda it: _toxic_keys(it, p), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    counted = counted.orderBy(F.desc("n"), "key").limit(p.max_keys).toArrow()
    if not counted.num_rows:
        return constant
    keys, pos = counted["key"].to_numpy().view(np.uint64), counted["n"].to_numpy().astype(float)
    order = np.argsort(keys)
    keys, pos = keys[order], pos[order]
    clean = sample.filter("toxic = 0").select("text").mapInArrow(lambda it: _count_known(it, keys, p), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    neg = np.zeros(len(keys))
    neg[clean["feature"].to_numpy()] = clean["n"].to_numpy()
    ratio = np.log((pos + p.smoothing) / (n1 + 2 * p.smoothing)) - np.log((neg + p.smoothing) / (n0 + 2 * p.smoothing))
    gain = np.abs(ratio) * np.sqrt(pos + neg * n1 / n0)
    best = np.sort(np.lexsort((keys, -gain))[: p.features])
    keys, ratio = keys[best], ratio[best]
    rows = sample.mapInArrow(lambda it: _features(it, keys, p), "doc_id long, toxic int, found array<int>").toArrow().sort_by("doc_id")
    beta, bias = _fit(rows, ratio, {1: 1 / rate[1], 0: 1 / rate[0]}, p)
    return ToxicityModel(keys, beta * ratio, bias, p.lengths, p.bits)


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    claim("toxicity", lambda: None)
    look = _Lookup(model.keys, model.bits)
    for batch in batches:
        texts = pc.cast(batch.column("row").field("text"), pa.string()).to_pylist()
        z = np.array([model.bias + model.weights[look(t, model.lengths)].sum() for t in texts], float)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["row", "score"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep_row: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text, ...), and with
    ``keep_row`` all its columns as ``row``.

    Null texts count as empty; an empty text gets the score of the intercept. Repeated rows are
    scored alike; other columns are ignored.
    """
    taken = docs if keep_row else docs.select("doc_id", "text")
    out = StructType([StructField("row", taken.schema), StructField("score", DoubleType())])
    rows = bounded_batches(taken).select(F.struct(*taken.columns).alias("row"))
    found = rows.mapInArrow(lambda it: _score(it, model), out).withColumn("doc_id", F.col("row.doc_id").cast("long"))
    kept = ["row"] if keep_row else []
    return found.select("doc_id", *kept, F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

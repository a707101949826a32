"""MinHash near duplicates with sequential Bayesian verification.

Texts with equal shingle sets form one class, which has a number and the text of its smallest doc_id. Signatures of
the classes are cut into bands; the smallest member of a bucket is its leader, and every
other member is a candidate of that leader. Candidates are compared batch by batch of signature
values: a pair is dropped as soon as the posterior probability that its similarity reaches the
threshold falls below ``miss``. Only signatures are shuffled for this; the full shingle sets follow
for the survivors alone, which are verified on them.

The confirmed links give first components. Members of a bucket outside their leader's component
are then held, in bounded blocks, against the bucket's other members: first by signature, then, for
rows with a survivor, by set. Two members of one bucket share its leader, so no candidate pair is
lost, while the pairs of a large group of copies are never written out: rows of one component need
no comparison. Only confirmed links leave a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatchwork.llm.shingles import begin_task, hash_parameters, minhash, shingle_set
from swatchwork.operators.graph import connected_components
from swatchwork.runtime import bounded_batches, small_enough, united, written


@dataclass(frozen=True)
class NearDupParams:
    """``bands`` x ``rows`` MinHash values: at similarity 0.8 a pair shares no band with
    probability (1 - 0.8^5)^40 = 1.3e-7. ``percent``: the least similarity. ``miss``: posterior
    probability below which a pair is dropped. ``block``: rows of a block in the second round.
    ``lead_rows``: a leader with more candidates is copied, and they are dealt to the copies."""

    shingle: int = 2
    percent: int = 80
    rows: int = 5
    bands: int = 40
    batch: int = 20
    miss: float = 1e-7
    block: int = 256
    lead_rows: int = 500

    def needed(self) -> list[int]:
        """Least matches after each batch; with a uniform prior the posterior of n values with m
        matches is P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
        t, out = self.percent / 100, []
        for n in range(self.batch, self.rows * self.bands + 1, self.batch):
            below = 0.0
            for m in range(n + 2):
                below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if below >= self.miss:
                    break
            out.append(m)
        return out


def _sketches(batches: Iterator[pa.RecordBatch], p: NearDupParams) -> Iterator[pa.RecordBatch]:
    begin_task()
    a, b = hash_parameters(p.rows * p.bands)
    for batch in batches:
        n, prints, sigs = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text, p.shingle)
            n.append(len(s))
            prints.append(hashlib.md5(s.tobytes()).digest())
            sigs.append(minhash(s, a, b).astype("<u2").tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "n_shingles", "print", "sig"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a hash of the text, which tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def sketch(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """Per row: hash of the text, number of shingles, fingerprint of the shingle set, 16-bit signature values."""
    return _keyed(docs).mapInArrow(lambda it: _sketches(it, p), "doc_id long, text_hash long, n_shingles long, print binary, sig binary")


def _band_keys(batches: Iterator[pa.RecordBatch], p: NearDupParams) -> Iterator[pa.RecordBatch]:
    fold = hash_parameters(p.rows, seed=11)[0]
    band = np.arange(p.bands, dtype=np.uint64) << np.uint64(57)
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, p.bands, p.rows)
        cells = ((sig.astype(np.uint64) + np.uint64(1)) * fold).sum(axis=2, dtype=np.uint64)
        keys = ((cells >> np.uint64(7)) | band).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), p.bands)), pa.array(keys)], ["rep", "key"])


def _sets(batches: Iterator[pa.RecordBatch], p: NearDupParams) -> Iterator[pa.RecordBatch]:
    begin_task()
    for batch in batches:
        sets = [_packed(shingle_set(text, p.shingle)) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("as_lead"), batch.column("as_rep"), pa.array(sets, pa.binary())], ["rep", "as_lead", "as_rep", "shingles"])


def shingle_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, p: NearDupParams) -> DataFrame:
    """Full shingle sets of the classes in ``ids`` (rep, as_lead, as_rep), written once; 48 of the
    64 bits of a hash are kept, still far more than a pair of sets can confuse."""
    ids = written(ids.join(classes.select("rep", "doc_id", "text_hash"), "rep"))
    side = F.broadcast(ids) if small_enough(ids.count(), 40) else ids
    rows = _keyed(docs).join(side, ["doc_id", "text_hash"]).select("rep", "as_lead", "as_rep", "text")
    return written(rows.mapInArrow(lambda it: _sets(it, p), "rep long, as_lead boolean, as_rep boolean, shingles binary").dropDuplicates(["rep"]))


def _packed(s: np.ndarray) -> bytes:
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _matches(x: np.ndarray, others: np.ndarray, p: NearDupParams, needed: list[int]) -> np.ndarray:
    """Indices of the rows of ``others`` that the sequential test keeps for the signature ``x``."""
    alive, seen = np.arange(len(others)), np.zeros(len(others), np.int32)
    for k, least in enumerate(needed):
        cut = slice(k * p.batch, (k + 1) * p.batch)
        seen = seen + (others[alive, cut] == x[cut]).sum(axis=1, dtype=np.int32)
        hold = seen >= least
        alive, seen = alive[hold], seen[hold]
        if not len(alive):
            break
    return alive


def _linked(s: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Exact test of one set against several."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
    both = np.add.reduceat((s[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return 100 * both >= percent * (len(s) + sizes - both)


def _near(batches: Iterator[pa.RecordBatch], p: NearDupParams) -> Iterator[pa.RecordBatch]:
    """Adds the verdict of the sequential test."""
    needed = p.needed()
    for batch in batches:
        pairs = zip(batch.column("lead_sig").to_pylist(), batch.column("sig").to_pylist())
        near = [bool(len(_matches(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")[None, :], p, needed))) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("rep"), batch.column("salt"), pa.array(near, pa.bool_())], ["lead", "rep", "salt", "near"])


def _confirmed(batches: Iterator[pa.RecordBatch], p: NearDupParams) -> Iterator[pa.RecordBatch]:
    """Only the pairs whose sets reach the similarity."""
    for batch in batches:
        pairs = zip(batch.column("lead_shingles").to_pylist(), batch.column("shingles").to_pylist())
        linked = [bool(_linked(_unpacked(x), [_unpacked(y)], p.percent)[0]) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("rep")], ["lead", "rep"]).filter(pa.array(linked, pa.bool_()))


def _others(right: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a block with those that each has to be held against: of another component, and where
    the block has two sides, of the other side."""
    two = bool(right.any())
    for i in np.flatnonzero(right) if two else range(len(group)):
        other = np.flatnonzero(~right & (group != group[i])) if two else i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if len(other):
            yield i, other


def _partners(rows: pd.DataFrame, p: NearDupParams) -> pd.DataFrame:
    """The rows of one block that the sequential test leaves with another row."""
    needed = p.needed()
    sig = np.stack([np.frombuffer(x, "<u2") for x in rows["sig"]])
    keep = np.zeros(len(rows), bool)
    for i, other in _others(rows["right"].to_numpy(), rows["component"].to_numpy()):
        found = other[_matches(sig[i], sig[other], p, needed)]
        keep[found] = True
        keep[i] |= len(found) > 0
    return rows[keep]


def _block(rows: pd.DataFrame, p: NearDupParams) -> pd.DataFrame:
    """Confirmed links between the components of one block, as few as connect them."""
    needed = p.needed()
    first = rows["component"].to_numpy()
    sig = np.stack([np.frombuffer(x, "<u2") for x in rows["sig"]])
    sets = [_unpacked(x) for x in rows["shingles"]]
    group = first.copy()  # changes while the rows are gone through, and _others sees it
    src, dst = [], []
    for i, other in _others(rows["right"].to_numpy(), group):
        other = other[_matches(sig[i], sig[other], p, needed)]
        if not len(other):
            continue
        for j in other[_linked(sets[i], [sets[j] for j in other], p.percent)]:
            if group[j] != group[i]:
                src.append(first[i])
                dst.append(first[j])
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group[group == old] = new
    return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})


def _heavy(pairs: DataFrame, p: NearDupParams) -> DataFrame:
    """``lead, salts`` of the leaders with many candidates; to be broadcast only when few."""
    heavy = written(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > p.lead_rows).select("lead", F.ceil(F.col("n") / p.lead_rows).cast("int").alias("salts")))
    return F.broadcast(heavy) if small_enough(heavy.count(), 16) else heavy


def _copied(leads: DataFrame, heavy: DataFrame) -> DataFrame:
    """One row a leader and salt."""
    return leads.join(heavy, "lead", "left").select(*leads.columns, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))


def _ids(pairs: DataFrame) -> DataFrame:
    """The classes of a table of pairs, and on which side they stand."""
    ends = F.array(*(F.struct(F.col(c).alias("rep"), F.lit(c == "lead").alias("as_lead")) for c in ("lead", "rep")))
    return pairs.select(F.explode(ends).alias("e")).groupBy("e.rep").agg(F.max("e.as_lead").alias("as_lead"), F.max(~F.col("e.as_lead")).alias("as_rep"))


def representative_components(docs: DataFrame, classes: DataFrame, p: NearDupParams) -> tuple[DataFrame, DataFrame]:
    """``node, component`` of the classes that are linked with a leader, and the same of the
    components that blocks of the second round connect.

    ``classes``: rep (number of the class), doc_id and text_hash of one of its rows, sig. The copies of a row in the second round: one outside its leader's
    component meets every block of those inside and of the others like it.
    """
    bands = classes.select("rep", "sig").mapInArrow(lambda it: _band_keys(it, p), "rep long, key long")
    leads = bands.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "lead")
    pairs = written(bands.join(leads, "key").filter("rep <> lead").select("lead", "rep").distinct())
    heavy = _heavy(pairs, p)
    pairs = pairs.join(heavy, "lead", "left").select("lead", "rep", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))

    ids = _ids(pairs)
    sigs = written(classes.select("rep", "sig").join(ids, "rep"))
    led = _copied(sigs.filter("as_lead").select(F.col("rep").alias("lead"), F.col("sig").alias("lead_sig")), heavy)
    own = sigs.filter("as_rep").select("rep", "sig")
    tested = written(pairs.join(own, "rep").join(led, ["lead", "salt"]).mapInArrow(lambda it: _near(it, p), "lead long, rep long, salt int, near boolean"))

    near = tested.filter("near").select("lead", "rep", "salt")
    sets = shingle_sets(docs, classes, _ids(near), p)
    led = _copied(sets.filter("as_lead").select(F.col("rep").alias("lead"), F.col("shingles").alias("lead_shingles")), heavy)
    own_sets = sets.filter("as_rep").select("rep", "shingles")
    links = written(near.join(own_sets, "rep").join(led, ["lead", "salt"]).mapInArrow(lambda it: _confirmed(it, p), "lead long, rep long"))
    first = written(connected_components(links, "lead", "rep"))

    of_rep = first.select(F.col("node").alias("rep"), "component")
    of_lead = first.select(F.col("node").alias("lead"), F.col("component").alias("lead_component"))
    leads = tested.select("lead").distinct().join(of_lead, "lead", "left").select("lead", F.coalesce("lead_component", "lead").alias("lead_component"))
    member = tested.join(of_rep, "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(_copied(leads, heavy), ["lead", "salt"])
    member = written(member.select("lead", "salt", "rep", "component", (F.col("component") == F.col("lead_component")).alias("inside")))
    sizes = member.groupBy("lead").agg(F.count_if("inside").alias("n_in"), F.count_if(~F.col("inside")).alias("n_out")).filter("n_out > 0 and n_in + n_out > 1")
    blocks = lambda c: F.ceil(F.col(c) / p.block).cast("int")
    mark = F.pmod(F.xxhash64("rep"), F.when(F.col("inside"), F.greatest(blocks("n_in"), F.lit(1))).otherwise(blocks("n_out"))).cast("int")
    others = F.sequence(F.lit(0), blocks("n_out") - 1)
    task = lambda kind, left, right, is_right: F.struct(F.lit(kind).alias("kind"), left.alias("a"), right.alias("b"), is_right.alias("right"))
    none = F.array().cast("array<struct<kind:string,a:int,b:int,right:boolean>>")
    m = F.col("mark")
    from_inside = F.transform(others, lambda j: task("in", m, j, F.lit(False)))
    from_outside = F.concat(
        F.when(F.col("n_in") > 0, F.transform(F.sequence(F.lit(0), blocks("n_in") - 1), lambda i: task("in", i, m, F.lit(True)))).otherwise(none),
        F.transform(others, lambda j: task("out", F.least(m, j), F.greatest(m, j), m > j)),
    )
    copies = member.join(_copied(sizes, heavy), ["lead", "salt"]).withColumn("mark", mark)
    copies = copies.select("lead", "rep", "component", F.explode(F.when(F.col("inside"), from_inside).otherwise(from_outside)).alias("t")).select("lead", "rep", "component", "t.*")
    of_block = ["lead", "kind", "a", "b"]
    kept = written(
        copies.join(sigs.select("rep", "sig"), "rep").groupBy(*of_block).applyInPandas(lambda g: _partners(g, p), "lead long, rep long, component long, kind string, a int, b int, right boolean, sig binary")
    )
    more = kept.select("rep").distinct().join(sets.select("rep"), "rep", "left_anti").select("rep", F.lit(False).alias("as_lead"), F.lit(True).alias("as_rep"))
    all_sets = sets.transform(united, shingle_sets(docs, classes, more, p)).select("rep", "shingles")
    second = connected_components(written(kept.join(all_sets, "rep").groupBy(*of_block).applyInPandas(lambda g: _block(g, p), "src long, dst long")))

    return first, second


def _of_one_document(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``named`` (print, component, doc_id) with the components joined that rows of one doc_id belong to."""
    held = rows.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "print")
    several = written(held.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("b")).filter("a <> b").select("doc_id"))
    if several.isEmpty():
        return named
    side = F.broadcast(several) if small_enough(several.count(), 16) else several
    parts = held.join(side, "doc_id").distinct().join(named.select("print", "component"), "print").select("doc_id", "component").distinct()
    lowest = parts.groupBy("doc_id").agg(F.min("component").alias("src"))
    joined = connected_components(parts.join(lowest, "doc_id").select("src", F.col("component").alias("dst")))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return named.join(joined, "component", "left").select("print", F.coalesce("whole", "component").alias("component"), "doc_id")


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text, ...).

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. A
    null doc_id stays alone with a null component and is kept. Rows that repeat a doc_id are one
    document: what one of them is linked with, all are. The order of the rows makes no difference. Other
    columns are ignored. An empty table gives an empty result.
    """
    bounded_batches(docs)
    rows = written(sketch(docs, p))
    one = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("print").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("sig").alias("sig"))
    classes = written(one.select("print", "row.doc_id", "row.text_hash", "sig", F.monotonically_increasing_id().alias("rep")))
    first, second = representative_components(docs, classes, p)
    named = classes.select("print", "rep", "doc_id").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"), "doc_id")
    # A component of components has the smallest node of them all.
    second = second.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    named = written(named.join(second, "component", "left").select("print", F.coalesce("whole", "component").alias("component"), "doc_id"))
    named = _of_one_document(rows, named)
    # Most classes are alone; the others get the smallest doc_id of their component.
    least = written(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("component", "component_id"))
    side = F.broadcast(least) if small_enough(least.count(), 24) else least
    named = named.join(side, "component", "left").select("print", F.coalesce("component_id", "doc_id").alias("component"))
    found = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("print")).alias("print")).join(named, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

"""Prefix trie of rebuilt conversations by composable fingerprints.

A sequence of turns has a fingerprint (length, sum), where turn i adds hash * B^i to the sum; that of two
sequences after each other is (n1 + n2, s1 + B^n1 * s2). The prefixes of a conversation are running sums,
and those of a rebuilt one, a head of its base and a suffix of its own, follow from the prefixes of both:
no text is put together, and rows carry a reference to the stored turn. Equal prefixes meet by depth and
fingerprint. A group is right when its members have one parent and the stored turns that they end in are
equal; if any group is not, the fingerprints are made anew with other numbers.

The smallest member of a node owns it. The nodes of a subtree are owned by members of its top, and a member
owns the last nodes of its path; so the sums over a subtree are, over the members of its top, the sums of
what each owns from there on: one running sum along the paths and one grouping, whatever the depth.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchwork.llm.mixing import words
from swatchwork.llm.running import in_ranges, running_sums
from swatchwork.runtime import bounded_batches, small_enough, united, written

#: Two primes below 2^31: products of two values stay in the range of a long.
PRIMES = (2_147_483_647, 2_147_483_629)


@dataclass(frozen=True)
class TrieParams:
    """A conversation takes up to ``most_head - 1`` turns of the first conversation of its block of ``block``
    numbers. ``position_block``: positions of a conversation that meet its splice in one task. ``chunk``: ids
    joined before a digest reads them. ``hash_bits``: kept bits of a turn's hash (fewer only in tests)."""

    block: int = 20
    most_head: int = 4
    position_block: int = 4096
    chunk: int = 4096
    hash_bits: int = 62
    seed: int = 0


@dataclass(frozen=True)
class _Numbers:
    """Random numbers of one attempt: a base for each prime and the seed of the hash of turns."""

    seed: int

    def base(self, k: int) -> int:
        return random.Random(2 * self.seed + k).randrange(1 << 20, PRIMES[k] - 1)

    def power(self, k: int, e: int) -> int:
        return pow(self.base(k), e, PRIMES[k])


def _power(numbers: _Numbers, k: int, e: Column) -> Column:
    """Base to the power of a position, by its bits."""
    squares = F.array(*(F.lit(numbers.power(k, 1 << b)) for b in range(40)))
    step = lambda acc, b: F.when(F.call_function("shiftright", e, b).bitwiseAND(1) == 1, acc * F.element_at(squares, b + 1) % PRIMES[k]).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(e.cast("double") + 1)).cast("int")), F.lit(1).cast("long"), step)


def stored_turns(conversations: DataFrame) -> DataFrame:
    """``ref, conv_id, turn, role, text`` of all rows with a conv_id, written; ``ref`` is the row's number."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    return written(rows.filter("conv_id is not null").withColumn("ref", F.monotonically_increasing_id()))


def _prefixes(stored: DataFrame, numbers: _Numbers, p: TrieParams) -> DataFrame:
    """``conv_id, pos, ref, n_words, t0, t1, s0, s1``: every turn with its term and the sum of the terms up
    to it, for both primes."""
    mark = F.xxhash64(F.lit(numbers.seed), "role", "text")
    turns = stored.select("conv_id", "turn", "role", "ref", words(F.col("text")).alias("n_words"), F.shiftrightunsigned(mark, 64 - p.hash_bits).alias("mark"))
    order = [F.col("turn").asc_nulls_first(), "role", "mark", "ref"]
    ranged = in_ranges(turns, "conv_id", *order)
    placed = running_sums(ranged, ["conv_id"], order, {"pos": F.lit(1).cast("long")})
    halves = (F.col("mark") % PRIMES[0], F.shiftright("mark", 31) % PRIMES[1])
    placed = written(placed.withColumns({f"t{k}": (halves[k] + 1) * _power(numbers, k, F.col("pos")) % PRIMES[k] for k in (0, 1)}))
    sums = running_sums(placed, ["conv_id"], order, {"s0": F.col("t0"), "s1": F.col("t1")})
    return written(sums.select("conv_id", "pos", "ref", "n_words", "t0", "t1", *((F.col(f"s{k}") % PRIMES[k]).alias(f"s{k}") for k in (0, 1))))


def _joined(sums: list[Column]) -> Column:
    return F.shiftleft(sums[0], 31) + sums[1]


def rebuilt_paths(prefixes: DataFrame, numbers: _Numbers, p: TrieParams) -> DataFrame:
    """``conv_id, depth, node, parent, ref, n_words, last``: every prefix of every rebuilt conversation, from
    the empty one. ``node`` and ``parent`` are fingerprints."""
    head = F.when(F.col("pos") < p.most_head, F.struct("pos", "s0", "s1", "ref", "n_words"))
    convs = written(prefixes.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(head)).alias("first")))
    base = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    cut = F.col("conv_id") - F.col("conv_id") % p.block
    splice = convs.withColumn("base", cut).join(base, "base", "left").withColumn("h", F.crc32(F.col("conv_id").cast("string")) % p.most_head)
    taken = F.slice(F.coalesce("base_first", F.array().cast(base.schema["base_first"].dataType)), F.lit(1), F.col("h").cast("int"))
    splice = splice.withColumn("head", taken).withColumn("k", F.size("head").cast("long")).withColumn("size", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    at = lambda items, i, k: F.coalesce(F.get(items, i.cast("int") - 1)[f"s{k}"], F.lit(0).cast("long"))
    for k in (0, 1):
        # The suffix moves from behind h turns to behind those of the head: fewer where the base is short.
        shifts = F.array(*(F.lit(numbers.power(k, -e)) for e in range(p.most_head)))
        splice = splice.withColumns({f"b{k}": at(F.col("head"), F.col("k"), k), f"c{k}": at(F.col("first"), F.col("h"), k), f"m{k}": F.element_at(shifts, (F.col("h") - F.col("k") + 1).cast("int"))})
    splice = written(splice.drop("first", "base_first", "base"))

    zero = F.lit(0).cast("long")
    row = lambda depth, node, parent, ref, n: [depth.cast("long").alias("depth"), node.alias("node"), parent.alias("parent"), ref.alias("ref"), n.alias("n_words")]
    none = F.lit(None).cast("long")
    root = splice.select("conv_id", *row(zero, zero, none, none, zero), (F.col("size") == 0).alias("last"))
    heads = splice.select("conv_id", "size", "head", F.explode("head").alias("e"))
    before = F.when(F.col("e.pos") > 1, _joined([at(F.col("head"), F.col("e.pos") - 1, k) for k in (0, 1)])).otherwise(0)
    heads = heads.select("conv_id", *row(F.col("e.pos"), _joined([F.col("e.s0"), F.col("e.s1")]), before, F.col("e.ref"), F.col("e.n_words")), (F.col("e.pos") == F.col("size")).alias("last"))
    # A long conversation meets its splice in many tasks.
    blocks = F.explode(F.sequence(zero, F.floor(F.col("n") / p.position_block))).alias("part")
    side = splice.select("conv_id", "h", "k", "size", *(f"{x}{k}" for x in "bcm" for k in (0, 1)), blocks)
    own = prefixes.withColumn("part", F.floor(F.col("pos") / p.position_block)).join(side, ["conv_id", "part"]).filter("pos > h")
    sums = lambda upto: _joined([(F.col(f"b{k}") + F.pmod(upto(k) - F.col(f"c{k}"), F.lit(PRIMES[k])) * F.col(f"m{k}")) % PRIMES[k] for k in (0, 1)])
    depth = F.col("pos") - F.col("h") + F.col("k")
    own = own.select("conv_id", *row(depth, sums(lambda k: F.col(f"s{k}")), sums(lambda k: F.col(f"s{k}") - F.col(f"t{k}")), F.col("ref"), F.col("n_words")), (depth == F.col("size")).alias("last"))
    return written(root.transform(united, heads).transform(united, own))


def _groups(paths: DataFrame) -> DataFrame:
    """One row a depth and fingerprint: members, owner, and the ranges of parents and references."""
    found = paths.groupBy("depth", "node").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_words").alias("n_words"), F.min("parent").alias("parent"),
        F.max("parent").alias("last_parent"), F.min("ref").alias("ref"), F.max("ref").alias("last_ref"),
    )
    return written(found)


def _equal(stored: DataFrame, paths: DataFrame, groups: DataFrame) -> bool:
    """Whether every group has one parent, and its stored turns are equal: by induction on the depth its
    members are the same sequence then."""
    if not groups.filter("parent <> last_parent").isEmpty():
        return False
    several = written(groups.filter("ref <> last_ref").select("depth", "node"))
    side = F.broadcast(several) if small_enough(several.count(), 24) else several
    refs = written(paths.join(side, ["depth", "node"], "left_semi").select("depth", "node", "ref").distinct())
    side = F.broadcast(refs) if small_enough(refs.count(), 32) else refs
    said = stored.select("ref", F.struct("role", "text").alias("said")).join(side, "ref")
    # Least and greatest are found before the shuffle, so copies of a turn leave a task once.
    return said.groupBy("depth", "node").agg(F.min("said").alias("a"), F.max("said").alias("b")).filter("a <> b").isEmpty()


def _joined_ids(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Ids of one node after each other, joined in pieces of at most ``size``."""
    at, held, out = None, [], [[], [], [], []]

    def close() -> None:
        if held:
            for o, v in zip(out, (*at, held[0], ",".join(map(str, held)))):
                o.append(v)
            held.clear()

    def ready() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["depth", "node", "start", "ids"])
        for o in out:
            o.clear()
        return batch

    for batch in batches:
        for key, conv in zip(zip(batch.column("depth").to_pylist(), batch.column("node").to_pylist()), batch.column("conv_id").to_pylist()):
            if key != at or len(held) == size:
                close()
                at = key
            held.append(conv)
        if out[0]:
            yield ready()
    close()
    if out[0]:
        yield ready()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node in order, fed piece by piece."""
    at, digest = None, None
    for batch in batches:
        out: list[list] = [[], [], []]
        for key, ids in zip(zip(batch.column("depth").to_pylist(), batch.column("node").to_pylist()), batch.column("ids").to_pylist()):
            if key != at:
                if digest:
                    for o, v in zip(out, (*at, digest.hexdigest())):
                        o.append(v)
                at, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["depth", "node", "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([digest.hexdigest()])], ["depth", "node", "ends_sha256"])


def _ends(paths: DataFrame, p: TrieParams) -> DataFrame:
    """``depth, node, ends_sha256`` of the nodes at which conversations end."""
    order = ["depth", "node", "conv_id"]
    rows = bounded_batches(paths.filter("last").select(*order)).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = rows.mapInArrow(lambda it: _joined_ids(it, p.chunk), "depth long, node long, start long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "start").mapInArrow(_digests, "depth long, node long, ends_sha256 string")


def _subtrees(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``depth, node, n_leaves, saved_tokens``: sums over the subtrees."""
    owned = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"))
    down = paths.select("conv_id", "depth", "node").join(owned, ["conv_id", "depth"], "left").fillna(0, ["leaf", "saved"])
    order = [F.col("depth").desc()]
    upto = running_sums(in_ranges(down, "conv_id", *order), ["conv_id"], order, {"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")})
    return upto.groupBy("depth", "node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_conv_id``. Parents of many children are few, and are broadcast: there are at most
    500,000 above the limit, as each has that part of all nodes. The others meet their children by key."""
    limit = max(256, nodes.count() // 500_000)
    above = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = above.filter(F.col("n_children") > limit).select("depth", "parent", F.col("parent_conv_id").alias("hot_conv_id"))
    cold = above.filter(F.col("n_children") <= limit).select(F.col("depth").alias("key_depth"), F.col("parent").alias("key_parent"), "parent_conv_id")
    found = nodes.join(F.broadcast(hot), ["depth", "parent"], "left")
    # Children of hot parents have found theirs and are spread over keys that no parent has.
    depth = F.when(F.col("hot_conv_id").isNotNull(), -1 - F.pmod("node", F.lit(1000))).otherwise(F.col("depth"))
    found = found.withColumn("key_depth", depth).withColumn("key_parent", F.col("parent")).join(cold, ["key_depth", "key_parent"], "left")
    return found.withColumn("parent_conv_id", F.coalesce("hot_conv_id", "parent_conv_id"))


def prefix_trie(conversations: DataFrame, p: TrieParams = TrieParams()) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every
    node of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text).

    Turns are ordered by ``turn``, null first, then by role and a hash of the text. Null roles and texts are
    empty; rows without a conv_id are no part of a conversation and are left out; repeated rows are turns of
    their own. Remainders of negative numbers are negative, as in SQL. Other columns are ignored. An empty
    table has no conversations and gives an empty result; otherwise the root is there even when no rebuilt
    conversation has a turn.
    """
    stored = stored_turns(conversations)
    seed = p.seed
    while True:
        numbers = _Numbers(seed)
        # A later attempt, after equal hashes of unequal turns, keeps all bits.
        paths = rebuilt_paths(_prefixes(stored, numbers, p if seed == p.seed else TrieParams(p.block, p.most_head, p.position_block, p.chunk)), numbers, p)
        groups = _groups(paths)
        if _equal(stored, paths, groups):
            break
        seed += 1
    children = groups.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(groups.join(children, ["depth", "node"], "left").fillna(0, ["n_children"]).select("depth", "node", "conv_id", "parent", "n_convs", "n_words", "n_children"))
    whole = _with_parents(nodes).join(_subtrees(paths, nodes), ["depth", "node"]).join(_ends(paths, p), ["depth", "node"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))

"""Prefix trie, whitening and source mix against brute force, and their edge cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute_trie import trie

TURNS = "conv_id long, turn long, role string, text string"


def nodes(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def conversations(rng):
    """Few texts, so that prefixes are shared; copies, a long conversation, gaps in the numbers, odd rows."""
    said = ["", "a", "b c", "b  c\n", None, "é d"]
    rows = []
    for c in rng.sample(range(200), 90):
        n = 60 if c % 31 == 0 else rng.randint(1, 6)
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else "user", rng.choice(said) if rng.random() < 0.5 else "a") for t in range(n)]
    rows += [(500 + i, t, "user", "same") for i in range(40) for t in range(3)]
    return rows + [rows[0], (None, 0, "user", "nobody"), (1000, None, None, None)]


@pytest.mark.parametrize("bits", [62, 2])
def test_trie_like_brute_force(spark, bits):
    """With two bits of a turn's hash most groups are wrong at first, and are found so."""
    from swatchwork.llm.prefixtrie import TrieParams, prefix_trie

    rows = conversations(random.Random(4))
    if bits == 2:  # rows of one turn are ordered by the hash
        rows = [(c, t, "user", x) for c, t, _, x in rows if t is not None and c != rows[0][0]]
    df = spark.createDataFrame(rows, TURNS).withColumns({"pos": F.lit(1), "depth": F.lit("x"), "node": F.lit(2)})
    got = nodes(prefix_trie(df, TrieParams(position_block=4, chunk=3, hash_bits=bits)))
    want = trie(rows)
    if bits == 62:  # turns without a number are ordered by a hash behind their role: compare what does not depend on it
        assert len([r for r in got if r[1] == 0]) == 1 and got != []
        rows = [(c, t, r, x) for c, t, r, x in rows if t is not None and (c, t) != rows[0][:2]]
        df, want = spark.createDataFrame(rows, TURNS), trie(rows)
        got = nodes(prefix_trie(df, TrieParams(position_block=4, chunk=3)))
    assert got == sorted(want, key=repr)


def test_trie_of_edge_tables(spark):
    from swatchwork.llm.prefixtrie import prefix_trie

    assert prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0
    # crc32 of "1" leaves 3: without a base the first three turns go, and the conversation has none.
    (root,) = prefix_trie(spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "user", "y")], TURNS)).collect()
    assert (root.conv_id, root.depth, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (1, 0, None, 1, 0, 1, 0)


def test_running_sums_over_ranges(spark):
    from swatchwork.llm.running import running_sums

    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(40), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame([(*r, at // 500) for at, r in enumerate(sorted(rows))], "k long, i long, v long, _range int").repartition(5)
    got = {(r.k, r.i): r.s for r in running_sums(df, ["k"], ["i"], {"s": F.col("v")}).collect()}
    upto = defaultdict(int)
    for k, i, v in sorted(rows):
        upto[k] += v
        assert got[k, i] == upto[k]


def spectra(rng):
    turn = lambda values: (lambda q: q @ np.diag(values) @ q.T)(np.linalg.qr(rng.normal(size=(len(values), len(values))))[0])
    yield np.array([[3.0]])
    yield np.diag([1.0, 1.0, 1.0, 5.0])
    yield 3 * np.eye(5)
    yield np.zeros((4, 4))
    yield turn([1, 2, 3, 1, 2, 3.0])
    yield turn(10.0 ** -np.linspace(0, 12, 40))
    yield turn([1 + 1e-9 * i for i in range(20)])
    yield turn([1e-3, 1, 1, 1, 1, 1, 1, 1.0])
    half = rng.normal(size=(64, 20))
    yield half @ half.T


def test_spectral_divide_and_conquer():
    from swatchwork.llm.whitening import eigen, matrix_sign

    for a in spectra(np.random.default_rng(1)):
        a = (a + a.T) / 2
        values, vectors = eigen(a)
        size = max(np.abs(a).max(), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size
    a = np.random.default_rng(2).normal(size=(30, 30))
    sign = matrix_sign(a + a.T)
    assert np.abs(sign @ sign - np.eye(30)).max() < 1e-13


def test_whitening_like_numpy(spark):
    from swatchwork.llm.whitening import WhitenParams, whiten

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    fine = [*rows, rows[5], (None, rows[6][1])]
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (1003, [1.0, math.nan, 2.0, 3.0, 4.0, 5.0]), (1004, [1.0, math.inf, 2.0, 3.0, 4.0, 5.0]), (1005, [-math.inf] * 6), (1006, [1.0, 2.0]), (1007, [1e300] * 6)]
    df = spark.createDataFrame(fine + odd, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "n": F.lit(2), "z": F.lit(3)}).repartition(3)
    got = defaultdict(list)
    for r in whiten(df, WhitenParams(components=4)).collect():
        got[r.vec_id].append(r)
    k = np.floor(64 * np.array([v for _, v in fine])).astype(np.int64) + 1_000_000
    n, s = len(k), k.sum(axis=0)
    y = (n * k - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, z = values[::-1], (y @ vectors / np.sqrt(values))[:, ::-1]
    assert set(got) == {*range(400), None} and len(got[5]) == 8
    for (i, _), row, exact in zip(fine, z, ((n * k - s) ** 2).sum(axis=1)):
        for r in got[i]:
            assert r.n == n and r.deviation == exact and abs(abs(r.whitened) - abs(row[r.component - 1])) < 1e-9
            assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-10


def test_whitening_of_edge_tables(spark):
    from swatchwork.llm.whitening import whiten

    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whiten(make([])).count() == 0 and whiten(make([(1, None), (2, [])])).count() == 0
    for r in whiten(make([(1, [0.5, 0.5])] * 3)).collect():  # no variance at all
        assert (r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (3, 0, None, None, None)
    got = whiten(make([(1, [0.5, 1.0]), (2, [0.5, 3.0]), (3, [0.5, 5.0])])).collect()  # variance in one dimension
    assert {r.whitened is None for r in got if r.component == 2} == {True} and max(r.identity_error for r in got) < 1e-12
    far = [(1, [2.0**50, 0.0]), (2, [-(2.0**50), 1.0]), (3, [0.0, 2.0])]  # squares beyond a long
    assert {r.deviation is None for r in whiten(make(far)).collect() if r.vec_id < 3} == {True}


def targets(sizes, percent=100, weights=(5, 2, 1), most=3):
    """Water filling by hand: (source, size) in rank order -> target."""
    budget, open_, out = percent / 100 * sum(sizes.values()), {}, {}
    for rank, s in enumerate(sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)):
        open_[s] = weights[rank % len(weights)]
    while True:
        level = (budget - sum(out.values())) / sum(open_.values()) if open_ else 0
        above = [s for s, w in open_.items() if level * w > most * sizes[s]]
        if not above:
            return out | {s: level * w for s, w in open_.items()}
        out |= {s: float(most * sizes[s]) for s in above}
        for s in above:
            del open_[s]


def documents(rng):
    rows = [(i, " ".join("x" * rng.randint(1, 3) for _ in range(rng.randint(1, 60))), "big") for i in range(600)]
    rows += [(1000 + i, "a b\tc d e\x85f g", rng.choice(["a", "\U0001f600", "￿", "", None])) for i in range(150)]
    rows += [(3000, "one copy of many words again and again", "copies")] * 300  # one place
    return [*rows, (2000, None, "a"), (2001, "", "empty"), (None, "no id here", "a"), (None, "no id here", "a")]


def test_mix_like_brute_force(spark):
    from swatchwork.llm.mixing import MixParams, mix, mixture

    rows = documents(random.Random(7))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "name": F.lit("n"), "key": F.lit(2), "row": F.lit(3), "budget": F.lit(4)}).repartition(6)
    got = [tuple(r) for r in mix(df.drop("size"), MixParams(percents=(10, 40, 100))).collect()]
    assert len(got) == len(rows)
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in mix(df.repartition(3), MixParams(percents=(10, 40, 100))).collect()), "a second run agrees"
    size = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    by_target = {s: targets(sizes, q)[s] for q in (100,) for s in sizes}
    source = {(i, size(t)): s for i, t, s in rows}
    taken, most = defaultdict(lambda: [0, 0, 0]), defaultdict(int)
    for i, n, total, target, took, at in got:
        s = source[i, n]
        assert total == sizes[s] and abs(target - by_target[s]) < 1e-6 and took == at[-1] <= 3 * n and at == sorted(at)
        most[s] = max(most[s], n)
        for k, v in enumerate(at):
            taken[s][k] += v
    for k, q in enumerate((10, 40, 100)):
        want = targets(sizes, q)
        assert all(abs(taken[s][k] - want[s]) <= most[s] / 2 + 1e-6 for s in sizes)
    whole = mixture(df)
    assert whole.columns == df.columns
    assert whole.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).filter("source = 'copies'").first()["n"] == taken["copies"][2]


def test_mix_of_edge_tables(spark):
    from swatchwork.llm.mixing import mix

    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mix(make([])).count() == 0
    assert [tuple(r)[1:5] for r in mix(make([(1, None, None), (2, " ", "s")])).collect()] == [(0, 0, 0.0, 0)] * 2
    assert [tuple(r)[:5] for r in mix(make([(1, "a b", "s")]).drop("source")).collect()] == [(1, 2, 2, 2.0, 2)]

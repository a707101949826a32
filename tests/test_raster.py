"""Components, simplification and near pairs against plain Python."""

import contextlib
import io
import random

from swatchwork.operators import boxes as B
from swatchwork.operators import compare as C
from swatchwork.operators import curves as K
from swatchwork.operators import raster as R
from swatchwork.operators.graph import connected_components


def flood(cells):
    left, n = set(cells), 0
    while left:
        todo = [left.pop()]
        n += 1
        while todo:
            y, x = todo.pop()
            near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
            left -= near
            todo += near
    return n


def test_components_of_random_masks(spark):
    rng = random.Random(4)
    masks = {d: {(y, x) for y in range(20) for x in range(20) if rng.random() < 0.35} for d in range(3)}
    df = spark.createDataFrame([(d, y, x) for d, m in masks.items() for y, x in m], "doc_id long, y int, x int")
    stats = R.component_stats(R.component_runs(df)).collect()
    for d, m in masks.items():
        own = [s for s in stats if s.doc_id == d]
        assert len(own) == flood(m) and sum(s.area for s in own) == len(m)
        assert sorted(s.comp_id for s in own) == list(range(1, len(own) + 1))


def test_components_of_long_chains_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "src long, dst long")
    for last in (0, 10, 20_000):
        got = {r.node: r.component for r in connected_components(chain, last_rows=last).collect()}
        assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert connected_components(chain.limit(0)).count() == 0


def test_near_pairs_once_each(spark):
    rng = random.Random(2)
    box = [(0, i, *(lambda x, y, w, h: (x, y, x + w, y + h))(rng.uniform(0, 90), rng.uniform(0, 90), rng.uniform(0, 30), rng.uniform(0, 30))) for i in range(40)]
    got = sorted((r.idx, r.o_idx) for r in B.near_pairs(spark.createDataFrame(box, "doc_id long, idx int, x0 double, y0 double, x1 double, y1 double"), 6.0).collect())
    want = sorted((a[1], b[1]) for a in box for b in box if a[1] < b[1] and a[2] - 6 <= b[4] and b[2] - 6 <= a[4] and a[3] - 6 <= b[5] and b[3] - 6 <= a[5])
    assert got == want


def test_simplify_like_recursion(spark):
    rng = random.Random(3)
    pts = [(i, float(i), rng.uniform(0, 20)) for i in range(60)]

    def keep(a, b):
        if b <= a + 1:
            return set()
        (_, ax, ay), (_, bx, by) = pts[a], pts[b]
        size = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        d, i = max((round(abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / size, 9), -i) for i, x, y in pts[a + 1 : b])
        return {-i} | keep(a, -i) | keep(-i, b) if d > 4 else set()

    df = spark.createDataFrame([(1, *p) for p in pts], "curve_id long, seq int, x double, y double")
    assert {r.seq for r in K.simplify(df, 4.0).collect()} == {0, 59} | keep(0, 59)


def bars(spark, gap):
    px = [(1, y, x, *([0, 0, 0] if x % 16 < 8 and 8 <= y < 56 and not (gap and 30 <= y < 36) else [255, 255, 255]), 255) for y in range(64) for x in range(64)]
    return spark.createDataFrame(px, "doc_id long, y int, x int, r int, g int, b int, a int")


def test_topology_sees_a_split(spark):
    whole = C.topology_summary(C.component_topology(bars(spark, False), bars(spark, False), 64, 64)).first()
    split = C.component_topology(bars(spark, False), bars(spark, True), 64, 64).collect()
    assert (whole.components, whole.worst) == (4, 100.0)
    assert all(r.fragments == 2 and r.score < 60 for r in split)


def test_identical_pictures_are_perfect(spark):
    got = C.foreground_match(bars(spark, False), bars(spark, False), 64, 64).first()
    assert (got.score, got.recall, got.precision) == (100.0, 100.0, 100.0)


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_pixels_are_never_broadcast(spark):
    """Spark takes exploded rows and compressed files for small; they went through the driver."""
    from swatchwork.runtime import written

    shapes = spark.createDataFrame([(d, 1, 5, 5, 3, 10, 20, 30) for d in range(2)], "doc_id long, z int, cx int, cy int, rad int, r int, g int, b int")
    px = R.rasterize(shapes, 12, 10)
    mask = written(px.filter("r < 255").select("doc_id", "y", "x"))
    for df in (px, R.erode(mask), R.denoise(written(px)), C.best_match(written(px), written(px)), C.pair_gate(written(px), written(px))):
        assert "Broadcast" not in plan(df)


def test_canvas_rows_keep_every_pixel(spark):
    """Overlap, clipping, null tones, documents without a shape, and shapes of no listed document."""
    rows = [(1, 1, 0, 0, 2, 10, 20, 30), (1, 2, 1, 1, 1, 40, None, 60), (2, 1, 50, 50, 3, 1, 2, 3), (9, 1, 3, 3, 1, 7, 7, 7)]
    shapes = spark.createDataFrame(rows, "doc_id long, z int, cx int, cy int, rad int, r int, g int, b int")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    want = {}
    for d in (1, 2, 3):
        for y in range(6):
            for x in range(8):
                hit = [s for s in rows if s[0] == d and (y - s[3]) ** 2 + (x - s[2]) ** 2 <= s[4] ** 2]
                top = max(hit, key=lambda s: s[1])[5:] if hit else (255, 255, 255)
                want[d, y, x] = tuple(255 if c is None else c for c in top) + (255,)
    got = R.rasterize(shapes, 6, 8, docs=docs).collect()
    assert len(got) == len(want) and {tuple(r[:3]): tuple(r[3:]) for r in got} == want


def test_circles_meet_by_shuffle(spark):
    from swatchwork.operators import shapes as S
    from swatchwork.runtime import written

    circles = written(spark.createDataFrame([(1, 1, 5, 5, 4), (1, 2, 6, 5, 2)], "doc_id long, z int, cx int, cy int, rad int"))
    found = S.concentric_rings(circles)
    assert "Broadcast" not in plan(found) and [tuple(r) for r in found.collect()] == [(1, 1, 2, 3.0, 2)]


def test_a_written_border_meets_its_colours_by_shuffle(spark, monkeypatch):
    """A border that is written looks small to Spark: only one row a document may be broadcast."""
    px = spark.range(4).selectExpr("id AS doc_id", "explode(sequence(0, 9)) AS y").selectExpr("doc_id", "y", "explode(sequence(0, 9)) AS x").selectExpr("*", "cast(x * y + doc_id AS int) AS r", "10 AS g", "20 AS b", "255 AS a")
    px = R.written(px)
    plans, real = [], C.written
    monkeypatch.setattr(C, "written", lambda df: plans.append(plan(df)) or real(df))
    got = {r.doc_id: (r.bg_r, r.noise_p95) for r in C.border_stats(px, 10, 10).collect()}
    assert len(plans) == 2 and "Broadcast" not in plans[1]
    for d in range(4):
        tones = sorted(x * y + d for y in range(10) for x in range(10) if y in (0, 9) or x in (0, 9))
        middle = (tones[17] + tones[18]) / 2
        off = sorted(abs(t - middle) for t in tones)
        assert got[d] == (middle, off[33] + 0.25 * (off[34] - off[33]))


def test_many_hooks_meet_by_shuffle(spark, monkeypatch):
    """Written hooks look small to Spark; they are broadcast only while their counted rows are few."""
    from swatchwork import runtime
    from swatchwork.operators import graph

    edges = spark.range(300).selectExpr("struct(id % 3 AS doc_id, id AS y) AS src", "struct(id % 3 AS doc_id, id + 3 AS y) AS dst")
    for most, word in ((0, False), (1 << 20, True)):
        plans, real = [], R.written
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", most)
        monkeypatch.setattr(graph, "written", lambda df: plans.append(plan(df)) or real(df))
        parts = connected_components(edges, last_rows=0)
        monkeypatch.setattr(graph, "written", real)
        assert any("Broadcast" in p for p in [*plans, plan(parts)]) == word
        assert all(tuple(r.component) == (r.node.doc_id, r.node.doc_id) for r in parts.collect())


def test_pieces_are_the_components_of_runs(spark):
    """Over many bands, with what the pixels carry: every pixel has the number that component_runs gives it."""
    rng = random.Random(8)
    rows = [(d, y, x, 1000 * y + x) for d in range(3) for y in range(40) for x in range(20) if rng.random() < 0.45]
    px = spark.createDataFrame(rows, "doc_id long, y int, x int, v long")
    pieces, names = R.component_pieces(px, ["v"], band=4)
    got = {(r.doc_id, y, x): r.comp_id for r in pieces.join(names, R.PIECE).collect() for y, x, v in zip(r.ys, r.xs, r.vs) if v == 1000 * y + x}
    want = {(r.doc_id, r.y, x): r.comp_id for r in R.component_runs(px.select(*R.PIXEL)).collect() for x in range(r.x0, r.x1 + 1)}
    assert got == want and len(got) == len(rows)


def test_thin_lines_are_written_as_pieces(spark, monkeypatch):
    """No table with a row a pixel is written or joined; moments and tones are those of plain Python."""
    from swatchwork.operators import audits as Q

    rows = [(1, i + 30, 2 * i // 3, 10 * (i % 7), 100 - i, 0) for i in range(90)] + [(1, y, x, 0, 0, 0) for y in range(5) for x in range(5)]
    px = spark.createDataFrame(rows, "doc_id long, y int, x int, r int, g int, b int")
    stats = spark.createDataFrame([(1, 255.0, 255.0, 255.0, 6.0)], "doc_id long, bg_r double, bg_g double, bg_b double, threshold double")
    sizes = []
    for module in (Q, R):
        monkeypatch.setattr(module, "written", lambda df, real=module.written: sizes.append(real(df)) or sizes[-1])
    (got,) = Q.linear_details(px, stats).collect()
    assert max(s.count() for s in sizes) < 10
    line = rows[:90]
    middle = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    assert got.area == 90 and (got.r, got.g, got.b) == tuple(middle([p[3 + k] for p in line]) for k in range(3))

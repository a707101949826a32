"""Operators that no SQL twin checks, against plain Python on random tables."""

import random

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("reach,band", [(1, 3), (0, 3), (1, 64)])
def test_components_over_bands(spark, reach, band):
    """Runs that wind through many bands, numbered as a flood fill numbers them."""
    from swatchwork.operators.raster import component_runs

    rng = random.Random(5)
    cells = {(d, y, x) for d in (4, 9) for y in range(20) for x in range(17) if rng.random() < 0.45}
    cells |= {(1, y, 0 if y % 2 else x) for y in range(14) for x in (0, 2, 4)}
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0) and (reach or 0 in (dy, dx))]
    want, left, number = {}, set(cells), {}
    for first in sorted(cells):
        if first not in left:
            continue
        number[first[0]] = number.get(first[0], 0) + 1
        todo = [first]
        left.discard(first)
        while todo:
            d, y, x = todo.pop()
            want[d, y, x] = number[d]
            for dy, dx in near:
                other = (d, y + dy, x + dx)
                if other in left:
                    left.discard(other)
                    todo.append(other)
    mask = spark.createDataFrame(sorted(cells), "doc_id long, y int, x int")
    rows = component_runs(mask, reach, band).collect()
    assert {(r.doc_id, r.y, x): r.comp_id for r in rows for x in range(r.x0, r.x1 + 1)} == want
    assert component_runs(mask.limit(0), reach, band).count() == 0


def test_anchor_of_least_conflicts(spark):
    from swatchwork.operators.boxes import order_conflicts

    rng = random.Random(3)
    el, groups = [], {}
    for doc in range(4):
        for idx in range(30):
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            el.append((doc, idx, x, y, x + rng.uniform(2, 25), y + rng.uniform(2, 25)))
            if rng.random() < 0.5:
                groups[doc, idx] = rng.randrange(4)
    box = {(d, i): b for d, i, *b in el}
    meet = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    want = set()
    for doc, g in {(d, g) for (d, _), g in groups.items()}:
        own = [i for (d, i), k in groups.items() if (d, k) == (doc, g)]
        ways = []
        for anchor in own:
            hits = sum(meet(box[doc, m], box[doc, o]) for m in own for o in range(30) if min(m, anchor) < o < max(m, anchor) and groups.get((doc, o)) != g)
            ways.append((hits, sum(abs(m - anchor) for m in own), anchor))
        hits, moved, anchor = min(ways)
        want.add((doc, g, anchor, hits, moved))
    rows = order_conflicts(spark.createDataFrame(el, "doc_id long, idx int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame([(*k, g) for k, g in groups.items()], "doc_id long, idx int, group_id int"))
    assert {tuple(r[c] for c in ("doc_id", "group_id", "anchor", "conflicts", "moved")) for r in rows.collect()} == want


def test_bounded_sample_keeps_the_heavy_half(spark):
    from swatchwork.operators.palette import bounded_sample

    rng = random.Random(8)
    colours = sorted({(rng.randrange(256), rng.randrange(256), rng.randrange(256)) for _ in range(300)})
    rows = [(1, *c, rng.randrange(1, 50)) for c in colours] + [(2, *c, 1) for c in colours[:40]]
    got = {tuple(r) for r in bounded_sample(spark.createDataFrame(rows, "doc_id long, r int, g int, b int, w long"), 40).collect()}
    own = sorted((r for r in rows if r[0] == 1), key=lambda r: (-r[4], r[1:4]))
    rest = sorted(own[20:], key=lambda r: r[1:4])
    step = (len(own) - 20 - 1) / 19
    # Evenly spaced places from the first to the last of the rest.
    spaced = {rest[int(k * step)] for k in range(20)}
    assert {r for r in got if r[0] == 2} == {r for r in rows if r[0] == 2}
    assert {r for r in got if r[0] == 1} == set(own[:20]) | spaced


def test_farthest_colours_one_by_one(spark):
    from swatchwork.operators.palette import farthest_colors

    levels = (3, 35, 67, 99, 131, 163, 195, 227, 251)
    grid = [(r, g, b) for r in levels for g in levels for b in levels]
    pals = {1: [(0, 0, 0), (255, 255, 255)], 2: [(200, 30, 30), (20, 220, 90), (100, 100, 100)]}
    want = {}
    for doc, taken in pals.items():
        taken = list(taken)
        for k in range(5):
            gap = lambda c: min(max(abs(p - q) for p, q in zip(c, t)) for t in taken)
            best = max(grid, key=gap)
            if gap(best) < 48:
                break
            want[doc, k] = (*best, gap(best))
            taken.append(best)
    pal = spark.createDataFrame([(d, k, *map(float, c)) for d, p in pals.items() for k, c in enumerate(p)], "doc_id long, k int, r double, g double, b double")
    assert {(r.doc_id, r.k): (r.r, r.g, r.b, r.gap) for r in farthest_colors(pal, 5).collect()} == want


def test_points_apart_from_the_last_kept(spark):
    from swatchwork.operators.curves import chained_distance_filter

    rng = random.Random(2)
    rows, want = [], set()
    for curve in range(6):
        x = y = 0.0
        last = None
        for seq in range(40):
            x, y = x + rng.uniform(-1, 2), y + rng.uniform(-1, 1)
            rows.append((curve, seq, x, y))
            if last is None or (x - last[0]) ** 2 + (y - last[1]) ** 2 >= 9:
                last = (x, y)
                want.add((curve, seq))
    pts = spark.createDataFrame(rows, "curve_id long, seq int, x double, y double")
    assert {(r.curve_id, r.seq) for r in chained_distance_filter(pts, 3.0).collect()} == want


def test_groups_by_best_edges_within_a_bound(spark):
    from swatchwork.operators.boxes import object_groups

    rng = random.Random(6)
    edges = [(d, a, b, round(rng.random(), 2)) for d in range(3) for a in range(20) for b in range(a + 1, 20) if rng.random() < 0.2]
    want = set()
    for doc in range(3):
        of = {i: {i} for i in range(20)}
        for _, a, b, s in sorted((e for e in edges if e[0] == doc), key=lambda e: (-e[3], e[1], e[2])):
            if s >= 0.7 and of[a] is not of[b] and len(of[a]) + len(of[b]) <= 5:
                whole = of[a] | of[b]
                of.update(dict.fromkeys(whole, whole))
        want |= {(doc, i, min(g)) for i, g in of.items() if len(g) > 1}
    frame = spark.createDataFrame(edges, "doc_id long, a int, b int, score double")
    assert {tuple(r) for r in object_groups(frame, frame, most=5).collect()} == want


def test_a_recolour_keeps_the_structure(spark):
    from swatchwork.operators.documents import structure_signature
    from swatchwork.sources.files import scan_svg

    base = '<svg viewBox="0 0 9 9"><g id="a"><circle r="2" cx="3" fill="#f00" style="fill:#0f0;opacity:.5"/><rect width="2" class="c1"/></g></svg>'
    texts = [
        base, base.replace("#f00", "#00f").replace("#0f0", "#111"), base.replace('class="c1"', 'class="c2" data-paint-role-fill="x" stroke="red"'), base.replace('r="2" cx="3"', 'cx="3" r="2"'),
        base.replace('cx="3"', 'cx="4"'), base.replace("opacity:.5", "opacity:.6"), base.replace("<rect", "<path"), "<svg", base.replace('<rect width="2" class="c1"/>', "").replace("<circle", '<rect width="2" class="c1"/><circle'),
        base.replace("</svg>", '<metadata id="m">x</metadata></svg>'),
    ]
    scanned = scan_svg(spark.createDataFrame(list(enumerate(texts)), "doc_id long, svg string"))
    got = {r.doc_id: r.signature for r in structure_signature(scanned, ("m",)).collect()}
    assert {k for k, v in got.items() if v == got[0]} == {0, 1, 2, 3, 9} and 7 not in got and len(set(got.values())) == 5
    assert {r.signature for r in structure_signature(scanned.filter("doc_id = 9")).collect()} != {got[0]}


def test_a_candidate_in_the_way_is_only_listed(spark):
    from swatchwork.operators.boxes import order_conflicts
    from swatchwork.operators.scene import candidate_manifest

    kind = "doc_id long, idx int, paint string, x0 double, y0 double, x1 double, y1 double"
    nodes = spark.createDataFrame([(1, 0, "red", 0.0, 0.0, 4.0, 4.0), (1, 1, "blue", 3.0, 3.0, 9.0, 9.0), (1, 2, "red", 8.0, 8.0, 12.0, 12.0), (1, 3, "red", 40.0, 40.0, 44.0, 44.0), (1, 4, "green", 41.0, 41.0, 45.0, 45.0)], kind)
    found = spark.createDataFrame(
        [(1, 0, [0, 2], 0.87654, ["fragment-proximity"], 0.0, 0.0, 12.0, 12.0), (1, 3, [3, 4], 0.9, ["matching-bounds"], 40.0, 40.0, 45.0, 45.0)],
        "doc_id long, group_id int, members array<int>, confidence double, reasons array<string>, x0 double, y0 double, x1 double, y1 double",
    )
    groups = found.select("doc_id", F.explode("members").alias("idx"), "group_id")
    first, second = candidate_manifest(found, nodes, order_conflicts(nodes, groups)).orderBy("group_id").collect()
    # Element 1 lies between 0 and 2 and overlaps both, so neither can move to the other.
    assert (first["mode"], first.not_applied_reason, first.anchor, first.confidence, first.paints) == ("manifest-only", "overlapping paint-order inversion", None, 0.8765, ["red"])
    assert (second["mode"], second.not_applied_reason, second.anchor, second.paint_count, second.member_count) == ("actual-dom", None, 3, 2, 2)

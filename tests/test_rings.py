"""Rings, scan conversion and dashes against plain Python and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swatchwork.operators import rings as R


def test_scan_fill_like_point_in_polygon(spark):
    rng = random.Random(3)
    shapes = {}
    for k in range(12):
        n = rng.randint(3, 9)
        shapes[k] = [[(rng.uniform(-3, 20), rng.uniform(-3, 20)) for _ in range(n)] for _ in range(rng.choice([1, 1, 2]))]
    shapes[50] = [[(2, 2), (12, 2), (12, 12), (2, 12)], [(5, 5), (5, 9), (9, 9), (9, 5)]]  # a frame
    rows = [(k, c, s, float(x), float(y)) for k, cs in shapes.items() for c, pts in enumerate(cs) for s, (x, y) in enumerate(pts)]
    pts = spark.createDataFrame(rows, "doc_id long, contour int, seq int, x double, y double")
    spans = R.scan_fill(R.polygon_edges(pts, ["doc_id"]), ["doc_id"])
    got = {tuple(r) for r in R.span_pixels(spans, ["doc_id"], F.lit(18), F.lit(18)).collect()}

    def inside(cs, px, py):
        odd = False
        for pts in cs:
            for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
                if (y1 <= py) != (y2 <= py) and px >= x1 + (py - y1) / (y2 - y1) * (x2 - x1):
                    odd = not odd
        return odd

    assert got == {(k, y, x) for k, cs in shapes.items() for y in range(18) for x in range(18) if inside(cs, x + 0.5, y + 0.5)}


def test_strokes_and_discs(spark):
    line = [(1, 0, s, float(x), float(y), 2.0, True) for s, (x, y) in enumerate([(5, 5), (15, 5), (15, 16)])]
    df = spark.createDataFrame(line, "doc_id long, line long, seq long, x double, y double, half double, round boolean")
    got = {(r.y, r.x) for r in R.span_pixels(R.stroke_spans(df, ["doc_id"]), ["doc_id"], F.lit(30), F.lit(30)).collect()}

    def near(px, py, a, b):
        (ax, ay), (bx, by) = a, b
        t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    for y in range(30):
        for x in range(30):
            d = min(near(x + 0.5, y + 0.5, (5, 5), (15, 5)), near(x + 0.5, y + 0.5, (15, 5), (15, 16)))
            assert abs(d - 2) < 1e-9 or ((y, x) in got) == (d < 2), (y, x)


def trimmed(points):
    """The fit by trimming in numpy."""

    def circle(q):
        if len(q) < 5:
            return None
        a = np.c_[2 * q, np.ones(len(q))]
        s = np.linalg.lstsq(a, (q**2).sum(axis=1), rcond=None)[0]
        return s[0], s[1], math.sqrt(s[2] + s[0] ** 2 + s[1] ** 2)

    keep, fit = np.ones(len(points), bool), circle(points)
    for _ in range(4):
        signed = np.hypot(points[:, 0] - fit[0], points[:, 1] - fit[1]) - fit[2]
        middle = np.median(signed[keep])
        new = np.abs(signed - middle) <= max(1.5, 4.5 * 1.4826 * np.median(np.abs(signed[keep] - middle)))
        if new.sum() < max(5, int(0.65 * len(points))):
            break
        keep, fit = new, circle(points[new])
    d = np.abs(np.hypot(points[:, 0] - fit[0], points[:, 1] - fit[1]) - fit[2])[keep]
    return (*fit, int(keep.sum()), math.sqrt((d**2).mean()), float(np.percentile(d, 95)))


def test_trimmed_circles_like_numpy(spark):
    rng = np.random.default_rng(5)
    curves = {}
    for k in range(14):
        n, r = int(rng.integers(6, 80)), rng.uniform(8, 120)
        a = rng.uniform(0, 6) + np.linspace(0, rng.uniform(1, 6), n)
        p = np.c_[300 + r * np.cos(a), -50 + r * np.sin(a)] + rng.normal(size=(n, 2)) * rng.choice([0.05, 0.8])
        p[rng.random(n) < rng.choice([0, 0.1, 0.3])] += rng.uniform(5, 60)
        curves[k] = p
    rows = [(k, s, float(x), float(y)) for k, p in curves.items() for s, (x, y) in enumerate(p)]
    rows += [(100, s, float(s), 2.0 * s) for s in range(9)] + [(101, s, float(s), float(s * s)) for s in range(4)] + [(102, 0, None, 1.0)]
    got = {r.curve_id: r for r in R.mad_circles(spark.createDataFrame(rows, "curve_id long, seq int, x double, y double"), ["curve_id"]).collect()}
    assert set(got) == set(curves), "a line, four points and nulls have no circle"
    for k, p in curves.items():
        cx, cy, radius, n, rms, p95 = trimmed(p)
        r = got[k]
        assert r.n == n and np.allclose([r.cx, r.cy, r.radius, r.rms, r.p95], [cx, cy, radius, rms, p95], rtol=1e-7, atol=1e-7)


def dashes(on, radius):
    """Dash list by walking the circle once, from the middle of its first largest gap."""
    bins = len(on)
    if all(on):
        return 0.0, []
    gaps = []
    for s in range(bins):
        if not on[s] and on[s - 1]:
            n = 0
            while not on[(s + n) % bins]:
                n += 1
            gaps.append((-n, s, n))
    _, s, n = min(gaps)
    middle = (s + n // 2) % bins
    turned = [on[(middle + k) % bins] for k in range(bins)]
    runs, last = [0], False
    for v in turned:
        if v != last:
            runs.append(0)
            last = v
        runs[-1] += 1
    if last:
        runs.append(0)
    runs = [0, *runs]
    return -360.0 * middle / bins, [c * 2 * math.pi * radius / bins for c in runs + [0] * (len(runs) % 2)]


def test_dashes_like_a_walk(spark):
    rng = random.Random(8)
    circles = {k: [rng.random() < rng.choice([0.3, 0.8]) for _ in range(24)] for k in range(30)}
    circles |= {50: [True] * 24, 51: [True] * 23 + [False], 52: [False] + [True] * 23, 53: [False] * 10 + [True] * 4 + [False] * 10, 54: [True] * 4 + [False] * 16 + [True] * 4}
    circles = {k: v for k, v in circles.items() if any(v)}
    marks = spark.createDataFrame([(k, b) for k, v in circles.items() for b, on in enumerate(v) if on], "k long, bin int")
    radius = spark.createDataFrame([(k, 10.0 + k) for k in circles], "k long, radius double")
    got = {r.k: (r.rotation, r.dashes) for r in R.ring_dashes(marks, radius, ["k"], 24).collect()}
    for k, v in circles.items():
        rotation, want = dashes(v, 10.0 + k)
        assert got[k][0] == pytest.approx(rotation) and got[k][1] == pytest.approx(want), (k, v)


def arc(doc, name, cx, cy, r, a0, a1, width=8.0, paint="#112233", n=40):
    pts = [(doc, name, s, cx + r * math.cos(math.radians(a)), cy + r * math.sin(math.radians(a))) for s, a in enumerate(np.linspace(a0, a1, n))]
    return pts, (doc, name, paint, width, 1.0, "round", "round")


def rings(spark, *arcs):
    pts = spark.createDataFrame([p for a, _ in arcs for p in a], "doc_id long, arc_id long, seq int, x double, y double")
    lines = spark.createDataFrame([x for _, x in arcs], "doc_id long, arc_id long, paint string, width double, opacity double, linecap string, linejoin string")
    views = spark.createDataFrame([(d, 320.0, 320.0) for d in range(9)], "doc_id long, view_w double, view_h double")
    return {(r.doc_id, r.ring): r for r in R.ring_candidates(pts, lines, views).collect()}


def test_ring_gate(spark):
    one = lambda doc, **k: (arc(doc, 1, 160, 160, 112, -155, -25, 8.0), arc(doc, 2, 160.5, 159.7, 112.2, 25, 155, **{"width": 8.2} | k))
    got = rings(
        spark, *one(0), *one(1, paint="#112234"), *one(2, width=14.0),
        # Ids of the arcs repeat in every document: red and blue must not meet through document 0.
        arc(3, 1, 160, 160, 90, 0, 100, paint="red"), arc(3, 2, 160, 160, 90, 120, 220, paint="blue"),
        # Arcs on each other, and too little of the circle.
        arc(4, 1, 160, 160, 90, 0, 200), arc(4, 2, 160, 160, 90, 20, 210), arc(5, 1, 160, 160, 90, 0, 60), arc(5, 2, 160, 160, 90, 100, 170),
        # A wave around the circle stays within the radial limit, but not within a pixel.
        *(((lambda a: ([(d, i, s, 160 + (x - 160) * (1 + 0.026 * math.sin(s / 2)), 160 + (y - 160) * (1 + 0.026 * math.sin(s / 2))) for d, i, s, x, y in a[0]], a[1]))(arc(6, i, 160, 160, 90, a0, a0 + 150, width=1.0, n=200))) for i, a0 in ((1, 0), (2, 180))),
    )
    assert {k for k in got if k[0] != 6} == {(0, 1)}
    r = got[0, 1]
    assert r.safe and r.reasons == [] and r.arc_ids == [1, 2] and r.f1 > 0.985
    assert abs(r.cx - 160.25) < 1 and abs(r.cy - 159.85) < 1 and abs(r.radius - 112.1) < 1 and r.degrees > 250 and abs(r.width - 8.1) < 0.01
    assert len(r.dashes) % 2 == 0 and r.dashes[0] == 0 and sum(r.dashes) == pytest.approx(2 * math.pi * r.radius)
    assert sum(r.dashes[::2]) == pytest.approx(2 * math.pi * r.radius * r.degrees / 360)
    wave = got[6, 1]
    assert not wave.safe and wave.reasons and wave.reasons[0].startswith("raster recall")


def test_spans_are_never_spread_to_be_counted(spark):
    """Bins and pixels went through a hash table of all of them; spans are parted by a sort instead."""
    from swatchwork.operators import curves as K
    from tests.test_raster import plan

    rng = random.Random(6)
    rows = [(rng.randint(0, 2), k // 2, *sorted((rng.uniform(-400, 700), rng.uniform(-400, 700)))) for k in range(24)] + [(7, 99, 10.0, 900.0), (8, 98, 30.0, 30.0)]
    arcs = spark.createDataFrame(rows, "doc_id long, arc_id long, a0 double, a1 double").withColumn("ring", F.lit("p"))
    covered = {(d, a): set() for d, a, _, _ in rows}
    for d, a, a0, a1 in rows:
        first, last = sorted((math.floor(a0), math.ceil(a1) - 1))
        covered[d, a] |= {b % 360 for b in range(first, last + 1)}
    got = {r.doc_id: (r.degrees, r.overlap) for r in K.arc_coverage(arcs).collect()}
    for d in {r[0] for r in rows}:
        total, union = sum(len(b) for (doc, _), b in covered.items() if doc == d), set().union(*(b for (doc, _), b in covered.items() if doc == d))
        assert got[d] == (len(union), round((total - len(union)) / total, 6))
    spans = [(1, rng.randint(-1, 6), x, x + rng.randint(0, 6)) for x in (rng.randint(-4, 12) for _ in range(40))]
    px = R.span_pixels(spark.createDataFrame(spans, "doc_id long, y int, x0 int, x1 int"), ["doc_id"], F.lit(6), F.lit(10))
    want = sorted({(1, y, x) for _, y, a, b in spans for x in range(a, b + 1) if 0 <= y < 6 and 0 <= x < 10})
    assert "Aggregate" not in plan(px) and sorted(map(tuple, px.collect())) == want


def test_agreement_of_spans_like_pixels(spark):
    rng = random.Random(7)
    sets = [{(k, y, x) for k in range(3) for y in range(9) for x in range(9) if rng.random() < 0.15} for _ in range(2)]
    sets[0] |= {(5, 1, 1)}
    sets[1] |= {(6, 1, 1)}
    spans = [spark.createDataFrame([(*p, p[2]) for p in sorted(s)], "k long, y int, x0 int, x1 int") for s in sets]
    near = [{(k, y + dy, x + dx) for k, y, x in s for dy in (-1, 0, 1) for dx in (-1, 0, 1)} for s in sets]
    share = lambda k, own, other: (lambda m: len(m & other) / len(m) if m else 0.0)({p for p in own if p[0] == k})
    got = {r.k: (r.recall, r.precision) for r in R.raster_agreement(*spans, ["k"]).collect()}
    assert got == {k: (share(k, sets[0], near[1]), share(k, sets[1], near[0])) for k in (0, 1, 2, 5, 6)}

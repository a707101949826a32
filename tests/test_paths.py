"""Path curves, arcs by end points and boxes against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from swatchwork.operators import paths as P
from swatchwork.operators.checks import sample_path


def test_end_point_arcs(spark):
    rng = random.Random(1)
    arcs = [[rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([0.5, 4.0, 20.0, -7.0]), rng.choice([0.5, 6.0, 15.0]), rng.uniform(-400, 400), float(a), float(b), rng.uniform(-9, 9), rng.uniform(-9, 9)] for a in (0, 1) for b in (0, 1) for _ in range(12)]
    arcs += [[0.0, 0.0, 5.0, 5.0, 0.0, 0.0, 1.0, 10.0, 0.0], [0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 1.0, 10.0, 0.0], [1.0, 1.0, 5.0, 5.0, 0.0, 1.0, 1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(1, k, "svg_arc", p) for k, p in enumerate(arcs)], "doc_id long, seg int, kind string, p array<double>")
    centre = {r.seg: r.a for r in df.select("seg", P.endpoint_arc(F.col("p")).alias("a")).collect()}
    points = {}
    for r in sample_path(df, 0.5).orderBy("seg", "k").collect():
        points.setdefault(r.seg, []).append((r.x, r.y))
    for k, p in enumerate(arcs):
        a = centre[k]
        assert points[k][-1] == pytest.approx((p[7], p[8]), abs=1e-3)
        if a.straight:
            assert k >= len(arcs) - 2 and len(points[k]) == 1
            continue
        cos, sin = math.cos(a.turn), math.sin(a.turn)
        on = lambda x, y: ((cos * (x - a.cx) + sin * (y - a.cy)) / a.rx) ** 2 + ((cos * (y - a.cy) - sin * (x - a.cx)) / a.ry) ** 2
        assert on(p[0], p[1]) == pytest.approx(1, abs=1e-6) and on(p[7], p[8]) == pytest.approx(1, abs=1e-6)
        assert all(on(x, y) == pytest.approx(1, abs=2e-3) for x, y in points[k])
        assert a.rx >= abs(p[2]) - 1e-9 and a.ry / a.rx == pytest.approx(abs(p[3] / p[2]))
        grown = a.rx > abs(p[2]) + 1e-9
        assert (a.sweep > 0) == bool(p[6]) and (grown or k >= 48 or (abs(a.sweep) > math.pi) == bool(p[5]))
        assert not grown or abs(a.sweep) == pytest.approx(math.pi, abs=1e-5)


def walk(d):
    """Curves of a tokenised path, command by command."""
    out, cur, start, c2, q = [], (0.0, 0.0), (0.0, 0.0), None, None
    for cmd, n in d:
        up, (bx, by) = cmd.upper(), cur if cmd.islower() else (0.0, 0.0)
        at = lambda k: (n[k] + bx, n[k + 1] + by)
        nc2 = nq = None
        if up == "M":
            cur = start = at(0)
        elif up == "Z":
            out.append(("line", [*cur, *start]))
            cur = start
        elif up in "LHV":
            end = at(0) if up == "L" else (n[0] + bx, cur[1]) if up == "H" else (cur[0], n[0] + by)
            out.append(("line", [*cur, *end]))
            cur = end
        elif up in "CS":
            c1, nc2, end = (at(0), at(2), at(4)) if up == "C" else ((2 * cur[0] - c2[0], 2 * cur[1] - c2[1]) if c2 else cur, at(0), at(2))
            out.append(("cubic", [*cur, *c1, *nc2, *end]))
            cur = end
        elif up in "QT":
            nq, end = (at(0), at(2)) if up == "Q" else ((2 * cur[0] - q[0], 2 * cur[1] - q[1]) if q else cur, at(0))
            out.append(("quad", [*cur, *nq, *end]))
            cur = end
        else:
            end = at(5)
            out.append(("svg_arc", [*cur, *n[:5], *end]))
            cur = end
        c2, q = nc2, nq
    return out


def test_curves_and_boxes_like_a_walk(spark):
    rng = random.Random(6)
    size = {"L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
    paths = {}
    for k in range(25):
        d = [("M", [5.0, 6.0])]
        for _ in range(rng.randint(2, 14)):
            cmd = rng.choice("LHVCSSQTTTAZ")
            n = [float(rng.randint(-20, 20)) for _ in range(size[cmd])]
            if cmd == "A":
                n[:5] = [float(rng.randint(3, 30)), float(rng.randint(3, 30)), float(rng.randint(0, 90)), float(rng.randint(0, 1)), float(rng.randint(0, 1))]
            d.append((cmd if rng.random() < 0.5 or cmd == "Z" else cmd.lower(), n))
        paths[k] = d
    text = lambda d: " ".join(c + " ".join(f"{v:g}" for v in n) for c, n in d)
    df = spark.createDataFrame([(1, k, text(d)) for k, d in paths.items()] + [(1, 99, "M0 0 L")], "doc_id long, idx int, d string")
    curves = P.path_curves(df)
    got = {}
    for r in curves.orderBy("idx", "seg").collect():
        got.setdefault(r.idx, []).append((r.kind, r.p))
    for k, d in paths.items():
        want = walk(d)
        assert [g[0] for g in got[k]] == [w[0] for w in want]
        assert all(g[1] == pytest.approx(w[1], abs=1e-9) for g, w in zip(got[k], want)), text(d)
    assert 99 not in got
    fine = sample_path(curves.filter("kind = 'svg_arc'").withColumn("seg", F.col("idx") * 1000 + F.col("seg")), 0.05)
    far = {}
    for r in fine.collect():
        far.setdefault(r.seg, []).append((r.x, r.y))
    one = curves.filter("kind = 'svg_arc'").withColumn("subpath", F.col("idx") * 1000 + F.col("seg"))
    starts = {r.subpath: tuple(r.p[:2]) for r in one.collect()}
    for r in P.curve_boxes(one).collect():
        xs, ys = zip(*far[r.subpath], starts[r.subpath])
        assert (r.x0, r.y0, r.x1, r.y1) == pytest.approx((min(xs), min(ys), max(xs), max(ys)), abs=0.3)
        assert r.x0 <= min(xs) + 1e-3 and r.x1 >= max(xs) - 1e-3 and r.y0 <= min(ys) + 1e-3 and r.y1 >= max(ys) - 1e-3

"""Rings from stroked arcs: robust circle fits, groups of arcs on one circle, angular coverage and dash
pattern, and a raster comparison of the strokes with the ring that may replace them.

Points are ordered samples (doc_id, arc_id, seq, x, y) of open strokes; ``lines`` has their looks (doc_id,
arc_id, paint, width, opacity, linecap, linejoin) and ``views`` the size of each document (doc_id, view_w,
view_h). Shapes are scan converted into spans, so no canvas is ever made.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.operators.curves import circle_spans, disjoint_spans, span_depth, wrap_angle
from swatchwork.operators.graph import connected_components
from swatchwork.operators.raster import EIGHT
from swatchwork.runtime import by_shuffle, united, written

ARC, RING = ["doc_id", "arc_id"], ["doc_id", "ring"]


@dataclass(frozen=True)
class RingParams:
    """Limits of radius (of the shorter side), span in degrees, straightness of the turn, radial
    error, tolerances of two arcs on one circle (units and share), least coverage, overlap, and raster scores."""

    min_radius: float = 0.12
    max_radius: float = 0.55
    min_arc: float = 35.0
    max_arc: float = 300.0
    min_monotonicity: float = 0.94
    radial: tuple[float, float] = (2.6, 0.008)
    centre: tuple[float, float] = (5.0, 0.012)
    radius: tuple[float, float] = (3.0, 0.010)
    width: tuple[float, float] = (1.0, 0.12)
    opacity: float = 0.01
    min_degrees: float = 180.0
    max_overlap: float = 0.12
    bins: int = 1440
    raster_side: int = 1600
    min_recall: float = 0.985
    min_precision: float = 0.985


# ---- circles -----------------------------------------------------------------------------------------------


def _algebraic(rows: DataFrame, key: list[str], when: Column | None = None) -> DataFrame:
    """Least-squares circle of the rows of a key (with x, y and the offset ox, oy near their middle): n, cx,
    cy, radius; a null radius for fewer than five points or points on a line."""
    u, v = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    z = u * u + v * v
    take = (lambda c: F.sum(F.when(when, c))) if when is not None else F.sum
    g = rows.groupBy(*key, "ox", "oy", "total").agg(*(take(c).alias(n) for n, c in {"n": F.lit(1), "su": u, "sv": v, "sz": z, "uu": u * u, "uv": u * v, "vv": v * v, "uz": u * z, "vz": v * z}.items()))
    c = lambda p, a, b: F.col(p) - F.col(a) * F.col(b) / F.col("n")
    g = g.select(*key, "ox", "oy", "total", "n", "su", "sv", "sz", c("uu", "su", "su").alias("uu"), c("uv", "su", "sv").alias("uv"), c("vv", "sv", "sv").alias("vv"), c("uz", "su", "sz").alias("uz"), c("vz", "sv", "sz").alias("vz"))
    det = F.expr("2 * (uu * vv - uv * uv)")
    g = g.withColumn("a", F.expr("uz * vv - vz * uv") / det).withColumn("b", F.expr("vz * uu - uz * uv") / det)
    square = F.expr("(sz - 2 * a * su - 2 * b * sv) / n + a * a + b * b")
    fine = (F.col("n") >= 5) & (det > 1e-12 * F.pow(F.col("uu") + F.col("vv"), 2)) & (square > 0)
    return g.select(*key, "ox", "oy", "total", "n", F.when(fine, F.col("ox") + F.col("a")).alias("cx"), F.when(fine, F.col("oy") + F.col("b")).alias("cy"), F.when(fine, F.sqrt(square)).alias("radius"))


def _signed(x: str = "cx", y: str = "cy", r: str = "radius") -> Column:
    return F.sqrt(F.pow(F.col("x") - F.col(x), 2) + F.pow(F.col("y") - F.col(y), 2)) - F.col(r)


def mad_circles(pts: DataFrame, key: list[str], rounds: int = 4, share: float = 0.65, least: float = 1.5, wide: float = 4.5) -> DataFrame:
    """Circles fitted by trimming: ``key, total, n, cx, cy, radius, rms, p95``.

    Each round measures the signed distances of the points to the circle and their median absolute
    deviation over the points kept so far; points further from the median than ``wide`` deviations of a
    normal spread (``least`` at least) are left out, and the circle is fitted again on the others, which may
    take points in again. A curve stops where fewer than ``share`` of its points (or five) would be left. The
    error is that of the kept points. Curves without a circle are left out; nulls in x or y count as no point.
    """
    points = pts.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"])
    middle = points.groupBy(*key).agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"), F.count(F.lit(1)).alias("total"))
    points = written(points.join(middle, key))
    none = F.lit(None).cast("double")
    now = written(_algebraic(points, key).filter("radius IS NOT NULL").select("*", *(none.alias(c) for c in ("sx", "sy", "sr", "sc", "tol")), F.lit(True).alias("open")))
    kept = F.col("tol").isNull() | (F.abs(_signed("sx", "sy", "sr") - F.col("sc")) <= F.col("tol"))
    for _ in range(rounds):
        live = now.filter("open")
        if live.isEmpty():
            break
        rows = points.join(live.drop("ox", "oy", "total"), key).withColumn("d", _signed()).withColumn("kept", kept)
        centre = rows.filter("kept").groupBy(*key).agg(F.percentile("d", F.lit(0.5)).alias("centre"))
        off = rows.join(centre, key).withColumn("off", F.abs(F.col("d") - F.col("centre")))
        spread = off.filter("kept").groupBy(*key, "centre").agg(F.greatest(F.lit(least), wide * 1.4826 * F.percentile("off", F.lit(0.5))).alias("spread"))
        chosen = off.drop("centre").join(spread, key)
        again = _algebraic(chosen, key, F.col("off") <= F.col("spread")).select(*key, F.col("n").alias("new_n"), *(F.col(c).alias(f"new_{c}") for c in ("cx", "cy", "radius")))
        enough = F.coalesce("new_n", F.lit(0)) >= F.greatest(F.lit(5), F.floor(share * F.col("total")))
        go = F.col("open") & enough
        both = now.join(spread, key, "left").join(again, key, "left").withColumn("go", go)
        was = {"sx": "cx", "sy": "cy", "sr": "radius", "sc": "centre", "tol": "spread", "n": "new_n", "cx": "new_cx", "cy": "new_cy", "radius": "new_radius"}
        now = written(both.select(*key, "ox", "oy", "total", *(F.when(F.col("go"), F.col(new)).otherwise(F.col(c)).alias(c) for c, new in was.items()), F.col("go").alias("open")).filter("radius IS NOT NULL"))
    d = F.when(kept, F.abs(_signed()))
    error = points.join(now.drop("ox", "oy", "total"), key).groupBy(*key).agg(F.sqrt(F.avg(d * d)).alias("rms"), F.percentile(d, F.lit(0.95)).alias("p95"))
    return now.select(*key, "total", "n", "cx", "cy", "radius").join(error, key)


def turns(pts: DataFrame, fit: DataFrame, key: list[str], of: list[str] | None = None) -> DataFrame:
    """Around the fitted centre (joined by ``of``, the key by default): ``key, start, net, turned``, the first
    angle, the signed turn and the sum of all turns, in radians."""
    at = pts.join(fit.select(*(of or key), "cx", "cy"), of or key).withColumn("a", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    step = wrap_angle(F.col("a") - F.lag("a").over(Window.partitionBy(*key).orderBy("seq")), 2 * pi)
    return at.withColumn("d", step).groupBy(*key).agg(F.min_by("a", "seq").alias("start"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("net"), F.coalesce(F.sum(F.abs("d")), F.lit(0.0)).alias("turned"))


def _limit(bounds: tuple[float, float], of: Column) -> Column:
    return F.greatest(F.lit(bounds[0]), bounds[1] * of)


def stroke_arcs(pts: DataFrame, lines: DataFrame, views: DataFrame, p: RingParams = RingParams()) -> DataFrame:
    """The strokes that are arcs of a circle: ``lines`` with cx, cy, radius, rms, p95, span, monotonicity."""
    fit = written(mad_circles(pts, ARC))
    arcs = fit.join(turns(pts, fit, ARC), ARC).join(lines, ARC).join(views, "doc_id")
    side, net = F.least("view_w", "view_h"), F.abs("net")
    arcs = arcs.withColumn("span", F.degrees(net)).withColumn("monotonicity", F.when(F.col("turned") > 1e-12, net / F.col("turned")).otherwise(0.0))
    good = F.col("radius").between(p.min_radius * side, p.max_radius * side) & (F.col("p95") <= _limit(p.radial, F.col("radius"))) & (F.col("monotonicity") >= p.min_monotonicity) & F.col("span").between(p.min_arc, p.max_arc)
    return arcs.filter(good).select(*lines.columns, "total", "cx", "cy", "radius", "rms", "p95", "span", "monotonicity", "view_w", "view_h")


def co_circular(arcs: DataFrame, p: RingParams = RingParams()) -> DataFrame:
    """Pairs of arcs (src, dst: structs of doc_id and arc_id) of equal looks that may lie on one circle.

    Arcs meet by the octave of their radius and by cells of the width of the largest tolerance there, so no
    arc is held against all others of its document.
    """
    keys = ["doc_id", "paint", "linecap", "linejoin"]
    octave = lambda r: F.floor(F.log2(r))
    slack = _limit(p.radius, 1.02 * F.col("radius"))
    cell = lambda c: F.floor(F.col(c) / F.greatest(F.lit(p.centre[0]), p.centre[1] * F.pow(F.lit(2.0), F.col("octave") + 2)))
    near = arcs.withColumn("octave", F.explode(F.array_distinct(F.array(octave(F.greatest(F.col("radius") - slack, F.lit(0.5))), octave(F.col("radius") + slack)))))
    near = near.withColumn("gx", cell("cx")).withColumn("gy", cell("cy"))
    looks = ("arc_id", "opacity", "cx", "cy", "radius", "width")
    around = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in EIGHT))).alias("to")
    other = near.select(*keys, "octave", "gx", "gy", around, *(F.col(c).alias(f"o_{c}") for c in looks))
    other = other.withColumn("gx", F.col("gx") + F.col("to.dx")).withColumn("gy", F.col("gy") + F.col("to.dy"))
    pairs = near.join(other, [*keys, "octave", "gx", "gy"]).filter("arc_id < o_arc_id")
    mean = lambda c: (F.col(c) + F.col(f"o_{c}")) / 2
    apart = F.sqrt(F.pow(F.col("cx") - F.col("o_cx"), 2) + F.pow(F.col("cy") - F.col("o_cy"), 2))
    gap = lambda c: F.abs(F.col(c) - F.col(f"o_{c}"))
    like = (gap("opacity") <= p.opacity + 1e-12) & (apart <= _limit(p.centre, mean("radius"))) & (gap("radius") <= _limit(p.radius, mean("radius"))) & (gap("width") <= _limit(p.width, mean("width")))
    node = lambda c: F.struct(F.col("doc_id"), F.col(c).alias("arc_id"))
    return pairs.filter(like).select(node("arc_id").alias("src"), node("o_arc_id").alias("dst")).distinct()


# ---- coverage and dashes -----------------------------------------------------------------------------------


def covered_spans(spans: DataFrame, key: list[str], part: str, bins: int) -> DataFrame:
    """``key, part, x0, x1`` of arcs, one a part, given by ``start`` and ``net`` in radians: spans of bins of the
    circle in the direction in which a circle is drawn, which is against the angle."""
    at = lambda a: F.floor(-a / (2 * pi) * bins + 1e-9).cast("int")
    return spans.select(*key, part, F.inline(circle_spans(at(F.col("start")), at(F.col("start") + F.col("net")), bins)))


def ring_coverage(marks: DataFrame, key: list[str], bins: int) -> DataFrame:
    """``key, degrees, overlap``: the part of the circle that the arcs (key, x0, x1) cover, and how often they do
    so more than once, by the bins that they cover."""
    g = span_depth(marks, key)
    return g.select(*key, (F.col("covered") * 360.0 / bins).alias("degrees"), ((F.col("total") - F.col("covered")) / F.col("covered")).alias("overlap"))


def bin_runs(marks: DataFrame, key: list[str], bins: int) -> DataFrame:
    """Circular runs of covered bins: ``key, start, size``. A run over the seam is one; a circle without a gap
    is one run from 0. ``marks`` are bins (key, bin) or spans of them (key, x0, x1), which may overlap."""
    own = marks if "x0" in marks.columns else marks.select(*key, F.col("bin").alias("x0"), F.col("bin").alias("x1"))
    by = Window.partitionBy(*key).orderBy("x0", "x1")
    upto = F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    head = own.select(*key, "x0", "x1", F.when(F.col("x0") <= upto + 1, 0).otherwise(1).alias("new"))
    head = head.withColumn("run", F.sum("new").over(by))
    runs = head.groupBy(*key, "run").agg(F.min("x0").alias("start"), (F.max("x1") - F.min("x0") + 1).cast("long").alias("size"))
    whole = Window.partitionBy(*key)
    seam = (F.min("start").over(whole) == 0) & (F.max(F.col("start") + F.col("size")).over(whole) == bins) & (F.count(F.lit(1)).over(whole) > 1)
    first = F.max(F.when(F.col("start") == 0, F.col("size"))).over(whole)
    runs = runs.withColumn("seam", seam).withColumn("first", first)
    return runs.filter(~(F.col("seam") & (F.col("start") == 0))).select(*key, "start", (F.col("size") + F.when(F.col("seam") & (F.col("start") + F.col("size") == bins), F.col("first")).otherwise(0)).alias("size"))


def ring_dashes(marks: DataFrame, radius: DataFrame, key: list[str], bins: int) -> DataFrame:
    """Dash list of a circle that shows the covered bins only: ``key, rotation, dashes``.

    The path starts in the middle of the largest gap (of equal ones the first), so the list opens with an
    empty dash; lengths are in units of the circle (``radius``: key, radius), and the list has an even number
    of them. A circle without a gap has no dashes.
    """
    by = Window.partitionBy(*key).orderBy("start")
    runs = bin_runs(marks, key, bins)
    following = F.coalesce(F.lead("start").over(by), F.min("start").over(Window.partitionBy(*key)) + bins)
    gaps = runs.withColumn("gap_at", F.col("start") + F.col("size")).withColumn("gap", following - F.col("gap_at"))
    gaps = gaps.withColumn("gap_at", F.pmod("gap_at", F.lit(bins)))
    best = F.min(F.struct(-F.col("gap"), "gap_at")).over(Window.partitionBy(*key))
    gaps = gaps.withColumn("middle", F.pmod(best["gap_at"] + F.floor(-best["col1"] / 2), F.lit(bins))).withColumn("half", F.floor(-best["col1"] / 2))
    run = F.struct(F.pmod(F.col("start") - F.col("middle"), F.lit(bins)).alias("at"), "size", "gap")
    g = gaps.groupBy(*key, "middle").agg(F.array_sort(F.collect_list(run)).alias("runs"), F.max("gap").alias("most"), F.max("half").alias("half")).join(radius.select(*key, "radius"), key)
    unit = 2 * pi * F.col("radius") / bins
    inner = F.flatten(F.transform("runs", lambda r: F.array(r["size"], r["gap"])))
    # The last gap is the largest: its first half ends the list.
    counts = F.concat(F.array(F.lit(0), F.element_at("runs", 1)["at"]), F.slice(inner, 1, F.size(inner) - 1), F.array(F.col("half")))
    even = F.when(F.size(counts) % 2 == 1, F.concat(counts, F.array(F.lit(0)))).otherwise(counts)
    full = F.col("most") <= 0
    lengths = F.transform(even, lambda n: n * unit)
    return g.select(*key, F.when(full, 0.0).otherwise(-360.0 * F.col("middle") / bins).alias("rotation"), F.when(full, F.array().cast("array<double>")).otherwise(lengths).alias("dashes"))


# ---- scan conversion ---------------------------------------------------------------------------------------


def scan_fill(edges: DataFrame, key: list[str]) -> DataFrame:
    """Spans (key, y, x0, x1) of closed shapes given by their edges (key, x1, y1, x2, y2), filled even-odd.

    A pixel is inside when its centre is. Every edge is cut by the rows that it passes, and the crossings of
    a row are paired from left to right; several contours of one key, such as the two of a ring, leave holes.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1
    cut = edges.withColumn("_from", first).withColumn("_to", last).filter("_to >= _from").withColumn("y", F.explode(F.sequence("_from", "_to")))
    at = F.col("x1") + (F.col("y") + 0.5 - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    by = Window.partitionBy(*key, "y").orderBy("at")
    cross = cut.select(*key, F.col("y").cast("int").alias("y"), at.alias("at")).withColumn("nth", F.row_number().over(by)).withColumn("end", F.lead("at").over(by))
    spans = cross.filter("nth % 2 = 1 AND end IS NOT NULL")
    return spans.select(*key, "y", F.ceil(F.col("at") - 0.5).cast("int").alias("x0"), (F.ceil(F.col("end") - 0.5) - 1).cast("int").alias("x1")).filter("x0 <= x1")


def polygon_edges(pts: DataFrame, key: list[str], contour: str = "contour") -> DataFrame:
    """Edges of closed contours (key, contour, seq, x, y), the closing one included."""
    by = Window.partitionBy(*key, contour).orderBy("seq")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole))
    return pts.select(*key, F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def disc_spans(discs: DataFrame, key: list[str]) -> DataFrame:
    """Spans of discs (key, x, y, half)."""
    rows = discs.withColumn("row", F.explode(F.sequence(F.ceil(F.col("y") - F.col("half") - 0.5), F.floor(F.col("y") + F.col("half") - 0.5))))
    reach = F.sqrt(F.greatest(F.col("half") * F.col("half") - F.pow(F.col("row") + 0.5 - F.col("y"), 2), F.lit(0.0)))
    return rows.select(*key, F.col("row").cast("int").alias("y"), F.ceil(F.col("x") - reach - 0.5).cast("int").alias("x0"), F.floor(F.col("x") + reach - 0.5).cast("int").alias("x1")).filter("x0 <= x1")


def stroke_spans(pts: DataFrame, key: list[str]) -> DataFrame:
    """Spans of stroked lines (key, line, seq, x, y, half, round): a box a segment, a disc at every joint, and
    one at the ends where they are round. Spans may overlap."""
    by = Window.partitionBy(*key, "line").orderBy("seq")
    rows = written(pts.select(*key, "line", "seq", "x", "y", "half", "round", F.lead("x").over(by).alias("nx"), F.lead("y").over(by).alias("ny"), F.lag("x").over(by).isNull().alias("is_first")))
    size = F.sqrt(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2))
    box = rows.filter("nx IS NOT NULL").withColumn("size", size).filter("size > 0")
    dx, dy = -(F.col("ny") - F.col("y")) / F.col("size") * F.col("half"), (F.col("nx") - F.col("x")) / F.col("size") * F.col("half")
    x, y, nx, ny = map(F.col, ("x", "y", "nx", "ny"))
    corners = [(x + dx, y + dy), (nx + dx, ny + dy), (nx - dx, ny - dy), (x - dx, y - dy)]
    sides = F.explode(F.array(*(F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(corners, corners[1:] + corners[:1])))).alias("e")
    boxes = scan_fill(box.select(*key, "line", "seq", sides).select(*key, "line", "seq", "e.*"), [*key, "line", "seq"]).select(*key, "y", "x0", "x1")
    joints = rows.filter(F.col("round") | (~F.col("is_first") & F.col("nx").isNotNull()))
    return boxes.transform(united, disc_spans(joints, key))


def canvas_spans(spans: DataFrame, key: list[str], height: Column, width: Column) -> DataFrame:
    """Spans on a canvas that share no pixel (key, y, x0, x1)."""
    inside = spans.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x1") >= 0) & (F.col("x0") < width))
    return disjoint_spans(inside.select(*key, "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least(F.col("x1"), (width - 1).cast("int")).alias("x1")), [*key, "y"])


def span_pixels(spans: DataFrame, key: list[str], height: Column, width: Column) -> DataFrame:
    """Distinct pixels (key, y, x) of spans on a canvas. The spans are parted before they are spread, so no
    table of pixels is held to find equal ones."""
    return canvas_spans(spans, key, height, width).select(*key, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def raster_agreement(source: DataFrame, proposal: DataFrame, key: list[str]) -> DataFrame:
    """``key, recall, precision, f1`` of two pixel sets, given by spans that share no pixel (key, y, x0, x1):
    shares of the pixels of each that have one of the other within one pixel. Spans meet grown spans of
    their row; no pixel is spread."""

    def side(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        rows = other.select(*key, F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y"), (F.col("x0") - 1).alias("x0"), (F.col("x1") + 1).alias("x1"))
        near = disjoint_spans(rows, [*key, "y"]).select(*key, "y", F.col("x0").alias("n0"), F.col("x1").alias("n1"))
        met = own.join(by_shuffle(near), [*key, "y"]).filter("x0 <= n1 AND n0 <= x1").groupBy(*key).agg(F.sum(F.least("x1", "n1") - F.greatest("x0", "n0") + 1).alias("hit"))
        size = own.groupBy(*key).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
        return size.join(by_shuffle(met), key, "left").select(*key, (F.coalesce("hit", F.lit(0)) / F.col("n")).alias(name))

    g = side(source, proposal, "recall").join(by_shuffle(side(proposal, source, "precision")), key, "full").fillna(0.0, ["recall", "precision"])
    total = F.col("recall") + F.col("precision")
    return g.withColumn("f1", F.when(total > 0, 2 * F.col("recall") * F.col("precision") / total).otherwise(0.0))


# ---- rings -------------------------------------------------------------------------------------------------


def _drawn(members: DataFrame, pts: DataFrame, marks: DataFrame, rings: DataFrame, p: RingParams) -> DataFrame:
    """Raster agreement of the arcs of a ring with the covered runs of its circle."""
    scale = F.least(F.lit(1.0), p.raster_side / F.greatest("view_w", "view_h"))
    canvas = rings.select(*RING, "cx", "cy", "radius", scale.alias("scale"), F.greatest(F.lit(0.5), F.bround(F.col("width") * scale) / 2).alias("half"), (F.col("linecap") == "round").alias("round"), F.ceil(F.col("view_h") * scale).cast("int").alias("tall"), F.ceil(F.col("view_w") * scale).cast("int").alias("wide"))
    looks = canvas.select(*RING, "scale", "half", "round")
    scaled = [(F.col(c) * F.col("scale")).alias(c) for c in "xy"]
    source = pts.join(members.select(*RING, "arc_id"), ARC).join(looks, RING).select(*RING, F.col("arc_id").cast("long").alias("line"), F.col("seq").cast("long").alias("seq"), *scaled, "half", "round")
    runs = bin_runs(marks, RING, p.bins).join(canvas, RING)
    a0, turn = -2 * pi * F.col("start") / p.bins, -2 * pi * F.col("size") / p.bins
    n = F.greatest(F.lit(3), F.ceil(F.col("radius") * F.abs(turn) * F.col("scale") / 2)).cast("int")
    place = runs.withColumn("n", n).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("a", a0 + turn * F.col("seq") / (F.col("n") - 1))
    place = place.withColumn("x", F.col("cx") + F.col("radius") * F.cos("a")).withColumn("y", F.col("cy") + F.col("radius") * F.sin("a"))
    proposal = place.select(*RING, F.col("start").cast("long").alias("line"), F.col("seq").cast("long").alias("seq"), *scaled, "half", "round")
    size = canvas.select(*RING, "tall", "wide")
    painted = lambda lines: written(canvas_spans(stroke_spans(lines, RING).join(size, RING), RING, F.col("tall"), F.col("wide")))
    return raster_agreement(painted(source), painted(proposal), RING)


def ring_candidates(pts: DataFrame, lines: DataFrame, views: DataFrame, p: RingParams = RingParams()) -> DataFrame:
    """Rings that groups of arcs of a document may become: ``doc_id, ring, arc_ids, paint, width, opacity,
    linecap, linejoin, cx, cy, radius, degrees, overlap, rms, p95, centre_spread, radius_spread, rotation, dashes,
    recall, precision, f1, safe, reasons``; ``ring`` is the smallest arc_id.

    Arcs of one circle are linked in pairs and joined into groups of two and more. A group is a ring when all
    its points fit one circle, each of its arcs does so on its own, and the arcs cover enough of it without
    lying on each other. It is safe to replace when the strokes and the ring agree within a pixel both
    ways; otherwise ``reasons`` says what is too low.
    """
    arcs = written(stroke_arcs(pts, lines, views, p))
    parts = written(connected_components(co_circular(arcs, p)))
    members = written(arcs.join(parts.select("node.doc_id", "node.arc_id", F.col("component.arc_id").alias("ring")), ARC))
    own = written(pts.join(members.select(*RING, "arc_id"), ARC).select(*RING, "arc_id", "seq", "x", "y"))
    fit = mad_circles(own, RING).withColumn("limit", _limit(p.radial, F.col("radius"))).filter("p95 <= limit")
    fit = written(fit.select(*RING, "cx", "cy", "radius", "rms", "p95", "limit"))
    # Two arcs may be like a third and yet not on one circle.
    local = own.join(fit, RING).groupBy(*RING, "arc_id", "limit").agg(F.percentile(F.abs(_signed()), F.lit(0.95)).alias("local"))
    off = local.filter(F.col("local") > F.col("limit")).select(*RING).distinct()
    fit = fit.join(off, RING, "left_anti")
    marks = written(covered_spans(turns(own, fit, [*RING, "arc_id"], RING), RING, "arc_id", p.bins))
    fit = fit.join(ring_coverage(marks, RING, p.bins), RING).filter((F.col("degrees") >= p.min_degrees) & (F.col("overlap") <= p.max_overlap))
    apart = F.sqrt(F.pow(F.col("a.cx") - F.col("f.cx"), 2) + F.pow(F.col("a.cy") - F.col("f.cy"), 2))
    first = lambda c: F.min_by(f"a.{c}", "a.arc_id").alias(c)
    rings = written(
        members.alias("a").join(fit.alias("f"), RING)
        .groupBy(*RING, *(F.col(f"f.{c}").alias(c) for c in ("cx", "cy", "radius", "rms", "p95")), "degrees", "overlap")
        .agg(
            F.array_sort(F.collect_list("a.arc_id")).alias("arc_ids"), *(first(c) for c in ("paint", "opacity", "linecap", "linejoin", "view_w", "view_h")),
            (F.sum(F.col("a.width") * F.col("a.total")) / F.sum("a.total")).alias("width"), F.max(apart).alias("centre_spread"), F.max(F.abs(F.col("a.radius") - F.col("f.radius"))).alias("radius_spread"),
        )
    )
    marks = marks.join(rings.select(*RING), RING, "left_semi")
    scored = rings.join(_drawn(members, pts, marks, rings, p), RING, "left").fillna(0.0, ["recall", "precision", "f1"]).join(ring_dashes(marks, rings, RING, p.bins), RING)
    low = lambda c, least: F.when(F.col(c) < least, F.concat(F.lit(f"raster {c} "), F.format_string("%.4f", F.col(c)), F.lit(f" below {least:.4f}")))
    reasons = F.filter(F.array(low("recall", p.min_recall), low("precision", p.min_precision)), lambda r: r.isNotNull())
    return scored.select(
        *RING, "arc_ids", "paint", "width", "opacity", "linecap", "linejoin", "cx", "cy", "radius", "degrees", "overlap", "rms", "p95", "centre_spread", "radius_spread",
        "rotation", "dashes", "recall", "precision", "f1", (F.size(reasons) == 0).alias("safe"), reasons.alias("reasons"),
    )

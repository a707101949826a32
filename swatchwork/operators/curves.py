"""Ordered points: lengths, angles, clusters, corners, fits and simplification, a curve a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.runtime import united, written


def _by(key: str = "curve_id", order: str = "seq"):
    return Window.partitionBy(key).orderBy(order)


def wrap_angle(d: Column, turn: float = 360.0) -> Column:
    """Signed difference in (-half, half] turns."""
    m = F.pmod(d, F.lit(turn))
    return F.when(m > turn / 2, m - turn).otherwise(m)


def polyline_length(pts: DataFrame) -> DataFrame:
    """Length, chord and straightness (chord by length) of every polyline."""
    w = _by()
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    g = pts.withColumn("step", step).groupBy("curve_id").agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    chord = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    return g.select("curve_id", "points", F.round("length", 4).alias("length"), F.round(chord, 4).alias("chord"), F.round(F.when(F.col("length") > 0, chord / F.col("length")), 6).alias("straightness"))


def corners(pts: DataFrame, degrees: float = 40.0) -> DataFrame:
    """Inner points at which the direction turns by more than ``degrees``."""
    w = _by()
    near = pts.select("curve_id", "seq", "x", "y", F.lag("x").over(w).alias("ax"), F.lag("y").over(w).alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"))
    u, v = (F.col("x") - F.col("ax"), F.col("y") - F.col("ay")), (F.col("bx") - F.col("x"), F.col("by") - F.col("y"))
    turn = F.degrees(F.abs(F.atan2(u[0] * v[1] - u[1] * v[0], u[0] * v[0] + u[1] * v[1])))
    return near.withColumn("turn", F.round(turn, 4)).filter(F.col("turn") > degrees).select("curve_id", "seq", "turn")


def polygon_area(pts: DataFrame) -> DataFrame:
    """Signed area by the shoelace sum; the last point joins the first."""
    w = _by()
    whole = Window.partitionBy("curve_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), F.coalesce(F.lead("y").over(w), F.first("y").over(whole))
    return pts.withColumn("cross", F.col("x") * ny - nx * F.col("y")).groupBy("curve_id").agg(F.round(F.sum("cross") / 2, 3).alias("area"))


def drop_collinear(pts: DataFrame) -> DataFrame:
    """Points that are no exact forward continuation of the last step, in a closed curve."""
    w = _by()
    whole = Window.partitionBy("curve_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda c, f, g: F.coalesce(f(c).over(w), g(c).over(whole))
    near = pts.select("curve_id", "seq", "x", "y", at("x", F.lag, F.last).alias("ax"), at("y", F.lag, F.last).alias("ay"), at("x", F.lead, F.first).alias("bx"), at("y", F.lead, F.first).alias("by"))
    ux, uy, vx, vy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay"), F.col("bx") - F.col("x"), F.col("by") - F.col("y")
    return near.filter(~((ux * vy - uy * vx == 0) & (ux * vx + uy * vy >= 0))).select("curve_id", "seq", "x", "y")


def polar(pts: DataFrame, cx: float, cy: float) -> DataFrame:
    """Points by angle (degrees, 0 to 360) and radius around a centre."""
    dx, dy = F.col("x") - cx, F.col("y") - cy
    return pts.select("curve_id", "seq", F.round(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)), 4).alias("angle"), F.round(F.sqrt(dx * dx + dy * dy), 4).alias("radius"))


def coverage_gap(polar_pts: DataFrame, limit: float = 75.0) -> DataFrame:
    """Largest angular gap, the one over 360 included."""
    w = Window.partitionBy("curve_id").orderBy("angle")
    gap = F.col("angle") - F.lag("angle").over(w)
    g = polar_pts.select("curve_id", "angle").distinct().withColumn("gap", gap).groupBy("curve_id").agg(F.max("gap").alias("inner"), (F.min("angle") + 360 - F.max("angle")).alias("outer"))
    largest = F.greatest(F.coalesce("inner", F.lit(0.0)), "outer")
    return g.select("curve_id", F.round(largest, 4).alias("gap"), (largest <= limit).alias("covered"))


def distance_clusters(polar_pts: DataFrame, least: int = 8, least_radius: float = 20.0) -> DataFrame:
    """1-D clusters of radii, split at gaps over max(2.5, 0.8 % of the radius)."""
    w = Window.partitionBy("curve_id").orderBy("radius", "seq")
    new = F.when(F.col("radius") - F.lag("radius").over(w) > F.greatest(F.lit(2.5), 0.008 * F.col("radius")), 1).otherwise(0)
    parts = polar_pts.withColumn("new", new).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("curve_id", "cluster").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg("radius"), 4).alias("radius")).filter((F.col("points") >= least) & (F.col("radius") >= least_radius))


def angle_clusters(polar_pts: DataFrame, gap: float = 6.0) -> DataFrame:
    """1-D clusters on the circle: split at gaps over ``gap``; the last joins the first across 360."""
    w = Window.partitionBy("curve_id").orderBy("angle", "seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("curve_id")
    parts = polar_pts.withColumn("new", F.when(F.col("angle") - F.lag("angle").over(w) > gap, 1).otherwise(0)).withColumn("cluster", F.sum("new").over(run))
    joins = F.min("angle").over(whole) + 360 - F.max("angle").over(whole) <= gap
    return parts.withColumn("cluster", F.when(joins & (F.col("cluster") == F.max("cluster").over(whole)), 0).otherwise(F.col("cluster"))).groupBy("curve_id", "cluster").agg(F.count(F.lit(1)).alias("points"))


def arc_monotonicity(polar_pts: DataFrame) -> DataFrame:
    """Net and total turn of the angle along the points, and their ratio."""
    d = wrap_angle(F.col("angle") - F.lag("angle").over(_by()))
    g = polar_pts.withColumn("d", d).groupBy("curve_id").agg(F.round(F.sum("d"), 3).alias("net"), F.round(F.sum(F.abs("d")), 3).alias("total"))
    return g.withColumn("ratio", F.round(F.when(F.col("total") > 0, F.abs("net") / F.col("total")), 6))


def circle_fit(pts: DataFrame) -> DataFrame:
    """Algebraic circle fit by moment sums and a closed solution; null on a line."""
    mean = pts.groupBy("curve_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("n"))
    c = pts.join(mean, "curve_id").withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))
    s = lambda e: F.sum(F.expr(e))
    m = c.groupBy("curve_id", "mx", "my", "n").agg(s("u*u").alias("uu"), s("u*v").alias("uv"), s("v*v").alias("vv"), s("u*(u*u+v*v)").alias("uz"), s("v*(u*u+v*v)").alias("vz"))
    det = F.expr("2 * (uu * vv - uv * uv)")
    a, b = F.expr("uz * vv - vz * uv") / det, F.expr("vz * uu - uz * uv") / det
    ok = F.abs(det) > 1e-9
    return m.select("curve_id", "n", F.when(ok, F.round(F.col("mx") + a, 4)).alias("cx"), F.when(ok, F.round(F.col("my") + b, 4)).alias("cy"), F.when(ok, F.round(F.sqrt(a * a + b * b + F.expr("(uu + vv) / n")), 4)).alias("radius"))


def circle_residual(pts: DataFrame, fit: DataFrame) -> DataFrame:
    """Root mean square and 95th percentile of the distance to the fitted circle."""
    d = F.abs(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) - F.col("radius"))
    return pts.join(fit, "curve_id").withColumn("d", d).groupBy("curve_id").agg(F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 4).alias("rms"), F.round(F.percentile("d", F.lit(0.95)), 4).alias("p95"))


def robust_circle_fit(pts: DataFrame, rounds: int = 3, share: float = 0.025) -> DataFrame:
    """Fit again on the points within ``share`` of the radius, round by round; a curve with fewer
    than three of them keeps its fit."""
    fit = circle_fit(pts)
    for _ in range(rounds - 1):
        d = F.abs(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) - F.col("radius"))
        near = pts.join(fit.drop("n"), "curve_id").filter(d <= share * F.col("radius")).select("curve_id", "seq", "x", "y")
        again = circle_fit(near).filter("n >= 3 AND radius IS NOT NULL")
        both = fit.select("curve_id", *(F.col(c).alias(f"o_{c}") for c in ("n", "cx", "cy", "radius"))).join(again, "curve_id", "left")
        fit = written(both.select("curve_id", *(F.coalesce(c, f"o_{c}").alias(c) for c in ("n", "cx", "cy", "radius"))))
    return fit


def mode_smooth(pts: DataFrame, label: str, half: int = 2) -> DataFrame:
    """Most frequent label within ``half`` points to each side; the smallest of equals."""
    near = F.collect_list(label).over(_by().rowsBetween(-half, half))
    count = F.transform(F.array_sort(F.array_distinct("near")), lambda v: F.struct((-F.size(F.filter("near", lambda o: o == v))).alias("n"), v.alias("v")))
    return pts.withColumn("near", near).select("curve_id", "seq", F.array_min(count)["v"].alias("mode"))


def chained_distance_filter(pts: DataFrame, least: float) -> DataFrame:
    """Points at least ``least`` away from the last point kept: a fold over each curve's points."""
    p = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    far = lambda acc, q: F.size(acc) == 0

    def keep(acc: Column, q: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        d2 = F.pow(q["x"] - last["x"], 2) + F.pow(q["y"] - last["y"], 2)
        return F.when(far(acc, q) | (d2 >= least * least), F.concat(acc, F.array(q))).otherwise(acc)

    none = F.array().cast("array<struct<seq:int,x:double,y:double>>")
    return pts.groupBy("curve_id").agg(p.alias("p")).select("curve_id", F.explode(F.aggregate("p", none, keep)).alias("q")).select("curve_id", "q.seq", "q.x", "q.y")


def simplify(pts: DataFrame, eps: float) -> DataFrame:
    """Douglas-Peucker for all curves at once: each round splits every open segment at its farthest
    point beyond ``eps``, until none has one. Ties go to the earliest point. A point carries the ends
    of its segment, so each round moves a point once, and points of settled segments drop out."""
    p = F.struct("seq", "x", "y")
    ends = pts.groupBy("curve_id").agg(F.min(p).alias("a"), F.max(p).alias("b"))
    kept = ends.select("curve_id", F.explode(F.array_distinct(F.array("a.seq", "b.seq"))).alias("seq"))
    live = written(pts.join(ends, "curve_id").filter("seq > a.seq AND seq < b.seq").select("curve_id", "seq", "x", "y", "a", "b"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    ax, ay = F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
    size = F.sqrt(dx * dx + dy * dy)
    away = F.round(F.when(size > 0, F.abs(dx * ay - dy * ax) / size).otherwise(F.sqrt(ax * ax + ay * ay)), 9)
    while True:  # each round keeps at least one more point of a curve
        beyond = live.withColumn("d", away).filter(F.col("d") > eps).groupBy("curve_id", F.col("a.seq").alias("start"))
        far = written(beyond.agg(F.max(F.struct("d", (-F.col("seq")).alias("n"), "x", "y")).alias("m")).select("curve_id", "start", F.struct((-F.col("m.n")).alias("seq"), "m.x", "m.y").alias("c")))
        if far.isEmpty():
            break
        kept = written(kept.transform(united, far.select("curve_id", "c.seq")))
        left = F.col("seq") < F.col("c.seq")
        split = live.withColumn("start", F.col("a.seq")).join(far, ["curve_id", "start"]).filter("seq <> c.seq")
        live = written(split.select("curve_id", "seq", "x", "y", F.when(left, F.col("a")).otherwise(F.col("c")).alias("a"), F.when(left, F.col("c")).otherwise(F.col("b")).alias("b")))
    return pts.join(kept, ["curve_id", "seq"]).select("curve_id", "seq", "x", "y")


def compatible_arcs(arcs: DataFrame, centre: float = 2.0, radius: float = 2.0, width: float = 1.0) -> DataFrame:
    """Pairs of arcs of equal paint and ends with near opacity, centre, radius and width."""
    keys = ["doc_id", "paint", "linecap", "linejoin"]
    o = arcs.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("arc_id", "opacity", "cx", "cy", "radius", "width")))
    near = lambda c, d: F.abs(F.col(c) - F.col(f"o_{c}")) <= d
    apart = F.sqrt(F.pow(F.col("cx") - F.col("o_cx"), 2) + F.pow(F.col("cy") - F.col("o_cy"), 2))
    return arcs.join(o, keys).filter("arc_id < o_arc_id").filter(near("opacity", 0.02) & near("radius", radius) & near("width", width) & (apart <= centre)).select("doc_id", F.col("arc_id").alias("src"), F.col("o_arc_id").alias("dst"))


def circle_spans(first: Column, last: Column, bins: int) -> Column:
    """Array of the spans (x0, x1) of bins from ``first`` to ``last``, either way, on a circle of ``bins``: one,
    or two where it passes the seam."""
    low, n = F.least(first, last), F.abs(last - first) + 1
    at = F.pmod(low, F.lit(bins))
    span = lambda a, b: F.struct(a.cast("int").alias("x0"), b.cast("int").alias("x1"))
    end = F.lit(bins - 1)
    over = F.array(span(at, end), span(F.lit(0), at + n - 1 - bins))
    return F.when(n >= bins, F.array(span(F.lit(0), end))).when(at + n <= bins, F.array(span(at, at + n - 1))).otherwise(over)


def disjoint_spans(spans: DataFrame, key: list[str]) -> DataFrame:
    """The numbers that spans (key, x0, x1) cover, as spans that share none: each keeps what lies beyond
    those that begin before it."""
    by = Window.partitionBy(*key).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.select(*key, "x0", "x1", F.max("x1").over(by).alias("upto"))
    return rows.select(*key, F.greatest("x0", F.col("upto") + 1).alias("x0"), "x1").filter("x0 <= x1")


def span_depth(spans: DataFrame, key: list[str]) -> DataFrame:
    """``key, covered, total``: how many numbers the spans cover, and how many together, by a running sum
    over their ends; a span costs two rows whatever its length."""
    ends = spans.select(*key, F.explode(F.array(F.struct(F.col("x0").alias("at"), F.lit(1).alias("step")), F.struct((F.col("x1") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    by = Window.partitionBy(*key).orderBy("at")
    rows = ends.select(*key, "e.at", "e.step").withColumn("gap", F.lead("at").over(by) - F.col("at")).withColumn("depth", F.sum("step").over(by))
    return rows.groupBy(*key).agg(F.sum(F.when(F.col("depth") > 0, F.col("gap")).otherwise(0)).alias("covered"), F.sum(F.col("depth") * F.coalesce("gap", F.lit(0))).alias("total"))


def arc_coverage(arcs: DataFrame, bins: int = 360) -> DataFrame:
    """Share of the circle that the arcs of a group (doc_id, ring) cover, and how often they overlap."""
    step = 360.0 / bins
    spans = F.inline(circle_spans(F.floor(F.col("a0") / step).cast("int"), (F.ceil(F.col("a1") / step) - 1).cast("int"), bins))
    own = disjoint_spans(arcs.select("doc_id", "ring", "arc_id", spans), ["doc_id", "ring", "arc_id"])
    g = span_depth(own, ["doc_id", "ring"])
    return g.select("doc_id", "ring", F.round(F.col("covered") * step, 3).alias("degrees"), F.round((F.col("total") - F.col("covered")) / F.col("total"), 6).alias("overlap"))


def dash_pattern(bins: DataFrame) -> DataFrame:
    """Run lengths of occupied bins and of gaps (curve_id, bin, on) in order of the bins."""
    w = Window.partitionBy("curve_id").orderBy("bin")
    new = F.when(F.col("on") == F.lag("on").over(w), 0).otherwise(1)
    runs = bins.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("curve_id", "run", "on").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("curve_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("run", "on", "n"))), lambda r: F.concat(F.when(r["on"], "+").otherwise("-"), r["n"].cast("string")))).alias("pattern"))


def near_circle(pts: DataFrame, fit: DataFrame) -> DataFrame:
    """``curve_id, cx, cy, radius`` of the fits (curve_id, cx, cy, radius) that may stand for the whole
    curve: radius 3 at least, the centre within the bounds (a fifth of their size beyond them too),
    all points near the circle, and no wide gap around it."""
    d = F.abs(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) - F.col("radius"))
    centred = pts.join(fit.select("curve_id", "cx", "cy", "radius").filter("radius >= 3"), "curve_id").withColumn("d", d)
    angle = F.pmod(F.degrees(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))), F.lit(360.0))
    covered = coverage_gap(centred.select("curve_id", angle.alias("angle"))).filter("covered").select("curve_id")
    g = centred.groupBy("curve_id", "cx", "cy", "radius").agg(F.max("d").alias("d"), *(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    within = lambda c: F.col(f"c{c}").between(F.col(f"lo_{c}") - 0.2 * (F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.col(f"hi_{c}") + 0.2 * (F.col(f"hi_{c}") - F.col(f"lo_{c}")))
    near = F.least(1.6 * F.greatest(0.02 * F.col("radius"), F.lit(0.9)), F.greatest(0.03 * F.col("radius"), F.lit(1.5)))
    return g.filter(within("x") & within("y") & (F.col("d") <= near)).join(covered, "curve_id", "left_semi").select("curve_id", "cx", "cy", "radius")


def color_runs(pts: DataFrame, width: float = 1.0, apart: float = 80.0, most: int = 8) -> DataFrame:
    """Runs of one label along a curve (curve_id, seq, label, r, g, b: the label's colour).

    Of each curve: all runs, long ones (6 points and two widths), their labels, whether two of these
    are more than ``apart`` from each other, and whether the curve is cut there: then at most ``most``
    runs are allowed.
    """
    turn = F.when(F.lag("label").over(_by()) == F.col("label"), 0).otherwise(1)
    run = F.sum("turn").over(_by().rowsBetween(Window.unboundedPreceding, 0))
    runs = pts.withColumn("turn", turn).withColumn("run", run).groupBy("curve_id", "run").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("label", "r", "g", "b")))
    long = F.when(F.col("n") >= max(6, int(2 * width)), F.struct("label", "r", "g", "b"))
    per = runs.groupBy("curve_id").agg(F.count(F.lit(1)).alias("runs"), F.count(long).alias("long_runs"), F.collect_set(long).alias("seen"))
    gap = lambda p, q: sum((F.pow(p[c] - q[c], 2) for c in "rgb"), F.lit(0.0))
    far = F.exists("seen", lambda p: F.exists("seen", lambda q: gap(p, q) > apart * apart))
    return per.select("curve_id", "runs", "long_runs", F.size("seen").alias("labels"), far.alias("is_far"), (far & (F.col("runs") <= most)).alias("is_cut"))

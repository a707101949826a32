"""Path texts as curves: control points, arcs given by their end points, boxes."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.operators.documents import path_steps


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def endpoint_arc(p: Column) -> Column:
    """An elliptic arc by its end points (x1, y1, rx, ry, rotation in degrees, large, sweep, x2, y2) as ``cx, cy,
    rx, ry, turn, start, sweep, straight``, angles in radians.

    Radii that cannot reach both ends grow until they do. Without a radius, or between equal ends, the arc
    is ``straight``: a line to its end.
    """
    half_x, half_y, middle_x, middle_y = (p[0] - p[7]) / 2, (p[1] - p[8]) / 2, (p[0] + p[7]) / 2, (p[1] + p[8]) / 2
    turn = F.radians(F.pmod(p[4], F.lit(360.0)))
    # Half the chord in the axes of the ellipse.
    given = F.struct(
        (F.cos(turn) * half_x + F.sin(turn) * half_y).alias("u"), (F.cos(turn) * half_y - F.sin(turn) * half_x).alias("v"), F.abs(p[2]).alias("rx"), F.abs(p[3]).alias("ry"),
        turn.alias("turn"), middle_x.alias("mx"), middle_y.alias("my"), ((F.abs(p[2]) <= 1e-9) | (F.abs(p[3]) <= 1e-9) | (F.sqrt(half_x * half_x + half_y * half_y) <= 5e-10)).alias("straight"),
    )

    def grown(g: Column) -> Column:
        """The chord on the unit circle, and by how much the radii grow for it."""
        u, v = F.try_divide(g["u"], g["rx"]), F.try_divide(g["v"], g["ry"])
        return _let(F.struct(u.alias("u"), v.alias("v"), F.sqrt(F.greatest(F.lit(1.0), u * u + v * v)).alias("by")), lambda c: placed(g, c))

    def placed(g: Column, c: Column) -> Column:
        """On the unit circle the centre lies across the middle of the chord, on the side that the flags name."""
        u, v = c["u"] / c["by"], c["v"] / c["by"]
        side = F.when((p[5] != 0) == (p[6] != 0), -1.0).otherwise(1.0)
        away = side * F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.lit(1.0), u * u + v * v) - 1))
        centre = F.struct(u.alias("u"), v.alias("v"), (away * v).alias("cu"), (-away * u).alias("cv"), (g["rx"] * c["by"]).alias("a"), (g["ry"] * c["by"]).alias("b"))
        return _let(centre, lambda m: _let(F.struct(F.atan2(m["v"] - m["cv"], m["u"] - m["cu"]).alias("start"), F.pmod(F.atan2(-m["v"] - m["cv"], -m["u"] - m["cu"]) - F.atan2(m["v"] - m["cv"], m["u"] - m["cu"]), F.lit(2 * pi)).alias("swept")), lambda t: whole(g, m, t)))

    def whole(g: Column, m: Column, t: Column) -> Column:
        # Ends that rounding brings together are a whole turn apart.
        swept = F.when(t["swept"] == 0, 2 * pi).otherwise(t["swept"])
        back = F.when(t["swept"] == 0, 0.0).otherwise(t["swept"]) - 2 * pi
        x, y, cos, sin = m["cu"] * m["a"], m["cv"] * m["b"], F.cos(g["turn"]), F.sin(g["turn"])
        return F.struct(
            (cos * x - sin * y + g["mx"]).alias("cx"), (sin * x + cos * y + g["my"]).alias("cy"), m["a"].alias("rx"), m["b"].alias("ry"), g["turn"].alias("turn"), t["start"].alias("start"),
            F.when(p[6] != 0, swept).otherwise(back).alias("sweep"), g["straight"].alias("straight"),
        )

    return _let(given, grown)


def on_arc(arc: Column, angle: Column) -> tuple[Column, Column]:
    """Point of an arc of ``endpoint_arc`` at an angle."""
    a, b = arc["rx"] * F.cos(angle), arc["ry"] * F.sin(angle)
    cos, sin = F.cos(arc["turn"]), F.sin(arc["turn"])
    return arc["cx"] + cos * a - sin * b, arc["cy"] + sin * a + cos * b


def path_curves(paths: DataFrame) -> DataFrame:
    """Segments of path texts (doc_id, idx, d) with absolute points: ``doc_id, idx, subpath, seg, kind, p,
    closes``. ``kind`` is line, quad, cubic or svg_arc, ``p`` as ``sample_path`` takes it; ``closes`` marks the
    line back to the start of a closed sub-path.

    Short forms get the control point mirrored from the segment before: for chains of short quads, whose
    points alternate, by a running sum of alternating signs. Paths that break the grammar have no segments.
    """
    steps = path_steps(paths).filter("is_valid")
    by = Window.partitionBy("doc_id", "idx").orderBy("seq")
    n = [F.get("n", F.lit(k)) for k in range(7)]
    at = steps.withColumn("cmd", F.upper("cmd")).withColumn("sx", F.coalesce(F.lag("x").over(by), F.lit(0.0))).withColumn("sy", F.coalesce(F.lag("y").over(by), F.lit(0.0))).withColumn("was", F.lag("cmd").over(by))
    base = {"x": F.when(F.col("rel"), F.col("sx")).otherwise(0.0), "y": F.when(F.col("rel"), F.col("sy")).otherwise(0.0)}
    cmd, mirrored, own = F.col("cmd"), {}, {}
    for c, o in (("x", 0), ("y", 1)):
        # The last control point of each cubic is written; that of a long quad too.
        own[c] = F.when(cmd == "C", n[2 + o] + base[c]).when(cmd.isin("S", "Q"), n[o] + base[c])
    at = at.withColumns({f"o{c}": e for c, e in own.items()})
    run = F.sum(F.when(cmd == "T", 0).otherwise(1)).over(by)
    at = at.withColumn("run", run)
    chain = Window.partitionBy("doc_id", "idx", "run").orderBy("seq")
    at = at.withColumn("nth", F.row_number().over(chain) - 1)
    sign = F.when(F.col("nth") % 2 == 0, 1.0).otherwise(-1.0)
    for c in "xy":
        cur = F.col(f"s{c}")
        mirrored[c] = F.when(F.col("was").isin("C", "S"), 2 * cur - F.lag(f"o{c}").over(by)).otherwise(cur)
        before = F.first(F.when(F.col("cmd") == "Q", F.col(f"o{c}"))).over(chain)
        first = F.first(F.when(F.col("nth") == 1, cur), ignorenulls=True).over(chain)
        alternating = F.sum(F.when(F.col("nth") > 0, 2 * sign * cur).otherwise(0.0)).over(chain)
        at = at.withColumn(f"t{c}", sign * (F.coalesce(before, first) + alternating))
    pick = lambda c, o: F.when(cmd == "C", n[o] + base[c]).when(cmd == "S", mirrored[c])
    at = at.withColumn("c1x", pick("x", 0)).withColumn("c1y", pick("y", 1))
    kind = F.when(cmd.isin("C", "S"), "cubic").when(cmd.isin("Q", "T"), "quad").when(cmd == "A", "svg_arc").when(cmd != "M", "line")
    q = lambda c: F.when(cmd == "Q", F.col(f"o{c}")).otherwise(F.col(f"t{c}"))
    s, e = [F.col("sx"), F.col("sy")], [F.col("x"), F.col("y")]
    points = (
        F.when(kind == "cubic", F.array(*s, F.col("c1x"), F.col("c1y"), F.col("ox"), F.col("oy"), *e)).when(kind == "quad", F.array(*s, q("x"), q("y"), *e))
        .when(kind == "svg_arc", F.array(*s, *n[:5], *e)).otherwise(F.array(*s, *e))
    )
    return at.withColumn("kind", kind).filter("kind IS NOT NULL").select("doc_id", "idx", "subpath", F.col("seq").alias("seg"), "kind", points.alias("p"), (cmd == "Z").alias("closes"))


def curve_boxes(curves: DataFrame) -> DataFrame:
    """``doc_id, idx, subpath, x0, y0, x1, y1`` of the curves of ``path_curves``: end points, control points, and
    the true extent of arcs."""
    arc = F.when(F.col("kind") == "svg_arc", endpoint_arc(F.col("p")))
    rows = curves.withColumn("arc", arc)
    a = F.col("arc")
    # Where an ellipse is extreme in x, and in y; each holds for the opposite angle too.
    peaks = F.array(F.atan2(-a["ry"] * F.sin(a["turn"]), a["rx"] * F.cos(a["turn"])), F.atan2(a["ry"] * F.cos(a["turn"]), a["rx"] * F.sin(a["turn"])))
    angles = F.concat(peaks, F.transform(peaks, lambda t: t + pi))
    swept = lambda t: F.when(a["sweep"] > 0, F.pmod(t - a["start"], F.lit(2 * pi)) <= a["sweep"]).otherwise(F.pmod(a["start"] - t, F.lit(2 * pi)) <= -a["sweep"])
    point = lambda t: F.struct(on_arc(a, t)[0].alias("x"), on_arc(a, t)[1].alias("y"))
    bulge = F.transform(F.filter(angles, swept), point)
    p = F.col("p")
    pairs = F.transform(F.sequence(F.lit(0), F.size(p) - 2, F.lit(2)), lambda i: F.struct(F.get(p, i).alias("x"), F.get(p, i + 1).alias("y")))
    ends = F.array(F.struct(p[0].alias("x"), p[1].alias("y")), F.struct(F.get(p, F.lit(7)).alias("x"), F.get(p, F.lit(8)).alias("y")))
    points = F.when(F.col("kind") != "svg_arc", pairs).when(a["straight"], ends).otherwise(F.concat(ends, bulge))
    flat = rows.select("doc_id", "idx", "subpath", F.explode(points).alias("q"))
    return flat.groupBy("doc_id", "idx", "subpath").agg(F.min("q.x").alias("x0"), F.min("q.y").alias("y0"), F.max("q.x").alias("x1"), F.max("q.y").alias("y1"))

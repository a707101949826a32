"""Shapes and regions: pixels in shapes, masks at other scales, bands, ramps, rings, gradient chains,
staged results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.operators.curves import arc_coverage, compatible_arcs
from swatchwork.operators.graph import connected_components
from swatchwork.operators.palette import plane_fit
from swatchwork.operators.raster import PIXEL
from swatchwork.runtime import by_shuffle, united, written


def points_in_shape(px: DataFrame, circles: DataFrame, inset: float = 0.5, cell: int = 16) -> DataFrame:
    """Pixels inside each circle less its inset; pixels and boxes meet in grid cells."""
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    p = px.select(*PIXEL, at("y").alias("gy"), at("x").alias("gx"))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("rad")) / cell).cast("int"), F.floor((F.col(c) + F.col("rad")) / cell).cast("int")))
    s = circles.select("doc_id", "z", "cx", "cy", "rad").withColumn("gy", span("cy")).withColumn("gx", span("cx"))
    inside = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2) <= F.pow(F.greatest(F.col("rad") - inset, F.lit(0.0)), 2)
    return p.join(s, ["doc_id", "gy", "gx"]).filter(inside).select(*PIXEL, "z")


def clear_mask(px: DataFrame, mask: DataFrame, px_size: int, mask_size: int) -> DataFrame:
    """Alpha 0 where the mask (at another resolution, nearest pixel) covers the picture."""
    to = lambda c: F.floor(F.col(c) * mask_size / px_size).cast("int")
    m = mask.select("doc_id", F.col("y").alias("my"), F.col("x").alias("mx")).distinct().withColumn("hole", F.lit(True))
    return px.withColumn("my", to("y")).withColumn("mx", to("x")).join(m, ["doc_id", "my", "mx"], "left").select(*PIXEL, "r", "g", "b", F.when(F.col("hole"), 0).otherwise(F.col("a")).alias("a"))


def palette_image(px: DataFrame, labels: DataFrame, pal: DataFrame) -> DataFrame:
    """Pixels in palette colours (labels: doc_id, r, g, b, k) with their own alpha. Colours, one row each, get their
    palette's first; pixels meet them once, by shuffle."""
    p = pal.select("doc_id", "k", *(F.round(F.col(c)).cast("int").alias(f"p_{c}") for c in "rgb"))
    known = labels.select("doc_id", "r", "g", "b", "k").join(by_shuffle(p), ["doc_id", "k"])
    return px.join(by_shuffle(known), ["doc_id", "r", "g", "b"]).select(*PIXEL, F.col("p_r").alias("r"), F.col("p_g").alias("g"), F.col("p_b").alias("b"), "a")


def merge_bands(adjacency: DataFrame, contacts: int = 40, smooth: float = 0.55) -> DataFrame:
    """Regions (doc_id, lo, hi) joined over long smooth contacts, with their smallest label."""
    node = lambda c: F.struct(F.col("doc_id"), F.col(c).alias("label"))
    edges = adjacency.filter((F.col("contacts") >= contacts) & (F.col("smooth") >= smooth)).select(node("lo").alias("src"), node("hi").alias("dst"))
    found = connected_components(edges)
    return found.select("node.doc_id", "node.label", F.col("component.label").alias("region"))


def merge_color_bands(adjacency: DataFrame, regions: DataFrame, contacts: int = 40, smooth: float = 0.55, area: int = 400, apart: float = 32.0) -> DataFrame:
    """``merge_bands`` over contacts of large regions (doc_id, label, area, r, g, b) of clearly different
    colours only: bands of one ramp, not shades of one paint."""
    end = lambda side: regions.filter(F.col("area") >= area).select("doc_id", F.col("label").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in "rgb"))
    gap = sum((F.pow(F.col(f"lo_{c}") - F.col(f"hi_{c}"), 2) for c in "rgb"), F.lit(0.0))
    far = adjacency.join(end("lo"), ["doc_id", "lo"]).join(end("hi"), ["doc_id", "hi"]).filter(gap >= apart * apart)
    return merge_bands(far.select("doc_id", "lo", "hi", "contacts", "smooth"), contacts, smooth)


def along_axis(px: DataFrame, fit: DataFrame) -> DataFrame:
    """``px`` with its place ``t`` along the direction of steepest brightness of its document's plane ``fit`` (of
    ``plane_fit``), that direction ``ux, uy``, and the range ``lo, length`` of the document's places."""
    steep = {d: sum((w * F.col(f"slope_{d}_{c}") for c, w in zip("rgb", (0.299, 0.587, 0.114))), F.lit(0.0)) for d in "xy"}
    # A plane without brightness slopes takes its strongest channel instead.
    one = F.array_max(F.array(*(F.struct((F.abs(f"slope_x_{c}") + F.abs(f"slope_y_{c}")).alias("size"), F.lit(-k).alias("first"), F.col(f"slope_x_{c}").alias("x"), F.col(f"slope_y_{c}").alias("y")) for k, c in enumerate("rgb"))))
    flat = F.sqrt(F.pow(steep["x"], 2) + F.pow(steep["y"], 2)) < 1e-4
    axis = fit.select("doc_id", F.when(flat, one["x"]).otherwise(steep["x"]).alias("gx"), F.when(flat, one["y"]).otherwise(steep["y"]).alias("gy")).withColumn("norm", F.sqrt(F.pow("gx", F.lit(2)) + F.pow("gy", F.lit(2)))).filter("norm >= 1e-6")
    at = px.join(axis, "doc_id").withColumn("t", F.round((F.col("x") * F.col("gx") + F.col("y") * F.col("gy")) / F.col("norm"), 6))
    ends = at.groupBy("doc_id").agg(F.min("t").alias("lo"), (F.max("t") - F.min("t")).alias("length"))
    return at.withColumn("ux", F.col("gx") / F.col("norm")).withColumn("uy", F.col("gy") / F.col("norm")).drop("gx", "gy", "norm").join(ends, "doc_id")


def axis_stops(px: DataFrame, stops: int = 5, half: float = 0.08, least: int = 30, long: float = 24.0, near: int = 6, span: int = 30) -> DataFrame:
    """Colour stops of a region along its own axis, the direction of steepest brightness of its plane
    fit: doc_id, stop, r, g, b.

    A stop is the median colour of the pixels within ``half`` of the length around its place. Stops of
    few pixels, and those like the last one kept, are left out; the last one stays. Regions shorter
    than ``long``, with one stop, or whose ends differ by less than ``span`` have none.
    """
    return _stops_along(along_axis(px, written(plane_fit(px))), stops, half, least, long, near, span)


def _stops_along(at: DataFrame, stops: int, half: float, least: int, long: float, near: int, span: int) -> DataFrame:
    place = F.filter(F.sequence(F.lit(0), F.lit(stops - 1)), lambda k: F.abs(F.col("t") - (F.col("lo") + F.col("length") * k / (stops - 1))) <= F.col("length") * half + 1e-9)
    tone = at.filter(F.col("length") >= long).select("doc_id", F.explode(place).alias("stop"), "r", "g", "b").groupBy("doc_id", "stop").agg(F.count(F.lit(1)).alias("n"), *(F.floor(F.percentile(c, F.lit(0.5))).cast("int").alias(c) for c in "rgb")).filter(F.col("n") >= least)
    line = tone.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("stop", "r", "g", "b"))).alias("s")).filter(F.size("s") >= 2)
    differ = lambda p, q: F.greatest(*(F.abs(p[c] - q[c]) for c in "rgb"))
    last = F.element_at("s", -1)
    kept = F.aggregate(F.slice("s", 2, stops), F.slice("s", 1, 1), lambda acc, q: F.when((differ(q, F.element_at(acc, -1)) > near) | (q["stop"] == last["stop"]), F.concat(acc, F.array(q))).otherwise(acc))
    wide = line.filter(differ(F.element_at("s", 1), last) >= span)
    return wide.select("doc_id", F.explode(kept).alias("q")).select("doc_id", "q.stop", "q.r", "q.g", "q.b")


@dataclass(frozen=True)
class RampParams:
    """Least pixels of a region, largest mean distance from its plane, stops along the axis (see
    ``axis_stops``), and by how much a ramp has to beat the flat colours; ``most`` ramps a document."""

    area: int = 1200
    off_plane: float = 26.0
    stops: int = 5
    half: float = 0.08
    least: int = 30
    long: float = 24.0
    near: int = 6
    span: int = 30
    gain: float = 2.0
    worse: float = 3.0
    share: float = 0.1
    most: int = 8


def region_ramps(px: DataFrame, p: RampParams = RampParams()) -> DataFrame:
    """Ramps of any number of regions a document, along each region's own axis: ``doc_id, region, area, x1, y1,
    x2, y2, stops, flat_mean, ramp_mean, flat_p90, ramp_p90, worse_share``.

    ``px``: doc_id, region, y, x, r, g, b and the flat colour fr, fg, fb that stands there now. A region stays
    flat when it is small, far from a plane, short, of nearly one colour, or when the ramp's error (largest
    channel difference) is not lower by ``gain`` on average, is higher at the 90th percentile, or gets worse by
    more than ``worse`` on over ``share`` of the pixels. Of each document the ``most`` largest stay.
    """
    own = px.withColumn("doc_id", F.struct("doc_id", "region")).drop("region")
    large = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("area"), F.avg("x").alias("mx"), F.avg("y").alias("my"), *(F.avg(c).alias(f"m{c}") for c in "rgb")).filter(F.col("area") >= p.area)
    large = written(large)
    own = written(own.join(large.select("doc_id"), "doc_id", "left_semi"))
    fit = plane_fit(own)
    off = F.greatest(*(F.abs(F.col(c) - F.col(f"m{c}") - F.col(f"slope_x_{c}") * (F.col("x") - F.col("mx")) - F.col(f"slope_y_{c}") * (F.col("y") - F.col("my"))) for c in "rgb"))
    plane = own.join(large, "doc_id").join(fit, "doc_id").groupBy("doc_id").agg(F.avg(off).alias("off")).filter(F.col("off") <= p.off_plane)
    fit = written(fit.join(plane.select("doc_id"), "doc_id", "left_semi"))
    at = written(along_axis(own, fit))
    stops = _stops_along(at, p.stops, p.half, p.least, p.long, p.near, p.span)
    line = stops.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((F.col("stop") / (p.stops - 1)).alias("offset"), "r", "g", "b"))).alias("stops"))
    rows = at.join(line, "doc_id").withColumn("u", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - F.col("lo")) / F.col("length"))))
    nth = F.size(F.filter("stops", lambda q: q["offset"] <= F.col("u")))
    a, b = F.element_at("stops", F.greatest(nth, F.lit(1))), F.element_at("stops", F.least(nth + 1, F.size("stops")))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("u") - a["offset"], b["offset"] - a["offset"]), F.lit(0.0))))
    ramp = F.greatest(*(F.abs(F.col(c) - a[c] - part * (b[c] - a[c])) for c in "rgb"))
    flat = F.greatest(*(F.abs(F.col(c) - F.col(f"f{c}")) for c in "rgb")).cast("double")
    e = rows.select("doc_id", "stops", "ux", "uy", "lo", "length", ramp.alias("ramp"), flat.alias("flat"))
    p90 = lambda c: F.percentile(c, F.lit(0.9)).alias(f"{c}_p90")
    lost = F.avg(F.when(F.col("ramp") > F.col("flat") + p.worse, 1.0).otherwise(0.0)).alias("worse_share")
    g = e.groupBy("doc_id", "stops", "ux", "uy", "lo", "length").agg(F.count(F.lit(1)).alias("area"), F.avg("flat").alias("flat_mean"), F.avg("ramp").alias("ramp_mean"), p90("flat"), p90("ramp"), lost)
    kept = g.filter((F.col("ramp_mean") <= F.col("flat_mean") - p.gain) & (F.col("ramp_p90") <= F.col("flat_p90")) & (F.col("worse_share") <= p.share))
    end = lambda far: [(F.col(u) * (F.col("lo") + far)).alias(f"{c}{1 if far is zero else 2}") for c, u in (("x", "ux"), ("y", "uy"))]
    zero = F.lit(0.0)
    out = kept.select("doc_id.doc_id", "doc_id.region", "area", *end(zero), *end(F.col("length")), "stops", *(F.round(c, 3).alias(c) for c in ("flat_mean", "ramp_mean", "flat_p90", "ramp_p90")), F.round("worse_share", 4).alias("worse_share"))
    return largest_ramps(out, p.most, ["doc_id"], "region")


def ramp_stops(px: DataFrame, stops: int = 5) -> DataFrame:
    """Median colour in overlapping windows around equally spaced places along x."""
    ends = px.groupBy("doc_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    t = (F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    near = F.filter(F.sequence(F.lit(0), F.lit(stops - 1)), lambda k: F.abs(t - k / (stops - 1)) <= 0.6 / (stops - 1))
    return px.join(ends, "doc_id").select("doc_id", F.explode(near).alias("stop"), "r", "g", "b").groupBy("doc_id", "stop").agg(F.count(F.lit(1)).alias("pixels"), *(F.percentile(c, F.lit(0.5)).alias(c) for c in "rgb"))


def eval_gradient(px: DataFrame, stops: DataFrame) -> DataFrame:
    """Colour of each pixel by linear interpolation between the stops around its place along x."""
    by = Window.partitionBy("doc_id").orderBy("stop")
    n = F.max("stop").over(Window.partitionBy("doc_id"))
    seg = stops.select("doc_id", (F.col("stop") / n).alias("t0"), (F.lead("stop").over(by) / n).alias("t1"), *(F.col(c).alias(f"{c}0") for c in "rgb"), *(F.lead(c).over(by).alias(f"{c}1") for c in "rgb")).filter("t1 IS NOT NULL")
    ends = px.groupBy("doc_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = px.join(ends, "doc_id").withColumn("t", (F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
    u = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    hit = at.join(seg, "doc_id").filter("t >= t0 AND (t < t1 OR (t = 1 AND t1 = 1))")
    return hit.select(*PIXEL, *(F.round(F.col(f"{c}0") + u * (F.col(f"{c}1") - F.col(f"{c}0")), 3).alias(c) for c in "rgb"))


def annulus_candidates(arcs: DataFrame, least: float = 180.0, overlap: float = 0.12) -> DataFrame:
    """Rings made of compatible arcs (doc_id, arc_id, the looks, cx, cy, radius, a0, a1): members, weighted
    radius and width, coverage, and whether they cover enough without overlap. ``rings.ring_candidates`` is
    the full gate on sampled points."""
    node = lambda c: F.struct(F.col("doc_id"), F.col(c).alias("arc_id"))
    parts = written(connected_components(compatible_arcs(arcs).select(node("src").alias("src"), node("dst").alias("dst"))))
    ring = parts.select("node.doc_id", "node.arc_id", F.col("component.arc_id").alias("ring"))
    rows = written(arcs.join(ring, ["doc_id", "arc_id"]).select("doc_id", "arc_id", "ring", "radius", "width", "a0", "a1"))
    span = F.col("a1") - F.col("a0")
    mean = rows.groupBy("doc_id", "ring").agg(F.count(F.lit(1)).alias("arcs"), F.round(F.sum(F.col("radius") * span) / F.sum(span), 6).alias("radius"), F.round(F.sum(F.col("width") * span) / F.sum(span), 6).alias("width"))
    return mean.join(arc_coverage(rows), ["doc_id", "ring"]).withColumn("safe", (F.col("degrees") >= least) & (F.col("overlap") <= overlap))


def concentric_rings(circles: DataFrame, apart: float = 2.5) -> DataFrame:
    """Pairs of circles of a document with near centres: radius and width of the ring between."""
    cell = lambda c: F.floor(F.col(c) / apart).cast("int")
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    a = circles.select("doc_id", "z", "cx", "cy", "rad").withColumn("gx", cell("cx")).withColumn("gy", cell("cy"))
    b = a.select("doc_id", *(F.col(c).alias(f"o_{c}") for c in ("z", "cx", "cy", "rad")), "gx", "gy").withColumn("dx", near).withColumn("dy", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("gx", F.col("gx") + F.col("dx")).withColumn("gy", F.col("gy") + F.col("dy"))
    d = F.sqrt(F.pow(F.col("cx") - F.col("o_cx"), 2) + F.pow(F.col("cy") - F.col("o_cy"), 2))
    return a.join(by_shuffle(b), ["doc_id", "gx", "gy"]).filter("rad > o_rad").filter(d <= apart).select("doc_id", F.col("z").alias("outer"), F.col("o_z").alias("inner"), ((F.col("rad") + F.col("o_rad")) / 2).alias("radius"), (F.col("rad") - F.col("o_rad")).alias("width"))


def resolved_stops(gradients: DataFrame) -> DataFrame:
    """Stops of every gradient (doc_id, id, href, stops), its own or those of the first in its chain
    of references that owns some; 0 for cycles and dead ends.

    Pointers double in each round, so after as many rounds as the largest document's number of gradients has
    binary digits every chain is at its end; what still points on then is in or before a cycle.
    """
    most = gradients.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    now = written(gradients.select("doc_id", "id", F.when(F.col("stops") > 0, F.lit(None).cast("string")).otherwise(F.col("href")).alias("next"), F.coalesce("stops", F.lit(0)).alias("stops")))
    for _ in range(most.bit_length()):
        if now.filter("stops = 0 AND next IS NOT NULL").isEmpty():
            break
        up = now.select("doc_id", F.col("id").alias("next"), F.col("next").alias("up_next"), F.col("stops").alias("up_stops"))
        stuck = F.col("stops") > 0
        now = written(now.join(up, ["doc_id", "next"], "left").select("doc_id", "id", F.when(stuck | (F.coalesce("up_stops", F.lit(0)) > 0), F.lit(None).cast("string")).otherwise(F.col("up_next")).alias("next"), F.when(stuck, F.col("stops")).otherwise(F.coalesce("up_stops", F.lit(0))).alias("stops")))
    return now.select("doc_id", "id", "stops")


def staged(before: DataFrame, after: DataFrame, verdicts: DataFrame, key: str, *columns: str) -> DataFrame:
    """The later version of what was accepted, the earlier of all else; no verdict means rejected."""
    b = before.select(key, *(F.col(c).alias(f"b_{c}") for c in columns))
    a = after.select(key, *(F.col(c).alias(f"a_{c}") for c in columns))
    ok = F.coalesce("accepted", F.lit(False)) & F.col("there")
    rows = b.join(a.withColumn("there", F.lit(True)), key, "left").join(verdicts.select(key, "accepted"), key, "left")
    return rows.select(key, *(F.when(ok, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in columns), F.coalesce(ok, F.lit(False)).alias("committed"))


def failures_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document (doc_id, part): failures that stayed, and those that are new."""
    b, a = before.distinct().withColumn("was", F.lit(1)), after.distinct().withColumn("is_now", F.lit(1))
    both = b.join(a, ["doc_id", "part"], "full")
    return both.groupBy("doc_id").agg(F.count_if(F.col("was").isNotNull() & F.col("is_now").isNotNull()).alias("unresolved"), F.count_if(F.col("was").isNull()).alias("new_failures"), F.count_if(F.col("is_now").isNull()).alias("fixed"))


def ramp_gate(px: DataFrame, stops: DataFrame, flat: DataFrame, gain: float = 2.0, worse: float = 3.0, share: float = 0.1, span: int = 30) -> DataFrame:
    """Ramps along x, one a document, that beat the flat colour they would replace (flat: doc_id, r, g, b):
    the end stops differ by ``span`` levels, the mean error (largest channel difference) falls by
    ``gain``, its 90th percentile does not rise, and at most ``share`` of the pixels get worse by more
    than ``worse``. ``region_ramps`` takes several regions a document, each along its own axis."""
    wide = F.greatest(*(F.abs(F.max_by(c, "stop") - F.min_by(c, "stop")) for c in "rgb"))
    steep = stops.groupBy("doc_id").agg(wide.alias("span")).filter(F.col("span") >= span).select("doc_id")
    fitted = eval_gradient(px.join(steep, "doc_id", "left_semi"), stops).select(*PIXEL, *(F.col(c).alias(f"f_{c}") for c in "rgb"))
    other = flat.select("doc_id", *(F.col(c).alias(f"p_{c}") for c in "rgb"))
    gap = lambda m: F.greatest(*(F.abs(F.col(c) - F.col(f"{m}_{c}")) for c in "rgb")).cast("double")
    e = px.join(fitted, PIXEL).join(other, "doc_id").select("doc_id", gap("f").alias("ramp"), gap("p").alias("flat"))
    p90 = lambda c: F.round(F.percentile(c, F.lit(0.9)), 3).alias(f"{c}_p90")
    lost = F.avg(F.when(F.col("ramp") > F.col("flat") + worse, 1.0).otherwise(0.0))
    g = e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("area"), *(F.round(F.avg(c), 3).alias(f"{c}_mean") for c in ("ramp", "flat")), p90("ramp"), p90("flat"), F.round(lost, 4).alias("worse_share"))
    return g.filter((F.col("ramp_mean") <= F.col("flat_mean") - gain) & (F.col("ramp_p90") <= F.col("flat_p90")) & (F.col("worse_share") <= share))


def largest_ramps(ramps: DataFrame, most: int, key: list[str], last: str) -> DataFrame:
    """The ``most`` ramps of largest area of each ``key``; ties by ``last``."""
    return ramps.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("area"), last))).filter(F.col("place") <= most).drop("place")


def rank_annuli(rings: DataFrame) -> DataFrame:
    """Rings (doc_id, ring, safe, degrees, f1) with their place in the document: safe ones first, then
    by coverage, raster score and id."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("safe"), F.desc("degrees"), F.desc("f1"), "ring")
    return rings.withColumn("place", F.row_number().over(order))


def assemble(fills: DataFrame, strokes: DataFrame, recovered: DataFrame) -> DataFrame:
    """All drawables (doc_id, pos, ...) of a document in one order: fills, then strokes, then what was
    recovered; a column that one of them lacks is null."""
    layers = [df.withColumn("layer", F.lit(k)) for k, df in enumerate((fills, strokes, recovered))]
    every = layers[0].transform(united, layers[1], allowMissingColumns=True).transform(united, layers[2], allowMissingColumns=True)
    return every.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("layer", "pos"))).drop("layer", "pos")

"""Checks of elements, groups, circles and named editing operations, and ink mass under resizing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.functions.svg import NUMBER, solid_paint
from swatchwork.operators.bands import BAND, Grid, Pixels, by_band, eroded, filled, packed, runs, summed
from swatchwork.operators.compare import border_stats
from swatchwork.operators.paths import endpoint_arc, on_arc
from swatchwork.operators.raster import EIGHT, PIXEL, component_stats, composite_over, labelled_runs
from swatchwork.runtime import by_shuffle, united, written

#: Places that are not drawn, and attributes that make a split unsafe.
HIDDEN_PLACES = ("clipPath", "defs", "filter", "linearGradient", "marker", "mask", "pattern", "radialGradient", "symbol")
UNSAFE_ATTRIBUTES = ("clip-path", "filter", "isolation", "marker-end", "marker-mid", "marker-start", "mask", "mix-blend-mode", "pathLength", "transform")
#: Reasons of groups that hold one object, and of decorations, by kind.
OBJECT_REASONS = ("cross-paint-overlap", "cross-paint-overlay", "fragment-proximity", "matching-bounds")
DECORATIONS = {"halftone": ("repeated-dot-proximity", "declared-halftone-role"), "parallel-lines": ("parallel-stroke-proximity", "declared-parallel-line-role")}
#: Named checks and the status of a document that has no rows for one.
CHECKS = {
    "global-colour-role": "failed",
    "native-gradient-resource": "manual_review",
    "local-multicolour-dom-groups": "manual_review",
    "outer-ring": "failed",
    "decoration-groups": "manual_review",
}


def is_straight_cubic(*p: Column) -> Column:
    """Whether a cubic (start, two controls, end; exact numbers) is a straight line: both controls on
    it, in order, and the ends apart."""
    dx, dy = p[6] - p[0], p[7] - p[1]
    across = [dx * (p[k + 1] - p[1]) - dy * (p[k] - p[0]) for k in (2, 4)]
    first, second = (dx * (p[k] - p[0]) + dy * (p[k + 1] - p[1]) for k in (2, 4))
    size = dx * dx + dy * dy
    return (size > 0) & (across[0] == 0) & (across[1] == 0) & (first >= 0) & (first <= second) & (second <= size)


def exact_lines(el: DataFrame, segments: DataFrame, references: DataFrame) -> DataFrame:
    """Paths that are exactly a line or a polyline: stroked, unfilled, without style or transform,
    not referenced, one open sub-path of straight commands without a repeated point.

    ``el``: doc_id, idx, tag, id, fill, stroke, style, transform; ``segments``: of ``path_segments``;
    ``references``: doc_id, ref.
    """
    plain = el.filter("tag = 'path' AND lower(trim(fill)) = 'none' AND style IS NULL AND transform IS NULL").filter(F.coalesce(F.lower(F.trim("stroke")), F.lit("none")) != "none")
    free = plain.join(references.select("doc_id", F.col("ref").alias("id")).distinct(), ["doc_id", "id"], "left_anti")
    shape = segments.groupBy("doc_id", "idx").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("x", "y").alias("points"), F.max("subpath").alias("last"),
        F.min((F.col("is_valid") & F.col("cmd").isin("M", "L", "H", "V")).cast("int")).alias("straight"),
    ).filter("straight = 1 AND last = 0 AND n = points AND n >= 2")
    return free.join(shape, ["doc_id", "idx"]).select("doc_id", "idx", F.when(F.col("n") == 2, "line").otherwise("polyline").alias("kind"), F.col("n").alias("points"))


def canvas_of(view_box: Column, width: Column, height: Column, unit: bool = False) -> Column:
    """Canvas as struct of x, y, w, h: the view box where it has four numbers and a size, else width
    and height, else null, or the unit box with ``unit``."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(view_box, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda n: n.cast("double"))
    first = lambda c: F.try_element_at(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0)), F.lit(1)).cast("double")
    box = lambda *v: F.struct(*(c.alias(n) for n, c in zip("xywh", v)))
    boxed = F.when((F.size(numbers) == 4) & (F.get(numbers, F.lit(2)) > 0) & (F.get(numbers, F.lit(3)) > 0), box(*(F.get(numbers, F.lit(k)) for k in range(4))))
    sized = F.when((first(width) > 0) & (first(height) > 0), box(F.lit(0.0), F.lit(0.0), first(width), first(height)))
    return F.coalesce(boxed, sized, *([box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))] if unit else []))


def splittable(el: DataFrame, references: DataFrame, servers: DataFrame) -> DataFrame:
    """Can a path be split into its sub-paths? ``doc_id, idx, reason``: the first reason against, or
    null. Ancestors are followed level by level, each level one join.

    ``el``: doc_id, idx, parent_idx, tag, id, fill, stroke, attributes (names); ``references``:
    doc_id, ref; ``servers``: doc_id, id, is_safe of paint servers. A missing fill is black.
    """
    unsafe = F.exists("attributes", lambda a: a.isin(*UNSAFE_ATTRIBUTES) | F.startswith(F.lower(a), F.lit("on")))
    nodes = el.select("doc_id", "idx", "parent_idx", F.col("tag").isin(*HIDDEN_PLACES).cast("int").alias("hidden"), F.coalesce(unsafe, F.lit(False)).cast("int").alias("unsafe"))
    above = nodes.select("doc_id", F.col("idx").alias("at"), F.col("parent_idx").alias("next"), F.col("hidden").alias("up_hidden"), F.col("unsafe").alias("up_unsafe"))
    walk = written(el.filter("tag = 'path'").select("doc_id", "idx").join(nodes.select("doc_id", "idx", F.col("parent_idx").alias("at"), F.lit(0).alias("hidden"), "unsafe"), ["doc_id", "idx"]))
    ended = [walk.filter("at IS NULL")]
    live = walk.filter("at IS NOT NULL")
    while not live.isEmpty():
        walk = written(live.join(above, ["doc_id", "at"], "left").select("doc_id", "idx", F.col("next").alias("at"), F.greatest("hidden", "up_hidden").alias("hidden"), F.greatest("unsafe", "up_unsafe").alias("unsafe")))
        ended.append(walk.filter("at IS NULL"))
        live = walk.filter("at IS NOT NULL")
    around = reduce(united, ended).select("doc_id", "idx", "hidden", "unsafe")
    named = F.regexp_extract(F.trim(F.coalesce("fill", F.lit("#000000"))), r"^url\(\s*#([^\s)]+)\s*\)$", 1)
    rows = el.select("doc_id", "idx", "id", "stroke", F.coalesce("fill", F.lit("#000000")).alias("fill"), F.when(named != "", named).alias("server")).join(around, ["doc_id", "idx"])
    rows = rows.join(servers.select("doc_id", F.col("id").alias("server"), "is_safe"), ["doc_id", "server"], "left").join(references.select("doc_id", F.col("ref").alias("id"), F.lit(True).alias("used")).distinct(), ["doc_id", "id"], "left")
    odd = F.col("fill").rlike(r"(?i)(?:url|var)\s*\(")
    reason = (
        F.when(F.col("hidden") == 1, "not_rendered").when(F.col("unsafe") == 1, "unsafe_attribute")
        .when(F.lower(F.trim("fill")).isin("none", "transparent"), "no_fill").when(solid_paint(F.col("stroke")).isNotNull(), "stroked")
        .when(odd & ~F.coalesce("is_safe", F.lit(False)), "unsafe_paint").when(F.col("used"), "referenced")
    )
    return rows.select("doc_id", "idx", reason.alias("reason"))


#: Least and most steps of a segment by kind.
STEPS = {"line": (1, 1 << 20), "quad": (2, 512), "cubic": (3, 512), "arc": (2, 512), "svg_arc": (2, 512)}


def sample_path(segments: DataFrame, step: float) -> DataFrame:
    """Points along segments, about ``step`` apart, the last one at the end: doc_id, seg, k, x, y.

    ``segments``: doc_id, seg, kind, and up to nine numbers ``p`` - start, controls, end; a line uses the
    first four, a quad six, a cubic eight, an arc centre, radii, start angle and sweep in degrees, an
    svg_arc those of ``endpoint_arc``, all nine.
    """
    segments = segments.withColumn("_arc", F.when(F.col("kind") == "svg_arc", endpoint_arc(F.col("p"))))
    arc = F.col("_arc")
    p = [F.get("p", F.lit(k)) for k in range(8)]
    hop = lambda a, b: F.sqrt(F.pow(p[b] - p[a], 2) + F.pow(p[b + 1] - p[a + 1], 2))
    kind = F.col("kind")
    size = F.when(kind == "line", hop(0, 2)).when(kind == "quad", hop(0, 2) + hop(2, 4)).when(kind == "cubic", hop(0, 2) + hop(2, 4) + hop(4, 6)).when(kind == "svg_arc", F.greatest(arc["rx"], arc["ry"]) * F.abs(arc["sweep"])).otherwise(F.greatest(p[2], p[3]) * F.radians(F.abs(p[5])))
    low, high = (reduce(lambda c, n: c.when(kind == n, STEPS[n][i]), STEPS, F) for i in (0, 1))
    n = F.least(high, F.greatest(low, F.ceil(size / step).cast("int")))
    n = F.when(arc["straight"], 1).otherwise(n)
    rows = segments.select("doc_id", "seg", "kind", "p", "_arc", n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t, s = F.col("k") / F.col("n"), 1 - F.col("k") / F.col("n")

    def place(o: int) -> Column:
        turn = F.radians(p[4] + p[5] * t)
        return (
            F.when(kind == "line", s * p[o] + t * p[2 + o]).when(kind == "quad", s * s * p[o] + 2 * s * t * p[2 + o] + t * t * p[4 + o])
            .when(kind == "cubic", s * s * s * p[o] + 3 * s * s * t * p[2 + o] + 3 * s * t * t * p[4 + o] + t * t * t * p[6 + o])
            .when(arc["straight"], F.get("p", F.lit(7 + o))).when(kind == "svg_arc", on_arc(arc, arc["start"] + arc["sweep"] * t)[o])
            .otherwise(p[o] + p[2 + o] * (F.sin(turn) if o else F.cos(turn)))
        )

    return rows.select("doc_id", "seg", "k", F.round(place(0) + 1e-9, 4).alias("x"), F.round(place(1) + 1e-9, 4).alias("y"))


def _masses(pictures: dict[int, Pixels], band: int, facts: dict) -> dict[str, object]:
    """Ink of both pictures among the band's own pixels, and the sums of their agreement over it."""
    grid, threshold = Grid(*pictures.values()), facts["threshold"]
    ink, count, mass = [], [], []
    for side in (0, 1):
        p = pictures.get(side)
        strength = None if p is None else reduce(np.fmax, (np.abs(p[c] - facts[f"bg_{c}"]) for c in "rgb"))
        mask = grid.mask(p, None if p is None else strength >= threshold)
        if side == 0 and p is not None:
            lone = grid.mask(p, strength >= max(threshold * 1.75, threshold + 12))
            mask &= (summed(mask.astype(np.int32), EIGHT) >= 2) | lone
        ink.append(mask)
        count.append(summed(mask.astype(float), EIGHT))
        mass.append([summed(np.where(mask, np.rint(facts[f"bg_{c}"]) - grid.plane(p, c), 0.0), EIGHT) for c in "rgb"])
    off = reduce(np.maximum, (np.abs(a - b) for a, b in zip(*mass))) / np.maximum(np.maximum(*count), 1.0)
    alike, own = np.maximum(0.0, 1 - off / 128), grid.rows_of(band)
    return {f"{n}{side}": [v] for side in (0, 1) for n, v in (("own", (ink[side] & own).sum()), ("sim", alike[ink[side] & own].sum()))}


def ink_mass_match(src: DataFrame, ren: DataFrame, height: int, width: int) -> DataFrame:
    """Agreement of mean signed ink in 3x3 support, for a render compared with a resized source: over
    source ink and over render ink, in percent. Both pictures meet in packed bands, so no pixel is
    spread to its neighbours. ``ren`` has the size of ``src``."""
    src, ren = composite_over(src), composite_over(ren)
    stats = border_stats(src, height, width).select("doc_id", "bg_r", "bg_g", "bg_b", "threshold")
    found = by_band(packed([src, ren], halo=2), _masses, "own0 long, sim0 double, own1 long, sim1 double", stats)
    g = found.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("own0", "sim0", "own1", "sim1"))).filter("own0 + own1 > 0")
    over = lambda k: F.round(100 * F.when(F.col(f"own{k}") > 0, F.col(f"sim{k}") / F.col(f"own{k}")) + 1e-9, 3)
    return g.select("doc_id", F.col("own0").alias("src_ink"), F.col("own1").alias("ren_ink"), over(0).alias("src_match"), over(1).alias("ren_match"))


def concentric_dots(circles: DataFrame) -> DataFrame:
    """Large circles around one centre, and small dots on an orbit around it, per document.

    ``circles``: doc_id, z, cx, cy, rad, paint. Large is at least 0.35 of the largest radius; the
    centre is their mean where they agree, else that of the largest circle. Dots no more than six
    degrees apart are one cluster; five clusters are needed. Angles below the limits count as even.
    """
    top = circles.groupBy("doc_id").agg(F.max("rad").alias("rmax"), F.max_by(F.struct("cx", "cy"), F.struct("rad", "z")).alias("main"))
    c = circles.join(top, "doc_id")
    big = c.filter("rad >= 0.35 * rmax").groupBy("doc_id", "rmax", "main").agg(F.count(F.lit(1)).alias("large"), F.avg("cx").alias("ux"), F.avg("cy").alias("uy"), F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("spread"))
    one = (F.col("large") >= 2) & (F.col("spread") <= F.greatest(0.02 * F.col("rmax"), F.lit(3.0)))
    centre = big.select("doc_id", "rmax", "large", one.alias("concentric"), F.when(one, F.col("ux")).otherwise(F.col("main.cx")).alias("mx"), F.when(one, F.col("uy")).otherwise(F.col("main.cy")).alias("my"))
    dx, dy = F.col("cx") - F.col("mx"), F.col("cy") - F.col("my")
    dots = circles.join(centre, "doc_id").filter("rad <= 0.18 * rmax").withColumn("orbit", F.sqrt(dx * dx + dy * dy)).filter("orbit >= 0.25 * rmax AND orbit <= 1.05 * rmax")
    dots = dots.withColumn("angle", F.round(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)), 6))
    by = Window.partitionBy("doc_id").orderBy("angle", "z")
    all_ = Window.partitionBy("doc_id")
    dots = dots.withColumn("fresh", F.when(F.col("angle") - F.lag("angle").over(by) <= 6, 0).otherwise(1)).withColumn("cluster", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    dots = dots.withColumn("last", F.max("cluster").over(all_)).withColumn("joined", (F.col("last") > 1) & (F.min("angle").over(all_) + 360 - F.max("angle").over(all_) <= 6) & (F.col("cluster") == F.col("last")))
    dots = dots.withColumn("angle", F.when(F.col("joined"), F.col("angle") - 360).otherwise(F.col("angle"))).withColumn("cluster", F.when(F.col("joined"), 1).otherwise(F.col("cluster")))
    mean = dots.groupBy("doc_id", "cluster").agg(F.avg("angle").alias("at"))
    step = 360 / F.count(F.lit(1)).over(all_)
    even = mean.withColumn("rest", F.radians(F.col("at") - (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1) * step))
    phase = even.groupBy("doc_id").agg(F.count(F.lit(1)).alias("clusters"), F.atan2(F.sum(F.sin("rest")), F.sum(F.cos("rest"))).alias("phase"))
    gap = F.abs(F.pmod(F.degrees(F.col("rest") - F.col("phase")) + 180, F.lit(360.0)) - 180)
    turn = even.join(phase, "doc_id").groupBy("doc_id", "clusters").agg(F.round(F.max(gap), 4).alias("max_dev"))
    ring = dots.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dots"), ((F.max("orbit") - F.min("orbit")) / F.avg("orbit")).alias("swing"))
    size = dots.groupBy("doc_id", "paint").agg(F.count(F.lit(1)).alias("n"), ((F.max("rad") - F.min("rad")) / F.avg("rad")).alias("swing")).filter("swing <= 0.18").groupBy("doc_id").agg(F.sum("n").alias("same_size"))
    enough = (F.coalesce("clusters", F.lit(0)) >= 5) & (F.coalesce("dots", F.lit(0)) >= 5)
    rows = centre.join(turn, "doc_id", "left").join(ring, "doc_id", "left").join(size, "doc_id", "left")
    return rows.select(
        "doc_id", "large", "concentric", F.coalesce("dots", F.lit(0)).alias("dots"), F.coalesce("clusters", F.lit(0)).alias("clusters"), F.when(enough, F.col("max_dev")).alias("max_dev"),
        F.when(enough, F.col("max_dev") <= 4).alias("even_angles"), F.when(enough, F.col("swing") <= 0.06).alias("even_orbit"), F.when(enough, F.coalesce("same_size", F.lit(0))).alias("same_size"),
    )


def _extent(pictures: dict[int, Pixels], band: int) -> dict[str, object]:
    """Area and box of the second picture's own pixels."""
    p = pictures.get(1)
    own = np.flatnonzero(p["y"] // BAND == band) if p is not None else []
    if not len(own):
        return {c: np.empty(0) for c in ("n", "x0", "x1", "y0", "y1")}
    y, x = p["y"][own], p["x"][own]
    return {"n": [len(own)], "x0": [x.min()], "x1": [x.max()], "y0": [y.min()], "y1": [y.max()]}


def _told_apart(pairs: list[tuple[int, Pixels]]) -> dict[str, object]:
    """Runs of several masks in one table, by ``kind``."""
    return {"kind": np.concatenate([np.full(len(r["y"]), k) for k, r in pairs]), **{c: np.concatenate([r[c] for _, r in pairs]) for c in ("y", "x0", "x1")}}


def _pockets(pictures: dict[int, Pixels], band: int, facts: dict) -> dict[str, object]:
    """Runs of candidates inside the enclosure (kind 0) and of the enclosure's edge (1)."""
    grid = Grid(*pictures.values())
    whole, own = grid.mask(pictures.get(1)), grid.rows_of(band)
    core = whole
    for _ in range(facts["depth"]):
        core = eroded(core, EIGHT)
    return _told_apart([(0, runs(grid.mask(pictures.get(0)) & whole & own, grid)), (1, runs(whole & ~core & own, grid))])


def background_pockets(candidates: DataFrame, enclosure: DataFrame) -> DataFrame:
    """Components of background pixels inside an enclosure, and whether they are open space: large
    alone, spanning and dominant at the edge, or one of several parts that own some of the edge.

    ``candidates``, ``enclosure``: masks; the edge is a band of one to three pixels by the size of
    the enclosure. Both masks are packed once; after that only runs take part.
    """
    pieces = written(packed([candidates.select(*PIXEL), enclosure.select(*PIXEL)], halo=3))
    box = by_band(pieces, _extent, "n long, x0 long, x1 long, y0 long, y1 long")
    size = box.groupBy("doc_id").agg(F.sum("n").alias("e_area"), (F.max("x1") - F.min("x0") + 1).alias("e_w"), (F.max("y1") - F.min("y0") + 1).alias("e_h"))
    size = written(size.withColumn("depth", F.greatest(F.lit(1), F.least(F.lit(3), F.bround(0.01 * F.least("e_w", "e_h")).cast("int")))))
    found = written(by_band(pieces, _pockets, "kind int, y int, x0 int, x1 int", size.select("doc_id", "depth")))
    band = found.filter("kind = 1").select("doc_id", "y", F.col("x0").alias("o0"), F.col("x1").alias("o1"))
    own = written(labelled_runs(found.filter("kind = 0")))
    parts = written(component_stats(own))
    on_edge = own.join(by_shuffle(band), ["doc_id", "y"]).filter("x0 <= o1 AND o0 <= x1").groupBy("doc_id", "comp_id").agg(F.sum(F.least("x1", "o1") - F.greatest("x0", "o0") + 1).alias("on_edge"))
    edges = band.groupBy("doc_id").agg(F.sum(F.col("o1") - F.col("o0") + 1).alias("edge"))
    total = parts.groupBy("doc_id").agg(F.sum("area").alias("total"))
    rows = parts.join(by_shuffle(size), "doc_id").join(by_shuffle(edges), "doc_id").join(by_shuffle(total), "doc_id").join(by_shuffle(on_edge), ["doc_id", "comp_id"], "left")
    share, edge = F.col("area") / F.col("e_area"), F.coalesce("on_edge", F.lit(0)) / F.col("edge")
    spans = (F.col("bw") >= 0.72 * F.col("e_w")) & (F.col("bh") >= 0.72 * F.col("e_h"))
    rule = F.when(share >= 0.30, "large").when((share >= 0.08) & spans & (F.col("area") >= 0.65 * F.col("total")) & (edge >= 0.12), "spanning").when((F.col("total") >= 0.30 * F.col("e_area")) & (share >= 0.01) & (edge >= 0.08), "partitioned")
    return rows.select("doc_id", "comp_id", "area", F.round(share, 6).alias("share"), F.round(edge, 6).alias("edge_share"), rule.alias("rule"))


def group_evidence(members: DataFrame, reports: DataFrame, width: float, height: float) -> DataFrame:
    """Groups that are in the document, with box, paints and place, and those only in its report.

    ``members``: doc_id, group_id, box, fill, stroke, transformed; ``reports``: doc_id, group_id,
    reasons (array), confidence. No box is given under a transform.
    """
    paints = F.array_compact(F.array(F.concat(F.lit("fill:"), solid_paint(F.col("fill"))), F.concat(F.lit("stroke:"), solid_paint(F.col("stroke")))))
    box = members.groupBy("doc_id", "group_id").agg(
        F.count(F.lit(1)).alias("members"), F.max(F.col("transformed").cast("int")).alias("moved"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.size(F.array_distinct(F.flatten(F.collect_set(paints)))).alias("paints"),
    )
    rows = box.join(reports.select("doc_id", "group_id", "reasons", "confidence"), ["doc_id", "group_id"], "full")
    known = F.coalesce(F.col("moved") == 0, F.lit(False))
    w, h, mid = (F.col("x1") - F.col("x0")) / width, (F.col("y1") - F.col("y0")) / height, (F.col("x0") + F.col("x1")) / 2 / width
    return rows.select(
        "doc_id", "group_id", F.col("members").isNotNull().alias("in_document"), F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("paints", F.lit(0)).alias("paints"),
        F.when(~known, "unknown").when(mid < 0.40, "left").when(mid > 0.60, "right").otherwise("centre").alias("region"), F.when(known, F.round(w * h, 6)).alias("area_share"),
        (known & F.coalesce((w * h <= 0.15) & (w <= 0.60) & (h <= 0.60), F.lit(False))).alias("local"), F.array_join(F.array_sort(F.array_distinct(F.coalesce("reasons", F.array().cast("array<string>")))), ",").alias("reasons"), "confidence",
    )


def _has(names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split("reasons", ","), F.array(*map(F.lit, names)))


def colour_check(roles: DataFrame) -> DataFrame:
    """Does one control change a colour role everywhere? ``roles``: doc_id, role, channels (array),
    controls, paints_match, gradients_match, unsupported (paints of the document)."""
    wanted = F.array(*map(F.lit, ("fill", "stroke", "stop-color")))
    whole = (F.size(F.array_intersect("channels", wanted)) == 3) & (F.col("controls") == 1) & F.col("paints_match") & F.col("gradients_match")
    d = roles.groupBy("doc_id").agg(F.max(whole.cast("int")).alias("whole"), F.max("unsupported").alias("odd"), F.size(F.array_intersect(F.array_distinct(F.flatten(F.collect_set("channels"))), wanted)).alias("covered"))
    return d.select("doc_id", F.when((F.col("whole") == 1) & (F.col("odd") == 0), "passed").when(F.col("covered") == 3, "partial").otherwise("failed").alias("status"))


def gradient_check(inventory: DataFrame) -> DataFrame:
    """From ``gradient_inventory``: all used gradients can be edited, some, or none."""
    d = inventory.groupBy("doc_id").agg(F.count_if(F.col("uses") > 0).alias("used"), F.count_if("editable").alias("editable"))
    return d.select("doc_id", F.when((F.col("used") > 0) & (F.col("used") == F.col("editable")), "passed").when(F.col("used") + F.col("editable") > 0, "partial").otherwise("failed").alias("status"))


def local_group_check(evidence: DataFrame) -> DataFrame:
    """Small groups of several paints on the left and on the right; report-only groups don't count."""
    fits = F.expr("in_document AND local AND paints >= 2 AND area_share >= 0.0005 AND coalesce(confidence, 1) >= 0.74") & _has(OBJECT_REASONS) & ~_has(tuple(names[0] for names in DECORATIONS.values()))
    some = F.col("in_document") | _has(OBJECT_REASONS)
    side = lambda name: F.max((fits & (F.col("region") == name)).cast("int"))
    d = evidence.groupBy("doc_id").agg((side("left") + side("right")).alias("sides"), F.max(fits.cast("int")).alias("fits"), F.max(some.cast("int")).alias("some"))
    return d.select("doc_id", F.when(F.col("sides") == 2, "passed").when(F.col("fits") == 1, "partial").when(F.col("some") == 1, "failed").otherwise("manual_review").alias("status"))


def ring_check(circles: DataFrame, canvas: float, share: float = 0.25) -> DataFrame:
    """Is there a large circle that is drawn as a ring? ``circles``: doc_id, rad, fill, stroke,
    stroke_width, has_id; large is ``share`` of the canvas side. The largest ring decides."""
    ring = solid_paint(F.col("fill")).isNull() & solid_paint(F.col("stroke")).isNotNull() & (F.col("stroke_width") > 0)
    d = circles.filter(F.col("rad") >= share * canvas).groupBy("doc_id").agg(F.max(F.when(ring, F.struct("rad", "has_id"))).alias("best"))
    return d.select("doc_id", F.when(F.col("best.has_id"), "passed").otherwise("partial").alias("status"))


def decoration_check(evidence: DataFrame) -> DataFrame:
    """Groups of repeated dots and of parallel lines, in the document: both, one, only reported."""
    real = [F.max((F.col("in_document") & _has(names)).cast("int")) for names in DECORATIONS.values()]
    told = F.max(_has(sum(DECORATIONS.values(), ())).cast("int"))
    d = evidence.groupBy("doc_id").agg((real[0] + real[1]).alias("kinds"), told.alias("told"))
    return d.select("doc_id", F.when(F.col("kinds") == 2, "passed").when(F.col("kinds") == 1, "partial").when(F.col("told") == 1, "failed").otherwise("manual_review").alias("status"))


def operation_checks(docs: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """``doc_id, check, status`` for every document and named check; ``found``: statuses by check."""
    names = F.array(*(F.struct(F.lit(n).alias("check"), F.lit(s).alias("default")) for n, s in CHECKS.items()))
    every = docs.select("doc_id").distinct().select("doc_id", F.explode(names).alias("c")).select("doc_id", "c.*")
    told = reduce(united, [df.select("doc_id", F.lit(n).alias("check"), "status") for n, df in found.items()])
    return every.join(told, ["doc_id", "check"], "left").select("doc_id", "check", F.coalesce("status", "default").alias("status"))


def operation_summary(checks: DataFrame) -> DataFrame:
    """Checks of a document by status."""
    return checks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("passed", "partial", "failed", "manual_review")), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "passed", F.col("check")))), ",").alias("passed_checks"))


def operation_evidence(reports: DataFrame) -> DataFrame:
    """Counts of a separate operation audit inside reports (doc_id, json): numbers, or the length of
    lists; documents without one are ``not_supplied``."""
    at = lambda path: F.get_json_object("json", f"$.designer_operations{path}")
    is_object = lambda c: F.coalesce(F.startswith(F.ltrim(c), F.lit("{")), F.lit(False))
    supplied, nested = is_object(at("")), is_object(at(".summary"))

    def count(name: str) -> Column:
        raw = F.when(nested, at(f".summary.{name}")).otherwise(at(f".{name}"))
        number = raw.try_cast("double").cast("long")
        return F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.json_array_length(raw).cast("long")).when(number >= 0, number)

    rows = reports.select("doc_id", supplied.alias("supplied"), at(".schema").alias("schema"), count("passed").alias("passed"), count("total_operations").alias("total"))
    only = lambda c: F.when(F.col("supplied"), c)
    done = F.when(F.col("total") > 0, F.col("passed") == F.col("total"))
    return rows.select("doc_id", F.when(F.col("supplied"), "reported").otherwise("not_supplied").alias("status"), only(F.col("schema")).alias("schema"), only(F.col("passed")).alias("passed"), only(F.col("total")).alias("total"), only(done).alias("all_passed"))


def _holes(pictures: dict[int, Pixels], band: int) -> dict[str, object]:
    """Runs of visible background (kind 0), and the first and last column that shows something (1)."""
    p = pictures[0]
    grid, shown = Grid(p), p["visible"] == 1
    x = p["x"][shown]
    ends = np.array([[band, x.min(), x.max()]] if len(x) else np.empty((0, 3)), np.int64)
    wide = {"y": ends[:, 0], "x0": ends[:, 1], "x1": ends[:, 2]}
    return _told_apart([(0, runs(grid.mask(p, shown & (p["background"] == 1)) & grid.rows_of(band), grid)), (1, wide)])


def _around(reach: int) -> Callable[..., dict[str, object]]:
    steps = range(-reach, reach + 1)

    def count(pictures: dict[int, Pixels], band: int) -> dict[str, object]:
        """Of each component: the band's own pixels beside it, those of them that are ink, and clear ones near it."""
        found: dict[str, list] = {"comp_id": [], "edge": [], "ink": [], "clear": []}
        p, c = pictures.get(0), pictures.get(1)
        if p is None or c is None:
            return found
        ends = {"y": np.r_[c["y"], c["y"]], "x": np.r_[c["x"], c["x1"]]}
        grid = Grid(p, ends, pad=reach)
        own = grid.rows_of(band)
        there, clear = grid.mask(p) & own, grid.mask(p, p["visible"] == 0) & own
        ink = grid.mask(p, (p["visible"] == 1) & (p["background"] == 0)) & own
        order = np.argsort(c["comp_id"], kind="stable")
        y, x0, x1 = ((c[k][order].astype(np.int64) - at) for k, at in (("y", grid.y), ("x", grid.x), ("x1", grid.x)))
        ids, cuts = np.unique(c["comp_id"][order], return_index=True)
        for comp, a, b in zip(ids, cuts, np.r_[cuts[1:], len(order)]):
            top, left = y[a:b].min() - reach, x0[a:b].min() - reach
            shape = (y[a:b].max() + reach + 1 - top, x1[a:b].max() + reach + 1 - left)
            at = (slice(top, top + shape[0]), slice(left, left + shape[1]))
            hole = filled(shape, y[a:b] - top, x0[a:b] - left, x1[a:b] - left)
            beside, near = (summed(summed(hole.astype(np.int32), [(d, 0) for d in s]), [(0, d) for d in s]) > 0 for s in ((-1, 0, 1), steps))
            beside, near = beside & ~hole, near & ~hole
            for name, n in (("comp_id", comp), ("edge", (beside & there[at]).sum()), ("ink", (beside & ink[at]).sum()), ("clear", (near & clear[at]).sum())):
                found[name].append(int(n))
        return found

    return count


def row_counters(px: DataFrame, height: int, width: int) -> DataFrame:
    """Background trapped in glyphs: tight holes in ink near the open canvas, removed when three or
    more stand in one row of text. ``doc_id, comp_id, area, removed`` for every hole that fits.

    ``px``: doc_id, y, x, visible, background. Rows of text are found in one sorted pass over the
    holes' tops, so no pairs of holes are written out. Pixels are packed once; a hole's surroundings are counted in
    the bands that it lies in, without a row for each.
    """
    reach = max(3, -(-4 * min(height, width) // 1000))
    marks = [F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("visible", "background")]
    pieces = written(packed([px.select(*PIXEL, *marks)], halo=reach))
    found = written(by_band(pieces, _holes, "kind int, y int, x0 int, x1 int"))
    own = written(labelled_runs(found.filter("kind = 0")))
    least = max(64, round(0.0001 * height * width))
    fit = written(component_stats(own).filter((F.col("area") >= least) & (F.least("bw", "bh") >= 3) & (F.col("area") >= 0.30 * F.col("bw") * F.col("bh"))))
    # The holes' runs meet the pixels in their bands; pixels of the hole itself are at distance 0.
    holes = own.join(by_shuffle(fit.select("doc_id", "comp_id")), ["doc_id", "comp_id"]).select("doc_id", "y", F.col("x0").alias("x"), "x1", "comp_id")
    seen = by_band(pieces.transform(united, packed([holes], halo=reach, first=1)), _around(reach), "comp_id int, edge long, ink long, clear long")
    seen = seen.groupBy("doc_id", "comp_id").agg(*(F.sum(c).alias(c) for c in ("edge", "ink", "clear")))
    holes = written(fit.join(by_shuffle(seen.filter((F.col("edge") > 0) & (F.col("ink") >= 0.95 * F.col("edge")) & (F.col("clear") > 0))), ["doc_id", "comp_id"]).select("doc_id", "comp_id", "area", "bx", "by", "bw", "bh"))
    # Two holes share a row when the gap between them is within 0.35 of the taller one, at least 4. In
    # order of their tops a row ends where no earlier hole's allowance reaches the next top and no
    # later hole's allowance reaches back to the last bottom.
    slack = F.greatest(F.lit(4), F.bround(0.35 * F.col("bh")).cast("int"))
    by = Window.partitionBy("doc_id").orderBy("by", "comp_id")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    bottom = F.col("by") + F.col("bh")
    joins = (F.col("by") <= F.max(bottom + slack).over(before)) | (F.min(F.col("by") - slack).over(after) <= F.max(bottom).over(before))
    rows = holes.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("row", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    seen_width = found.filter("kind = 1").groupBy("doc_id").agg((F.max("x1") - F.min("x0") + 1).alias("shown"))
    rule = rows.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n"), (F.max(F.col("bx") + F.col("bw")) - F.min("bx")).alias("span"), F.percentile("bw", F.lit(0.5)).alias("mid")).join(by_shuffle(seen_width), "doc_id")
    wide = F.col("span") >= F.greatest(F.lit(16), F.bround(0.10 * F.col("shown")), F.bround(4 * F.col("mid")))
    rule = rule.select("doc_id", "row", ((F.col("n") >= 3) & wide).alias("removed"))
    return rows.join(by_shuffle(rule), ["doc_id", "row"]).select("doc_id", "comp_id", "area", "removed")

"""Audits of light objects, thin details, closed curves, repairs, gradients and element roles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.operators.bands import BAND, Grid, Pixels, by_band, eroded, filled, packed, runs, summed
from swatchwork.operators.compare import border_stats
from swatchwork.operators.curves import circle_fit, polyline_length
from swatchwork.operators.raster import EIGHT, PIECE, PIXEL, channel_gap, component_pieces, component_runs, component_stats, labelled_runs
from swatchwork.runtime import by_shuffle, per_document, united, written


def _light_gaps(paper: tuple[int, int, int]) -> Callable[..., dict[str, object]]:
    def count(pictures: dict[int, Pixels], band: int) -> dict[str, object]:
        """How often each error occurs in the band's own light core, and whether the band has clear pixels."""
        src, ren = pictures.get(0), pictures.get(1)
        none = {"gap": np.empty(0), "n": np.empty(0), "clear": np.empty(0)}
        if src is None:
            return none
        own = src["y"] // BAND == band
        if not own.any():
            return none
        clear = int((src["a"][own] / 255 < 0.98).any())
        grid = Grid(src, ren)
        light = (src["a"] / 255 >= 0.5) & ((src["r"] + src["g"] + src["b"]) / 3 >= 210) & (np.minimum(np.minimum(src["r"], src["g"]), src["b"]) >= 185)
        core = eroded(grid.mask(src, light), EIGHT) & grid.mask(ren) & grid.rows_of(band)
        share = grid.plane(src, src["a"] / 255)
        gap = reduce(np.fmax, (np.abs(grid.plane(ren, c) - (grid.plane(src, src[c] * src["a"]) / 255 + p * (1 - share))) for c, p in zip("rgb", paper)))
        values, n = np.unique(gap[core], return_counts=True)
        return {"gap": np.r_[values, np.nan], "n": np.r_[n, 0], "clear": np.full(len(n) + 1, clear)}

    return count


def light_fidelity(src: DataFrame, ren: DataFrame, paper: tuple[int, int, int] = (91, 75, 138), least: int = 64, tolerance: float = 48.0) -> DataFrame:
    """Do light objects of a translucent source stay as they are on a coloured canvas? Measured on
    the light mask shrunk by one pixel; null where the source is opaque or the core too small. Both pictures
    meet in packed bands; only counts of equal errors leave them."""
    found = by_band(packed([src.select(*PIXEL, *"rgba"), ren.select(*PIXEL, *"rgb")], halo=1), _light_gaps(paper), "gap double, n long, clear int")
    near = F.when(F.col("gap") <= tolerance, 100.0 * F.col("n")).otherwise(0.0)
    rows = found.groupBy("doc_id", "gap").agg(F.sum("n").alias("n"), F.max("clear").alias("clear")).groupBy("doc_id").agg(
        F.max("clear").alias("clear"), F.sum("n").alias("n"), F.sum(near).alias("cover"), F.sum(F.col("gap") * F.col("n")).alias("mean"), F.percentile("gap", F.lit(0.9), F.col("n")).alias("p90")
    )
    ok = (F.col("clear") == 1) & (F.col("n") >= least)
    mean = lambda c: F.col(c) / F.nullif("n", F.lit(0))
    return rows.select("doc_id", F.col("n").alias("core_pixels"), ok.alias("applicable"), *(F.when(ok, F.round(v, 3)).alias(n) for v, n in ((mean("cover"), "coverage"), (mean("mean"), "mean_error"), (F.col("p90"), "p90_error"))))


def _thin(px: DataFrame, stats: DataFrame, least: int, most: int, core: float) -> tuple[DataFrame, DataFrame]:
    """Pixels of the components that are thin and straight, and these components. Moments come from the sums of
    pieces; only pixels of thin components, ``most`` a component, are gathered."""
    ink = px.join(per_document(written(stats)), "doc_id").withColumn("strength", channel_gap("", "bg_")).filter(F.col("strength") >= core)
    pieces, names = component_pieces(ink.select(*PIXEL, "r", "g", "b", "strength"), ["r", "g", "b", "strength"])
    names = written(names)
    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    ends = [(F.max(f"hi_{c}") - F.min(f"lo_{c}") + 1).alias(n) for c, n in (("x", "w"), ("y", "h"))]
    m = pieces.select(*PIECE, *sums, "lo_x", "hi_x", "lo_y", "hi_y").join(by_shuffle(names), PIECE).groupBy("doc_id", "comp_id").agg(*(F.sum(c).alias(c) for c in sums), *ends)
    spread = lambda a, b, ab: (F.col(ab) * F.col("n") - F.col(a) * F.col(b)) / (F.col("n") * (F.col("n") - 1))
    m = m.filter((F.col("n") >= least) & (F.col("n") <= most) & (F.greatest("w", "h") >= 12)).select("doc_id", "comp_id", F.col("n").alias("area"), "w", "h", spread("sx", "sx", "sxx").alias("vx"), spread("sy", "sy", "syy").alias("vy"), spread("sx", "sy", "sxy").alias("c"))
    half, root = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.col("c") * F.col("c"))
    m = m.withColumn("across", F.sqrt(F.greatest(half - root, F.lit(0.0)))).withColumn("linearity", (half + root) / F.greatest(half - root, F.lit(0.25))).withColumn("fill", F.col("area") / (F.col("w") * F.col("h")))
    m = written(m.filter("across <= 1.5 AND linearity >= 100 AND fill <= 0.28"))
    of = names.join(by_shuffle(m.select("doc_id", "comp_id")), ["doc_id", "comp_id"])
    lists = ("ys", "xs", "rs", "gs", "bs", "strengths")
    p = written(pieces.select(*PIECE, *lists).join(by_shuffle(of), PIECE).groupBy("doc_id", "comp_id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in lists)))
    return p, m


def _core_tone(p: DataFrame, thin: DataFrame) -> DataFrame:
    """Median colour of the strongest 15 percent of each thin component, from its lists of pixels."""

    def quantile(values: Column, share: float) -> Column:
        v, at = F.array_sort(values), (F.size(values) - 1) * F.lit(share)
        low, part = F.floor(at).cast("int"), at - F.floor(at)
        return F.get(v, low) * (1 - part) + F.get(v, F.ceil(at).cast("int")) * part

    rows = p.join(by_shuffle(thin.select("doc_id", "comp_id")), ["doc_id", "comp_id"], "left_semi").withColumn("cut", quantile(F.col("strengths"), 0.85))
    strong = [F.filter(F.arrays_zip(f"{c}s", "strengths"), lambda v: v["strengths"] >= F.col("cut"))[f"{c}s"].alias(c) for c in "rgb"]
    return rows.select("doc_id", "comp_id", *strong).select("doc_id", "comp_id", *(quantile(F.col(c), 0.5).alias(c) for c in "rgb"))


def linear_details(px: DataFrame, stats: DataFrame, least: int = 21, most: int = 800, core: float = 12.0) -> DataFrame:
    """Thin straight components: small spread across, long along, sparse in their box; with the median
    colour of their strongest 15 percent. ``stats``: of ``border_stats``. ``relabelled_lines`` also gives
    them one label."""
    p, thin = _thin(px, stats, least, most, core)
    return thin.join(by_shuffle(_core_tone(p, thin)), ["doc_id", "comp_id"]).select("doc_id", "comp_id", "area", F.round("across", 3).alias("across"), F.round("linearity", 3).alias("linearity"), "r", "g", "b")


def relabelled_lines(px: DataFrame, stats: DataFrame, labels: DataFrame, pal: DataFrame, owned: DataFrame | None = None, least: int = 21, most: int = 800, core: float = 12.0, dominant: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Thin straight components that several palette colours share get one: new ``labels`` (doc_id, y, x, label)
    and a record of each changed component.

    A component counts when its most frequent label holds less than ``dominant`` of it. Its new label is the
    palette colour (doc_id, k, r, g, b) nearest to the median of its strongest pixels, since the others fade
    into the background; of equals the first. Pixels that are transparent, or in ``owned`` (doc_id, y, x), are no
    part of a component; pixels without a label stay without one and don't count.
    """
    seen = px.filter("a > 0") if "a" in px.columns else px
    seen = seen if owned is None else seen.join(owned.select(*PIXEL).distinct(), PIXEL, "left_anti")
    p, thin = _thin(seen, stats, least, most, core)
    own = p.select("doc_id", "comp_id", F.explode(F.arrays_zip("ys", "xs")).alias("p")).select("doc_id", "comp_id", F.col("p.ys").alias("y"), F.col("p.xs").alias("x"))
    own = written(own.join(by_shuffle(labels.select(*PIXEL, "label")), PIXEL))
    share = own.groupBy("doc_id", "comp_id", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "comp_id").agg(F.max("n").alias("n"))
    mixed = thin.join(share, ["doc_id", "comp_id"]).withColumn("share", F.col("n") / F.col("area")).filter(F.col("share") < dominant)
    colors = pal.select("doc_id", "k", *(F.col(c).alias(f"p_{c}") for c in "rgb"))
    gap = sum((F.pow(F.col(f"p_{c}") - F.col(c), 2) for c in "rgb"), F.lit(0.0))
    near = _core_tone(p, mixed).join(colors, "doc_id").groupBy("doc_id", "comp_id").agg(F.min(F.struct(gap.alias("gap"), F.col("k").alias("k"))).alias("best"))
    new = written(own.join(near.select("doc_id", "comp_id", F.col("best.k").alias("paint")), ["doc_id", "comp_id"]).select("doc_id", "comp_id", "y", "x", "label", "paint"))
    moved = new.groupBy("doc_id", "comp_id", "paint").agg(F.count_if(F.col("label") != F.col("paint")).alias("relabelled")).filter("relabelled > 0")
    records = mixed.join(moved, ["doc_id", "comp_id"]).select("doc_id", "comp_id", "area", F.round("across", 3).alias("across"), F.round("linearity", 3).alias("linearity"), F.round("share", 4).alias("old_share"), "paint", "relabelled")
    after = labels.join(new.select(*PIXEL, "paint"), PIXEL, "left").withColumn("label", F.coalesce("paint", "label")).drop("paint")
    return after, records


def closed_primitives(pts: DataFrame, width: float) -> DataFrame:
    """Closed curves that are a circle (residual and length agree), else an axis rectangle (all four
    sides seen); other curves have no row."""
    fit = circle_fit(pts)
    size = polyline_length(pts).select("curve_id", F.col("length"))
    box = pts.groupBy("curve_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    rows = pts.join(box, "curve_id").join(fit, "curve_id").join(size, "curve_id")
    off = F.abs(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) - F.col("radius"))
    side = {s: F.abs(F.col(s[0]) - F.col(s)) for s in ("x0", "x1", "y0", "y1")}
    near = max(2.0, 0.6 * width)
    g = rows.groupBy("curve_id", "n", "cx", "cy", "radius", "length", "x0", "x1", "y0", "y1").agg(F.percentile(off, F.lit(0.9)).alias("off"), F.percentile(F.least(*side.values()), F.lit(0.9)).alias("edge"), *(F.max(F.when(d <= near, 1).otherwise(0)).alias(f"on_{s}") for s, d in side.items()))
    round_ = F.col("length") / (2 * 3.141592653589793 * F.col("radius"))
    circle = (F.col("n") >= 8) & (F.col("radius") >= max(3.0, 1.5 * width)) & round_.between(0.82, 1.18) & (F.col("off") <= max(1.1, 0.12 * width))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rect = (F.col("n") >= 8) & (w >= 2.5 * width) & (h >= 2.5 * width) & (F.expr("on_x0 + on_x1 + on_y0 + on_y1") == 4) & (F.col("length") / (2 * (w + h))).between(0.78, 1.22) & (F.col("edge") <= max(1.1, 0.22 * width))
    return g.select("curve_id", F.when(circle, "circle").when(rect, "rect").alias("kind")).filter("kind IS NOT NULL")


def _moats(moat: int) -> Callable[..., dict[str, object]]:
    steps = range(-moat, moat + 1)

    def count(pictures: dict[int, Pixels], band: int, facts: dict) -> dict[str, object]:
        """Of each component: strong pixels of the source around it, and of the render around and on it, among the
        band's own; and, in rows with a colour, how many of its own pixels have that."""
        rows: list[tuple] = []
        src, ren, c = (pictures.get(k) for k in (0, 1, 2))
        if c is not None and (src is not None or ren is not None):
            grid = Grid(src, ren, {"y": np.r_[c["y"], c["y"]], "x": np.r_[c["x"], c["x1"]]}, pad=moat)
            own, core = grid.rows_of(band), max(facts["threshold"] * 2, facts["threshold"] + 12)
            far = lambda p: None if p is None else reduce(np.fmax, (np.abs(p[k] - facts[f"bg_{k}"]) for k in "rgb")) >= core
            there, strong = grid.mask(src) & own, [grid.mask(p, far(p)) & own for p in (src, ren)]
            tones = np.stack([grid.plane(src, k) for k in "rgb"], axis=-1)
            order = np.argsort(c["src_comp"], kind="stable")
            y, x0, x1 = ((c[k][order].astype(np.int64) - at) for k, at in (("y", grid.y), ("x", grid.x), ("x1", grid.x)))
            ids, cuts = np.unique(c["src_comp"][order], return_index=True)
            for comp, a, b in zip(ids, cuts, np.r_[cuts[1:], len(order)]):
                top, left = y[a:b].min() - moat, x0[a:b].min() - moat
                shape = (y[a:b].max() + moat + 1 - top, x1[a:b].max() + moat + 1 - left)
                at = (slice(top, top + shape[0]), slice(left, left + shape[1]))
                mine = filled(shape, y[a:b] - top, x0[a:b] - left, x1[a:b] - left)
                near = summed(summed(mine.astype(np.int32), [(d, 0) for d in steps]), [(0, d) for d in steps]) > 0
                rows.append((comp, (near & strong[0][at] & ~mine).sum(), (near & strong[1][at]).sum(), None, None, None, None))
                values, n = np.unique(tones[at][mine & there[at]], axis=0, return_counts=True)
                rows.extend((comp, None, None, *v, k) for v, k in zip(values.tolist(), n))
        names = ("src_comp", "src_moat", "ren_moat", "r", "g", "b", "n")
        return {name: [None if r[k] is None else int(r[k]) for r in rows] for k, name in enumerate(names)}

    return count


def repair_candidates(src: DataFrame, ren: DataFrame, topology: DataFrame, height: int, width: int, moat: int = 3, most: int = 4, most_area: int = 4096) -> DataFrame:
    """Source components that the render lacks and that can be put back: wholly missing, not too
    large, with a clear moat in both pictures and one dominant colour. Each row has its first reason
    against, or the fill; a document over the limits is skipped whole. Pixels are packed once; the surroundings of
    missing components are counted in bands."""
    stats = border_stats(src, height, width)
    facts = stats.select("doc_id", "bg_r", "bg_g", "bg_b", "threshold")
    pieces = written(packed([src.select(*PIXEL, *"rgb"), ren.select(*PIXEL, *"rgb")], halo=moat))

    def strong(pictures: dict[int, Pixels], band: int, known: dict) -> dict[str, object]:
        p = pictures.get(0)
        if p is None:
            return {"y": [], "x0": [], "x1": []}
        core = max(known["threshold"] * 2, known["threshold"] + 12)
        grid = Grid(p)
        return runs(grid.mask(p, reduce(np.fmax, (np.abs(p[k] - known[f"bg_{k}"]) for k in "rgb")) >= core) & grid.rows_of(band), grid)

    own = labelled_runs(by_band(pieces, strong, "y int, x0 int, x1 int", facts)).withColumnRenamed("comp_id", "src_comp")
    missing = topology.filter("score <= 5 AND coverage <= 5 AND fragments = 0").select("doc_id", "src_comp", "area")
    mine = own.join(by_shuffle(missing.select("doc_id", "src_comp")), ["doc_id", "src_comp"]).select("doc_id", "y", F.col("x0").alias("x"), "x1", "src_comp")
    kinds = dict(src.dtypes)
    found = written(by_band(pieces.transform(united, packed([mine], halo=moat, first=2)), _moats(moat), f"src_comp int, src_moat long, ren_moat long, r {kinds['r']}, g {kinds['g']}, b {kinds['b']}, n long", facts))
    beside = found.filter("n IS NULL").groupBy("doc_id", "src_comp").agg(F.sum("src_moat").alias("src_moat"), F.sum("ren_moat").alias("ren_moat"))
    tones = found.filter("n IS NOT NULL").groupBy("doc_id", "src_comp", "r", "g", "b").agg(F.sum("n").alias("n")).groupBy("doc_id", "src_comp").agg(F.max(F.struct("n", "r", "g", "b")).alias("m"), F.sum("n").alias("all"))
    rows = missing.join(by_shuffle(beside), ["doc_id", "src_comp"], "left").join(by_shuffle(tones), ["doc_id", "src_comp"])
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    reason = (
        F.when(F.col("area") > most_area, "component_area_limit").when(total > most, "component_count_limit").when(F.col("src_moat") > 0, "source_moat_not_clear").when(F.col("ren_moat") > 0, "render_moat_not_clear").when(F.col("m.n") < 0.9 * F.col("all"), "not_single_colour")
    )
    fill = F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(F.col(f"m.{c}")), 2, "0") for c in "rgb")))
    return rows.withColumn("reason", reason).select("doc_id", "src_comp", "area", "reason", F.when(F.col("reason").isNull(), fill).alias("fill"))


def enclosed_pockets(px: DataFrame, height: int, width: int, least: int = 16) -> DataFrame:
    """Components of background that do not reach the border, of at least ``least`` pixels, with
    whether their box is no longer than four times its width."""
    paper = px.filter("r = 255 AND g = 255 AND b = 255").select(*PIXEL)
    runs = written(component_runs(paper, reach=0))
    edge = runs.groupBy("doc_id", "comp_id").agg(F.max(F.when((F.col("y") == 0) | (F.col("y") == height - 1) | (F.col("x0") == 0) | (F.col("x1") == width - 1), 1).otherwise(0)).alias("edge"))
    inner = component_stats(runs).join(edge.filter("edge = 0"), ["doc_id", "comp_id"]).filter(F.col("area") >= least)
    return inner.select("doc_id", "comp_id", "area", "bw", "bh", (F.greatest("bw", "bh") / F.least("bw", "bh") <= 4).alias("compact"))


def ribbon_width(comps: DataFrame, lengths: DataFrame) -> DataFrame:
    """Area by length of a line component (doc_id, comp_id, area) and its line (.., length)."""
    w = F.col("area") / F.col("length")
    return comps.join(lengths, ["doc_id", "comp_id"]).filter("length > 0").select("doc_id", "comp_id", F.round(w, 4).alias("width"), (F.col("length") >= 2.5 * w).alias("is_ribbon"))


def core_color(samples: DataFrame, share: float = 0.5) -> DataFrame:
    """Median colour of the ``share`` of a curve's samples that is farthest from the background."""
    rank = F.percent_rank().over(Window.partitionBy("curve_id").orderBy(F.desc("strength")))
    return samples.withColumn("rank", rank).filter(F.col("rank") <= share).groupBy("curve_id").agg(F.count(F.lit(1)).alias("samples"), *(F.percentile(c, F.lit(0.5)).alias(c) for c in "rgb"))


def even_ribbons(comps: DataFrame, lengths: DataFrame, widths: DataFrame, uneven: float = 0.35, shortest: float = 10.0, half_width: float = 13.0) -> DataFrame:
    """Line components (doc_id, comp_id, area; .., length; .., half: one row a point of the middle line)
    with their width, its evenness, and the first reason against drawing them as a line, if any."""
    even = widths.groupBy("doc_id", "comp_id").agg((F.stddev_pop("half") / F.avg("half")).alias("cv"))
    w = F.col("area") / F.col("length")
    cv = F.coalesce("cv", F.lit(9.9))
    why = F.when(~F.coalesce(F.col("length") >= shortest, F.lit(False)), "too_short").when((w <= 0.5) | (w > 2.2 * half_width), "width").when(F.col("length") < 2.5 * w, "stubby").when(cv > uneven, "uneven")
    rows = comps.join(lengths, ["doc_id", "comp_id"], "left").join(even, ["doc_id", "comp_id"], "left")
    return rows.select("doc_id", "comp_id", F.round(F.when(F.col("length") > 0, w), 4).alias("width"), F.round(cv, 6).alias("cv"), why.alias("reason"))


def core_opacity(samples: DataFrame) -> DataFrame:
    """Opacity of a curve (curve_id, a): the median of the upper half of its alphas, so that soft edges
    don't count; nearly opaque is opaque, and nothing is below 0.02."""
    place, n = F.row_number().over(Window.partitionBy("curve_id").orderBy("a")) - 1, F.count(F.lit(1)).over(Window.partitionBy("curve_id"))
    upper = samples.filter("a IS NOT NULL").withColumns({"place": place, "n": n}).filter("place >= n div 2")
    o = F.col("o")
    return upper.groupBy("curve_id").agg((F.percentile("a", F.lit(0.5)) / 255).alias("o")).select("curve_id", F.when(o >= 0.985, 1.0).otherwise(F.round(F.greatest(F.lit(0.02), o), 3)).alias("opacity"))


def gradient_inventory(gradients: DataFrame, uses: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per gradient (doc_id, id): references (uses: doc_id, ref), stops along its chain, and whether
    it can be edited alone: unique, used, with two stops."""
    n = gradients.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("copies"))
    r = uses.groupBy("doc_id", F.col("ref").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    rows = n.join(r, ["doc_id", "id"], "left").join(resolved, ["doc_id", "id"], "left")
    return rows.select("doc_id", "id", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("stops", F.lit(0)).alias("stops"), ((F.col("copies") == 1) & (F.coalesce("uses", F.lit(0)) > 0) & (F.coalesce("stops", F.lit(0)) >= 2)).alias("editable"))


def region_of(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """Place on the canvas in words, by thirds."""
    h = F.when(cx / width < 0.34, "left").when(cx / width > 0.66, "right").otherwise("center")
    v = F.when(cy / height < 0.34, "top").when(cy / height > 0.66, "bottom").otherwise("middle")
    return F.when((h == "center") & (v == "middle"), "center").when(h == "center", v).when(v == "middle", h).otherwise(F.concat(v, F.lit("-"), h))


def describe_clusters(manifest: DataFrame, rules: DataFrame, side: float) -> DataFrame:
    """Kind and label of each group (doc_id, group_id, members, box) from the rules of its edges."""
    has = rules.groupBy("doc_id", "group_id").agg(F.collect_set("rule").alias("rules"))
    kind = F.when(F.array_contains("rules", "bounds") | F.array_contains("rules", "overlay"), "layered object").when(F.array_contains("rules", "near"), "cluster").otherwise("object cluster")
    place = region_of((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.lit(side), F.lit(side))
    n = F.size(F.split("members", ","))
    return manifest.join(has, ["doc_id", "group_id"], "left").select("doc_id", "group_id", F.concat(F.initcap(place), F.lit(" "), F.coalesce(kind, F.lit("object cluster")), F.lit(" ("), n.cast("string"), F.lit(" parts)")).alias("label"))


def resolve_sidecar(docs: DataFrame, supplied: DataFrame, embedded: DataFrame, beside: DataFrame) -> DataFrame:
    """The manifest of each document, from the first source that has one, and the source's name."""
    j = docs.select("doc_id")
    for name, df in (("argument", supplied), ("embedded", embedded), ("file", beside)):
        j = j.join(df.select("doc_id", F.col("value").alias(name)), "doc_id", "left")
    source = F.when(F.col("argument").isNotNull(), "argument").when(F.col("embedded").isNotNull(), "embedded").when(F.col("file").isNotNull(), "file").otherwise("not-found")
    return j.select("doc_id", F.coalesce("argument", "embedded", "file").alias("value"), source.alias("source"))


def restore_details(final: DataFrame, details: DataFrame, merged: DataFrame) -> DataFrame:
    """Surviving elements (doc_id, name) with their old record (.., width), and merged rings added."""
    kept = final.join(details, ["doc_id", "name"], "left").select("doc_id", "name", "width", F.col("width").isNotNull().alias("known"))
    return kept.transform(united, merged.select("doc_id", "name", "width", F.lit(True).alias("known")))


def manifest_violations(roles: DataFrame) -> DataFrame:
    """Broken rules of role tables (doc_id, role, kind, paint, member_count): one row a rule."""
    by = lambda *c: F.count(F.lit(1)).over(Window.partitionBy("doc_id", *c))
    rows = roles.withColumn("same_paint", by("paint")).withColumn("in_role", by("role"))
    rules = {
        "bad_kind": ~F.coalesce(F.col("kind").isin("neutral", "chromatic"), F.lit(False)), "bad_hex": ~F.coalesce(F.col("paint").rlike("^#[0-9a-f]{6}$"), F.lit(False)),
        "duplicate_colour": F.col("same_paint") > 1, "count_mismatch": F.col("member_count") != F.col("in_role"),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda v: v.isNotNull())
    return rows.select("doc_id", "role", "paint", F.explode(broken).alias("rule"))


def classify_nodes(el: DataFrame, canvas: float) -> DataFrame:
    """Area share, scaffold flag (nearly the whole canvas), role and orientation of elements."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    share = w * h / canvas
    role = F.when(F.col("tag").isin("line", "polyline"), "stroke").when(F.col("tag") == "circle", "dot").otherwise("fragment")
    way = F.when(w >= 1.5 * h, "horizontal").when(h >= 1.5 * w, "vertical").otherwise("square")
    return el.select("doc_id", "idx", F.round(share, 6).alias("area_share"), (share >= 0.85).alias("scaffold"), role.alias("role"), way.alias("orientation"))

"""Source against render: ink regions, neighbourhood matches, detail grid, component continuity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.operators.bands import Grid, Pixels, by_band, packed, summed
from swatchwork.operators.raster import EIGHT, PIXEL, channel_gap, component_runs, composite_over, neighbour_count
from swatchwork.runtime import by_shuffle, per_document, written


def _rounded(value: Column, digits: int = 3) -> Column:
    """Rounded half up; what lies within 1e-9 below a half counts as the half, so that the order of
    a sum does not decide."""
    return F.round(value + 1e-9, digits)


def structural_threshold(threshold: Column) -> Column:
    """The ink threshold of structure: twice the plain one, at least 12 more; null for a null or negative
    one, which is no threshold, so that its document has no structure instead of a wrong one."""
    return F.when(threshold >= 0, F.greatest(threshold * 2, threshold + 12))


def border_stats(px: DataFrame, height: int, width: int) -> DataFrame:
    """Per document: median border colour, 95th percentile of border noise, ink threshold.

    The border pixels and the result are written once, for all their uses; a written border looks small to
    Spark, so its colours meet it by shuffle.
    """
    border = written(px.filter(f"y IN (0, {height - 1}) OR x IN (0, {width - 1})").select(*PIXEL, "r", "g", "b"))
    paper = border.groupBy("doc_id").agg(*(F.percentile(c, F.lit(0.5)).alias(f"bg_{c}") for c in "rgb"))
    noise = border.join(by_shuffle(paper), "doc_id").groupBy("doc_id").agg(F.percentile(channel_gap("", "bg_"), F.lit(0.95)).alias("noise_p95"))
    return written(paper.join(by_shuffle(noise), "doc_id").withColumn("threshold", F.greatest(F.lit(6.0), F.least(F.lit(24.0), F.col("noise_p95") + 3))))


def ink_mask(px: DataFrame, stats: DataFrame) -> DataFrame:
    """Source ink: strong enough, and either supported by a neighbour or strongly isolated. The strong
    pixels are written once."""
    strength = channel_gap("", "bg_")
    raw = written(px.join(per_document(stats), "doc_id").withColumn("strength", strength).filter("strength >= threshold").select(*PIXEL, "r", "g", "b", "strength", "threshold"))
    support = neighbour_count(raw).withColumnRenamed("n", "support")
    lone = F.col("strength") >= F.greatest(F.col("threshold") * 1.75, F.col("threshold") + 12)
    return raw.join(by_shuffle(support), PIXEL).filter((F.col("support") >= 2) | lone).select(*PIXEL, "r", "g", "b", "strength", "threshold")


def ink_roi(px: DataFrame, height: int, width: int) -> DataFrame:
    """Background, noise, threshold, ink pixels and ink share of every document."""
    px = composite_over(px)
    stats = border_stats(px, height, width)
    ink = ink_mask(px, stats).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return stats.join(ink, "doc_id", "left").select("doc_id", "bg_r", "bg_g", "bg_b", "noise_p95", "threshold", n.alias("ink_pixels"), F.round(n / (height * width), 6).alias("ink_share"))


def best_match(ink: DataFrame, other: DataFrame) -> DataFrame:
    """For each ink pixel the least colour error among ink of ``other`` within one pixel, 256 where
    there is none. Only the ink rows are spread over the nine offsets."""
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in EIGHT))
    moved = other.select("doc_id", F.explode(steps).alias("o"), "y", "x", *(F.col(c).alias(f"o_{c}") for c in "rgb")).select("doc_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "o_r", "o_g", "o_b")
    found = ink.join(by_shuffle(moved), PIXEL, "left")
    error = F.min(channel_gap("", "o_"))
    return found.groupBy(*PIXEL).agg(F.coalesce(error, F.lit(256)).cast("double").alias("error"))


def _credit(error: Column) -> tuple[Column, Column]:
    return F.when(error < 256, 1.0).otherwise(0.0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - error / 128))


def detail_cells(src: DataFrame, ren: DataFrame, height: int, width: int, cell: int = 48) -> DataFrame:
    """Per ink cell: ink pixels, score (0.65 coverage + 0.35 colour), coverage, colour, severity.
    Blank cells have no row."""
    src, ren = composite_over(src), composite_over(ren)
    stats = border_stats(src, height, width)
    ren_ink = ren.join(per_document(stats), "doc_id").filter(channel_gap("", "bg_") >= F.col("threshold")).select(*PIXEL, "r", "g", "b")
    match = best_match(ink_mask(src, stats), ren_ink)
    cover, colour = _credit(F.col("error"))
    at = lambda c: F.floor(F.col(c) / cell).cast("int") * cell
    per = match.withColumn("cover", cover).withColumn("colour", colour).groupBy("doc_id", at("y").alias("cell_y"), at("x").alias("cell_x"))
    rows = per.agg(F.count(F.lit(1)).alias("ink_pixels"), F.avg("cover").alias("c"), F.avg("colour").alias("k"))
    score = 100 * (0.65 * F.col("c") + 0.35 * F.col("k"))
    return rows.select(
        "doc_id", "cell_y", "cell_x", "ink_pixels", _rounded(score).alias("score"), _rounded(100 * F.col("c")).alias("coverage"), _rounded(100 * F.col("k")).alias("colour"),
        _rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - score / 100))).alias("severity"),
    )


def detail_grid(cells: DataFrame) -> DataFrame:
    """p10, median, worst and mean cell score of each document."""
    return cells.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("cells"), _rounded(F.percentile("score", F.lit(0.1))).alias("p10"), _rounded(F.percentile("score", F.lit(0.5))).alias("median"),
        F.min("score").alias("worst"), _rounded(F.avg("score")).alias("mean"),
    )


def hotspots(cells: DataFrame, below: float = 78.0, most: int = 40) -> DataFrame:
    """Worst cells of each document, at most ``most`` (a report's limit)."""
    by = Window.partitionBy("doc_id").orderBy(F.desc("severity"), F.desc("ink_pixels"), "cell_y", "cell_x")
    return cells.filter(F.col("score") < below).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most).select("doc_id", "place", "cell_y", "cell_x", "severity", "ink_pixels")


def canvas_match(src: DataFrame, ren: DataFrame) -> DataFrame:
    """Mean similarity over the whole canvas, in percent."""
    both = src.join(by_shuffle(ren.select(*PIXEL, *(F.col(c).alias(f"o_{c}") for c in "rgb"))), PIXEL)
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pixels"), F.round(100 * F.avg(F.greatest(F.lit(0.0), 1 - channel_gap("", "o_") / 128)), 6).alias("match"))


def foreground_match(src: DataFrame, ren: DataFrame, height: int, width: int) -> DataFrame:
    """Recall, precision, F1, colour fidelity and score of the ink; null score without source ink.
    Corner pixels count twice in the border here, as rows and as columns."""
    src, ren = composite_over(src), composite_over(ren)
    twice = F.explode(F.array_repeat(F.lit(1), F.when(F.col("y").isin(0, height - 1) & F.col("x").isin(0, width - 1), 2).otherwise(1)))
    border = written(src.filter(f"y IN (0, {height - 1}) OR x IN (0, {width - 1})").select(*PIXEL, "r", "g", "b")).withColumn("one", twice)
    paper = border.groupBy("doc_id").agg(*(F.percentile(c, F.lit(0.5)).alias(f"bg_{c}") for c in "rgb"))
    noise = border.join(by_shuffle(paper), "doc_id").groupBy("doc_id").agg(F.percentile(channel_gap("", "bg_"), F.lit(0.95)).alias("p95"))
    stats = written(paper.join(by_shuffle(noise), "doc_id").withColumn("threshold", F.greatest(F.lit(6.0), F.least(F.lit(24.0), F.col("p95") + 3))))
    small = per_document(stats)
    ink = lambda px: px.join(small, "doc_id").filter(channel_gap("", "bg_") >= F.col("threshold")).select(*PIXEL, "r", "g", "b")
    a, b = written(ink(src)), written(ink(ren))

    def side(match: DataFrame, name: str) -> DataFrame:
        cover, colour = _credit(F.col("error"))
        return match.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"{name}_ink"), F.avg(cover).alias(f"{name}_cover"), F.avg(colour).alias(f"{name}_sim"), F.avg(F.when(F.col("error") < 256, colour)).alias(f"{name}_near"))

    both = stats.select("doc_id").join(side(best_match(a, b), "src"), "doc_id", "left").join(side(best_match(b, a), "ren"), "doc_id", "left")
    recall, precision = F.col("src_cover"), F.coalesce("ren_cover", F.lit(0.0))
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    near = F.filter(F.array("src_near", "ren_near"), lambda v: v.isNotNull())
    fidelity = F.when(F.size(near) > 0, F.aggregate(near, F.lit(0.0), lambda s, v: s + v) / F.size(near)).otherwise(0.0)
    has = F.col("src_ink") > 0
    out = {"recall": recall * 100, "precision": precision * 100, "coverage_f1": f1 * 100, "color_fidelity": fidelity * 100, "score": 100 * (0.65 * f1 + 0.35 * F.col("src_sim"))}
    return both.select("doc_id", F.coalesce("src_ink", F.lit(0)).alias("src_ink"), F.coalesce("ren_ink", F.lit(0)).alias("ren_ink"), *(F.round(F.when(has, c), 6).alias(n) for n, c in out.items()))


def component_topology(src: DataFrame, ren: DataFrame, height: int, width: int, least: int = 16) -> DataFrame:
    """Continuity of every source component of at least ``least`` pixels in the render: coverage,
    share of its largest fragment, number of relevant fragments, score."""
    src, ren = composite_over(src), composite_over(ren)
    stats = border_stats(src, height, width)
    core = structural_threshold(F.col("threshold"))
    small = per_document(stats)
    strong = lambda px: px.join(small, "doc_id").filter(channel_gap("", "bg_") >= core).select(*PIXEL)
    inside = f"y BETWEEN 0 AND {height - 1} AND x BETWEEN 0 AND {width - 1}"
    grown = neighbour_count(strong(ren)).filter(inside).select(*PIXEL)
    own = written(component_runs(written(strong(src))).withColumnRenamed("comp_id", "src_comp"))
    other = component_runs(written(grown)).select("doc_id", F.col("comp_id").alias("ren_comp"), "y", F.col("x0").alias("o0"), F.col("x1").alias("o1"))
    met = own.join(by_shuffle(other), ["doc_id", "y"]).filter("x0 <= o1 AND o0 <= x1")  # runs of one row, no pixels
    overlap = met.groupBy("doc_id", "src_comp", "ren_comp").agg(F.sum(F.least("x1", "o1") - F.greatest("x0", "o0") + 1).alias("n"))
    areas = own.groupBy("doc_id", "src_comp").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).filter(F.col("area") >= least)
    hit = F.coalesce("n", F.lit(0))
    found = areas.join(overlap, ["doc_id", "src_comp"], "left").groupBy("doc_id", "src_comp").agg(
        F.max("area").alias("area"), F.sum(hit).alias("covered"), F.max(hit).alias("largest"), F.count_if((hit >= 3) & (hit >= 0.05 * F.col("area"))).alias("fragments")
    )
    coverage, whole = 100 * F.col("covered") / F.col("area"), F.when(F.col("covered") > 0, 100 * F.col("largest") / F.col("covered")).otherwise(0.0)
    return found.select("doc_id", "src_comp", "area", F.round(coverage, 3).alias("coverage"), F.round(whole, 3).alias("connectivity"), "fragments", F.round(coverage * whole / 100, 3).alias("score"))


def topology_summary(components: DataFrame) -> DataFrame:
    return components.groupBy("doc_id").agg(F.count(F.lit(1)).alias("components"), F.round(F.percentile("score", F.lit(0.1)), 3).alias("p10"), F.min("score").alias("worst"), F.round(F.avg("score"), 3).alias("mean"))


def worst_components(components: DataFrame, most: int = 20) -> DataFrame:
    """Worst components of each document, with the total beside them (a report's limit)."""
    by = Window.partitionBy("doc_id").orderBy("score", F.desc("area"), "src_comp")
    return components.filter("score < 100").withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most).select("doc_id", "place", "src_comp", "score", "area", "total")


def pair_gate(src: DataFrame, ren: DataFrame, tolerance: int = 0) -> DataFrame:
    """Share of pixels that differ by more than ``tolerance``; accepted below one percent."""
    both = src.join(by_shuffle(ren.select(*PIXEL, *(F.col(c).alias(f"o_{c}") for c in "rgb"))), PIXEL)
    changed = F.avg(F.when(channel_gap("", "o_") > tolerance, 1.0).otherwise(0.0))
    return both.groupBy("doc_id").agg(F.round(changed, 6).alias("changed"), (changed <= 0.01).alias("accepted"))


def _gate_sums(reach: int, ink: float) -> Callable[..., dict[str, object]]:
    square = [(d, 0) for d in range(-reach, reach + 1)], [(0, d) for d in range(-reach, reach + 1)]

    def count(pictures: dict[int, Pixels], band: int, facts: dict) -> dict[str, object]:
        """Of the band's own pixels: all, ink of each picture, that near ink of the other, ink of either with its
        similarity, and changed ones."""
        grid = Grid(*pictures.values())
        there, own = grid.mask(pictures.get(0)) & grid.mask(pictures.get(1)), grid.rows_of(band)
        was, now = ({c: grid.plane(pictures.get(side), c) for c in "rgb"} for side in (0, 1))
        gap = lambda v, w: reduce(np.fmax, (np.abs(v[c] - w[c]) for c in "rgb"))
        paper, error = {c: facts[f"bg_{c}"] for c in "rgb"}, gap(was, now)
        inked = [there & (gap(v, paper) >= ink) for v in (was, now)]
        grown = [summed(summed(m.astype(np.int32), square[0]), square[1]) > 0 for m in inked]
        either, alike = (inked[0] | inked[1]) & own, np.fmax(0.0, np.fmin(1.0, 1 - error / 128))
        found = {"n": there & own, "was": inked[0] & own, "was_hit": inked[0] & grown[1] & own, "now": inked[1] & own, "now_hit": inked[1] & grown[0] & own, "ink": either, "moved": there & own & (error >= 2)}
        return {**{k: [int(m.sum())] for k, m in found.items()}, "alike": [float(alike[either].sum())]}

    return count


def render_gate(before: DataFrame, after: DataFrame, height: int, width: int, reach: int = 1, ink: float = 6.0) -> DataFrame:
    """Two renders of one document: recall and precision of the ink within ``reach`` pixels, F1, colour
    similarity where either has ink, score, share of changed pixels; accepted from 99 percent on.

    The paper is the median border colour of ``before``, corners counted for both of their edges. A
    picture without ink has recall and similarity one. Both pictures are packed and meet in bands; only
    counts leave them.
    """
    a, b = composite_over(before), composite_over(after)
    edges = F.when(F.col("y").isin(0, height - 1), 1).otherwise(0) + F.when(F.col("x").isin(0, width - 1), 1).otherwise(0)
    paper = a.withColumn("times", edges).filter("times > 0").groupBy("doc_id").agg(*(F.percentile(c, F.lit(0.5), F.col("times")).alias(f"bg_{c}") for c in "rgb"))
    sums = ("n", "was", "was_hit", "now", "now_hit", "ink", "moved", "alike")
    found = by_band(packed([a, b], halo=reach), _gate_sums(reach, ink), ", ".join(f"{c} {'double' if c == 'alike' else 'long'}" for c in sums), paper)
    share = lambda part, all_: F.coalesce(F.when(F.col(all_) > 0, F.col(part) / F.col(all_)), F.lit(1.0))
    rows = found.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in sums)).filter("n > 0").select(
        "doc_id", share("was_hit", "was").alias("recall"), share("now_hit", "now").alias("precision"), share("alike", "ink").alias("similarity"), share("moved", "n").alias("changed")
    )
    recall, precision = F.col("recall"), F.col("precision")
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    score = 100 * (0.65 * f1 + 0.35 * F.col("similarity"))
    shown = {"score": score, "ink_recall": recall * 100, "ink_precision": precision * 100, "ink_f1": f1 * 100, "color_similarity": F.col("similarity") * 100, "changed": F.col("changed")}
    passed = (score >= 99) & (recall >= 0.99) & (precision >= 0.99)
    return rows.select("doc_id", *(F.round(c, 6).alias(n) for n, c in shown.items()), passed.alias("accepted"))


def changes_outside(before: DataFrame, after: DataFrame, boxes: DataFrame, pad: int = 2) -> DataFrame:
    """Changed pixels of each document, and those outside all its padded boxes."""
    both = before.join(by_shuffle(after.select(*PIXEL, *(F.col(c).alias(f"o_{c}") for c in "rgb"))), PIXEL)
    changed = both.filter(channel_gap("", "o_") > 0).select(*PIXEL)
    box = boxes.select("doc_id", *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    within = (F.col("x") >= F.col("b_x0") - pad) & (F.col("x") <= F.col("b_x1") + pad) & (F.col("y") >= F.col("b_y0") - pad) & (F.col("y") <= F.col("b_y1") + pad)
    out = changed.join(by_shuffle(box), (changed["doc_id"] == box["doc_id"]) & within, "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("outside"))
    return changed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("changed")).join(out, "doc_id", "left").select("doc_id", "changed", F.coalesce("outside", F.lit(0)).alias("outside"))

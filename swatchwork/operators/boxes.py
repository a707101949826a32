"""Bounding-box graphs: grid-bucketed spatial joins, scored edges, groups and paint order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.functions.svg import box_gap, box_iou
from swatchwork.operators.graph import connected_components
from swatchwork.runtime import by_shuffle, united

BOX = ("x0", "y0", "x1", "y1")


def near_pairs(el: DataFrame, reach: float, cell: float = 16.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of elements of a document whose boxes are at most ``reach`` apart in x and in y.

    Boxes grown by half the reach are spread over grid cells; a pair is taken only in the first cell
    that both share, so no pair comes twice and none is made by a nested loop. Columns in ``carry`` come
    along for both (``o_`` for the second), so that pairs need no further joins with the elements.
    """
    half = reach / 2
    cells = lambda lo, hi: F.sequence(F.floor((F.col(lo) - half) / cell).cast("int"), F.floor((F.col(hi) + half) / cell).cast("int"))
    spread = el.select("doc_id", "idx", *BOX, *carry).withColumn("gx", F.explode(cells("x0", "x1"))).withColumn("gy", F.explode(cells("y0", "y1")))
    o = spread.select("doc_id", "gx", "gy", F.col("idx").alias("o_idx"), *(F.col(c).alias(f"o_{c}") for c in (*BOX, *carry)))
    first = lambda c: F.floor((F.greatest(c, f"o_{c}") - half) / cell).cast("int")
    close = (F.col("x0") - half <= F.col("o_x1") + half) & (F.col("o_x0") - half <= F.col("x1") + half) & (F.col("y0") - half <= F.col("o_y1") + half) & (F.col("o_y0") - half <= F.col("y1") + half)
    return spread.join(by_shuffle(o), ["doc_id", "gx", "gy"]).filter(F.col("idx") < F.col("o_idx")).filter(close & (F.col("gx") == first("x0")) & (F.col("gy") == first("y0"))).drop("gx", "gy")


def bbox_edges(el: DataFrame, reach: float = 12.0) -> DataFrame:
    """Scored relations of near elements: matching bounds, overlay, overlap, proximity."""
    gap, iou = F.col("gap"), F.col("iou")
    inside = (F.col("x0") >= F.col("o_x0")) & (F.col("y0") >= F.col("o_y0")) & (F.col("x1") <= F.col("o_x1")) & (F.col("y1") <= F.col("o_y1"))
    around = (F.col("x0") <= F.col("o_x0")) & (F.col("y0") <= F.col("o_y0")) & (F.col("x1") >= F.col("o_x1")) & (F.col("y1") >= F.col("o_y1"))
    rule = F.when(iou >= 0.9, "bounds").when(inside | around, "overlay").when(gap == 0, "overlap").when(gap <= reach, "near")
    score = F.when(iou >= 0.9, 0.95).when(inside | around, 0.85).when(gap == 0, 0.7 + 0.2 * iou).otherwise(0.6 * (1 - gap / (reach + 1)))
    pairs = near_pairs(el, reach).withColumn("gap", box_gap("", "o_")).withColumn("iou", box_iou("", "o_"))
    return pairs.withColumn("rule", rule).filter("rule IS NOT NULL").select("doc_id", F.col("idx").alias("a"), F.col("o_idx").alias("b"), "rule", F.round(score, 6).alias("score"))


def overlap_families(el: DataFrame) -> DataFrame:
    """Elements with the smallest element of their family of overlapping boxes."""
    node = lambda c: F.struct(F.col("doc_id"), F.col(c).alias("idx"))
    pairs = near_pairs(el, 0.0).filter(box_gap("", "o_") == 0).select(node("idx").alias("src"), node("o_idx").alias("dst"))
    found = connected_components(pairs)
    rows = el.select("doc_id", "idx", node("idx").alias("node"))
    return rows.join(found, "node", "left").select("doc_id", "idx", F.coalesce(F.col("component.idx"), F.col("idx")).cast("int").alias("family"))


def order_inversions(el: DataFrame, placed: DataFrame) -> DataFrame:
    """Overlapping pairs of a document whose relative order differs in ``placed`` (doc_id, idx, pos)."""
    pos = lambda n, p: placed.select("doc_id", F.col("idx").alias(n), F.col("pos").alias(p))
    pairs = near_pairs(el, 0.0).filter(box_gap("", "o_") == 0).select("doc_id", "idx", "o_idx")
    both = pairs.join(pos("idx", "p"), ["doc_id", "idx"]).join(pos("o_idx", "o_p"), ["doc_id", "o_idx"])
    return both.filter("p > o_p").select("doc_id", F.col("idx").alias("a"), F.col("o_idx").alias("b"))


def order_conflicts(el: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group (doc_id, idx, group_id) and possible anchor (a member): outsiders that overlap a
    member and lie between it and the anchor. The anchor of least conflicts, then least movement.

    Overlaps come from the grid; an outsider above its member is in the way of all later anchors, one
    below it of all earlier ones, so conflicts and movement are running sums over a group's places.
    """
    pair = near_pairs(el, 0.0).filter(box_gap("", "o_") == 0).select("doc_id", F.explode(F.array(F.struct("idx", "o_idx"), F.struct(F.col("o_idx").alias("idx"), F.col("idx").alias("o_idx")))).alias("p")).select("doc_id", "p.*")
    theirs = groups.select("doc_id", F.col("idx").alias("o_idx"), F.col("group_id").alias("o_group"))
    out = pair.join(by_shuffle(groups), ["doc_id", "idx"]).join(by_shuffle(theirs), ["doc_id", "o_idx"], "left").filter("NOT (o_group <=> group_id)")
    met = out.select("doc_id", "group_id", F.col("o_idx").alias("at"), F.lit(0).alias("member"), (F.col("idx") < F.col("o_idx")).cast("int").alias("rise"), (F.col("idx") > F.col("o_idx")).cast("int").alias("fall"))
    own = groups.join(by_shuffle(el.select("doc_id", "idx")), ["doc_id", "idx"], "left_semi").select("doc_id", "group_id", F.col("idx").alias("at"), F.lit(1).alias("member"), F.lit(0).alias("rise"), F.lit(0).alias("fall"))
    places = own.transform(united, met).groupBy("doc_id", "group_id", "at").agg(*(F.sum(c).alias(c) for c in ("member", "rise", "fall")))
    by = Window.partitionBy("doc_id", "group_id").orderBy("at")
    before, after = by.rangeBetween(Window.unboundedPreceding, -1), by.rangeBetween(1, Window.unboundedFollowing)
    run = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    spot = F.col("member") * F.col("at")
    moved = F.col("at") * (run(F.col("member"), before) - run(F.col("member"), after)) - run(spot, before) + run(spot, after)
    every = places.withColumn("conflicts", run(F.col("rise"), before) + run(F.col("fall"), after)).withColumn("moved", moved).filter("member > 0")
    best = F.min(F.struct("conflicts", "moved", F.col("at").alias("anchor")))
    return every.groupBy("doc_id", "group_id").agg(best.alias("m")).select("doc_id", "group_id", "m.anchor", "m.conflicts", "m.moved")


def place_groups(el: DataFrame, groups: DataFrame, anchors: DataFrame) -> DataFrame:
    """New paint order: the members of a group stand at its anchor, in their old order."""
    at = groups.join(anchors.select("doc_id", "group_id", "anchor"), ["doc_id", "group_id"]).select("doc_id", "idx", "anchor")
    rows = el.select("doc_id", "idx").join(at, ["doc_id", "idx"], "left")
    by = Window.partitionBy("doc_id").orderBy(F.coalesce("anchor", "idx"), "idx")
    return rows.select("doc_id", "idx", (F.row_number().over(by) - 1).alias("pos"))


def object_groups(edges: DataFrame, el: DataFrame, most: int = 96, least_score: float = 0.7) -> DataFrame:
    """Groups by accepting edges, best first, while a group stays within ``most`` members.

    The order of acceptance matters, so one document's edges are folded together; edges are made
    by the distributed join, and a document has no more than its elements allow.
    """
    strong = edges.filter(F.col("score") >= least_score).select("doc_id", "a", "b", "score")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        group: dict[int, list[int]] = {}
        for a, b in rows.sort_values(["score", "a", "b"], ascending=[False, True, True])[["a", "b"]].itertuples(index=False):
            x, y = group.setdefault(a, [a]), group.setdefault(b, [b])
            if x is not y and len(x) + len(y) <= most:
                x.extend(y)
                for i in y:
                    group[i] = x
        out = [(int(rows["doc_id"].iloc[0]), int(i), int(min(g))) for i, g in sorted(group.items()) if len(g) > 1]
        return pd.DataFrame(out, columns=["doc_id", "idx", "group_id"])

    return strong.groupBy("doc_id").applyInPandas(fold, "doc_id long, idx int, group_id int")


def group_manifest(groups: DataFrame, el: DataFrame) -> DataFrame:
    """Members, paints, layers and box of each group."""
    return groups.join(el, ["doc_id", "idx"]).groupBy("doc_id", "group_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("idx")), lambda i: i.cast("string")), ",").alias("members"), F.array_join(F.array_sort(F.collect_set("stroke")), ",").alias("strokes"),
        F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, marked by side."""
    return a.exceptAll(b).withColumn("side", F.lit("before")).transform(united, b.exceptAll(a).withColumn("side", F.lit("after")))


def partition_violations(rows: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are in no family or in several."""
    n = members.groupBy(*key).agg(F.count(F.lit(1)).alias("families"))
    return rows.select(*key).distinct().join(n, key, "left").withColumn("families", F.coalesce("families", F.lit(0))).filter("families <> 1")

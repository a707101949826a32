"""From scanned vector elements to object candidates: boxes, scene nodes, scored edges and groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.functions.svg import NUMBER, box_area, box_gap, is_stable_self_rotation
from swatchwork.operators.boxes import BOX, near_pairs
from swatchwork.operators.checks import canvas_of
from swatchwork.operators.documents import path_steps
from swatchwork.runtime import by_shuffle, united

# Tags that draw, and attributes that a scene can't keep when it is regrouped.
DRAWABLE = ("path", "circle", "ellipse", "rect", "line", "polyline", "polygon")
UNSAFE_GROUP = ("transform", "style", "class", "clip-path", "mask", "filter", "mix-blend-mode", "isolation", "opacity")
UNSAFE_DRAWABLE = ("transform", "style", "class", "mask", "filter", "marker-start", "marker-mid", "marker-end", "mix-blend-mode", "isolation")
NO_PAINT = ("", "none", "transparent")
#: Farthest gap over which two elements may be related.
REACH = 34.0


def path_boxes(paths: DataFrame) -> DataFrame:
    """Box of every path text (doc_id, idx, d) around its end and control points. Arcs count with
    twice their larger radius about both ends, so a box may be too large. In a chain of T, each
    control point is that of the Q before the chain, mirrored. Texts that break the grammar have no row.
    """
    path = Window.partitionBy("doc_id", "idx").orderBy("seq")
    n = lambda k: F.get("n", F.lit(k))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    before = [F.coalesce(F.lag(c).over(path), F.lit(0.0)).alias(f"p{c}") for c in "xy"]
    s = path_steps(paths).filter("is_valid").select("*", *before, F.lag("cmd").over(path).alias("last"))
    s = s.withColumn("bx", F.when(F.col("rel"), F.col("px")).otherwise(0.0)).withColumn("by", F.when(F.col("rel"), F.col("py")).otherwise(0.0))
    given = lambda k: point(F.col("bx") + n(k), F.col("by") + n(k + 1))
    cmd, last = F.col("cmd"), F.col("last")
    s = s.withColumn("cubic", F.when(cmd == "C", given(2)).when(cmd == "S", given(0))).withColumn("quad", F.when(cmd == "Q", given(0)))
    s = s.withColumn("chain", F.sum(F.when(cmd.isin("Q", "T"), 0).otherwise(1)).over(path))
    so_far = Window.partitionBy("doc_id", "idx", "chain").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("old_cubic", F.lag("cubic").over(path)).withColumn("old_quad", F.last("quad", ignorenulls=True).over(so_far))
    mirrored = lambda c: point(2 * F.col("px") - F.col(c)["x"], 2 * F.col("py") - F.col(c)["y"])
    rx, ry, turn = F.abs(n(0)), F.abs(n(1)), F.radians(F.pmod(n(2), F.lit(360.0)))
    dx, dy = (F.col("px") - F.col("x")) / 2, (F.col("py") - F.col("y")) / 2
    tx, ty = F.cos(turn) * dx + F.sin(turn) * dy, F.cos(turn) * dy - F.sin(turn) * dx
    grown = F.when((rx > 0) & (ry > 0), F.sqrt(F.greatest(F.lit(1.0), tx * tx / (rx * rx) + ty * ty / (ry * ry)))).otherwise(1.0)
    reach = F.when(cmd == "A", 2 * F.greatest(rx, ry) * grown).otherwise(0.0)
    points = F.array(
        point(F.col("x") - reach, F.col("y") - reach), point(F.col("x") + reach, F.col("y") + reach),
        F.when(cmd == "A", point(F.col("px") - reach, F.col("py") - reach)), F.when(cmd == "A", point(F.col("px") + reach, F.col("py") + reach)),
        F.when(cmd == "C", given(0)), F.col("cubic"), F.col("quad"),
        F.when((cmd == "S") & last.isin("C", "S"), mirrored("old_cubic")), F.when((cmd == "T") & last.isin("Q", "T"), mirrored("old_quad")),
    )
    s = s.select("doc_id", "idx", points.alias("points")).select("doc_id", "idx", F.col("points.x").alias("xs"), F.col("points.y").alias("ys"))
    return s.groupBy("doc_id", "idx").agg(F.min(F.array_min("xs")).alias("x0"), F.min(F.array_min("ys")).alias("y0"), F.max(F.array_max("xs")).alias("x1"), F.max(F.array_max("ys")).alias("y1"))


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda v: v.cast("double"))


def element_boxes(el: DataFrame) -> DataFrame:
    """Drawable elements (doc_id, idx, tag, attrs) with their box, grown by half the stroke, times the
    miter limit where joins are mitred. The box is null where an attribute is no number, a path breaks
    the grammar, or a list of points has none. Other tags and elements below ``defs`` are left out."""
    attr = lambda name: F.try_element_at("attrs", F.lit(name))
    num = lambda name, default="0": F.coalesce(attr(name), F.lit(default)).try_cast("double")
    drawn = el.filter(F.col("tag").isin(*DRAWABLE) & ~F.coalesce("in_defs", F.lit(False))) if "in_defs" in el.columns else el.filter(F.col("tag").isin(*DRAWABLE))
    drawn = drawn.select("doc_id", "idx", "tag", "attrs")
    paths = path_boxes(drawn.filter("tag = 'path'").select("doc_id", "idx", F.coalesce(attr("d"), F.lit("")).alias("d")))
    rows = drawn.join(paths.select("doc_id", "idx", F.struct(*BOX).alias("path")), ["doc_id", "idx"], "left")
    box = lambda *v: F.struct(*(c.alias(k) for k, c in zip(BOX, v)))
    round_box = lambda rx, ry: box(num("cx") - F.abs(rx), num("cy") - F.abs(ry), num("cx") + F.abs(rx), num("cy") + F.abs(ry))
    xs, ys = F.filter("numbers", lambda v, i: i % 2 == 0), F.filter("numbers", lambda v, i: i % 2 == 1)
    tag = F.col("tag")
    plain = (
        F.when(tag == "path", F.col("path"))
        .when(tag == "circle", round_box(num("r"), num("r"))).when(tag == "ellipse", round_box(num("rx"), num("ry")))
        .when(tag == "rect", box(num("x"), num("y"), num("x") + num("width"), num("y") + num("height")))
        .when(tag == "line", box(*(F.when(num(a).isNotNull() & num(b).isNotNull(), pick(num(a), num(b))) for a, b, pick in (("x1", "x2", F.least), ("y1", "y2", F.least), ("x1", "x2", F.greatest), ("y1", "y2", F.greatest)))))
        .when(F.size("numbers") >= 2, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    )
    stroked = ~F.lower(F.trim(F.coalesce(attr("stroke"), F.lit("none")))).isin(*NO_PAINT)
    width = F.abs(F.regexp_extract(F.coalesce(attr("stroke-width"), F.lit("1")), rf"^\s*({NUMBER})\s*(?:[pP][xX])?\s*$", 1).try_cast("double"))
    mitred = F.lower(F.trim(F.coalesce(attr("stroke-linejoin"), F.lit("miter")))) == "miter"
    limit = F.get(_numbers(F.coalesce(attr("stroke-miterlimit"), F.lit("4"))), F.lit(0))
    pad = F.when(stroked, width * F.when(mitred, F.coalesce(F.greatest(limit, F.lit(1.0)), F.lit(4.0))).otherwise(1.0) / 2).otherwise(0.0)
    boxed = rows.withColumn("numbers", _numbers(attr("points"))).select("doc_id", "idx", "tag", "attrs", plain.alias("b"), pad.alias("pad"))
    whole = F.col("b.x0").isNotNull() & F.col("b.y0").isNotNull() & F.col("b.x1").isNotNull() & F.col("b.y1").isNotNull() & F.col("pad").isNotNull()
    side = lambda c: F.when(whole, F.col(f"b.{c}") + (F.col("pad") if c[1] == "1" else -F.col("pad"))).alias(c)
    return boxed.select("doc_id", "idx", "tag", "attrs", *(side(c) for c in BOX))


def scene_refusals(el: DataFrame, boxes: DataFrame) -> DataFrame:
    """Documents that can't be regrouped, with all reasons in order: no canvas, groups or elements with
    unsafe attributes (a circle turned about its own centre is safe), elements without a usable box.
    ``el`` are scanned elements, ``boxes`` their ``element_boxes``."""
    has = lambda names: F.arrays_overlap(F.map_keys("attrs"), F.array(*(F.lit(n) for n in names)))
    attr = lambda name: F.try_element_at("attrs", F.lit(name))
    turned = is_stable_self_rotation(F.col("tag"), attr("transform"), attr("cx").try_cast("double"), attr("cy").try_cast("double"))
    safe_turn = turned & ~has([n for n in UNSAFE_DRAWABLE if n != "transform"])
    no_box = F.coalesce(box_area(*(F.col(c) for c in BOX)), F.lit(0.0)) <= 0
    inside = el.filter("NOT in_defs")
    reasons = [
        el.filter("idx = 0").filter(~F.col("is_valid") | canvas_of(attr("viewBox"), attr("width"), attr("height")).isNull()).select("doc_id", F.lit("no canvas").alias("reason")),
        inside.filter((F.col("tag") == "g") & has(UNSAFE_GROUP)).select("doc_id", F.lit("unsafe group").alias("reason")),
        boxes.filter(has(UNSAFE_DRAWABLE) & ~safe_turn).select("doc_id", F.lit("unsafe element").alias("reason")),
        boxes.filter(no_box).select("doc_id", F.lit("unusable box").alias("reason")),
    ]
    every = reasons[0].transform(united, reasons[1]).transform(united, reasons[2]).transform(united, reasons[3])
    return every.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def scene_paint(fill: Column, stroke: Column) -> Column:
    """The fill of an element (black by default) where it has one, else its stroke."""
    f, s = F.lower(F.trim(F.coalesce(fill, F.lit("black")))), F.lower(F.trim(F.coalesce(stroke, F.lit("none"))))
    return F.when(~f.isin(*NO_PAINT), F.concat(F.lit("fill:"), f)).when(~s.isin(*NO_PAINT), F.concat(F.lit("stroke:"), s)).otherwise("none")


def scene_nodes(el: DataFrame, boxes: DataFrame, most: float = 0.075) -> DataFrame:
    """Elements of documents without a refusal: box, paint with its family and hue, role (stroke, dot,
    fragment), orientation, and whether the element is a primitive or a scaffold, which is too large
    to bind others (``most`` of the canvas, or a stroke across 42 % of its diagonal)."""
    attr = lambda name: F.try_element_at("attrs", F.lit(name))
    canvas = el.filter("idx = 0").select("doc_id", canvas_of(attr("viewBox"), attr("width"), attr("height")).alias("canvas"))
    usable = boxes.join(canvas, "doc_id").join(scene_refusals(el, boxes), "doc_id", "left_anti")
    n = usable.select("doc_id", "idx", "tag", scene_paint(attr("fill"), attr("stroke")).alias("paint"), *BOX, F.col("canvas.w").alias("canvas_w"), F.col("canvas.h").alias("canvas_h"), (F.size(F.regexp_extract_all(F.coalesce(attr("d"), F.lit("")), F.lit("[A-Za-z]"), F.lit(0)))).alias("letters"))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    diagonal, canvas_diagonal = F.hypot(wide, high), F.hypot("canvas_w", "canvas_h")
    value = F.substring_index("paint", ":", -1)
    digits = F.when(value.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(value, "^#(.)(.)(.)$", "$1$1$2$2$3$3")).when(value.rlike("^#[0-9a-f]{6}$"), F.substring(value, 2, 6))
    level = lambda k: F.conv(F.substring("digits", k, 2), 16, 10).cast("int")
    n = n.withColumn("digits", digits).withColumn("r", level(1)).withColumn("g", level(3)).withColumn("b", level(5))
    top, delta = F.greatest("r", "g", "b"), F.greatest("r", "g", "b") - F.least("r", "g", "b")
    grey = (top <= 45) | (delta <= 20) | (delta / F.greatest(top, F.lit(1)) <= 0.14)
    family = F.when(F.col("digits").isNull(), F.when(F.contains("paint", F.lit(":url(")), "unknown").otherwise("other")).when(grey, "neutral").otherwise("chromatic")
    part = lambda p, q: (F.col(p) - F.col(q)) / F.greatest(delta, F.lit(1))
    hue = F.when(F.col("r") == top, F.pmod(60 * part("g", "b"), F.lit(360.0))).when(F.col("g") == top, 60 * (part("b", "r") + 2)).otherwise(60 * (part("r", "g") + 4))
    stroke_only = F.startswith("paint", F.lit("stroke:"))
    primitive = (F.col("tag") != "path") | (F.col("letters") <= 12)
    aspect = F.greatest(wide, high) / F.greatest(F.least(wide, high), F.lit(1e-6))
    role = F.when(stroke_only, "stroke").when(F.col("tag").isin("circle", "ellipse") | (primitive & (aspect <= 2.4) & (diagonal <= 0.035 * canvas_diagonal)), "dot").otherwise("fragment")
    fraction = wide * high / F.greatest(F.col("canvas_w") * F.col("canvas_h"), F.lit(1.0))
    scaffold = (fraction >= most) | (stroke_only & (diagonal / F.greatest(canvas_diagonal, F.lit(1.0)) >= 0.42))
    return n.select(
        "doc_id", "idx", "tag", "paint", *BOX, "canvas_w", "canvas_h", family.alias("family"), F.when(family == "chromatic", hue).alias("hue"),
        role.alias("role"), F.atan2(high, wide).alias("turn"), primitive.alias("primitive"), fraction.alias("fraction"), scaffold.alias("scaffold"),
    )


def scene_edges(nodes: DataFrame) -> DataFrame:
    """The first of six rules that relates two nodes of a document, with its score: matching bounds,
    overlay and overlap of paints, nearness of dots, of parallel strokes and of fragments. Scaffolds
    relate to nothing. Pairs meet in grid cells, so far apart elements are never compared."""
    j = near_pairs(nodes.filter("NOT scaffold"), REACH, 64.0, ("paint", "family", "hue", "role", "turn", "fraction", "canvas_w", "canvas_h"))
    col, other = F.col, lambda c: F.col(f"o_{c}")
    sizes = [box_area(*(F.col(f"{p}{c}") for c in BOX)) for p in ("", "o_")]
    common = F.greatest(F.least("x1", "o_x1") - F.greatest("x0", "o_x0"), F.lit(0.0)) * F.greatest(F.least("y1", "o_y1") - F.greatest("y0", "o_y0"), F.lit(0.0))
    j = j.withColumn("small", F.least(*sizes)).withColumn("ratio", F.greatest(*sizes) / F.least(*sizes)).withColumn("common", common)
    j = j.withColumn("iou", F.col("common") / (sizes[0] + sizes[1] - F.col("common"))).withColumn("cover", F.col("common") / F.col("small")).withColumn("gap", box_gap("", "o_"))
    differ = col("paint") != other("paint")
    apart = F.abs(col("hue") - other("hue"))
    akin = ~differ | ((col("family") == other("family")) & ((col("family") == "neutral") | ((col("family") == "chromatic") & (F.least(apart, 360 - apart) <= 55))))
    akin = F.coalesce(akin, F.lit(False))
    perhaps = akin | (col("family") == "unknown") | (other("family") == "unknown")
    both = lambda r: (col("role") == r) & (other("role") == r)
    roles = (col("role") == other("role")) | ((col("role") != "dot") & (other("role") != "dot"))
    inside = (col("cover") >= 0.88) & (col("ratio") >= 2.8)
    limit = F.least(F.lit(REACH), F.greatest(F.lit(6.0), 2.6 * F.sqrt("small")), F.greatest(F.lit(8.0), 0.025 * F.least("canvas_w", "canvas_h")))
    near, close = col("gap") <= limit, 1 - col("gap") / limit
    swing = F.abs(col("turn") - other("turn"))
    parallel = F.least(swing, F.lit(3.141592653589793) - swing) <= 0.3141592653589793
    rules = [
        ("matching-bounds", (col("iou") >= 0.68) & (col("ratio") <= 6) & perhaps, F.lit(0.97)),
        ("cross-paint-overlay", differ & roles & (perhaps | inside) & (col("cover") >= 0.72) & (col("ratio") <= 6), F.least(F.lit(0.96), 0.86 + 0.1 * col("cover"))),
        ("cross-paint-overlap", differ & roles & perhaps & (col("cover") >= 0.42) & (col("ratio") <= 3.5), 0.8 + 0.08 * col("cover")),
        ("repeated-dot-proximity", near & both("dot") & (col("ratio") <= 5), 0.74 + 0.1 * close),
        ("parallel-stroke-proximity", near & both("stroke") & (col("ratio") <= 5) & akin & parallel, 0.74 + 0.08 * close),
        ("fragment-proximity", near & both("fragment") & differ & (col("ratio") <= 3.2) & (F.least("fraction", "o_fraction") >= 0.00025) & akin, 0.76 + 0.1 * close),
    ]
    first = F.coalesce(*(F.when(holds, F.struct(F.lit(rule).alias("rule"), value.cast("double").alias("score"))) for rule, holds, value in rules))
    # Unpacked by a generator: a filter on the rule would be pushed down and compute all of this again.
    return j.select("doc_id", F.col("idx").alias("a"), F.col("o_idx").alias("b"), F.inline(F.array_compact(F.array(first))))


def object_candidates(edges: DataFrame, nodes: DataFrame, least_score: float = 0.74, most: float = 0.075, members: int = 96) -> DataFrame:
    """Groups of nodes that edges of ``least_score`` bind, taken best first (ties by a, b). A merge is
    refused when the group would have over ``members`` nodes, a box over ``most`` of the canvas, or
    boxes that fill too little of it (3 %; 1 % where at least four and 70 % are primitives). Groups of
    one paint need four nodes and four primitives. The confidence is .65 of the median and .35 of the
    smallest score of the edges within the group.

    Whether an edge counts depends on the better ones, so the edges and the nodes of one document are
    folded in one group: as many as one file's elements allow.
    """
    strong = edges.filter(F.col("score") >= least_score).select("doc_id", "a", "b", "rule", "score")
    facts = nodes.select(F.col("doc_id").alias("of"), "idx", *BOX, "primitive", "paint", (F.col("canvas_w") * F.col("canvas_h")).alias("canvas"))

    def fold(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "a", "b"], ascending=[False, True, True])
        node = {v["idx"]: v for v in of[of["idx"].isin({*rows["a"], *rows["b"]})].to_dict("records")}
        size = {i: (v["x1"] - v["x0"]) * (v["y1"] - v["y0"]) for i, v in node.items()}
        # Of each group: members, box, sum of areas, primitives and taken edges.
        group = {i: {"ids": [i], "box": [v[c] for c in BOX], "mass": size[i], "prim": int(v["primitive"]), "edges": []} for i, v in node.items()}
        for a, b, rule, score in rows[["a", "b", "rule", "score"]].itertuples(index=False):
            x, y = group[a], group[b]
            if x is not y:
                n, prim = len(x["ids"]) + len(y["ids"]), x["prim"] + y["prim"]
                box = [f(p, q) for f, p, q in zip((min, min, max, max), x["box"], y["box"])]
                area = (box[2] - box[0]) * (box[3] - box[1])
                floor = 0.01 if prim >= max(4, int(0.7 * n)) else 0.03
                if n > members or area / max(node[a]["canvas"], 1.0) > most or (x["mass"] + y["mass"]) / max(area, 1.0) < floor:
                    continue
                if len(x["ids"]) < len(y["ids"]):
                    x, y = y, x
                x["ids"] += y["ids"]
                x["edges"] += y["edges"]
                x.update(box=box, mass=x["mass"] + y["mass"], prim=prim)
                for i in y["ids"]:
                    group[i] = x
            x["edges"].append((score, rule))
        out = []
        for g in {id(v): v for v in group.values()}.values():
            n = len(g["ids"])
            if n < 2 or (len({node[i]["paint"] for i in g["ids"]}) < 2 and (n < 4 or g["prim"] < 4)):
                continue
            scores = pd.Series([s for s, _ in g["edges"]])
            out.append((int(rows["doc_id"].iloc[0]), int(min(g["ids"])), sorted(map(int, g["ids"])), float(0.65 * scores.median() + 0.35 * scores.min()), sorted({r for _, r in g["edges"]}), *map(float, g["box"])))
        return pd.DataFrame(out, columns=["doc_id", "group_id", "members", "confidence", "reasons", *BOX])

    kind = "doc_id long, group_id int, members array<int>, confidence double, reasons array<string>, x0 double, y0 double, x1 double, y1 double"
    return strong.groupBy("doc_id").cogroup(facts.groupBy("of")).applyInPandas(fold, kind)


def candidate_manifest(candidates: DataFrame, nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row a candidate: members, paints, box, confidence, reasons, and whether it can be applied.
    A candidate whose best anchor (``order_conflicts``) still has outsiders in its way would change
    what covers what: it is listed only, with the reason."""
    member = candidates.select("doc_id", "group_id", F.explode("members").alias("idx"))
    paints = member.join(by_shuffle(nodes.select("doc_id", "idx", "paint")), ["doc_id", "idx"]).groupBy("doc_id", "group_id").agg(F.array_sort(F.collect_set("paint")).alias("paints"))
    rows = candidates.join(paints, ["doc_id", "group_id"], "left").join(conflicts.select("doc_id", "group_id", "anchor", "conflicts"), ["doc_id", "group_id"], "left")
    unsafe = F.coalesce(F.col("conflicts") > 0, F.col("anchor").isNull())
    return rows.select(
        "doc_id", "group_id", F.when(unsafe, "manifest-only").otherwise("actual-dom").alias("mode"), F.round("confidence", 4).alias("confidence"), "reasons", F.size("members").alias("member_count"),
        F.size("paints").alias("paint_count"), "paints", *BOX, "members", F.when(~unsafe, F.col("anchor")).alias("anchor"), F.when(unsafe, "overlapping paint-order inversion").alias("not_applied_reason"),
    )

"""Queries that read vector documents as text and relate their elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from swatchwork.operators import boxes as B
from swatchwork.operators import documents as D
from swatchwork.operators import scene as C
from swatchwork.runtime import written
from swatchwork.sources import adapters as A
from swatchwork.sources import files as I

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _scanned(spark, sf_dir):
    """The elements of documents of 96 x 96 units, scanned from their text; in every twentieth
    document the group is turned."""
    shape = F.expr("""CASE tag WHEN 'circle' THEN format_string('cx="%d" cy="%d" r="%d" transform="rotate(30 %d %d)"', cx, cy, rad, cx, cy)
        WHEN 'rect' THEN format_string('x="%d" y="%d" width="%d" height="%d"', cx - rad, cy - rad, 2 * rad, 2 * rad)
        WHEN 'line' THEN format_string('x1="%d" y1="%d" x2="%d" y2="%d"', cx - rad, cy + rad, cx + rad, cy - rad)
        WHEN 'polyline' THEN format_string('points="%d,%d %d,%d %d,%d"', cx - rad, cy, cx, cy - rad, cx + rad, cy + rad)
        ELSE if(idx % 2 = 0, format_string('d="M%d %d q%d %d %d 0 t%d 0a%d %d 0 0 1 %d 0"', cx - rad, cy, rad, -2 * rad, 2 * rad, rad, rad, rad, rad),
            format_string('d="M%d %dQ%d %d %d %d T%d %d A %d %d 0 0 1 %d %d"', cx - rad, cy, cx, cy - 2 * rad, cx + rad, cy, cx + 2 * rad, cy, rad, rad, cx + 3 * rad, cy)) END""")
    paint = F.expr("""concat(CASE WHEN idx % 4 = 2 THEN ' fill="none"' WHEN fill IS NULL THEN '' ELSE concat(' fill="', fill, '"') END,
        format_string(' stroke="%s" stroke-width="%dpx"', stroke, cast(stroke_width AS int)), CASE idx % 3 WHEN 0 THEN ' stroke-linejoin="round"' WHEN 1 THEN ' stroke-miterlimit="2"' ELSE '' END)""")
    one = F.concat(F.lit("<"), "tag", F.lit(" "), shape, paint, F.lit("/>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("t")))), lambda e: e["t"]), "")
    turned = F.when(F.col("doc_id") % 20 == 7, '<g transform="rotate(5)">').otherwise("<g>")
    docs = A.elements(spark, sf_dir).groupBy("doc_id").agg(body.alias("b"))
    return written(I.scan_svg(docs.select("doc_id", F.concat(F.lit('<svg viewBox="0 0 96 96">'), turned, "b", F.lit("</g></svg>")).alias("svg"))))


_BOXES = """, pd AS (SELECT *, CASE WHEN tag = 'path' THEN 2 ELSE 1 END AS up, CASE WHEN tag = 'path' THEN 5 ELSE 1 END AS far, CASE WHEN stroke = 'none' THEN 0 WHEN idx % 3 = 0 THEN stroke_width / 2 WHEN idx % 3 = 1 THEN stroke_width ELSE stroke_width * 2 END AS pad FROM el),
bx AS (SELECT doc_id, idx + 2 AS idx, idx AS z, tag, fill, stroke, r, g, b, cx - rad - pad AS bx0, cy - up * rad - pad AS by0, cx + far * rad + pad AS bx1, cy + up * rad + pad AS by1 FROM pd)"""
_NODES = _BOXES + """, pt AS (SELECT *, CASE WHEN z % 4 <> 2 THEN 'fill:' || coalesce(fill, 'black') WHEN stroke <> 'none' THEN 'stroke:' || stroke ELSE 'none' END AS paint, bx1 - bx0 AS w, by1 - by0 AS h, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS delta FROM bx WHERE doc_id % 20 <> 7),
fm AS (SELECT *, CASE WHEN paint NOT LIKE '%#%' THEN 'other' WHEN top <= 45 OR delta <= 20 OR delta / top <= 0.14 THEN 'neutral' ELSE 'chromatic' END AS family FROM pt),
nd AS (SELECT *, CASE WHEN family = 'chromatic' THEN CASE WHEN r = top THEN ((60 * (g - b) / delta) + 360) % 360 WHEN g = top THEN 60 * ((b - r) / delta + 2) ELSE 60 * ((r - g) / delta + 4) END END AS hue,
CASE WHEN paint LIKE 'stroke:%' THEN 'stroke' WHEN tag = 'circle' OR (greatest(w, h) / least(w, h) <= 2.4 AND sqrt(w * w + h * h) <= 0.035 * sqrt(2 * 96 * 96)) THEN 'dot' ELSE 'fragment' END AS role, atan2(h, w) AS turn, w * h / 9216 AS fraction,
w * h / 9216 >= 0.075 OR (paint LIKE 'stroke:%' AND sqrt(w * w + h * h) / sqrt(2 * 96 * 96) >= 0.42) AS scaffold FROM fm)"""
_EDGES = _NODES + """, pr AS (SELECT a.doc_id, a.idx AS a, b.idx AS b, a.paint <> b.paint AS differ, a.role AS ra, b.role AS rb, least(a.fraction, b.fraction) AS least_fraction, a.w * a.h AS sa, b.w * b.h AS sb, greatest(least(a.bx1, b.bx1) - greatest(a.bx0, b.bx0), 0) * greatest(least(a.by1, b.by1) - greatest(a.by0, b.by0), 0) AS common,
sqrt(greatest(a.bx0 - b.bx1, b.bx0 - a.bx1, 0) ** 2 + greatest(a.by0 - b.by1, b.by0 - a.by1, 0) ** 2) AS gap, least(abs(a.turn - b.turn), pi() - abs(a.turn - b.turn)) AS swing,
a.paint = b.paint OR (a.family = 'neutral' AND b.family = 'neutral') OR coalesce(least(abs(a.hue - b.hue), 360 - abs(a.hue - b.hue)) <= 55, FALSE) AS akin FROM nd a JOIN nd b ON a.doc_id = b.doc_id AND a.idx < b.idx AND NOT a.scaffold AND NOT b.scaffold),
ms AS (SELECT *, ra = rb OR (ra <> 'dot' AND rb <> 'dot') AS roles, greatest(sa, sb) / least(sa, sb) AS ratio, common / (sa + sb - common) AS iou, common / least(sa, sb) AS cover, least(34, greatest(6, 2.6 * sqrt(least(sa, sb))), greatest(8, 2.4)) AS reach FROM pr),
sr AS (SELECT *, CASE WHEN iou >= 0.68 AND ratio <= 6 AND akin THEN 1 WHEN differ AND roles AND (akin OR (cover >= 0.88 AND ratio >= 2.8)) AND cover >= 0.72 AND ratio <= 6 THEN 2 WHEN differ AND roles AND akin AND cover >= 0.42 AND ratio <= 3.5 THEN 3 WHEN gap > reach THEN 0
WHEN ra = 'dot' AND rb = 'dot' AND ratio <= 5 THEN 4 WHEN ra = 'stroke' AND rb = 'stroke' AND ratio <= 5 AND akin AND swing <= radians(18) THEN 5 WHEN ra = 'fragment' AND rb = 'fragment' AND differ AND ratio <= 3.2 AND least_fraction >= 0.00025 AND akin THEN 6 ELSE 0 END AS rule_no FROM ms)"""


@query(A.with_views("el") + _BOXES + " SELECT doc_id, idx, tag, bx0 AS x0, by0 AS y0, bx1 AS x1, by1 AS y1 FROM bx")
def element_boxes(spark, sf_dir):
    return C.element_boxes(_scanned(spark, sf_dir)).drop("attrs")


@query(A.with_views("el") + " SELECT DISTINCT doc_id, 'unsafe group' AS reasons FROM el WHERE doc_id % 20 = 7")
def scene_refusals(spark, sf_dir):
    el = _scanned(spark, sf_dir)
    return C.scene_refusals(el, C.element_boxes(el))


def _nodes(spark, sf_dir):
    el = _scanned(spark, sf_dir)
    return C.scene_nodes(el, written(C.element_boxes(el)))


@query(A.with_views("el") + _NODES + " SELECT doc_id, idx, paint, family, round(hue, 6) AS hue, role, round(turn, 6) AS turn, round(fraction, 6) AS fraction, scaffold FROM nd")
def scene_nodes(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in ("hue", "turn", "fraction")]
    return _nodes(spark, sf_dir).select("doc_id", "idx", "paint", "family", "role", "scaffold", *rounded)


@query(A.with_views("el") + _EDGES + """ SELECT doc_id, a, b, ['matching-bounds', 'cross-paint-overlay', 'cross-paint-overlap', 'repeated-dot-proximity', 'parallel-stroke-proximity', 'fragment-proximity'][rule_no] AS rule,
round(CASE rule_no WHEN 1 THEN 0.97 WHEN 2 THEN least(0.96, 0.86 + 0.1 * cover) WHEN 3 THEN 0.8 + 0.08 * cover WHEN 4 THEN 0.74 + 0.1 * (1 - gap / reach) WHEN 5 THEN 0.74 + 0.08 * (1 - gap / reach) ELSE 0.76 + 0.1 * (1 - gap / reach) END, 6)::DOUBLE AS score FROM sr WHERE rule_no > 0""")
def scene_edges(spark, sf_dir):
    return C.scene_edges(written(_nodes(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query()
def object_candidates(spark, sf_dir):
    nodes = written(_nodes(spark, sf_dir))
    return C.object_candidates(C.scene_edges(nodes), nodes)


@query()
def object_manifest(spark, sf_dir):
    nodes = written(_nodes(spark, sf_dir))
    found = written(C.object_candidates(C.scene_edges(nodes), nodes))
    groups = found.select("doc_id", F.explode("members").alias("idx"), "group_id")
    return C.candidate_manifest(found, nodes, B.order_conflicts(nodes, groups))


@query()
def structure_signature(spark, sf_dir):
    return D.structure_signature(_scanned(spark, sf_dir))

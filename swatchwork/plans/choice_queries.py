"""Queries on chosen palettes, accents, ramps, near circles, paint resources and notations."""

from __future__ import annotations

from pyspark.sql import functions as F

from swatchwork.functions import svg
from swatchwork.operators import curves as K
from swatchwork.operators import paints as T
from swatchwork.operators import palette as P
from swatchwork.operators import shapes as S
from swatchwork.runtime import written
from swatchwork.sources import adapters as A

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query()
def choose_palette(spark, sf_dir):
    pal = P.choose_palette(written(A.hist_li(spark, sf_dir)))
    size = pal.groupBy("doc_id").agg(F.count(F.lit(1)).alias("colours"))
    return pal.join(size, "doc_id").withColumn("continuous", P.is_continuous_tone(F.col("mode"), F.col("colours")))


@query()
def retain_accents(spark, sf_dir):
    px = written(A.src_px(spark, sf_dir))
    pal = written(A.palette_of(P.color_histogram(px)))
    return P.retain_accents(px, pal, pal.filter("k < 3"), area=24)


@query()
def ramp_gate(spark, sf_dir):
    px = written(A.ramp_px(spark, sf_dir))
    flat = px.groupBy("doc_id").agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in "rgb"))
    return S.ramp_gate(px, S.ramp_stops(px), flat)


@query()
def near_circle(spark, sf_dir):
    pts = A.ring_pts(spark, sf_dir)
    return K.near_circle(pts, K.circle_fit(pts))


_HEX = "'#' || printf('%02x', r) || printf('%02x', g) || printf('%02x', b)"
_NEW = "'#' || printf('%02x', 255 - r) || printf('%02x', 255 - g) || printf('%02x', 255 - b)"


@query(A.with_views("el") + f""" SELECT doc_id, idx, CASE idx % 4 WHEN 0 THEN {_NEW} WHEN 1 THEN 'rgb(' || (255 - r) || ',' || (255 - g) || ',' || (255 - b) || ')' WHEN 2 THEN 'rgba(' || (255 - r) || ',' || (255 - g) || ',' || (255 - b) || ',.5)' ELSE {_NEW} || '80' END AS paint FROM el""")
def format_color(spark, sf_dir):
    hexed = lambda d: f"lower(concat('#', lpad(hex({d}r), 2, '0'), lpad(hex({d}g), 2, '0'), lpad(hex({d}b), 2, '0')))"
    old = f"CASE idx % 4 WHEN 0 THEN {hexed('')} WHEN 1 THEN concat('rgb(', concat_ws(', ', r, g, b), ')') WHEN 2 THEN concat('rgba(', concat_ws(', ', r, g, b), ', .5)') ELSE concat({hexed('')}, '80') END"
    return A.elements(spark, sf_dir).select("doc_id", "idx", svg.format_color(F.expr(hexed("255 - ")), F.expr(old)).alias("paint"))


@query(A.with_views("el") + """ SELECT doc_id, idx, CASE WHEN idx % 4 = 0 THEN x0 * 2 + 10 WHEN idx % 4 = 1 THEN x0 / 2 WHEN idx % 4 = 2 THEN x0 END AS x0, CASE WHEN idx % 4 = 0 THEN y1 * 1.0 + 20 WHEN idx % 4 = 1 THEN y1 / 4 WHEN idx % 4 = 2 THEN y1 END AS y1 FROM el""")
def viewbox_scale(spark, sf_dir):
    box = F.expr("CASE idx % 4 WHEN 0 THEN array(10D, 20D, 192D, 96D) WHEN 1 THEN array(48D, 24D) WHEN 3 THEN array(1D) END")
    el = A.elements(spark, sf_dir)
    u = svg.viewbox_scale({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, box, F.lit(96), F.lit(96))
    return el.select("doc_id", "idx", u.alias("u")).select("doc_id", "idx", "u.x0", "u.y1")


@query(A.with_views("el") + " SELECT doc_id, idx, tag = 'circle' AND idx % 3 <> 1 AS stable FROM el")
def self_rotation(spark, sf_dir):
    turn = F.expr("CASE idx % 3 WHEN 0 THEN concat('rotate(30 ', cx, ' ', cy, ')') WHEN 1 THEN concat('rotate(30, ', cx + 1, ', ', cy, ')') ELSE concat('rotate(-4.5,', cx, ',', cy, ')') END")
    return A.elements(spark, sf_dir).select("doc_id", "idx", svg.is_stable_self_rotation(F.col("tag"), turn, F.col("cx").cast("double"), F.col("cy").cast("double")).alias("stable"))


@query(A.with_views("el") + f""", s AS (SELECT doc_id, {_HEX} AS hex FROM el WHERE idx % 5 <> 0 UNION SELECT doc_id, {_NEW} FROM el WHERE idx % 2 = 1), g AS (SELECT doc_id, count(*) AS n FROM el WHERE idx % 10 = 0 GROUP BY doc_id), d AS (SELECT DISTINCT doc_id FROM el)
SELECT doc_id, coalesce(c.n, 0) AS solid_paints, coalesce(g.n, 0) AS gradient_paints, coalesce(c.n, 0) + coalesce(g.n, 0) AS unique_paints_total FROM d LEFT JOIN (SELECT doc_id, count(DISTINCT hex) AS n FROM s GROUP BY doc_id) c USING (doc_id) LEFT JOIN g USING (doc_id)""")
def paint_resources(spark, sf_dir):
    hexed = lambda d: f"upper(concat('#', lpad(hex({d}r), 2, '0'), lpad(hex({d}g), 2, '0'), lpad(hex({d}b), 2, '0')))"
    el = A.elements(spark, sf_dir)
    layers = el.selectExpr("doc_id", "idx AS pos", "if(idx % 5 = 0, concat('Gradient ', idx), concat('Layer ', idx)) AS name", f"{hexed('')} AS value")
    gradients = el.filter("idx % 10 = 0").selectExpr("doc_id", "idx AS pos", "concat('g', idx) AS id", f"array(struct(0D AS offset, '#000000' AS color), struct(0.5D AS offset, {hexed('')} AS color)) AS stops")
    return T.paint_resources(layers, gradients, el.filter("idx % 2 = 1").selectExpr("doc_id", f"{hexed('255 - ')} AS color"))


@query()
def paint_layers(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    hexed = "lower(concat('#', lpad(hex(r), 2, '0'), lpad(hex(g), 2, '0'), lpad(hex(b), 2, '0')))"
    layers = el.selectExpr("doc_id", "idx AS pos", "if(idx % 5 = 0, concat('gradient ', idx), concat('layer ', idx)) AS name", f"{hexed} AS value")
    gradients = el.filter("idx % 10 = 0").selectExpr("doc_id", "idx AS pos", "concat('g', idx) AS id", f"array(struct(0D AS offset, '#000000' AS color), struct(0.5D AS offset, {hexed} AS color)) AS stops")
    return T.paint_layers(layers, gradients)

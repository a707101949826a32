"""Queries on shapes, regions, paints, and documents read back from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from swatchwork.operators import documents as D
from swatchwork.operators import paints as T
from swatchwork.operators import palette as P
from swatchwork.operators import shapes as S
from swatchwork.plans.table_queries import _SEGS
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


@query(A.with_views("src_px") + " SELECT s.doc_id, z, count(*) AS pixels FROM src_px p JOIN shapes s ON s.doc_id = p.doc_id AND (x - cx) ** 2 + (y - cy) ** 2 <= greatest(rad - 0.5, 0) ** 2 GROUP BY ALL")
def points_in_shape(spark, sf_dir):
    return S.points_in_shape(A.src_px(spark, sf_dir), A.shapes(spark, sf_dir)).groupBy("doc_id", "z").agg(F.count(F.lit(1)).alias("pixels"))


@query(A.with_views("src_px") + " SELECT p.doc_id, y, x, r, g, b, CASE WHEN EXISTS (SELECT 1 FROM shapes s WHERE s.doc_id = p.doc_id AND s.cy // 2 = p.y // 2 AND s.cx // 2 = p.x // 2) THEN 0 ELSE a END AS a FROM src_px p")
def clear_mask(spark, sf_dir):
    mask = A.shapes(spark, sf_dir).selectExpr("doc_id", "cy div 2 AS y", "cx div 2 AS x")
    return S.clear_mask(A.src_px(spark, sf_dir), mask, 96, 48)


@query(A.with_views("src_px") + """, h AS (SELECT doc_id, r, g, b, count(*) AS w FROM src_px GROUP BY ALL), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, r, g, b) - 1 AS k FROM h) WHERE k < 8),
l AS (SELECT h.doc_id, h.r, h.g, h.b, arg_min({'r': p.r, 'g': p.g, 'b': p.b}, ((h.r - p.r) ** 2 + (h.g - p.g) ** 2 + (h.b - p.b) ** 2, k)) AS m FROM h JOIN p USING (doc_id) GROUP BY ALL) SELECT doc_id, y, x, m.r AS r, m.g AS g, m.b AS b, a FROM src_px JOIN l USING (doc_id, r, g, b)""")
def palette_image(spark, sf_dir):
    px = A.src_px(spark, sf_dir)
    hist = written(P.color_histogram(px))
    pal = A.palette_of(hist)
    return S.palette_image(px, P.nearest_label(hist, pal), pal)


_BANDS = """, l AS (SELECT *, r // 64 * 16 + g // 64 * 4 + b // 64 AS lab FROM src_px), c AS (SELECT a.doc_id, least(a.lab, o.lab) AS lo, greatest(a.lab, o.lab) AS hi, count(*) AS n, avg((greatest(abs(a.r - o.r), abs(a.g - o.g), abs(a.b - o.b)) < 140)::INT) AS s FROM l a JOIN l o ON o.doc_id = a.doc_id AND ((o.y = a.y AND o.x = a.x + 1) OR (o.y = a.y + 1 AND o.x = a.x)) WHERE a.lab <> o.lab GROUP BY ALL),
e AS (SELECT doc_id, lo AS s, hi AS t FROM c WHERE n >= 2 AND s >= 0.2 UNION SELECT doc_id, hi, lo FROM c WHERE n >= 2 AND s >= 0.2), reach(doc_id, label, other) AS (SELECT DISTINCT doc_id, s, s FROM e UNION SELECT r.doc_id, r.label, e.t FROM reach r JOIN e ON e.doc_id = r.doc_id AND e.s = r.other)
SELECT doc_id, label, min(other) AS region FROM reach GROUP BY doc_id, label"""


@query(A.with_views("src_px") + _BANDS)
def merge_bands(spark, sf_dir):
    px = A.src_px(spark, sf_dir).withColumn("lab", F.expr("r div 64 * 16 + g div 64 * 4 + b div 64"))
    return S.merge_bands(P.region_adjacency(px, "lab", 140), contacts=2, smooth=0.2)


_STOPS = ", t AS (SELECT *, (x - min(x) OVER (PARTITION BY doc_id)) / greatest(max(x) OVER (PARTITION BY doc_id) - min(x) OVER (PARTITION BY doc_id), 1) AS t FROM ramp_px), stops AS (SELECT doc_id, k AS stop, count(*) AS pixels, quantile_cont(r, 0.5) AS r, quantile_cont(g, 0.5) AS g, quantile_cont(b, 0.5) AS b FROM t, (SELECT unnest(range(5))::INT AS k) WHERE abs(t - k / 4) <= 0.15::DOUBLE GROUP BY doc_id, k)"


@query(A.with_views("ramp_px") + _STOPS + " SELECT * FROM stops")
def ramp_stops(spark, sf_dir):
    return S.ramp_stops(A.ramp_px(spark, sf_dir))


@query(A.with_views("ramp_px") + _STOPS + """, seg AS (SELECT a.doc_id, a.stop / 4 AS t0, b.stop / 4 AS t1, a.r AS r0, a.g AS g0, a.b AS b0, b.r AS r1, b.g AS g1, b.b AS b1 FROM stops a JOIN stops b ON a.doc_id = b.doc_id AND b.stop = a.stop + 1)
SELECT t.doc_id, y, x, round(r0 + (t - t0) / (t1 - t0) * (r1 - r0), 3) AS r, round(g0 + (t - t0) / (t1 - t0) * (g1 - g0), 3) AS g, round(b0 + (t - t0) / (t1 - t0) * (b1 - b0), 3) AS b FROM t JOIN seg s ON s.doc_id = t.doc_id AND t >= t0 AND (t < t1 OR (t = 1 AND t1 = 1))""")
def eval_gradient(spark, sf_dir):
    px = A.ramp_px(spark, sf_dir)
    return S.eval_gradient(px, S.ramp_stops(px))


@query(A.with_views("arcs") + """, e AS (SELECT a.arc_id AS s, b.arc_id AS t FROM arcs a JOIN arcs b ON a.doc_id = b.doc_id AND a.paint = b.paint AND a.arc_id <> b.arc_id WHERE abs(a.radius - b.radius) <= 2 AND abs(a.width - b.width) <= 1 AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 2),
reach(arc_id, other) AS (SELECT DISTINCT s, s FROM e UNION SELECT r.arc_id, e.t FROM reach r JOIN e ON e.s = r.other), ring AS (SELECT arc_id, min(other) AS ring FROM reach GROUP BY arc_id), rows_ AS (SELECT * FROM arcs JOIN ring USING (arc_id)),
m AS (SELECT doc_id, ring, count(*) AS arcs, round(sum(radius * (a1 - a0)) / sum(a1 - a0), 6) AS radius, round(sum(width * (a1 - a0)) / sum(a1 - a0), 6) AS width FROM rows_ GROUP BY ALL), b AS (SELECT DISTINCT doc_id, ring, arc_id, unnest(range(floor(a0)::INT, ceil(a1)::INT)) % 360 AS bin FROM rows_), n AS (SELECT doc_id, ring, bin, count(*) AS n FROM b GROUP BY ALL),
c AS (SELECT doc_id, ring, round(count(*)::DOUBLE, 3) AS degrees, round(sum(n - 1) / sum(n), 6) AS overlap FROM n GROUP BY doc_id, ring) SELECT *, degrees >= 180 AND overlap <= 0.12 AS safe FROM m JOIN c USING (doc_id, ring)""")
def annulus_candidates(spark, sf_dir):
    return S.annulus_candidates(A.arcs(spark, sf_dir))


@query(A.with_views("shapes") + " SELECT a.doc_id, a.z AS outer, b.z AS inner, (a.rad + b.rad) / 2 AS radius, a.rad - b.rad AS width FROM shapes a JOIN shapes b ON a.doc_id = b.doc_id AND a.rad > b.rad AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 10".replace(" outer,", ' "outer",').replace(" inner,", ' "inner",'))
def concentric_rings(spark, sf_dir):
    return S.concentric_rings(A.shapes(spark, sf_dir), 10.0)


_GRADS = "grads AS (SELECT p_partkey // 40 AS doc_id, 'g' || (p_partkey % 40) AS id, 'g' || (p_partkey * 7 % 41) AS href, CASE WHEN p_partkey % 4 = 0 THEN (2 + p_partkey % 3)::INT ELSE 0 END AS stops FROM part)"


@query(f"WITH RECURSIVE {_GRADS}, walk(doc_id, id, nxt, stops, n) AS (SELECT doc_id, id, href, stops, 0 FROM grads UNION ALL SELECT w.doc_id, w.id, g.href, g.stops, n + 1 FROM walk w JOIN grads g ON g.doc_id = w.doc_id AND g.id = w.nxt WHERE w.stops = 0 AND n < 45) SELECT doc_id, id, max(stops) AS stops FROM walk GROUP BY doc_id, id")
def resolved_stops(spark, sf_dir):
    grads = A.table(spark, sf_dir, "part").selectExpr("p_partkey div 40 AS doc_id", "concat('g', p_partkey % 40) AS id", "concat('g', p_partkey * 7 % 41) AS href", "if(p_partkey % 4 = 0, cast(2 + p_partkey % 3 AS int), 0) AS stops")
    return S.resolved_stops(grads)


@query(A.with_views("cand") + " SELECT b.item_id, CASE WHEN coalesce(a.item_id % 3 = 0, FALSE) THEN a.foreground ELSE b.foreground END AS foreground, coalesce(a.item_id % 3 = 0, FALSE) AS committed FROM (SELECT * FROM cand WHERE cand_no = 1) b LEFT JOIN (SELECT * FROM cand WHERE cand_no = 2) a USING (item_id)".replace("a.item_id % 3", "(CASE WHEN a.cand_no IS NOT NULL THEN b.item_id END) % 3"))
def staged_commit(spark, sf_dir):
    c = A.cand(spark, sf_dir)
    verdicts = c.filter("cand_no = 1 AND item_id % 3 < 2").selectExpr("item_id", "item_id % 3 = 0 AS accepted")
    return S.staged(c.filter("cand_no = 1"), c.filter("cand_no = 2"), verdicts, "item_id", "foreground")


@query(A.with_views("el") + ", b AS (SELECT DISTINCT doc_id, id AS part FROM el WHERE idx % 2 = 0 AND id IS NOT NULL), a AS (SELECT DISTINCT doc_id, id AS part FROM el WHERE idx % 3 = 0 AND id IS NOT NULL) SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, count(*) FILTER (b.part IS NOT NULL AND a.part IS NOT NULL) AS unresolved, count(*) FILTER (b.part IS NULL) AS new_failures, count(*) FILTER (a.part IS NULL) AS fixed FROM b FULL JOIN a ON b.doc_id = a.doc_id AND b.part = a.part GROUP BY 1")
def failures_after(spark, sf_dir):
    el = A.elements(spark, sf_dir).filter("id IS NOT NULL").selectExpr("doc_id", "idx", "id AS part")
    return S.failures_after(el.filter("idx % 2 = 0").drop("idx"), el.filter("idx % 3 = 0").drop("idx"))


# -- documents as text --------------------------------------------------------------------------------


def _svg(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    attr = lambda n, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    one = F.concat(F.lit("<"), "tag", attr("id", "id"), attr("fill", "fill"), attr("stroke", "stroke"), F.lit("/>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("t")))), lambda e: e["t"]), "")
    head = '<svg xmlns="http://www.w3.org/2000/svg"><metadata id="m">{"n": '
    return el.groupBy("doc_id").agg(body.alias("b"), F.count(F.lit(1)).alias("n")).select("doc_id", F.when(F.col("doc_id") % 20 == 7, "<svg><g>").otherwise(F.concat(F.lit(head), "n", F.lit('}</metadata><g stroke-width="2">'), "b", F.lit("</g></svg>"))).alias("svg"))


@query(A.with_views("el") + " SELECT doc_id, (idx + 3)::INT AS idx, tag, id, fill, stroke, '2' AS width, 2 AS depth FROM el WHERE doc_id % 20 <> 7 UNION ALL SELECT DISTINCT doc_id, 0, NULL, NULL, NULL, NULL, NULL, 0 FROM el WHERE doc_id % 20 = 7")
def scan_svg(spark, sf_dir):
    rows = I.scan_svg(_svg(spark, sf_dir)).filter("NOT is_valid OR tag NOT IN ('svg', 'metadata', 'g')")
    return rows.selectExpr("doc_id", "idx", "tag", "attrs['id'] AS id", "attrs['fill'] AS fill", "attrs['stroke'] AS stroke", "attrs['stroke-width'] AS width", "depth")


@query(A.with_views("el") + " SELECT doc_id, count(*) AS n FROM el WHERE doc_id % 20 <> 7 GROUP BY doc_id")
def embedded_json(spark, sf_dir):
    return I.embedded_json(_svg(spark, sf_dir), "m", "n long").filter("value IS NOT NULL").select("doc_id", "value.n")


@query(A.with_views("cand") + " SELECT item_id AS doc_id, max(nodes) % 7 AS circles, max(nodes) % 3 AS rectangles, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END AS lines, 0 AS ellipses, 0 AS polylines, 0 AS polygons, max(nodes) % 7 + max(nodes) % 3 + CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END AS primitives FROM cand WHERE item_id % 50 <> 0 GROUP BY item_id")
def report_versions(spark, sf_dir):
    rows = A.cand(spark, sf_dir).groupBy(F.col("item_id").alias("doc_id")).agg(F.max("nodes").alias("n")).selectExpr("doc_id", "n % 7 AS c", "n % 3 AS r")
    new = F.to_json(F.struct(F.col("c").alias("native_circles"), F.col("r").alias("native_rectangles"), F.lit(2).alias("native_lines")))
    old = F.to_json(F.struct((F.col("c") + F.col("r")).alias("native_primitives"), F.transform(F.array_repeat(F.lit("rect"), F.col("r")), lambda p: F.struct(p.alias("primitive"))).alias("stroke_details")))
    text = F.when(F.col("doc_id") % 2 == 0, new).otherwise(old)
    return I.report_versions(rows.select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.substring(text, 1, 12)).otherwise(text).alias("json")))


# -- paints and audits ----------------------------------------------------------------------------------


@query()
def paint_roles(spark, sf_dir):
    return T.paint_roles(D.paint_inventory(A.elements(spark, sf_dir)))


@query()
def role_mapping(spark, sf_dir):
    return T.role_mapping(T.role_members(D.paint_inventory(A.elements(spark, sf_dir))), 0.6, 0.12, 150.0)


def _penalty(v: str, free: float, severe: float, most: float) -> str:
    return f"greatest(0, least(1, ({v} - {free}) / ({severe} - {free}))) * {most}"


@query(A.with_views("el") + _SEGS + f""", n AS (SELECT doc_id, idx, count(*) AS n FROM seg GROUP BY ALL), c AS (SELECT doc_id, count(*) AS paths, sum(n) AS commands, quantile_cont(n, 0.5) AS median, quantile_disc(n, 0.95) AS p95, max(n) AS largest, round(max(n) / sum(n), 6) AS largest_share FROM n GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS elements, count(id) AS with_id FROM el GROUP BY doc_id), b AS (SELECT s.*, largest, round(greatest({_penalty("paths", 40, 300, 22)}, {_penalty("commands", 500, 5000, 24)}) + greatest({_penalty("median", 40, 150, 8)}, {_penalty("p95", 120, 450, 10)}, {_penalty("largest", 250, 800, 12)}, {_penalty("largest_share", 0.45, 0.85, 6)}), 1) AS redraw_burden FROM s JOIN c USING (doc_id))
SELECT doc_id, redraw_burden, CASE WHEN elements >= 20 AND with_id = 0 THEN 8.0 WHEN elements >= 50 AND with_id / elements < 0.1 THEN 5.0 ELSE 0.0 END AS workflow_burden, round(30 * least(1, with_id / elements / 0.8), 1) AS identity_score, CASE WHEN 100 - redraw_burden >= 85 THEN 'low' WHEN 100 - redraw_burden >= 70 AND largest < 500 THEN 'moderate' WHEN 100 - redraw_burden >= 50 THEN 'high' ELSE 'very_high' END AS level FROM b""")
def editability(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    return T.editability(D.path_complexity(D.path_segments(A.path_texts(spark, sf_dir))), D.structure_counts(el))


@query(A.with_views("el") + " SELECT doc_id, idx, lower(printf('#%02x%02x%02x', round_even(r * 0.5 + 127.5, 0)::INT, round_even(g * 0.5 + 127.5, 0)::INT, round_even(b * 0.5 + 127.5, 0)::INT)) AS hex FROM el")
def preblend_opacity(spark, sf_dir):
    return A.elements(spark, sf_dir).select("doc_id", "idx", T.preblend_opacity(F.col("r"), F.col("g"), F.col("b"), F.lit(0.5)).alias("hex"))

"""Queries on pixels, comparisons and palettes, over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.operators import compare as C
from swatchwork.operators import palette as P
from swatchwork.operators import raster as R
from swatchwork.runtime import written
from swatchwork.sources import adapters as A

N = A.SIDE
_GAP = "greatest(abs({a}r - {b}r), abs({a}g - {b}g), abs({a}b - {b}b))"
_NEAR9 = "(SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)"


def gap(a: str, b: str) -> str:
    return _GAP.replace("{a}", a).replace("{b}", b)


#: Squared distance of colour h from the line between a and b.
_BESIDE = "(h.r - (a.r + u * (b.r - a.r))) ** 2 + (h.g - (a.g + u * (b.g - a.g))) ** 2 + (h.b - (a.b + u * (b.b - a.b))) ** 2".replace("u *", "greatest(0, least(1, coalesce(((h.r - a.r) * (b.r - a.r) + (h.g - a.g) * (b.g - a.g) + (h.b - a.b) * (b.b - a.b)) / nullif((b.r - a.r) ** 2 + (b.g - a.g) ** 2 + (b.b - a.b) ** 2, 0), 0))) *")


QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.src_px(spark, sf_dir).filter("r < 255 OR g < 255 OR b < 255").select(*R.PIXEL)


_INK = "ink AS (SELECT doc_id, y, x FROM src_px WHERE r < 255 OR g < 255 OR b < 255)"
_RUNS = "runs AS (SELECT doc_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY doc_id, y ORDER BY x) AS i FROM ink) GROUP BY doc_id, y, i)"


@query(A.with_views("src_px") + " SELECT * FROM src_px")
def rasterize(spark, sf_dir):
    return A.src_px(spark, sf_dir)


@query(A.with_views("src_px") + """ SELECT doc_id, count(*) FILTER (least(r, g, b) >= 220 AND greatest(r, g, b) - least(r, g, b) <= 35) AS light, count(*) FILTER (least(r, g, b) >= 220 AND greatest(r, g, b) - least(r, g, b) <= 30) AS neutral,
count(*) FILTER (a BETWEEN 1 AND 254) AS soft, count(*) FILTER (a > 0) AS visible, count(*) FILTER ((255 - r) * (255 - r) + (255 - g) * (255 - g) + (255 - b) * (255 - b) > 3600) AS ink FROM src_px GROUP BY doc_id""")
def pixel_flags(spark, sf_dir):
    return R.flags(A.src_px(spark, sf_dir)).groupBy("doc_id").agg(*(F.count_if(c).alias(n) for c, n in (("is_light", "light"), ("is_neutral", "neutral"), ("is_soft", "soft"), ("is_visible", "visible"), ("is_ink", "ink"))))


@query(A.with_views("src_px") + " SELECT doc_id, y, x, floor((r * (a - y) + 10 * (255 - (a - y))) / 255.0 + 0.5)::INT AS r, floor((g * (a - y) + 20 * (255 - (a - y))) / 255.0 + 0.5)::INT AS g, floor((b * (a - y) + 30 * (255 - (a - y))) / 255.0 + 0.5)::INT AS b FROM src_px")
def composite_over(spark, sf_dir):
    return R.composite_over(A.src_px(spark, sf_dir).withColumn("a", F.expr("a - y")), (10, 20, 30))


@query(A.with_views("src_px") + f", {_INK} SELECT doc_id, y + dy AS y, x + dx AS x, count(*) AS n FROM ink, {_NEAR9} GROUP BY ALL")
def neighbour_count(spark, sf_dir):
    return R.neighbour_count(_ink(spark, sf_dir))


@query(A.with_views("src_px") + f", {_INK} SELECT DISTINCT doc_id, y + dy AS y, x + dx AS x FROM ink, {_NEAR9} WHERE y + dy BETWEEN 0 AND 95 AND x + dx BETWEEN 0 AND 95")
def dilate(spark, sf_dir):
    return R.dilate(_ink(spark, sf_dir), N, N)


@query(A.with_views("src_px") + f""", {_INK}, h AS (SELECT *, lag(x) OVER w = x - 1 AND lead(x) OVER w = x + 1 AS wide FROM ink WINDOW w AS (PARTITION BY doc_id, y ORDER BY x)), v AS (SELECT *, lag(y) OVER u = y - 1 AND lead(y) OVER u = y + 1 AS high FROM h WHERE wide WINDOW u AS (PARTITION BY doc_id, x ORDER BY y)) SELECT doc_id, y, x FROM v WHERE high""")
def erode(spark, sf_dir):
    return R.erode(_ink(spark, sf_dir))


@query(A.with_views("src_px") + f", {_INK}, {_RUNS} SELECT * FROM runs")
def row_runs(spark, sf_dir):
    return R.row_runs(_ink(spark, sf_dir))


_COMPS = _RUNS + """, node AS (SELECT doc_id, y, x0, x1, y * 65536 + x0 AS run FROM runs),
edge AS (SELECT a.doc_id, a.run AS s, b.run AS t FROM node a JOIN node b ON a.doc_id = b.doc_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + {reach} AND b.x0 <= a.x1 + {reach}),
reach(doc_id, run, other) AS (SELECT doc_id, run, run FROM node UNION SELECT r.doc_id, r.run, e.t FROM reach r JOIN edge e ON r.doc_id = e.doc_id AND r.other = e.s),
root AS (SELECT doc_id, run, min(other) AS root FROM reach GROUP BY doc_id, run),
comp AS (SELECT doc_id, y, x0, x1, root, dense_rank() OVER (PARTITION BY doc_id ORDER BY root) AS comp_id FROM node JOIN root USING (doc_id, run))"""


@query(A.with_views("src_px") + f", {_INK}, {_COMPS.replace('{reach}', '1')}" + """ SELECT doc_id, comp_id, sum(x1 - x0 + 1)::BIGINT AS area, min(x0) AS bx, min(y) AS by, max(x1) - min(x0) + 1 AS bw, max(y) - min(y) + 1 AS bh, round(sum(x1 - x0 + 1) / ((max(x1) - min(x0) + 1) * (max(y) - min(y) + 1)), 6) AS fill,
round(sum((x0 + x1) * (x1 - x0 + 1) / 2.0) / sum(x1 - x0 + 1), 6) AS mx, round(sum(y * (x1 - x0 + 1)) / sum(x1 - x0 + 1), 6) AS my FROM comp GROUP BY doc_id, comp_id""")
def connected_components(spark, sf_dir):
    return R.component_stats(R.component_runs(_ink(spark, sf_dir)))


_PAPER = "ink AS (SELECT doc_id, y, x FROM src_px WHERE r = 255 AND g = 255 AND b = 255)"


@query(A.with_views("src_px") + f", {_PAPER}, {_COMPS.replace('{reach}', '0')}" + """, c AS (SELECT doc_id, comp_id, max(CASE WHEN y IN (0, 95) OR x0 = 0 OR x1 = 95 THEN 1 ELSE 0 END) AS edge, sum(x1 - x0 + 1) AS area FROM comp GROUP BY doc_id, comp_id)
SELECT doc_id, sum(CASE WHEN edge = 1 THEN area ELSE 0 END)::BIGINT AS outer_pixels, sum(area)::BIGINT AS mask_pixels, count(*) FILTER (edge = 0) AS enclosed FROM c GROUP BY doc_id""")
def border_connected(spark, sf_dir):
    return R.border_connected(A.src_px(spark, sf_dir).filter("r = 255 AND g = 255 AND b = 255").select(*R.PIXEL), N, N)


@query(A.with_views("src_px") + f", {_INK}, {_RUNS}, h AS (SELECT doc_id, y, x, least(x - x0, x1 - x) + 1 AS h FROM (SELECT doc_id, y, x0, x1, unnest(range(x0, x1 + 1)) AS x FROM runs)), far AS (SELECT doc_id, y, x, h, unnest(range(1 - h, h)) AS dy FROM h) SELECT f.doc_id, f.y, f.x::INT AS x, min(abs(f.dy) + coalesce(o.h, 0)) AS distance FROM far f LEFT JOIN h o ON o.doc_id = f.doc_id AND o.y = f.y + f.dy AND o.x = f.x GROUP BY ALL")
def distance_capped(spark, sf_dir):
    return R.distance_capped(_ink(spark, sf_dir))


_THREE = ", ".join(f"[lag({c}, 1, {c}) OVER w, {c}, lead({c}, 1, {c}) OVER w] AS l{c}" for c in "rgb")
_NINE = ", ".join(f"list_sort(list_concat(list_concat(lag(l{c}, 1, l{c}) OVER u, l{c}), lead(l{c}, 1, l{c}) OVER u))[5] AS m{c}" for c in "rgb")


@query(A.with_views("src_px") + f""", h AS (SELECT doc_id, y, x, r, g, b, {_THREE} FROM src_px WINDOW w AS (PARTITION BY doc_id, y ORDER BY x)), m AS (SELECT doc_id, y, x, r, g, b, {_NINE} FROM h WINDOW u AS (PARTITION BY doc_id, x ORDER BY y)), d AS (SELECT *, greatest(abs(r - mr), abs(g - mg), abs(b - mb)) <= 18 AS k FROM m)
SELECT doc_id, y, x, CASE WHEN k THEN mr ELSE r END AS r, CASE WHEN k THEN mg ELSE g END AS g, CASE WHEN k THEN mb ELSE b END AS b FROM d""")
def denoise(spark, sf_dir):
    return R.denoise(A.src_px(spark, sf_dir))


_BORDER = """, bg AS (SELECT doc_id, quantile_cont(r, 0.5) AS bg_r, quantile_cont(g, 0.5) AS bg_g, quantile_cont(b, 0.5) AS bg_b FROM src_px WHERE y IN (0, 95) OR x IN (0, 95) GROUP BY doc_id),
noise AS (SELECT doc_id, quantile_cont(greatest(abs(r - bg_r), abs(g - bg_g), abs(b - bg_b)), 0.95) AS noise_p95 FROM src_px JOIN bg USING (doc_id) WHERE y IN (0, 95) OR x IN (0, 95) GROUP BY doc_id),
st AS (SELECT *, greatest(6, least(24, noise_p95 + 3)) AS threshold FROM bg JOIN noise USING (doc_id)),
raw AS (SELECT s.*, threshold, greatest(abs(r - bg_r), abs(g - bg_g), abs(b - bg_b)) AS strength FROM src_px s JOIN st USING (doc_id) WHERE greatest(abs(r - bg_r), abs(g - bg_g), abs(b - bg_b)) >= threshold),
sup AS (SELECT doc_id, y + dy AS y, x + dx AS x, count(*) AS n FROM raw, """ + _NEAR9 + """ GROUP BY ALL),
mask AS (SELECT raw.* FROM raw JOIN sup USING (doc_id, y, x) WHERE n >= 2 OR strength >= greatest(threshold * 1.75, threshold + 12))"""


@query(A.with_views("src_px") + _BORDER + " SELECT st.*, coalesce(n, 0) AS ink_pixels, round(coalesce(n, 0) / 9216, 6) AS ink_share FROM st LEFT JOIN (SELECT doc_id, count(*) AS n FROM mask GROUP BY doc_id) USING (doc_id)")
def ink_roi(spark, sf_dir):
    return C.ink_roi(A.src_px(spark, sf_dir), N, N)


_CELLS = _BORDER + f""", rink AS (SELECT r.* FROM ren_px r JOIN st USING (doc_id) WHERE greatest(abs(r - bg_r), abs(g - bg_g), abs(b - bg_b)) >= threshold),
moved AS (SELECT doc_id, y + dy AS y, x + dx AS x, r AS o_r, g AS o_g, b AS o_b FROM rink, {_NEAR9}),
best AS (SELECT m.doc_id, m.y, m.x, coalesce(min(greatest(abs(r - o_r), abs(g - o_g), abs(b - o_b))), 256)::DOUBLE AS error FROM mask m LEFT JOIN moved USING (doc_id, y, x) GROUP BY ALL),
credit AS (SELECT *, CASE WHEN error < 256 THEN 1.0::DOUBLE ELSE 0 END AS cover, greatest(0, least(1, 1 - error / 128)) AS colour FROM best),
agg AS (SELECT doc_id, y // 48 * 48 AS cell_y, x // 48 * 48 AS cell_x, count(*) AS ink_pixels, avg(cover) AS c, avg(colour) AS k FROM credit GROUP BY ALL),
cells AS (SELECT doc_id, cell_y, cell_x, ink_pixels, round(100 * (0.65 * c + 0.35 * k) + 1e-9, 3) AS score, round(100 * c + 1e-9, 3) AS coverage, round(100 * k + 1e-9, 3) AS colour, round(greatest(0, least(1, 1 - (0.65 * c + 0.35 * k))) + 1e-9, 3) AS severity FROM agg)"""


def _cells(spark, sf_dir):
    return C.detail_cells(A.src_px(spark, sf_dir), A.ren_px(spark, sf_dir), N, N)


@query(A.with_views("src_px", "ren_px") + _CELLS + " SELECT * FROM cells")
def detail_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


_GRID = ", grid AS (SELECT doc_id, count(*) AS cells, round(quantile_cont(score, 0.1) + 1e-9, 3) AS p10, round(quantile_cont(score, 0.5) + 1e-9, 3) AS median, min(score) AS worst, round(avg(score) + 1e-9, 3) AS mean FROM cells GROUP BY doc_id)"


@query(A.with_views("src_px", "ren_px") + _CELLS + _GRID + " SELECT * FROM grid")
def detail_grid(spark, sf_dir):
    return C.detail_grid(_cells(spark, sf_dir))


@query(A.with_views("src_px", "ren_px") + _CELLS + " SELECT doc_id, place, cell_y, cell_x, severity, ink_pixels FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY severity DESC, ink_pixels DESC, cell_y, cell_x) AS place FROM cells WHERE score < 78) WHERE place <= 40")
def hotspots(spark, sf_dir):
    return C.hotspots(_cells(spark, sf_dir))


@query(A.with_views("src_px", "ren_px") + _CELLS + _GRID + ", h AS (SELECT doc_id, count(*) AS hot FROM cells WHERE score < 78 GROUP BY doc_id) SELECT doc_id, cells, p10, mean, coalesce(hot, 0) AS hot, CASE WHEN p10 < 55 OR mean < 75 OR (p10 < 80 AND mean < 88) THEN 'rejected' WHEN p10 < 80 OR mean < 88 THEN 'manual_review' ELSE 'accepted' END AS status FROM grid LEFT JOIN h USING (doc_id)")
def detail_gate(spark, sf_dir):
    """Which documents lost detail, where, and do they pass?"""
    cells = written(_cells(spark, sf_dir))
    hot = C.hotspots(cells).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hot"))
    status = F.expr("CASE WHEN p10 < 55 OR mean < 75 OR (p10 < 80 AND mean < 88) THEN 'rejected' WHEN p10 < 80 OR mean < 88 THEN 'manual_review' ELSE 'accepted' END")
    return C.detail_grid(cells).join(hot, "doc_id", "left").select("doc_id", "cells", "p10", "mean", F.coalesce("hot", F.lit(0)).alias("hot"), status.alias("status"))


@query(A.with_views("src_px", "ren_px") + f" SELECT s.doc_id, count(*) AS pixels, round(100 * avg(greatest(0, 1 - {gap('s.', 'o.')} / 128)), 6) AS match FROM src_px s JOIN ren_px o USING (doc_id, y, x) GROUP BY s.doc_id")
def canvas_match(spark, sf_dir):
    return C.canvas_match(A.src_px(spark, sf_dir), A.ren_px(spark, sf_dir))


@query(A.with_views("src_px", "ren_px") + f""", edge AS (SELECT * FROM src_px WHERE y IN (0, 95) UNION ALL SELECT * FROM src_px WHERE x IN (0, 95)),
bg AS (SELECT doc_id, quantile_cont(r, 0.5) AS bg_r, quantile_cont(g, 0.5) AS bg_g, quantile_cont(b, 0.5) AS bg_b FROM edge GROUP BY doc_id),
st AS (SELECT doc_id, any_value(bg_r) AS bg_r, any_value(bg_g) AS bg_g, any_value(bg_b) AS bg_b, greatest(6, least(24, quantile_cont(greatest(abs(r - bg_r), abs(g - bg_g), abs(b - bg_b)), 0.95) + 3)) AS threshold FROM edge JOIN bg USING (doc_id) GROUP BY doc_id),
a AS (SELECT s.* FROM src_px s JOIN st USING (doc_id) WHERE greatest(abs(r - bg_r), abs(g - bg_g), abs(b - bg_b)) >= threshold), b AS (SELECT s.* FROM ren_px s JOIN st USING (doc_id) WHERE greatest(abs(r - bg_r), abs(g - bg_g), abs(b - bg_b)) >= threshold),
ma AS (SELECT doc_id, a.y, a.x, coalesce(min({gap('a.', 'm.')}), 256) AS e FROM a LEFT JOIN (SELECT b.*, y + dy AS ny, x + dx AS nx FROM b, {_NEAR9}) m ON m.doc_id = a.doc_id AND m.ny = a.y AND m.nx = a.x GROUP BY a.doc_id, a.y, a.x),
mb AS (SELECT doc_id, b.y, b.x, coalesce(min({gap('b.', 'm.')}), 256) AS e FROM b LEFT JOIN (SELECT a.*, y + dy AS ny, x + dx AS nx FROM a, {_NEAR9}) m ON m.doc_id = b.doc_id AND m.ny = b.y AND m.nx = b.x GROUP BY b.doc_id, b.y, b.x),
sa AS (SELECT doc_id, count(*) AS src_ink, avg((e < 256)::INT) AS rc, avg(greatest(0, 1 - e / 128)) AS q, avg(greatest(0, 1 - e / 128)) FILTER (e < 256) AS n1 FROM ma GROUP BY doc_id),
sb AS (SELECT doc_id, count(*) AS ren_ink, avg((e < 256)::INT) AS pc, avg(greatest(0, 1 - e / 128)) FILTER (e < 256) AS n2 FROM mb GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(src_ink, 0) AS src_ink, coalesce(ren_ink, 0) AS ren_ink, rc, coalesce(pc, 0) AS pc, q, n1, n2, CASE WHEN rc + coalesce(pc, 0) > 0 THEN 2 * rc * coalesce(pc, 0) / (rc + coalesce(pc, 0)) ELSE 0 END AS f1 FROM st LEFT JOIN sa USING (doc_id) LEFT JOIN sb USING (doc_id))
SELECT doc_id, src_ink, ren_ink, CASE WHEN src_ink > 0 THEN round(rc * 100, 6) END AS recall, CASE WHEN src_ink > 0 THEN round(pc * 100, 6) END AS precision, CASE WHEN src_ink > 0 THEN round(f1 * 100, 6) END AS coverage_f1,
CASE WHEN src_ink > 0 THEN round(coalesce((coalesce(n1, 0) + coalesce(n2, 0)) / nullif((n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT, 0), 0) * 100, 6) END AS color_fidelity, CASE WHEN src_ink > 0 THEN round(100 * (0.65 * f1 + 0.35 * q), 6) END AS score FROM f""".replace("SELECT doc_id, a.y", "SELECT a.doc_id, a.y").replace("SELECT doc_id, b.y", "SELECT b.doc_id, b.y"))
def foreground_match(spark, sf_dir):
    return C.foreground_match(A.src_px(spark, sf_dir), A.ren_px(spark, sf_dir), N, N)


def _topology(spark, sf_dir):
    return C.component_topology(A.src_px(spark, sf_dir), A.ren_px(spark, sf_dir), N, N)


@query()
def component_topology(spark, sf_dir):
    return _topology(spark, sf_dir)


@query()
def topology_summary(spark, sf_dir):
    return C.topology_summary(_topology(spark, sf_dir))


@query()
def worst_components(spark, sf_dir):
    return C.worst_components(_topology(spark, sf_dir))


@query(A.with_views("src_px", "ren_px") + f" SELECT s.doc_id, round(avg(({gap('s.', 'o.')} > 8)::INT), 6) AS changed, avg(({gap('s.', 'o.')} > 8)::INT) <= 0.01 AS accepted FROM src_px s JOIN ren_px o USING (doc_id, y, x) GROUP BY s.doc_id")
def pair_gate(spark, sf_dir):
    return C.pair_gate(A.src_px(spark, sf_dir), A.ren_px(spark, sf_dir), 8)


@query(A.with_views("src_px", "ren_px") + f""", ch AS (SELECT s.doc_id, s.y, s.x FROM src_px s JOIN ren_px o USING (doc_id, y, x) WHERE {gap('s.', 'o.')} > 0), box AS (SELECT doc_id, cx - rad AS x0, cy - rad AS y0, cx + rad AS x1, cy + rad AS y1 FROM shapes WHERE z % 7 = 3),
o AS (SELECT * FROM ch WHERE NOT EXISTS (SELECT 1 FROM box WHERE box.doc_id = ch.doc_id AND x BETWEEN x0 - 2 AND x1 + 2 AND y BETWEEN y0 - 2 AND y1 + 2))
SELECT doc_id, changed, coalesce(outside, 0) AS outside FROM (SELECT doc_id, count(*) AS changed FROM ch GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS outside FROM o GROUP BY doc_id) USING (doc_id)""")
def changes_outside(spark, sf_dir):
    boxes = A.shapes(spark, sf_dir).filter("z % 7 = 3").selectExpr("doc_id", "cx - rad AS x0", "cy - rad AS y0", "cx + rad AS x1", "cy + rad AS y1")
    return C.changes_outside(A.src_px(spark, sf_dir), A.ren_px(spark, sf_dir), boxes)


@query(A.with_views("src_px") + " SELECT doc_id, r, g, b, count(*) AS w FROM src_px WHERE a > 0 GROUP BY ALL")
def color_histogram(spark, sf_dir):
    return P.color_histogram(A.src_px(spark, sf_dir))


_LABEL = """, lab AS (SELECT h.doc_id, h.r, h.g, h.b, w, arg_min({'k': k, 'pr': p.r, 'pg': p.g, 'pb': p.b}, ((h.r - p.r) ** 2 + (h.g - p.g) ** 2 + (h.b - p.b) ** 2, k)) AS m, min((h.r - p.r) ** 2 + (h.g - p.g) ** 2 + (h.b - p.b) ** 2) AS d2 FROM hist_li h JOIN pal p USING (doc_id) GROUP BY ALL)"""


def _labelled(spark, sf_dir):
    hist = A.hist_li(spark, sf_dir)
    return P.nearest_label(hist, A.palette_of(hist))


@query(A.with_views("pal") + _LABEL + " SELECT doc_id, r, g, b, w, m.k AS k, d2 FROM lab")
def nearest_label(spark, sf_dir):
    return _labelled(spark, sf_dir).drop("p_r", "p_g", "p_b")


@query(A.with_views("pal") + _LABEL + " SELECT doc_id, r, g, b, w, CASE WHEN d2 <= 2304 THEN m.pr ELSE r END::INT AS to_r, CASE WHEN d2 <= 2304 THEN m.pg ELSE g END::INT AS to_g, CASE WHEN d2 <= 2304 THEN m.pb ELSE b END::INT AS to_b FROM lab")
def snap_to_palette(spark, sf_dir):
    hist = A.hist_li(spark, sf_dir)
    return P.snap_to_palette(hist, A.palette_of(hist))


@query(A.with_views("pal") + _LABEL + " SELECT doc_id, m.k AS k, sum(w)::BIGINT AS w, round(sum(w) / sum(sum(w)) OVER (PARTITION BY doc_id), 6) AS share FROM lab GROUP BY doc_id, m.k")
def cluster_shares(spark, sf_dir):
    return P.cluster_shares(_labelled(spark, sf_dir))


@query(A.with_views("pal") + _LABEL + """, e AS (SELECT doc_id, sqrt(d2) AS e, sum(w) AS w FROM lab GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY e) AS run, sum(w) OVER (PARTITION BY doc_id) AS total FROM e)
SELECT doc_id, round(sum(e * w) / sum(w), 3) AS mean, round(sum(CASE WHEN e > 25 THEN w ELSE 0 END) / sum(w), 4) AS over_25_share, round(min(e) FILTER (run >= 0.9 * total), 3) AS p90, round(min(e) FILTER (run >= 0.95 * total), 3) AS p95 FROM c GROUP BY doc_id""")
def palette_fit(spark, sf_dir):
    return P.palette_fit(_labelled(spark, sf_dir))


@query(A.with_views("hist_li") + " SELECT doc_id, min(r) AS value FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY r) AS run, sum(w) OVER (PARTITION BY doc_id) AS total FROM hist_li) WHERE run >= 0.75 * total GROUP BY doc_id")
def weighted_quantile(spark, sf_dir):
    return P.weighted_quantile(A.hist_li(spark, sf_dir), "r", "w", 0.75)


@query(A.with_views("hist_li") + """, k AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM hist_li), h AS (SELECT *, hi / 255 AS v, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS s, CASE WHEN hi = lo THEN NULL WHEN hi = r THEN (60 * (g - b) / (hi - lo) + 360) % 360 WHEN hi = g THEN 60 * (b - r) / (hi - lo) + 120 ELSE 60 * (r - g) / (hi - lo) + 240 END AS hue FROM k)
SELECT doc_id, CASE WHEN v < 0.18 THEN 'black' WHEN s < 0.12 AND v > 0.9 THEN 'white' WHEN s < 0.15 THEN 'gray' WHEN hue < 15 THEN 'red' WHEN hue < 45 THEN 'orange' WHEN hue < 70 THEN 'yellow' WHEN hue < 95 THEN 'yellow-green' WHEN hue < 160 THEN 'green' WHEN hue < 200 THEN 'cyan' WHEN hue < 255 THEN 'blue' WHEN hue < 290 THEN 'purple' WHEN hue < 340 THEN 'magenta' WHEN hue < 360 THEN 'red' ELSE 'color' END AS name, count(*) AS colours, sum(w)::BIGINT AS w FROM h GROUP BY ALL""")
def color_names(spark, sf_dir):
    return A.hist_li(spark, sf_dir).groupBy("doc_id", P.color_name(F.col("r"), F.col("g"), F.col("b")).alias("name")).agg(F.count(F.lit(1)).alias("colours"), F.sum("w").alias("w"))


@query(A.with_views("pal") + """, lin AS (SELECT doc_id, k, CASE WHEN r / 255 <= 0.04045 THEN r / 255 / 12.92 ELSE ((r / 255 + 0.055) / 1.055) ** 2.4 END AS x, CASE WHEN g / 255 <= 0.04045 THEN g / 255 / 12.92 ELSE ((g / 255 + 0.055) / 1.055) ** 2.4 END AS y, CASE WHEN b / 255 <= 0.04045 THEN b / 255 / 12.92 ELSE ((b / 255 + 0.055) / 1.055) ** 2.4 END AS z FROM pal),
c AS (SELECT doc_id, k, cbrt(0.4122214708::DOUBLE * x + 0.5363325363::DOUBLE * y + 0.0514459929::DOUBLE * z) AS l, cbrt(0.2119034982::DOUBLE * x + 0.6806995451::DOUBLE * y + 0.1073969566::DOUBLE * z) AS m, cbrt(0.0883024619::DOUBLE * x + 0.2817188376::DOUBLE * y + 0.6299787005::DOUBLE * z) AS s FROM lin),
o AS (SELECT doc_id, k, 0.2104542553::DOUBLE * l + 0.7936177850::DOUBLE * m - 0.0040720468::DOUBLE * s AS lightness, 1.9779984951::DOUBLE * l - 2.4285922050::DOUBLE * m + 0.4505937099::DOUBLE * s AS a, 0.0259040371::DOUBLE * l + 0.7827717662::DOUBLE * m - 0.8086757660::DOUBLE * s AS bb FROM c)
SELECT doc_id, k, round(lightness, 5) AS lightness, round(sqrt(a * a + bb * bb), 5) AS chroma, CASE WHEN sqrt(a * a + bb * bb) > 0.001 THEN round((degrees(atan2(bb, a)) + 360) % 360, 3) END AS hue FROM o""")
def oklch(spark, sf_dir):
    c = P.oklch(F.col("r"), F.col("g"), F.col("b"))
    rows = A.palette_of(A.hist_li(spark, sf_dir)).withColumn("c", c)
    return rows.select("doc_id", "k", F.round("c.lightness", 5).alias("lightness"), F.round("c.chroma", 5).alias("chroma"), F.when(F.col("c.chroma") > 0.001, F.round("c.hue", 3)).alias("hue"))


@query()
def bounded_sample(spark, sf_dir):
    return P.bounded_sample(A.hist_li(spark, sf_dir), 2000)


@query()
def weighted_kmeans(spark, sf_dir):
    return P.weighted_kmeans(written(A.hist_li(spark, sf_dir)), 4)


@query()
def merge_close(spark, sf_dir):
    hist = written(A.hist_li(spark, sf_dir))
    pal = A.palette_of(hist)
    return P.merge_close(pal, hist, limit=90.0)


@query(A.with_views("pal") + _LABEL + """, sh AS (SELECT doc_id, m.k AS k, round(sum(w) / sum(sum(w)) OVER (PARTITION BY doc_id), 6) AS share FROM lab GROUP BY doc_id, m.k), p AS (SELECT * FROM pal JOIN sh USING (doc_id, k)),
t AS (SELECT p.doc_id, p.k, p.share, p.r, p.g, p.b, a.r AS ar, a.g AS ag, a.b AS ab, b.r AS br, b.g AS bg, b.b AS bb FROM p JOIN p a ON a.doc_id = p.doc_id AND a.k <> p.k AND a.share >= 3 * p.share JOIN p b ON b.doc_id = p.doc_id AND b.k <> p.k AND a.k < b.k AND b.share >= 3 * p.share WHERE p.share < 0.035),
s AS (SELECT *, greatest(0, least(1, ((r - ar) * (br - ar) + (g - ag) * (bg - ag) + (b - ab) * (bb - ab)) / nullif((br - ar) ** 2 + (bg - ag) ** 2 + (bb - ab) ** 2, 0))) AS u FROM t),
d AS (SELECT *, sqrt((r - (ar + u * (br - ar))) ** 2 + (g - (ag + u * (bg - ag))) ** 2 + (b - (ab + u * (bb - ab))) ** 2) AS gap FROM s)
SELECT doc_id, k, round(min(gap), 6) AS gap, any_value(share) AS share FROM d WHERE gap < 28 GROUP BY doc_id, k""")
def prune_blends(spark, sf_dir):
    hist = written(A.hist_li(spark, sf_dir))
    pal = A.palette_of(hist)
    return P.prune_blends(pal, P.cluster_shares(P.nearest_label(hist, pal)))


@query(A.with_views("pal") + _LABEL + f""", sh AS (SELECT doc_id, m.k AS k, round(sum(w) / sum(sum(w)) OVER (PARTITION BY doc_id), 6) AS share FROM lab GROUP BY doc_id, m.k), heavy AS (SELECT * FROM sh JOIN pal USING (doc_id, k) WHERE share >= 0.01)
SELECT doc_id, k, r, g, b, share FROM heavy h WHERE NOT EXISTS (SELECT 1 FROM pal e WHERE e.k < 3 AND e.doc_id = h.doc_id AND {gap('h.', 'e.')} <= 75)
AND NOT EXISTS (SELECT 1 FROM (SELECT h.doc_id, h.k FROM heavy h JOIN pal a ON a.doc_id = h.doc_id AND a.k < 3 JOIN pal b ON b.doc_id = h.doc_id AND b.k < 3 AND a.k < b.k WHERE {_BESIDE} < 35 * 35) c WHERE c.doc_id = h.doc_id AND c.k = h.k)""")
def lost_colors(spark, sf_dir):
    hist = written(A.hist_li(spark, sf_dir))
    pal = A.palette_of(hist)
    return P.lost_colors(hist, pal, pal.filter("k < 3"))


@query(A.with_views("pal") + """, cur AS (SELECT h.doc_id, h.r, h.g, h.b, w, sqrt(min((h.r - p.r) ** 2 + (h.g - p.g) ** 2 + (h.b - p.b) ** 2)) AS now FROM hist_li h JOIN pal p ON p.doc_id = h.doc_id AND p.k < 3 GROUP BY ALL),
gain AS (SELECT c.*, m.k, now - sqrt((c.r - m.r) ** 2 + (c.g - m.g) ** 2 + (c.b - m.b) ** 2) AS gain FROM cur c JOIN pal m ON m.doc_id = c.doc_id AND m.k >= 3), best AS (SELECT * FROM gain WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, r, g, b ORDER BY gain DESC, k) = 1)
SELECT doc_id, k, sum(w)::BIGINT AS w, round(sum(gain * w), 3) AS gain FROM best GROUP BY ALL""")
def unique_color_gain(spark, sf_dir):
    hist = written(A.hist_li(spark, sf_dir))
    pal = A.palette_of(hist)
    return P.unique_color_gain(hist, pal.filter("k < 3"), pal.filter("k >= 3"))


@query(A.with_views("src_px") + f""", l AS (SELECT *, r // 64 * 16 + g // 64 * 4 + b // 64 AS lab FROM src_px), both_ AS (SELECT a.doc_id, least(a.lab, o.lab) AS lo, greatest(a.lab, o.lab) AS hi, ({gap('a.', 'o.')} < 30)::INT AS smooth FROM l a JOIN l o ON o.doc_id = a.doc_id AND ((o.y = a.y AND o.x = a.x + 1) OR (o.y = a.y + 1 AND o.x = a.x)) WHERE a.lab <> o.lab)
SELECT doc_id, lo, hi, count(*) AS contacts, round(avg(smooth), 6) AS smooth FROM both_ GROUP BY ALL""")
def region_adjacency(spark, sf_dir):
    return P.region_adjacency(A.src_px(spark, sf_dir).withColumn("lab", F.expr("r div 64 * 16 + g div 64 * 4 + b div 64")), "lab")


@query(A.with_views("src_px") + " SELECT doc_id, round(sum((a < 10)::INT * n) / sum(n), 6) AS transparent, round(sum((least(r, g, b) >= 220)::INT * n) / sum(n), 6) AS light FROM (SELECT *, (y IN (0, 95))::INT + (x IN (0, 95))::INT AS n FROM src_px) WHERE n > 0 GROUP BY doc_id")
def border_ratios(spark, sf_dir):
    return P.border_ratios(A.src_px(spark, sf_dir), N, N)


@query(A.with_views("src_px") + " SELECT doc_id, place, n, share, m_r, m_g, m_b FROM (SELECT doc_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 6) AS share, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, r // 8, g // 8, b // 8) AS place, quantile_cont(r, 0.5) AS m_r, quantile_cont(g, 0.5) AS m_g, quantile_cont(b, 0.5) AS m_b FROM src_px WHERE y IN (0, 95) OR x IN (0, 95) GROUP BY doc_id, r // 8, g // 8, b // 8) WHERE place <= 6 AND share >= 0.01")
def border_colors(spark, sf_dir):
    return P.border_colors(A.src_px(spark, sf_dir), N, N)


@query(A.with_views("src_px") + " SELECT doc_id, r, g, b, round(CASE WHEN o >= 0.985 THEN 1.0 ELSE o END, 6) AS opacity FROM (SELECT doc_id, r, g, b, quantile_cont(a - x, 0.75) / 255 AS o FROM src_px GROUP BY ALL) WHERE o >= 0.02")
def paint_opacity(spark, sf_dir):
    return P.paint_opacity(A.src_px(spark, sf_dir).withColumn("a", F.expr("a - x")))


@query(A.with_views("ramp_px") + " SELECT doc_id, count(*) AS pixels, " + ", ".join(f"round((s(x,{c}) * syy - s(y,{c}) * sxy) / (sxx * syy - sxy * sxy), 6) AS slope_x_{c}, round((s(y,{c}) * sxx - s(x,{c}) * sxy) / (sxx * syy - sxy * sxy), 6) AS slope_y_{c}".replace(f"s(x,{c})", f"(covar_pop(x, {c}) * count(*))").replace(f"s(y,{c})", f"(covar_pop(y, {c}) * count(*))").replace("sxx", "(var_pop(x) * count(*))").replace("syy", "(var_pop(y) * count(*))").replace("sxy", "(covar_pop(x, y) * count(*))") for c in "rgb") + " FROM ramp_px GROUP BY doc_id")
def plane_fit(spark, sf_dir):
    return P.plane_fit(A.ramp_px(spark, sf_dir))


@query()
def farthest_colors(spark, sf_dir):
    return P.farthest_colors(A.palette_of(A.hist_li(spark, sf_dir)), 4)

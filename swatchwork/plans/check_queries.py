"""Queries of element, group and circle checks, over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from swatchwork.operators import audits as Q
from swatchwork.operators import checks as K
from swatchwork.operators import documents as D
from swatchwork.plans.pixel_queries import _CELLS, _COMPS, _NEAR9, N
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


@query(A.with_views("shapes") + """, c AS (SELECT doc_id, z, cx, cy, cx + z % 3 AS ax, cy + z % 3 + CASE WHEN z % 5 = 0 THEN 1 ELSE 0 END AS ay, cx + (z % 7) * 2 AS bx, cy + (z % 7) * 2 AS by, cx + 9 AS ex, cy + 9 AS ey FROM shapes)
SELECT doc_id, z AS idx, (ay - cy = ax - cx) AND z % 3 <= z % 7 * 2 AND z % 7 * 2 <= 9 AS straight FROM c""")
def straight_cubics(spark, sf_dir):
    c = A.shapes(spark, sf_dir).selectExpr("doc_id", "z", *(f"cast({e} AS decimal(12, 3)) AS p{k}" for k, e in enumerate(
        ("cx", "cy", "cx + z % 3", "cy + z % 3 + if(z % 5 = 0, 1, 0)", "cx + z % 7 * 2", "cy + z % 7 * 2", "cx + 9", "cy + 9"))))
    return c.select("doc_id", F.col("z").alias("idx"), K.is_straight_cubic(*(F.col(f"p{k}") for k in range(8))).alias("straight"))


@query(A.with_views("el") + """, n AS (SELECT doc_id, idx, id, 2 + (idx % 4 = 1)::INT AS points FROM el WHERE tag = 'path' AND stroke <> 'none' AND style IS NULL AND idx % 7 <> 0 AND idx % 5 <> 0), used AS (SELECT DISTINCT doc_id, 'e' || (idx % 5) AS id FROM el)
SELECT doc_id, idx, CASE WHEN points = 2 THEN 'line' ELSE 'polyline' END AS kind, points FROM n WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = n.doc_id AND u.id = n.id)""")
def exact_lines(spark, sf_dir):
    """Paths of one or two straight commands; every fifth is closed, every seventh turned."""
    el = A.elements(spark, sf_dir)
    paths = el.filter("tag = 'path'").selectExpr("doc_id", "idx", "concat('M', x0, ' ', y0, ' L', x1, ' ', y1, if(idx % 4 = 1, ' h5', ''), if(idx % 5 = 0, ' z', '')) AS d")
    drawn = el.select("doc_id", "idx", "tag", "id", F.lit("none").alias("fill"), "stroke", "style", F.expr("if(idx % 7 = 0, 'rotate(5)', NULL)").alias("transform"))
    return K.exact_lines(drawn, D.path_segments(paths), el.selectExpr("doc_id", "concat('e', idx % 5) AS ref"))


@query(A.with_views("shapes") + """, t AS (SELECT doc_id, z AS idx, CASE WHEN z % 4 IN (0, 3) THEN [cx, cy, rad, rad + 1]::DOUBLE[] WHEN z % 4 = 1 THEN [0, 0, cx, rad]::DOUBLE[] END AS v, z % 4 = 1 AND cx = 0 AS bad FROM shapes)
SELECT doc_id, idx, CASE WHEN bad THEN NULL ELSE v[1] END AS x, CASE WHEN bad THEN NULL ELSE v[2] END AS y, CASE WHEN bad THEN NULL ELSE v[3] END AS w, CASE WHEN bad THEN NULL ELSE v[4] END AS h, coalesce(CASE WHEN bad THEN NULL ELSE v[3] END, 1) AS unit_w FROM t""")
def canvas_of(spark, sf_dir):
    s = A.shapes(spark, sf_dir).selectExpr("doc_id", "z AS idx", "CASE z % 4 WHEN 0 THEN concat_ws(' ', cx, cy, rad, rad + 1) WHEN 1 THEN '0 0 0 5' WHEN 3 THEN concat_ws(', ', cx, cy, rad, rad + 1) END AS box", "if(z % 4 = 1, concat(cx, 'px'), NULL) AS w", "concat(rad, 'px') AS h")
    s = s.select("doc_id", "idx", K.canvas_of(F.col("box"), F.col("w"), F.col("h")).alias("c"), K.canvas_of(F.col("box"), F.col("w"), F.col("h"), unit=True).alias("u"))
    return s.select("doc_id", "idx", "c.x", "c.y", "c.w", "c.h", F.col("u.w").alias("unit_w"))


@query(A.with_views("el") + """, t AS (SELECT doc_id, idx, CASE WHEN idx > 0 THEN idx // 3 END AS parent_idx, CASE WHEN idx % 13 = 5 THEN 'defs' ELSE tag END AS tag, id, CASE WHEN idx % 6 = 1 THEN 'url(#g' || (idx % 4) || ')' ELSE coalesce(fill, '#000000') END AS fill, CASE WHEN idx % 3 = 0 THEN stroke ELSE 'none' END AS stroke, (idx % 11 = 7)::INT AS unsafe, (idx % 13 = 5)::INT AS hidden FROM el),
up(doc_id, idx, above, hidden, unsafe) AS (SELECT doc_id, idx, parent_idx, 0, unsafe FROM t WHERE tag = 'path' UNION ALL SELECT up.doc_id, up.idx, t.parent_idx, greatest(up.hidden, t.hidden), greatest(up.unsafe, t.unsafe) FROM up JOIN t ON t.doc_id = up.doc_id AND t.idx = up.above)
SELECT doc_id, t.idx, CASE WHEN up.hidden = 1 THEN 'not_rendered' WHEN up.unsafe = 1 THEN 'unsafe_attribute' WHEN stroke <> 'none' THEN 'stroked' WHEN fill LIKE 'url%' AND idx % 4 <> 1 THEN 'unsafe_paint' WHEN id IN ('e1', 'e2') THEN 'referenced' END AS reason FROM t JOIN up USING (doc_id, idx) WHERE above IS NULL""")
def splittable(spark, sf_dir):
    el = A.elements(spark, sf_dir).selectExpr(
        "doc_id", "idx", "if(idx > 0, idx div 3, NULL) AS parent_idx", "if(idx % 13 = 5, 'defs', tag) AS tag", "id", "if(idx % 6 = 1, concat('url(#g', idx % 4, ')'), fill) AS fill", "if(idx % 3 = 0, stroke, 'none') AS stroke",
        "if(idx % 11 = 7, array('d', 'onclick'), array('d')) AS attributes",
    )
    docs = el.select("doc_id").distinct()
    return K.splittable(el, docs.selectExpr("doc_id", "explode(array('e1', 'e2')) AS ref"), docs.selectExpr("doc_id", "inline(array(struct('g1' AS id, true AS is_safe), struct('g3' AS id, false AS is_safe)))"))


_SEGS = """, s AS (SELECT doc_id, z AS seg, ['line', 'quad', 'cubic', 'arc'][z % 4 + 1] AS kind, CASE WHEN z % 4 = 3 THEN [cx, cy, 3.0 * rad, 2.0 * rad, z, 90 + cx, 0, 0] ELSE [cx, cy, cy, cx, 2.0 * cx, cy + 5, cx + 40.0, cy + 30] END::DOUBLE[] AS p FROM shapes),
l AS (SELECT *, sqrt((p[3] - p[1]) ** 2 + (p[4] - p[2]) ** 2) AS a, sqrt((p[5] - p[3]) ** 2 + (p[6] - p[4]) ** 2) AS b, sqrt((p[7] - p[5]) ** 2 + (p[8] - p[6]) ** 2) AS c FROM s),
n AS (SELECT *, CASE kind WHEN 'line' THEN greatest(1, ceil(a / 5)) WHEN 'quad' THEN least(512, greatest(2, ceil((a + b) / 5))) WHEN 'cubic' THEN least(512, greatest(3, ceil((a + b + c) / 5))) ELSE least(512, greatest(2, ceil(greatest(p[3], p[4]) * radians(abs(p[6])) / 5))) END::INT AS n FROM l),
k AS (SELECT *, k / n AS t, 1 - k / n AS u FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM n))
SELECT doc_id, seg, k::INT AS k, round(CASE kind WHEN 'line' THEN u * p[1] + t * p[3] WHEN 'quad' THEN u * u * p[1] + 2 * u * t * p[3] + t * t * p[5] WHEN 'cubic' THEN u * u * u * p[1] + 3 * u * u * t * p[3] + 3 * u * t * t * p[5] + t * t * t * p[7] ELSE p[1] + p[3] * cos(radians(p[5] + p[6] * t)) END + 1e-9, 4) AS x,
round(CASE kind WHEN 'line' THEN u * p[2] + t * p[4] WHEN 'quad' THEN u * u * p[2] + 2 * u * t * p[4] + t * t * p[6] WHEN 'cubic' THEN u * u * u * p[2] + 3 * u * u * t * p[4] + 3 * u * t * t * p[6] + t * t * t * p[8] ELSE p[2] + p[4] * sin(radians(p[5] + p[6] * t)) END + 1e-9, 4) AS y FROM k"""


@query(A.with_views("shapes") + _SEGS)
def sample_path(spark, sf_dir):
    p = "CASE WHEN z % 4 = 3 THEN array(cx, cy, 3 * rad, 2 * rad, z, 90 + cx, 0, 0) ELSE array(cx, cy, cy, cx, 2 * cx, cy + 5, cx + 40, cy + 30) END"
    return K.sample_path(A.shapes(spark, sf_dir).selectExpr("doc_id", "z AS seg", "element_at(array('line', 'quad', 'cubic', 'arc'), z % 4 + 1) AS kind", f"cast({p} AS array<double>) AS p"), 5.0)


_MASS = f""", both_ AS (SELECT doc_id, y, x, r, g, b, 0 AS side FROM mask UNION ALL SELECT doc_id, y, x, r, g, b, 1 FROM rink), far AS (SELECT doc_id, y + dy AS y, x + dx AS x, side, dy = 0 AND dx = 0 AS own, round_even(bg_r, 0) - r AS vr, round_even(bg_g, 0) - g AS vg, round_even(bg_b, 0) - b AS vb FROM both_ JOIN st USING (doc_id), {_NEAR9}),
cell AS (SELECT doc_id, y, x, greatest(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS n, bool_or(own AND side = 0) AS s, bool_or(own AND side = 1) AS t, sum(CASE WHEN side = 0 THEN vr ELSE -vr END) AS dr, sum(CASE WHEN side = 0 THEN vg ELSE -vg END) AS dg, sum(CASE WHEN side = 0 THEN vb ELSE -vb END) AS db FROM far GROUP BY ALL),
sim AS (SELECT *, greatest(0, 1 - greatest(abs(dr), abs(dg), abs(db)) / n / 128) AS sim FROM cell)
SELECT doc_id, count(*) FILTER (s) AS src_ink, count(*) FILTER (t) AS ren_ink, round(100 * avg(sim) FILTER (s) + 1e-9, 3) AS src_match, round(100 * avg(sim) FILTER (t) + 1e-9, 3) AS ren_match FROM sim GROUP BY doc_id"""


@query(A.with_views("src_px", "ren_px") + _CELLS + _MASS)
def ink_mass_match(spark, sf_dir):
    return K.ink_mass_match(A.src_px(spark, sf_dir), A.ren_px(spark, sf_dir), N, N)


_DOTS = """, c AS (SELECT doc_id, z, CASE WHEN z % 10 = 0 THEN 48.0 + z // 20 ELSE cx END::DOUBLE AS cx, CASE WHEN z % 10 = 0 THEN 48.0 ELSE cy END::DOUBLE AS cy, CASE WHEN z % 10 = 0 THEN 60.0 ELSE rad END::DOUBLE AS rad, b AS paint FROM shapes),
top AS (SELECT doc_id, max(rad) AS rmax, arg_max({'x': cx, 'y': cy}, (rad, z)) AS main FROM c GROUP BY doc_id),
big AS (SELECT doc_id, any_value(rmax) AS rmax, any_value(main) AS main, count(*) AS large, avg(cx) AS ux, avg(cy) AS uy, greatest(max(cx) - min(cx), max(cy) - min(cy)) AS spread FROM c JOIN top USING (doc_id) WHERE rad >= 0.35 * rmax GROUP BY doc_id),
mid AS (SELECT doc_id, rmax, large, large >= 2 AND spread <= greatest(0.02 * rmax, 3) AS concentric, CASE WHEN large >= 2 AND spread <= greatest(0.02 * rmax, 3) THEN ux ELSE main.x END AS mx, CASE WHEN large >= 2 AND spread <= greatest(0.02 * rmax, 3) THEN uy ELSE main.y END AS my FROM big),
d0 AS (SELECT c.*, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) AS orbit, degrees(atan2(cy - my, cx - mx)) AS a, rmax FROM c JOIN mid USING (doc_id) WHERE rad <= 0.18 * rmax),
d1 AS (SELECT *, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS angle FROM d0 WHERE orbit BETWEEN 0.25 * rmax AND 1.05 * rmax),
d2 AS (SELECT *, CASE WHEN angle - lag(angle) OVER w <= 6 THEN 0 ELSE 1 END AS fresh FROM d1 WINDOW w AS (PARTITION BY doc_id ORDER BY angle, z)),
d3 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY angle, z) AS cluster FROM d2),
d4 AS (SELECT *, max(cluster) OVER w AS last, min(angle) OVER w + 360 - max(angle) OVER w <= 6 AS wraps FROM d3 WINDOW w AS (PARTITION BY doc_id)),
d5 AS (SELECT doc_id, orbit, rad, paint, CASE WHEN last > 1 AND wraps AND cluster = last THEN angle - 360 ELSE angle END AS angle, CASE WHEN last > 1 AND wraps AND cluster = last THEN 1 ELSE cluster END AS cluster FROM d4),
m AS (SELECT doc_id, cluster, avg(angle) AS a FROM d5 GROUP BY ALL), e AS (SELECT doc_id, radians(a - (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1) * (360 / count(*) OVER (PARTITION BY doc_id))) AS rest FROM m),
ph AS (SELECT doc_id, count(*) AS clusters, atan2(sum(sin(rest)), sum(cos(rest))) AS phase FROM e GROUP BY doc_id),
tu AS (SELECT doc_id, clusters, round(max(abs(g - 360 * floor(g / 360) - 180)), 4) AS max_dev FROM (SELECT doc_id, clusters, degrees(rest - phase) + 180 AS g FROM e JOIN ph USING (doc_id)) GROUP BY ALL),
ri AS (SELECT doc_id, count(*) AS dots, (max(orbit) - min(orbit)) / avg(orbit) AS swing FROM d5 GROUP BY doc_id),
si AS (SELECT doc_id, sum(n)::BIGINT AS same_size FROM (SELECT doc_id, count(*) AS n FROM d5 GROUP BY doc_id, paint HAVING (max(rad) - min(rad)) / avg(rad) <= 0.18) GROUP BY doc_id)
SELECT doc_id, large, concentric, coalesce(dots, 0) AS dots, coalesce(clusters, 0) AS clusters, CASE WHEN clusters >= 5 AND dots >= 5 THEN max_dev END AS max_dev, CASE WHEN clusters >= 5 AND dots >= 5 THEN max_dev <= 4 END AS even_angles, CASE WHEN clusters >= 5 AND dots >= 5 THEN swing <= 0.06 END AS even_orbit, CASE WHEN clusters >= 5 AND dots >= 5 THEN coalesce(same_size, 0) END AS same_size
FROM mid LEFT JOIN tu USING (doc_id) LEFT JOIN ri USING (doc_id) LEFT JOIN si USING (doc_id)"""


@query(A.with_views("shapes") + _DOTS)
def concentric_dots(spark, sf_dir):
    """Every tenth part is a large circle, the others are dots."""
    c = A.shapes(spark, sf_dir).selectExpr("doc_id", "z", "cast(if(z % 10 = 0, 48 + z div 20, cx) AS double) AS cx", "cast(if(z % 10 = 0, 48, cy) AS double) AS cy", "cast(if(z % 10 = 0, 60, rad) AS double) AS rad", "b AS paint")
    return K.concentric_dots(c)


_OPEN = ", enc AS (SELECT doc_id, y, x FROM src_px WHERE (y - 48) * (y - 48) + (x - 48) * (x - 48) <= 1600), ink AS (SELECT doc_id, y, x FROM src_px WHERE (y - 48) * (y - 48) + (x - 48) * (x - 48) <= 1600 AND r = 255 AND g = 255 AND b = 255), "


@query(A.with_views("src_px") + _OPEN + _COMPS.replace("{reach}", "1") + f""", n9 AS (SELECT doc_id, y + dy AS y, x + dx AS x, count(*) AS n FROM enc, {_NEAR9} GROUP BY ALL), band AS (SELECT doc_id, y, x FROM enc JOIN n9 USING (doc_id, y, x) WHERE n < 9),
e AS (SELECT doc_id, count(*) AS e_area, max(x) - min(x) + 1 AS e_w, max(y) - min(y) + 1 AS e_h FROM enc GROUP BY doc_id), bn AS (SELECT doc_id, count(*) AS edge FROM band GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS total FROM ink GROUP BY doc_id),
p AS (SELECT doc_id, comp_id, sum(x1 - x0 + 1)::BIGINT AS area, max(x1) - min(x0) + 1 AS bw, max(y) - min(y) + 1 AS bh FROM comp GROUP BY ALL), o AS (SELECT c.doc_id, comp_id, count(*) AS on_edge FROM comp c JOIN band b ON b.doc_id = c.doc_id AND b.y = c.y AND b.x BETWEEN c.x0 AND c.x1 GROUP BY ALL),
a AS (SELECT *, area / e_area AS share, coalesce(on_edge, 0) / edge AS es FROM p JOIN e USING (doc_id) JOIN bn USING (doc_id) JOIN t USING (doc_id) LEFT JOIN o USING (doc_id, comp_id))
SELECT doc_id, comp_id, area, round(share, 6) AS share, round(es, 6) AS edge_share, CASE WHEN share >= 0.3 THEN 'large' WHEN share >= 0.08 AND bw >= 0.72 * e_w AND bh >= 0.72 * e_h AND area >= 0.65 * total AND es >= 0.12 THEN 'spanning' WHEN total >= 0.3 * e_area AND share >= 0.01 AND es >= 0.08 THEN 'partitioned' END AS rule FROM a""")
def background_pockets(spark, sf_dir):
    disc = A.src_px(spark, sf_dir).filter("(y - 48) * (y - 48) + (x - 48) * (x - 48) <= 1600")
    return K.background_pockets(disc.filter("r = 255 AND g = 255 AND b = 255"), disc)


_EVIDENCE = """, m AS (SELECT doc_id, layer AS group_id, count(*) AS members, bool_or(idx % 19 = 4) AS moved, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM el GROUP BY ALL),
pt AS (SELECT doc_id, group_id, count(DISTINCT p) AS paints FROM (SELECT doc_id, layer AS group_id, unnest(['fill:' || fill, CASE WHEN stroke <> 'none' THEN 'stroke:' || stroke END]) AS p FROM el) WHERE p IS NOT NULL GROUP BY ALL),
rep AS (SELECT doc_id, CASE WHEN k % 9 = 8 THEN 'only' || k ELSE layer END AS group_id, CASE k % 4 WHEN 0 THEN 'matching-bounds' WHEN 1 THEN 'cross-paint-overlay,repeated-dot-proximity' WHEN 2 THEN 'fragment-proximity' ELSE 'declared-parallel-line-role' END AS reasons, 0.7 + k % 3 / 10.0 AS confidence FROM (SELECT doc_id, layer, min(idx) AS k FROM el GROUP BY ALL)),
ev AS (SELECT doc_id, group_id, members IS NOT NULL AS in_document, coalesce(members, 0) AS members, coalesce(paints, 0) AS paints, CASE WHEN coalesce(moved, TRUE) THEN 'unknown' WHEN (x0 + x1) / 2 / 96 < 0.4 THEN 'left' WHEN (x0 + x1) / 2 / 96 > 0.6 THEN 'right' ELSE 'centre' END AS region, CASE WHEN NOT moved THEN round((x1 - x0) / 96 * ((y1 - y0) / 96), 6) END AS area_share,
NOT coalesce(moved, TRUE) AND (x1 - x0) / 96 * ((y1 - y0) / 96) <= 0.15 AND (x1 - x0) / 96 <= 0.6 AND (y1 - y0) / 96 <= 0.6 AS local, coalesce(reasons, '') AS reasons, confidence::DOUBLE AS confidence FROM m LEFT JOIN pt USING (doc_id, group_id) FULL JOIN rep USING (doc_id, group_id))"""


def _evidence(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    members = el.selectExpr("doc_id", "layer AS group_id", "x0", "y0", "x1", "y1", "fill", "stroke", "idx % 19 = 4 AS transformed")
    reports = el.groupBy("doc_id", "layer").agg(F.min("idx").alias("k")).selectExpr(
        "doc_id", "if(k % 9 = 8, concat('only', k), layer) AS group_id", "cast(0.7 + k % 3 / 10.0 AS double) AS confidence",
        "CASE k % 4 WHEN 0 THEN array('matching-bounds') WHEN 1 THEN array('repeated-dot-proximity', 'cross-paint-overlay') WHEN 2 THEN array('fragment-proximity') ELSE array('declared-parallel-line-role') END AS reasons",
    )
    return K.group_evidence(members, reports, float(N), float(N))


@query(A.with_views("el") + _EVIDENCE + " SELECT * FROM ev")
def group_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


_CHECKED = _EVIDENCE + """, ro AS (SELECT doc_id, layer, bool_or(TRUE) AS f, bool_or(idx % 2 = 0) AS s, bool_or(idx % 3 = 0) AS t, count(*) AS n, max(idx) AS k FROM el GROUP BY ALL),
c1 AS (SELECT doc_id, CASE WHEN bool_or(s AND t AND k % 5 > 0) AND doc_id % 3 > 0 THEN 'passed' WHEN bool_or(s) AND bool_or(t) THEN 'partial' ELSE 'failed' END AS status FROM ro GROUP BY doc_id),
gr AS (SELECT doc_id, 'g' || (idx % 10) AS id, count(*) AS n FROM el WHERE idx < 13 GROUP BY ALL), us AS (SELECT doc_id, 'g' || idx AS id FROM el WHERE idx % 2 = doc_id % 2 AND idx < 10),
c2 AS (SELECT doc_id, CASE WHEN count(us.id) > 0 AND count(us.id) = count(*) FILTER (us.id IS NOT NULL AND n = 1) THEN 'passed' WHEN count(us.id) > 0 THEN 'partial' ELSE 'failed' END AS status FROM gr LEFT JOIN us USING (doc_id, id) GROUP BY doc_id),
rs AS (SELECT *, string_split(reasons, ',') AS rl FROM ev), fl AS (SELECT *, in_document AND local AND paints >= 2 AND area_share >= 0.0005 AND coalesce(confidence, 1) >= 0.74 AND list_has_any(rl, ['cross-paint-overlap', 'cross-paint-overlay', 'fragment-proximity', 'matching-bounds']) AND NOT list_has_any(rl, ['repeated-dot-proximity', 'parallel-stroke-proximity']) AS fits, in_document OR list_has_any(rl, ['cross-paint-overlap', 'cross-paint-overlay', 'fragment-proximity', 'matching-bounds']) AS told FROM rs),
c3 AS (SELECT doc_id, CASE WHEN bool_or(fits AND region = 'left') AND bool_or(fits AND region = 'right') THEN 'passed' WHEN bool_or(fits) THEN 'partial' WHEN bool_or(told) THEN 'failed' ELSE 'manual_review' END AS status FROM fl GROUP BY doc_id),
c4 AS (SELECT doc_id, CASE WHEN coalesce((arg_max(id IS NOT NULL, idx) FILTER (idx % 2 = 0 AND stroke <> 'none')), FALSE) THEN 'passed' ELSE 'partial' END AS status FROM el WHERE tag = 'circle' AND idx * 6 >= 24 GROUP BY doc_id),
c5 AS (SELECT doc_id, CASE bool_or(in_document AND list_has_any(rl, ['repeated-dot-proximity', 'declared-halftone-role']))::INT + bool_or(in_document AND list_has_any(rl, ['parallel-stroke-proximity', 'declared-parallel-line-role']))::INT WHEN 2 THEN 'passed' WHEN 1 THEN 'partial' ELSE CASE WHEN bool_or(list_has_any(rl, ['repeated-dot-proximity', 'declared-halftone-role', 'parallel-stroke-proximity', 'declared-parallel-line-role'])) THEN 'failed' ELSE 'manual_review' END END AS status FROM rs GROUP BY doc_id),
ch AS (SELECT d.doc_id, k.name AS "check", coalesce(s.status, k.d) AS status FROM (SELECT DISTINCT doc_id FROM el) d, (VALUES ('global-colour-role', 'failed'), ('native-gradient-resource', 'manual_review'), ('local-multicolour-dom-groups', 'manual_review'), ('outer-ring', 'failed'), ('decoration-groups', 'manual_review')) k(name, d)
LEFT JOIN (SELECT doc_id, 'global-colour-role' AS name, status FROM c1 UNION ALL SELECT doc_id, 'native-gradient-resource', status FROM c2 UNION ALL SELECT doc_id, 'local-multicolour-dom-groups', status FROM c3 UNION ALL SELECT doc_id, 'outer-ring', status FROM c4 UNION ALL SELECT doc_id, 'decoration-groups', status FROM c5) s ON s.doc_id = d.doc_id AND s.name = k.name)"""


def _checks(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    evidence = _evidence(spark, sf_dir)
    roles = el.groupBy("doc_id", "layer").agg(F.array_distinct(F.flatten(F.collect_set(F.expr("concat(array('fill'), if(idx % 2 = 0, array('stroke'), array()), if(idx % 3 = 0, array('stop-color'), array()))")))).alias("channels"), F.max("idx").alias("k"))
    roles = roles.selectExpr("doc_id", "layer AS role", "channels", "1 AS controls", "k % 5 > 0 AS paints_match", "true AS gradients_match", "if(doc_id % 3 > 0, 0, 1) AS unsupported")
    grads = el.filter("idx < 13").selectExpr("doc_id", "concat('g', idx % 10) AS id", "2 AS stops")
    uses = el.filter("idx % 2 = doc_id % 2 AND idx < 10").selectExpr("doc_id", "concat('g', idx) AS ref")
    circles = el.filter("tag = 'circle'").selectExpr("doc_id", "idx * 6 AS rad", "if(idx % 2 = 0, 'none', '#112233') AS fill", "stroke", "stroke_width", "id IS NOT NULL AS has_id")
    inventory = Q.gradient_inventory(grads, uses, grads.select("doc_id", "id", "stops").distinct())
    found = dict(zip(K.CHECKS, (K.colour_check(roles), K.gradient_check(inventory), K.local_group_check(evidence), K.ring_check(circles, float(N)), K.decoration_check(evidence))))
    return K.operation_checks(el.select("doc_id"), found)


@query(A.with_views("el") + _CHECKED + " SELECT * FROM ch")
def operation_checks(spark, sf_dir):
    return _checks(spark, sf_dir)


@query(A.with_views("el") + _CHECKED + """ SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'manual_review') AS manual_review, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (status = 'passed'), '') AS passed_checks FROM ch GROUP BY doc_id""")
def operation_summary(spark, sf_dir):
    return K.operation_summary(_checks(spark, sf_dir))


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 = 2 THEN 'not_supplied' ELSE 'reported' END AS status, CASE WHEN p_partkey % 4 = 0 THEN 's/1' END AS schema, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN p_size % 3 END AS passed, CASE WHEN p_partkey % 4 IN (0, 1) THEN 2 END AS total, CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN p_size % 3 = 2 END AS all_passed FROM part""")
def operation_evidence(spark, sf_dir):
    json = """CASE p_partkey % 4 WHEN 0 THEN '{"designer_operations": {"schema": "s/1", "summary": {"passed": ["a", "b"], "total_operations": 2}}}' WHEN 1 THEN concat('{"designer_operations": {"passed": ', p_size % 3, ', "total_operations": "2"}}') WHEN 2 THEN '{"other": 1}' ELSE '{"designer_operations": {"summary": {"passed": true, "total_operations": -1}}}' END AS json"""
    return K.operation_evidence(A.table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", json))


_HOLES = ", pv AS (SELECT doc_id, y, x, NOT (y % 3 = 0 AND x % 24 = 0) AS visible, r < 255 OR g < 255 OR b < 255 AS background FROM src_px), ink AS (SELECT doc_id, y, x FROM pv WHERE visible AND background), "


@query(A.with_views("src_px") + _HOLES + _COMPS.replace("{reach}", "1") + """, fit AS (SELECT doc_id, comp_id, sum(x1 - x0 + 1)::BIGINT AS area, min(x0) AS bx, min(y) AS by_, max(x1) - min(x0) + 1 AS bw, max(y) - min(y) + 1 AS bh FROM comp GROUP BY ALL HAVING sum(x1 - x0 + 1) >= 64 AND sum(x1 - x0 + 1) >= 0.3 * (max(x1) - min(x0) + 1) * (max(y) - min(y) + 1)),
own AS (SELECT doc_id, comp_id, y, unnest(range(x0, x1 + 1)) AS x FROM comp JOIN fit USING (doc_id, comp_id)),
near AS (SELECT doc_id, comp_id, y + dy AS y, x + dx AS x, min(greatest(abs(dy), abs(dx))) AS far FROM own, (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) GROUP BY ALL),
seen AS (SELECT doc_id, comp_id, count(*) FILTER (far = 1) AS edge, count(*) FILTER (far = 1 AND visible AND NOT background) AS inked, count(*) FILTER (NOT visible) AS clear FROM near JOIN pv USING (doc_id, y, x) WHERE far > 0 GROUP BY ALL),
h AS (SELECT fit.* FROM fit JOIN seen USING (doc_id, comp_id) WHERE inked >= 0.95 * edge AND clear > 0 AND edge > 0 AND least(bw, bh) >= 3),
pair AS (SELECT a.doc_id, a.comp_id AS s, b.comp_id AS t FROM h a JOIN h b ON a.doc_id = b.doc_id AND greatest(a.by_, b.by_) - least(a.by_ + a.bh, b.by_ + b.bh) <= greatest(4, round_even(0.35 * greatest(a.bh, b.bh), 0))),
hop(doc_id, comp_id, other) AS (SELECT doc_id, comp_id, comp_id FROM h UNION SELECT hop.doc_id, hop.comp_id, t FROM hop JOIN pair ON pair.doc_id = hop.doc_id AND s = other),
line AS (SELECT doc_id, comp_id, min(other) AS line FROM hop GROUP BY ALL), shown AS (SELECT doc_id, max(x) - min(x) + 1 AS shown FROM pv WHERE visible GROUP BY doc_id),
rule AS (SELECT doc_id, line, count(*) >= 3 AND max(bx + bw) - min(bx) >= greatest(16, round_even(0.1 * any_value(shown), 0), round_even(4 * quantile_cont(bw, 0.5), 0)) AS removed FROM h JOIN line USING (doc_id, comp_id) JOIN shown USING (doc_id) GROUP BY ALL)
SELECT doc_id, comp_id, area, removed FROM h JOIN line USING (doc_id, comp_id) JOIN rule USING (doc_id, line)""")
def row_counters(spark, sf_dir):
    """Painted shapes as holes in the white, with a grid of clear points."""
    px = A.src_px(spark, sf_dir).selectExpr("doc_id", "y", "x", "NOT (y % 3 = 0 AND x % 24 = 0) AS visible", "r < 255 OR g < 255 OR b < 255 AS background")
    return K.row_counters(px, N, N)

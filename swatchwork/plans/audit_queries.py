"""Queries of audits and element functions, over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from swatchwork.functions import svg as V
from swatchwork.operators import audits as Q
from swatchwork.operators import boxes as B
from swatchwork.operators import compare as C
from swatchwork.plans.pixel_queries import _COMPS, _PAPER, N
from swatchwork.plans.table_queries import _EDGES, _GROUPS, _groups
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


_CLEAR = ", s2 AS (SELECT doc_id, y, x, 200 + r // 5 AS r, 190 + g // 4 AS g, 186 + b // 4 AS b, CASE WHEN (x + y) % 17 = 0 THEN 180 ELSE 255 END AS a FROM src_px)"


@query(A.with_views("src_px", "ren_px") + _CLEAR + """, light AS (SELECT * FROM s2 WHERE a / 255 >= 0.5 AND (r + g + b) / 3 >= 210 AND least(r, g, b) >= 185), n9 AS (SELECT doc_id, y + dy AS y, x + dx AS x, count(*) AS n FROM light, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) GROUP BY ALL),
core AS (SELECT l.* FROM light l JOIN n9 USING (doc_id, y, x) WHERE n = 9), e AS (SELECT c.doc_id, greatest(abs(o.r - (c.r * c.a / 255 + 91 * (1 - c.a / 255))), abs(o.g - (c.g * c.a / 255 + 75 * (1 - c.a / 255))), abs(o.b - (c.b * c.a / 255 + 138 * (1 - c.a / 255)))) AS e FROM core c JOIN ren_px o USING (doc_id, y, x)),
m AS (SELECT doc_id, count(*) AS n, avg((e <= 48)::INT) * 100 AS cover, avg(e) AS mean, quantile_cont(e, 0.9) AS p90 FROM e GROUP BY doc_id), d AS (SELECT doc_id, max((a / 255 < 0.98)::INT) = 1 AS clear FROM s2 GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS core_pixels, clear AND coalesce(n, 0) >= 64 AS applicable, CASE WHEN clear AND n >= 64 THEN round(cover, 3) END AS coverage, CASE WHEN clear AND n >= 64 THEN round(mean, 3) END AS mean_error, CASE WHEN clear AND n >= 64 THEN round(p90, 3) END AS p90_error FROM d LEFT JOIN m USING (doc_id)""")
def light_fidelity(spark, sf_dir):
    src = A.src_px(spark, sf_dir).selectExpr("doc_id", "y", "x", "200 + r div 5 AS r", "190 + g div 4 AS g", "186 + b div 4 AS b", "if((x + y) % 17 = 0, 180, 255) AS a")
    return Q.light_fidelity(src, A.ren_px(spark, sf_dir))


@query()
def linear_details(spark, sf_dir):
    """Thin diagonals drawn from all parts, apart from each other."""
    bars = A.shapes(spark, sf_dir).select("doc_id", "z", F.explode(F.sequence(F.lit(5), F.lit(60))).alias("x"), "r", "g", "b").selectExpr("doc_id", "x + z * 4 AS y", "x", "r", "g", "b")
    stats = bars.select("doc_id").distinct().selectExpr("doc_id", "255D AS bg_r", "255D AS bg_g", "255D AS bg_b", "6D AS threshold")
    return Q.linear_details(bars, stats)


@query()
def closed_primitives(spark, sf_dir):
    ring = A.ring_pts(spark, sf_dir).selectExpr("curve_id", "row_number() OVER (PARTITION BY curve_id ORDER BY atan2(y - 200, x - 200), seq) AS seq", "x", "y")
    return Q.closed_primitives(ring, 8.0)


@query()
def repair_candidates(spark, sf_dir):
    src, ren = written(A.src_px(spark, sf_dir)), written(A.ren_px(spark, sf_dir))
    return Q.repair_candidates(src, ren, written(C.component_topology(src, ren, N, N)), N, N)


@query(A.with_views("src_px") + f", {_PAPER}, {_COMPS.replace('{reach}', '0')}" + """, c AS (SELECT doc_id, comp_id, sum(x1 - x0 + 1)::BIGINT AS area, max(x1) - min(x0) + 1 AS bw, max(y) - min(y) + 1 AS bh, max(CASE WHEN y IN (0, 95) OR x0 = 0 OR x1 = 95 THEN 1 ELSE 0 END) AS edge FROM comp GROUP BY doc_id, comp_id)
SELECT doc_id, comp_id, area, bw, bh, greatest(bw, bh) / least(bw, bh) <= 4 AS compact FROM c WHERE edge = 0 AND area >= 16""")
def enclosed_pockets(spark, sf_dir):
    return Q.enclosed_pockets(A.src_px(spark, sf_dir), N, N)


@query(A.with_views("shapes") + " SELECT doc_id, z AS comp_id, round((rad * rad * 3) / (2.0 + cx), 4) AS width, 2.0 + cx >= 2.5 * ((rad * rad * 3) / (2.0 + cx)) AS is_ribbon FROM shapes")
def ribbon_width(spark, sf_dir):
    s = A.shapes(spark, sf_dir)
    return Q.ribbon_width(s.selectExpr("doc_id", "z AS comp_id", "rad * rad * 3 AS area"), s.selectExpr("doc_id", "z AS comp_id", "2.0D + cx AS length"))


@query(A.with_views("hist_li") + ", k AS (SELECT *, percent_rank() OVER (PARTITION BY doc_id ORDER BY r + g + b DESC) AS p FROM hist_li) SELECT doc_id AS curve_id, count(*) AS samples, quantile_cont(r, 0.5) AS r, quantile_cont(g, 0.5) AS g, quantile_cont(b, 0.5) AS b FROM k WHERE p <= 0.5 GROUP BY doc_id")
def core_color(spark, sf_dir):
    return Q.core_color(A.hist_li(spark, sf_dir).selectExpr("doc_id AS curve_id", "r", "g", "b", "r + g + b AS strength"))


@query("WITH RECURSIVE grads AS (SELECT p_partkey // 40 AS doc_id, 'g' || (p_partkey % 30) AS id, CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE p_partkey % 2 END AS stops FROM part), n AS (SELECT doc_id, id, count(*) AS copies, max(stops)::INT AS stops FROM grads GROUP BY ALL), u AS (SELECT p_partkey // 40 AS doc_id, 'g' || (p_size % 30) AS id, count(*) AS uses FROM part GROUP BY ALL) SELECT doc_id, id, coalesce(uses, 0) AS uses, stops, copies = 1 AND coalesce(uses, 0) > 0 AND stops >= 2 AS editable FROM n LEFT JOIN u USING (doc_id, id)")
def gradient_inventory(spark, sf_dir):
    part = A.table(spark, sf_dir, "part")
    grads = part.selectExpr("p_partkey div 40 AS doc_id", "concat('g', p_partkey % 30) AS id", "cast(if(p_partkey % 4 = 0, 3, p_partkey % 2) AS int) AS stops")
    uses = part.selectExpr("p_partkey div 40 AS doc_id", "concat('g', p_size % 30) AS ref")
    return Q.gradient_inventory(grads, uses, grads.groupBy("doc_id", "id").agg(F.max("stops").alias("stops")))


_PLACE = "CASE WHEN h = 'center' AND v = 'middle' THEN 'Center' WHEN h = 'center' THEN upper(v[1]) || v[2:] WHEN v = 'middle' THEN upper(h[1]) || h[2:] ELSE upper(v[1]) || v[2:] || '-' || h END"


@query(A.with_views("el") + _EDGES + _GROUPS + """, m AS (SELECT doc_id, group_id, count(*) AS n, (min(x0) + max(x1)) / 2 / 96 AS u, (min(y0) + max(y1)) / 2 / 96 AS w FROM gr JOIN el USING (doc_id, idx) GROUP BY ALL), p AS (SELECT *, CASE WHEN u < 0.34 THEN 'left' WHEN u > 0.66 THEN 'right' ELSE 'center' END AS h, CASE WHEN w < 0.34 THEN 'top' WHEN w > 0.66 THEN 'bottom' ELSE 'middle' END AS v FROM m),
r AS (SELECT e.doc_id, a.group_id, bool_or(rule IN ('bounds', 'overlay')) AS layered, bool_or(rule = 'near') AS near FROM edges e JOIN gr a ON a.doc_id = e.doc_id AND a.idx = e.a JOIN gr b ON b.doc_id = e.doc_id AND b.idx = e.b AND b.group_id = a.group_id GROUP BY ALL)
SELECT doc_id, group_id, """ + _PLACE + " || ' ' || CASE WHEN layered THEN 'layered object' WHEN near THEN 'cluster' ELSE 'object cluster' END || ' (' || n || ' parts)' AS label FROM p LEFT JOIN r USING (doc_id, group_id)")
def describe_clusters(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    groups = _groups(el)
    of = lambda n: groups.select("doc_id", F.col("idx").alias(n), F.col("group_id").alias(f"g_{n}"))
    rules = B.bbox_edges(el).join(of("a"), ["doc_id", "a"]).join(of("b"), ["doc_id", "b"]).filter("g_a = g_b").select("doc_id", F.col("g_a").alias("group_id"), "rule")
    return Q.describe_clusters(B.group_manifest(groups, el), rules, 96.0)


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'a' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'e' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'f' || o_orderkey END AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'argument' WHEN o_orderkey % 3 = 0 THEN 'embedded' WHEN o_orderkey % 2 = 0 THEN 'file' ELSE 'not-found' END AS source FROM orders")
def resolve_sidecar(spark, sf_dir):
    d = A.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id")
    of = lambda n, c: d.filter(f"doc_id % {n} = 0").selectExpr("doc_id", f"concat('{c}', doc_id) AS value")
    return Q.resolve_sidecar(d, of(5, "a"), of(3, "e"), of(2, "f"))


@query(A.with_views("el") + " SELECT doc_id, 'stroke-' || idx AS name, CASE WHEN idx % 4 <> 0 THEN stroke_width END AS width, idx % 4 <> 0 AS known FROM el WHERE idx % 3 > 0 UNION ALL SELECT DISTINCT doc_id, 'ring-0', 9.0, TRUE FROM el")
def restore_details(spark, sf_dir):
    el = A.elements(spark, sf_dir).selectExpr("doc_id", "idx", "concat('stroke-', idx) AS name", "stroke_width AS width")
    return Q.restore_details(el.filter("idx % 3 > 0").select("doc_id", "name"), el.filter("idx % 4 <> 0").select("doc_id", "name", "width"), el.selectExpr("doc_id", "'ring-0' AS name", "9.0D AS width").distinct())


@query(A.with_views("el") + """, r AS (SELECT doc_id, layer AS role, CASE WHEN idx % 11 = 0 THEN 'other' ELSE 'neutral' END AS kind, CASE WHEN idx % 7 = 0 THEN 'red' ELSE lower(printf('#%02x%02x%02x', r, g, b)) END AS paint, 2 AS member_count FROM el), w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, paint) AS same, count(*) OVER (PARTITION BY doc_id, role) AS n FROM r)
SELECT doc_id, role, paint, unnest(list_filter([CASE WHEN kind = 'other' THEN 'bad_kind' END, CASE WHEN paint = 'red' THEN 'bad_hex' END, CASE WHEN same > 1 THEN 'duplicate_colour' END, CASE WHEN n <> 2 THEN 'count_mismatch' END], lambda v: v IS NOT NULL)) AS rule FROM w""")
def manifest_violations(spark, sf_dir):
    roles = A.elements(spark, sf_dir).selectExpr("doc_id", "layer AS role", "if(idx % 11 = 0, 'other', 'neutral') AS kind", "if(idx % 7 = 0, 'red', lower(concat('#', lpad(hex(r), 2, '0'), lpad(hex(g), 2, '0'), lpad(hex(b), 2, '0')))) AS paint", "2 AS member_count")
    return Q.manifest_violations(roles)


@query(A.with_views("el") + " SELECT doc_id, idx, round((x1 - x0) * (y1 - y0) / 9216, 6) AS area_share, (x1 - x0) * (y1 - y0) / 9216 >= 0.85 AS scaffold, CASE WHEN tag IN ('line', 'polyline') THEN 'stroke' WHEN tag = 'circle' THEN 'dot' ELSE 'fragment' END AS role, 'square' AS orientation FROM el")
def classify_nodes(spark, sf_dir):
    return Q.classify_nodes(A.elements(spark, sf_dir), 9216.0)


@query(A.with_views("el") + " SELECT a.doc_id, a.idx AS a, b.idx AS b, round((a.x1 - a.x0) * (a.y1 - a.y0), 3) AS area, round(sqrt(greatest(a.x0 - b.x1, b.x0 - a.x1, 0) ** 2 + greatest(a.y0 - b.y1, b.y0 - a.y1, 0) ** 2), 6) AS gap, round(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)), 6) AS iou FROM el a JOIN el b ON a.doc_id = b.doc_id AND b.idx = a.idx + 1")
def box_algebra(spark, sf_dir):
    el = A.elements(spark, sf_dir).select("doc_id", "idx", *B.BOX)
    o = el.select("doc_id", (F.col("idx") - 1).alias("idx"), F.col("idx").alias("b"), *(F.col(c).alias(f"o_{c}") for c in B.BOX))
    rows = el.join(o, ["doc_id", "idx"])
    area = V.box_area(*(F.col(c) for c in B.BOX))
    return rows.select("doc_id", F.col("idx").alias("a"), "b", F.round(area, 3).alias("area"), F.round(V.box_gap("", "o_"), 6).alias("gap"), F.round(V.box_iou("", "o_"), 6).alias("iou"))


@query(A.with_views("el") + " SELECT doc_id, idx, CASE idx % 4 WHEN 0 THEN idx + 0.5 WHEN 1 THEN idx * 1.0 WHEN 2 THEN idx * 2.0 END::DOUBLE AS size FROM el")
def parse_length(spark, sf_dir):
    text = F.expr("CASE idx % 4 WHEN 0 THEN concat(' ', idx, '.5 ') WHEN 1 THEN concat(idx, 'px') WHEN 2 THEN concat(idx, '%') ELSE concat(idx, 'em') END")
    return A.elements(spark, sf_dir).select("doc_id", "idx", V.parse_length(text, F.lit(200.0)).alias("size"))


@query(A.with_views("el") + " SELECT doc_id, idx, CASE WHEN idx % 2 = 0 THEN 'red layer' ELSE 'left wing' END AS words FROM el")
def layer_words(spark, sf_dir):
    label = F.expr("CASE WHEN idx % 2 = 0 THEN concat('redLayer', idx) ELSE concat('Left_Wing-', idx) END")
    return A.elements(spark, sf_dir).select("doc_id", "idx", F.array_join(V.layer_words(label), " ").alias("words"))

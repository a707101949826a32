"""Queries on scores, curves, vector elements, boxes, jobs and raw pages, over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.functions import svg as V
from swatchwork.operators import boxes as B
from swatchwork.operators import curves as K
from swatchwork.operators import documents as D
from swatchwork.operators import rules as U
from swatchwork.runtime import united, written
from swatchwork.sources import adapters as A
from swatchwork.streaming import jobs as J

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# -- rules on scores ---------------------------------------------------------------------------

_P = U.GateParams()


def _metric_sql(p: str = "") -> dict[str, str]:
    local, topo = f"{p}eligible_cells >= 8", f"{p}eligible_components >= 8"
    lit = f"{p}light_coverage IS NOT NULL AND {p}light_pixels >= 64"
    on = dict(zip(U.METRICS, ("TRUE", "TRUE", local, local, topo, lit)))
    return {m: f"(CASE WHEN {on[m]} THEN {p}{m} END)" for m in U.METRICS}


def _names_sql(tests: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items()) + "], lambda v: v IS NOT NULL), ',')"


def _gate_sql(source: str = "cand") -> str:
    m = _metric_sql()
    local, topo, lit = "eligible_cells >= 8", "eligible_components >= 8", "light_coverage IS NOT NULL AND light_pixels >= 64"
    on = dict(zip(U.METRICS, ("TRUE", "TRUE", local, local, topo, lit)))
    hard = _names_sql({n: f"{m[n]} < {t}" for n, t in zip(U.METRICS, _P.reject)})
    soft = _names_sql({n: f"{m[n]} < {t}" for n, t in zip(U.METRICS, _P.soft)})
    missed = _names_sql({n: f"({on[n]}) AND ({m[n]} IS NULL OR {m[n]} < {t})" for n, t in zip(U.METRICS, _P.accept)})
    count = " + ".join(f"coalesce(({m[n]} < {t})::INT, 0)" for n, t in zip(U.METRICS, _P.soft))
    return f"""gated AS (SELECT *, CASE WHEN hard_breaches <> '' OR n_soft >= 2 OR compound THEN 'rejected' WHEN missed <> '' THEN 'manual_review' ELSE 'accepted' END AS status FROM (
SELECT *, {hard} AS hard_breaches, {soft} AS soft_breaches, {missed} AS missed, coalesce({m['detail_p10']} < 80 AND {m['detail_mean']} < 88, FALSE) AS compound, {count} AS n_soft FROM {source}))"""


def _dominates_sql(a: str, b: str) -> str:
    x, y = _metric_sql(f"{a}."), _metric_sql(f"{b}.")
    worse = " + ".join(f"coalesce(({x[n]} - {y[n]} < -{v})::INT, 0)" for n, v in zip(U.METRICS, _P.budget))
    better = " + ".join(f"coalesce(({x[n]} - {y[n]} >= {v})::INT, 0)" for n, v in zip(U.METRICS, _P.gain))
    return f"{worse} = 0 AND {better} > 0"


@query(A.with_views("cand") + f", {_gate_sql()} SELECT item_id, cand_no, hard_breaches, soft_breaches, missed, compound, status FROM gated")
def visual_gate(spark, sf_dir):
    return U.visual_gate(A.cand(spark, sf_dir)).select("item_id", "cand_no", "hard_breaches", "soft_breaches", "missed", "compound", "status")


@query(A.with_views("cand") + f" SELECT item_id, cand_no FROM cand b WHERE EXISTS (SELECT 1 FROM cand a WHERE a.item_id = b.item_id AND a.cand_no <> b.cand_no AND {_dominates_sql('a', 'b')})")
def safely_dominated(spark, sf_dir):
    return U.dominated(A.cand(spark, sf_dir)).select("item_id", "cand_no")


@query(A.with_views("cand") + f""", {_gate_sql()}, t AS (SELECT *, CASE status WHEN 'accepted' THEN 2 WHEN 'manual_review' THEN 1 ELSE 0 END AS tier FROM gated), top AS (SELECT * FROM t QUALIFY tier = max(tier) OVER (PARTITION BY item_id)),
kept AS (SELECT b.*, (strokes <> 'off')::INT + (gradients <> 'off')::INT + (geometry <> 'off')::INT AS kept, round(0.9 * foreground + 0.1 * greatest(0, least(100, 100 - 12 * log10(1 + nodes))), 6) AS rank FROM top b WHERE NOT EXISTS (SELECT 1 FROM top a WHERE a.item_id = b.item_id AND a.cand_no <> b.cand_no AND {_dominates_sql('a', 'b')}))
SELECT item_id, cand_no, status, kept, rank FROM kept QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY kept DESC, rank DESC, foreground DESC, cand_no) = 1""")
def select_candidate(spark, sf_dir):
    return U.select_candidate(A.cand(spark, sf_dir))


@query(A.with_views("cand") + " SELECT DISTINCT item_id, CASE WHEN m & 1 <> 0 THEN 'off' ELSE strokes END AS strokes, CASE WHEN m & 2 <> 0 THEN 'off' ELSE gradients END AS gradients, CASE WHEN m & 4 <> 0 THEN 'off' ELSE geometry END AS geometry FROM cand, (SELECT unnest(range(8)) AS m)")
def option_matrix(spark, sf_dir):
    return U.option_matrix(A.cand(spark, sf_dir))


@query(A.with_views("cand") + f", {_gate_sql('(SELECT * FROM cand WHERE cand_no = 1)')} SELECT item_id, status, missed FROM gated WHERE status <> 'accepted'")
def needs_expansion(spark, sf_dir):
    return U.needs_expansion(A.cand(spark, sf_dir))


_MOVE = "greatest(" + ", ".join(f"coalesce(abs(c.{m} - b.{m}), 0)" for m in U.METRICS) + ")"


@query(A.with_views("cand") + f" SELECT c.item_id, c.cand_no, round({_MOVE}, 6) AS move FROM cand c JOIN cand b ON b.item_id = c.item_id AND b.cand_no = 1 WHERE c.cand_no > 1 AND round({_MOVE}, 6) >= 1")
def impactful(spark, sf_dir):
    return U.impactful(A.cand(spark, sf_dir))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = A.cand(spark, sf_dir)
    return c.filter("cand_no = 1"), c.filter("cand_no = 2")


_HALVES = " FROM cand b JOIN cand a ON a.item_id = b.item_id AND b.cand_no = 1 AND a.cand_no = 2"


@query(A.with_views("cand") + ", g AS (SELECT b.item_id, " + _names_sql({"foreground_unscored": "a.foreground IS NULL", "foreground_drop": "a.foreground < b.foreground - 0.25", "detail_p10_unscored": "b.detail_p10 IS NOT NULL AND a.detail_p10 IS NULL", "detail_p10_drop": "a.detail_p10 < b.detail_p10 - 1"}) + f" AS triggers{_HALVES}) SELECT *, triggers <> '' AS rollback FROM g")
def regression_guard(spark, sf_dir):
    return U.regression_guard(*_halves(spark, sf_dir))


@query(A.with_views("cand") + ", g AS (SELECT b.item_id, " + _names_sql({m: f"b.{m} IS NOT NULL AND (a.{m} IS NULL OR a.{m} < b.{m} - {t})" for m, t in zip(U.METRICS, (0.05, 0.1, 0.1, 0.1, 0.1, 0.1))}) + f" AS worse{_HALVES}) SELECT *, worse = '' AS kept FROM g")
def repair_verdict(spark, sf_dir):
    return U.repair_verdict(*_halves(spark, sf_dir))


@query(A.with_views("cand") + f", {_gate_sql()} SELECT item_id, cand_no, CASE WHEN status = 'rejected' OR strokes = 'none' THEN 'rejected' WHEN status = 'manual_review' OR gradients <> 'auto' THEN 'manual_review' ELSE 'accepted' END AS status FROM gated")
def acceptance(spark, sf_dir):
    edit = F.when(F.col("strokes") == "none", "rejected").when(F.col("gradients") != "auto", "manual_review").otherwise("accepted")
    return U.visual_gate(A.cand(spark, sf_dir)).select("item_id", "cand_no", U.acceptance(F.col("status"), edit, F.col("status") == "manual_review").alias("status"))


@query(A.with_views("cand") + " SELECT item_id, cand_no, round(greatest(0, least(100, 100 - 12 * log10(1 + nodes) - least(12, 0.4 * eligible_cells) + least(8, 2.0 * eligible_components))), 6) AS structure, round(0.9 * foreground + 0.1 * greatest(0, least(100, 100 - 12 * log10(1 + nodes) - least(12, 0.4 * eligible_cells) + least(8, 2.0 * eligible_components))), 6) AS rank FROM cand")
def structure_score(spark, sf_dir):
    s = U.structure_score(F.col("nodes"), F.col("eligible_cells"), F.col("eligible_components"))
    return A.cand(spark, sf_dir).select("item_id", "cand_no", F.round(s, 6).alias("structure"), F.round(U.selection_rank(F.col("foreground"), s), 6).alias("rank"))


@query(A.with_views("timings") + " SELECT case_id, count(*) AS tasks, round(100 * (1 - sum(vector_s) / sum(redraw_s)), 2) AS saved_percent, 100 * (1 - sum(vector_s) / sum(redraw_s)) >= 80 AS reaches_80 FROM timings WHERE evidence = 'actual' AND redraw_s > 0 GROUP BY case_id")
def time_saving(spark, sf_dir):
    return U.time_saving(A.timings(spark, sf_dir))


@query(A.with_views("answers") + " SELECT CASE WHEN answer NOT IN ('left', 'right') THEN 'tie' WHEN answer = tool_side THEN 'tool_better' ELSE 'original_better' END AS verdict, count(*) AS n FROM answers GROUP BY 1")
def blind_verdicts(spark, sf_dir):
    return U.blind_verdicts(A.answers(spark, sf_dir))


@query(A.with_views("cand") + f", {_gate_sql()} SELECT missed AS reason, count(*) AS n FROM gated GROUP BY missed")
def reason_counts(spark, sf_dir):
    return U.reason_counts(U.visual_gate(A.cand(spark, sf_dir)), "missed")


# -- curves ------------------------------------------------------------------------------------

_WRAP = "(CASE WHEN (({d}) % 360 + 360) % 360 > 180 THEN (({d}) % 360 + 360) % 360 - 360 ELSE (({d}) % 360 + 360) % 360 END)"
_POLAR = ", polar AS (SELECT curve_id, seq, round((degrees(atan2(y - 200, x - 200)) + 360) % 360, 4) AS angle, round(sqrt((x - 200) ** 2 + (y - 200) ** 2), 4) AS radius FROM ring_pts)"


def _polar(spark, sf_dir):
    return K.polar(A.ring_pts(spark, sf_dir), 200.0, 200.0)


@query(A.with_views("polylines") + """, s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM polylines WINDOW w AS (PARTITION BY curve_id ORDER BY seq)), g AS (SELECT curve_id, count(*) AS points, coalesce(sum(step), 0) AS l, sqrt((arg_max(x, seq) - arg_min(x, seq)) ** 2 + (arg_max(y, seq) - arg_min(y, seq)) ** 2) AS c FROM s GROUP BY curve_id)
SELECT curve_id, points, round(l, 4) AS length, round(c, 4) AS chord, round(CASE WHEN l > 0 THEN c / l END, 6) AS straightness FROM g""")
def polyline_length(spark, sf_dir):
    return K.polyline_length(A.polylines(spark, sf_dir))


@query(A.with_views("polylines") + """, n AS (SELECT *, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM polylines WINDOW w AS (PARTITION BY curve_id ORDER BY seq)), t AS (SELECT curve_id, seq, round(degrees(abs(atan2(ux * vy - uy * vx, ux * vx + uy * vy))), 4) AS turn FROM n) SELECT * FROM t WHERE turn > 40""")
def corners(spark, sf_dir):
    return K.corners(A.polylines(spark, sf_dir))


@query(A.with_views("polylines") + """, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM polylines WINDOW w AS (PARTITION BY curve_id ORDER BY seq)) SELECT curve_id, round(sum(x * ny - nx * y) / 2, 3) AS area FROM n GROUP BY curve_id""")
def polygon_area(spark, sf_dir):
    return K.polygon_area(A.polylines(spark, sf_dir))


@query(A.with_views("polylines") + """, q AS (SELECT curve_id, seq, x, floor(y / 100) AS y FROM polylines), n AS (SELECT *, x - coalesce(lag(x) OVER w, last_value(x) OVER f) AS ux, y - coalesce(lag(y) OVER w, last_value(y) OVER f) AS uy, coalesce(lead(x) OVER w, first_value(x) OVER f) - x AS vx, coalesce(lead(y) OVER w, first_value(y) OVER f) - y AS vy FROM q WINDOW w AS (PARTITION BY curve_id ORDER BY seq), f AS (PARTITION BY curve_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT curve_id, seq, x, y FROM n WHERE NOT (ux * vy - uy * vx = 0 AND ux * vx + uy * vy >= 0)""")
def drop_collinear(spark, sf_dir):
    return K.drop_collinear(A.polylines(spark, sf_dir).withColumn("y", F.floor(F.col("y") / 100).cast("double")))


@query(A.with_views("ring_pts") + _POLAR + ", d AS (SELECT DISTINCT curve_id, angle FROM polar), g AS (SELECT *, angle - lag(angle) OVER (PARTITION BY curve_id ORDER BY angle) AS gap FROM d), m AS (SELECT curve_id, greatest(coalesce(max(gap), 0), min(angle) + 360 - max(angle)) AS gap FROM g GROUP BY curve_id) SELECT curve_id, round(gap, 4) AS gap, gap <= 75 AS covered FROM m")
def coverage_gap(spark, sf_dir):
    return K.coverage_gap(_polar(spark, sf_dir))


@query(A.with_views("ring_pts") + _POLAR + ", n AS (SELECT *, (radius - lag(radius) OVER (PARTITION BY curve_id ORDER BY radius, seq) > greatest(2.5, 0.008 * radius))::INT AS new FROM polar), c AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY curve_id ORDER BY radius, seq), 0) AS cluster FROM n) SELECT curve_id, cluster::BIGINT AS cluster, count(*) AS points, round(avg(radius), 4) AS radius FROM c GROUP BY ALL HAVING count(*) >= 8 AND avg(radius) >= 20")
def distance_clusters(spark, sf_dir):
    return K.distance_clusters(_polar(spark, sf_dir))


@query(A.with_views("ring_pts") + _POLAR + """, n AS (SELECT *, coalesce((angle - lag(angle) OVER (PARTITION BY curve_id ORDER BY angle, seq) > 2)::INT, 0) AS new FROM polar), c AS (SELECT *, sum(new) OVER (PARTITION BY curve_id ORDER BY angle, seq) AS k, min(angle) OVER (PARTITION BY curve_id) + 360 - max(angle) OVER (PARTITION BY curve_id) <= 2 AS joins FROM n), l AS (SELECT *, max(k) OVER (PARTITION BY curve_id) AS top FROM c)
SELECT curve_id, (CASE WHEN joins AND k = top THEN 0 ELSE k END)::BIGINT AS cluster, count(*) AS points FROM l GROUP BY 1, 2""")
def angle_clusters(spark, sf_dir):
    return K.angle_clusters(_polar(spark, sf_dir), 2.0)


@query(A.with_views("ring_pts") + _POLAR + ", d AS (SELECT curve_id, " + _WRAP.replace("{d}", "angle - lag(angle) OVER (PARTITION BY curve_id ORDER BY seq)") + " AS d FROM polar), g AS (SELECT curve_id, round(sum(d), 3) AS net, round(sum(abs(d)), 3) AS total FROM d GROUP BY curve_id) SELECT *, round(CASE WHEN total > 0 THEN abs(net) / total END, 6) AS ratio FROM g")
def arc_monotonicity(spark, sf_dir):
    return K.arc_monotonicity(_polar(spark, sf_dir))


_FIT = """, c AS (SELECT *, x - avg(x) OVER (PARTITION BY curve_id) AS u, y - avg(y) OVER (PARTITION BY curve_id) AS v FROM ring_pts), m AS (SELECT curve_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, sum(u*(u*u+v*v)) AS uz, sum(v*(u*u+v*v)) AS vz FROM c GROUP BY curve_id),
ab AS (SELECT *, (uz*vv - vz*uv) / (2*(uu*vv - uv*uv)) AS a, (vz*uu - uz*uv) / (2*(uu*vv - uv*uv)) AS b FROM m), fit AS (SELECT curve_id, n, round(mx + a, 4) AS cx, round(my + b, 4) AS cy, round(sqrt(a*a + b*b + (uu + vv) / n), 4) AS radius FROM ab)"""


@query(A.with_views("ring_pts") + _FIT + " SELECT * FROM fit")
def circle_fit(spark, sf_dir):
    return K.circle_fit(A.ring_pts(spark, sf_dir))


@query(A.with_views("ring_pts") + _FIT + ", d AS (SELECT p.curve_id, abs(sqrt((x - cx) ** 2 + (y - cy) ** 2) - radius) AS d FROM ring_pts p JOIN fit USING (curve_id)) SELECT curve_id, round(sqrt(avg(d * d)), 4) AS rms, round(quantile_cont(d, 0.95), 4) AS p95 FROM d GROUP BY curve_id")
def circle_residual(spark, sf_dir):
    pts = A.ring_pts(spark, sf_dir)
    return K.circle_residual(pts, K.circle_fit(pts))


@query()
def robust_circle_fit(spark, sf_dir):
    return K.robust_circle_fit(A.ring_pts(spark, sf_dir))


@query(A.with_views("polylines") + """, q AS (SELECT curve_id, seq, (floor(y)::BIGINT % 4)::INT AS label FROM polylines), n AS (SELECT a.curve_id, a.seq, b.label, count(*) AS n FROM q a JOIN q b ON a.curve_id = b.curve_id AND b.seq BETWEEN a.seq - 2 AND a.seq + 2 GROUP BY ALL) SELECT curve_id, seq, label AS mode FROM n QUALIFY row_number() OVER (PARTITION BY curve_id, seq ORDER BY n DESC, label) = 1""")
def mode_smooth(spark, sf_dir):
    return K.mode_smooth(A.polylines(spark, sf_dir).withColumn("label", F.expr("cast(cast(floor(y) AS bigint) % 4 AS int)")), "label")


@query()
def chained_distance_filter(spark, sf_dir):
    return K.chained_distance_filter(A.polylines(spark, sf_dir), 60.0)


@query()
def simplify(spark, sf_dir):
    return K.simplify(A.polylines(spark, sf_dir), 120.0)


_ARCS = " FROM arcs a JOIN arcs b ON a.doc_id = b.doc_id AND a.paint = b.paint AND a.linecap = b.linecap AND a.linejoin = b.linejoin AND a.arc_id < b.arc_id WHERE abs(a.opacity - b.opacity) <= 0.02 AND abs(a.radius - b.radius) <= 2 AND abs(a.width - b.width) <= 1 AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 2"


@query(A.with_views("arcs") + f" SELECT a.doc_id, a.arc_id AS src, b.arc_id AS dst{_ARCS}")
def compatible_arcs(spark, sf_dir):
    return K.compatible_arcs(A.arcs(spark, sf_dir))


@query(A.with_views("arcs") + ", b AS (SELECT DISTINCT doc_id, paint AS ring, arc_id, unnest(range(floor(a0)::INT, ceil(a1)::INT)) % 360 AS bin FROM arcs), n AS (SELECT doc_id, ring, bin, count(*) AS n FROM b GROUP BY ALL) SELECT doc_id, ring, round(count(*)::DOUBLE, 3) AS degrees, round(sum(n - 1) / sum(n), 6) AS overlap FROM n GROUP BY doc_id, ring")
def arc_coverage(spark, sf_dir):
    return K.arc_coverage(A.arcs(spark, sf_dir).withColumnRenamed("paint", "ring"))


@query(A.with_views("polylines") + """, q AS (SELECT curve_id, seq AS bin, y > 250 AS on_ FROM polylines), n AS (SELECT *, coalesce((on_ <> lag(on_) OVER (PARTITION BY curve_id ORDER BY bin))::INT, 1) AS new FROM q), r AS (SELECT curve_id, on_, sum(new) OVER (PARTITION BY curve_id ORDER BY bin) AS run FROM n), g AS (SELECT curve_id, run, on_, count(*) AS n FROM r GROUP BY ALL) SELECT curve_id, string_agg((CASE WHEN on_ THEN '+' ELSE '-' END) || n, ',' ORDER BY run) AS pattern FROM g GROUP BY curve_id""")
def dash_pattern(spark, sf_dir):
    return K.dash_pattern(A.polylines(spark, sf_dir).select("curve_id", F.col("seq").alias("bin"), (F.col("y") > 250).alias("on")))


# -- vector elements -----------------------------------------------------------------------------


@query(A.with_views("el") + " SELECT doc_id, count(*) AS elements, " + ", ".join(f"count(*) FILTER (tag = '{t}') AS n_{t}" for t in ("path", "circle", "rect", "line", "polyline")) + ", count(id) AS with_id, count(DISTINCT fill) AS fills FROM el GROUP BY doc_id")
def structure_counts(spark, sf_dir):
    return D.structure_counts(A.elements(spark, sf_dir))


_USES = """, uses AS (SELECT doc_id, idx, 'attribute' AS place, 'fill' AS property, fill AS paint FROM el WHERE fill IS NOT NULL UNION ALL SELECT doc_id, idx, 'attribute', 'stroke', stroke FROM el WHERE stroke <> 'none' UNION ALL SELECT doc_id, idx, 'style', 'fill', trim(regexp_extract(style, '.*fill:([^;]*)', 1)) FROM el WHERE style IS NOT NULL)"""


@query(A.with_views("el") + _USES + " SELECT * FROM uses")
def paint_uses(spark, sf_dir):
    return D.paint_uses(A.elements(spark, sf_dir))


@query(A.with_views("el") + _USES + " SELECT doc_id, paint, count(*) AS uses, count(*) FILTER (place = 'attribute' AND property = 'fill') AS attribute_fill, count(*) FILTER (place = 'attribute' AND property = 'stroke') AS attribute_stroke, count(*) FILTER (place = 'style') AS style_fill FROM uses GROUP BY doc_id, paint")
def paint_inventory(spark, sf_dir):
    return D.paint_inventory(A.elements(spark, sf_dir))


@query(A.with_views("el") + _USES + ", map AS (SELECT doc_id, paint, '#000000' AS to_paint FROM uses GROUP BY ALL HAVING count(*) > 1) SELECT doc_id, property, count(*) AS uses, count(to_paint) AS changed, count(DISTINCT coalesce(to_paint, paint)) AS colours_after FROM uses LEFT JOIN map USING (doc_id, paint) GROUP BY doc_id, property")
def role_recolor(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    mapping = D.paint_inventory(el).filter("uses > 1").select("doc_id", "paint", F.lit("#000000").alias("to_paint"))
    return D.apply_role_recolor(el, mapping)


@query(A.with_views("el") + ", n AS (SELECT doc_id, idx, coalesce(id, 'h' || substr(sha1(concat_ws('|', tag, coalesce(fill, ''), coalesce(stroke, ''), cx, cy, rad)), 1, 10)) AS name FROM el) SELECT doc_id, idx, CASE WHEN count(*) OVER (PARTITION BY doc_id, name) > 1 THEN name || '-' || row_number() OVER (PARTITION BY doc_id, name ORDER BY idx) ELSE name END AS stable_id FROM n")
def stable_ids(spark, sf_dir):
    return D.stable_ids(A.elements(spark, sf_dir))


_STACK = ", n AS (SELECT *, CASE WHEN layer IS NOT DISTINCT FROM lag(layer) OVER w AND idx > first_value(idx) OVER w THEN 0 ELSE 1 END AS new FROM el WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM n), stack AS (SELECT doc_id, run::BIGINT AS run, layer AS paint, min(idx) AS first, max(idx) AS last, count(*) AS n FROM r GROUP BY doc_id, run, layer)"


@query(A.with_views("el") + _STACK + " SELECT * FROM stack")
def stack_runs(spark, sf_dir):
    return D.stack_runs(A.elements(spark, sf_dir), "layer")


@query(A.with_views("el") + _STACK + " SELECT doc_id, run, paint || CASE WHEN row_number() OVER (PARTITION BY doc_id, paint ORDER BY run) > 1 THEN (row_number() OVER (PARTITION BY doc_id, paint ORDER BY run))::VARCHAR ELSE '' END AS name FROM stack")
def layer_names(spark, sf_dir):
    return D.layer_names(D.stack_runs(A.elements(spark, sf_dir), "layer"))


@query(A.with_views("el") + " SELECT doc_id, id, count(*) AS n FROM el WHERE id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return D.duplicate_ids(A.elements(spark, sf_dir))


@query(A.with_views("el") + ", u AS (SELECT doc_id, idx, unnest(['e' || (idx % 37), 'e' || (idx % 11)]) AS ref FROM el) SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM el WHERE el.doc_id = u.doc_id AND el.id = u.ref)")
def dangling_references(spark, sf_dir):
    el = A.elements(spark, sf_dir).withColumn("id_refs", F.expr("array(concat('e', idx % 37), concat('e', idx % 11))"))
    return D.references(el).select("doc_id", "idx", "ref")


@query(A.with_views("el") + ", s AS (SELECT doc_id, sha256(concat_ws('|', tag, coalesce(fill, '~'), coalesce(stroke, '~'))) AS h FROM el) SELECT doc_id, sha256(string_agg(h, '' ORDER BY h)) AS signature FROM s GROUP BY doc_id")
def paint_signature(spark, sf_dir):
    return D.content_signature(A.elements(spark, sf_dir), "doc_id", "tag", "fill", "stroke")


@query(A.with_views("el") + """, c AS (SELECT idx, doc_id, coalesce(fill, stroke) AS h FROM el), l AS (SELECT *, ('0x' || substr(h, 2, 2))::INT AS r, ('0x' || substr(h, 4, 2))::INT AS g, ('0x' || substr(h, 6, 2))::INT AS b FROM c WHERE h LIKE '#%')
SELECT doc_id, idx, CASE WHEN coalesce(h, '') NOT LIKE '#%' THEN 'unknown' WHEN greatest(r, g, b) - least(r, g, b) <= 30 THEN 'neutral' ELSE 'chromatic' END AS profile FROM c LEFT JOIN l USING (doc_id, idx, h)""")
def paint_profile(spark, sf_dir):
    return A.elements(spark, sf_dir).select("doc_id", "idx", V.paint_profile(F.coalesce("fill", "stroke")).alias("profile"))


@query(A.with_views("el") + " SELECT doc_id, idx, CASE WHEN stroke <> 'none' THEN 'stroke:' || stroke ELSE 'fill:' || coalesce(fill, '#000000') END AS paint FROM el")
def effective_paint(spark, sf_dir):
    return A.elements(spark, sf_dir).select("doc_id", "idx", V.effective_paint(F.col("fill"), F.col("stroke")).alias("paint"))


@query(A.with_views("el") + " SELECT doc_id, idx, r || ',' || g || '|' AS text, lower(printf('#%02x%02x%02x', r, g, b)) AS hex, round(CASE idx % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE round(136 / 255.0, 4) END, 4)::DOUBLE AS alpha FROM el".replace("r || ',' || g || '|' AS text, ", ""))
def parse_color(spark, sf_dir):
    text = F.expr("CASE idx % 3 WHEN 0 THEN concat('rgb(', r, ', ', g, ', ', b, ')') WHEN 1 THEN concat('rgba(', r, ' ', g, ' ', b, ' / 50%)!important') ELSE upper(concat('#', lpad(hex(r), 2, '0'), lpad(hex(g), 2, '0'), lpad(hex(b), 2, '0'), '88')) END")
    return A.elements(spark, sf_dir).select("doc_id", "idx", V.parse_color(text).alias("c")).select("doc_id", "idx", "c.hex", F.round("c.alpha", 4).alias("alpha"))


@query(A.with_views("el") + " SELECT doc_id, idx, 'fill:#123456;opacity:.5' AS style, '.5' AS opacity FROM el WHERE style IS NOT NULL")
def style_rewrite(spark, sf_dir):
    rows = A.elements(spark, sf_dir).filter("style IS NOT NULL")
    return rows.select("doc_id", "idx", V.set_style(F.col("style"), "fill", F.lit("#123456")).alias("style"), V.style_value(F.col("style"), "opacity").alias("opacity"))


@query(" SELECT DISTINCT page_id, regexp_replace(url, '[\\\\/:*?\"<>|\\x00-\\x1F]', '_', 'g') AS name FROM pages")
def safe_names(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", V.safe_name(F.col("url")).alias("name"))


# -- paths ---------------------------------------------------------------------------------------

_SEGS = """, p AS (SELECT * FROM el WHERE tag = 'path'), seg AS (
SELECT doc_id, idx, 0 AS seq, 'M' AS cmd, 0 AS subpath, (cx - rad)::DOUBLE AS x, cy::DOUBLE AS y FROM p UNION ALL SELECT doc_id, idx, 1, 'L', 0, cx::DOUBLE, (cy - rad)::DOUBLE FROM p UNION ALL SELECT doc_id, idx, 2, 'L', 0, (cx + rad)::DOUBLE, cy::DOUBLE FROM p
UNION ALL SELECT doc_id, idx, 3, 'C', 0, cx::DOUBLE, (cy + rad)::DOUBLE FROM p UNION ALL SELECT doc_id, idx, 4, 'Z', 0, (cx - rad)::DOUBLE, cy::DOUBLE FROM p WHERE idx % 2 = 0
UNION ALL SELECT doc_id, idx, 4 + (idx % 2 = 0)::INT, 'M', 1, CASE WHEN idx % 2 = 0 THEN cx - rad ELSE cx END + 1.0::DOUBLE, CASE WHEN idx % 2 = 0 THEN cy ELSE cy + rad END + 1.0::DOUBLE FROM p WHERE idx % 3 = 0
UNION ALL SELECT doc_id, idx, 5 + (idx % 2 = 0)::INT, 'H', 1, CASE WHEN idx % 2 = 0 THEN cx - rad ELSE cx END + 1.0::DOUBLE + rad, CASE WHEN idx % 2 = 0 THEN cy ELSE cy + rad END + 1.0::DOUBLE FROM p WHERE idx % 3 = 0
UNION ALL SELECT doc_id, idx, 6 + (idx % 2 = 0)::INT, 'V', 1, CASE WHEN idx % 2 = 0 THEN cx - rad ELSE cx END + 1.0::DOUBLE + rad, CASE WHEN idx % 2 = 0 THEN cy ELSE cy + rad END + 1.0::DOUBLE + rad FROM p WHERE idx % 3 = 0
UNION ALL SELECT doc_id, idx, 7 + (idx % 2 = 0)::INT, 'H', 1, cx::DOUBLE, CASE WHEN idx % 2 = 0 THEN cy ELSE cy + rad END + 1.0::DOUBLE + rad FROM p WHERE idx % 3 = 0
UNION ALL SELECT doc_id, idx, 8 + (idx % 2 = 0)::INT, 'V', 1, cx::DOUBLE, cy::DOUBLE FROM p WHERE idx % 3 = 0)"""


@query(A.with_views("el") + _SEGS + " SELECT *, TRUE AS is_valid FROM seg")
def path_segments(spark, sf_dir):
    return D.path_segments(A.path_texts(spark, sf_dir))


@query(A.with_views("el") + _SEGS + ", n AS (SELECT doc_id, idx, count(*) AS n, max(subpath) AS last FROM seg GROUP BY ALL) SELECT doc_id, count(*) AS paths, sum(n)::BIGINT AS commands, sum(last + 1)::BIGINT AS subpaths, quantile_cont(n, 0.5) AS median, quantile_disc(n, 0.95) AS p95, max(n) AS largest, round(max(n) / sum(n), 6) AS largest_share FROM n GROUP BY doc_id")
def path_complexity(spark, sf_dir):
    return D.path_complexity(D.path_segments(A.path_texts(spark, sf_dir)))


@query(A.with_views("el") + _SEGS + " SELECT doc_id, idx, subpath, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS commands FROM seg GROUP BY ALL")
def subpath_boxes(spark, sf_dir):
    return D.subpath_boxes(D.path_segments(A.path_texts(spark, sf_dir)))


# -- boxes ---------------------------------------------------------------------------------------

_GAPS = """, pr AS (SELECT a.doc_id, a.idx AS a, b.idx AS b, sqrt(greatest(a.x0 - b.x1, b.x0 - a.x1, 0) ** 2 + greatest(a.y0 - b.y1, b.y0 - a.y1, 0) ** 2) AS gap, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS both_, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb,
(a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1) OR (a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1) AS inside FROM el a JOIN el b ON a.doc_id = b.doc_id AND a.idx < b.idx), pairs AS (SELECT *, both_ / (sa + sb - both_) AS iou FROM pr)"""
_EDGES = _GAPS + ", edges AS (SELECT doc_id, a, b, CASE WHEN iou >= 0.9 THEN 'bounds' WHEN inside THEN 'overlay' WHEN gap = 0 THEN 'overlap' ELSE 'near' END AS rule, round(CASE WHEN iou >= 0.9 THEN 0.95 WHEN inside THEN 0.85 WHEN gap = 0 THEN 0.7 + 0.2 * iou ELSE 0.6 * (1 - gap / 13) END, 6) AS score FROM pairs WHERE gap <= 12)"


@query(A.with_views("el") + _EDGES + " SELECT * FROM edges")
def bbox_edges(spark, sf_dir):
    return B.bbox_edges(A.elements(spark, sf_dir))


@query(A.with_views("el") + _GAPS + ", e AS (SELECT doc_id, a, b FROM pairs WHERE gap = 0 UNION SELECT doc_id, b, a FROM pairs WHERE gap = 0), reach(doc_id, idx, other) AS (SELECT doc_id, idx, idx FROM el UNION SELECT r.doc_id, r.idx, e.b FROM reach r JOIN e ON e.doc_id = r.doc_id AND e.a = r.other) SELECT doc_id, idx, min(other) AS family FROM reach GROUP BY doc_id, idx")
def overlap_families(spark, sf_dir):
    return B.overlap_families(A.elements(spark, sf_dir))


@query(A.with_views("el") + _GAPS + " SELECT doc_id, a, b FROM pairs WHERE gap = 0 AND a * 7 % 40 > b * 7 % 40")
def order_inversions(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    return B.order_inversions(el, el.selectExpr("doc_id", "idx", "idx * 7 % 40 AS pos"))


_GROUPS = ", gr AS (SELECT doc_id, idx, idx % 9 AS group_id FROM el WHERE idx % 3 = 0)"


def _groups(el: DataFrame) -> DataFrame:
    return el.filter("idx % 3 = 0").selectExpr("doc_id", "idx", "idx % 9 AS group_id")


@query(A.with_views("el") + _GROUPS + """, mv AS (SELECT m.doc_id, m.group_id, m.idx, a.idx AS anchor, least(m.idx, a.idx) AS lo, greatest(m.idx, a.idx) AS hi, x0, y0, x1, y1 FROM gr m JOIN gr a USING (doc_id, group_id) JOIN el e ON e.doc_id = m.doc_id AND e.idx = m.idx),
c AS (SELECT mv.doc_id, mv.group_id, anchor, count(*) AS conflicts FROM mv JOIN el o ON o.doc_id = mv.doc_id AND o.idx > lo AND o.idx < hi AND mv.x0 <= o.x1 AND o.x0 <= mv.x1 AND mv.y0 <= o.y1 AND o.y0 <= mv.y1 LEFT JOIN gr og ON og.doc_id = o.doc_id AND og.idx = o.idx WHERE og.group_id IS DISTINCT FROM mv.group_id GROUP BY ALL),
s AS (SELECT doc_id, group_id, anchor, sum(hi - lo)::BIGINT AS moved FROM mv GROUP BY ALL) SELECT doc_id, group_id, anchor, coalesce(conflicts, 0) AS conflicts, moved FROM s LEFT JOIN c USING (doc_id, group_id, anchor) QUALIFY row_number() OVER (PARTITION BY doc_id, group_id ORDER BY coalesce(conflicts, 0), moved, anchor) = 1""")
def order_conflicts(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    return B.order_conflicts(el, _groups(el))


@query(A.with_views("el") + _GROUPS + ", an AS (SELECT doc_id, group_id, min(idx) AS anchor FROM gr GROUP BY ALL) SELECT el.doc_id, el.idx, row_number() OVER (PARTITION BY el.doc_id ORDER BY coalesce(anchor, el.idx), el.idx) - 1 AS pos FROM el LEFT JOIN gr USING (doc_id, idx) LEFT JOIN an USING (doc_id, group_id)")
def place_groups(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    groups = _groups(el)
    return B.place_groups(el, groups, groups.groupBy("doc_id", "group_id").agg(F.min("idx").alias("anchor")))


@query()
def object_groups(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    return B.object_groups(B.bbox_edges(el), el, most=12)


@query(A.with_views("el") + _GROUPS + " SELECT doc_id, group_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS members, array_to_string(list_sort(list(DISTINCT stroke)), ',') AS strokes, array_to_string(list_sort(list(DISTINCT layer)), ',') AS layers, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM gr JOIN el USING (doc_id, idx) GROUP BY doc_id, group_id")
def group_manifest(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    return B.group_manifest(_groups(el), el)


@query(A.with_views("el") + " SELECT doc_id, tag, stroke, 'before' AS side FROM (SELECT doc_id, tag, stroke FROM el EXCEPT ALL SELECT doc_id, tag, stroke FROM el WHERE idx % 5 <> 0)")
def same_drawables(spark, sf_dir):
    el = A.elements(spark, sf_dir)
    return B.multiset_difference(el.select("doc_id", "tag", "stroke"), el.filter("idx % 5 <> 0").select("doc_id", "tag", "stroke"))


@query(A.with_views("el") + ", f AS (SELECT doc_id, idx FROM el WHERE idx % 3 = 0 UNION ALL SELECT doc_id, idx FROM el WHERE idx % 2 = 0) SELECT doc_id, idx, coalesce(n, 0) AS families FROM el LEFT JOIN (SELECT doc_id, idx, count(*) AS n FROM f GROUP BY ALL) USING (doc_id, idx) WHERE coalesce(n, 0) <> 1")
def partition_check(spark, sf_dir):
    el = A.elements(spark, sf_dir).select("doc_id", "idx")
    return B.partition_violations(el, el.filter("idx % 3 = 0").transform(united, el.filter("idx % 2 = 0")), ["doc_id", "idx"])


# -- pages and texts -------------------------------------------------------------------------------

_TERMS = ["password", "secret", "licensed under", "@mail"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term, ((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)})::INT AS uses FROM documents" for t in _TERMS) + ") WHERE uses > 0")
def blocklist_scan(spark, sf_dir):
    return D.blocklist_scan(A.table(spark, sf_dir, "documents"), _TERMS)


@query("SELECT sha256(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_hash(spark, sf_dir):
    return D.content_hash(A.table(spark, sf_dir, "documents"))


@query(" UNION ALL ".join(f"SELECT page_id, '{n}' AS rule FROM pages WHERE regexp_matches(html, '{r.replace(chr(39), chr(39) * 2)}')" for n, r in D.UNSAFE.items()))
def unsafe_markup(spark, sf_dir):
    return D.unsafe_markup(A.table(spark, sf_dir, "pages"))


@query("""WITH f AS (SELECT page_id AS file_id, 'Page' || page_id % 50 AS stem, CASE page_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'webp' END AS ext FROM pages), n AS (SELECT *, lower(stem || '_' || ext) AS pair, count(*) OVER (PARTITION BY lower(stem)) AS alone FROM f)
SELECT file_id, CASE WHEN alone = 1 THEN stem WHEN row_number() OVER (PARTITION BY pair ORDER BY file_id) = 1 THEN stem || '_' || ext ELSE stem || '_' || ext || '_' || row_number() OVER (PARTITION BY pair ORDER BY file_id) END AS name FROM n""")
def plan_names(spark, sf_dir):
    return D.plan_names(A.table(spark, sf_dir, "pages").selectExpr("page_id AS file_id", "concat('Page', page_id % 50) AS stem", "element_at(array('png', 'jpg', 'webp'), cast(page_id % 3 AS int) + 1) AS ext"))


# -- jobs ------------------------------------------------------------------------------------------


@query(A.with_views("jobs") + " SELECT job_id, count(*) AS events, arg_max(status, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id FROM jobs GROUP BY job_id")
def job_state(spark, sf_dir):
    return J.latest_state(A.jobs(spark, sf_dir))


@query(A.with_views("jobs") + ", l AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status FROM jobs GROUP BY job_id) SELECT * FROM l WHERE status NOT IN ('done', 'review', 'rejected', 'failed')")
def open_jobs(spark, sf_dir):
    return J.open_jobs(A.jobs(spark, sf_dir))


@query(A.with_views("jobs") + " SELECT job_id, version, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS version FROM jobs WHERE status = 'done') WHERE version <= 8")
def keep_versions(spark, sf_dir):
    return J.keep_versions(A.jobs(spark, sf_dir))


@query(A.with_views("jobs") + ", g AS (SELECT *, last_value(CASE WHEN status = 'done' THEN event_id END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS restored_id FROM jobs) SELECT job_id, event_id, restored_id FROM g WHERE status = 'failed'")
def restore_last_good(spark, sf_dir):
    return J.restored(A.jobs(spark, sf_dir))


@query("SELECT user_id, event_id, seconds FROM (SELECT *, greatest(1, date_diff('second', date_trunc('second', ts), date_trunc('second', lead(ts) OVER w))) AS seconds, lead(event_id) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click' AND nxt IS NOT NULL")
def timer_pairs(spark, sf_dir):
    return J.timer_pairs(A.table(spark, sf_dir, "events"))


@query(A.with_views("jobs") + " SELECT event_id, job_id, status FROM jobs ORDER BY ts DESC, event_id DESC LIMIT 60")
def recent_jobs(spark, sf_dir):
    return J.recent_jobs(A.jobs(spark, sf_dir))


@query(A.with_views("jobs") + " SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, status, count(*) AS n FROM jobs GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    return J.windowed_counts(A.jobs(spark, sf_dir))

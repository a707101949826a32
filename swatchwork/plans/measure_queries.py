"""Queries on lost colours, render pairs, border backgrounds, ramps along their axis, ribbons, runs of
colour and the full editability audit, over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from swatchwork.functions import svg as V
from swatchwork.operators import audits as Q
from swatchwork.operators import compare as C
from swatchwork.operators import curves as K
from swatchwork.operators import documents as D
from swatchwork.operators import paints as T
from swatchwork.operators import palette as P
from swatchwork.operators import shapes as S
from swatchwork.plans import pixel_queries
from swatchwork.plans.pixel_queries import _BESIDE, _LABEL, N, gap
from swatchwork.plans.table_queries import _SEGS
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


@query(A.with_views("pal") + _LABEL + f""", sh AS (SELECT doc_id, m.k AS k, round(sum(w) / sum(sum(w)) OVER (PARTITION BY doc_id), 6) AS share FROM lab GROUP BY doc_id, m.k), heavy AS (SELECT * FROM sh JOIN pal USING (doc_id, k) WHERE share >= 0.01),
ends AS (SELECT doc_id, k, r, g, b FROM pal WHERE k < 3 UNION ALL SELECT DISTINCT doc_id, -1, 255.0, 255.0, 255.0 FROM pal),
covered AS (SELECT h.doc_id, h.k FROM heavy h JOIN pal e ON e.doc_id = h.doc_id AND e.k < 3 WHERE {gap('h.', 'e.')} <= 60), blended AS (SELECT h.doc_id, h.k FROM heavy h JOIN ends a ON a.doc_id = h.doc_id JOIN ends b ON b.doc_id = h.doc_id AND a.k < b.k WHERE {_BESIDE} < 35 * 35)
SELECT doc_id, k, r, g, b, share FROM heavy h WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = h.doc_id AND c.k = h.k) AND NOT EXISTS (SELECT 1 FROM blended c WHERE c.doc_id = h.doc_id AND c.k = h.k)""")
def lost_unblended_colors(spark, sf_dir):
    hist = written(A.hist_li(spark, sf_dir))
    pal = A.palette_of(hist)
    paper = hist.select("doc_id").distinct().selectExpr("doc_id", "255 AS r", "255 AS g", "255 AS b")
    return P.lost_colors(hist, pal, pal.filter("k < 3"), radius=60.0, paper=paper)


_GROWN = "SELECT DISTINCT doc_id, y + dy AS y, x + dx AS x FROM i, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE "


@query(A.with_views("src_px", "ren_px") + f""", edge AS (SELECT * FROM src_px WHERE y IN (0, 95) UNION ALL SELECT * FROM src_px WHERE x IN (0, 95)), paper AS (SELECT doc_id, quantile_cont(r, 0.5) AS r, quantile_cont(g, 0.5) AS g, quantile_cont(b, 0.5) AS b FROM edge GROUP BY doc_id),
i AS (SELECT s.doc_id, s.y, s.x, {gap('s.', 'p.')} >= 6 AS was, {gap('o.', 'p.')} >= 6 AS is_now, {gap('s.', 'o.')} AS e FROM src_px s JOIN ren_px o USING (doc_id, y, x) JOIN paper p ON p.doc_id = s.doc_id),
re AS (SELECT doc_id, avg((n.y IS NOT NULL)::INT) AS v FROM i LEFT JOIN ({_GROWN} is_now) n USING (doc_id, y, x) WHERE was GROUP BY doc_id), pr AS (SELECT doc_id, avg((n.y IS NOT NULL)::INT) AS v FROM i LEFT JOIN ({_GROWN} was) n USING (doc_id, y, x) WHERE is_now GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(avg(greatest(0, least(1, 1 - e / 128))) FILTER (was OR is_now), 1) AS sim, avg((e >= 2)::INT) AS changed FROM i GROUP BY doc_id),
m AS (SELECT w.*, coalesce(re.v, 1) AS rec, coalesce(pr.v, 1) AS pre FROM w LEFT JOIN re USING (doc_id) LEFT JOIN pr USING (doc_id)), f AS (SELECT *, CASE WHEN rec + pre > 0 THEN 2 * rec * pre / (rec + pre) ELSE 0 END AS f1 FROM m)
SELECT doc_id, round(100 * (0.65::DOUBLE * f1 + 0.35::DOUBLE * sim), 6) AS score, round(rec * 100, 6) AS ink_recall, round(pre * 100, 6) AS ink_precision, round(f1 * 100, 6) AS ink_f1, round(sim * 100, 6) AS color_similarity, round(changed, 6) AS changed, 100 * (0.65::DOUBLE * f1 + 0.35::DOUBLE * sim) >= 99 AND rec >= 0.99 AND pre >= 0.99 AS accepted FROM f""")
def render_gate(spark, sf_dir):
    return C.render_gate(A.src_px(spark, sf_dir), A.ren_px(spark, sf_dir), N, N)


_PALE = ", pale AS (SELECT doc_id, y, x, 255 - (255 - r) // 8 AS r, 255 - (255 - g) // 8 AS g, 255 - (255 - b) // 8 AS b FROM src_px)"


@query(A.with_views("src_px") + _PALE + """, plain AS (SELECT * FROM pale WHERE least(r, g, b) >= 190 AND greatest(r, g, b) - least(r, g, b) <= 30), edge AS (SELECT * FROM plain WHERE y IN (0, 95) UNION ALL SELECT * FROM plain WHERE x IN (0, 95)),
t AS (SELECT doc_id, r // 8 AS qr, g // 8 AS qg, b // 8 AS qb, count(*) AS n, quantile_cont(r, 0.5) AS r, quantile_cont(g, 0.5) AS g, quantile_cont(b, 0.5) AS b FROM edge GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, qr, qg, qb) AS place FROM t) WHERE place <= 6 AND n >= greatest(2, floor(0.01 * total)))
SELECT doc_id, count(*) AS pixels FROM plain p WHERE EXISTS (SELECT 1 FROM k WHERE k.doc_id = p.doc_id AND greatest(abs(p.r - k.r), abs(p.g - k.g), abs(p.b - k.b)) <= 14) GROUP BY doc_id""")
def border_background(spark, sf_dir):
    px = A.src_px(spark, sf_dir).selectExpr("doc_id", "y", "x", *(f"255 - (255 - {c}) div 8 AS {c}" for c in "rgb"))
    return P.border_background(px, N, N).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pixels"))


@query(A.with_views("src_px") + """, l AS (SELECT *, r // 64 * 16 + g // 64 * 4 + b // 64 AS lab FROM src_px), reg AS (SELECT doc_id, lab, count(*) AS area, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM l GROUP BY ALL HAVING count(*) >= 60),
c AS (SELECT a.doc_id, least(a.lab, o.lab) AS lo, greatest(a.lab, o.lab) AS hi, count(*) AS n, avg((greatest(abs(a.r - o.r), abs(a.g - o.g), abs(a.b - o.b)) < 140)::INT) AS s FROM l a JOIN l o ON o.doc_id = a.doc_id AND ((o.y = a.y AND o.x = a.x + 1) OR (o.y = a.y + 1 AND o.x = a.x)) WHERE a.lab <> o.lab GROUP BY ALL),
f AS (SELECT c.* FROM c JOIN reg p ON p.doc_id = c.doc_id AND p.lab = lo JOIN reg q ON q.doc_id = c.doc_id AND q.lab = hi WHERE n >= 2 AND s >= 0.2 AND (p.r - q.r) ** 2 + (p.g - q.g) ** 2 + (p.b - q.b) ** 2 >= 1024),
e AS (SELECT doc_id, lo AS s, hi AS t FROM f UNION SELECT doc_id, hi, lo FROM f), reach(doc_id, label, other) AS (SELECT DISTINCT doc_id, s, s FROM e UNION SELECT r.doc_id, r.label, e.t FROM reach r JOIN e ON e.doc_id = r.doc_id AND e.s = r.other)
SELECT doc_id, label, min(other) AS region FROM reach GROUP BY doc_id, label""")
def merge_color_bands(spark, sf_dir):
    px = A.src_px(spark, sf_dir).withColumn("lab", F.expr("r div 64 * 16 + g div 64 * 4 + b div 64"))
    regions = px.groupBy("doc_id", F.col("lab").alias("label")).agg(F.count(F.lit(1)).alias("area"), *(F.avg(c).alias(c) for c in "rgb"))
    return S.merge_color_bands(P.region_adjacency(px, "lab", 140), regions, contacts=2, smooth=0.2, area=60)


_LUM = "0.299::DOUBLE * slope_{d}_r + 0.587::DOUBLE * slope_{d}_g + 0.114::DOUBLE * slope_{d}_b"


@query(A.with_views("ramp_px") + ", plane AS (" + pixel_queries.SQL["plane_fit"].removeprefix(A.with_views("ramp_px")) + f"), a AS (SELECT doc_id, {_LUM.replace('{d}', 'x')} AS gx, {_LUM.replace('{d}', 'y')} AS gy FROM plane), " + """
t AS (SELECT p.*, round((x * gx + y * gy) / sqrt(gx * gx + gy * gy), 6) AS t FROM ramp_px p JOIN a USING (doc_id)), ends AS (SELECT doc_id, min(t) AS lo, max(t) - min(t) AS length FROM t GROUP BY doc_id HAVING max(t) - min(t) >= 24),
s AS (SELECT doc_id, k AS stop, floor(quantile_cont(r, 0.5))::INT AS r, floor(quantile_cont(g, 0.5))::INT AS g, floor(quantile_cont(b, 0.5))::INT AS b FROM t JOIN ends USING (doc_id), (SELECT unnest(range(5))::INT AS k) WHERE abs(t - (lo + length * k / 4)) <= length * 0.08::DOUBLE + 1e-9 GROUP BY doc_id, k HAVING count(*) >= 20),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stop) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
walk(doc_id, pos, stop, r, g, b, kept) AS (SELECT doc_id, pos, stop, r, g, b, TRUE FROM n WHERE pos = 1 UNION ALL SELECT n.doc_id, n.pos, CASE WHEN yes THEN n.stop ELSE w.stop END, CASE WHEN yes THEN n.r ELSE w.r END, CASE WHEN yes THEN n.g ELSE w.g END, CASE WHEN yes THEN n.b ELSE w.b END, yes FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.pos = w.pos + 1, LATERAL (SELECT greatest(abs(n.r - w.r), abs(n.g - w.g), abs(n.b - w.b)) > 40 OR n.pos = n.n AS yes) z),
ok AS (SELECT p.doc_id FROM n p JOIN n q ON p.doc_id = q.doc_id AND p.pos = 1 AND q.pos = q.n AND q.n >= 2 WHERE greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b)) >= 30)
SELECT doc_id, stop, r, g, b FROM walk JOIN ok USING (doc_id) WHERE kept""")
def axis_stops(spark, sf_dir):
    return S.axis_stops(A.ramp_px(spark, sf_dir), least=20, near=40)


@query(A.with_views("shapes") + """, c AS (SELECT doc_id, z % 8 AS comp_id, sum(rad * rad * 3)::BIGINT AS area, sum(2.0 + cx)::DOUBLE AS length, stddev_pop(rad) / avg(rad) AS cv FROM shapes GROUP BY ALL)
SELECT doc_id, comp_id, round(area / length, 4) AS width, round(cv, 6) AS cv, CASE WHEN length < 10 THEN 'too_short' WHEN area / length <= 0.5 OR area / length > 2.2 * 13 THEN 'width' WHEN length < 2.5 * (area / length) THEN 'stubby' WHEN cv > 0.35 THEN 'uneven' END AS reason FROM c""")
def even_ribbons(spark, sf_dir):
    s = A.shapes(spark, sf_dir).withColumn("comp_id", F.col("z") % 8)
    per = s.groupBy("doc_id", "comp_id")
    return Q.even_ribbons(per.agg(F.sum(F.expr("rad * rad * 3")).alias("area")), per.agg(F.sum(F.expr("2.0D + cx")).alias("length")), s.selectExpr("doc_id", "comp_id", "rad AS half"))


@query(A.with_views("hist_li") + """, u AS (SELECT * FROM (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id, g % 4 ORDER BY b) - 1 AS place, count(*) OVER (PARTITION BY doc_id, g % 4) AS n, g % 4 AS part FROM hist_li) WHERE place >= n // 2), o AS (SELECT doc_id * 4 + part AS curve_id, quantile_cont(b, 0.5) / 255 AS o FROM u GROUP BY ALL)
SELECT curve_id, CASE WHEN o >= 0.985 THEN 1.0 ELSE round(greatest(0.02, o), 3) END AS opacity FROM o""")
def core_opacity(spark, sf_dir):
    return Q.core_opacity(A.hist_li(spark, sf_dir).selectExpr("doc_id * 4 + g % 4 AS curve_id", "b AS a"))


@query(A.with_views("polylines") + """, q AS (SELECT curve_id, seq, (floor(y / 200)::BIGINT % 3)::INT AS label FROM polylines), t AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY curve_id ORDER BY seq) = label THEN 0 ELSE 1 END AS turn FROM q), r AS (SELECT *, sum(turn) OVER (PARTITION BY curve_id ORDER BY seq) AS run FROM t),
n AS (SELECT curve_id, run, any_value(label) AS label, count(*) AS n FROM r GROUP BY ALL) SELECT curve_id, count(*) AS runs, count(*) FILTER (n >= 6) AS long_runs, count(DISTINCT label) FILTER (n >= 6) AS labels, coalesce(max(label) FILTER (n >= 6) - min(label) FILTER (n >= 6), 0) * 50 > 80 AS is_far, coalesce(max(label) FILTER (n >= 6) - min(label) FILTER (n >= 6), 0) * 50 > 80 AND count(*) <= 8 AS is_cut FROM n GROUP BY curve_id""")
def color_runs(spark, sf_dir):
    label = F.expr("cast(cast(floor(y / 200) AS bigint) % 3 AS int)")
    return K.color_runs(A.polylines(spark, sf_dir).withColumn("label", label).selectExpr("curve_id", "seq", "label", "label * 50 AS r", "10 AS g", "20 AS b"))


@query(A.with_views("el") + " SELECT doc_id, idx, stroke <> 'none' AND idx % 3 <> 0 AS visible FROM el")
def visible_stroke(spark, sf_dir):
    width = F.expr("element_at(array('0.0px', 'wide', '2'), idx % 3 + 1)")
    return A.elements(spark, sf_dir).select("doc_id", "idx", V.visible_stroke(F.concat(F.lit(" "), "stroke"), width).alias("visible"))


_SUFFIXES = (".html", ".png", ".zip")


@query(f"SELECT page_id AS file_id, regexp_extract(name, '[^.].*?(\\.[^.]+)$', 1) AS suffix, regexp_extract(name, '[^.].*?(\\.[^.]+)$', 1) IN {_SUFFIXES} AND page_id % 10 <> 0 AS blocked FROM (SELECT page_id, lower(list_extract(string_split(coalesce(CASE WHEN page_id % 10 = 0 THEN 'keep/a.png' ELSE regexp_replace(url, '[?#].*$', '') END, ''), '/'), -1)) AS name FROM pages)")
def blocked_suffixes(spark, sf_dir):
    path = F.expr(r"if(page_id % 10 = 0, 'keep/a.png', regexp_replace(url, '[?#].*$', ''))")
    return D.blocked_suffixes(A.table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), path.alias("path")), _SUFFIXES, ("keep/a.png",))


def _penalty(v: str, free: float, severe: float, most: float) -> str:
    return f"greatest(0, least(1, ({v} - {free}) / ({severe} - {free})::DOUBLE)) * {most}"


@query(A.with_views("el") + _SEGS + f""", n AS (SELECT doc_id, idx, count(*) * 60 AS n, max(subpath) + 1 AS subs, count(*) FILTER (cmd = 'C') * 120 AS ctl FROM seg GROUP BY ALL), c AS (SELECT doc_id, count(*) AS paths, sum(n) AS nodes, sum(ctl) AS controls, max(ctl) AS most_controls, quantile_cont(n, 0.5) AS median, quantile_disc(n, 0.95) AS p95, max(n) AS largest, max(n) / sum(n) AS largest_share, max(subs) AS most_subpaths FROM n GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS drawables, count(id) AS with_id, count(*) FILTER (layer LIKE '%1') AS grouped, count(*) FILTER (idx % 4 = 3) AS with_role, count(DISTINCT style) AS roles, count(DISTINCT fill) AS solid_paints, count(*) FILTER (idx % 13 = 0) AS gradients, count(*) FILTER (tag <> 'path') AS native, count(*) FILTER (stroke <> 'none') AS strokes, count(DISTINCT layer) AS groups, count(DISTINCT layer) FILTER (layer NOT LIKE '%1') AS color_layers FROM el GROUP BY doc_id),
j AS (SELECT s.*, coalesce(paths, 0) AS paths, coalesce(nodes, 0) + native AS nodes, coalesce(controls, 0) AS controls, coalesce(most_controls, 0) AS most_controls, coalesce(median, 0) AS median, coalesce(p95, 0) AS p95, coalesce(largest, 0) AS largest, coalesce(largest_share, 0) AS largest_share, coalesce(most_subpaths, 0) AS most_subpaths FROM s LEFT JOIN c USING (doc_id)),
b AS (SELECT *, color_layers = groups AS only_layers, round(least(100, 30 * least(1, with_id / drawables / 0.8) + 25 * least(1, grouped / drawables / 0.4) + CASE WHEN roles > 0 THEN 20 * least(1, with_role / drawables / 0.8) WHEN solid_paints > 0 OR gradients > 0 THEN 8 ELSE 0 END + 5 * ((native > 0)::INT + (strokes > 0)::INT + (gradients > 0)::INT) + 10 - 4 * (largest >= 500)::INT - 4 * (most_subpaths > 20)::INT - 2 * (largest_share > 0.45)::INT), 1) AS readiness,
round(greatest({_penalty("paths", 40, 300, 22)}, {_penalty("nodes", 500, 5000, 24)}, {_penalty("controls", 500, 5000, 18)}) + greatest({_penalty("median", 40, 150, 8)}, {_penalty("p95", 120, 450, 10)}, {_penalty("largest", 250, 800, 12)}, {_penalty("most_controls", 100, 1200, 10)}, {_penalty("most_subpaths", 20, 100, 6)}, {_penalty("largest_share", 0.45, 0.85, 6)}), 1) AS redraw_burden,
round({_penalty("groups", 60, 180, 6)} + CASE WHEN drawables >= 20 AND with_id = 0 THEN 8 WHEN drawables >= 50 AND with_id / drawables < 0.1 THEN 5 ELSE 0 END + CASE WHEN color_layers = groups THEN 10 ELSE 0 END, 1) AS workflow_burden FROM j),
o AS (SELECT *, array_to_string(list_filter([CASE WHEN paths >= 200 THEN 'path_count_at_least_200' END, CASE WHEN nodes >= 4000 THEN 'node_count_at_least_4000' END, CASE WHEN largest >= 500 THEN 'one_path_at_least_500_commands' END, CASE WHEN most_subpaths >= 50 THEN 'one_path_at_least_50_subpaths' END], lambda v: v IS NOT NULL), ',') AS outline,
array_to_string(list_filter([CASE WHEN only_layers AND groups >= 20 THEN 'twenty_plus_color_layers_without_semantic_groups' END, CASE WHEN drawables >= 100 AND with_id = 0 THEN 'one_hundred_plus_objects_without_ids' END], lambda v: v IS NOT NULL), ',') AS rest FROM b)
SELECT doc_id, readiness, CASE WHEN readiness >= 80 THEN 'ready_for_common_operations' WHEN readiness >= 55 THEN 'partially_ready' ELSE 'limited' END AS readiness_status, redraw_burden, CASE WHEN 100 - redraw_burden >= 85 AND outline = '' THEN 'low' WHEN 100 - redraw_burden >= 70 AND largest < 500 THEN 'moderate' WHEN 100 - redraw_burden >= 50 THEN 'high' ELSE 'very_high' END AS redraw_level, workflow_burden,
CASE WHEN workflow_burden = 0 THEN 'low' WHEN workflow_burden <= 6 THEN 'moderate' WHEN workflow_burden <= 15 THEN 'high' ELSE 'very_high' END AS workflow_level, outline || CASE WHEN outline <> '' AND rest <> '' THEN ',' ELSE '' END || rest AS triggers,
CASE WHEN 100 - redraw_burden >= 75 AND 100 - redraw_burden - workflow_burden >= 75 AND readiness >= 55 AND outline = '' AND rest = '' THEN 'accepted' ELSE 'manual_review' END AS status FROM o""")
def editability_audit(spark, sf_dir):
    """Each command of the small paths stands for sixty, so that the penalties differ."""
    seg = D.path_segments(A.path_texts(spark, sf_dir)).filter("is_valid")
    path = seg.groupBy("doc_id", "idx").agg((F.count(F.lit(1)) * 60).alias("n"), (F.max("subpath") + 1).alias("subs"), (F.count_if(F.col("cmd") == "C") * 120).alias("ctl"))
    shape = path.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("paths"), F.sum("n").alias("nodes"), F.sum("ctl").alias("controls"), F.max("ctl").alias("most_controls"), F.percentile("n", F.lit(0.5)).alias("median"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").alias("p95"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("largest_share"), F.max("subs").alias("most_subpaths"),
    )
    count = {
        "drawables": "count(1)", "with_id": "count(id)", "grouped": "count_if(layer LIKE '%1')", "with_role": "count_if(idx % 4 = 3)", "roles": "count(DISTINCT style)", "solid_paints": "count(DISTINCT fill)", "gradients": "count_if(idx % 13 = 0)",
        "native": "count_if(tag <> 'path')", "strokes": "count_if(stroke <> 'none')", "groups": "count(DISTINCT layer)", "color_layers": "count(DISTINCT layer) FILTER (WHERE layer NOT LIKE '%1')",
    }
    own = A.elements(spark, sf_dir).groupBy("doc_id").agg(*(F.expr(e).alias(n) for n, e in count.items()))
    return T.editability_audit(own.join(shape, "doc_id", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)) + F.col("native")))

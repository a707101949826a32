"""Queries on rings, dashes, scan conversion, path curves and ramps of several regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from swatchwork.operators import paths as D
from swatchwork.operators import rings as R
from swatchwork.operators import shapes as S
from swatchwork.operators.checks import sample_path
from swatchwork.operators.curves import circle_spans
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


def _rings(spark, sf_dir):
    lines = A.arcs(spark, sf_dir)
    views = lines.select("doc_id").distinct().selectExpr("doc_id", "200.0D AS view_w", "200.0D AS view_h")
    return R.ring_candidates(written(A.arc_points(spark, sf_dir)), lines.select(*R.ARC, "paint", "width", "opacity", "linecap", "linejoin"), views)


@query()
def ring_candidates(spark, sf_dir):
    return _rings(spark, sf_dir)


@query()
def rank_annuli(spark, sf_dir):
    return S.rank_annuli(_rings(spark, sf_dir))


_MOMENTS = """, m AS (SELECT curve_id, avg(x) AS mx, avg(y) AS my FROM ring_pts GROUP BY curve_id), c AS (SELECT curve_id, x, y, x - mx AS u, y - my AS v, mx, my FROM ring_pts JOIN m USING (curve_id)),
s AS (SELECT curve_id, mx, my, count(*) AS n, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * (u * u + v * v)) AS uz, sum(v * (u * u + v * v)) AS vz FROM c GROUP BY ALL),
f AS (SELECT curve_id, mx + (uz * vv - vz * uv) / (2 * (uu * vv - uv * uv)) AS cx, my + (vz * uu - uz * uv) / (2 * (uu * vv - uv * uv)) AS cy, sqrt(((uz * vv - vz * uv) / (2 * (uu * vv - uv * uv))) ** 2 + ((vz * uu - uz * uv) / (2 * (uu * vv - uv * uv))) ** 2 + (uu + vv) / n) AS radius FROM s),
d AS (SELECT curve_id, abs(sqrt((x - cx) ** 2 + (y - cy) ** 2) - radius) AS d FROM ring_pts JOIN f USING (curve_id))
SELECT curve_id, n, round(cx, 3) AS cx, round(cy, 3) AS cy, round(radius, 3) AS radius, round(sqrt(avg(d * d)), 3) AS rms, round(quantile_cont(d, 0.95), 3) AS p95 FROM d JOIN f USING (curve_id) JOIN (SELECT curve_id, count(*) AS n FROM ring_pts GROUP BY ALL) USING (curve_id) GROUP BY ALL"""


@query(A.with_views("ring_pts") + _MOMENTS)
def mad_circles(spark, sf_dir):
    """The points of this table are all near their circles, so the trimmed fit is the plain one."""
    fit = R.mad_circles(A.ring_pts(spark, sf_dir), ["curve_id"])
    return fit.select("curve_id", "n", *(F.round(c, 3).alias(c) for c in ("cx", "cy", "radius", "rms", "p95")))


_DASHES = """, b AS (SELECT DISTINCT doc_id, paint, unnest(range(floor(a0)::INT, ceil(a1)::INT)) % 360 AS bin FROM arcs),
g AS (SELECT *, coalesce(lead(bin) OVER w, min(bin) OVER (PARTITION BY doc_id, paint) + 360) - bin - 1 AS gap FROM b WINDOW w AS (PARTITION BY doc_id, paint ORDER BY bin)),
best AS (SELECT doc_id, paint, max(gap) AS most, arg_min((bin + 1) % 360, (-gap, (bin + 1) % 360)) AS start_ FROM g GROUP BY ALL),
p AS (SELECT doc_id, paint, (bin - (start_ + most // 2) % 360 + 360) % 360 AS p, most, (start_ + most // 2) % 360 AS middle FROM b JOIN best USING (doc_id, paint) WHERE most > 0),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, paint ORDER BY p) AS run FROM p),
run AS (SELECT doc_id, paint, middle, min(p) AS lo, max(p) + 1 AS hi FROM r GROUP BY doc_id, paint, middle, run),
e AS (SELECT *, lo - coalesce(lag(hi) OVER w, 0) AS before_, hi - lo AS size, row_number() OVER w AS nth, lead(lo) OVER w IS NULL AS final FROM run WINDOW w AS (PARTITION BY doc_id, paint ORDER BY lo)),
list AS (SELECT doc_id, paint, middle, 2 * nth - 1 AS pos, before_ AS n FROM e UNION ALL SELECT doc_id, paint, middle, 2 * nth, size FROM e UNION ALL SELECT doc_id, paint, middle, 2 * nth + 1, 360 - hi FROM e WHERE final UNION ALL SELECT DISTINCT doc_id, paint, middle, 0, 0 FROM e)
SELECT doc_id, paint, pos::INT AS pos, round(n * 2 * pi() * 60 / 360, 4) AS dash, -middle::DOUBLE AS rotation FROM list"""


@query(A.with_views("arcs") + _DASHES)
def ring_dashes(spark, sf_dir):
    key = ["doc_id", "paint"]
    # A bin is a whole degree of the angle here, as in the twin.
    marks = A.arcs(spark, sf_dir).select(*key, F.inline(circle_spans(F.floor("a0").cast("int"), (F.ceil("a1") - 1).cast("int"), 360)))
    radius = marks.select(*key).distinct().withColumn("radius", F.lit(60.0))
    return R.ring_dashes(marks, radius, key, 360).select(*key, F.posexplode("dashes").alias("pos", "dash"), "rotation").withColumn("dash", F.round("dash", 4))


_FILL = """, e AS (SELECT doc_id, z, cx, cy, rad, unnest([{'x1': cx - rad, 'y1': cy + 0.25, 'x2': cx + 0.5, 'y2': cy - 1.5 * rad}, {'x1': cx + 0.5, 'y1': cy - 1.5 * rad, 'x2': cx + rad + 0.25, 'y2': cy}, {'x1': cx + rad + 0.25, 'y1': cy, 'x2': cx, 'y2': cy + rad + 0.4}, {'x1': cx, 'y1': cy + rad + 0.4, 'x2': cx - rad, 'y2': cy + 0.25},
 {'x1': cx - 1, 'y1': cy - 1, 'x2': cx + 1, 'y2': cy - 1}, {'x1': cx + 1, 'y1': cy - 1, 'x2': cx + 1, 'y2': cy + 1}, {'x1': cx + 1, 'y1': cy + 1, 'x2': cx - 1, 'y2': cy + 1}, {'x1': cx - 1, 'y1': cy + 1, 'x2': cx - 1, 'y2': cy - 1}]) AS s FROM shapes),
px AS (SELECT doc_id, z, cy + dy AS y, cx + dx AS x FROM shapes, (SELECT unnest(range(-12, 12)) AS dy), (SELECT unnest(range(-9, 10)) AS dx)),
hit AS (SELECT px.doc_id, px.z, px.y, px.x FROM px JOIN e USING (doc_id, z) WHERE (s.y1 <= y + 0.5) <> (s.y2 <= y + 0.5) AND s.x1::DOUBLE + (y + 0.5 - s.y1::DOUBLE) / (s.y2::DOUBLE - s.y1::DOUBLE) * (s.x2::DOUBLE - s.x1::DOUBLE) <= x + 0.5 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT doc_id, z, y::INT AS y, x::INT AS x FROM hit WHERE y BETWEEN 0 AND 95 AND x BETWEEN 0 AND 95"""


@query(A.with_views("shapes") + _FILL)
def scan_fill(spark, sf_dir):
    """Four-sided shapes with a square hole."""
    outer = "array(struct(x - rad AS x, y + 0.25D AS y), struct(x + 0.5D AS x, y - 1.5D * rad AS y), struct(x + rad + 0.25D AS x, y AS y), struct(x AS x, y + rad + 0.4D AS y))"
    inner = "array(struct(x - 1 AS x, y - 1 AS y), struct(x + 1 AS x, y - 1 AS y), struct(x + 1 AS x, y + 1 AS y), struct(x - 1 AS x, y + 1 AS y))"
    at = A.shapes(spark, sf_dir).selectExpr("doc_id", "z", "rad", "cast(cx AS double) AS x", "cast(cy AS double) AS y")
    pts = at.selectExpr("doc_id", "z", f"posexplode(array({outer}, {inner})) AS (contour, c)").selectExpr("doc_id", "z", "contour", "posexplode(c) AS (seq, p)").select("doc_id", "z", "contour", "seq", "p.x", "p.y")
    key = ["doc_id", "z"]
    return R.span_pixels(R.scan_fill(R.polygon_edges(pts, key), key), key, F.lit(96), F.lit(96))


def _curves(spark, sf_dir):
    """The path texts with an arc of growing radii, short curves and a closed sub-path behind them."""
    more = "concat(d, ' A', idx % 7, ' ', 3 + idx % 5, ' ', idx * 9 % 180, ' ', idx % 2, ' ', idx div 2 % 2, ' ', 10 + idx, ' ', 60 - idx, ' q3 4 6 0 t6 2 t5 -3 s4 4 8 0 Z') AS d"
    return D.path_curves(A.path_texts(spark, sf_dir).selectExpr("doc_id", "idx", more))


@query()
def path_curves(spark, sf_dir):
    return _curves(spark, sf_dir)


@query()
def curve_boxes(spark, sf_dir):
    return D.curve_boxes(_curves(spark, sf_dir))


@query()
def sample_curves(spark, sf_dir):
    """Points along whole paths, arcs given by their end points among them."""
    rows = _curves(spark, sf_dir).withColumn("seg", F.struct("idx", "seg"))
    return sample_path(rows, 3.0).select("doc_id", "seg.idx", "seg.seg", "k", "x", "y")


@query()
def region_ramps(spark, sf_dir):
    """Two regions a document, each flat in its middle colour now."""
    px = written(A.ramp_px(spark, sf_dir).withColumn("region", F.col("y").bitwiseAND(32)))
    flat = px.groupBy("doc_id", "region").agg(*(F.percentile(c, F.lit(0.5)).alias(f"f{c}") for c in "rgb"))
    return S.region_ramps(px.join(flat, ["doc_id", "region"]), S.RampParams(area=64, least=8))

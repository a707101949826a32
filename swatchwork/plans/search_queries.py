"""Queries on staged searches, repair verdicts, stage chains and relabelled lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from swatchwork.operators import audits as Q
from swatchwork.operators import search as U
from swatchwork.operators.rules import METRICS, structure_score
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
def staged_search(spark, sf_dir):
    """An item's lines are its candidates: each set of switched-off features is one of them."""
    cand = written(A.cand(spark, sf_dir))
    on = lambda c: f"if({c} = 'auto', 'on', 'off') AS {c}"
    requests = cand.filter("cand_no = 1").selectExpr("item_id", *map(on, U.FEATURES), "if(item_id % 3 = 0, 'keep', 'auto') AS background")
    scores = cand.select(
        "item_id", "cand_no", F.col("foreground").alias("quality"), structure_score(F.col("nodes"), F.lit(0), F.lit(0)).alias("structure"), "nodes", F.expr("cast(nodes div 20 AS int)").alias("elements"),
        (F.col("nodes") % 11 == 0).alias("free_closed"), *METRICS, "eligible_cells", "eligible_components", "light_pixels",
    )

    def evaluate(todo):
        off = sum((F.when(F.col(f) == "off", 1 << k).otherwise(0) for k, f in enumerate(U.FEATURES)), F.lit(0))
        return todo.withColumn("cand_no", off % 7 + 1).join(scores, ["item_id", "cand_no"]).drop("cand_no")

    return U.staged_search(requests, evaluate).select("item_id", *U.OPTIONS, "round", "status", "quality", "visual")


_CHANGES = """, box AS (SELECT doc_id, cx - rad - 2 AS x0, cy - rad - 2 AS y0, cx + rad + 2 AS x1, cy + rad + 2 AS y1 FROM shapes WHERE z % 7 = 3),
ch AS (SELECT s.doc_id, s.y, s.x FROM src_px s JOIN ren_px t USING (doc_id, y, x) WHERE s.r <> t.r OR s.g <> t.g OR s.b <> t.b OR s.a <> t.a),
far AS (SELECT * FROM ch c WHERE NOT EXISTS (SELECT 1 FROM box b WHERE b.doc_id = c.doc_id AND c.x >= b.x0 AND c.x < b.x1 AND c.y >= b.y0 AND c.y < b.y1))
SELECT d.doc_id, (SELECT count(*) FROM ch WHERE ch.doc_id = d.doc_id) AS changed, (SELECT count(*) FROM far WHERE far.doc_id = d.doc_id) AS outside, TRUE AS same_size FROM (SELECT DISTINCT doc_id FROM shapes) d"""


def _changes(spark, sf_dir):
    boxes = A.shapes(spark, sf_dir).filter("z % 7 = 3").selectExpr("doc_id", "cx - rad AS x", "cy - rad AS y", "2 * rad AS w", "2 * rad AS h")
    return U.repair_changes(A.src_px(spark, sf_dir), A.ren_px(spark, sf_dir), boxes)


@query(A.with_views("src_px", "ren_px") + _CHANGES)
def repair_changes(spark, sf_dir):
    """The parts that the render drops are the boxes that may change."""
    return _changes(spark, sf_dir)


@query()
def repair_audit(spark, sf_dir):
    docs = A.shapes(spark, sf_dir).groupBy("doc_id").agg(F.min("rad").alias("rad"), F.array_sort(F.collect_set("z")).alias("parts"))
    proposals = docs.selectExpr("doc_id", "if(doc_id % 9 = 8, 'skipped', 'proposed') AS status")
    repairs = A.shapes(spark, sf_dir).filter("z % 7 = 3").selectExpr("doc_id", "z AS component", "cx - rad AS x", "cy - rad AS y", "if(doc_id % 10 = 9, 0, 2 * rad) AS w", "2 * rad AS h")
    failures = docs.selectExpr("doc_id", "filter(parts, z -> z % 7 = 3) AS before", "if(doc_id % 4 = 3, NULL, filter(parts, z -> z % 21 = if(doc_id % 4 = 2, 4, 99))) AS after")
    gates = docs.selectExpr("doc_id", "if(doc_id % 3 = 0, 'accepted', 'manual_review') AS before", "if(doc_id % 5 = 0, 'manual_review', 'accepted') AS after")
    names = F.explode(F.array(*map(F.lit, U.REPAIR_DROPS))).alias("metric")
    metrics = docs.select("doc_id", "rad", names).selectExpr("doc_id", "metric", "90.0D AS before", "90.0D - if(doc_id % 6 = length(metric) % 6, 0.3D, 0D) AS after", "doc_id % 2 = 0 AS applies")
    return U.repair_audit(proposals, repairs, failures, gates, metrics, _changes(spark, sf_dir))


@query()
def stage_chain(spark, sf_dir):
    """Three changes of all elements; the second is refused for every third document."""
    rows = A.elements(spark, sf_dir).select("doc_id", "idx", "tag", "fill", "stroke")
    third = lambda before, after: before.select("doc_id").distinct().selectExpr("doc_id", "doc_id % 3 <> 0 AS accepted", "'third' AS reason")
    every = lambda before, after: before.select("doc_id").distinct().selectExpr("doc_id", "true AS accepted", "'' AS reason")
    stages = [
        U.Stage("upper", lambda df: df.withColumn("fill", F.upper("fill")), every),
        U.Stage("no_lines", lambda df: df.filter("tag <> 'line'"), third),
        U.Stage("off", lambda df: df.limit(0), every, enabled=False),
        U.Stage("outline", lambda df: df.withColumn("stroke", F.coalesce(F.when(F.col("stroke") == "none", F.col("fill")), F.col("stroke"))), every),
    ]
    return U.stage_chain(rows, stages)[1]


@query()
def relabelled_lines(spark, sf_dir):
    """Thin diagonals of all parts, each over three bands of labels."""
    bars = A.shapes(spark, sf_dir).select("doc_id", "z", F.explode(F.sequence(F.lit(5), F.lit(60))).alias("x"), "r", "g", "b").selectExpr("doc_id", "x + z * 4 AS y", "x", "r", "g", "b", "x % 3 AS label")
    docs = bars.select("doc_id").distinct()
    stats = docs.selectExpr("doc_id", "255D AS bg_r", "255D AS bg_g", "255D AS bg_b", "6D AS threshold")
    pal = docs.selectExpr("doc_id", "posexplode(array(0, 64, 128, 192)) AS (k, v)").selectExpr("doc_id", "k", "cast(v AS double) AS r", "cast(v AS double) AS g", "cast(v AS double) AS b")
    return Q.relabelled_lines(bars.drop("label"), stats, bars.select("doc_id", "y", "x", "label"), pal)[1]

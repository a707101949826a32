"""Input views of the operators, derived from the supplied tables by integer formulas.

Each view exists twice: as a DataFrame, and in ``CTES`` as DuckDB SQL for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swatchwork.operators.raster import rasterize
from swatchwork.runtime import by_shuffle

SIDE = 96


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey div 40 AS doc_id", "cast(p_partkey % 40 AS int) AS z", "cast(p_partkey * 17 % 96 AS int) AS cx", "cast(p_partkey * 29 % 96 AS int) AS cy",
        "cast(2 + p_size % 6 AS int) AS rad", "cast(p_partkey * 53 % 8 * 32 AS int) AS r", "cast(p_size * 41 % 8 * 32 AS int) AS g", "cast(cast(floor(p_retailprice) AS bigint) % 4 * 64 AS int) AS b",
    )


def src_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasterize(shapes(spark, sf_dir), SIDE, SIDE)


def ren_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged picture: some shapes gone, some documents shifted, some colours turned."""
    all_docs = shapes(spark, sf_dir)
    hurt = all_docs.filter("z % 7 <> 3").withColumn("cx", F.expr("cx + if(doc_id % 3 = 1, 1, 0)")).withColumn("r", F.expr("if(z % 11 = 5, 255 - r, r)"))
    return rasterize(hurt, SIDE, SIDE, docs=all_docs.select("doc_id").distinct())


def hist_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey % 10 AS doc_id", "cast(l_partkey * 7 % 256 AS int) AS r", "cast(cast(l_quantity AS int) * 5 % 256 AS int) AS g", "cast(l_linenumber * 36 % 256 AS int) AS b"
    ).groupBy("doc_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("w"))


def palette_of(hist: DataFrame, size: int = 8) -> DataFrame:
    """The heaviest colours of each document, ties by colour."""
    by = Window.partitionBy("doc_id").orderBy(F.desc("w"), "r", "g", "b")
    return hist.withColumn("k", F.row_number().over(by) - 1).filter(F.col("k") < size).selectExpr("doc_id", "k", "cast(r AS double) r", "cast(g AS double) g", "cast(b AS double) b")


def ramp_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey % 16 AS doc_id", "cast(l_linenumber * 8 AS int) AS y", "cast(l_partkey % 64 AS int) AS x", "cast(l_quantity AS int) % 5 AS v"
    ).groupBy("doc_id", "y", "x").agg(F.max("v").alias("v")).selectExpr("doc_id", "y", "x", "2 * x AS r", "x + y AS g", "100 + v AS b", "255 AS a")


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seq = F.row_number().over(by).cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("curve_id"), seq.alias("seq"), seq.cast("double").alias("x"), F.col("value").cast("double").alias("y"))


def ring_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("user_id % 20 AS curve_id", "event_id AS seq", "radians(event_id * 7 % 360) AS theta", "50 + user_id % 20 + (cast(value AS double) % 1) / 2 AS radius")
    return e.selectExpr("curve_id", "seq", "round(200 + radius * cos(theta), 6) AS x", "round(200 + radius * sin(theta), 6) AS y")


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey div 40 AS doc_id", "p_partkey AS arc_id", "p_brand AS paint", "cast(1 + p_size % 3 AS double) AS width", "1.0D AS opacity", "'round' AS linecap", "'round' AS linejoin",
        "cast(100 + p_partkey % 3 AS double) AS cx", "cast(100 + p_partkey % 5 AS double) AS cy", "cast(60 + p_partkey % 2 AS double) AS radius",
        "cast(p_partkey * 37 % 360 AS double) AS a0", "cast(p_partkey * 37 % 360 + 35 + p_size AS double) AS a1",
    )


def arc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points along the arcs, about three units apart."""
    a = "radians(a0 + (a1 - a0) * seq / n)"
    return arcs(spark, sf_dir).selectExpr("*", "cast(ceil(radians(a1 - a0) * radius / 3) AS int) AS n").selectExpr("*", "explode(sequence(0, n)) AS seq").selectExpr("doc_id", "arc_id", "seq", f"cx + radius * cos({a}) AS x", f"cy + radius * sin({a}) AS y")


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate scores; rows of one item are numbered by all columns, since keys repeat."""
    li = table(spark, sf_dir, "lineitem")
    no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE))
    return li.withColumn("cand_no", no).selectExpr(
        "l_orderkey AS item_id", "cand_no", "50 + cast(l_quantity AS double) AS foreground", "100 - 300 * cast(l_discount AS double) AS color_fidelity", "cast(50 + l_partkey % 51 AS double) AS detail_p10",
        "cast(70 + l_suppkey % 31 AS double) AS detail_mean", "CASE WHEN l_partkey % 4 <> 0 THEN cast(60 + l_suppkey * 7 % 41 AS double) END AS topology_p10",
        "CASE WHEN l_returnflag = 'A' THEN cast(70 + l_partkey % 31 AS double) END AS light_coverage", "cast(l_linenumber * 3 AS int) AS eligible_cells", "cast(l_suppkey % 16 AS int) AS eligible_components",
        "cast(l_partkey % 128 AS int) AS light_pixels", "cast(10 + l_partkey % 500 AS int) AS nodes",
        "if(l_linenumber % 2 = 1, 'auto', 'off') AS strokes", "if(l_linenumber div 2 % 2 = 1, 'auto', 'off') AS gradients", "if(l_linenumber div 4 % 2 = 1, 'auto', 'off') AS geometry",
    )


_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id AS job_id", "element_at(map('signup', 'queued', 'view', 'running', 'purchase', 'done', 'click', 'review', 'error', 'failed'), event_type) AS status"
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS case_id", "l_linenumber AS task", "cast(l_quantity AS double) AS vector_s", "round(cast(l_extendedprice AS double) / 500) AS redraw_s",
        "element_at(map('A', 'actual', 'N', 'estimated', 'R', 'none'), l_returnflag) AS evidence",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS item_id", "if(o_orderkey % 2 = 0, 'left', 'right') AS tool_side", "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'left' WHEN '2' THEN 'right' WHEN '3' THEN 'left' WHEN '4' THEN 'right' ELSE 'tie' END AS answer"
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector elements, flat: geometry, id, presentation attributes and a style text."""
    hexed = "lower(concat('#', lpad(hex(r), 2, '0'), lpad(hex(g), 2, '0'), lpad(hex(b), 2, '0')))"
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand")
    s = shapes(spark, sf_dir).withColumn("p_partkey", F.expr("doc_id * 40 + z"))
    return s.join(by_shuffle(p), "p_partkey").selectExpr(
        "doc_id", "z AS idx", "element_at(array('circle', 'rect', 'path', 'line', 'polyline'), cast(p_partkey % 5 AS int) + 1) AS tag",
        "if(p_partkey % 3 = 0, NULL, concat('e', p_partkey % 37)) AS id", f"if(z % 4 = 3, NULL, {hexed}) AS fill",
        f"if(p_partkey % 2 = 0, 'none', {hexed}) AS stroke", "cast(1 + p_partkey % 3 AS double) AS stroke_width", f"if(z % 4 = 3, concat('fill: ', {hexed}, '; opacity:.5; fill:', {hexed}), NULL) AS style",
        "p_brand AS layer", "cast(cx - rad AS double) AS x0", "cast(cy - rad AS double) AS y0", "cast(cx + rad AS double) AS x1", "cast(cy + rad AS double) AS y1", "cx", "cy", "rad", "r", "g", "b",
    )


def path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path text an element of tag ``path``, with relative and repeated commands."""
    return elements(spark, sf_dir).filter("tag = 'path'").selectExpr(
        "doc_id", "idx", "concat('M', cx - rad, ' ', cy, ' L', cx, ' ', cy - rad, ' ', cx + rad, ' ', cy, ' c0 ', rad, ' ', -rad, ' ', rad, ' ', -rad, ' ', rad, if(idx % 2 = 0, ' Z', ''), if(idx % 3 = 0, concat(' m1 1 h', rad, ' v', rad, ' H', cx, ' V', cy), '')) AS d"
    )


_HEXED = "lower(printf('#%02x%02x%02x', r, g, b))"

CTES: dict[str, str] = {
    "shapes": "shapes AS (SELECT p_partkey // 40 AS doc_id, (p_partkey % 40)::INT AS z, (p_partkey * 17 % 96)::INT AS cx, (p_partkey * 29 % 96)::INT AS cy, (2 + p_size % 6)::INT AS rad, (p_partkey * 53 % 8 * 32)::INT AS r, (p_size * 41 % 8 * 32)::INT AS g, (floor(p_retailprice)::BIGINT % 4 * 64)::INT AS b FROM part)",
    "canvas": "canvas AS (SELECT doc_id, y, x FROM (SELECT DISTINCT doc_id FROM shapes), (SELECT unnest(range(96))::INT AS y), (SELECT unnest(range(96))::INT AS x))",
    "src_px": """src_painted AS (SELECT doc_id, y, x, arg_max({'r': r, 'g': g, 'b': b}, z) AS c FROM (SELECT s.*, cy + dy AS y, cx + dx AS x, dx, dy FROM shapes s, (SELECT unnest(range(-7, 8))::INT AS dy), (SELECT unnest(range(-7, 8))::INT AS dx) WHERE dx * dx + dy * dy <= rad * rad) WHERE y BETWEEN 0 AND 95 AND x BETWEEN 0 AND 95 GROUP BY ALL),
src_px AS (SELECT doc_id, y, x, coalesce(c.r, 255) AS r, coalesce(c.g, 255) AS g, coalesce(c.b, 255) AS b, 255 AS a FROM canvas LEFT JOIN src_painted USING (doc_id, y, x))""",
    "ren_px": """ren_painted AS (SELECT doc_id, y, x, arg_max({'r': CASE WHEN z % 11 = 5 THEN 255 - r ELSE r END, 'g': g, 'b': b}, z) AS c FROM (SELECT s.*, cy + dy AS y, cx + dx + CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS x, dx, dy FROM shapes s, (SELECT unnest(range(-7, 8))::INT AS dy), (SELECT unnest(range(-7, 8))::INT AS dx) WHERE dx * dx + dy * dy <= rad * rad AND z % 7 <> 3) WHERE y BETWEEN 0 AND 95 AND x BETWEEN 0 AND 95 GROUP BY ALL),
ren_px AS (SELECT doc_id, y, x, coalesce(c.r, 255) AS r, coalesce(c.g, 255) AS g, coalesce(c.b, 255) AS b, 255 AS a FROM canvas LEFT JOIN ren_painted USING (doc_id, y, x))""",
    "hist_li": "hist_li AS (SELECT l_suppkey % 10 AS doc_id, (l_partkey * 7 % 256)::INT AS r, (l_quantity::INT * 5 % 256)::INT AS g, (l_linenumber * 36 % 256)::INT AS b, count(*) AS w FROM lineitem GROUP BY ALL)",
    "pal": "pal AS (SELECT doc_id, k, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, r, g, b) - 1 AS k FROM hist_li) WHERE k < 8)",
    "ramp_px": "ramp_px AS (SELECT doc_id, y, x, 2 * x AS r, x + y AS g, 100 + v AS b, 255 AS a FROM (SELECT l_suppkey % 16 AS doc_id, (l_linenumber * 8)::INT AS y, (l_partkey % 64)::INT AS x, max(l_quantity::INT % 5) AS v FROM lineitem GROUP BY ALL))",
    "polylines": "polylines AS (SELECT user_id AS curve_id, seq::INT AS seq, seq::DOUBLE AS x, value::DOUBLE AS y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events))",
    "ring_pts": "ring_pts AS (SELECT curve_id, seq, round(200 + radius * cos(theta), 6) AS x, round(200 + radius * sin(theta), 6) AS y FROM (SELECT user_id % 20 AS curve_id, event_id AS seq, radians(event_id * 7 % 360) AS theta, 50 + user_id % 20 + (value::DOUBLE % 1) / 2 AS radius FROM events))",
    "arcs": "arcs AS (SELECT p_partkey // 40 AS doc_id, p_partkey AS arc_id, p_brand AS paint, (1 + p_size % 3)::DOUBLE AS width, 1.0::DOUBLE AS opacity, 'round' AS linecap, 'round' AS linejoin, (100 + p_partkey % 3)::DOUBLE AS cx, (100 + p_partkey % 5)::DOUBLE AS cy, (60 + p_partkey % 2)::DOUBLE AS radius, (p_partkey * 37 % 360)::DOUBLE AS a0, (p_partkey * 37 % 360 + 35 + p_size)::DOUBLE AS a1 FROM part)",
    "cand": f"""cand AS (SELECT l_orderkey AS item_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE)})::INT AS cand_no, 50 + l_quantity::DOUBLE AS foreground, 100 - 300 * l_discount::DOUBLE AS color_fidelity, (50 + l_partkey % 51)::DOUBLE AS detail_p10, (70 + l_suppkey % 31)::DOUBLE AS detail_mean,
CASE WHEN l_partkey % 4 <> 0 THEN (60 + l_suppkey * 7 % 41)::DOUBLE END AS topology_p10, CASE WHEN l_returnflag = 'A' THEN (70 + l_partkey % 31)::DOUBLE END AS light_coverage, l_linenumber * 3 AS eligible_cells, l_suppkey % 16 AS eligible_components, l_partkey % 128 AS light_pixels, 10 + l_partkey % 500 AS nodes,
CASE WHEN l_linenumber % 2 = 1 THEN 'auto' ELSE 'off' END AS strokes, CASE WHEN l_linenumber // 2 % 2 = 1 THEN 'auto' ELSE 'off' END AS gradients, CASE WHEN l_linenumber // 4 % 2 = 1 THEN 'auto' ELSE 'off' END AS geometry FROM lineitem)""",
    "jobs": "jobs AS (SELECT event_id, ts, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'review' WHEN 'error' THEN 'failed' END AS status FROM events)",
    "timings": "timings AS (SELECT l_orderkey AS case_id, l_linenumber AS task, l_quantity::DOUBLE AS vector_s, round(l_extendedprice::DOUBLE / 500) AS redraw_s, CASE l_returnflag WHEN 'A' THEN 'actual' WHEN 'N' THEN 'estimated' WHEN 'R' THEN 'none' END AS evidence FROM lineitem)",
    "answers": "answers AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS tool_side, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'left' WHEN '2' THEN 'right' WHEN '3' THEN 'left' WHEN '4' THEN 'right' ELSE 'tie' END AS answer FROM orders)",
    "el": f"""el AS (SELECT s.doc_id, z AS idx, ['circle', 'rect', 'path', 'line', 'polyline'][p_partkey % 5 + 1] AS tag, CASE WHEN p_partkey % 3 <> 0 THEN 'e' || (p_partkey % 37) END AS id, CASE WHEN z % 4 <> 3 THEN {_HEXED} END AS fill, CASE WHEN p_partkey % 2 = 0 THEN 'none' ELSE {_HEXED} END AS stroke, (1 + p_partkey % 3)::DOUBLE AS stroke_width,
CASE WHEN z % 4 = 3 THEN 'fill: ' || {_HEXED} || '; opacity:.5; fill:' || {_HEXED} END AS style, p_brand AS layer, (cx - rad)::DOUBLE AS x0, (cy - rad)::DOUBLE AS y0, (cx + rad)::DOUBLE AS x1, (cy + rad)::DOUBLE AS y1, cx, cy, rad, r, g, b FROM shapes s JOIN part ON p_partkey = s.doc_id * 40 + z)""",
}
#: Views that a view is built on.
_NEEDS = {"canvas": ("shapes",), "src_px": ("canvas",), "ren_px": ("canvas",), "pal": ("hist_li",), "el": ("shapes",)}


def with_views(*names: str) -> str:
    """``WITH ...`` for the named views and all they need, in order."""
    seen: list[str] = []

    def add(name: str):
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in seen:
            seen.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(CTES[n] for n in seen)

"""Chosen palettes, accents, ramps, circles, paints, names and keys on hand-made cases."""

import math

from pyspark.sql import functions as F


def _hist(spark, rows):
    return spark.createDataFrame([(d, *map(int, c), int(w)) for d, c, w in rows], "doc_id long, r int, g int, b int, w long")


def test_compact_adaptive_and_forced_palettes(spark):
    from swatchwork.operators import palette as P

    flat = [(1, c, 500) for c in ((0, 0, 0), (255, 255, 255), (200, 20, 20), (20, 20, 200))]
    ramp = [(2, (x * 7 % 256, y * 7 % 256, (x + y) * 5 % 256), 1 + (x * y) % 3) for x in range(0, 36, 2) for y in range(0, 36, 2)]
    hist = _hist(spark, flat + ramp)
    rows = P.choose_palette(hist).collect()
    one, two = ([r for r in rows if r.doc_id == d] for d in (1, 2))
    assert {r.mode for r in one} == {"compact"} and {(r.r, r.g, r.b) for r in one} == {c for _, c, _ in flat} and one[0].mean == 0
    assert {r.mode for r in two} == {"adaptive"} and 9 <= len(two) <= 20 and two[0].base_colors <= 8
    base = P.pruned(P.merge_close(P.weighted_kmeans(hist.filter("doc_id = 2"), 8), hist.filter("doc_id = 2"), 45.0), hist.filter("doc_id = 2"))
    fit = P.palette_fit(P.nearest_label(hist.filter("doc_id = 2"), base)).first()
    assert two[0].mean < fit["mean"] and two[0].p90 < fit.p90 and fit["mean"] > 13 and fit.p90 > 25
    assert {(r.mode, r.base_colors) for r in P.choose_palette(hist.filter("doc_id = 1"), forced=3).collect()} == {("forced", 3)}


def test_all_blends_go_in_order(spark):
    from swatchwork.operators import palette as P

    pal = spark.createDataFrame([(1, k, float(v), float(v), float(v)) for k, v in enumerate((0, 255, 100, 150))] + [(1, 4, 200.0, 0.0, 0.0)], "doc_id long, k int, r double, g double, b double")
    hist = _hist(spark, [(1, (0, 0, 0), 5000), (1, (255, 255, 255), 5000), (1, (100, 100, 100), 20), (1, (150, 150, 150), 30), (1, (200, 0, 0), 25)])
    assert {r.k for r in P.pruned(pal, hist).collect()} == {0, 1, 4}


def test_a_round_of_palettes_is_a_few_jobs(spark):
    """Six greys merge to one in five rounds, and a sixth finds no pair; each round is one pass over the colours."""
    from swatchwork.operators import palette as P

    pal = spark.createDataFrame([(d, k, *[float(40 * d + 2 * k)] * 3) for d in (1, 2) for k in range(6)] + [(3, 0, 0.0, 0.0, 0.0), (3, 1, 4.0, 4.0, 4.0)], "doc_id long, k int, r double, g double, b double")
    hist = _hist(spark, [(d, (40 * d + x,) * 3, 1) for d in (1, 2) for x in range(12)])
    spark.sparkContext.setJobGroup("merge", "")
    got = P.merge_close(pal, hist, 60.0)
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("merge")) <= 6 * 8 + 12
    # A document without a colour is merged too, each of its entries at weight 1.
    assert {(r.doc_id, r.k, r.w) for r in got.collect()} == {(1, 10, 12.0), (2, 10, 12.0), (3, 2, 1.0)}


def test_a_lost_accent_comes_back(spark):
    from swatchwork.operators import palette as P

    rows = []
    for y in range(40):
        for x in range(40):
            c = (120, 70, 20) if 5 <= y < 20 and 5 <= x < 20 else (0, 200, 0) if (x + y) % 9 == 0 and y > 25 else (255, 255, 255)
            rows.append((1, y, x, *c, 255))
    px = spark.createDataFrame(rows, "doc_id long, y int, x int, r int, g int, b int, a int")
    pal = lambda *cs: spark.createDataFrame([(1, k, *map(float, c)) for k, c in enumerate(cs)], "doc_id long, k int, r double, g double, b double")
    got = P.retain_accents(px, pal((255, 255, 255), (120, 70, 20), (0, 200, 0), (122, 70, 20)), pal((255, 255, 255), (0, 0, 0))).collect()
    assert [(r.k, r.assigned_pixels, r.strong_pixels) for r in got] == [(1, 225, 225)]
    then = min(math.dist((120, 70, 20), c) for c in ((255, 255, 255), (0, 0, 0)))
    assert abs(got[0].mean_gain - then) < 0.01


def test_ramps_that_help(spark):
    from swatchwork.operators import shapes as S

    rows = [(1, y, x, 4 * x, 100, 50) for y in range(5) for x in range(60)] + [(2, y, x, 100 + x % 2, 100, 50) for y in range(5) for x in range(60)]
    px = spark.createDataFrame(rows, "doc_id long, y int, x int, r int, g int, b int").selectExpr("*", "255 AS a")
    flat = spark.createDataFrame([(1, 118, 100, 50), (2, 100, 100, 50)], "doc_id long, r int, g int, b int")
    got = S.ramp_gate(px, S.ramp_stops(px), flat).collect()
    assert [r.doc_id for r in got] == [1] and got[0].area == 300 and got[0].ramp_mean < 6 and got[0].worse_share <= 0.1


def test_ramps_of_every_document_and_region(spark):
    from swatchwork.operators import shapes as S

    # 40 documents with a ramp along x, and one with ten: bars that get brighter along their own axes.
    rows = [(d, 0, y, x, 4 * x, 100, 50, 118, 100, 50) for d in range(40) for y in range(7) for x in range(60)]
    for k in range(10):
        steep = lambda x, y: x if k % 2 else x / 2 + y  # noqa: B023, E731
        rows += [(99, k, y, x, int(4 * steep(x, y)), 30, 30, 60, 30, 30) for y in range(30) for x in range(30 + k)]
    rows += [(100, 0, y, x, 100 + x % 2, 100, 50, 100, 100, 50) for y in range(5) for x in range(60)]
    rows += [(101, 0, y, x, (x * 37 + y * 91) % 256, 0, 0, 128, 0, 0) for y in range(30) for x in range(30)]
    px = spark.createDataFrame(rows, "doc_id long, region int, y int, x int, r int, g int, b int, fr int, fg int, fb int")
    got = S.region_ramps(px, S.RampParams(area=200)).collect()
    assert {r.doc_id for r in got if r.doc_id != 99} == set(range(40))
    assert sorted(r.region for r in got if r.doc_id == 99) == list(range(2, 10)), "the eight largest of a document"
    one = next(r for r in got if r.doc_id == 0)
    assert (one.x1, one.x2, len(one.stops)) == (0, 59, 5) and abs(one.y2 - one.y1) < 1e-6 and one.ramp_mean < 4
    tilted = next(r for r in got if r.doc_id == 99 and r.region == 2)
    assert abs((tilted.y2 - tilted.y1) / (tilted.x2 - tilted.x1) - 2) < 0.05
    plain = px.drop("region")
    flat = px.select("doc_id", F.col("fr").alias("r"), F.col("fg").alias("g"), F.col("fb").alias("b")).distinct()
    assert S.ramp_gate(plain.filter("doc_id < 40"), S.ramp_stops(plain.filter("doc_id < 40")), flat).count() == 40


def test_rings_with_repeated_ids_and_long_chains(spark):
    from swatchwork.operators import shapes as S

    arc = lambda d, i, paint, a0, a1: (d, i, paint, 2.0, 1.0, "round", "round", 50.0, 50.0, 30.0, a0, a1)
    arcs = [arc(0, 1, "red", 0.0, 100.0), arc(0, 2, "red", 120.0, 220.0), arc(1, 1, "red", 0.0, 100.0), arc(1, 2, "blue", 120.0, 220.0)]
    df = spark.createDataFrame(arcs, "doc_id long, arc_id long, paint string, width double, opacity double, linecap string, linejoin string, cx double, cy double, radius double, a0 double, a1 double")
    assert [(r.doc_id, r.ring, r.arcs) for r in S.annulus_candidates(df).collect()] == [(0, 1, 2)]
    n = 100_000
    chain = spark.range(n).selectExpr("1L AS doc_id", "concat('g', id) AS id", f"if(id < {n - 1}, concat('g', id + 1), null) AS href", f"if(id = {n - 1}, 3, 0) AS stops")
    loop = spark.createDataFrame([(2, "a", "b", 0), (2, "b", "c", 0), (2, "c", "b", 0), (2, "d", "nowhere", 0)], "doc_id long, id string, href string, stops int")
    got = S.resolved_stops(chain.unionByName(loop))
    assert got.filter("doc_id = 1 AND stops = 3").count() == n and got.filter("doc_id = 2 AND stops <> 0").count() == 0


def test_near_circles(spark):
    from swatchwork.operators import curves as K

    at = lambda k, d, r: (k, d, 50 + r * math.cos(math.radians(d)), 40 + r * math.sin(math.radians(d)))
    rows = [at(1, d, 20) for d in range(0, 360, 10)] + [at(2, d, 20) for d in range(0, 200, 10)] + [at(3, d, 20 + 3 * (d % 40 == 0)) for d in range(0, 360, 10)] + [at(4, d, 2) for d in range(0, 360, 10)]
    pts = spark.createDataFrame(rows, "curve_id int, seq int, x double, y double")
    assert [(r.curve_id, round(r.radius)) for r in K.near_circle(pts, K.circle_fit(pts)).collect()] == [(1, 20)]


def test_gradient_layers_by_their_middle_stop(spark):
    from swatchwork.operators import paints as T

    stops = lambda c: [(0.0, "#ffffff"), (0.5, c)]
    gradients = spark.createDataFrame([(1, 0, "g0", stops("#AA0000")), (1, 1, "g1", stops("#aa0000")), (1, 2, "g2", stops("#00aa00"))], "doc_id int, pos int, id string, stops array<struct<offset:double,color:string>>")
    layers = spark.createDataFrame([(1, 0, "Gradient a", "#aa0000"), (1, 1, "x", "#123456"), (1, 2, "gradient b", "#AA0000"), (1, 3, "gradient c", "#aa0000"), (1, 4, "gradient d", "#777777"), (1, 5, "gradient e", "#888888")], "doc_id int, pos int, name string, value string")
    assert [(r.type, r.value) for r in T.paint_layers(layers, gradients).orderBy("pos").collect()] == [("linearGradient", "g0"), ("solid", "#123456"), ("linearGradient", "g1"), ("linearGradient", "g0"), ("linearGradient", "g2"), ("linearGradient", "")]
    strokes = spark.createDataFrame([(1, "#123456"), (1, "#999999"), (2, "none")], "doc_id int, color string")
    assert {tuple(r) for r in T.paint_resources(layers, gradients, strokes).collect()} == {(1, 2, 3, 5), (2, 0, 0, 0)}


def test_names_are_unique(spark):
    from swatchwork.operators.documents import plan_names

    rows = [(1, "a", "png"), (2, "a", "jpg"), (3, "a_png", "gif"), (4, "A_PNG_2", "x"), (5, "b", "c"), (6, "B", "C"), (7, "b_c_2", "z"), (8, "b", "c")]
    got = {r.file_id: r.name for r in plan_names(spark.createDataFrame(rows, "file_id int, stem string, ext string")).collect()}
    assert len(got) == 8 and len({n.lower() for n in got.values()}) == 8
    assert got[2] == "a_jpg" and got[3] == "a_png" and got[4] == "A_PNG_2" and got[7] == "b_c_2"


def test_keys_of_any_size(spark):
    from swatchwork.operators import boxes as B
    from swatchwork.operators import raster as R
    from swatchwork.operators import shapes as S

    big = 2**40
    mask = spark.createDataFrame([(big, 70_000, 70_000), (big, 70_001, 70_001), (big, 70_000, 140_000), (big + 1, 70_000, 70_000)], "doc_id long, y int, x int")
    assert sorted((r.doc_id, r.comp_id, r.y) for r in R.component_runs(mask).collect()) == [(big, 1, 70_000), (big, 1, 70_001), (big, 2, 70_000), (big + 1, 1, 70_000)]
    el = spark.createDataFrame([(0, 100_000, 0.0, 0.0, 2.0, 2.0), (0, 150_000, 1.0, 1.0, 3.0, 3.0), (1, 0, 0.0, 0.0, 2.0, 2.0), (1, 50_000, 9.0, 9.0, 10.0, 10.0)], "doc_id long, idx int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.doc_id, r.idx): r.family for r in B.overlap_families(el).collect()} == {(0, 100_000): 100_000, (0, 150_000): 100_000, (1, 0): 0, (1, 50_000): 50_000}
    bands = spark.createDataFrame([(0, 1, 200_000, 99, 1.0), (2, 200_000, 300_000, 99, 1.0)], "doc_id long, lo int, hi int, contacts long, smooth double")
    assert {(r.doc_id, r.label): r.region for r in S.merge_bands(bands).collect()} == {(0, 1): 1, (0, 200_000): 1, (2, 200_000): 200_000, (2, 300_000): 200_000}


def test_many_rounds_are_run_to_the_end(spark):
    from swatchwork.operators import curves as K
    from swatchwork.operators.paints import hue_clusters

    # Every point is a corner, and each split takes off one end: 50 levels.
    rows = [(0, i, float(2**i), float((-1) ** i) * 3.0**i) for i in range(50)]
    pts = spark.createDataFrame(rows, "curve_id int, seq int, x double, y double")
    assert K.simplify(pts, 0.1).count() == 50
    hues = spark.createDataFrame([(0, f"#{k:06x}", 1, float(k) / 10, 0.1) for k in range(45)], "doc_id int, paint string, uses int, hue double, chroma double")
    assert {r.family for r in hue_clusters(hues).collect()} == {"#000000"}


def test_a_check_fails_closed(spark):
    from swatchwork.operators.rules import validated

    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    good = lambda a, b: spark.createDataFrame([(1, True, "ok"), (2, None, "odd")], "doc_id int, accepted boolean, reason string")

    def bad(a, b):
        raise ValueError("no")

    assert {r.doc_id: (r.accepted, r.reason) for r in validated(docs, docs, good, "s").collect()} == {1: (True, "ok"), 2: (False, "odd"), 3: (False, "no_verdict")}
    assert {(r.accepted, r.reason) for r in validated(docs, docs, bad, "s").collect()} == {(False, "validator_error: ValueError")}


def test_layers_are_assembled_in_order(spark):
    from swatchwork.operators.shapes import assemble

    df = lambda *rows: spark.createDataFrame(list(rows), "doc_id int, pos int, tag string")
    got = assemble(df((1, 2, "f2"), (1, 1, "f1")), df((1, 0, "s")), df((1, 0, "r")).selectExpr("*", "tag AS why")).orderBy("at").collect()
    assert [(r.at, r.tag, r.why) for r in got] == [(1, "f1", None), (2, "f2", None), (3, "s", None), (4, "r", "r")]

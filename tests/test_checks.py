"""Hand-made lines, canvases, pockets, dots and editing checks."""

from pyspark.sql import functions as F

from swatchwork.operators import checks as K


def test_straight_cubics(spark):
    rows = [(0, 0, 1, 1, 2, 2, 4, 4, True), (0, 0, 2, 2, 1, 1, 4, 4, False), (0, 0, 1, 2, 2, 2, 4, 4, False), (3, 3, 3, 3, 3, 3, 3, 3, False), (0, 0, 0, 0, 4, 4, 4, 4, True)]
    names = [f"p{k}" for k in range(8)]
    df = spark.createDataFrame(rows, [*names, "want"])
    got = df.select(K.is_straight_cubic(*(F.col(n) for n in names)).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_canvas(spark):
    df = spark.createDataFrame([("0 0 20 10", None, None), ("0 0 0 10", "5px", "6px"), ("1 2", None, "4"), (None, None, None)], "b string, w string, h string")
    c = [F.col(n) for n in "bwh"]
    got = df.select(K.canvas_of(*c).alias("c"), K.canvas_of(*c, unit=True).alias("u")).collect()
    assert [tuple(r.c) if r.c else None for r in got] == [(0, 0, 20, 10), (0, 0, 5, 6), None, None]
    assert [tuple(r.u) for r in got][2:] == [(0, 0, 1, 1)] * 2


def test_sampled_line_and_arc(spark):
    df = spark.createDataFrame([(1, 0, "line", [0.0, 0.0, 10.0, 0.0]), (1, 1, "arc", [0.0, 0.0, 10.0, 10.0, 0.0, 90.0])], "doc_id long, seg int, kind string, p array<double>")
    rows = K.sample_path(df, 5.0).orderBy("seg", "k").collect()
    assert [(r.x, r.y) for r in rows if r.seg == 0] == [(5.0, 0.0), (10.0, 0.0)]
    assert [(r.x, r.y) for r in rows if r.seg == 1][-1] == (0.0, 10.0) and len(rows) == 2 + 4


def test_open_space_inside_a_disc(spark):
    disc = [(1, y, x) for y in range(40) for x in range(40)]
    ink = {(y, x) for y in range(5, 10) for x in range(5, 30)}
    cols = "doc_id long, y int, x int"
    got = K.background_pockets(spark.createDataFrame([p for p in disc if p[1:] not in ink], cols), spark.createDataFrame(disc, cols)).collect()
    assert [(r.area, r.rule) for r in got] == [(1600 - len(ink), "large")]
    small = [(1, y, x) for y in range(20, 24) for x in range(20, 24)]
    got = K.background_pockets(spark.createDataFrame(small, cols), spark.createDataFrame(disc, cols)).collect()
    assert [(r.area, r.rule) for r in got] == [(16, None)]


def test_dots_on_an_orbit(spark):
    import math

    rows = [(1, 0, 100.0, 100.0, 100.0, 1), (1, 1, 101.0, 100.0, 60.0, 1)]
    rows += [(1, k + 2, 100.5 + 80 * math.cos(math.tau * k / 8), 100 + 80 * math.sin(math.tau * k / 8), 5.0, 2) for k in range(8)]
    rows += [(2, 0, 50.0, 50.0, 50.0, 1)]
    got = {r.doc_id: r for r in K.concentric_dots(spark.createDataFrame(rows, "doc_id long, z int, cx double, cy double, rad double, paint int")).collect()}
    assert (got[1].large, got[1].concentric, got[1].clusters, got[1].even_angles, got[1].even_orbit, got[1].same_size) == (2, True, 8, True, True, 8)
    assert (got[2].concentric, got[2].clusters, got[2].max_dev) == (False, 0, None)


def test_mass_of_a_split_line(spark):
    """One dark row against two rows of half its strength: the same ink."""
    px = lambda rows: spark.createDataFrame([(1, y, x, *(v := [rows.get(y, 255) if 3 <= x < 17 else 255] * 3), 255) for y in range(20) for x in range(20)], "doc_id long, y int, x int, r int, g int, b int, a int")  # noqa: E731, F841
    same = K.ink_mass_match(px({10: 55}), px({10: 155, 11: 155}), 20, 20).first()
    gone = K.ink_mass_match(px({10: 55}), px({}), 20, 20).first()
    assert (same.src_ink, same.ren_ink) == (14, 28) and same.src_match == 100.0
    assert gone.ren_ink == 0 and gone.src_match < 60 and gone.ren_match is None


def test_checks_of_a_document_without_rows(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    status = spark.createDataFrame([(1, "passed")], "doc_id long, status string")
    checks = K.operation_checks(docs, {"outer-ring": status})
    assert {r.check: r.status for r in checks.collect()} == K.CHECKS | {"outer-ring": "passed"}
    s = K.operation_summary(checks).first()
    assert (s.total, s.passed, s.failed, s.manual_review, s.passed_checks) == (5, 1, 1, 3, "outer-ring")


def test_row_counters(spark):
    """Three holes in a row of ink go, two don't."""
    def doc(d, n):
        out = []
        for y in range(60):
            for x in range(200):
                hole = any(10 + 60 * k <= x < 20 + 60 * k and 20 <= y < 30 for k in range(n))
                near = any(8 + 60 * k <= x < 22 + 60 * k and 18 <= y < 32 for k in range(n))
                out.append((d, y, x, near, hole))
        return out

    df = spark.createDataFrame(doc(1, 3) + doc(2, 2), "doc_id long, y int, x int, visible boolean, background boolean")
    got = K.row_counters(df, 60, 200).collect()
    assert sorted((r.doc_id, r.area, r.removed) for r in got) == [(1, 100, True)] * 3 + [(2, 100, False)] * 2

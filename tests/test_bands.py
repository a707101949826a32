"""Pictures in packed bands: no pixels through the driver, and the same values as plain Python."""

import random

import pytest

from swatchwork.operators import bands as B
from swatchwork.operators import raster as R
from swatchwork.operators import search as U
from swatchwork.runtime import written
from swatchwork.sources import adapters as A
from tests.test_raster import plan

PX = "doc_id long, y int, x int, r int, g int, b int, a int"


@pytest.fixture(scope="module")
def px(spark):
    """Two documents of 140 rows, so that they lie in two bands, with colours that change often."""
    rng = random.Random(7)
    rows = [(d, y, x, *(rng.choice((0, 10, 250, 255)) for _ in "rgb"), rng.choice((0, 130, 255, 255))) for d in (1, 2) for y in range(140) for x in range(12)]
    return written(spark.createDataFrame(rows, PX))


def test_packed_pixels_come_back(spark, px):
    """Each pixel once in its own band, and those within the halo in the next one."""
    keep = lambda pictures, band: {"band": [band] * len(pictures[0]["y"]), **{c: pictures[0][c] for c in "yxrgba"}}
    got = B.by_band(B.packed([px], halo=2), keep, "band long, y int, x int, r int, g int, b int, a int").collect()
    assert sorted(tuple(r[c] for c in px.columns) for r in got if r.y // B.BAND == r.band) == sorted(map(tuple, px.collect()))
    assert sorted({(r.doc_id, r.band, r.y) for r in got if r.y // B.BAND != r.band}) == [(d, b, y) for d in (1, 2) for b, ys in ((-1, (0, 1)), (0, (128, 129)), (1, (126, 127))) for y in ys]


def test_repair_changes_in_bands(spark, px):
    """both pictures were joined pixel by pixel, and one of them was broadcast."""
    after = written(px.selectExpr("doc_id", "y", "x", "if(y % 7 = 3 AND x = 5, 1, r) AS r", "if(doc_id = 2 AND y = 130, NULL, g) AS g", "b", "a").filter("doc_id = 1 OR y < 139"))
    boxes = spark.createDataFrame([(1, 3.0, 0.0, 4.0, 70.0), (2, 0.0, 0.0, 1.0, 1.0)], "doc_id long, x double, y double, w double, h double")
    found = U.repair_changes(px, after, boxes)
    assert "Broadcast" not in plan(found)
    n = len([y for y in range(140) if y % 7 == 3])
    last = len([y for y in range(139) if y % 7 == 3])
    out = len([y for y in range(72, 140) if y % 7 == 3])
    assert sorted(map(tuple, found.collect())) == [(1, n, out, True), (2, last, last, False)]


def test_repair_audit_has_no_broadcast(spark):
    from swatchwork.plans import catalog

    assert "Broadcast" not in plan(catalog.QUERIES["repair_audit"](spark, "/root/testdata/sf0.001"))


def _no_spread(monkeypatch):
    """Pixels may not be copied to each of their neighbours."""
    from swatchwork.operators import compare

    def spread(*_):
        raise AssertionError("pixels are spread to their neighbours")

    for module in (R, compare):
        monkeypatch.setattr(module, "neighbour_count", spread)


def test_row_counters_has_no_broadcast(spark, monkeypatch):
    """hole pixels, spread over 49 places each, met the picture by a broadcast."""
    from swatchwork.plans import catalog

    _no_spread(monkeypatch)
    assert "Broadcast" not in plan(catalog.QUERIES["row_counters"](spark, "/root/testdata/sf0.001"))


def test_pockets_over_bands(spark, px, monkeypatch):
    """three erosions spread every pixel nine times each. What lies on two bands is as what lies on one."""
    from swatchwork.operators.checks import background_pockets

    _no_spread(monkeypatch)
    small = px.filter("y < 100")
    both = [background_pockets(at.filter("r = 255"), at) for at in (small, small.withColumn("y", small.y + 77))]
    one, two = (sorted(map(tuple, df.collect())) for df in both)
    assert one and one == two
    assert "Broadcast" not in plan(both[0])


def _twice(px, make):
    """The same measured on one band, and on two."""
    one, two = px.filter("y < 100"), px.filter("y < 100").withColumn("y", px.y + 77)
    return [make(written(at)) for at in (one, two)]


def test_light_and_medians_over_bands(spark, px, monkeypatch):
    """erosion spread every light pixel nine times; the medians sorted every pixel twice."""
    from swatchwork.operators.audits import light_fidelity

    _no_spread(monkeypatch)
    pale = px.selectExpr("doc_id", "y", "x", "230 + r div 12 AS r", "230 + g div 12 AS g", "230 + b div 12 AS b", "if(a = 0, 130, a) AS a")
    one, two = (sorted(map(tuple, df.collect())) for df in _twice(pale, lambda at: light_fidelity(at, at)))
    assert one == two and one[0][1] == 98 * 10
    smooth = _twice(px, lambda at: R.denoise(at, 60))
    assert "Window" not in plan(smooth[0])
    one, two = ({tuple(r) for r in df.collect()} for df in smooth)
    assert two == {(d, y + 77, *rest) for d, y, *rest in one} and len(one) == 2400


def test_distance_has_no_bound(spark):
    """pixels three and more steps inside were all at distance three."""
    block = {(y, x) for y in range(100, 161) for x in range(120, 161)} - {(130, 125)}
    got = {(r.y, r.x): r.distance for r in R.distance_capped(spark.createDataFrame([(1, *p) for p in block], "doc_id long, y int, x int")).collect()}
    want = {(y, x): min(y - 99, 161 - y, x - 119, 161 - x, abs(y - 130) + abs(x - 125)) for y, x in block}
    assert got == want and max(want.values()) == 21
    capped = R.distance_capped(spark.createDataFrame([(1, *p) for p in block], "doc_id long, y int, x int"), 5).collect()
    assert {(r.y, r.x): r.distance for r in capped} == {p: min(5, d) for p, d in want.items()}


@pytest.mark.parametrize("name", ["ink_mass_match", "render_gate"])
def test_pictures_meet_unspread(spark, monkeypatch, name):
    """F6, F8: ink was spread to all neighbours."""
    from swatchwork.plans import catalog

    _no_spread(monkeypatch)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_palette_image_has_no_broadcast(spark):
    """colours with their labels, which may be as many as the pixels, were broadcast."""
    from swatchwork.plans import catalog

    assert "Broadcast" not in plan(catalog.QUERIES["palette_image"](spark, "/root/testdata/sf0.001"))


def test_repairs_over_bands(spark):
    """every pixel of a missing component was spread over its moat of 49 places."""
    from swatchwork.operators.audits import repair_candidates

    square = lambda y, x: {(y + dy, x + dx) for dy in range(5) for dx in range(5)}
    ink = {1: square(125, 8), 2: square(125, 8) | square(132, 8)}
    src = [(d, y, x, 200, 0, 0 if (y, x) in ink[d] else 255, 255) if (y, x) in ink[d] else (d, y, x, 255, 255, 255, 255) for d in ink for y in range(140) for x in range(30)]
    px = written(spark.createDataFrame(src, PX))
    blank = px.selectExpr("doc_id", "y", "x", "255 AS r", "255 AS g", "255 AS b", "a")
    topology = spark.createDataFrame([(1, 1, 25, 0.0, 0.0, 0), (2, 1, 25, 0.0, 0.0, 0), (2, 2, 25, 0.0, 0.0, 0)], "doc_id long, src_comp int, area long, score double, coverage double, fragments long")
    found = repair_candidates(px, blank, topology, 140, 30)
    assert "Generate" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 25, None, "#c80000"), (2, 1, 25, "source_moat_not_clear", None), (2, 2, 25, "source_moat_not_clear", None)]

"""Colours of one document in roles, and colour conversions both ways."""

from pyspark.sql import functions as F

from swatchwork.functions import svg as V
from swatchwork.operators import paints as T
from swatchwork.sources import files as I


def inventory(spark, *paints):
    return spark.createDataFrame([(1, p, n) for p, n in paints], "doc_id long, paint string, uses long")


def test_roles_of_greens_blue_and_neutrals(spark):
    greens = ("#2e7d32", "#388e3c", "#43a047", "#66bb6a")
    rows = T.paint_roles(inventory(spark, *((g, 2) for g in greens), ("#1e5bd8", 3), ("#181a1e", 1), ("#b8bec4", 1), ("#f7f8fa", 1))).collect()
    role = {r.paint: r.role for r in rows}
    assert {role[g] for g in greens} == {"accent-1"} and role["#1e5bd8"] == "accent-2"
    assert (role["#181a1e"], role["#b8bec4"], role["#f7f8fa"]) == ("neutral-dark", "neutral-mid", "neutral-light")


def test_oklch_both_ways(spark):
    paints = ["#2e7d32", "#1e5bd8", "#ffffff", "#000000", "#ff0000", "#123456"]
    rows = T.with_oklch(inventory(spark, *((p, 1) for p in paints))).select("paint", T.oklch_to_hex(F.col("lightness"), F.col("chroma"), F.col("hue")).alias("back")).collect()
    for r in rows:
        gap = max(abs(int(r.paint[k : k + 2], 16) - int(r.back[k : k + 2], 16)) for k in (1, 3, 5))
        assert gap <= 1, (r.paint, r.back)


def test_out_of_gamut_colour_is_pulled_in(spark):
    got = spark.range(1).select(T.oklch_to_hex(F.lit(0.7), F.lit(0.9), F.lit(140.0)).alias("h")).first().h
    assert len(got) == 7 and got != "#000000"


def test_colour_texts(spark):
    texts = {"#abc": ("#aabbcc", 1.0), "#ABCD": ("#aabbcc", round(221 / 255, 4)), "rgb(10%, 20%, 30%)": ("#1a334c", 1.0), "rgba(1,2,3,.5)": ("#010203", 0.5), "none": None, "url(#g)": None}
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.parse_color(F.col("t")).alias("c")).collect():
        want = texts[r.t]
        assert (r.c is None) if want is None else (r.c.hex, round(r.c.alpha, 4)) == want, r


def test_broken_svg_and_inheritance(spark):
    docs = spark.createDataFrame([(1, '<svg fill="red"><defs><g/></defs><path d="M0 0"/></svg>'), (2, "<svg>"), (3, None)], "doc_id long, svg string")
    rows = {(r.doc_id, r.idx): r for r in I.scan_svg(docs).collect()}
    assert rows[1, 3].attrs["fill"] == "red" and rows[1, 2].in_defs and not rows[1, 3].in_defs and rows[1, 3].parent_idx == 0
    assert not rows[2, 0].is_valid and not rows[3, 0].is_valid


def test_report_files(spark, tmp_path):
    for name, text in (("a", '{"native_circles": 2, "native_lines": 1}'), ("b", '{"native_primitives": 5, "stroke_details": [{"primitive": "rect"}]}'), ("c", '{"native_c')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "report.json").write_text(text)
    got = sorted((r.circles, r.rectangles, r.primitives) for r in I.report_versions(I.scan_reports(spark, str(tmp_path))).collect())
    assert got == [(2, 0, 3), (4, 1, 5)]


def test_image_pixels(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\x00" + b"".join(bytes((x * 10, y * 20, 7, 128)) for x in range(3)) for y in range(2))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "One.PNG").write_bytes(png)
    (tmp_path / "note.txt").write_text("x")
    images = I.scan_images(spark, str(tmp_path))
    assert [(r.name, r.status) for r in images.collect()] == [("One.PNG", "ok")]
    px = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in I.to_pixels(images).collect()}
    assert px == {(y, x): (x * 10, y * 20, 7, 128) for y in range(2) for x in range(3)}


def test_families_are_joined_by_shuffle(spark):
    from swatchwork.operators.paints import paint_roles
    from tests.test_raster import plan

    colours = spark.createDataFrame([(1, "#ff0000", 3), (1, "#ee1010", 2), (1, "#0000ff", 1), (1, "#222222", 4)], "doc_id long, paint string, uses long")
    roles = paint_roles(colours)
    assert "Broadcast" not in plan(roles) and {r.paint: r.role for r in roles.collect()} == {"#ff0000": "accent-1", "#ee1010": "accent-1", "#0000ff": "accent-2", "#222222": "neutral-dark"}


def test_mapping_keeps_chroma_and_hue_spread(spark):
    """one target chroma and hue for all colours of a role lost their own."""
    import math

    def back(members, *target, **kw):
        rows = T.role_mapping(members, *target, **kw).withColumnRenamed("to_paint", "paint2").select("doc_id", F.col("paint").alias("old"), F.col("paint2").alias("paint"), F.lit(1).alias("uses"))
        return {r.old: r for r in T.with_oklch(rows.drop("old")).join(rows, ["doc_id", "paint"]).collect()}

    colours = [("#2e7d32", 3), ("#66bb6a", 1), ("#8a9a20", 2), ("#808080", 1), ("#b8bec4", 2)]
    members = T.role_members(inventory(spark, *colours)).cache()
    own = {r.paint: r for r in T.with_oklch(inventory(spark, *colours)).collect()}
    role = {r.paint: r.role for r in members.collect()}
    greens = [p for p, _ in colours[:3]]
    assert {role[p] for p in greens} == {"accent-1"} and role["#808080"] == role["#b8bec4"] == "neutral-mid"
    uses = dict(colours)
    mean = lambda f, ps: sum(f(p) * uses[p] for p in ps) / sum(uses[p] for p in ps)
    anchor_c = mean(lambda p: own[p].chroma, greens)
    anchor_h = math.degrees(math.atan2(*(mean(lambda p, f=f: f(math.radians(own[p].hue)), greens) for f in (math.sin, math.cos))))
    got = back(members, 0.6, 0.05, 150.0)
    for p in greens:
        delta = (own[p].hue - anchor_h + 180) % 360 - 180
        assert abs(got[p].chroma - 0.05 * own[p].chroma / anchor_c) < 0.004
        assert abs((got[p].hue - (150 + delta / 2) + 180) % 360 - 180) < 4
    grey_c = mean(lambda p: own[p].chroma, ("#808080", "#b8bec4"))
    assert abs(got["#b8bec4"].chroma - 0.05 * own["#b8bec4"].chroma / grey_c) < 0.004 and got["#808080"].chroma < 0.004
    assert all(r.chroma < 0.004 for r in back(members, 0.6, 0.0, 150.0).values())
    lightest = spark.createDataFrame([(1, "#f7f8fa", "neutral", 0.0, 0.2, 0.0, 0.0)], "doc_id long, paint string, kind string, anchor_chroma double, lightness_delta double, chroma_ratio double, hue_delta double")
    assert 0.98 < back(lightest, 1.0, 0.0, 150.0)["#f7f8fa"].lightness < 0.995
    assert back(lightest, 0.5, 0.1, 150.0)["#f7f8fa"].chroma > 0.001

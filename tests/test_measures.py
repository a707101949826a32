"""Unions of partitioned frames, lost colours, render pairs, axis stops, runs and audits on hand-made cases."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def test_a_union_of_partitioned_frames_groups_rightly(spark):
    from swatchwork.runtime import united, written

    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    rows = written(spark.range(2000).selectExpr("id % 40 AS doc_id", "id AS w"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("w"))).filter("n < 3").select("doc_id", "w")
    every = rows.select("doc_id").distinct()
    whole = united(first, every.selectExpr("doc_id", "-1L AS w")).groupBy("doc_id").agg(F.collect_list("w").alias("all"))
    # With a plain union this join has 160 rows: the grouping gives two rows a key.
    got = first.join(every, "doc_id").join(whole, "doc_id", "left").collect()
    assert len(got) == 80 and all(sorted(r["all"]) == [-1, r.doc_id, r.doc_id + 40] for r in got)
    half = united(first.withColumn("a", F.lit(1)), first, allowMissingColumns=True)
    assert half.filter("a IS NULL").count() == 80


def test_blends_and_covered_colours_are_not_lost(spark):
    from swatchwork.operators.palette import lost_colors

    tones = [(0, 0, 0), (255, 0, 0), (128, 0, 0), (40, 60, 70), (0, 255, 0), (230, 140, 140)]
    pal = spark.createDataFrame([(1, k, *map(float, c)) for k, c in enumerate(tones)], "doc_id long, k int, r double, g double, b double")
    hist = spark.createDataFrame([(1, *c, 100) for c in tones], "doc_id long, r int, g int, b int, w long")
    lost = lambda **kw: {r.k for r in lost_colors(hist, pal, pal.filter("k < 2"), **kw).collect()}
    paper = spark.createDataFrame([(1, 255, 255, 255)], "doc_id long, r int, g int, b int")
    # Without the paper pink lies on no line; a dark grey is near black, and on the line from black to white.
    assert lost() == {4, 5} and lost(paper=paper) == {4} and lost(radius=30.0) == {3, 4, 5}
    assert {r.k for r in lost_colors(hist, pal, pal.limit(0)).collect()} == set(range(6))


def picture(spark, doc, ink):
    px = [(doc, y, x, *((0, 0, 0) if (y, x) in ink else (255, 255, 255)), 255) for y in range(12) for x in range(12)]
    return spark.createDataFrame(px, "doc_id long, y int, x int, r int, g int, b int, a int")


def test_renders_within_a_pixel(spark):
    from swatchwork.operators.compare import render_gate

    line = {(5, x) for x in range(2, 10)}
    gate = lambda a, b, **kw: render_gate(picture(spark, 1, a), picture(spark, 1, b), 12, 12, **kw).first()
    same, empty = gate(line, line), gate(set(), set())
    assert same.accepted and same.score == 100 and empty.accepted and (empty.ink_recall, empty.changed) == (100, 0)
    moved = gate(line, {(6, x) for _, x in line})
    assert (moved.ink_recall, moved.ink_precision, moved.color_similarity, moved.accepted) == (100, 100, 0, False) and moved.changed == round(16 / 144, 6)
    assert gate(line, {(6, x) for _, x in line}, reach=0).ink_recall == 0
    gone = gate(line, set())
    assert (gone.ink_recall, gone.ink_precision, gone.ink_f1) == (0, 100, 0) and not gone.accepted


def test_stops_along_a_slanted_axis(spark):
    from swatchwork.operators.shapes import axis_stops

    ramp = lambda doc, f: [(doc, y, x, *f(y, x)) for y in range(40) for x in range(40)]
    rows = ramp(1, lambda y, x: (100 + (x + y), 100 + (x + y), 0)) + ramp(2, lambda y, x: (100, 100, 100)) + ramp(3, lambda y, x: (100 + x // 4, 90, 90)) + ramp(4, lambda y, x: (3 * y, 10, 10))
    px = spark.createDataFrame(rows, "doc_id long, y int, x int, r int, g int, b int").filter("doc_id < 4 OR y < 40")
    got = {}
    for r in axis_stops(px).orderBy("doc_id", "stop").collect():
        got.setdefault(r.doc_id, []).append((r.stop, r.r))
    # The slanted ramp's colour follows x + y, so its middle stop has x + y = 39.
    assert set(got) == {1, 4} and dict(got[1])[2] == 139 and [v for _, v in got[1]] == sorted(v for _, v in got[1])
    assert [s for s, _ in got[4]] == [0, 1, 2, 3, 4] and got[4][-1][1] - got[4][0][1] >= 100


def test_runs_of_colour(spark):
    from swatchwork.operators.curves import color_runs

    curve = lambda k, text: [(k, i, ord(c), 200 if c == "b" else 0, 0, 0) for i, c in enumerate(text)]
    rows = curve(1, "a" * 8 + "b" * 8) + curve(2, "a" * 8 + "c" * 8) + curve(3, "a" * 8 + "bbb" + "a" * 8) + curve(4, "ab" * 10 + "a" * 6 + "b" * 6)
    got = {r.curve_id: (r.runs, r.long_runs, r.labels, r.is_far, r.is_cut) for r in color_runs(spark.createDataFrame(rows, "curve_id int, seq int, label int, r int, g int, b int")).collect()}
    assert got == {1: (2, 2, 2, True, True), 2: (2, 2, 2, False, False), 3: (3, 2, 1, False, False), 4: (22, 2, 2, True, False)}


def test_ribbons_and_opacity(spark):
    from swatchwork.operators.audits import core_opacity, even_ribbons

    comps = spark.createDataFrame([(1, k, a) for k, a in enumerate((100, 100, 8, 900, 100))], "doc_id int, comp_id int, area long")
    lengths = spark.createDataFrame([(1, 0, 50.0), (1, 1, 50.0), (1, 2, 4.0), (1, 3, 40.0)], "doc_id int, comp_id int, length double")
    widths = spark.createDataFrame([(1, k, h) for k, hs in enumerate(((1, 1, 1), (1, 5, 9), (1,), (11, 11), (1,))) for h in hs], "doc_id int, comp_id int, half int")
    assert {r.comp_id: r.reason for r in even_ribbons(comps, lengths, widths).collect()} == {0: None, 1: "uneven", 2: "too_short", 3: "stubby", 4: "too_short"}
    alphas = spark.createDataFrame([(1, a) for a in (0, 0, 100, 100)] + [(2, 252)] + [(3, None), (3, 0)], "curve_id int, a int")
    assert {r.curve_id: r.opacity for r in core_opacity(alphas).collect()} == {1: 0.392, 2: 1.0, 3: 0.02}


def test_editability_of_plain_and_heavy_documents(spark):
    from swatchwork.operators.paints import editability_audit

    easy = {"doc_id": 1, "drawables": 10, "with_id": 10, "grouped": 5, "with_role": 10, "roles": 2, "native": 3, "strokes": 1, "gradients": 1, "groups": 2, "paths": 5, "nodes": 60, "largest": 20, "largest_share": 0.4}
    heavy = {"doc_id": 2, "drawables": 300, "paths": 300, "nodes": 5000, "largest": 800, "largest_share": 0.9, "most_subpaths": 60, "groups": 20, "color_layers": 20, "solid_paints": 4}
    names = ["doc_id", *"drawables with_id grouped with_role roles solid_paints gradients native strokes groups color_layers paths nodes controls most_controls median p95 largest largest_share most_subpaths".split()]
    kind = lambda n: "double" if n in ("median", "largest_share") else "long"
    df = spark.createDataFrame([tuple(d.get(n) for n in names) for d in (easy, heavy)], ", ".join(f"{n} {kind(n)}" for n in names))
    one, two = editability_audit(df).orderBy("doc_id").collect()
    assert (one.readiness, one.redraw_burden, one.workflow_burden, one.status, one.redraw_level, one.triggers) == (100.0, 0.0, 0.0, "accepted", "low", "")
    assert (two.redraw_burden, two.workflow_burden, two.redraw_level, two.workflow_level, two.status, two.readiness) == (36.0, 18.0, "high", "very_high", "manual_review", 8.0)
    assert two.triggers.count(",") == 5


def test_suffixes_and_visible_strokes(spark):
    from swatchwork.functions.svg import visible_stroke
    from swatchwork.operators.documents import blocked_suffixes

    files = spark.createDataFrame([(1, "a/b.PNG"), (2, "a/.gitkeep"), (3, "ok/x.png"), (4, None), (5, "x.tar.zip"), (6, "png")], "file_id int, path string")
    got = {r.file_id: (r.suffix, r.blocked) for r in blocked_suffixes(files, (".png", ".zip"), ("ok/x.png",)).collect()}
    assert got == {1: (".png", True), 2: ("", False), 3: (".png", False), 4: ("", False), 5: (".zip", True), 6: ("", False)}
    strokes = spark.createDataFrame([(" #F00 ", None), ("red", "0px"), ("none", "2"), ("url(#g)", "2"), ("red", "auto"), ("currentColor", "1"), ("red", ".5em")], "stroke string, width string")
    assert [r[0] for r in strokes.select(visible_stroke(F.col("stroke"), F.col("width"))).collect()] == [True, False, False, False, True, False, True]


def test_topology_like_flood_fill(spark):
    """Components of random pictures, their coverage, largest fragment and fragments, against plain Python."""
    import random

    from swatchwork.operators.compare import component_topology, topology_summary

    rng = random.Random(11)
    side = 32
    src = {(y, x) for y in range(2, 30) for x in range(2, 30) if (y // 4 + x // 5) % 3 == 0}
    ren = {p for p in src if rng.random() < 0.6}

    def parts(cells):
        left, out = set(cells), []
        while left:
            todo, own = [min(left)], set()
            left.discard(todo[0])
            while todo:
                y, x = todo.pop()
                own.add((y, x))
                near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
                left -= near
                todo += near
            out.append(own)
        return out

    grown = {(y + dy, x + dx) for y, x in ren for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 <= y + dy < side and 0 <= x + dx < side}
    pieces, want = parts(grown), []
    for own in parts(src):
        if len(own) >= 16:
            hits = [len(own & p) for p in pieces]
            covered = sum(hits)
            coverage, whole = 100 * covered / len(own), 100 * max(hits) / covered if covered else 0.0
            want.append((len(own), round(coverage, 3), round(whole, 3), sum(h >= 3 and h >= 0.05 * len(own) for h in hits), round(coverage * whole / 100, 3)))

    def px(ink):
        rows = [(1, y, x, *((0, 0, 0) if (y, x) in ink else (255, 255, 255)), 255) for y in range(side) for x in range(side)]
        return spark.createDataFrame(rows, "doc_id long, y int, x int, r int, g int, b int, a int")

    found = component_topology(px(src), px(ren), side, side)
    assert want and sorted((r.area, r.coverage, r.connectivity, r.fragments, r.score) for r in found.collect()) == sorted(want)
    summary = topology_summary(found).first()
    assert summary.components == len(want) and summary.worst == min(w[4] for w in want)

"""Boxes of elements, refusals, nodes, edges and object candidates on hand-made documents."""

import pytest

from swatchwork.operators import scene as C
from swatchwork.runtime import written
from swatchwork.sources.files import scan_svg

PATHS = {
    "M1 2L5 9": (1, 2, 5, 9), "m1 2 3 4 l-5 1 z": (-1, 2, 4, 7), "M0 0H5V-3h-9v1": (-4, -3, 5, 0),
    "M0 0C1 9 2 -9 3 0": (0, -9, 3, 9), "M0 0c1 1 2 2 3 0s4 5 6 0": (0, -2, 9, 5), "M0 0S4 5 6 0": (0, 0, 6, 5),
    "M0 0Q5 10 10 0T20 0": (0, -10, 20, 10), "M0 0T20 0": (0, 0, 20, 0), "M0 0Q5 10 10 0L20 0T30 0": (0, 0, 30, 10),
    "M0 0Q5 10 10 0T20 0t10 0": (0, -10, 35, 10), "M0 0A5 5 0 0 1 10 0": (-10, -10, 20, 10), "M0 0a2 1 0 0 1 10 0": (-10, -10, 20, 10), "M0 0a0 1 0 0 1 10 0": (-2, -2, 12, 2),
    "M0 0a2 1 90 0 1 0 10": (-10, -10, 10, 20), "5 5": None, "": None, "M1 1 L2": None, "M1 1 X": None,
}


def test_path_boxes(spark):
    texts = spark.createDataFrame([(1, i, d) for i, d in enumerate(PATHS)], "doc_id long, idx int, d string")
    got = {r.idx: tuple(r)[2:] for r in C.path_boxes(texts).collect()}
    for i, want in enumerate(PATHS.values()):
        assert (got.get(i) is None) if want is None else got[i] == pytest.approx(want), list(PATHS)[i]


def _boxes(spark, *elements, head='viewBox="0 0 100 100"', doc_id=1):
    el = written(scan_svg(spark.createDataFrame([(doc_id, f"<svg {head}>{''.join(elements)}</svg>")], "doc_id long, svg string")))
    return el, written(C.element_boxes(el))


def test_element_boxes(spark):
    _, boxes = _boxes(
        spark, '<circle cx="5" cy="6" r="-2"/>', '<ellipse cx="5" cy="6" rx="2" ry="3" stroke="red" stroke-width="2"/>', '<rect x="1" y="2" width="3" height="4" stroke="none" stroke-width="9"/>',
        '<g stroke="#000" stroke-width="1px" stroke-linejoin="round"><line x1="9" y1="1" x2="2" y2="5"/></g>', '<polygon points="1,2 3,9 -4,5"/>', '<polyline points="7"/>', '<rect x="1px" width="3" height="4"/>',
        '<line x1="1" y1="q" x2="2" y2="3"/>', '<rect width="2" height="2" stroke="red" stroke-width="2em"/>', '<rect width="2" height="2" stroke="red" stroke-miterlimit="0.1"/>', '<defs><rect width="1" height="1"/></defs>', "<text>x</text>",
    )
    assert [tuple(r)[4:] for r in boxes.orderBy("idx").collect()] == [
        (3, 4, 7, 8), (-1, -1, 11, 13), (1, 2, 4, 6), (1.5, 0.5, 9.5, 5.5), (-4, 2, 3, 9), (None,) * 4, (None,) * 4, (None,) * 4, (None,) * 4, (-0.5, -0.5, 2.5, 2.5),
    ]


#: Head, elements and the reasons against the document.
CASES = [
    ('viewBox="0 0 9 9"', '<circle cx="0" cy="0" r="1" transform="rotate(5 0 0)"/>', None), ('width="9px" height="9"', '<rect width="1" height="1"/>', None), ("", '<rect width="1" height="1"/>', "no canvas"),
    ('viewBox="0 0 9 9"', '<circle cx="0" cy="0" r="1" transform="rotate(5 1 0)"/>', "unsafe element"), ('viewBox="0 0 9 9"', '<circle cx="0" cy="0" r="1" style="" transform="rotate(5 0 0)"/>', "unsafe element"),
    ('viewBox="0 0 9 9"', '<g opacity=".5"><rect width="0" height="1"/></g>', "unsafe group,unusable box"), ('viewBox="0 0 9 9"', "<broken", "no canvas"),
]


def test_refusals(spark):
    el = written(scan_svg(spark.createDataFrame([(i, f"<svg {head}>{body}</svg>") for i, (head, body, _) in enumerate(CASES)], "doc_id long, svg string")))
    boxes = written(C.element_boxes(el))
    assert {r.doc_id: r.reasons for r in C.scene_refusals(el, boxes).collect()} == {i: why for i, (_, _, why) in enumerate(CASES) if why}
    assert {r.doc_id for r in C.scene_nodes(el, boxes).collect()} == {i for i, (_, _, why) in enumerate(CASES) if why is None}


def test_nodes(spark):
    el, boxes = _boxes(
        spark, '<circle cx="5" cy="5" r="2" fill="#f00"/>', '<rect width="10" height="40" fill="none" stroke="#123"/>', '<rect width="10" height="10"/>', '<rect width="30" height="30" fill="#00ff80"/>',
        '<path d="M0 0h1v1h1v1h1v1h1v1h1v1h1v1h1" fill="#ffffff"/>', '<rect x="9" y="9" width="1" height="1" fill="url(#a)"/>',
    )
    got = [(r.paint, r.family, r.hue and round(r.hue), r.role, r.primitive, r.scaffold) for r in C.scene_nodes(el, boxes).orderBy("idx").collect()]
    assert got == [
        ("fill:#f00", "chromatic", 0, "dot", True, False), ("stroke:#123", "chromatic", 210, "stroke", True, False), ("fill:black", "other", None, "fragment", True, False), ("fill:#00ff80", "chromatic", 150, "fragment", True, True),
        ("fill:#ffffff", "neutral", None, "fragment", False, False), ("fill:url(#a)", "unknown", None, "dot", True, False),
    ]


def _groups(spark, *elements, **limits):
    el, boxes = _boxes(spark, *elements)
    nodes = written(C.scene_nodes(el, boxes))
    edges = written(C.scene_edges(nodes))
    return edges.orderBy("a", "b").collect(), C.object_candidates(edges, nodes, **limits).orderBy("group_id").collect()


def test_candidates(spark):
    dot = lambda x, fill="red": f'<circle cx="{x}" cy="50" r="2" fill="{fill}"/>'
    edges, groups = _groups(spark, *(dot(x) for x in (10, 15, 20, 25)), dot(60), dot(65), dot(90, "red"), dot(94, "blue"))
    assert {e.rule for e in edges} == {"repeated-dot-proximity"} and [(e.a, e.b) for e in edges] == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (5, 6), (7, 8)]
    near, far = 0.74 + 0.1 * (1 - 1 / 8), 0.74 + 0.1 * (1 - 6 / 8)
    assert [g.members for g in groups] == [[1, 2, 3, 4], [7, 8]] and groups[0].reasons == ["repeated-dot-proximity"]
    assert groups[0].confidence == pytest.approx(0.65 * near + 0.35 * far) and tuple(groups[0])[5:] == (8, 48, 27, 52)
    assert [g.members for g in _groups(spark, *(dot(x) for x in (10, 15, 20, 25)), members=3)[1]] == []
    assert [g.members for g in _groups(spark, dot(10), dot(15, "blue"), dot(20), dot(25), members=2)[1]] == [[1, 2]]
    assert _groups(spark, *(dot(x) for x in (10, 15, 20, 25)), most=0.0075)[1] == []
    assert _groups(spark, dot(10, "red"), dot(15, "blue"), least_score=0.9)[1] == []


def test_six_rules(spark):
    rect = lambda x, y, w, h, paint: f'<rect x="{x}" y="{y}" width="{w}" height="{h}" {paint}/>'
    red, pink, wire = 'fill="#c01010"', 'fill="#d02040"', 'fill="none" stroke="#c01010" stroke-width="1" stroke-miterlimit="1"'
    one = lambda *e: [(x.rule, round(x.score, 6)) for x in _groups(spark, *e)[0]]
    assert one(rect(0, 0, 10, 10, red), rect(1, 0, 10, 10, red)) == [("matching-bounds", 0.97)]
    assert one(rect(0, 0, 10, 10, red), rect(1, 1, 5, 5, pink)) == [("cross-paint-overlay", 0.96)]
    assert one(rect(0, 0, 10, 10, red), rect(5, 0, 10, 10, pink)) == [("cross-paint-overlap", 0.84)]
    assert one(rect(0, 0, 1, 20, wire), rect(4, 0, 1, 20, wire)) == [("parallel-stroke-proximity", round(0.74 + 0.08 * (1 - 2 / 8), 6))]
    assert one(rect(0, 0, 10, 10, red), rect(12, 0, 10, 10, pink)) == [("fragment-proximity", round(0.76 + 0.1 * (1 - 2 / 8), 6))]
    assert one(rect(0, 0, 10, 10, red), rect(12, 0, 10, 10, 'fill="#10c010"')) == [] and one(rect(0, 0, 10, 10, red), rect(19, 0, 10, 10, pink)) == []
    assert one(rect(0, 0, 30, 30, red), rect(0, 0, 30, 30, red)) == []


def test_pairs_and_folds_meet_by_shuffle(spark):
    """Written nodes look small to Spark; they are neither broadcast to pairs nor to the edges of a fold."""
    from tests.test_raster import plan

    el, boxes = _boxes(spark, '<rect width="9" height="9" fill="#f00"/>', '<rect width="9" height="9" fill="#e00000"/>', '<rect x="50" y="50" width="2" height="2" fill="#00f"/>')
    nodes = written(C.scene_nodes(el, boxes))
    edges = C.scene_edges(nodes)
    found = C.object_candidates(edges, nodes)
    assert "Broadcast" not in plan(edges) and "Broadcast" not in plan(found)
    assert [(r.a, r.b, r.rule) for r in edges.collect()] == [(1, 2, "matching-bounds")] and [r.members for r in found.collect()] == [[1, 2]]


def test_scan_takes_documents_in_small_batches(spark):
    """Python holds the elements of one batch of documents, not of a whole partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        docs = spark.range(0, 1200, 1, 1).selectExpr("id AS doc_id", "'<svg><rect/></svg>' AS svg")
        assert scan_svg(docs).count() == 2400 and int(spark.conf.get(key)) <= 500
    finally:
        spark.conf.set(key, old)

"""Hand-made score rows and their verdicts."""

import pytest

from swatchwork.operators import rules as U

COLUMNS = "item_id long, cand_no int, foreground double, color_fidelity double, detail_p10 double, detail_mean double, topology_p10 double, light_coverage double, eligible_cells int, eligible_components int, light_pixels int, nodes int, strokes string, gradients string, geometry string"


def rows(spark, *scores):
    data = [(k, 1, *map(float, s[:5]), None, s[5], s[6], 0, 100, "auto", "auto", "auto") for k, s in enumerate(scores)]
    return spark.createDataFrame(data, COLUMNS)


@pytest.mark.parametrize(
    "scores,status",
    [
        ((96.9, 91.03, 93.387, 97.012, 99.9, 50, 20), "accepted"),
        ((91.777, 84.906, 74.001, 87.094, 99.977, 304, 53), "rejected"),
        ((90, 88, 78, 91, 99, 50, 20), "manual_review"),
        ((92, 87, 76, 87, 99, 50, 20), "rejected"),
        ((91, 65, 90, 94, 99, 50, 20), "rejected"),
    ],
)
def test_visual_gate(spark, scores, status):
    assert U.visual_gate(rows(spark, scores)).first().status == status


def test_gate_ignores_what_does_not_apply(spark):
    few = U.visual_gate(rows(spark, (96, 91, 10, 10, 10, 3, 3))).first()
    assert (few.status, few.missed) == ("accepted", "")


def test_selection_keeps_features_on_a_tie(spark):
    data = [
        (1, 1, 96.889, 90.0, 90.0, 90.0, None, None, 20, 0, 0, 300, "auto", "auto", "auto"),
        (1, 2, 97.047, 90.0, 90.0, 90.0, None, None, 20, 0, 0, 300, "off", "auto", "auto"),
        (2, 1, 88.0, 90.0, 90.0, 90.0, None, None, 20, 0, 0, 300, "auto", "auto", "auto"),
        (2, 2, 90.2, 90.0, 90.0, 90.0, None, None, 20, 0, 0, 300, "off", "auto", "auto"),
    ]
    got = {r.item_id: (r.cand_no, r.kept) for r in U.select_candidate(spark.createDataFrame(data, COLUMNS)).collect()}
    assert got == {1: (1, 3), 2: (2, 2)}

"""Staged searches, repair verdicts, stage chains and relabelled lines against plain Python and by case."""

import itertools
import random

from pyspark.sql import functions as F

from swatchwork.operators import search as S

OPTS = "strokes string, gradients string, geometry string, background string"
SCORES = "quality double, structure double, nodes int, elements int, free_closed boolean, foreground double, color_fidelity double, detail_p10 double, detail_mean double, topology_p10 double, light_coverage double, eligible_cells int, eligible_components int, light_pixels int"
FEATURES = ("strokes", "gradients", "geometry")
ACCEPT, GAIN, BUDGET = (88.0, 85.0, 80.0, 88.0), (1.0, 1.0, 1.0, 1.0), (0.5, 3.0, 3.0, 1.0)


def search(item, asked, score):
    """Rounds of one item, in order: option tuple -> round."""
    tried = {}

    def attempt(o, name):
        tried.setdefault(o, name)

    def off(o, which):
        return tuple("off" if f in which else v for f, v in zip((*FEATURES, "background"), o))

    def accepted(s):
        m = s[5:9]
        hard = any(v < t for v, t in zip(m, (60, 70, 55, 75)))
        soft = sum(v < t for v, t in zip(m, (85, 85, 75, 88)))
        return not hard and soft < 2 and not (m[2] < 80 and m[3] < 88) and all(v >= t for v, t in zip(m, ACCEPT))

    def beats(a, b):
        d = [x - y for x, y in zip(a[5:9], b[5:9])]
        return any(x >= g for x, g in zip(d, GAIN)) and not any(x < -g for x, g in zip(d, BUDGET))

    free = [f for f, v in zip(FEATURES, asked) if v != "off"]
    subsets = lambda fs, sizes: [c for n in sizes for c in itertools.combinations(fs, n)]
    attempt(asked, "requested")
    b = score(item, asked)
    q = b and b[0]
    if q is None or q < 88 or not accepted(b) or b[2] > 24 * max(1, b[3]) or b[4]:
        for c in subsets(free, [1]):
            attempt(off(asked, c), "single")
        if q is None or q < 80:
            for c in subsets(free, [2, 3]):
                attempt(off(asked, c), "full")
        else:
            useful = []
            for f in free:
                s = score(item, off(asked, [f]))
                if s and s[0] is not None and (beats(s, b) or s[0] >= q + 0.5 or s[1] - b[1] >= 3):
                    useful.append(f)
            if len(useful) >= 2:
                for c in subsets(useful, [2, 3]):
                    attempt(off(asked, c), "combined")
    best = max((s[0] for s in (score(item, o) for o in tried) if s and s[0] is not None), default=-1)
    if asked[3] != "keep" and best < 80:
        for c in subsets(free, [0, 1, 2, 3]):
            attempt((*off(asked, c)[:3], "keep"), "background")
    return {(item, *o): (name, "ok" if score(item, o) else "failed") for o, name in tried.items()}


def test_staged_search_like_a_loop(spark):
    rng = random.Random(11)
    asked = {i: tuple(rng.choice(["on", "on", "off"]) for _ in FEATURES) + (rng.choice(["auto", "auto", "keep"]),) for i in range(120)}
    table = {}
    for i in asked:
        level = rng.choice([60, 78, 84, 90])
        for o in itertools.product(("on", "off"), ("on", "off"), ("on", "off"), ("auto", "keep")):
            if rng.random() < 0.9:
                m = [min(100.0, level + rng.uniform(-2, 8)) for _ in range(4)]
                table[i, *o] = (None if rng.random() < 0.05 else round(level + rng.uniform(-1, 2), 2), round(rng.uniform(40, 46), 1), rng.choice([10, 400]), rng.choice([0, 20]), rng.random() < 0.1, *m, None, None, 20, 3, 0)
    scores = spark.createDataFrame([(*k, *v) for k, v in table.items()], f"item_id long, {OPTS}, {SCORES}")
    requests = spark.createDataFrame([(i, *o) for i, o in asked.items()] + [(0, *asked[0])], f"item_id long, {OPTS}")
    calls = []

    def evaluate(todo):
        calls.append(todo.count())
        return todo.join(scores, ["item_id", *S.OPTIONS])

    got = {(r.item_id, r.strokes, r.gradients, r.geometry, r.background): (r.round, r.status) for r in S.staged_search(requests, evaluate).collect()}
    want = {}
    for i, o in asked.items():
        want |= search(i, o, lambda item, opts: table.get((item, *opts)))
    assert got == want and sum(calls) == len(want), "each combination is built once"
    assert {"requested", "single", "full", "combined", "background"} == {name for name, _ in want.values()}


def test_repair_verdicts_by_reason(spark):
    names = ["ok", "not_ready", "no_repairs", "size", "locator", "bbox", "unchanged", "outside", "no_evidence", "not_failing", "unresolved", "new", "gate_gone", "gate_down", "metric_gone", "metric_down", "light_down", "light_unused"]
    ids = {n: k for k, n in enumerate(names)}
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    proposals = make([(k, "skipped" if n == "not_ready" else "proposed") for n, k in ids.items()], "doc_id int, status string")
    box = {"locator": (None, 1.0, 1.0, 2.0, 2.0), "bbox": (3, 1.0, 1.0, 0.0, 2.0)}
    repairs = make([(k, *box.get(n, (3, 1.0, 1.0, 2.0, 2.0))) for n, k in ids.items() if n != "no_repairs"], "doc_id int, component int, x double, y double, w double, h double")
    lists = {"no_evidence": (None, [1]), "not_failing": ([1], [1]), "unresolved": ([1, 3], [1, 3]), "new": ([1, 3], [1, 7])}
    failures = make([(k, *lists.get(n, ([1, 3], [1]))) for n, k in ids.items()], "doc_id int, before array<int>, after array<int>")
    gate = {"gate_gone": ("accepted", None), "gate_down": ("accepted", "manual_review")}
    gates = make([(k, *gate.get(n, ("rejected", "accepted"))) for n, k in ids.items()], "doc_id int, before string, after string")
    rows = []
    for n, k in ids.items():
        for m, drop in S.REPAIR_DROPS.items():
            if m == "light_object_coverage":
                rows.append((k, m, 90.0, 80.0, n == "light_down"))
            elif (n, m) != ("metric_gone", "topology_worst"):
                rows.append((k, m, 90.0, 90.0 - drop * (1.5 if (n, m) == ("metric_down", "detail_p10") else 0.5), None))
    metrics = make(rows, "doc_id int, metric string, before double, after double, applies boolean")
    before = [(k, y, x, 255, 255, 255, 255) for k in ids.values() for y in range(12) for x in range(12)]
    hit = lambda n, y, x: n != "unchanged" and ((y, x) == (2, 2) or (n == "outside" and (y, x) == (9, 9)))
    after = [(k, y, x, 0 if hit(names[k], y, x) else 255, 255, 255, 255) for k, y, x, *_ in before if not (names[k] == "size" and y == 11)]
    px = "doc_id int, y int, x int, r int, g int, b int, a int"
    changes = S.repair_changes(make(before, px), make(after, px), repairs.dropna())
    got = {names[r.doc_id]: r for r in S.repair_audit(proposals, repairs, failures, gates, metrics, changes).collect()}
    want = {
        "ok": [], "not_ready": ["proposal_not_ready"], "no_repairs": ["proposal_has_no_repairs"], "size": ["render_size_mismatch"], "locator": ["invalid_repair_locator"], "bbox": ["invalid_repair_bbox"],
        "unchanged": ["proposal_render_unchanged"], "outside": ["render_changed_outside_repair_bbox"], "no_evidence": ["topology_failure_evidence_missing"],
        "not_failing": ["target_not_in_before_failures"], "unresolved": ["target_component_not_repaired"], "new": ["repair_created_new_topology_failure"], "gate_gone": ["visual_gate_evidence_missing"],
        "gate_down": ["visual_gate_regressed"], "metric_gone": ["topology_worst_evidence_missing"], "metric_down": ["detail_p10_regressed"], "light_down": ["light_object_coverage_regressed"], "light_unused": [],
    }
    assert {n: got[n].reasons for n in names} == want
    assert {n for n in names if got[n].status == "accepted"} == {"ok", "light_unused"}
    assert (got["ok"].targets, got["ok"].changed, got["outside"].outside, got["new"].new_failed, got["unresolved"].unresolved) == ([3], 1, 1, [7], [3])


def test_stage_chain(spark):
    rows = spark.createDataFrame([(d, k, 0) for d in range(4) for k in range(3)], "doc_id int, k int, v int")
    even = lambda before, after: before.select("doc_id").distinct().withColumn("accepted", F.col("doc_id") % 2 == 0).withColumn("reason", F.lit("odd"))
    fine = lambda before, after: after.select("doc_id").distinct().withColumn("accepted", F.lit(True)).withColumn("reason", F.lit(""))
    seen = []

    def last(df):
        seen.append(sorted(map(tuple, df.collect())))
        return df.withColumn("v", F.col("v") * 10)

    stages = [
        S.Stage("add", lambda df: df.withColumn("v", F.col("v") + 1), fine),
        S.Stage("drop", lambda df: df.filter("k > 0").withColumn("v", F.col("v") + 100), even),
        S.Stage("broken", lambda df: df.withColumn("v", F.raise_error(F.lit("no"))), fine),
        S.Stage("off", lambda df: df.limit(0), fine, enabled=False),
        S.Stage("same", lambda df: df, fine),
        S.Stage("tenfold", last, fine),
    ]
    now, report = S.stage_chain(rows, stages)
    mid = sorted([(d, k, 101) for d in (0, 2) for k in (1, 2)] + [(d, k, 1) for d in (1, 3) for k in range(3)])
    assert seen == [mid], "the stage after a rollback starts from what was committed"
    assert sorted(map(tuple, now.collect())) == sorted((d, k, v * 10) for d, k, v in mid)
    told = {(r.doc_id, r.stage): (r.status, r.attempted, r.committed, r.reason) for r in report.collect()}
    assert told[0, "add"] == ("applied", 6, 6, None) and told[0, "drop"] == ("applied", 5, 5, None) and told[1, "drop"] == ("rolled_back_render_guard", 5, 0, "odd")
    assert {told[d, "broken"][0] for d in range(4)} == {"rolled_back_error"} and told[2, "off"][0] == "disabled" and told[3, "same"] == ("no_change", 0, 0, None)
    assert told[1, "tenfold"] == ("applied", 6, 6, None)


def test_lines_of_several_labels_get_one(spark):
    from swatchwork.operators.audits import relabelled_lines

    rows = []
    for y in range(60):
        for x in range(60):
            c, label = (255, 255, 255), 0
            if y == x and x < 50:  # a thin ray over two bands, its strong pixels gold
                c, label = ((200, 160, 0), 1) if x % 3 else ((240, 230, 180), 2)
            elif y == 55 and 3 <= x < 40:  # one label already
                c, label = (10, 10, 10), 3
            elif 5 <= y < 25 and 35 <= x < 55:  # a block
                c, label = (0, 0, 200), 1 + x % 2
            rows.append((1, y, x, *c, 255, label))
    all_ = spark.createDataFrame(rows, "doc_id int, y int, x int, r int, g int, b int, a int, label int")
    stats = spark.createDataFrame([(1, 255.0, 255.0, 255.0, 6.0)], "doc_id int, bg_r double, bg_g double, bg_b double, threshold double")
    pal = spark.createDataFrame([(1, 0, 255.0, 255.0, 255.0), (1, 1, 0.0, 0.0, 200.0), (1, 2, 240.0, 230.0, 180.0), (1, 3, 10.0, 10.0, 10.0), (1, 4, 205.0, 165.0, 5.0)], "doc_id int, k int, r double, g double, b double")
    labels = all_.select("doc_id", "y", "x", "label")
    after, records = relabelled_lines(all_.drop("label"), stats, labels, pal)
    (one,) = records.collect()
    assert (one.area, one.paint, one.relabelled) == (50, 4, 50) and 0.6 < one.old_share < 0.7
    was, now = ({(r.y, r.x): r.label for r in df.collect()} for df in (labels, after))
    assert len(now) == 3600 and all(now[p] == (4 if p[0] == p[1] and p[0] < 50 else was[p]) for p in was)
    same, none = relabelled_lines(all_.drop("label"), stats, labels, pal, owned=all_.filter("y = x").select("doc_id", "y", "x"))
    assert none.count() == 0 and same.exceptAll(labels).count() == 0


def test_rounds_are_written_once(spark, monkeypatch):
    """No written table holds results of more than one round."""
    from swatchwork.operators import search as U
    from swatchwork.plans.search_queries import staged_search

    tables, real = [], U.written
    monkeypatch.setattr(U, "written", lambda df: tables.append(real(df)) or tables[-1])
    staged_search(spark, "/root/testdata/sf0.001")
    rounds = [t.select("round").distinct().count() for t in tables if "round" in t.columns]
    assert len(rounds) > 2 and max(rounds) == 1

"""Searches and transactions over whole tables: candidates by stages, repair verdicts with their reasons, and
chains of stages that commit or roll back each document on its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchwork.operators.bands import Grid, Pixels, by_band, packed
from swatchwork.operators.raster import PIXEL
from swatchwork.operators.rules import METRICS, GateParams, metric, validated, visual_gate
from swatchwork.runtime import by_shuffle, united, written

FEATURES = ("strokes", "gradients", "geometry")
OPTIONS = (*FEATURES, "background")


# ---- candidates by stages ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class SearchParams:
    """Quality below which an item is searched further, and searched in full; nodes an element
    that count as a risk; what makes a single change worth combining; the background mode of the last try."""

    enough: float = 88.0
    rescue: float = 80.0
    nodes: int = 24
    quality_gain: float = 0.5
    structure_gain: float = 3.0
    keep: str = "keep"
    gate: GateParams = GateParams()


def _variants(items: DataFrame, sizes: Column) -> DataFrame:
    """Options of the items (one row an item: item_id, its options, free: features that may be off) with every
    subset of ``free`` off whose size is in the array ``sizes``. An item's variants are made and parted where its
    row lies."""

    def variant(mask: int) -> Column:
        off = [f for k, f in enumerate(FEATURES) if mask >> k & 1]
        allowed = reduce(lambda a, f: a & F.array_contains("free", f), off, F.array_contains(sizes, F.lit(len(off))))
        return F.when(allowed, F.struct(*((F.lit("off") if f in off else F.col(f)).alias(f) for f in FEATURES)))

    every = F.array_distinct(F.array_compact(F.array(*map(variant, range(1 << len(FEATURES))))))
    return items.select("item_id", "background", F.inline(every)).select("item_id", *OPTIONS)


def _beats(p: GateParams, one: str, other: str) -> Column:
    """Candidate ``one`` safely dominates ``other``: a material gain, and no loss beyond its budget."""
    delta = [metric(n, p, one) - metric(n, p, other) for n in METRICS]
    some = lambda tests: F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests)), F.lit(False))
    return some(d >= g for d, g in zip(delta, p.gain)) & ~some(d < -b for d, b in zip(delta, p.budget))


def staged_search(requests: DataFrame, evaluate: Callable[[DataFrame], DataFrame], p: SearchParams = SearchParams()) -> DataFrame:
    """Candidates of every item, tried in up to four rounds over all items at once: ``item_id, strokes,
    gradients, geometry, background, round, status`` and what ``evaluate`` returned.

    ``requests``: item_id and the asked options; a feature that is ``off`` already cannot be switched off.
    ``evaluate`` takes rows of item_id and options and returns those that could be built with ``quality``
    (null: unscored), ``structure``, ``nodes``, ``elements``, ``free_closed`` and the columns of ``visual_gate``;
    rows that it leaves out have failed. Rounds: what is asked; for items that failed, score low, are not
    accepted or look risky, each feature off alone; then all combinations for items that failed or score
    very low, else those of the features that made a difference alone, if there are two; at last all of it with
    the background kept, where nothing scored well. A combination is tried once; each round's results are
    written once, beside those of the rounds before. Repeated items count once; null options count as off.
    """
    asked = requests.dropna(subset=["item_id"]).groupBy("item_id").agg(*(F.coalesce(F.min(c), F.lit("off")).alias(c) for c in OPTIONS))
    free = F.filter(F.array(*(F.when(F.col(f) != "off", F.lit(f)) for f in FEATURES)), lambda x: x.isNotNull())
    asked = written(asked.withColumn("free", free))
    key = ["item_id", *OPTIONS]
    tried = None

    def attempt(todo: DataFrame, name: str) -> None:
        nonlocal tried
        new = todo.select(*key)
        new = written(new if tried is None else new.join(tried.select(*key), key, "left_anti"))
        if tried is not None and new.isEmpty():
            return
        built = visual_gate(evaluate(new).dropDuplicates(key), p.gate).withColumnRenamed("status", "visual")
        found = new.join(built, key, "left").withColumn("round", F.lit(name)).withColumn("status", F.when(F.col("visual").isNull(), "failed").otherwise("ok"))
        found = written(found)
        tried = found if tried is None else tried.transform(united, found)

    attempt(asked, "requested")
    base = asked.join(tried, key)
    low = F.col("quality").isNull()
    risky = (F.col("nodes") > p.nodes * F.greatest("elements", F.lit(1))) | F.col("free_closed")
    wide = low | (F.col("quality") < p.enough) | F.coalesce(F.col("visual") != "accepted", F.lit(True)) | F.coalesce(risky, F.lit(False))
    state = written(base.filter(wide).select(*key, "free", (low | (F.col("quality") < p.rescue)).alias("all")))
    attempt(_variants(state, F.array(F.lit(1))), "single")
    attempt(_variants(state.filter("all"), F.sequence(F.lit(2), F.lit(len(FEATURES)))), "full")
    # Which features made a difference alone.
    scores = ["quality", "structure", *METRICS, "eligible_cells", "eligible_components", "light_pixels"]
    b = base.join(state.filter("NOT all").select("item_id"), "item_id", "left_semi").select("item_id", "free", *(F.col(c).alias(f"b_{c}") for c in (*OPTIONS, *scores)))
    s = tried.filter("round = 'single' AND quality IS NOT NULL").select("item_id", *(F.col(c).alias(f"s_{c}") for c in (*OPTIONS, *scores)))
    gain = _beats(p.gate, "s_", "b_") | (F.col("s_quality") >= F.col("b_quality") + p.quality_gain) | (F.coalesce("s_structure", F.lit(0.0)) - F.coalesce("b_structure", F.lit(0.0)) >= p.structure_gain)
    which = reduce(lambda c, f: c.when(F.col(f"s_{f}") != F.col(f"b_{f}"), f), FEATURES, F)
    useful = s.join(b, "item_id").filter(gain).groupBy("item_id").agg(F.collect_set(which).alias("free")).filter(F.size("free") >= 2)
    attempt(_variants(state.drop("free").join(useful, "item_id"), F.sequence(F.lit(2), F.lit(len(FEATURES)))), "combined")
    best = tried.groupBy("item_id").agg(F.max("quality").alias("best"))
    again = asked.filter(F.col("background") != p.keep).join(best.filter(F.coalesce(F.col("best") < p.rescue, F.lit(True))), "item_id", "left_semi")
    attempt(_variants(again.withColumn("background", F.lit(p.keep)), F.sequence(F.lit(0), F.lit(len(FEATURES)))), "background")
    return tried


# ---- repair verdicts ---------------------------------------------------------------------------------------

#: Metrics of a repair and the drop that each may show; the last only where it applies.
REPAIR_DROPS = {"foreground": 0.05, "color_fidelity": 0.25, "detail_p10": 0.05, "detail_mean": 0.05, "topology_p10": 0.01, "topology_worst": 0.01, "light_object_coverage": 0.1}
GATE_RANK = {"rejected": 0, "manual_review": 1, "accepted": 2}


def _changed(pictures: dict[int, Pixels], band: int) -> dict[str, object]:
    """Pixels that differ, without a side, and the size of each side."""
    before, after = pictures.get(0), pictures.get(1)
    sizes = [(p["y"].max(), p["x"].max(), side, len(p["y"])) for side, p in pictures.items()]
    y = x = np.empty(0, np.int64)
    if before is not None and after is not None:
        grid = Grid(before, after, pad=0)
        both, off = grid.mask(before) & grid.mask(after), np.zeros(grid.shape, bool)
        for c in ("r", "g", "b", "a"):
            was, now = grid.plane(before, c), grid.plane(after, c)
            off |= (was != now) & (was == was) & (now == now)  # a null differs from nothing
        y, x = np.nonzero(both & off)
        y, x = y + grid.y, x + grid.x
    nth, n = (np.r_[[float(s[i]) for s in sizes], np.full(len(y), np.nan)] for i in (2, 3))
    return {"y": np.r_[[s[0] for s in sizes], y].astype(np.int64), "x": np.r_[[s[1] for s in sizes], x].astype(np.int64), "side": nth, "n": n}


def repair_changes(before: DataFrame, after: DataFrame, boxes: DataFrame, pad: int = 2) -> DataFrame:
    """``doc_id, changed, outside, same_size``: pixels (with alpha) that differ between two pictures, those of
    them in none of the padded boxes (doc_id, x, y, w, h), and whether the pictures have one size. The pictures
    meet in packed bands; only changed pixels are written, and no side is broadcast."""
    cols = [*PIXEL, "r", "g", "b", "a"]
    found = written(by_band(packed([before.select(cols), after.select(cols)]), _changed, "y long, x long, side int, n long"))
    size = lambda side, n: found.filter(F.col("side") == side).groupBy("doc_id").agg(F.struct(F.max("y").alias("y"), F.max("x").alias("x"), F.sum("n").alias("n")).alias(n))
    sizes = size(0, "b").join(by_shuffle(size(1, "a")), "doc_id", "full")
    changed = found.filter("side IS NULL").select(*PIXEL)
    box = boxes.select("doc_id", (F.floor("x") - pad).alias("x0"), (F.floor("y") - pad).alias("y0"), (F.ceil(F.col("x") + F.col("w")) + pad).alias("x1"), (F.ceil(F.col("y") + F.col("h")) + pad).alias("y1"))
    inside = (F.col("p.x") >= F.col("q.x0")) & (F.col("p.x") < F.col("q.x1")) & (F.col("p.y") >= F.col("q.y0")) & (F.col("p.y") < F.col("q.y1"))
    out = changed.alias("p").join(by_shuffle(box.alias("q")), (F.col("p.doc_id") == F.col("q.doc_id")) & inside, "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("outside"))
    n = changed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("changed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sizes.join(by_shuffle(n), "doc_id", "left").join(by_shuffle(out), "doc_id", "left").select("doc_id", zero("changed"), zero("outside"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same_size"))


def repair_audit(proposals: DataFrame, repairs: DataFrame, failures: DataFrame, gates: DataFrame, metrics: DataFrame, changes: DataFrame) -> DataFrame:
    """Verdict on every proposed repair: ``doc_id, status, reasons, targets, unresolved, new_failed, changed,
    outside``; accepted when there is no reason against it.

    ``proposals``: doc_id, status. ``repairs``: doc_id, component, x, y, w, h. ``failures``: doc_id, before, after,
    arrays of failed components, null where there is no evidence. ``gates``: doc_id, before, after. ``metrics``:
    doc_id, metric (of ``REPAIR_DROPS``), before, after, and applies, which only light coverage looks at.
    ``changes``: of ``repair_changes``. A proposal that is not ready, has no repairs or broken ones, or pictures
    of two sizes is judged no further; all other reasons are listed together: pictures unchanged or changed
    outside the boxes, targets that did not fail before or still do, new failures, a lower gate, and metrics
    that fell by more than they may. What is not there is a reason too.
    """
    numbers = [F.col(c) for c in ("x", "y", "w", "h")]
    whole = reduce(lambda a, b: a & b, (c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")) for c in numbers))
    fault = F.when(F.col("component").isNull() | reduce(lambda a, b: a | b, (c.isNull() for c in numbers)), "invalid_repair_locator").when(~whole | (F.col("w") <= 0) | (F.col("h") <= 0), "invalid_repair_bbox")
    asked = repairs.withColumn("fault", fault).groupBy("doc_id").agg(F.array_sort(F.collect_set("component")).alias("targets"), F.array_sort(F.collect_list("fault")).alias("faults"))
    spec = F.create_map(*(x for k, v in REPAIR_DROPS.items() for x in (F.lit(k), F.lit(v))))
    gone = F.col("before").isNull() | F.col("after").isNull() | F.isnan("before") | F.isnan("after")
    bad = F.when(gone, F.concat("metric", F.lit("_evidence_missing"))).when(F.col("after") < F.col("before") - F.element_at(spec, F.col("metric")), F.concat("metric", F.lit("_regressed")))
    # A metric without a row is missing as well.
    need = F.explode(F.array(*map(F.lit, REPAIR_DROPS))).alias("metric")
    light = "light_object_coverage"
    rows = proposals.select("doc_id", need).join(by_shuffle(metrics), ["doc_id", "metric"], "left").filter((F.col("metric") != light) | F.coalesce(F.col("applies"), F.lit(False)))
    place = F.array_position(F.array(*map(F.lit, REPAIR_DROPS)), F.col("metric"))
    worse = rows.withColumn("bad", bad).filter("bad IS NOT NULL").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), "bad"))), lambda r: r["bad"]).alias("worse"))
    one = (
        proposals.select("doc_id", "status").join(by_shuffle(asked), "doc_id", "left").join(by_shuffle(failures.select("doc_id", F.col("before").alias("f_before"), F.col("after").alias("f_after"))), "doc_id", "left")
        .join(by_shuffle(gates.select("doc_id", F.col("before").alias("g_before"), F.col("after").alias("g_after"))), "doc_id", "left").join(by_shuffle(worse), "doc_id", "left").join(by_shuffle(changes), "doc_id", "left")
    )
    none = F.array().cast("array<string>")
    rank = F.create_map(*(x for k, v in GATE_RANK.items() for x in (F.lit(k), F.lit(v))))
    level = lambda c: F.try_element_at(rank, F.coalesce(c, F.lit("")))
    targets, was, now = F.col("targets"), F.col("f_before"), F.col("f_after")
    evidence = was.isNotNull() & now.isNotNull()
    unresolved, new = F.array_sort(F.array_intersect(targets, now)), F.array_sort(F.array_except(now, was))
    tests = [
        (F.coalesce(F.col("changed"), F.lit(0)) == 0, "proposal_render_unchanged"), (F.col("outside") > 0, "render_changed_outside_repair_bbox"), (~evidence, "topology_failure_evidence_missing"),
        (evidence & (F.size(F.array_except(targets, was)) > 0), "target_not_in_before_failures"), (evidence & (F.size(unresolved) > 0), "target_component_not_repaired"),
        (evidence & (F.size(new) > 0), "repair_created_new_topology_failure"), (level(F.col("g_before")).isNull() | level(F.col("g_after")).isNull(), "visual_gate_evidence_missing"),
        (level(F.col("g_after")) < level(F.col("g_before")), "visual_gate_regressed"),
    ]
    listed = F.filter(F.array(*(F.when(t, F.lit(n)) for t, n in tests)), lambda x: x.isNotNull())
    first = (
        F.when(F.coalesce(F.col("status") != "proposed", F.lit(True)), F.array(F.lit("proposal_not_ready"))).when(targets.isNull(), F.array(F.lit("proposal_has_no_repairs")))
        .when(~F.coalesce("same_size", F.lit(False)), F.array(F.lit("render_size_mismatch"))).when(F.size("faults") > 0, F.col("faults"))
    )
    reasons = F.coalesce(first, F.concat(listed, F.coalesce("worse", none)))
    judged = first.isNull()
    return one.select(
        "doc_id", F.when(F.size(reasons) == 0, "accepted").otherwise("rejected").alias("status"), reasons.alias("reasons"), *(F.when(judged, c).alias(n) for c, n in ((targets, "targets"), (unresolved, "unresolved"), (new, "new_failed"))),
        *(F.when(judged, F.coalesce(c, F.lit(0))).alias(c) for c in ("changed", "outside")),
    )


# ---- chains of stages --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stage:
    """A named change of a table of documents' rows, and the check of its result (of ``validated``)."""

    name: str
    change: Callable[[DataFrame], DataFrame]
    check: Callable[[DataFrame, DataFrame], DataFrame]
    enabled: bool = True


def stage_chain(rows: DataFrame, stages: list[Stage]) -> tuple[DataFrame, DataFrame]:
    """Apply ``stages`` in order to ``rows`` (doc_id, ...); each starts from what the one before committed.

    Returns the rows after the last stage, and a report ``doc_id, nth, stage, status, attempted, committed,
    reason``: rows that a stage would add and remove of a document, and those that it did. A document's
    rows change together, when its verdict says so; a stage that fails, on all or without a verdict for one,
    leaves the rows as they were and the next stages go on. Every state is written, so that a stage reads
    what was committed. Rows count with their repeats. A document that a stage adds is refused.
    """
    now, reports = written(rows), []
    docs = written(now.select("doc_id").distinct())

    def told(nth: int, name: str, status: str, reason: str | None = None) -> DataFrame:
        zero = F.lit(0).cast("long")
        return docs.select("doc_id", F.lit(nth).alias("nth"), F.lit(name).alias("stage"), F.lit(status).alias("status"), zero.alias("attempted"), zero.alias("committed"), F.lit(reason).cast("string").alias("reason"))

    for nth, stage in enumerate(stages):
        if not stage.enabled:
            reports.append(told(nth, stage.name, "disabled"))
            continue
        try:
            after = written(stage.change(now).select(now.columns))
        except Exception as error:  # whatever the stage's code raises
            reports.append(told(nth, stage.name, "rolled_back_error", type(error).__name__))
            continue
        moved = now.exceptAll(after).transform(united, after.exceptAll(now)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("attempted"))
        verdict = validated(now, after, stage.check, stage.name).join(moved, "doc_id", "left").withColumn("attempted", F.coalesce("attempted", F.lit(0)).cast("long"))
        status = F.when(F.col("attempted") == 0, "no_change").when(F.col("accepted"), "applied").otherwise("rolled_back_render_guard")
        verdict = written(verdict.withColumn("status", status))
        taken = verdict.filter("status = 'applied'").select("doc_id")
        now = written(now.join(taken, "doc_id", "left_anti").select(now.columns).transform(united, after.join(taken, "doc_id", "left_semi").select(now.columns)))
        reports.append(verdict.select("doc_id", F.lit(nth).alias("nth"), "stage", "status", "attempted", F.when(F.col("status") == "applied", F.col("attempted")).otherwise(0).cast("long").alias("committed"), F.when(F.col("status") == "rolled_back_render_guard", F.col("reason")).alias("reason")))
    return now, reduce(united, reports) if reports else told(0, "", "").limit(0)

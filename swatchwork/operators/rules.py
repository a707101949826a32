"""Rules on scores: gates, dominance, selection, guards and tallies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.runtime import written

METRICS = ("foreground", "color_fidelity", "detail_p10", "detail_mean", "topology_p10", "light_coverage")


@dataclass(frozen=True)
class GateParams:
    """Fixed values, in the order of ``METRICS``: limits of acceptance, of outright rejection and of
    a soft breach; gain that a dominating candidate needs, and loss it may spend."""

    accept: tuple[float, ...] = (88.0, 85.0, 80.0, 88.0, 90.0, 95.0)
    reject: tuple[float, ...] = (60.0, 70.0, 55.0, 75.0, 70.0, 85.0)
    soft: tuple[float, ...] = (85.0, 85.0, 75.0, 88.0, 85.0, 95.0)
    gain: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0, 2.0, 2.0)
    budget: tuple[float, ...] = (0.5, 3.0, 3.0, 1.0, 2.0, 2.0)
    least_cells: int = 8
    least_components: int = 8
    least_light_pixels: int = 64


def _applies(p: GateParams, prefix: str = "") -> dict[str, Column]:
    local = F.coalesce(F.col(f"{prefix}eligible_cells"), F.lit(0)) >= p.least_cells
    topo = F.coalesce(F.col(f"{prefix}eligible_components"), F.lit(0)) >= p.least_components
    lit = F.col(f"{prefix}light_coverage").isNotNull() & (F.coalesce(F.col(f"{prefix}light_pixels"), F.lit(0)) >= p.least_light_pixels)
    return dict(zip(METRICS, (F.lit(True), F.lit(True), local, local, topo, lit)))


def metric(name: str, p: GateParams = GateParams(), prefix: str = "") -> Column:
    """A metric, null where it does not apply."""
    return F.when(_applies(p, prefix)[name], F.col(f"{prefix}{name}"))


def _names(tests: dict[str, Column]) -> Column:
    """Comma-joined names of the tests that hold (a null test doesn't)."""
    return F.concat_ws(",", *(F.when(c, F.lit(n)) for n, c in tests.items()))


def visual_gate(cand: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """Status and breaches of every candidate: rejected on one outright failure, two soft ones or a
    compound local failure; accepted when every required metric reaches its limit."""
    m = {n: metric(n, p) for n in METRICS}
    hard = _names({n: m[n] < t for n, t in zip(METRICS, p.reject)})
    soft = _names({n: m[n] < t for n, t in zip(METRICS, p.soft)})
    applies = _applies(p)
    missed = _names({n: applies[n] & (m[n].isNull() | (m[n] < t)) for n, t in zip(METRICS, p.accept)})
    compound = F.coalesce((m["detail_p10"] < p.accept[2]) & (m["detail_mean"] < p.accept[3]), F.lit(False))
    n_soft = sum((F.when(m[n] < t, 1).otherwise(0) for n, t in zip(METRICS, p.soft)), F.lit(0))
    return cand.select("*", hard.alias("hard_breaches"), soft.alias("soft_breaches"), missed.alias("missed"), compound.alias("compound"), n_soft.alias("n_soft")).withColumn(
        "status", F.when((F.col("hard_breaches") != "") | (F.col("n_soft") >= 2) | F.col("compound"), "rejected").when(F.col("missed") != "", "manual_review").otherwise("accepted")
    )


def dominated(cand: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """Candidates of an item that another one safely dominates: a material gain in one metric, and
    no loss beyond its budget in any."""
    other = cand.select(*(F.col(c).alias(f"o_{c}") for c in cand.columns))
    deltas = {n: metric(n, p, "o_") - metric(n, p) for n in METRICS}
    worse = sum((F.when(deltas[n] < -b, 1).otherwise(0) for n, b in zip(METRICS, p.budget)), F.lit(0)) > 0
    better = sum((F.when(deltas[n] >= g, 1).otherwise(0) for n, g in zip(METRICS, p.gain)), F.lit(0)) > 0
    on = (F.col("item_id") == F.col("o_item_id")) & (F.col("cand_no") != F.col("o_cand_no"))
    return cand.join(other, on & better & ~worse, "left_semi")


def structure_score(nodes: Column, elements: Column, native: Column) -> Column:
    """100 less 12 log10(1 + nodes), less up to 12 for elements, plus up to 8 for native shapes."""
    raw = 100 - 12 * F.log10(1 + nodes) - F.least(F.lit(12.0), 0.4 * elements) + F.least(F.lit(8.0), 2.0 * native)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def selection_rank(quality: Column, structure: Column) -> Column:
    return F.when(quality.isNull(), -1.0).otherwise(0.9 * quality + 0.1 * structure)


def select_candidate(cand: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """One candidate an item: best gate tier, not dominated from within the tier, most features
    kept, then rank, quality and the lowest number."""
    tier = {"rejected": 0, "manual_review": 1, "accepted": 2}
    status = visual_gate(cand, p)
    level = F.element_at(F.create_map(*(x for k, v in tier.items() for x in (F.lit(k), F.lit(v)))), F.col("status"))
    best = status.withColumn("tier", level).withColumn("top", F.max("tier").over(Window.partitionBy("item_id"))).filter("tier = top")
    held = best.select(cand.columns)
    beaten = dominated(held, p).select("item_id", "cand_no")
    left = best.join(beaten, ["item_id", "cand_no"], "left_anti")
    kept = sum((F.when(F.col(c) != "off", 1).otherwise(0) for c in ("strokes", "gradients", "geometry")), F.lit(0))
    rank = selection_rank(F.col("foreground"), structure_score(F.col("nodes"), F.lit(0), F.lit(0)))
    ordered = left.withColumn("kept", kept).withColumn("rank", F.round(rank, 6))
    by = Window.partitionBy("item_id").orderBy(F.desc("kept"), F.desc("rank"), F.desc("foreground"), "cand_no")
    return ordered.withColumn("place", F.row_number().over(by)).filter("place = 1").select("item_id", "cand_no", "status", "kept", "rank")


def option_matrix(options: DataFrame, features: tuple[str, ...] = ("strokes", "gradients", "geometry")) -> DataFrame:
    """All variants of an item with some of its active features switched off; equal ones once."""
    masks = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(features) - 1))).alias("mask")
    rows = options.select("item_id", *features, masks)
    off = lambda k, c: F.when(F.col("mask").bitwiseAND(1 << k) != 0, "off").otherwise(F.col(c)).alias(c)
    return rows.select("item_id", *(off(k, c) for k, c in enumerate(features))).distinct()


def needs_expansion(base: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """Items whose first candidate is not accepted, with the metrics it misses."""
    return visual_gate(base.filter("cand_no = 1"), p).filter("status <> 'accepted'").select("item_id", "status", "missed")


def impactful(cand: DataFrame, least: float = 1.0) -> DataFrame:
    """Later candidates that move a metric of the first by at least ``least``."""
    base = cand.filter("cand_no = 1").select("item_id", *(F.col(m).alias(f"b_{m}") for m in METRICS))
    move = F.greatest(*(F.coalesce(F.abs(F.col(m) - F.col(f"b_{m}")), F.lit(0.0)) for m in METRICS))
    return cand.filter("cand_no > 1").join(base, "item_id").withColumn("move", F.round(move, 6)).filter(F.col("move") >= least).select("item_id", "cand_no", "move")


def regression_guard(before: DataFrame, after: DataFrame, drop: float = 0.25, p10_drop: float = 1.0) -> DataFrame:
    """Triggers of a rollback: unscored or lower foreground, unscored or lower local detail."""
    b = before.select("item_id", F.col("foreground").alias("b_fg"), F.col("detail_p10").alias("b_p10"))
    a = after.select("item_id", F.col("foreground").alias("a_fg"), F.col("detail_p10").alias("a_p10"))
    tests = {
        "foreground_unscored": F.col("a_fg").isNull(), "foreground_drop": F.col("a_fg") < F.col("b_fg") - drop,
        "detail_p10_unscored": F.col("b_p10").isNotNull() & F.col("a_p10").isNull(), "detail_p10_drop": F.col("a_p10") < F.col("b_p10") - p10_drop,
    }
    return b.join(a, "item_id").select("item_id", _names(tests).alias("triggers")).withColumn("rollback", F.col("triggers") != "")


def repair_verdict(before: DataFrame, after: DataFrame, tolerance: tuple[float, ...] = (0.05, 0.1, 0.1, 0.1, 0.1, 0.1)) -> DataFrame:
    """Metrics that got worse by more than their tolerance or went missing; kept when there are none."""
    b = before.select("item_id", *(F.col(m).alias(f"b_{m}") for m in METRICS))
    a = after.select("item_id", *(F.col(m).alias(f"a_{m}") for m in METRICS))
    worse = _names({m: F.col(f"b_{m}").isNotNull() & (F.col(f"a_{m}").isNull() | (F.col(f"a_{m}") < F.col(f"b_{m}") - t)) for m, t in zip(METRICS, tolerance)})
    return b.join(a, "item_id").select("item_id", worse.alias("worse")).withColumn("kept", F.col("worse") == "")


def acceptance(visual: Column, edit: Column, review: Column) -> Column:
    """Combined status of the visual and the editing verdict."""
    return F.when((visual == "rejected") | (edit == "rejected"), "rejected").when(review | (edit != "accepted"), "manual_review").otherwise("accepted")


def time_saving(timings: DataFrame) -> DataFrame:
    """Share of the redraw time that is saved, a case; only actual timings with a baseline count."""
    actual = timings.filter("evidence = 'actual' AND redraw_s > 0 AND vector_s IS NOT NULL")
    saved = 100 * (1 - F.sum("vector_s") / F.sum("redraw_s"))
    return actual.groupBy("case_id").agg(F.count(F.lit(1)).alias("tasks"), F.round(saved, 2).alias("saved_percent"), (saved >= 80).alias("reaches_80"))


def blind_verdicts(answers: DataFrame) -> DataFrame:
    """Tally of blind comparisons: the answer names a side, the table knows whose it was."""
    verdict = F.when(~F.col("answer").isin("left", "right"), "tie").when(F.col("answer") == F.col("tool_side"), "tool_better").otherwise("original_better")
    return answers.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def validated(before: DataFrame, after: DataFrame, check: Callable[[DataFrame, DataFrame], DataFrame], stage: str) -> DataFrame:
    """Verdict of a caller's check ``(before, after) -> (doc_id, accepted, reason)`` for every document
    of ``before``: ``doc_id, stage, accepted, reason``. It fails closed: a document without a verdict,
    with a null one, or any document when the check raises, is rejected."""
    docs = before.select("doc_id").distinct()
    try:
        found = written(check(before, after).select("doc_id", F.col("accepted").cast("boolean").alias("accepted"), F.col("reason").cast("string").alias("reason")))
    except Exception as error:  # whatever the caller's code raises
        return docs.select("doc_id", F.lit(stage).alias("stage"), F.lit(False).alias("accepted"), F.lit(f"validator_error: {type(error).__name__}").alias("reason"))
    one = found.groupBy("doc_id").agg(F.bool_and(F.coalesce("accepted", F.lit(False))).alias("accepted"), F.min("reason").alias("reason"))
    return docs.join(one, "doc_id", "left").select("doc_id", F.lit(stage).alias("stage"), F.coalesce("accepted", F.lit(False)).alias("accepted"), F.when(F.col("accepted").isNull(), "no_verdict").otherwise(F.col("reason")).alias("reason"))

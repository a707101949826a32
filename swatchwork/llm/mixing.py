"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every document has a place between 0 and 1, its hash. The words of a source are summed by hash
bucket; the running sum over the buckets tells in which bucket the budget of the source ends. Only the
documents of that bucket are summed again by finer buckets, until it holds one document. The budget is
then a threshold: documents below it are taken once more than the others. Nothing is sorted by its
hash, and a smaller budget's documents are a part of a larger one's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.llm.running import in_ranges, running_sums
from swatchwork.runtime import small_enough, united, written

#: Bits of a hash digit, digits of a hash, and digits of a row number (63 bits, the first digit is short).
BITS, KEY_DIGITS, ROW_DIGITS = 12, 5, 6


@dataclass(frozen=True)
class MixParams:
    """Sources in the order of their names, null last, have ``weights`` in turn. A budget is a percentage of
    all words; each of ``percents``, in rising order, is one. No source is taken more than ``most`` times."""

    weights: tuple[int, ...] = (5, 2, 1)
    percents: tuple[int, ...] = (100,)
    most: int = 3


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of id and text, the same in every run."""
    shown = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(shown), 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame, keep_row: bool) -> DataFrame:
    """Rows with size, hash and row number; ``name`` is the source, marked so that null is a name too."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("name"), words(F.col("text")).alias("size"),
        place(F.col("doc_id"), F.col("text")).alias("key"), F.monotonically_increasing_id().alias("row"), *([F.struct(*docs.columns).alias("doc")] if keep_row else []),
    )
    return written(rows)


def source_targets(sized: DataFrame, p: MixParams) -> DataFrame:
    """``budget, name, source_size, target`` for every budget and source.

    Targets share the budget by weight; those above the cap of their source stop there, and the rest is
    shared anew until none is above. Sources are ranked in ranges, so their number has no bound; a round
    is one sum over them.
    """
    sizes = sized.groupBy("name").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("name") == "")
    ranked = running_sums(in_ranges(sizes, "last", "name"), [], ["last", "name"], {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (F.pmod(F.col("rank") - 1, F.lit(len(p.weights))) + 1).cast("int"))
    held = written(ranked.select("name", "source_size", weight.alias("weight"), (p.most * F.col("source_size")).alias("cap")))
    total = held.agg(F.sum("source_size")).first()[0] or 0
    out = []
    for k, percent in enumerate(p.percents):
        level, before = 0.0, None
        while True:
            above = F.col("cap") < F.lit(level) * F.col("weight") if before is not None else F.lit(False)
            capped, free = held.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
            if (capped, free) == before:
                break
            before = (capped, free)
            level = (percent * total - 100 * (capped or 0)) / (100 * free) if free else float("inf")
        out.append(held.select(F.lit(k).alias("budget"), "name", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target")))
    return reduce(united, out)


def _digit(level: int) -> Column:
    c, at = (F.col("key"), KEY_DIGITS - 1 - level) if level < KEY_DIGITS else (F.col("row"), KEY_DIGITS + ROW_DIGITS - 1 - level)
    return F.shiftright(c, BITS * at).bitwiseAND((1 << BITS) - 1)


def _paths(level: int) -> list[Column]:
    """The bucket of a row before ``level``: the digits of hash and row number so far."""
    key = F.shiftright(F.col("key"), BITS * max(0, KEY_DIGITS - level))
    row = F.shiftright(F.col("row"), BITS * (KEY_DIGITS + ROW_DIGITS - level)) if level > KEY_DIGITS else F.lit(0).cast("long")
    return [key.alias("key_path"), row.alias("row_path")]


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``times`` (passes over the whole source) and the threshold ``cut_key, cut_row`` of
    one pass more, whose words come nearest to the rest of the target."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = written(targets.withColumn("times", whole).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")))
    zero = F.lit(0).cast("long")
    left = plan.filter("rest > 0").select("budget", "name", "rest", zero.alias("below"), zero.alias("key_path"), zero.alias("row_path"))
    rows, found, by = sized.filter("size > 0").select("name", "key", "row", "size"), [], ["name", "key_path", "row_path"]
    for level in range(KEY_DIGITS + ROW_DIGITS):
        n_left = left.count()
        if not n_left:
            break
        inside = rows.select("*", *_paths(level))
        if level:
            side = left.select(*by).distinct()
            inside = written(inside.join(F.broadcast(side) if small_enough(n_left, 64) else side, by, "left_semi"))
        rows = inside.select("name", "key", "row", "size")
        buckets = inside.groupBy(*by, _digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        # At most 4096 buckets a source and budget.
        upto = F.sum("words").over(Window.partitionBy("budget", "name").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        ends = left.join(buckets, by).withColumn("upto", F.col("below") + upto).withColumn("below", F.col("upto") - F.col("words"))
        ends = ends.filter((F.col("upto") >= F.col("rest")) & (F.col("below") < F.col("rest")))
        path = F.col("key_path" if level < KEY_DIGITS else "row_path") * (1 << BITS) + F.col("digit")
        ends = written(ends.withColumn("key_path" if level < KEY_DIGITS else "row_path", path))
        take = (2 * F.col("rest") > (2 * F.col("below") + F.col("words")).cast("double")).cast("long")
        if level < KEY_DIGITS:
            cut = [F.shiftleft(F.col("key_path") + take, BITS * (KEY_DIGITS - 1 - level)).alias("cut_key"), zero.alias("cut_row")]
        else:
            cut = [F.col("key_path").alias("cut_key"), F.shiftleft(F.col("row_path") + take, BITS * (KEY_DIGITS + ROW_DIGITS - 1 - level)).alias("cut_row")]
        found.append(ends.filter("rows = 1").select("budget", "name", *cut))
        left = ends.filter("rows > 1").select(*left.columns)
    if not found:
        return plan.select("*", zero.alias("cut_key"), zero.alias("cut_row"))
    cuts = reduce(united, found)
    return plan.join(cuts, ["budget", "name"], "left").fillna(0, ["cut_key", "cut_row"])


def _taken(docs: DataFrame, p: MixParams, keep_row: bool) -> DataFrame:
    sized = _sized(docs, keep_row)
    plan = written(thresholds(sized, source_targets(sized, p)))
    # One row a source, with its few budgets.
    one = F.struct("budget", "times", "cut_key", "cut_row", "target")
    by_source = plan.groupBy("name").agg(F.first("source_size").alias("source_size"), F.array_sort(F.collect_list(one)).alias("budgets"))
    side = F.broadcast(by_source) if small_enough(plan.count(), 128) else by_source
    below = lambda b: (F.col("key") < b["cut_key"]) | ((F.col("key") == b["cut_key"]) & (F.col("row") < b["cut_row"]))
    times = F.transform("budgets", lambda b: b["times"] + below(b).cast("long"))
    return sized.join(side, "name").withColumn("times", times).withColumn("target", F.element_at("budgets", -1)["target"])


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, taken_at`` for every row of ``docs`` (doc_id, text, source).

    ``size``: words of the text, 0 of a null or empty one. ``target`` and ``taken`` are of the last budget,
    ``taken_at`` has the words taken under each. Rows without a source form one, ranked last; without that
    column all rows do. Documents are placed by a hash of id and text. Repeated rows have one place and are
    told apart by their number in the written table; as they are alike, the rows of the result are the same
    in every run. Other columns are ignored. An empty table gives an empty result.
    """
    rows = _taken(docs, p, False)
    at = F.transform("times", lambda t: t * F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", F.element_at(at, -1).alias("taken"), at.alias("taken_at"))


def mixture(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The rows of ``docs``, each as often as the last budget takes it; ``mix`` says how nulls and repeated
    rows are handled. Rows without words are left out."""
    rows = _taken(docs, p, True).filter("size > 0").withColumn("n", F.element_at("times", -1)).filter("n > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).select("doc.*")

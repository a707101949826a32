"""Connected components of an edge table by repeated hooking and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatchwork.runtime import by_shuffle, small_enough, written


def _join_rest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the few edges that are left, in one task. A node that is a struct counts as the
    tuple of its fields."""
    top: dict = {}
    kind = None

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    as_given: dict = {}

    def plain(v):
        key = tuple(map(plain, v.values())) if isinstance(v, dict) else v
        as_given[key] = v
        return key

    for rows in parts:
        kind = rows.schema.field("lo").type
        for a, b in zip(rows.column("lo").to_pylist(), rows.column("hi").to_pylist()):
            x, y = find(plain(a)), find(plain(b))
            top[max(x, y)] = min(x, y)
    if top:
        back = as_given.__getitem__
        yield pa.RecordBatch.from_arrays([pa.array([back(x) for x in top], kind), pa.array([back(find(x)) for x in list(top)], kind)], ["component", "up"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, last_rows: int = 20_000) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table; component is the smallest
    node that can be reached. Nodes are of any type with an order, structs such as (doc_id, y, x) too.

    Each round every node hooks on to its smallest neighbour (a plain ``min``, combined before the
    shuffle; a hub's edges that meet in one partition of the later joins are split by Spark's adaptive
    skew join), edges are renamed and equal ones merged. The
    edge table at least halves its nodes each round, and each round's hooks and edges are written
    to the shared folder; the labels follow them by one join a round. Once no more than
    ``last_rows`` edges are left (a fixed bound, whatever the input), one task joins them, which saves
    the last rounds of jobs over next to nothing. Written hooks look small to Spark, so they are broadcast
    only while their edges are counted few. Null ends are ignored; an empty table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    links = written(edges.filter(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct())
    labels = links.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    live = links.filter("lo < hi")
    for _ in range(max_rounds):
        left = live.count()
        if left <= last_rows:
            if not left:
                return labels
            kind = dict(live.dtypes)["lo"]
            hooks = live.repartition(1).mapInArrow(_join_rest, f"component {kind}, up {kind}")
            return labels.join(hooks, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        hooks = (
            live.select(F.explode(F.array(F.struct(F.col("hi").alias("component"), F.col("lo").alias("up")), F.struct(F.col("lo").alias("component"), F.col("lo").alias("up")))).alias("e"))
            .select("e.*")
            .groupBy("component")
            .agg(F.min("up").alias("up"))
        )
        # Two hooks an edge at most; a struct takes some 128 bytes in a broadcast, a number some 48.
        side = F.broadcast if small_enough(2 * left, 128 if dict(live.dtypes)["lo"].startswith("struct") else 48) else by_shuffle
        up = hooks.select(F.col("component").alias("up"), F.col("up").alias("top"))
        hooks = written(hooks.join(side(up), "up", "left").select("component", F.coalesce("top", "up").alias("up")))
        labels = labels.join(side(hooks), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        lo = hooks.select(F.col("component").alias("lo"), F.col("up").alias("lo_up"))
        hi = hooks.select(F.col("component").alias("hi"), F.col("up").alias("hi_up"))
        live = written(
            live.join(side(lo), "lo").join(side(hi), "hi").filter("lo_up <> hi_up")
            .select(F.least("lo_up", "hi_up").alias("lo"), F.greatest("lo_up", "hi_up").alias("hi")).distinct()
        )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

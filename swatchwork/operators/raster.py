"""Pixel tables: drawing, blending, neighbourhoods, runs and components.

``px`` has doc_id, y, x, r, g, b, a; masks are tables of (doc_id, y, x). All keys are spread over
documents and pixels, so one large image is no single task's work.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from swatchwork.operators.bands import BAND, Grid, Pixels, by_band, moved, packed
from swatchwork.operators.graph import connected_components
from swatchwork.runtime import by_shuffle, spread, united, written

PIXEL = ["doc_id", "y", "x"]
EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
FOUR = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def _painter(height: int, width: int, paper: int, band: int, kinds: list[pa.DataType]) -> Callable[[pa.Table], pa.Table]:
    def paint(rows: pa.Table) -> pa.Table:
        """A band of the canvas: shapes in order of ``z``, and nothing where the canvas is not asked for."""
        top = rows.column("band")[0].as_py() * band
        high = min(band, height - top) if pc.any(rows.column("canvas")).as_py() else 0
        shapes = rows.filter(pc.is_valid(rows.column("z"))).sort_by("z").combine_chunks()
        owner = np.full((high, width), len(shapes))
        at = np.arange(width)
        for k, (cx, cy, rad) in enumerate(zip(*(shapes.column(c).to_pylist() for c in ("cx", "cy", "rad")))):
            y0, y1, x0, x1 = max(0, cy - rad - top), min(high, cy + rad - top + 1), max(0, cx - rad), min(width, cx + rad + 1)
            if y0 < y1 and x0 < x1:
                inside = (np.arange(y0, y1) + top - cy)[:, None] ** 2 + (at[x0:x1] - cx) ** 2 <= rad * rad
                owner[y0:y1, x0:x1][inside] = k
        which = pa.array(owner.ravel())
        tones = [pa.concat_arrays([*shapes.column(c).chunks, pa.array([paper]).cast(t)]).take(which) for c, t in zip("rgb", kinds)]
        y, x = (pa.array(v, pa.int32()) for v in (np.repeat(np.arange(high) + top, width), np.tile(at, high)))
        doc = rows.column("doc_id").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(which), np.int64)))
        return pa.Table.from_arrays([doc, y, x, *tones, pa.array(np.full(len(which), 255), pa.int32())], ["doc_id", "y", "x", "r", "g", "b", "a"])

    return paint


def rasterize(shapes: DataFrame, height: int, width: int, docs: DataFrame | None = None, paper: int = 255) -> DataFrame:
    """Filled circles on a plain canvas; the topmost ``z`` paints a pixel.

    Shapes are shuffled to the bands of rows that they touch, and a band, at most ``BAND`` rows of ``width``, is
    painted where it lies: no pixel is ever shuffled, and a band's pixels lie together.
    """
    docs = docs if docs is not None else shapes.select("doc_id").distinct()
    last = (height - 1) // BAND
    tones = [F.coalesce(c, F.lit(paper)).alias(c) for c in "rgb"]
    known = shapes.dropna(subset=["doc_id", "z", "cx", "cy", "rad"]).select("doc_id", "z", *(F.col(c).cast("long").alias(c) for c in ("cx", "cy")), F.abs(F.col("rad").cast("long")).alias("rad"), *tones)
    bands = F.sequence(F.greatest(F.lit(0), F.floor((F.col("cy") - F.col("rad")) / BAND)).cast("long"), F.least(F.lit(last), F.floor((F.col("cy") + F.col("rad")) / BAND)).cast("long"))
    touched = known.filter(f"cy + rad >= 0 AND cy - rad < {height}").withColumn("band", F.explode(bands))
    canvas = docs.select("doc_id", F.lit(True).alias("canvas"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(last + 1)))).alias("band"))
    kinds = dict(known.dtypes)
    arrow = [f.type for f in to_arrow_schema(known.select(*"rgb").schema)]
    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, y int, x int, {', '.join(f'{c} {kinds[c]}' for c in 'rgb')}, a int"
    return spread(united(canvas, touched, allowMissingColumns=True), "doc_id", "band").groupBy("doc_id", "band").applyInArrow(_painter(height, width, paper, BAND, arrow), ddl)


def composite_over(px: DataFrame, paper: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """Visible colours over a plain background."""
    mix = lambda c, p: F.floor((F.col(c) * F.col("a") + F.lit(p) * (255 - F.col("a"))) / 255 + 0.5).cast("int").alias(c)
    return px.select(*PIXEL, *(mix(c, p) for c, p in zip("rgb", paper)))


def channel_gap(a: dict[str, Column] | str, b: dict[str, Column] | str) -> Column:
    """Largest channel difference of two colours, given as column prefixes."""
    at = lambda v, c: v[c] if isinstance(v, dict) else F.col(f"{v}{c}")
    return F.greatest(*(F.abs(at(a, c) - at(b, c)) for c in "rgb"))


def flags(px: DataFrame, light: int = 220) -> DataFrame:
    """Light, neutral, soft and visible pixels, and ink that is far from white."""
    low, high = F.least("r", "g", "b"), F.greatest("r", "g", "b")
    far = sum((F.pow(255 - F.col(c), 2) for c in "rgb"), F.lit(0.0)) > 60 * 60
    return px.select(
        *PIXEL, ((low >= light) & (high - low <= 35)).alias("is_light"), ((low >= light) & (high - low <= 30)).alias("is_neutral"),
        F.col("a").between(1, 254).alias("is_soft"), (F.col("a") > 0).alias("is_visible"), far.alias("is_ink"),
    )


def neighbour_count(mask: DataFrame, offsets: list[tuple[int, int]] = EIGHT) -> DataFrame:
    """Mask pixels in the neighbourhood of every pixel that has any; only mask rows are spread."""
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    moved = mask.select("doc_id", "y", "x", F.explode(steps).alias("o")).select("doc_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return moved.groupBy(*PIXEL).agg(F.count(F.lit(1)).cast("int").alias("n"))


def dilate(mask: DataFrame, height: int, width: int, offsets: list[tuple[int, int]] = EIGHT) -> DataFrame:
    """Mask grown by one pixel, inside the canvas."""
    return neighbour_count(mask, offsets).filter(f"y BETWEEN 0 AND {height - 1} AND x BETWEEN 0 AND {width - 1}").select(*PIXEL)


def erode(mask: DataFrame, offsets: list[tuple[int, int]] = EIGHT) -> DataFrame:
    """Mask pixels whose whole neighbourhood is mask; outside the canvas nothing is."""
    return neighbour_count(mask, offsets).filter(F.col("n") == len(offsets)).join(by_shuffle(mask), PIXEL, "left_semi").select(*PIXEL)


def row_runs(mask: DataFrame) -> DataFrame:
    """Maximal runs ``(doc_id, y, x0, x1)`` of neighbouring mask pixels in a row."""
    by = Window.partitionBy("doc_id", "y").orderBy("x")
    return mask.withColumn("island", F.col("x") - F.row_number().over(by)).groupBy("doc_id", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def _label_band(rows: pa.Table) -> pa.Table:
    """Runs of one band of rows with the first run that they reach inside it (``root_y``, ``root_x0``).
    The band is bounded by its height and the canvas's width."""
    rows = rows.sort_by([("y", "ascending"), ("x0", "ascending")])
    ys, lo, hi, reach = (rows.column(c).to_pylist() for c in ("y", "x0", "x1", "reach"))
    top = list(range(len(ys)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    up, edge = 0, reach[0] if reach else 0  # the run above from which on runs can still touch
    for i, y in enumerate(ys):
        while up < i and (ys[up] < y - 1 or ys[up] == y - 1 and hi[up] < lo[i] - edge):
            up += 1
        j = up
        while j < i and ys[j] == y - 1 and lo[j] <= hi[i] + edge:
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
            j += 1
    roots = [find(i) for i in range(len(ys))]
    at = lambda values: pa.array([values[i] for i in roots], rows.schema.field("y").type)
    return rows.select(["doc_id", "y", "x0", "x1"]).append_column("root_y", at(ys)).append_column("root_x0", at(lo))


def component_runs(mask: DataFrame, reach: int = 1, band: int = 64) -> DataFrame:
    """Runs with the dense number of their component, in order of its first run. ``reach`` 1 joins
    diagonal neighbours (8-connected), 0 only straight ones (4-connected).

    Each ``band`` of rows is labelled where it lies; only components that meet at the border of two
    bands take part in the joins of ``connected_components``. Roots are (doc_id, y, x0) of a component's
    first run, for ids and canvases of any size.
    """
    kind = dict(mask.dtypes)
    runs = row_runs(mask.select(*(F.col(c).cast("int").alias(c) if c != "doc_id" else F.col(c) for c in PIXEL)))
    return labelled_runs(runs, reach, band).select("doc_id", "comp_id", *(F.col(c).cast(kind["y" if c == "y" else "x"]).alias(c) for c in ("y", "x0", "x1")))


def labelled_runs(runs: DataFrame, reach: int = 1, band: int = 64) -> DataFrame:
    """``component_runs`` of what is in runs ``doc_id, y, x0, x1`` already; places are ints."""
    kind = dict(runs.dtypes)["doc_id"]
    rows = runs.select("doc_id", F.floor(F.col("y") / band).cast("int").alias("band"), *(F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")), F.lit(reach).alias("reach"))
    local = written(rows.groupBy("doc_id", "band").applyInArrow(_label_band, f"doc_id {kind}, y int, x0 int, x1 int, root_y int, root_x0 int").withColumn("root", F.struct("doc_id", F.col("root_y").alias("y"), F.col("root_x0").alias("x0"))))
    first = local.filter(F.pmod("y", F.lit(band)) == 0)
    last = local.filter(F.pmod("y", F.lit(band)) == band - 1).select("doc_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("root").alias("up"))
    near = (F.col("u0") <= F.col("x1") + reach) & (F.col("u1") >= F.col("x0") - reach)
    edges = first.join(by_shuffle(last), ["doc_id", "y"]).filter(near).select(F.col("up").alias("src"), F.col("root").alias("dst"))
    parts = connected_components(edges).withColumnRenamed("node", "root")
    named = local.join(by_shuffle(parts), "root", "left").withColumn("root", F.coalesce("component", "root"))
    rank = named.select("doc_id", "root").distinct().withColumn("comp_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("root")))
    return named.join(by_shuffle(rank), ["doc_id", "root"]).select("doc_id", "comp_id", "y", "x0", "x1")


def _label_pixels(rows: pa.Table) -> pa.Table:
    """Pixels of one band as lists by the component that they make inside it, with sums for its moments."""
    rows = rows.sort_by([("y", "ascending"), ("x", "ascending")])
    y, x = (rows.column(c).to_numpy() for c in ("y", "x"))
    starts = np.flatnonzero(np.r_[True, (np.diff(y) != 0) | (np.diff(x) != 1)])
    ends = np.r_[starts[1:], len(y)] - 1
    ints = lambda v: pa.array(v, pa.int32())
    runs = pa.table({"doc_id": rows.column("doc_id").take(pa.array(starts)), "y": ints(y[starts]), "x0": ints(x[starts]), "x1": ints(x[ends]), "reach": rows.column("reach").take(pa.array(starts))})
    labelled = _label_band(runs)
    of_run = np.stack([labelled.column(c).to_numpy() for c in ("root_y", "root_x0")])
    root = np.repeat(of_run, ends - starts + 1, axis=1)
    order = np.lexsort((x, y, root[1], root[0]))
    root, y, x = root[:, order], y[order].astype(np.int64), x[order].astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, (np.diff(root[0]) != 0) | (np.diff(root[1]) != 0)])
    offsets = pa.array(np.r_[cuts, len(y)], pa.int32())
    of = {"n": np.diff(np.r_[cuts, len(y)]), **{k: np.add.reduceat(v, cuts) for k, v in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))}}
    of |= {f"{pick}_{c}": at.reduceat(v, cuts) for c, v in (("x", x), ("y", y)) for pick, at in (("lo", np.minimum), ("hi", np.maximum))}
    sorted_ = rows.drop_columns(["band", "reach", "doc_id"]).take(pa.array(order)).combine_chunks()
    lists = {f"{c}s": pa.ListArray.from_arrays(offsets, sorted_.column(c).combine_chunks()) for c in sorted_.column_names}
    return pa.table({"doc_id": rows.column("doc_id").slice(0, 1).take(pa.array(np.zeros(len(cuts), int))), "root_y": ints(root[0, cuts]), "root_x": ints(root[1, cuts]), **{k: pa.array(v, pa.int64()) for k, v in of.items()}, **lists})


PIECE = ["doc_id", "root_y", "root_x"]


def component_pieces(px: DataFrame, extra: list[str], band: int = 64) -> tuple[DataFrame, DataFrame]:
    """8-connected components with what their pixels carry: pieces, and the ``comp_id`` (as in
    ``component_runs``) of each.

    A piece is what a component has in one band of rows: (doc_id, root_y, root_x), sums for its moments, and its
    pixels as lists ``ys, xs`` and one of each column in ``extra``. Pixels are shuffled once, by band, and written
    as pieces; only the names of pieces and the pixels on the borders of bands take part in the joins after.
    """
    kind = dict(px.dtypes)
    rows = px.select("doc_id", F.floor(F.col("y") / band).cast("int").alias("band"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *extra, F.lit(1).alias("reach"))
    sums = ", ".join(f"{c} long" for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "lo_x", "hi_x", "lo_y", "hi_y"))
    lists = ", ".join(["ys array<int>", "xs array<int>", *(f"{c}s array<{kind[c]}>" for c in extra)])
    pieces = written(rows.groupBy("doc_id", "band").applyInArrow(_label_pixels, f"doc_id {kind['doc_id']}, root_y int, root_x int, {sums}, {lists}"))
    root = F.struct("doc_id", F.col("root_y").alias("y"), F.col("root_x").alias("x0"))
    at = pieces.select(root.alias("root"), F.explode(F.arrays_zip("ys", "xs")).alias("p")).select("root", "root.doc_id", "p.ys", "p.xs")
    first = at.filter(F.pmod("ys", F.lit(band)) == 0).select("doc_id", F.col("ys").alias("y"), F.col("xs").alias("x"), "root")
    last = at.filter(F.pmod("ys", F.lit(band)) == band - 1).select("doc_id", (F.col("ys") + 1).alias("y"), F.explode(F.array(*(F.col("xs") + d for d in (-1, 0, 1)))).alias("x"), F.col("root").alias("up"))
    parts = connected_components(first.join(by_shuffle(last), PIXEL).select(F.col("up").alias("src"), F.col("root").alias("dst")).distinct()).withColumnRenamed("node", "root")
    named = pieces.select(root.alias("root")).join(by_shuffle(parts), "root", "left").select("root.doc_id", F.col("root.y").alias("root_y"), F.col("root.x0").alias("root_x"), F.coalesce("component", "root").alias("top"))
    return pieces, named.select(*PIECE, F.dense_rank().over(Window.partitionBy("doc_id").orderBy("top")).alias("comp_id"))


def component_stats(runs: DataFrame) -> DataFrame:
    """Area, box, fill and centre of each component, from its runs."""
    n = F.col("x1") - F.col("x0") + 1
    found = runs.groupBy("doc_id", "comp_id").agg(
        F.sum(n).alias("area"), F.min("x0").alias("bx"), F.min("y").alias("by"), (F.max("x1") - F.min("x0") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"),
        F.sum(n * F.col("y")).alias("sy"), F.sum((F.col("x0") + F.col("x1")) * n / 2).alias("sx"),
    )
    return found.select("doc_id", "comp_id", "area", "bx", "by", "bw", "bh", F.round(F.col("area") / (F.col("bw") * F.col("bh")), 6).alias("fill"), F.round(F.col("sx") / F.col("area"), 6).alias("mx"), F.round(F.col("sy") / F.col("area"), 6).alias("my"))


def border_connected(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Per document the mask pixels that are 4-connected with the border, and all mask pixels."""
    runs = component_runs(mask, reach=0)
    touches = F.max(F.when((F.col("y") == 0) | (F.col("y") == height - 1) | (F.col("x0") == 0) | (F.col("x1") == width - 1), 1).otherwise(0))
    comps = runs.groupBy("doc_id", "comp_id").agg(touches.alias("edge"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    return comps.groupBy("doc_id").agg(F.sum(F.when(F.col("edge") == 1, F.col("area")).otherwise(0)).alias("outer_pixels"), F.sum("area").alias("mask_pixels"), F.count_if(F.col("edge") == 0).alias("enclosed"))


def _upwards(pictures: dict[int, Pixels], band: int) -> dict[str, object]:
    """Distance of each pixel to the end of the mask in its own column; the band has whole columns."""
    p = pictures[0]
    grid = Grid(p)
    far = grid.mask(p).astype(np.int64)
    for k in range(1, len(far)):
        far[k] *= far[k - 1] + 1
    back = (far > 0).astype(np.int64)
    for k in range(len(far) - 2, -1, -1):
        back[k] *= back[k + 1] + 1
    return {"y": p["y"], "x": p["x"], "d": np.minimum(far, back)[grid.at(p)]}


def _sideways(pictures: dict[int, Pixels], band: int) -> dict[str, object]:
    """The least of each pixel's distances along its row to a column and up that column; the band has whole rows."""
    p = pictures[0]
    grid = Grid(p)
    far = grid.plane(p, "d").astype(np.int64)
    for k in range(1, far.shape[1]):
        far[:, k] = np.minimum(far[:, k], far[:, k - 1] + 1)
    for k in range(far.shape[1] - 2, -1, -1):
        far[:, k] = np.minimum(far[:, k], far[:, k + 1] + 1)
    return {"y": p["y"], "x": p["x"], "distance": far[grid.at(p)]}


def distance_capped(mask: DataFrame, cap: int | None = None) -> DataFrame:
    """4-neighbour distance of mask pixels to the outside, at most ``cap`` where one is given: along the columns,
    in bands of whole columns, then along the rows, in bands of whole rows. The distance has no bound of its own."""
    kind = dict(mask.dtypes)
    up = by_band(packed([mask.select(*PIXEL)], along="x"), _upwards, f"y {kind['y']}, x {kind['x']}, d int")
    found = by_band(packed([up]), _sideways, f"y {kind['y']}, x {kind['x']}, distance int")
    return found if cap is None else found.withColumn("distance", F.least("distance", F.lit(cap)))


def _medians(limit: int) -> Callable[..., dict[str, object]]:
    def middle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))

    def smooth(pictures: dict[int, Pixels], band: int) -> dict[str, object]:
        """The band's own pixels. A median of nine is that of the largest low, the middle mid and the smallest high of
        three sorted rows of three; a missing neighbour's place has the pixel, or its row, itself."""
        p = pictures[0]
        grid = Grid(p)
        there, own = grid.mask(p), p["y"] // BAND == band
        beside = {s: moved(there, *s, False) for s in ((0, -1), (0, 1), (-1, 0), (1, 0))}
        at, old, new = tuple(v[own] for v in grid.at(p)), {}, {}
        for c in "rgb":
            values = p[c].astype(float)
            plane = grid.plane(p, np.where(np.isnan(values), -np.inf, values))  # nulls sort first
            left, right = (np.where(beside[s], moved(plane, *s), plane) for s in ((0, -1), (0, 1)))
            three = (np.minimum(np.minimum(left, plane), right), middle(left, plane, right), np.maximum(np.maximum(left, plane), right))
            low, mid, high = ((np.where(beside[-1, 0], moved(v, -1, 0), v), v, np.where(beside[1, 0], moved(v, 1, 0), v)) for v in three)
            new[c] = middle(np.maximum(np.maximum(low[0], low[1]), low[2]), middle(*mid), np.minimum(np.minimum(high[0], high[1]), high[2]))[at]
            old[c] = values[own]
        with np.errstate(invalid="ignore"):
            gaps = [np.where(np.isinf(new[c]), np.nan, np.abs(old[c] - new[c])) for c in "rgb"]
            keep = reduce(np.fmax, gaps) <= limit
        return {"y": p["y"][own], "x": p["x"][own], **{c: np.where(keep, np.where(np.isinf(new[c]), np.nan, new[c]), old[c]) for c in "rgb"}}

    return smooth


def median3x3(px: DataFrame) -> DataFrame:
    """Median of each 3x3 neighbourhood, channel by channel; a pixel whose neighbour is not there, at
    the edge of the canvas, repeats itself. Rows of three, then columns of those, by windows: every
    pixel moves twice, not nine times."""
    row, column = Window.partitionBy("doc_id", "y").orderBy("x"), Window.partitionBy("doc_id", "x").orderBy("y")

    def beside(c: str, by: Window, at: str, step: int) -> Column:
        move = F.lag if step < 0 else F.lead
        return F.coalesce(F.when(move(at).over(by) == F.col(at) + step, move(c).over(by)), F.col(c))

    three = px.select(*PIXEL, *(F.array(beside(c, row, "x", -1), F.col(c), beside(c, row, "x", 1)).alias(c) for c in "rgb"))
    return three.select(*PIXEL, *(F.sort_array(F.concat(beside(c, column, "y", -1), F.col(c), beside(c, column, "y", 1)))[4].alias(c) for c in "rgb"))


def denoise(px: DataFrame, limit: int = 18) -> DataFrame:
    """The median (of ``median3x3``) where it changes a pixel by no more than ``limit``. Pixels are packed once
    and meet in bands."""
    kind = dict(px.dtypes)
    return by_band(packed([px.select(*PIXEL, *"rgb")], halo=1), _medians(limit), ", ".join(f"{c} {kind[c]}" for c in ("y", "x", "r", "g", "b")))

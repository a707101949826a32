"""Colour histograms and palettes.

Pixels are counted into a histogram first; all later work is on colours with weights, for all
documents at once.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.operators.palette_rounds import colour_pieces, joined, moved, settled, with_seed, without_blend
from swatchwork.operators.raster import component_runs
from swatchwork.runtime import by_shuffle, united, written

COLOUR = ["doc_id", "r", "g", "b"]


def color_histogram(px: DataFrame) -> DataFrame:
    """Distinct visible colours and their pixels; counts are combined before the shuffle."""
    return px.filter("a > 0").groupBy(*COLOUR).agg(F.count(F.lit(1)).alias("w"))


def bounded_sample(hist: DataFrame, most: int = 100_000) -> DataFrame:
    """Over ``most`` colours: the heaviest half, and evenly spaced ones of the rest."""
    half = most // 2
    by = Window.partitionBy("doc_id").orderBy(F.desc("w"), "r", "g", "b")
    ranked = hist.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).withColumn("rank", F.row_number().over(by))
    rest = ranked.withColumn("spread", F.row_number().over(Window.partitionBy("doc_id", F.col("rank") > half).orderBy("r", "g", "b")) - 1)
    step = F.greatest(F.col("n") - half - 1, F.lit(1)) / (half - 1)
    picked = F.ceil(F.col("spread") / step) != F.ceil((F.col("spread") + 1) / step)
    return rest.filter((F.col("n") <= most) | (F.col("rank") <= half) | picked).select(*COLOUR, "w")


def distance2(a: str, b: str) -> Column:
    return sum((F.pow(F.col(f"{a}{c}") - F.col(f"{b}{c}"), 2) for c in "rgb"), F.lit(0.0))


def _with_best(hist: DataFrame, pals: DataFrame) -> DataFrame:
    """Colours with ``best``, the nearest entry (d2, k, p_r, p_g, p_b) of their document's palette, one
    array ``pal`` (k, p_r, p_g, p_b) a document, so that colours are not copied for each of its entries."""
    gap = lambda q: sum((F.pow(F.col(c) - q[f"p_{c}"], 2) for c in "rgb"), F.lit(0.0))
    best = F.array_min(F.transform("pal", lambda q: F.struct(gap(q).alias("d2"), q["k"].alias("k"), q["p_r"].alias("p_r"), q["p_g"].alias("p_g"), q["p_b"].alias("p_b"))))
    return hist.join(pals.select("doc_id", "pal"), "doc_id").select(*COLOUR, "w", best.alias("best"))


def _palettes(pal: DataFrame) -> DataFrame:
    """A palette table as one array a document."""
    return pal.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", *(F.col(c).alias(f"p_{c}") for c in "rgb")))).alias("pal"))


def nearest_label(hist: DataFrame, pal: DataFrame) -> DataFrame:
    """Palette index of each colour: least squared distance, lowest index of equals."""
    return _with_best(hist, by_shuffle(_palettes(pal))).select(*COLOUR, "w", F.col("best.k").alias("k"), F.col("best.d2").alias("d2"), "best.p_r", "best.p_g", "best.p_b")


def snap_to_palette(hist: DataFrame, pal: DataFrame, radius: float = 48.0) -> DataFrame:
    """The nearest palette colour within the radius, else the colour itself."""
    near = F.col("d2") <= radius * radius
    return nearest_label(hist, pal).select(*COLOUR, "w", *(F.when(near, F.bround(F.col(f"p_{c}"))).otherwise(F.col(c)).cast("int").alias(f"to_{c}") for c in "rgb"))


def cluster_shares(labelled: DataFrame) -> DataFrame:
    total = F.sum(F.sum("w")).over(Window.partitionBy("doc_id"))
    return labelled.groupBy("doc_id", "k").agg(F.sum("w").alias("w"), F.round(F.sum("w") / total, 6).alias("share"))


def weighted_quantile(rows: DataFrame, value: str, weight: str, q: float, key: str = "doc_id") -> DataFrame:
    """First value, in ascending order, at which the running weight reaches ``q`` of the total."""
    flat = rows.groupBy(key, value).agg(F.sum(weight).alias("w"))
    run = flat.withColumn("run", F.sum("w").over(Window.partitionBy(key).orderBy(value))).withColumn("total", F.sum("w").over(Window.partitionBy(key)))
    return run.filter(F.col("run") >= q * F.col("total")).groupBy(key).agg(F.min(value).alias("value"))


def palette_fit(labelled: DataFrame) -> DataFrame:
    """Mean, 90th and 95th percentile of the colour error, and the share above 25."""
    flat = labelled.groupBy("doc_id", F.sqrt("d2").alias("e")).agg(F.sum("w").alias("w"))
    run, total = F.sum("w").over(Window.partitionBy("doc_id").orderBy("e")), F.sum("w").over(Window.partitionBy("doc_id"))
    at = lambda q: F.round(F.min(F.when(F.col("run") >= q * F.col("total"), F.col("e"))), 3).alias(f"p{round(100 * q)}")
    over = F.sum(F.when(F.col("e") > 25, F.col("w")).otherwise(0)) / F.sum("w")
    return flat.withColumn("run", run).withColumn("total", total).groupBy("doc_id").agg(F.round(F.sum(F.col("e") * F.col("w")) / F.sum("w"), 3).alias("mean"), F.round(over, 4).alias("over_25_share"), at(0.9), at(0.95))


def color_name(r: Column, g: Column, b: Column) -> Column:
    """One of twelve names by hue, after black, white and gray."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    v, spread = high / 255, high - low
    s = F.when(high == 0, 0.0).otherwise(spread / high)
    hue = F.when(high == r, F.pmod(60 * (g - b) / spread, F.lit(360.0))).when(high == g, 60 * (b - r) / spread + 120).otherwise(60 * (r - g) / spread + 240)
    name = F.when(v < 0.18, "black").when((s < 0.12) & (v > 0.9), "white").when(s < 0.15, "gray")
    # Upper hue limits of the names.
    for limit, word in ((15, "red"), (45, "orange"), (70, "yellow"), (95, "yellow-green"), (160, "green"), (200, "cyan"), (255, "blue"), (290, "purple"), (340, "magenta"), (360, "red")):
        name = name.when(hue < limit, word)
    return name.otherwise("color")


def oklch(r: Column, g: Column, b: Column) -> Column:
    """Lightness, chroma and hue (degrees) in OKLab; matrices are the published ones."""
    lin = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    x, y, z = lin(r), lin(g), lin(b)
    # Linear sRGB to cone response, and its cube root to OKLab.
    cone = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
    lab = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
    roots = [F.cbrt(x * m[0] + y * m[1] + z * m[2]) for m in cone]
    lightness, a, bb = (sum(w * c for w, c in zip(row, roots)) for row in lab)
    return F.struct(lightness.alias("lightness"), F.sqrt(a * a + bb * bb).alias("chroma"), F.pmod(F.degrees(F.atan2(bb, a)), F.lit(360.0)).alias("hue"))


def _no_palettes(hist: DataFrame) -> DataFrame:
    return hist.select("doc_id").distinct().withColumn("pal", F.array().cast("array<struct<k:int,p_r:double,p_g:double,p_b:double>>"))


def _spread(now: DataFrame) -> DataFrame:
    """Palettes, one array a document, as a palette table."""
    return now.select("doc_id", F.inline("pal")).toDF("doc_id", "k", "r", "g", "b")


def _given(pal: DataFrame) -> DataFrame:
    return _palettes(pal.select("doc_id", "k", *(F.col(c).cast("double").alias(c) for c in "rgb")))


def _merged(pieces: DataFrame, now: DataFrame, limit: float) -> DataFrame:
    return settled(pieces, now, partial(joined, limit=limit))


def _unblended(pieces: DataFrame, now: DataFrame, small: float = 0.035, near: float = 28.0) -> DataFrame:
    return settled(pieces, now, partial(without_blend, small=small, near=near))


def kmeans_seed(hist: DataFrame, k: int) -> DataFrame:
    """The heaviest colour, then k - 1 times the colour of largest weight times squared distance to
    its nearest seed; ties by colour. One pass a seed for all documents; only the seeds are
    written, the histogram is read."""
    return _spread(settled(colour_pieces(hist), _no_palettes(hist), partial(with_seed, k=k), k))


def weighted_kmeans(hist: DataFrame, k: int, rounds: int = 30, still: float = 0.3, seeds: DataFrame | None = None) -> DataFrame:
    """Weighted k-means of every document's colours at once; documents that moved no more than
    ``still`` and reseeded nothing are done, and the loop ends when all are. An empty centre goes to
    the colour of largest weighted error (the first by colour of equals). ``rounds``: the bound that
    belongs to the method; ``seeds``: first centres instead of the usual ``k``. A document's centres
    are one array; each round is one aggregation of the colours of open documents."""
    start = written(kmeans_seed(hist, k) if seeds is None else seeds)
    return _spread(settled(colour_pieces(hist, start), _given(start), partial(moved, still=still), rounds))


def merge_close(pal: DataFrame, hist: DataFrame, limit: float = 45.0) -> DataFrame:
    """Merge the closest pair of palette colours below the limit, one pair a document and round,
    until none is left; each round weighs the colours by the pixels of ``hist`` nearest to them. The
    merged colour gets a new last number. Each round takes one colour of a document, so the palette's size
    bounds the rounds."""
    now = _merged(colour_pieces(hist, pal), _given(pal), limit)
    return now.select("doc_id", F.inline(F.arrays_zip("pal", "w"))).select("doc_id", "pal.*", F.greatest(F.col("w").cast("double"), F.lit(1.0)).alias("w")).toDF("doc_id", "k", "r", "g", "b", "w")


def prune_blends(pal: DataFrame, shares: DataFrame, small: float = 0.035, near: float = 28.0) -> DataFrame:
    """Palette colours that are small and lie near the line between two colours of three times their
    share: the blends that a pruning round would look at."""
    p = pal.join(shares.select("doc_id", "k", "share"), ["doc_id", "k"])
    of = lambda m: p.select("doc_id", *(F.col(c).alias(f"{m}{c}") for c in ("k", "r", "g", "b", "share")))
    t = p.filter(F.col("share") < small).join(of("a_"), "doc_id").filter("a_k <> k AND a_share >= 3 * share").join(of("b_"), "doc_id").filter("b_k <> k AND a_k < b_k AND b_share >= 3 * share")
    ab2 = distance2("a_", "b_")
    dot = sum(((F.col(c) - F.col(f"a_{c}")) * (F.col(f"b_{c}") - F.col(f"a_{c}")) for c in "rgb"), F.lit(0.0))
    at = F.when(ab2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / ab2)))
    gap = F.sqrt(sum((F.pow(F.col(c) - (F.col(f"a_{c}") + at * (F.col(f"b_{c}") - F.col(f"a_{c}"))), 2) for c in "rgb"), F.lit(0.0)))
    return t.withColumn("gap", gap).filter(F.col("gap") < near).groupBy("doc_id", "k").agg(F.round(F.min("gap"), 6).alias("gap"), F.first("share").alias("share"))


def pruned(pal: DataFrame, hist: DataFrame, small: float = 0.035, near: float = 28.0) -> DataFrame:
    """The palette without its blends: each round drops the smallest one of a document (see
    ``prune_blends``), shares are counted again, and two colours always stay. Runs until no document
    has a blend left; each round takes one colour, so the palette's size bounds the rounds."""
    return _spread(_unblended(colour_pieces(hist, pal), _palettes(pal), small, near))


def choose_palette(hist: DataFrame, most: int = 8, forced: int | None = None) -> DataFrame:
    """``doc_id, mode, base_colors, k, r, g, b, mean, p90``: the palette of every document.

    ``forced``: that many centres as they are. Otherwise ``most`` centres, merged and pruned, are the
    compact palette. Where both its mean and its 90th percentile of error are high, palettes of 12,
    16 and 20 centres are fitted for all such documents at once; they are tried in this order, one
    replaces the best so far on a material gain, and the first that meets the target ends the search.
    """
    whole = lambda pal: pal.select("doc_id", "k", *(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c).cast("int"))).alias(c) for c in "rgb"))
    if forced is not None and forced >= 2:
        pal = written(weighted_kmeans(hist, forced))
        size = pal.groupBy("doc_id").agg(F.count(F.lit(1)).alias("base_colors"))
        return whole(pal).join(size, "doc_id").join(palette_fit(nearest_label(hist, pal)), "doc_id").select("doc_id", F.lit("forced").alias("mode"), "base_colors", "k", "r", "g", "b", "mean", "p90")
    # One table of colours for all rounds.
    pieces, drawn = colour_pieces(hist), lambda now: now.select("doc_id", "pal")
    first = settled(pieces, _no_palettes(hist), partial(with_seed, k=most), most)
    fitted = settled(pieces, drawn(first), partial(moved, still=0.3), 30)
    base = _spread(_unblended(pieces, drawn(_merged(pieces, drawn(fitted), 45.0))))
    fit = palette_fit(nearest_label(hist, base)).select("doc_id", "mean", "p90")
    size = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("base_colors"))
    n = hist.groupBy("doc_id").agg(F.count(F.lit(1)).alias("colours"))
    known = written(fit.join(size, "doc_id").join(n, "doc_id"))
    poor = known.filter((F.col("colours") > F.col("base_colors")) & (F.col("mean") > 13.0) & (F.col("p90") > 25.0) & F.lit(most >= 8)).select("doc_id")
    # A key of document and size, so that all sizes run in the same joins. The first seeds of all are the same.
    sizes = (12, 16, 20)
    keyed = lambda df: df.join(poor, "doc_id").withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("doc_id", F.struct("doc_id", "size")).drop("size")
    seeds = settled(pieces, drawn(first).join(poor, "doc_id", "left_semi"), partial(with_seed, k=sizes[-1]), sizes[-1])
    rich_hist, rich_pieces = written(keyed(hist)), written(keyed(pieces))
    rich = settled(rich_pieces, keyed(drawn(seeds)).withColumn("pal", F.filter("pal", lambda q: q["k"] < F.col("doc_id.size"))), partial(moved, still=0.3), 30)
    rich = _spread(_unblended(rich_pieces, drawn(_merged(rich_pieces, drawn(rich), 10.0)), 0.0015, 6.0))
    rich_fit = palette_fit(nearest_label(rich_hist, rich))
    tries = rich_fit.select("doc_id.doc_id", F.struct("doc_id.size", "mean", "p90").alias("t")).groupBy("doc_id").agg(F.array_sort(F.collect_list("t")).alias("tries"))

    def step(best: Column, t: Column) -> Column:
        gain = (t["mean"] <= best["mean"] - 1.0) | (t["p90"] <= best["p90"] - 2.0)
        material = gain & (t["mean"] <= best["mean"] + 0.25) & (t["p90"] <= best["p90"] + 0.5)
        met = (t["mean"] <= 13.0) & (t["p90"] <= 25.0)
        taken = ~best["met"] & (material | met)
        field = lambda c: F.when(taken, t[c]).otherwise(best[c]).alias(c)
        return F.struct(field("size"), field("mean"), field("p90"), (best["met"] | met).alias("met"))

    start = F.struct(F.lit(0).alias("size"), F.col("mean"), F.col("p90"), F.lit(False).alias("met"))
    none = F.array().cast("array<struct<size:int,mean:double,p90:double>>")
    best = known.join(tries, "doc_id", "left").withColumn("best", F.aggregate(F.coalesce("tries", none), start, step)).select("doc_id", "base_colors", "best.size", "best.mean", "best.p90")
    every = whole(base).withColumn("size", F.lit(0)).transform(united, whole(rich).select(F.col("doc_id.doc_id").alias("doc_id"), "k", "r", "g", "b", F.col("doc_id.size").alias("size")))
    chosen = every.join(best, ["doc_id", "size"])
    count = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1
    return chosen.select("doc_id", F.when(count > F.col("base_colors"), "adaptive").otherwise("compact").alias("mode"), "base_colors", place.alias("k"), "r", "g", "b", "mean", "p90")


def lost_colors(hist: DataFrame, pal: DataFrame, emitted: DataFrame, share: float = 0.01, radius: float = 75.0, blend: float = 35.0, paper: DataFrame | None = None) -> DataFrame:
    """Palette colours of at least ``share`` of the weight that no emitted colour covers (largest channel
    difference within ``radius``) and that lie further than ``blend`` from every straight line between
    two end points: emitted colours and the removed background ``paper``, if any (doc_id, r, g, b)."""
    heavy = cluster_shares(nearest_label(hist, pal)).filter(F.col("share") >= share).join(pal, ["doc_id", "k"])
    colour = lambda df, drawn: df.select("doc_id", F.struct(*(F.col(c).cast("double").alias(c) for c in "rgb"), F.lit(drawn).alias("drawn")).alias("e"))
    ends = colour(emitted, True) if paper is None else colour(emitted, True).transform(united, colour(paper, False))
    # A palette is small, so a document's end points are one short array.
    both = heavy.join(ends.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("ends")), "doc_id", "left")
    covered = F.exists("ends", lambda e: e["drawn"] & (F.greatest(*(F.abs(F.col(c) - e[c]) for c in "rgb")) <= radius))

    def beside(p: Column, q: Column) -> Column:
        along = sum(((F.col(c) - p[c]) * (q[c] - p[c]) for c in "rgb"), F.lit(0.0))
        size = sum((F.pow(q[c] - p[c], 2) for c in "rgb"), F.lit(0.0))
        u = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / size))).otherwise(0.0)
        return sum((F.pow(F.col(c) - (p[c] + u * (q[c] - p[c])), 2) for c in "rgb"), F.lit(0.0)) < blend * blend

    blended = F.exists("ends", lambda p: F.exists("ends", lambda q: (p < q) & beside(p, q)))
    lost = ~F.coalesce(covered, F.lit(False)) & ~F.coalesce(blended, F.lit(False))
    return both.filter(lost).select("doc_id", "k", "r", "g", "b", "share")


def unique_color_gain(hist: DataFrame, current: DataFrame, missing: DataFrame) -> DataFrame:
    """Weight that each missing colour would win: a colour goes to the one missing colour of largest
    error gain over the current palette."""
    now = nearest_label(hist, current).select(*COLOUR, "w", F.sqrt("d2").alias("now"))
    m = missing.select("doc_id", F.col("k").alias("m_k"), *(F.col(c).alias(f"m_{c}") for c in "rgb"))
    gain = F.col("now") - F.sqrt(distance2("", "m_"))
    best = now.join(m, "doc_id").withColumn("gain", gain).filter("gain > 0").groupBy(*COLOUR, "w").agg(F.min(F.struct((-F.col("gain")).alias("lost"), "m_k")).alias("best"))
    return best.groupBy("doc_id", F.col("best.m_k").alias("k")).agg(F.sum("w").alias("w"), F.round(F.sum(-F.col("best.lost") * F.col("w")), 3).alias("gain"))


def region_adjacency(px: DataFrame, label: str, limit: int = 30) -> DataFrame:
    """Contacts of differently labelled right and lower neighbours, and the share of smooth ones."""
    o = px.select("doc_id", F.col("y").alias("oy"), F.col("x").alias("ox"), F.col(label).alias("o_label"), *(F.col(c).alias(f"o_{c}") for c in "rgb"))
    side = lambda dy, dx: px.join(by_shuffle(o.withColumn("y", F.col("oy") - dy).withColumn("x", F.col("ox") - dx)), ["doc_id", "y", "x"])
    both = side(0, 1).transform(united, side(1, 0)).filter(F.col(label) != F.col("o_label"))
    smooth = F.when(F.greatest(*(F.abs(F.col(c) - F.col(f"o_{c}")) for c in "rgb")) < limit, 1.0).otherwise(0.0)
    return both.groupBy("doc_id", F.least(label, "o_label").alias("lo"), F.greatest(label, "o_label").alias("hi")).agg(F.count(F.lit(1)).alias("contacts"), F.round(F.avg(smooth), 6).alias("smooth"))


def border_ratios(px: DataFrame, height: int, width: int, light: int = 220) -> DataFrame:
    """Shares of transparent and light border pixels; corners belong to a row and to a column."""
    n = F.when(F.col("y").isin(0, height - 1), 1).otherwise(0) + F.when(F.col("x").isin(0, width - 1), 1).otherwise(0)
    b = px.withColumn("n", n).filter("n > 0")
    ratio = lambda c: F.round(F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return b.groupBy("doc_id").agg(ratio(F.col("a") < 10).alias("transparent"), ratio(F.least("r", "g", "b") >= light).alias("light"))


def border_colors(px: DataFrame, height: int, width: int, most: int = 6, least: float = 0.01) -> DataFrame:
    """The most frequent border colours in steps of 8 levels, with the median of each."""
    b = px.filter(f"y IN (0, {height - 1}) OR x IN (0, {width - 1})")
    key = [F.floor(F.col(c) / 8).cast("int").alias(f"q_{c}") for c in "rgb"]
    per = b.groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("n"), *(F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in "rgb"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    by = Window.partitionBy("doc_id").orderBy(F.desc("n"), "q_r", "q_g", "q_b")
    return per.withColumn("share", F.round(F.col("n") / total, 6)).withColumn("place", F.row_number().over(by)).filter((F.col("place") <= most) & (F.col("share") >= least)).select("doc_id", "place", "n", "share", "m_r", "m_g", "m_b")


def border_background(px: DataFrame, height: int, width: int, light: int = 190, spread: int = 30, most: int = 6, near: int = 14) -> DataFrame:
    """Neutral light pixels within ``near`` of a frequent border colour: doc_id, y, x.

    Border colours are the light neutral ones in steps of 8 levels, corners counted for both of their
    edges: the ``most`` most frequent that hold one percent and two pixels, by their median colour.
    """
    plain = px.filter((F.least("r", "g", "b") >= light) & (F.greatest("r", "g", "b") - F.least("r", "g", "b") <= spread))
    edges = F.when(F.col("y").isin(0, height - 1), 1).otherwise(0) + F.when(F.col("x").isin(0, width - 1), 1).otherwise(0)
    key = [F.floor(F.col(c) / 8).cast("int").alias(f"q_{c}") for c in "rgb"]
    per = plain.withColumn("times", edges).filter("times > 0").groupBy("doc_id", *key).agg(F.sum("times").alias("n"), *(F.percentile(c, F.lit(0.5), F.col("times")).alias(f"m_{c}") for c in "rgb"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "q_r", "q_g", "q_b"))
    kept = per.withColumn("least", F.greatest(F.lit(2), F.floor(0.01 * total))).withColumn("place", place).filter((F.col("place") <= most) & (F.col("n") >= F.col("least")))
    tones = kept.groupBy("doc_id").agg(F.collect_list(F.struct("m_r", "m_g", "m_b")).alias("tones"))
    close = F.exists("tones", lambda t: F.greatest(*(F.abs(F.col(c) - t[f"m_{c}"]) for c in "rgb")) <= near)
    return plain.join(tones, "doc_id").filter(close).select("doc_id", "y", "x")


def paint_opacity(px: DataFrame) -> DataFrame:
    """75th percentile of alpha a colour; nearly opaque is opaque, nearly clear is left out."""
    a = F.percentile("a", F.lit(0.75)) / 255
    return px.groupBy(*COLOUR).agg(a.alias("o")).filter("o >= 0.02").select(*COLOUR, F.round(F.when(F.col("o") >= 0.985, 1.0).otherwise(F.col("o")), 6).alias("opacity"))


def plane_fit(px: DataFrame) -> DataFrame:
    """Least-squares planes r, g, b ~ 1 + x + y by sums and a closed 3x3 solution, for each
    document; null where the pixels span no plane."""
    s = lambda e: F.sum(F.expr(e).cast("double"))
    sums = px.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"), s("x").alias("x"), s("y").alias("y"), s("x * x").alias("xx"), s("x * y").alias("xy"), s("y * y").alias("yy"),
        *(s(c).alias(f"v_{c}") for c in "rgb"), *(s(f"x * {c}").alias(f"x_{c}") for c in "rgb"), *(s(f"y * {c}").alias(f"y_{c}") for c in "rgb"),
    )
    cxx, cxy, cyy = (F.expr(e) for e in ("xx - x * x / n", "xy - x * y / n", "yy - y * y / n"))
    det = cxx * cyy - cxy * cxy
    out = []
    for c in "rgb":
        ux, uy = F.expr(f"x_{c} - x * v_{c} / n"), F.expr(f"y_{c} - y * v_{c} / n")
        out += [F.round(F.when(det > 1e-9, (ux * cyy - uy * cxy) / det), 6).alias(f"slope_x_{c}"), F.round(F.when(det > 1e-9, (uy * cxx - ux * cxy) / det), 6).alias(f"slope_y_{c}")]
    return sums.select("doc_id", F.col("n").cast("long").alias("pixels"), *out)


def farthest_colors(pal: DataFrame, n: int, least: int = 48) -> DataFrame:
    """``n`` grid colours a document, each as far as can be (in the largest channel difference) from
    the palette and from those before it; the first of equals in grid order. Rows are missing when
    the distance falls below ``least``."""
    # The nine levels of a channel.
    levels = (3, 35, 67, 99, 131, 163, 195, 227, 251)
    tone = lambda d: F.element_at(F.array(*map(F.lit, levels)), (F.floor(F.col("place") / d) % 9 + 1).cast("int"))
    free = pal.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(len(levels) ** 3 - 1))).alias("place")).select("doc_id", "place", *(tone(d).alias(c) for c, d in zip("rgb", (81, 9, 1))))
    taken = pal.select("doc_id", *(F.round(F.col(c)).cast("int").alias(f"t_{c}") for c in "rgb"))
    gap = lambda: F.min(F.greatest(*(F.abs(F.col(c) - F.col(f"t_{c}")) for c in "rgb")))
    state = written(free.join(taken, "doc_id").groupBy("doc_id", "place", "r", "g", "b").agg(gap().alias("gap")))
    out = None
    for k in range(n):
        best = state.groupBy("doc_id").agg(F.max(F.struct("gap", (-F.col("place")).alias("np"), "r", "g", "b")).alias("m")).filter(F.col("m.gap") >= least)
        pick = written(best.select("doc_id", F.lit(k).alias("k"), "m.r", "m.g", "m.b", F.col("m.gap").alias("gap")))
        out = pick if out is None else out.transform(united, pick)
        t = pick.select("doc_id", *(F.col(c).alias(f"t_{c}") for c in "rgb"))
        near = F.greatest(*(F.abs(F.col(c) - F.col(f"t_{c}")) for c in "rgb"))
        state = written(state.join(t, "doc_id").select("doc_id", "place", "r", "g", "b", F.least("gap", near).alias("gap")).filter("gap > 0"))
    return out


def is_continuous_tone(mode: Column, colours: Column) -> Column:
    """Whether a chosen palette tells of continuous tone, so that work on lines a colour is left out."""
    return F.coalesce((mode == "adaptive") & (colours >= 12), F.lit(False))


def retain_accents(px: DataFrame, initial: DataFrame, pal: DataFrame, most: int = 2, gain: float = 8.0, area: int = 128, share: float = 0.002) -> DataFrame:
    """Colours of ``initial`` that ``pal`` lost and that win back coherent areas, at most ``most`` a
    document: ``doc_id, k, r, g, b, assigned_pixels, strong_pixels, mean_gain, total_gain``.

    A colour at 8 or more from the palette competes for the pixels; each goes to the colour of largest
    gain in error. Components of its pixels with ``area`` strong ones (gain of ``gain``) count, and
    together they need ``area`` and ``share`` of the visible pixels. Ranked by the gain of all strong
    pixels; a colour nearer than 8 to one taken before is left out.
    """
    hist = written(color_histogram(px))
    p = pal.select("doc_id", *(F.col(c).alias(f"p_{c}") for c in "rgb"))
    close = initial.join(p, "doc_id").filter(distance2("", "p_") < 64).select("doc_id", "k").distinct()
    lost = written(initial.join(close, ["doc_id", "k"], "left_anti").select("doc_id", "k", *(F.col(c).cast("double").alias(c) for c in "rgb")))
    now = nearest_label(hist, pal).select(*COLOUR, "w", F.sqrt("d2").alias("now"))
    won = nearest_label(hist, lost).select(*COLOUR, "k", F.sqrt("d2").alias("then"))
    best = written(now.join(won, COLOUR).select(*COLOUR, "w", "k", (F.col("now") - F.col("then")).alias("gain")).filter("gain > 0"))
    total = hist.groupBy("doc_id").agg(F.sum("w").alias("visible"))
    least = F.greatest(F.lit(area), F.ceil(F.lit(share) * F.col("visible")))
    strong = F.col("gain") >= gain
    rough = best.filter(strong).groupBy("doc_id", "k").agg(F.sum(F.col("gain") * F.col("w")).alias("rough"), F.sum("w").alias("n")).join(total, "doc_id").filter(F.col("n") >= least)
    rough = written(rough.select("doc_id", "k", "rough", "n", least.alias("least")))
    # Components of each colour's pixels: a document of their own.
    own = px.filter("a > 0").join(best.join(rough.select("doc_id", "k"), ["doc_id", "k"], "left_semi").drop("w"), COLOUR).select(F.struct("doc_id", "k").alias("doc_id"), "y", "x", "gain")
    own = written(own)
    runs = component_runs(own.select("doc_id", "y", "x"))
    held = own.join(runs, ["doc_id", "y"]).filter("x BETWEEN x0 AND x1")
    parts = held.groupBy("doc_id", "comp_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(strong).alias("strong"), F.sum("gain").alias("gain")).filter(F.col("strong") >= area)
    sums = parts.groupBy("doc_id.doc_id", "doc_id.k").agg(F.sum("pixels").alias("assigned_pixels"), F.sum("strong").alias("strong_pixels"), F.sum("gain").alias("total"))
    left = sums.join(rough, ["doc_id", "k"]).filter("strong_pixels >= least").join(lost, ["doc_id", "k"])
    left = written(left.select("doc_id", "k", "r", "g", "b", "assigned_pixels", "strong_pixels", F.round(F.col("total") / F.col("assigned_pixels"), 3).alias("mean_gain"), F.round("total", 3).alias("total_gain"), "rough", "n"))
    out = None
    for _ in range(most):
        first = Window.partitionBy("doc_id").orderBy(F.desc("rough"), F.desc("n"), F.desc("k"))
        pick = written(left.withColumn("at", F.row_number().over(first)).filter("at = 1").drop("at"))
        out = pick if out is None else out.transform(united, pick)
        t = pick.select("doc_id", *(F.col(c).alias(f"t_{c}") for c in "rgb"))
        left = written(left.join(t, "doc_id").filter(distance2("", "t_") >= 64).drop("t_r", "t_g", "t_b"))
    return out.drop("rough", "n")

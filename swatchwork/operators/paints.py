"""Paint roles: neutral and hue families of a document's colours, and their recolouring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.operators.palette import oklch
from swatchwork.runtime import by_shuffle, united, written


def with_oklch(inventory: DataFrame) -> DataFrame:
    """Colours (doc_id, paint, uses) with lightness, chroma and hue."""
    level = lambda k: F.conv(F.substring("paint", k, 2), 16, 10).cast("double")
    return inventory.filter(F.col("paint").rlike("^#[0-9a-f]{6}$")).withColumn("c", oklch(level(2), level(4), level(6))).select("doc_id", "paint", "uses", "c.*")


def oklch_to_hex(lightness: Column, chroma: Column, hue: Column, steps: int = 24) -> Column:
    """The colour as ``#rrggbb``; chroma outside the gamut is halved towards it by bisection."""

    def linear(c: Column) -> list[Column]:
        a, b = c * F.cos(F.radians(hue)), c * F.sin(F.radians(hue))
        # OKLab to cone roots, and cone response to linear sRGB.
        root = ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480))
        rgb = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
        cone = [F.pow(lightness + x * a + y * b, F.lit(3.0)) for x, y in root]
        return [sum(m * v for m, v in zip(row, cone)) for row in rgb]

    def fits(c: Column) -> Column:
        return F.forall(F.array(*linear(c)), lambda v: v.between(-1e-6, 1 + 1e-6))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        ok = fits(mid)
        return F.struct(F.when(ok, mid).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), chroma.cast("double").alias("hi")), halve, lambda s: s["lo"])
    tone = lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    byte = lambda v: F.lower(F.lpad(F.hex(F.round(255 * tone(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))).cast("int")), 2, "0"))
    return F.concat(F.lit("#"), *(byte(v) for v in linear(F.when(fits(chroma), chroma).otherwise(found))))


def hue_clusters(colours: DataFrame, limit: float = 42.0) -> DataFrame:
    """Chromatic colours of each document in hue families: in every round the pair of families with
    the smallest joint radius (largest distance of a member from the mean hue, at most ``limit``)
    becomes one, until no pair is near. All documents work in the same joins; a family is named by its smallest colour."""
    now = written(colours.filter("chroma >= 0.035").select("doc_id", "paint", "uses", "hue", F.col("paint").alias("family")))
    around = lambda a, b: F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)
    while True:  # each round takes one family of a document
        weight = F.col("uses").cast("double")
        g = now.groupBy("doc_id", "family").agg(F.sum(weight * F.sin(F.radians("hue"))).alias("s"), F.sum(weight * F.cos(F.radians("hue"))).alias("c"), F.collect_list("hue").alias("hues"))
        o = g.select("doc_id", *(F.col(x).alias(f"o_{x}") for x in ("family", "s", "c", "hues")))
        mean = F.pmod(F.degrees(F.atan2(F.col("s") + F.col("o_s"), F.col("c") + F.col("o_c"))), F.lit(360.0))
        pair = g.join(by_shuffle(o), "doc_id").filter("family < o_family").withColumn("mean", mean)
        radius = F.round(F.array_max(F.transform(F.concat("hues", "o_hues"), lambda h: around(h, F.col("mean")))), 9)
        best = written(pair.withColumn("radius", radius).filter(F.col("radius") <= limit).groupBy("doc_id").agg(F.min(F.struct("radius", "family", "o_family")).alias("m")).select("doc_id", F.col("m.family").alias("to"), F.col("m.o_family").alias("family")))
        if best.isEmpty():
            break
        now = written(now.join(by_shuffle(best), ["doc_id", "family"], "left").select("doc_id", "paint", "uses", "hue", F.coalesce("to", "family").alias("family")))
    return now.select("doc_id", "paint", "family")


def role_members(inventory: DataFrame) -> DataFrame:
    """Every colour with its role (see ``paint_roles``), the role's ``kind`` and anchors, and where the colour lies
    from them: ``lightness_delta``, ``chroma_ratio`` (0 without an anchor's chroma), and ``hue_delta`` in degrees
    from the weighted mean hue, 0 in neutral roles."""
    c = written(with_oklch(inventory))
    grey = c.filter("chroma < 0.035").withColumn("family", F.when(F.col("lightness") < 0.38, "neutral-dark").when(F.col("lightness") >= 0.94, "neutral-light").otherwise("neutral-mid"))
    hued = c.filter("chroma >= 0.035").join(by_shuffle(hue_clusters(c)), ["doc_id", "paint"])
    n = hued.groupBy("doc_id", "family").agg(F.sum("uses").alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "family"))
    named = hued.join(by_shuffle(n.select("doc_id", "family", F.concat(F.lit("accent-"), place.cast("string")).alias("role"))), ["doc_id", "family"]).drop("family")
    rows = grey.withColumnRenamed("family", "role").withColumn("kind", F.lit("neutral")).transform(united, named.withColumn("kind", F.lit("chromatic")))
    by = Window.partitionBy("doc_id", "role")
    anchor = lambda v: F.sum(F.col(v) * F.col("uses")).over(by) / F.sum("uses").over(by)
    pull = lambda f: F.sum(f(F.radians("hue")) * F.col("uses")).over(by)
    turn = F.pmod(F.col("hue") - F.pmod(F.degrees(F.atan2(pull(F.sin), pull(F.cos))), F.lit(360.0)) + 180, F.lit(360.0)) - 180
    return rows.select(
        "doc_id", "paint", "uses", "role", F.round(anchor("lightness"), 6).alias("anchor_lightness"), F.round(anchor("chroma"), 6).alias("anchor_chroma"), F.round(F.col("lightness") - anchor("lightness"), 6).alias("lightness_delta"),
        "kind", F.round(F.when(anchor("chroma") > 1e-7, F.col("chroma") / anchor("chroma")).otherwise(0.0), 6).alias("chroma_ratio"), F.when(F.col("kind") == "chromatic", F.round(turn, 3)).otherwise(0.0).alias("hue_delta"),
    )


def paint_roles(inventory: DataFrame) -> DataFrame:
    """Role of every colour: neutral dark, mid or light by lightness, else an accent numbered by
    use; with the role's anchor (weighted means) and the colour's distance from its lightness."""
    return role_members(inventory).select("doc_id", "paint", "uses", "role", "anchor_lightness", "anchor_chroma", "lightness_delta")


def role_mapping(members: DataFrame, lightness: float, chroma: float, hue: float, spread: float = 0.5) -> DataFrame:
    """New colours of all roles (of ``role_members``) for one target. Each keeps its distance in lightness, between
    0.03 and 0.99, and its part of the role's chroma; in chromatic roles also ``spread`` of its distance in hue. A
    target without chroma makes a role grey; a neutral role without chroma of its own takes the target's."""
    is_hued = F.col("kind") == "chromatic"
    level = F.greatest(F.lit(0.03), F.least(F.lit(0.99), F.lit(lightness) + F.col("lightness_delta")))
    ratio = F.when(is_hued | (F.col("anchor_chroma") > 1e-7), F.col("chroma_ratio")).otherwise(1.0)
    strength = F.when(is_hued & F.lit(chroma <= 1e-6), 0.0).otherwise(F.lit(chroma) * ratio)
    turned = F.when(is_hued, F.pmod(F.lit(hue) + spread * F.col("hue_delta"), F.lit(360.0))).otherwise(F.lit(hue))
    return members.select("doc_id", "paint", oklch_to_hex(level, strength, turned).alias("to_paint"))


def scaled_penalty(value: Column, free: float, severe: float, most: float) -> Column:
    """0 up to ``free``, ``most`` from ``severe`` on, in proportion between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - free) / (severe - free))) * most


def editability(complexity: DataFrame, structure: DataFrame) -> DataFrame:
    """Redraw burden and level of a document: the worst penalty of each family counts once.

    ``complexity``: of ``path_complexity``; ``structure``: of ``structure_counts``.
    """
    c = structure.join(complexity, "doc_id", "left").fillna(0, ["paths", "commands", "median", "p95", "largest", "largest_share"])
    col = F.col
    volume = F.greatest(scaled_penalty(col("paths"), 40, 300, 22), scaled_penalty(col("commands"), 500, 5000, 24))
    local = F.greatest(
        scaled_penalty(col("median"), 40, 150, 8), scaled_penalty(col("p95"), 120, 450, 10), scaled_penalty(col("largest"), 250, 800, 12), scaled_penalty(col("largest_share"), 0.45, 0.85, 6)
    )
    share = col("with_id") / col("elements")
    identity = F.when((col("elements") >= 20) & (col("with_id") == 0), 8.0).when((col("elements") >= 50) & (share < 0.1), 5.0).otherwise(0.0)
    burden = F.round(volume + local, 1)
    rows = c.select("doc_id", burden.alias("redraw_burden"), identity.alias("workflow_burden"), F.round(30 * F.least(F.lit(1.0), share / 0.8), 1).alias("identity_score"), "largest")
    ease = 100 - F.col("redraw_burden")
    level = F.when(ease >= 85, "low").when((ease >= 70) & (F.col("largest") < 500), "moderate").when(ease >= 50, "high").otherwise("very_high")
    return rows.select("doc_id", "redraw_burden", "workflow_burden", "identity_score", level.alias("level"))


def editability_audit(counts: DataFrame) -> DataFrame:
    """How well a document can be recoloured, selected and redrawn, in two separate figures, and whether
    it passes.

    ``counts``: doc_id and, where null is zero, drawables, with_id, grouped, with_role, roles, solid_paints,
    gradients, native, strokes, groups, color_layers, paths, nodes, controls, most_controls, median, p95,
    largest, largest_share, most_subpaths. ``readiness`` rewards handles (ids, groups, roles, native
    shapes, apart objects); the burdens take the worst penalty of each family once.
    """
    c = counts.fillna(0)
    col, n = F.col, F.greatest(F.col("drawables"), F.lit(1))
    upto = lambda part, full: F.least(F.lit(1.0), F.when(col("drawables") > 0, col(part) / n / full).otherwise(0.0))
    some = lambda name: F.when(col(name) > 0, 5.0).otherwise(0.0)
    worth = {
        "object_identity": 30 * upto("with_id", 0.8), "semantic_selection": 25 * upto("grouped", 0.4),
        "paint_roles": F.when(col("roles") > 0, 20 * upto("with_role", 0.8)).when((col("solid_paints") > 0) | (col("gradients") > 0), 8.0).otherwise(0.0),
        "native_edit_handles": some("native") + some("strokes") + some("gradients"),
        "object_isolation": 10.0 - F.when(col("largest") >= 500, 4.0).otherwise(0.0) - F.when(col("most_subpaths") > 20, 4.0).otherwise(0.0) - F.when(col("largest_share") > 0.45, 2.0).otherwise(0.0),
    }
    readiness = F.round(F.least(F.lit(100.0), sum(worth.values(), F.lit(0.0))), 1)
    pen = lambda name, *limits: scaled_penalty(col(name), *limits)
    volume = F.greatest(pen("paths", 40, 300, 22), pen("nodes", 500, 5000, 24), pen("controls", 500, 5000, 18))
    local = F.greatest(
        pen("median", 40, 150, 8), pen("p95", 120, 450, 10), pen("largest", 250, 800, 12), pen("most_controls", 100, 1200, 10), pen("most_subpaths", 20, 100, 6), pen("largest_share", 0.45, 0.85, 6)
    )
    nameless = F.when((col("drawables") >= 20) & (col("with_id") == 0), 8.0).when((col("drawables") >= 50) & (col("with_id") / n < 0.1), 5.0).otherwise(0.0)
    layers_only = (col("groups") > 0) & (col("color_layers") == col("groups"))
    workflow = pen("groups", 60, 180, 6) + nameless + F.when(layers_only, 10.0).otherwise(0.0)
    rows = c.withColumns({"readiness": readiness, "redraw_burden": F.round(volume + local, 1), "workflow_burden": F.round(workflow, 1), "layers_only": layers_only})
    outline = {"path_count_at_least_200": col("paths") >= 200, "node_count_at_least_4000": col("nodes") >= 4000, "one_path_at_least_500_commands": col("largest") >= 500, "one_path_at_least_50_subpaths": col("most_subpaths") >= 50}
    review = outline | {"twenty_plus_color_layers_without_semantic_groups": col("layers_only") & (col("groups") >= 20), "one_hundred_plus_objects_without_ids": (col("drawables") >= 100) & (col("with_id") == 0)}
    listed = lambda tests: F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())))
    ease = F.greatest(F.lit(0.0), 100 - col("redraw_burden"))
    both = F.greatest(F.lit(0.0), 100 - col("redraw_burden") - col("workflow_burden"))
    ok = (ease >= 75) & (both >= 75) & (col("readiness") >= 55) & (F.size(listed(review)) == 0)
    redraw = F.when((ease >= 85) & (F.size(listed(outline)) == 0), "low").when((ease >= 70) & (col("largest") < 500), "moderate").when(ease >= 50, "high").otherwise("very_high")
    steps = F.when(col("workflow_burden") == 0, "low").when(col("workflow_burden") <= 6, "moderate").when(col("workflow_burden") <= 15, "high").otherwise("very_high")
    ready = F.when(col("readiness") >= 80, "ready_for_common_operations").when(col("readiness") >= 55, "partially_ready").otherwise("limited")
    return rows.select(
        "doc_id", "readiness", ready.alias("readiness_status"), "redraw_burden", redraw.alias("redraw_level"), "workflow_burden", steps.alias("workflow_level"),
        F.array_join(listed(review), ",").alias("triggers"), F.when(ok, "accepted").otherwise("manual_review").alias("status"),
    )


def preblend_opacity(r: Column, g: Column, b: Column, opacity: Column, paper: tuple[int, int, int] = (255, 255, 255)) -> Column:
    """The opaque colour that looks like a translucent one on plain paper, rounded half to even."""
    mix = lambda c, p: F.lower(F.lpad(F.hex(F.bround(c * opacity + p * (1 - opacity)).cast("int")), 2, "0"))
    return F.concat(F.lit("#"), *(mix(c, p) for c, p in zip((r, g, b), paper)))


def paint_layers(layers: DataFrame, gradients: DataFrame) -> DataFrame:
    """Stack layers (doc_id, pos, name, value) as solids and gradients: ``doc_id, pos, name, type,
    value``, where a gradient's value is its id.

    ``gradients``: doc_id, pos, id, stops (array of offset and color). A gradient layer is shown by the
    colour of the gradient's middle stop; equal ones are dealt in order, and the first serves those
    that are left over. Layers of other colours get the gradients of no layer, in order.
    """
    middle = F.array_min(F.transform("stops", lambda s: F.struct(F.abs(s["offset"] - 0.5).alias("away"), s["offset"].alias("offset"), F.lower(s["color"]).alias("color"))))["color"]
    of = Window.partitionBy("doc_id", "value").orderBy("pos")
    named = gradients.withColumn("value", middle).select("doc_id", "pos", "id", "value").withColumn("nth", F.row_number().over(of))
    is_ramp = F.startswith(F.lower("name"), F.lit("gradient"))
    low = layers.select("doc_id", "pos", "name", F.lower("value").alias("value"))
    ramps = low.filter(is_ramp).withColumn("nth", F.row_number().over(of))
    exact = named.select("doc_id", "value", "nth", F.col("id").alias("own"))
    first = named.filter("nth = 1").select("doc_id", "value", F.col("id").alias("first"))
    dealt = written(ramps.join(exact, ["doc_id", "value", "nth"], "left").join(first, ["doc_id", "value"], "left").select("doc_id", "pos", "name", F.coalesce("own", "first").alias("id")))
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    free = gradients.join(dealt.select("doc_id", "id").dropna().distinct(), ["doc_id", "id"], "left_anti").select("doc_id", F.row_number().over(by_pos).alias("nth"), F.col("id").alias("other"))
    open_ = dealt.filter("id IS NULL").select("doc_id", "pos", F.row_number().over(by_pos).alias("nth")).join(free, ["doc_id", "nth"]).select("doc_id", "pos", "other")
    found = dealt.join(open_, ["doc_id", "pos"], "left").select("doc_id", "pos", "name", F.lit("linearGradient").alias("type"), F.coalesce("id", "other", F.lit("")).alias("value"))
    return low.filter(~is_ramp).select("doc_id", "pos", "name", F.lit("solid").alias("type"), "value").transform(united, found)


def paint_resources(layers: DataFrame, gradients: DataFrame, strokes: DataFrame) -> DataFrame:
    """Unique paints that a designer can recolour: ``doc_id, solid_paints, gradient_paints,
    unique_paints_total``. Solids are the colours of layers that are no gradients, and of strokes
    (doc_id, color); a gradient counts once however often it is used."""
    solid = layers.filter(~F.startswith(F.lower("name"), F.lit("gradient"))).select("doc_id", F.lower("value").alias("hex"))
    drawn = strokes.select("doc_id", F.lower("color").alias("hex")).filter(F.col("hex").rlike("^#[0-9a-f]{6}$"))
    docs = layers.select("doc_id").transform(united, gradients.select("doc_id")).transform(united, strokes.select("doc_id")).distinct()
    n_solid = solid.transform(united, drawn).groupBy("doc_id").agg(F.count_distinct("hex").alias("solid_paints"))
    n_ramp = gradients.groupBy("doc_id").agg(F.count(F.lit(1)).alias("gradient_paints"))
    both = docs.join(n_solid, "doc_id", "left").join(n_ramp, "doc_id", "left").na.fill(0)
    return both.select("doc_id", "solid_paints", "gradient_paints", (F.col("solid_paints") + F.col("gradient_paints")).alias("unique_paints_total"))

"""Column functions on presentation attributes, colours, lengths, path texts and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


#: Paints that are no colour of their own.
NO_PAINT = ("", "none", "transparent", "currentcolor", "context-fill", "context-stroke", "inherit", "initial", "unset")


def style_map(style: Column) -> Column:
    """Declarations of a style text by lower-case name; the last of equal names wins."""
    parts = F.filter(F.split(F.coalesce(style, F.lit("")), ";", -1), lambda d: F.contains(d, F.lit(":")))
    pairs = F.transform(parts, lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("k"), F.trim(F.substring(d, F.length(F.substring_index(d, ":", 1)) + 2, F.length(d))).alias("v")))
    last = F.filter(pairs, lambda p: p["k"] != "")
    names = F.array_distinct(F.transform(last, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(last, lambda p: p["k"] == n), F.lit(-1))["v"]))


def style_value(style: Column, name: str) -> Column:
    return F.try_element_at(style_map(style), F.lit(name))


def set_style(style: Column, name: str, value: Column) -> Column:
    """The style text with one declaration replaced in place, or added at the end."""
    parts = F.filter(F.transform(F.split(F.coalesce(style, F.lit("")), ";", -1), lambda d: F.trim(d)), lambda d: d != "")
    named = lambda d: F.lower(F.trim(F.substring_index(d, ":", 1))) == name
    new = F.concat(F.lit(f"{name}:"), value)
    swapped = F.transform(parts, lambda d: F.when(named(d), new).otherwise(d))
    return F.array_join(F.when(F.exists(parts, named), F.array_distinct(swapped)).otherwise(F.concat(parts, F.array(new))), ";")


def parse_color(text: Column) -> Column:
    """``#rgb``, ``#rgba``, ``#rrggbb``, ``#rrggbbaa``, ``rgb()`` and ``rgba()`` (numbers or
    percent), with or without ``!important``, as struct of hex and alpha; else null."""
    t = F.lower(F.trim(F.regexp_replace(text, "(?i)!important", "")))
    short = F.regexp_replace(t, "^#(.)(.)(.)(.?)$", "#$1$1$2$2$3$3$4$4")
    full = F.when(t.rlike("^#[0-9a-f]{3,4}$"), short).when(t.rlike("^#(?:[0-9a-f]{6}|[0-9a-f]{8})$"), t)
    alpha = F.when(F.length(full) == 9, F.round(F.conv(F.substring(full, 8, 2), 16, 10).cast("double") / 255, 4)).otherwise(1.0)
    call = r"^rgba?\(\s*([0-9.]+%?)[\s,]+([0-9.]+%?)[\s,]+([0-9.]+%?)(?:[\s,/]+([0-9.]+%?))?\s*\)$"
    part = lambda k: F.regexp_extract(t, call, k)
    level = lambda s: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(s.try_cast("double")).cast("int")))
    percent = lambda s: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(F.rtrim(s, F.lit("%")).try_cast("double") * 2.55).cast("int")))
    tone = lambda k: F.lower(F.lpad(F.hex(F.when(F.endswith(part(k), F.lit("%")), percent(part(k))).otherwise(level(part(k)))), 2, "0"))
    a = part(4)
    opacity = F.when(a == "", 1.0).when(F.endswith(a, F.lit("%")), F.rtrim(a, F.lit("%")).try_cast("double") / 100).otherwise(a.try_cast("double"))
    from_call = F.when(t.rlike(call), F.struct(F.concat(F.lit("#"), tone(1), tone(2), tone(3)).alias("hex"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), opacity)).alias("alpha")))
    return F.when(full.isNotNull(), F.struct(F.substring(full, 1, 7).alias("hex"), alpha.alias("alpha"))).otherwise(from_call)


def paint_profile(hexed: Column) -> Column:
    """neutral, chromatic, or unknown for what is no ``#rrggbb``."""
    level = lambda k: F.conv(F.substring(hexed, k, 2), 16, 10).cast("int")
    spread = F.greatest(level(2), level(4), level(6)) - F.least(level(2), level(4), level(6))
    return F.when(~F.coalesce(hexed.rlike("^#[0-9a-f]{6}$"), F.lit(False)), "unknown").when(spread <= 30, "neutral").otherwise("chromatic")


def effective_paint(fill: Column, stroke: Column) -> Column:
    """What an element shows: its stroke where it has one, else its fill (black by default)."""
    f, s = F.lower(F.trim(F.coalesce(fill, F.lit("#000000")))), F.lower(F.trim(F.coalesce(stroke, F.lit("none"))))
    return F.when(~s.isin("none", "transparent", ""), F.concat(F.lit("stroke:"), s)).when(~f.isin("none", "transparent", ""), F.concat(F.lit("fill:"), f)).otherwise("none")


def solid_paint(text: Column) -> Column:
    """The paint in lower case without white space, or null for keywords that paint nothing of their own
    and for references."""
    t = F.lower(F.regexp_replace(text, r"\s+", ""))
    return F.when(~t.isin(*NO_PAINT) & ~F.startswith(t, F.lit("url(")), t)


def visible_stroke(stroke: Column, width: Column) -> Column:
    """Whether a stroke paints: its paint is solid, and its width text is missing, no number or not zero."""
    first = F.regexp_extract(F.trim(width), r"^[-+]?(?:\d+(?:\.\d*)?|\.\d+)", 0).try_cast("double")
    return solid_paint(stroke).isNotNull() & (F.coalesce(first, F.lit(1.0)) != 0)


def parse_length(text: Column, scale: Column) -> Column:
    """A number, pixels or a percentage of ``scale``; null for anything else."""
    n = F.regexp_extract(F.trim(text), rf"^({NUMBER})\s*(px|%)?$", 1)
    value = F.when(n != "", n.try_cast("double"))
    return F.when(F.endswith(F.trim(text), F.lit("%")), value * scale / 100).otherwise(value)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1F]', "_")


def layer_words(label: Column) -> Column:
    """Lower-case words of a label without trailing digits."""
    parts = F.split(F.lower(F.regexp_replace(label, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+", -1)
    return F.filter(F.transform(parts, lambda w: F.regexp_replace(w, "[0-9]+$", "")), lambda w: w != "")


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def box_gap(a: str, b: str) -> Column:
    """Distance between two boxes given by column prefixes; 0 where they touch or overlap."""
    c = lambda p, n: F.col(f"{p}{n}")
    dx = F.greatest(c(a, "x0") - c(b, "x1"), c(b, "x0") - c(a, "x1"), F.lit(0.0))
    dy = F.greatest(c(a, "y0") - c(b, "y1"), c(b, "y0") - c(a, "y1"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def box_iou(a: str, b: str) -> Column:
    c = lambda p, n: F.col(f"{p}{n}")
    both = F.greatest(F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")), F.lit(0.0)) * F.greatest(F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")), F.lit(0.0))
    size = lambda p: box_area(c(p, "x0"), c(p, "y0"), c(p, "x1"), c(p, "y1"))
    total = size(a) + size(b) - both
    return F.when(total > 0, both / total).otherwise(0.0)


def format_color(hexed: Column, original: Column) -> Column:
    """``#rrggbb`` in the notation of ``original``: ``rgba()`` and ``rgb()`` stay calls, and the text of
    an alpha is kept as it was written."""
    t = F.trim(F.regexp_replace(original, "(?i)!important", ""))
    level = lambda k: F.conv(F.substring(hexed, k, 2), 16, 10)
    tones = F.concat_ws(",", level(2), level(4), level(6))
    alpha = F.regexp_extract(t, r"(?i)^rgba\([^,/]*[\s,]+[^,/]*[\s,]+[^,/]*[,/]\s*([0-9.]+%?)\s*\)$", 1)
    short = F.regexp_extract(t, "^#[0-9A-Fa-f]{3}([0-9A-Fa-f])$", 1)
    long = F.regexp_extract(t, "^#[0-9A-Fa-f]{6}([0-9A-Fa-f]{2})$", 1)
    call = F.when(alpha == "", "1").otherwise(alpha)
    return (
        F.when(t.rlike(r"(?i)^rgba\("), F.concat(F.lit("rgba("), tones, F.lit(","), call, F.lit(")")))
        .when(t.rlike(r"(?i)^rgb\("), F.concat(F.lit("rgb("), tones, F.lit(")"))).otherwise(F.concat(hexed, short, short, long))
    )


def viewbox_scale(box: dict[str, Column], view_box: Column, width: Column, height: Column) -> Column:
    """A pixel box (x0, y0, x1, y1) of a canvas in the units of a view box of two or four numbers, as
    struct; without a view box in pixels, and null for one of another size."""
    n = F.size(view_box)
    at = lambda k: F.get(view_box, F.lit(k)).cast("double")
    left = F.when(n == 4, at(0)).otherwise(0.0)
    top = F.when(n == 4, at(1)).otherwise(0.0)
    wide = F.when(n == 4, at(2)).when(n == 2, at(0)).otherwise(width.cast("double"))
    high = F.when(n == 4, at(3)).when(n == 2, at(1)).otherwise(height.cast("double"))
    x = lambda c: left + box[c] * wide / width
    y = lambda c: top + box[c] * high / height
    scaled = F.struct(x("x0").alias("x0"), y("y0").alias("y0"), x("x1").alias("x1"), y("y1").alias("y1"))
    return F.when(view_box.isNull() | n.isin(2, 4), scaled)


def is_stable_self_rotation(tag: Column, transform: Column, cx: Column, cy: Column) -> Column:
    """Whether an element is a circle whose only transform rotates it about its own centre."""
    call = rf"^\s*rotate\(\s*({NUMBER})[\s,]+({NUMBER})[\s,]+({NUMBER})\s*\)\s*$"
    part = lambda k: F.regexp_extract(transform, call, k).try_cast("double")
    near = 1e-5 * F.greatest(F.lit(1.0), F.abs(cx), F.abs(cy))
    return F.coalesce((tag == "circle") & (F.abs(part(2) - cx) <= near) & (F.abs(part(3) - cy) <= near), F.lit(False))

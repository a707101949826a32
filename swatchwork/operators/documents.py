"""Vector documents: path segments, paints, ids, signatures and structure counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.runtime import united, written

from swatchwork.functions.svg import NUMBER, solid_paint, style_map, style_value

#: Numbers that one repetition of a path command takes.
ARITY = {"m": 2, "l": 2, "h": 1, "v": 1, "c": 6, "s": 4, "q": 4, "t": 2, "a": 7, "z": 0}


def path_segments(paths: DataFrame) -> DataFrame:
    """One row a command repetition of a path text (doc_id, idx, d), in order, with its end point in
    absolute coordinates; a repeated move draws lines. Texts that break the grammar have one row
    with ``is_valid`` false."""
    return path_steps(paths).drop("n", "rel")


def path_steps(paths: DataFrame) -> DataFrame:
    """``path_segments`` with the numbers of each step as written (n) and whether they are relative."""
    cmds = F.regexp_extract_all("d", F.lit(rf"([a-zA-Z])((?:[\s,]*{NUMBER})*)"), F.lit(0))
    rest = F.regexp_replace(F.regexp_replace("d", rf"[a-zA-Z](?:[\s,]*{NUMBER})*", ""), r"[\s,]+", "")
    read = paths.select("doc_id", "idx", cmds.alias("cmds"), (rest == "").alias("clean"))
    one = read.select("doc_id", "idx", "clean", F.posexplode("cmds").alias("at", "c"))
    letter, nums = F.substring("c", 1, 1), F.transform(F.regexp_extract_all("c", F.lit(NUMBER), F.lit(0)), lambda n: n.cast("double"))
    arity = F.element_at(F.create_map(*(x for k, v in ARITY.items() for x in (F.lit(k), F.lit(v)))), F.lower("cmd"))
    one = one.withColumn("cmd", letter).withColumn("nums", nums).withColumn("arity", arity)
    fits = F.col("arity").isNotNull() & F.when(F.col("arity") == 0, F.size("nums") == 0).otherwise((F.size("nums") > 0) & (F.size("nums") % F.col("arity") == 0))
    ok = one.withColumn("fits", F.coalesce(fits, F.lit(False)) & F.col("clean") & ((F.col("at") > 0) | (F.lower("cmd") == "m")))
    valid = F.min("fits").over(Window.partitionBy("doc_id", "idx"))
    ok = ok.withColumn("is_valid", valid)
    bad = ok.filter("NOT is_valid AND at = 0").select("doc_id", "idx", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("cmd"), F.lit(0).alias("subpath"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("is_valid"), F.lit(None).cast("array<double>").alias("n"), F.lit(False).alias("rel"))
    reps = F.greatest(F.when(F.col("arity") > 0, (F.size("nums") / F.col("arity")).cast("int")).otherwise(1), F.lit(1))
    part = F.explode(F.transform(F.sequence(F.lit(0), reps - 1), lambda k: F.struct(k.alias("k"), F.slice("nums", k * F.col("arity") + 1, F.col("arity")).alias("n"))))
    seg = ok.filter("is_valid").select("doc_id", "idx", "at", "cmd", part.alias("p")).select("doc_id", "idx", "at", "p.k", "p.n", F.when((F.lower("cmd") == "m") & (F.col("p.k") > 0), F.when(F.col("cmd") == "m", "l").otherwise("L")).otherwise(F.col("cmd")).alias("cmd"))
    low = F.lower("cmd")
    end = F.when(low == "h", F.struct(F.get("n", F.lit(0)).alias("x"), F.lit(None).cast("double").alias("y"))).when(low == "v", F.struct(F.lit(None).cast("double").alias("x"), F.get("n", F.lit(0)).alias("y"))).when(low == "z", F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))).otherwise(F.struct(F.try_element_at("n", F.lit(-2)).alias("x"), F.try_element_at("n", F.lit(-1)).alias("y")))
    rel = F.col("cmd") == low
    rows = seg.select("doc_id", "idx", F.struct("at", "k", "cmd", rel.alias("rel"), end.alias("end"), "n").alias("s"))
    ordered = rows.groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list("s")).alias("ss"))
    # A path's running position depends on all before it: a fold over the commands of one element.
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), F.lit(-1).alias("sub"), F.array().cast("array<struct<cmd:string,subpath:int,x:double,y:double>>").alias("out"))

    def step(acc, s):
        base_x, base_y = F.when(s["rel"], acc["x"]).otherwise(0.0), F.when(s["rel"], acc["y"]).otherwise(0.0)
        is_z, is_m = F.lower(s["cmd"]) == "z", F.lower(s["cmd"]) == "m"
        x = F.when(is_z, acc["sx"]).when(s["end"]["x"].isNull(), acc["x"]).otherwise(base_x + s["end"]["x"])
        y = F.when(is_z, acc["sy"]).when(s["end"]["y"].isNull(), acc["y"]).otherwise(base_y + s["end"]["y"])
        sub = acc["sub"] + F.when(is_m, 1).otherwise(0)
        row = F.struct(F.upper(s["cmd"]).alias("cmd"), sub.alias("subpath"), x.alias("x"), y.alias("y"))
        return F.struct(x.alias("x"), y.alias("y"), F.when(is_m, x).otherwise(acc["sx"]).alias("sx"), F.when(is_m, y).otherwise(acc["sy"]).alias("sy"), sub.alias("sub"), F.concat(acc["out"], F.array(row)).alias("out"))

    walked = ordered.select("doc_id", "idx", "ss", F.aggregate("ss", zero, step, lambda a: a["out"]).alias("r"))
    good = walked.select("doc_id", "idx", F.posexplode(F.arrays_zip("ss", "r")).alias("seq", "z"))
    return good.select("doc_id", "idx", "seq", "z.r.cmd", "z.r.subpath", "z.r.x", "z.r.y", F.lit(True).alias("is_valid"), "z.ss.n", "z.ss.rel").transform(united, bad)


def path_complexity(segments: DataFrame) -> DataFrame:
    """Commands a path: median, nearest-rank 95th percentile, largest and its share of a document."""
    per = segments.filter("is_valid").groupBy("doc_id", "idx").agg(F.count(F.lit(1)).alias("n"), F.max("subpath").alias("last"))
    sizes = F.array_sort(F.collect_list("n"))
    return per.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("paths"), F.sum("n").alias("commands"), F.sum(F.col("last") + 1).alias("subpaths"), F.percentile("n", F.lit(0.5)).alias("median"),
        F.element_at(sizes, F.ceil(0.95 * F.count(F.lit(1))).cast("int")).alias("p95"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"),
    )


def subpath_boxes(segments: DataFrame) -> DataFrame:
    """Box of the end points of every sub-path."""
    return segments.filter("is_valid").groupBy("doc_id", "idx", "subpath").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("commands"))


def structure_counts(el: DataFrame) -> DataFrame:
    """Elements by kind, ids and distinct solid paints of every document."""
    kinds = ("path", "circle", "rect", "line", "polyline")
    return el.groupBy("doc_id").agg(F.count(F.lit(1)).alias("elements"), *(F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in kinds), F.count("id").alias("with_id"), F.count_distinct(solid_paint(F.col("fill"))).alias("fills"))


def paint_uses(el: DataFrame) -> DataFrame:
    """Each visible solid paint of an element, with where it is written and for what."""
    rows = el.select("doc_id", "idx", F.explode(F.array(
        F.struct(F.lit("attribute").alias("place"), F.lit("fill").alias("property"), solid_paint(F.col("fill")).alias("paint")),
        F.struct(F.lit("attribute").alias("place"), F.lit("stroke").alias("property"), solid_paint(F.col("stroke")).alias("paint")),
        F.struct(F.lit("style").alias("place"), F.lit("fill").alias("property"), solid_paint(style_value(F.col("style"), "fill")).alias("paint")),
    )).alias("u"))
    return rows.select("doc_id", "idx", "u.*").filter("paint IS NOT NULL")


def paint_inventory(el: DataFrame) -> DataFrame:
    """Uses of each colour in a document, in total and by place and property."""
    spots = ("attribute:fill", "attribute:stroke", "style:fill")
    u = paint_uses(el).withColumn("spot", F.concat_ws(":", "place", "property"))
    return u.groupBy("doc_id", "paint").agg(F.count(F.lit(1)).alias("uses"), *(F.count_if(F.col("spot") == s).alias(s.replace(":", "_")) for s in spots))


def apply_role_recolor(el: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewrite each matching paint (doc_id, paint, to_paint) and count the changes by property."""
    return paint_uses(el).join(mapping, ["doc_id", "paint"], "left").groupBy("doc_id", "property").agg(F.count(F.lit(1)).alias("uses"), F.count("to_paint").alias("changed"), F.count_distinct(F.coalesce("to_paint", "paint")).alias("colours_after"))


def stable_ids(el: DataFrame) -> DataFrame:
    """The id, or a hash of the element's content; repeated ones get a number in paint order."""
    name = F.coalesce("id", F.concat(F.lit("h"), F.substring(F.sha1(F.concat_ws("|", "tag", F.coalesce("fill", F.lit("")), F.coalesce("stroke", F.lit("")), "cx", "cy", "rad")), 1, 10)))
    named = el.select("doc_id", "idx", name.alias("name"))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "name"))
    place = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("idx"))
    return named.select("doc_id", "idx", F.when(n > 1, F.concat_ws("-", "name", place.cast("string"))).otherwise(F.col("name")).alias("stable_id"))


def stack_runs(el: DataFrame, key: str = "stroke") -> DataFrame:
    """Runs of neighbouring elements in paint order with the same paint."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    new = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)
    runs = el.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run", F.col(key).alias("paint")).agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))


def layer_names(runs: DataFrame) -> DataFrame:
    """Names in stack order: the paint, then the paint with a number."""
    place = F.row_number().over(Window.partitionBy("doc_id", "paint").orderBy("run"))
    return runs.select("doc_id", "run", F.concat("paint", F.when(place > 1, place.cast("string")).otherwise("")).alias("name"))


def duplicate_ids(el: DataFrame) -> DataFrame:
    return el.filter("id IS NOT NULL").groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def references(el: DataFrame) -> DataFrame:
    """Uses ``url(#id)`` of an element's paints (id_refs) that name no element of the document."""
    uses = el.select("doc_id", "idx", F.explode("id_refs").alias("ref"))
    return uses.join(el.select("doc_id", F.col("id").alias("ref")).filter("ref IS NOT NULL").distinct(), ["doc_id", "ref"], "left_anti")


def content_signature(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """SHA-256 of a group's rows, whatever their order."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256)
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ""), 256).alias("signature"))


#: Attributes and declarations that only colour an element.
PAINTS = ("fill", "stroke", "stop-color")


def structure_signature(elements: DataFrame, ignored_ids: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 of the structure of a scanned document (doc_id, idx, tag, attrs, is_valid): tags and
    attributes in document order, without paints, classes and role marks. A recolour keeps it; a moved
    point, another order or another tag changes it. ``metadata`` elements of ``ignored_ids`` don't
    count; a document that can't be read has no signature. Its elements meet as one file's rows."""
    attrs, style = F.col("attrs"), style_map(F.col("attrs")["style"])
    kept = F.array_join(F.transform(F.filter(F.map_entries(style), lambda e: ~e["key"].isin(*PAINTS)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")
    plain = F.filter(F.map_entries(attrs), lambda e: ~e["key"].isin("class", "style", *PAINTS) & ~F.startswith(e["key"], F.lit("data-paint-role-")))
    names = F.array_sort(F.concat(plain, F.when(kept != "", F.array(F.struct(F.lit("style").alias("key"), kept.alias("value")))).otherwise(F.slice(plain, 1, 0))))
    own = elements.filter("is_valid").filter(~((F.col("tag") == "metadata") & F.coalesce(attrs["id"].isin(*ignored_ids), F.lit(False)))) if ignored_ids else elements.filter("is_valid")
    rows = own.select("doc_id", "idx", F.to_json(F.struct("tag", names.alias("attrs"))).alias("row"))
    return rows.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "row"))), lambda r: r["row"]), "\n"), 256).alias("signature"))


def content_hash(docs: DataFrame) -> DataFrame:
    """Documents by the hash of their text with plain line ends: size of the class, smallest id."""
    h = F.sha2(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), 256)
    return docs.groupBy(h.alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


def blocklist_scan(files: DataFrame, terms: list[str]) -> DataFrame:
    """One row a text and blocked term it holds, with the number of uses."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = F.filter(F.array(*(F.struct(F.lit(t).alias("term"), ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int").alias("uses")) for t in terms)), lambda h: h["uses"] > 0)
    return files.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.term", "h.uses")


def blocked_suffixes(files: DataFrame, suffixes: tuple[str, ...], allowed: tuple[str, ...] = ()) -> DataFrame:
    """Files (file_id, path) by the suffix of their last name: is it blocked? Allowed paths never are; a
    name that only begins with a dot has no suffix, and a null path neither."""
    name = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))
    open_ = F.col("path").isin(*allowed) if allowed else F.lit(False)
    return files.select("file_id", suffix.alias("suffix"), (suffix.isin(*suffixes) & ~F.coalesce(open_, F.lit(False))).alias("blocked"))


#: Rules of unsafe markup, by name.
UNSAFE = {
    "doctype": r"(?i)<!DOCTYPE", "entity": r"(?i)<!ENTITY", "stylesheet": r"(?i)<\?xml-stylesheet", "tag": r"(?i)<\s*(?:script|iframe|object|embed|foreignObject)\b", "handler": r"(?i)\son[a-z]+\s*=",
    "javascript": r"(?i)javascript:", "data": r"(?i)\b(?:href|src)\s*=\s*[\"']data:", "external": r"(?i)\b(?:href|src)\s*=\s*[\"']https?:",
}


def unsafe_markup(pages: DataFrame) -> DataFrame:
    """One row a document and broken rule."""
    hits = F.filter(F.array(*(F.when(F.col("html").rlike(r), F.lit(n)) for n, r in UNSAFE.items())), lambda v: v.isNotNull())
    return pages.select("page_id", F.explode(hits).alias("rule"))


def plan_names(files: DataFrame) -> DataFrame:
    """Output names from (file_id, stem, ext), unique whatever the case: the stem where no other file
    has it, else with its ending, else numbered too. Where that meets a name given before, the number
    goes up until it is free; such rows are few, and each round joins only them with the names."""
    low, both = F.lower("stem"), F.lower(F.concat_ws("_", "stem", "ext"))
    alone = F.count(F.lit(1)).over(Window.partitionBy(low)) == 1
    pair = F.count(F.lit(1)).over(Window.partitionBy(both))
    place = F.row_number().over(Window.partitionBy(both).orderBy("file_id"))
    base, first = F.concat_ws("_", "stem", "ext"), (pair == 1) | (place == 1)
    number = F.when(~alone & ~first, place).cast("int")
    left = written(files.select("file_id", F.when(alone, F.col("stem")).otherwise(base).alias("base"), number.alias("n"), alone.alias("alone")))
    show = lambda: F.when(F.col("n").isNull(), F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string")))
    done = None
    while True:
        tried = left.withColumn("name", show()).withColumn("key", F.lower("name"))
        free = tried if done is None else tried.join(done.select("key"), "key", "left_anti")
        order = Window.partitionBy("key").orderBy(F.desc("alone"), F.col("n").isNotNull(), "n", "file_id")
        given = written(free.withColumn("at", F.row_number().over(order)).filter("at = 1").select("file_id", "name", "key"))
        done = given if done is None else done.transform(united, given)
        left = written(left.join(given.select("file_id"), "file_id", "left_anti").withColumn("n", F.coalesce(F.col("n"), F.lit(1)) + 1).withColumn("alone", F.lit(False)))
        if left.isEmpty():
            return done.select("file_id", "name")


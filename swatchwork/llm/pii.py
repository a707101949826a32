"""Personal data by candidate generation and gradient boosting, with DataFrame functions only.

Strict patterns with validity tests give the base spans, which always stay. Looser generators
propose further spans, which may overlap them. Each candidate is described by its format and its
context, not by the validity tests. Training positives are the candidates over base spans and, since
extras never overlap those, each base span once more with its text rewritten into a loose form;
negatives are the candidates that something speaks against: mails that cannot be an address, numbers that
fail the test of the only kind they could be, dates, amounts, bare digits, and words like order or page
before them. All others are no examples, so loose forms in number don't teach the model to leave
them. Equal descriptions are counted by Spark, boosted trees are fitted to that table (bounded by the
description's values, whatever the input), and become a column expression. Each generator has a
threshold of its own: the lowest score group that is itself precise enough and down to which
rewritten spans against negatives keep the wanted precision. The scores for this are those of five
models, each on the fifth of the documents that it was not fitted to, pooled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchwork.runtime import written

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns, written so that no position is tried twice: a run is entered at its
#: start (or where the last match ended) and repeats don't give characters back.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20.()-]{0,2}[0-9]){6,24}+(?![0-9A-Za-z])",
    "mail": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++",
}
SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
SOURCES = ("number", "mail")
#: An ending that an address can have.
_ENDING = "[A-Za-z]{2,24}$"


@dataclass(frozen=True)
class PiiParams:
    """``precision``: share of rewritten base spans among these and the negatives over the threshold.
    ``folds``: parts of the documents that are scored in turn by a model of the others. ``least``: weight of
    a split's side in rows, times 100."""

    trees: int = 30
    rate: float = 0.3
    depth: int = 2
    precision: float = 0.95
    least: int = 5
    folds: int = 5
    context: int = 24


def cut_at(text: Column, pattern: str, width: int) -> Column:
    """The text cut at its leftmost non-overlapping matches: for each match the code points before it
    (``gap``), their ``head`` and ``tail``, and its ``text``; a last element without text follows."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    piece = lambda part, m: F.struct(F.length(part).alias("gap"), F.left(part, F.lit(1)).alias("head"), F.right(part, F.lit(width)).alias("tail"), m.alias("text"))
    return F.zip_with(F.split(text, pattern, -1), found, piece)


CUT = "array<struct<gap:int,head:string,tail:string,text:string>>"


def running(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """For each item what ``join`` makes of the values before it, from 0 on.

    Arrays grow by copying, so the fold runs inside chunks that start with the total of those before
    them. ``items`` has to be a column as it stands, or it would be worked out for every chunk.
    """
    piece = lambda first: F.slice(items, first + 1, F.lit(chunk))
    firsts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(chunk))

    def fold(values: Column, start: Column, of: Callable[[Column], Column]) -> Column:
        step = lambda acc, x: F.struct(join(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    totals = F.transform(firsts, lambda first: F.aggregate(piece(first), F.lit(0), lambda at, x: join(at, value(x))))
    return F.flatten(F.zip_with(firsts, fold(totals, F.lit(0), lambda t: t), lambda first, start: fold(piece(first), start, value)))


def spans_of(cut: Column, at: Column, width: int) -> Column:
    """Matches with their places and what stands beside them; ``at`` has the code points before each
    element of ``cut``. The text before reaches back over one other match at most."""

    def of(i: Column) -> Column:
        here, after = F.get(cut, i), F.get(cut, i + 1)
        start = F.get(at, i) + here["gap"]
        before = F.right(F.concat(F.when(i > 0, F.get(cut, i - 1)["text"]).otherwise(""), here["tail"]), F.lit(width))
        follows = F.when(after["gap"] > 0, after["head"]).otherwise(F.coalesce(F.left(after["text"], F.lit(1)), F.lit("")))
        end = F.get(at, i) + here["gap"] + F.length(here["text"])
        return F.struct(start.alias("start"), end.alias("end"), here["text"].alias("text"), before.alias("before"), follows.alias("after"))

    return F.when(F.size(cut) > 1, F.transform(F.sequence(F.lit(0), F.size(cut) - 2), of)).otherwise(F.array().cast(SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.substring(part(x), 1, 3).cast("int") <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(13, 19) & luhn(_digits(m))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda s: valid(kind, s["text"])


def with_spans(rows: DataFrame, p: PiiParams) -> DataFrame:
    """Adds ``of_<name>`` for each kind and each loose source: the spans that pass, failing matches
    dropped without a retry, and all loose ones. Each step is a column of its own, so that patterns
    and places are worked out once a text."""
    text = F.col("text")
    gate = {
        "email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": F.contains(text, F.lit(".")), "card": text.rlike("[0-9]"),
        "number": text.rlike("[0-9]"), "mail": text.rlike(r"[\[(](?:at|AT)[\])]"),
    }
    every = PATTERNS | LOOSE
    old = rows.columns
    cut = rows.select(*old, *(F.when(gate[k], cut_at(text, v, p.context)).otherwise(F.array().cast(CUT)).alias(f"cut_{k}") for k, v in every.items()))
    size = lambda x: x["gap"] + F.coalesce(F.length(x["text"]), F.lit(0))
    placed = cut.select(*cut.columns, *(F.when(F.size(f"cut_{k}") > 1, running(F.col(f"cut_{k}"), size, lambda a, b: a + b)).otherwise(F.array().cast("array<int>")).alias(f"at_{k}") for k in every))
    spans = {k: spans_of(F.col(f"cut_{k}"), F.col(f"at_{k}"), p.context) for k in every}
    return placed.select(*old, *((F.filter(c, _passes(k)) if k in ("ip", "card", "phone") else c).alias(f"of_{k}") for k, c in spans.items()))


def _char_kind(c: Column) -> Column:
    """0 none or a line end, 1 blank, 2 letter or digit, 3 other."""
    return F.when((c == "") | (c == "\n"), 0).when(c == " ", 1).when(c.rlike(r"[\p{L}0-9]"), 2).otherwise(3)


#: Words before a number of another kind, and signs of money before or after it.
OTHER_NUMBERS = r"(?:order|invoice|part|item|article|page|version|isbn|issn|serial|stock|price|total|amount|sum|model|batch|volume|chapter|section|line|row|case|ticket|build|release|usd|eur|gbp|[$\u20ac\u00a3#])[\x20:.]{0,3}(?:(?:no|nr|number|id)[\x20:.]{0,3})?$"


def refuted(m: Column, near: Column, after: Column) -> Column:
    """What speaks against a loose number ``m`` as personal data; ``near`` is the lower-cased text before."""
    digits, groups = F.length(_digits(m)), F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)))
    date = m.rlike(r"^(?:[12][0-9]{3}[-./](?:0?[1-9]|1[0-2])[-./][0-3]?[0-9]|[0-3]?[0-9][-./](?:0?[1-9]|1[0-2])[-./][12][0-9]{3})(?:\x20[0-2]?[0-9].*)?$") | m.rlike(r"^(?:1[89]|20)[0-9]{2}\x20?-\x20?(?:1[89]|20)[0-9]{2}$")
    amount = m.rlike(r"^[0-9]{1,3}(?:[\x20.][0-9]{3})+$|^[0-9]+\.[0-9]+$") | after.isin("%", "\u20ac", "$")
    address = m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    size = (digits < 9) | (digits > 19) | (digits.between(13, 19) & ~luhn(_digits(m)) & ~m.rlike("^[+(]"))
    return date | amount | address | size | ((groups == 1) & ~m.rlike("^[+(]")) | near.rlike(OTHER_NUMBERS)


FEATURES = ("source", "digits", "groups", "opening", "marks", "before", "after", "hint")


def described(spans: Column, source: int) -> Column:
    """Candidates with small integers for format and context, and whether one outside the base spans
    counts as a negative (``never``)."""

    def of(s: Column) -> Column:
        m, near = s["text"], F.lower(s["before"])
        # In order of how much they speak for personal data, since trees split at a limit.
        hint = F.when(near.rlike(OTHER_NUMBERS), 0).when(near.rlike("tel|phone|call|fax"), 5).when(near.rlike("card|visa|pay"), 4).when(near.rlike("pass|secret|key|token"), 2).when(near.rlike("mail|contact"), 3).otherwise(1)
        marks = sum((F.when(F.contains(m, F.lit(c)), 1 << k).otherwise(0) for k, c in enumerate(" .-(")), F.lit(0))
        values = (
            F.lit(source), F.least(F.length(_digits(m)), F.lit(25)), F.least(F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))), F.lit(9)),
            F.when(m.startswith("+"), 1).when(m.startswith("("), 2).otherwise(0), marks, _char_kind(F.right(s["before"], F.lit(1))), _char_kind(s["after"]), hint,
        )
        never = ~m.rlike(_ENDING) if source else refuted(m, near, s["after"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), never.cast("int").alias("never"), *(v.cast("int").alias(n) for n, v in zip(FEATURES, values)))

    return F.transform(spans, of)


def _forms(kind: str, m: Column) -> list[Column]:
    """Loose ways to write a base span's text, which the contract's patterns don't take."""
    if kind == "email":
        at, dot = F.split(m, "@"), lambda host, by: F.regexp_replace(host, r"\.", by)
        return [F.concat(at[0], F.lit(a), dot(at[1], d)) for a, d in ((" [at] ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" (AT) ", " (DOT) "))]
    if kind == "phone":
        home = F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]*+(?=[0-9(])", "")  # as it is written in its own country
        joined = lambda by: F.array_join(F.regexp_extract_all(home, F.lit("[0-9]+"), F.lit(0)), by)
        abroad = [F.regexp_replace(m, r"^\+", ""), F.regexp_replace(m, r"^\+", "00"), F.regexp_replace(m, r"^\+([0-9]+)", "($1)")]
        return [*abroad, F.concat(F.lit("0"), home), home, joined("-"), joined("."), joined(" ")]
    if kind == "card":
        return [F.regexp_replace(_digits(m), "([0-9]{4})(?=[0-9])", f"$1{mark}") for mark in (".", "  ", " - ")]
    return [F.regexp_replace(m, r"\.", mark) for mark in (". ", " .")]


def rewritten(kind: str, spans: Column) -> Column:
    """Each span with its text in one of the loose forms, dealt by the text itself; those that the
    loose generator doesn't find whole are left out."""
    loose = LOOSE["mail" if kind == "email" else "number"]

    def of(s: Column) -> Column:
        forms = _forms(kind, s["text"])
        text = F.element_at(F.array(*forms), F.pmod(F.crc32(s["text"].cast("binary")), F.lit(len(forms))).cast("int") + 1)
        return s.withField("text", text)

    return F.filter(F.transform(spans, of), lambda s: s["text"].rlike(f"^(?:{loose})$"))


def _overlaps(s: Column, base: Column) -> Column:
    """Whether a span overlaps a base span. Those of one kind stand in order and apart, so the last one
    that starts before the span's end decides; it is found by halving, or by trying a few."""

    def of(spans: Column) -> Column:
        few = F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        middle = lambda acc: F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")

        def halve(acc: Column, _: Column) -> Column:
            before = F.get(spans, middle(acc))["start"] < s["end"]
            return F.struct(F.when(before, middle(acc) + 1).otherwise(acc["lo"]).alias("lo"), F.when(before, acc["hi"]).otherwise(middle(acc)).alias("hi"))

        rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
        last = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda acc: acc["lo"])
        return F.when(F.size(spans) <= 16, few).otherwise(F.coalesce(F.get(spans, last - 1)["end"] > s["start"], F.lit(False)))

    out = F.lit(False)
    for kind in KINDS:
        out = out | of(base[kind])
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int, least: float):
    """Nested (feature, limit, left, right), or a leaf's value: Newton steps of the log loss."""
    gs, hs = g[at].sum(), h[at].sum()
    leaf = float(-gs / (hs + 1.0))
    if not depth:
        return leaf
    best = (1e-9, 0, 0)
    for f in range(x.shape[1]):
        for limit in np.unique(x[at, f])[:-1]:
            left = at & (x[:, f] <= limit)
            gl, hl = g[left].sum(), h[left].sum()
            if min(hl, hs - hl) < least * 0.01:
                continue
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            if gain > best[0] + 1e-9:
                best = (gain, f, int(limit))
    if best[1:] == (0, 0) and best[0] <= 1e-9:
        return leaf
    _, f, limit = best
    left = x[:, f] <= limit
    return f, limit, _tree(x, g, h, at & left, depth - 1, least), _tree(x, g, h, at & ~left, depth - 1, least)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, limit, a, b = tree
    return np.where(x[:, f] <= limit, _value(a, x), _value(b, x))


def _column(tree, s: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, limit, a, b = tree
    return F.when(s[FEATURES[f]] <= limit, _column(a, s)).otherwise(_column(b, s))


@dataclass(frozen=True)
class PiiModel:
    """Base log odds, trees (already times the rate) and the chosen log-odds threshold of each
    source; infinite where none keeps the precision."""

    base: float
    trees: tuple
    rate: float
    thresholds: tuple[float, ...]

    def margin(self, s: Column) -> Column:
        return sum((F.lit(self.rate) * _column(t, s) for t in self.trees), F.lit(self.base))

    def chosen(self, s: Column) -> Column:
        """Whether the candidate reaches the threshold of its source."""
        z, over = self.margin(s), F.lit(False)
        for source, limit in enumerate(self.thresholds):
            over = over | ((s["source"] == source) & (z >= limit)) if np.isfinite(limit) else over
        return over


def _threshold(z: np.ndarray, forms: np.ndarray, negatives: np.ndarray, p: PiiParams) -> float:
    """The lowest group of equal scores that keeps the precision both alone and with all above it."""
    limit, z = float("inf"), np.round(z, 9)
    for z0 in sorted(set(z), reverse=True):
        at, over = z == z0, z >= z0
        keeps = lambda rows: forms[rows].sum() >= p.precision * (forms[rows].sum() + negatives[rows].sum())
        if forms[at].sum() and keeps(at) and keeps(over):
            limit = float(z0) - 1e-6
    return limit


def _fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray, use: np.ndarray, p: PiiParams) -> tuple[float, list]:
    """Base log odds and trees of the rows ``use``, with ``y`` positives of ``n``."""
    total, right = n[use].sum(), y[use].sum()
    # Half a row more on either side keeps the odds finite.
    base = float(np.log(max(right, 0.5) / max(total - right, 0.5)))
    z, trees, w = np.full(len(x), base), [], np.where(use, n, 0)
    for _ in range(p.trees if total else 0):
        q = 1 / (1 + np.exp(-z))
        g, h = np.where(use, n * q - y, 0), w * q * (1 - q)
        tree = _tree(x, g, h, use, p.depth, p.least)
        trees.append(tree)
        z = z + p.rate * _value(tree, x)
    return base, trees


def boost(counts: list, p: PiiParams) -> PiiModel:
    """Fit on description counts: rows with the features, fold, n_base, n_form and n_never."""
    none = PiiModel(0.0, (), p.rate, (float("inf"),) * len(SOURCES))
    counts = sorted((r for r in counts if r.n_base + r.n_form + r.n_never), key=lambda r: tuple(r))
    if not counts:
        return none
    x, fold = np.array([[r[f] for f in FEATURES] for r in counts], int), np.array([r.fold for r in counts])
    forms, negatives = np.array([r.n_form for r in counts], float), np.array([r.n_never for r in counts], float)
    pos = np.array([r.n_base for r in counts], float) + forms
    if not pos.sum():
        return none
    z = np.zeros(len(x))
    for k in range(p.folds):
        base, trees = _fitted(x, pos, pos + negatives, fold != k, p)
        z = np.where(fold == k, base + p.rate * sum((_value(t, x) for t in trees), np.zeros(len(x))), z)
    base, trees = _fitted(x, pos, pos + negatives, np.ones(len(x), bool), p)
    of = [x[:, FEATURES.index("source")] == k for k in range(len(SOURCES))]
    return PiiModel(base, tuple(trees), p.rate, tuple(_threshold(z[m], forms[m], negatives[m], p) for m in of))


def personal_data(docs: DataFrame, p: PiiParams = PiiParams(), keep_row: bool = False) -> DataFrame:
    """``doc_id, base, extra`` for every row of ``docs`` (doc_id, text, ...), and with ``keep_row``
    all its columns as ``row``: ``base`` has arrays of spans by kind, ``extra`` the spans that the
    model adds.

    Null texts have no spans. Repeated rows are treated alike; other columns are ignored.
    """
    carried = [F.struct(*docs.columns).alias("row")] if keep_row else []
    more = ["row"] if keep_row else []
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carried), p)
    loose = F.concat(described(F.col("of_number"), 0), described(F.col("of_mail"), 1))
    forms = F.concat(*(described(rewritten(k, F.col(f"of_{k}")), int(k == "email")) for k in KINDS))
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = written(rows.select("doc_id", *more, F.struct(*(bare(F.col(f"of_{k}")).alias(k) for k in KINDS)).alias("base"), loose.alias("loose"), forms.alias("forms")))
    base = F.col("base")
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(p.folds)), F.lit(0)).cast("int").alias("fold")
    label = lambda s, is_base, form: s.withField("n_base", is_base.cast("int")).withField("n_form", F.lit(form)).withField("n_never", F.when(is_base | F.lit(form == 1), 0).otherwise(s["never"]))
    told = F.concat(F.transform("loose", lambda s: label(s, _overlaps(s, base), 0)), F.transform("forms", lambda s: label(s, F.lit(False), 1)))
    told = found.select(fold, F.explode(told).alias("s")).select("fold", "s.*")
    # Bounded: the features are small integers.
    counts = told.groupBy("fold", *FEATURES).agg(*(F.sum(c).alias(c) for c in ("n_base", "n_form", "n_never"))).collect()
    model = boost(counts, p)
    kind = lambda s: F.when(s["source"] == 1, "email").when(s["digits"] >= 13, "card").when((s["groups"] == 4) & s["marks"].isin(2, 3), "ip").otherwise("phone")
    chosen = F.filter("loose", lambda s: model.chosen(s) & ~_overlaps(s, base))
    extra = F.transform(chosen, lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *more, "base", extra.alias("extra"))


def span_strings(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and the string of all spans."""
    show = lambda k, s: F.concat_ws(":", k, s["start"].cast("string"), s["end"].cast("string"))
    base = lambda k: F.transform(F.col("base")[k], lambda s: show(F.lit(k), s))
    pair = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    extra = lambda k: F.transform(F.filter("extra", lambda s: s["kind"] == k), pair)
    shown = lambda k: lambda s: show(F.lit(k), s)
    everything = [F.transform(F.array_sort(F.concat(F.col("base")[k], extra(k))), shown(k)) for k in KINDS]
    return found.select(
        "doc_id", *(F.size(F.col("base")[k]).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.concat(*(base(k) for k in KINDS)), ","), 256).alias("base_sha256"), F.array_join(F.concat(*everything), ",").alias("spans"),
    )


def redacted(rows: DataFrame, text: str, block: int = 4096) -> DataFrame:
    """``rows`` with ``new_text``: column ``text`` with its spans (``base``, ``extra``) replaced by their
    kind in brackets. Overlapping spans are replaced together, under the kind of the one that starts
    first (then the longest). A null text stays null.

    A substring is counted from the start of its string, so texts are cut into blocks first.
    """
    mark = lambda kind: lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), (s["kind"] if kind is None else F.lit(kind)).alias("kind"))
    marked = F.array_sort(F.concat(*(F.transform(F.col("base")[k], mark(k)) for k in KINDS), F.transform("extra", mark(None))))
    whole = F.col("_text")
    firsts = F.sequence(F.lit(0), F.greatest(F.length(whole) - 1, F.lit(0)), F.lit(block))
    cut = rows.select("*", F.expr(text).cast("string").alias("_text"), marked.alias("_marked"))
    cut = cut.select("*", F.when(F.size("_marked") > 0, F.transform(firsts, lambda at: F.substring(whole, at + 1, F.lit(block)))).alias("_blocks"), running(F.col("_marked"), lambda s: -s["last"], F.greatest).alias("_reach"))
    blocks, marked, reach = F.col("_blocks"), F.col("_marked"), F.col("_reach")
    at_block = lambda at: F.floor(at / block).cast("int")

    def piece(at: Column, size: Column) -> Column:
        held = F.array_join(F.slice(blocks, at_block(at) + 1, at_block(at + size) - at_block(at) + 1), "")
        return F.substring(held, at - at_block(at) * block + 1, size)

    def of(i: Column) -> Column:
        s, at = F.get(marked, i), F.get(reach, i)
        return F.when(s["start"] >= at, F.concat(piece(at, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    last = F.greatest(F.element_at(reach, -1), -F.element_at(marked, -1)["last"])
    new = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(marked) - 1), of), ""), piece(last, F.length(whole) - last))
    return cut.select(*rows.columns, F.when(F.size(marked) > 0, new).otherwise(whole).alias("new_text"))

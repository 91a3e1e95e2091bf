"""Personal data in texts: fixed rules, and boosted trees that judge the candidates of wider generators.

The fixed rules give the base spans: e-mail and IP addresses, payment cards that pass Luhn's test, international phone
numbers. The method adds spans that the rules miss because they are written otherwise (``name [at] host dot org``, ``10[.]0[.]0[.]7``, cards in
other groupings, phone numbers without a plus):

1. *Generators.* One wide pattern per kind proposes candidates; those of different kinds may overlap each other.
2. *Trees.* Boosted trees score each candidate from its kind, its format (digits, groups, separators, Luhn, parts of an address) and
   its context (what stands before and after, cue words).
3. *Thresholds.* Per kind, the lowest score from 0.5 on at which the part PRECISION of the candidates in a fold kept from the fit is right. Of
   overlapping candidates above it the best one stays; none replaces or overlaps a base span.

The trees learn from the whole corpus. From all texts come: base spans rewritten in the ways people
write around filters (positive, where the generator of the kind finds them), rewritten spans that break the rule of their kind, candidates of other
kinds at the same place, and all candidates that no rule confirms (negative). A candidate counts once for each text around it, so copies of
a document don't count again; equal features are one row with a weight, and bins are cut from all rows. Without positives or negatives
there is no model, and the base spans are all there is.

Every text is read whole, by functions of its own row: nothing is shuffled but features and base spans. Patterns run in linear time: possessive
runs that can only begin where a run begins, or where the last match ended. Places are code points.

Defined cases: a null or empty text has no spans; equal scores are resolved by kind, then by start; rows that repeat a ``doc_id`` and
rows without one are all returned; very long texts are read whole; other columns are ignored or kept; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from threatlake.llm.common import scratch, stored, text_of
from threatlake.operators.trees import margin, node_table, probability

KINDS = ["email", "ip", "card", "phone"]
TREES, DEPTH = 20, 4
PRECISION = 0.99
#: Least number of bins of a feature; slots that scores are counted in first.
BINS, SLOTS = 1024, 4096

#: Base rules. Each matches what its plain form does (``[0-9]+`` and so on), leftmost and without overlaps.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_AT = r"(?:\x20?@\x20?|\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?|\x20(?i:at)\x20)"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?:\.|(?i:dot))\x20?[\])}]\x20?|\x20(?i:dot)\x20)"
#: Wide patterns, one per kind. That of e-mail begins at the sign; the name before it has at most LOCAL characters.
WIDE = {
    "email": rf"{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}(?:(?:\x20?\.\x20?|,|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\(?\+\x20?|\(?00\x20?|\()?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9])",
}
LOCAL = 64
#: Stretches that hold every match of the numeric kinds whole; shorter ones than RUN_LENGTH hold none.
RUN, RUN_LENGTH = r"[0-9+(](?:[0-9+\x20()./_,\[\]{}-]++|(?i:dot))*+", 7
#: Words before a span that speak for its kind.
CUES = {
    "email": "mail|contact|write|reach|sender|inbox",
    "ip": "ip|addr|address|host|server|client|node|gateway",
    "card": "card|visa|master|amex|credit|debit|payment|iban",
    "phone": "phone|tel|call|mobile|cell|fax|sms|dial|hotline",
}
#: Code points kept around a span: the name of an address and the context behind it; the context that cue words are sought in.
BEFORE, AFTER, CONTEXT = 96, 12, 24
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column, block: int = 128) -> Column:
    """Running totals of an array, by blocks, so that a long array takes little more than its length."""

    def totals(xs: Column) -> Column:
        start = F.expr("CAST(array() AS array<int>)")
        return F.aggregate(xs, start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))

    def joined(blocks: Column) -> Column:
        bases = totals(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(bases, lambda base: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.get(base, i) - F.element_at(b, -1)))))

    def cut(xs: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))
        return let(F.transform(places, lambda i: totals(F.slice(xs, i * block + 1, block))), joined)

    return let(lengths, lambda xs: F.when(F.size(xs) > 0, cut(xs)).otherwise(xs))


def matches(text: Column, pattern: str, before: Column | None = None, after: Column | None = None) -> Column:
    """All matches of a pattern, leftmost and without overlaps, with their places in code points and what stands around them.
    ``before`` and ``after`` are what stands around the text itself."""
    edge = lambda x: F.lit("") if x is None else x
    both = F.struct(
        F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("inside"),
        edge(before).alias("before"), edge(after).alias("after"),
    )

    def placed(s: Column) -> Column:
        between, inside = s.getField("between"), s.getField("inside")
        lengths = F.transform(inside, lambda m, i: F.length(m) + F.length(F.get(between, i)))
        left = lambda i: F.concat(F.when(i == 0, s.getField("before")).otherwise(""), F.right(F.get(between, i), F.lit(BEFORE)))
        right = lambda i: F.concat(F.left(F.get(between, i + 1), F.lit(AFTER)), F.when(i + 1 == F.size(inside), s.getField("after")).otherwise(""))
        return let(running(lengths), lambda ends: F.transform(inside, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("value"),
            F.right(left(i), F.lit(BEFORE)).alias("before"), F.left(right(i), F.lit(AFTER)).alias("after"),
        )))

    return let(both, placed)


NOTHING = f"CAST(array() AS {SPAN})"


def runs(text: Column) -> Column:
    """The stretches of a text in which numeric spans lie."""
    return F.filter(matches(text, RUN), lambda r: F.length(r.getField("value")) >= RUN_LENGTH)


def _in_runs(numbers: Column, pattern: str) -> Column:
    def moved(r: Column) -> Column:
        value = r.getField("value")
        shift = lambda m: F.struct(
            (m.getField("start") + r.getField("start")).alias("start"), (m.getField("end") + r.getField("start")).alias("end"),
            *(m.getField(n).alias(n) for n in ("value", "before", "after")))
        inside = F.transform(matches(value, pattern, r.getField("before"), r.getField("after")), shift)
        return F.when(F.regexp_like(value, F.lit(pattern)), inside).otherwise(F.expr(NOTHING))

    return F.flatten(F.transform(numbers, moved))


def _addresses(text: Column) -> Column:
    """Wide matches of e-mail: the sign and the host, with the name that stands before them."""

    def named(m: Column) -> Column:
        local = F.regexp_extract(F.right(m.getField("before"), F.lit(LOCAL)), "[A-Za-z0-9._%+-]*$", 0)
        return let(local, lambda x: F.struct(
            (m.getField("start") - F.length(x)).alias("start"), m.getField("end").alias("end"), F.concat(x, m.getField("value")).alias("value"),
            F.left(m.getField("before"), F.length(m.getField("before")) - F.length(x)).alias("before"), m.getField("after").alias("after"), x.alias("name")))

    found = F.filter(F.transform(matches(text, WIDE["email"]), named), lambda m: m.getField("name") != "")
    return F.transform(found, lambda m: F.struct(*(m.getField(n).alias(n) for n in ("start", "end", "value", "before", "after"))))


# --- rules ------------------------------------------------------------------------------------------------------------


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's test of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of the base rule passes its test."""
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, numbers: Column, kind: str) -> Column:
    """Matches of a base rule that pass its test; ``numbers`` are the runs of the text."""
    if kind == "email":
        return F.when(F.contains(text, F.lit("@")), matches(text, BASE[kind])).otherwise(F.expr(NOTHING))
    return F.filter(_in_runs(numbers, BASE[kind]), lambda m: _holds(kind, m.getField("value")))


# --- features -----------------------------------------------------------------------------------------------------------


def _flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def features(kind: int, c: Column) -> Column:
    """Format and context of a candidate, as an array of numbers."""
    v, before, after = c.getField("value"), F.right(c.getField("before"), F.lit(CONTEXT)), c.getField("after")
    like = lambda x, p: _flag(F.regexp_like(x, F.lit(p)))
    digits, letters = _digits(v), F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
    groups = F.filter(F.split(v, "[^0-9A-Za-z]+"), lambda g: g != "")
    numbers = F.filter(F.split(v, "[^0-9]+"), lambda g: g != "")
    out = [
        F.lit(float(kind)), F.length(v), F.length(digits), letters, F.length(v) - F.length(digits) - letters,
        F.size(groups), F.length(F.element_at(groups, 1)), F.length(F.element_at(groups, -1)),
        let(digits, lambda d: _flag(F.length(d).between(13, 19) & luhn(d))),
        _flag((F.size(numbers) == 4) & F.forall(numbers, lambda g: F.regexp_like(g, F.lit(rf"^{_PART}$")))),
        like(v, r"\+"), like(v, r"^\(?00"), like(v, r"[\[({]"), like(v, "@"), like(v, r"(?i)[^a-z]at[^a-z]"), like(v, r"(?i)[^a-z]dot[^a-z]|\[\.\]|\(\.\)"),
        like(v, r"[^A-Za-z][A-Za-z]{2,6}$"), like(v, r"\x20"), like(v, r"[/_,]"), like(before, r"[\p{L}0-9]$"), like(after, r"^[\p{L}0-9]"),
        like(before, r"[.,/_-]$"), like(after, r"^[./_-][0-9A-Za-z]"), F.length(_digits(before)), F.length(_digits(after)),
        *(like(before, rf"(?i)(?<![a-z])(?:{words})s?\b") for words in CUES.values()),
    ]
    return F.array(*[x.cast("double") for x in out])


def candidates(text: Column, numbers: Column) -> Column:
    """``(kind, start, end, value, before, after, f)`` of all kinds."""
    names = ("start", "end", "value", "before", "after")

    def some(i: int, kind: str) -> Column:
        whole = lambda c: F.struct(F.lit(i).alias("kind"), *(c.getField(n).alias(n) for n in names), features(i, c).alias("f"))
        return F.transform(_addresses(text) if kind == "email" else _in_runs(numbers, WIDE[kind]), whole)

    return F.concat(*(some(i, kind) for i, kind in enumerate(KINDS)))


def _overlap(x: Column, y: Column) -> Column:
    return (x.getField("start") < y.getField("end")) & (y.getField("start") < x.getField("end"))


# --- fit ----------------------------------------------------------------------------------------------------------------


@dataclass
class SpanModel:
    """Nodes of the trees, and the threshold of each kind; without nodes nothing is added."""

    nodes: list = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, f: Column) -> Column:
        return probability(margin(self.nodes, lambda i: F.get(f, F.lit(i))))


def _rewritten(kind: str, value: Column) -> list[tuple[Column, int]]:
    """Other ways to write a span of this kind, and ways that break its rule."""
    digits = _digits(value)
    if kind == "email":
        put = lambda at, dot: F.regexp_replace(F.regexp_replace(value, r"\.(?=[^@]*$)", dot), "@", at)
        return [(put(a, d), 1) for a, d in ((" @ ", "."), ("[at]", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), (" (at) ", "."))]
    if kind == "ip":
        parts = F.split(value, r"\.")
        over = F.concat_ws(".", F.slice(parts, 1, 3), (256 + F.pmod(F.xxhash64(value), F.lit(700))).cast("string"))
        return [(F.array_join(parts, s), 1) for s in ("[.]", " . ", "(dot)", " [dot] ", " dot ")] + [(F.replace(over, F.lit("."), F.lit(s)), 0) for s in (".", "[.]", " . ")]
    if kind == "card":
        last = F.substring(digits, F.length(digits), F.lit(1)).cast("int")
        wrong = F.concat(F.left(digits, F.length(digits) - 1), ((last + 1 + F.pmod(F.xxhash64(value), F.lit(9))) % 10).cast("string"))
        put = lambda d, s: F.regexp_replace(d, r"([0-9]{4})(?=[0-9])", "$1" + s)
        return [(put(d, s), y) for d, y in ((digits, 1), (wrong, 0)) for s in (".", "/", "  ", "_")] + [(wrong, 0), (put(wrong, " "), 0)]
    plain = F.regexp_replace(value, r"^\+", "")
    return [(plain, 1), (F.concat(F.lit("00"), plain), 1), (F.concat(F.lit("(+"), F.regexp_replace(plain, r"^([0-9]+)", "$1)")), 1),
            (F.regexp_replace(value, r"[\x20.-]", "/"), 1), (F.regexp_replace(plain, r"[\x20()-]+", "."), 1), (digits, 0)]


def _rows(texts: DataFrame) -> DataFrame:
    """``f, label, kind, fold, n``: the candidates to learn from, and how many there are in different surroundings."""
    text, names = F.col("text"), ("value", "before", "after")

    def both(numbers: Column) -> Column:
        named = lambda k: F.transform(base_spans(text, numbers, k), lambda m: m.withField("kind", F.lit(k)))
        return F.struct(F.concat(*map(named, KINDS)).alias("base"), candidates(text, numbers).alias("found"))

    def narrow(x: Column) -> Column:
        base = x.getField("base")
        free = F.filter(x.getField("found"), lambda c: ~F.exists(base, lambda b: _overlap(b, c)))
        surrounded = lambda c: F.xxhash64(*(c.getField(n) for n in names)).alias("h")
        return F.struct(
            F.transform(base, lambda b: F.struct(*(b.getField(n).alias(n) for n in ("kind", *names)))).alias("base"),
            F.transform(free, lambda c: F.struct(c.getField("f").alias("f"), c.getField("kind").alias("kind"), surrounded(c))).alias("free"),
        )

    read = stored(texts.select(let(let(runs(text), both), narrow).alias("both")).select("both.*"), "learnt")
    out = read.select(F.explode("free").alias("c")).select("c.f", F.lit(0.0).alias("label"), "c.kind", F.col("c.h").alias("_h"))
    spans = stored(read.select(F.explode("base").alias("b")).select("b.*").distinct(), "base-spans")
    snippet = F.concat("before", "w.v", "after")
    for i, kind in enumerate(KINDS):
        ways = F.array(*[F.struct(v.alias("v"), F.lit(y).alias("y")) for v, y in _rewritten(kind, F.col("value"))])
        planted = spans.where(F.col("kind") == kind).select("before", "after", F.explode(ways).alias("w"))
        place = F.struct(F.length("before").alias("start"), (F.length("before") + F.length("w.v")).alias("end")).alias("at")
        planted = stored(planted.select(place, "w", let(snippet, lambda x: candidates(x, runs(x))).alias("found")), "planted")
        one = planted.select("at", "w", F.explode("found").alias("c")).where(_overlap(F.col("at"), F.col("c")))
        right = (F.col("c.kind") == i) & (F.col("w.y") == 1) & (F.col("c.start") == F.col("at.start")) & (F.col("c.end") == F.col("at.end"))
        out = out.union(one.select("c.f", right.cast("double"), "c.kind", F.xxhash64(*(f"c.{n}" for n in names))))
    fold = F.pmod("_h", F.lit(4)).alias("fold")
    return out.groupBy("kind", "label", "f", fold).agg(F.count_distinct("_h").cast("double").alias("n"))


def fit(docs: DataFrame) -> SpanModel:
    """The trees and thresholds, learnt from all texts of ``docs``."""
    with scratch(docs.sparkSession):
        return _fitted(docs.select(text_of().alias("text")).where("text <> ''"))


def _fitted(texts: DataFrame) -> SpanModel:
    rows = stored(_rows(texts).orderBy("kind", "label", "fold", "f"), "rows")
    learnt = rows.where("fold <> 0")
    if learnt.select("label").distinct().count() < 2:
        return SpanModel()
    data = learnt.select(array_to_vector("f").alias("features"), "label", "n")
    bins = max(BINS, isqrt(learnt.count()) + 1)  # with fewer, bins are drawn from a part of the rows
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, stepSize=0.2, seed=12, weightCol="n").fit(data)
    model = SpanModel(node_table(trees, texts.sparkSession).collect())
    found = {r.kind: r.least for r in thresholds(rows.where("fold = 0").select("kind", model.score(F.col("f")).alias("p"), "label", "n")).collect()}
    model.thresholds = {k: found.get(i, 2.0) for i, k in enumerate(KINDS)}  # above 1 where there is none
    return model


def thresholds(scored: DataFrame) -> DataFrame:
    """``kind, least``: the lowest score from 0.5 on at which PRECISION of the candidates ``(kind, p, label, n)`` are right. Running counts are
    those of a slot of scores, added to those of the slots above it."""
    points = scored.where("p >= 0.5").groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("seen"))
    points = stored(points.withColumn("slot", F.floor(F.col("p") * SLOTS)), "points")
    above = Window.partitionBy("kind").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = points.groupBy("kind", "slot").agg(F.sum("right").alias("right"), F.sum("seen").alias("seen"))
    slots = slots.select("kind", "slot", *(F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"_{c}") for c in ("right", "seen")))
    inside = Window.partitionBy("kind", "slot").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = points.select("kind", "slot", "p", *(F.sum(c).over(inside).alias(c) for c in ("right", "seen"))).join(slots, ["kind", "slot"])
    good = (F.col("right") + F.col("_right")) / (F.col("seen") + F.col("_seen")) >= PRECISION
    return points.where(good).groupBy("kind").agg(F.min("p").alias("least"))


# --- spans --------------------------------------------------------------------------------------------------------------


def spans(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with ``_base`` and ``_added``: arrays of ``(kind, start, end)``, kinds by number."""
    names = ("kind", "start", "end")
    none = F.expr("CAST(array() AS array<struct<kind:int,start:int,end:int>>)")

    def placed(text: Column, numbers: Column, i: int) -> Column:
        place = lambda m: F.struct(F.lit(i).alias("kind"), m.getField("start").alias("start"), m.getField("end").alias("end"))
        return F.transform(base_spans(text, numbers, KINDS[i]), place)

    def chosen(text: Column, numbers: Column, base: Column) -> Column:
        free = F.filter(candidates(text, numbers), lambda c: ~F.exists(base, lambda b: _overlap(b, c)))
        scored = F.transform(free, lambda c: F.struct((-model.score(c.getField("f"))).alias("p"), *(c.getField(n).alias(n) for n in names)))
        least = F.array(*[F.lit(float(model.thresholds[k])) for k in KINDS])
        good = F.array_sort(F.filter(scored, lambda c: -c.getField("p") >= F.get(least, c.getField("kind"))))
        return F.aggregate(good, none, lambda kept, c: F.when(F.exists(kept, lambda k: _overlap(k, c)), kept).otherwise(
            F.concat(kept, F.array(F.struct(*(c.getField(n).alias(n) for n in names))))))

    def both(text: Column, numbers: Column) -> Column:
        base = F.concat(*(placed(text, numbers, i) for i in range(len(KINDS))))
        return let(base, lambda b: F.struct(b.alias("base"), (chosen(text, numbers, b) if model.nodes else none).alias("added")))

    found = let(text_of(), lambda text: let(runs(text), lambda numbers: both(text, numbers)))
    return docs.withColumn("_spans", found).withColumns({"_base": F.col("_spans.base"), "_added": F.col("_spans.added")}).drop("_spans")


def written(found: Column) -> Column:
    """``kind:start:end`` of the spans by kind, then start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s.getField("kind")), s.getField("start").cast("string"), s.getField("end").cast("string"))
    return F.array_join(F.transform(F.array_sort(found), one), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; where spans overlap, the first covers what follows it."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    order = F.array_sort(F.transform(found, lambda s: F.struct(*(s.getField(n).alias(n) for n in ("start", "end", "kind")))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def put(state: Column, s: Column) -> Column:
        at, low = state.getField("at"), s.getField("start")
        piece = F.when(low >= at, F.concat(F.substring(text, at + 1, low - at), F.get(names, s.getField("kind")))).otherwise("")
        return F.struct(F.concat(state.getField("done"), piece).alias("done"), F.greatest(at, s.getField("end")).alias("at"))

    return F.aggregate(order, start, put, lambda state: F.concat(state.getField("done"), F.substring(text, state.getField("at") + 1, F.length(text))))


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced; null texts stay null."""
    model = fit(docs) if model is None else model
    clean = redacted(F.col("text"), F.concat("_base", "_added"))
    return spans(docs, model).withColumn("text", clean).drop("_base", "_added")


def personal_data(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row of ``docs``; the counts are of base spans."""
    model = fit(docs) if model is None else model
    found = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    number = lambda i: F.size(F.filter("_base", lambda s: s.getField("kind") == i)).cast("long")
    return found.select(
        "doc_id", *(number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
        written(F.concat("_base", "_added")).alias("spans"), F.size("_added").cast("long").alias("n_added"),
    )

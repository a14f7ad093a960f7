"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

Generators with high recall propose spans, which may overlap. The first four are fixed rules, whose passing
matches are always reported. The others (``contact``, ``number``) propose what the rules miss: addresses written
with "(at)", phone numbers without a plus sign. No span is labelled, so the trees learn from targets and decoys:

* targets are spans that a rule passes, with the mark that the rule goes by hidden: an address whatever stands for
  the "@", a phone number without its plus sign and country code;
* decoys are spans that are not personal, whatever they look like: the places of one target in ``DECOYS`` and of
  every plain numeral with a format drawn at random, and names joined like an address by another mark.

The proposals themselves have no label, so however many of them are personal, none counts against the others.
The whole corpus is aggregated to one row for each combination of features, a table bounded by the number of
combinations; boosted trees are fitted to it, a threshold for each generator is calibrated on the other half
of the documents, and the trees are then evaluated as expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Generators: (kind, pattern, text that must be there). The first four are the fixed rules' patterns, written so that
#: no run of characters is read twice: possessive, and begun only where a run begins or the last match ended.
GENERATORS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9](?:[\x20-]?[0-9]){12}"),  # shorter runs fail the rule, and so do their ends
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    ("contact", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[](?:at|AT)[)\]])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]++)++", r"@|[(\[](?:at|AT)[)\]]"),
    ("number", r"(?<![0-9])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{2,8}){1,4}(?![0-9])", r"[0-9]{2}"),
)
BASE, CONTACT, NUMBER = 4, 4, 5
#: Decoys: names joined like an address, but by another symbol or word, and numerals that stand alone.
JOINED = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20[#*=|/<>~^&]\x20|\x20?[(\[](?!at|AT)[A-Za-z]{2,3}[)\]]\x20?)[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]++)++",
          r"[(\[][A-Za-z]{2,3}[)\]]|\x20[#*=|/<>~^&]\x20")
NUMERAL = (r"(?<![\p{L}\p{N}.,+()@-])[0-9]{1,6}(?![\p{L}\p{N}.,()@-])", "[0-9]")
#: What is hidden of a phone number: the plus sign and a country code that stands apart.
PREFIX = r"^\+(?:[0-9]{1,3}[\x20.-]+)?(?=[(0-9])"
#: Characters of context before a span.
CONTEXT = 24
#: Matches whose places are summed at a time.
RUN = 128
#: Feature: number of values. Of the generators, only those beyond the rules have examples.
FEATURES = {"gen": len(GENERATORS), "digits": 6, "groups": 4, "separators": 4, "before": 4, "after": 3, "cue": 6}
CUES = ((1, "mail|contact|write"), (2, "call|tel|phone|mobile|fax"), (3, "card|visa|account|pay"),
        (4, r"\bip\b|host|server|address"), (5, r"\bid\b|ref|order|version|invoice|\bno\b"))
ROUNDS, DEPTH, RATE, PRECISION = 20, 3, 0.4, 0.95
#: One of so many targets' places also gets a decoy.
DECOYS = 4


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once even where ``body`` uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, gen: int, source: tuple[str, str] | None = None) -> Column:
    """Array of (gen, start, stop, match, context, after): leftmost matches that don't overlap, of the generator's pattern or of ``source``.

    What lies between matches is what ``split`` leaves, and gives their places: those
    within a run of matches first, then those of the runs, since one running sum over all
    would copy what it has for each match. ``context`` is what stands before a match, back to the start of the last
    match or ``CONTEXT`` characters; ``after`` is the character behind it. So the work is linear in the text.
    """
    pattern, must = source or GENERATORS[gen][1:]
    none = F.array().cast("array<struct<gen:int,start:int,stop:int,match:string,context:string,after:string>>")
    parts = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def pairs(own: Column) -> Column:
        gap = lambda i: F.get(own["gaps"], i)
        around = lambda i: F.coalesce(F.get(own["found"], i), F.lit(""))
        return F.transform(own["found"], lambda m, i: F.struct(
            gap(i).alias("gap"), m.alias("match"), F.right(F.concat(around(i - 1), gap(i)), F.lit(CONTEXT)).alias("context"),
            F.left(F.concat(gap(i + 1), around(i + 1)), F.lit(1)).alias("after")))

    def run_of(own: Column):
        return lambda i: F.aggregate(
            F.slice(own, i, RUN), F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    F.lit(gen).alias("gen"), (acc["at"] + F.length(p["gap"])).alias("start"),
                    (acc["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("stop"), p["match"].alias("match"),
                    p["context"].alias("context"), p["after"].alias("after")))).alias("out")))

    def placed(own: Column) -> Column:
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, run_of(own)), lambda local: let(
            F.aggregate(local, F.array(F.lit(0)), lambda acc, run: F.concat(acc, F.array(F.element_at(acc, -1) + run["at"]))),
            lambda ends: F.flatten(F.transform(local, lambda run, i: F.transform(run["out"], lambda c: F.struct(
                c["gen"].alias("gen"), (c["start"] + F.get(ends, i)).alias("start"), (c["stop"] + F.get(ends, i)).alias("stop"), c["match"].alias("match"),
                c["context"].alias("context"), c["after"].alias("after")))))))

    return F.when(text.rlike(must), let(let(parts, pairs), placed)).otherwise(none)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _passes(c: Column) -> Column:
    """Whether a match of one of the first four generators meets its rule."""
    digits = F.regexp_replace(c["match"], "[^0-9]", "")
    n = F.length(digits)
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    small = F.forall(F.split(c["match"], r"\."), lambda p: (F.length(part(p)) <= 3) & (F.expr("0") + F.substring(part(p), F.lit(1), F.lit(3)).try_cast("int") <= 255))
    return (F.when(c["gen"] == 0, True).when(c["gen"] == 1, small).when(c["gen"] == 2, F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
            .when(c["gen"] == 3, n.between(9, 15)).otherwise(False))


def _format(match: Column, gen: int) -> dict[str, Column]:
    """Features of how a span is written, the same whether its mark is there or hidden."""
    n = F.length(F.regexp_replace(match, "[^0-9]", ""))
    digits = F.when(n == 0, 0).when(n < 9, 1).when(n < 13, 2).when(n < 16, 3).when(n == 16, 4).otherwise(5)
    if gen == NUMBER:
        groups = F.size(F.split(match, "[^0-9]+"))
        marks = F.regexp_replace(match, "[A-Za-z0-9+]", "")
        return {"digits": digits, "groups": F.least(groups, F.lit(4)) - 1,
                "separators": F.when(marks == "", 0).when(marks.rlike(r"^[.]+$"), 1).when(marks.rlike(r"^[\x20-]+$"), 2).otherwise(3)}
    names = F.split(F.regexp_replace(match, r"\x20?[(\[](?:dot|DOT)[)\]]\x20?|\x20?\.\x20?", "."), r"\.")
    last = F.element_at(names, -1)
    return {"digits": F.least(digits, F.lit(2)), "groups": F.least(F.size(names), F.lit(5)) - 2,
            "separators": F.when(last.rlike("^[A-Za-z]{2,3}$"), 0).when(last.rlike("^[A-Za-z]{4,6}$"), 1).when(last.rlike("^[A-Za-z]+$"), 2).otherwise(3)}


def _drawn(*seed: Column) -> dict[str, Column]:
    """A format drawn from all formats alike, by a hash of ``seed``."""
    h, out = F.xxhash64(*seed), {}
    for name in ("digits", "groups", "separators"):
        out[name] = F.pmod(h, F.lit(FEATURES[name])).cast("int")
        h = F.shiftright(h, 16)
    return out


def _features(c: Column, gen: int, form: dict[str, Column], good: int | None = None) -> Column:
    """Struct of the features of a match: its format, what stands around it, and its label."""
    context, before, after = F.lower(c["context"]), F.right(c["context"], F.lit(1)), c["after"]
    cue = F.lit(0)
    for code, words in reversed(CUES):
        cue = F.when(context.rlike(words), code).otherwise(cue)
    return F.struct(
        F.lit(gen).alias("gen"), *(v.cast("int").alias(k) for k, v in form.items()),
        (F.when((before == "") | (before == "\n"), 0).when(before == " ", 1).when(before.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)).alias("before"),
        (F.when((after == "") | after.rlike(r"\s"), 0).when(after.rlike(r"[\p{L}\p{N}]"), 1).otherwise(2)).alias("after"),
        cue.alias("cue"), F.lit(good).cast("int").alias("good"), c["start"].alias("start"), c["stop"].alias("stop"))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, base, spans``: what the rules pass, and the other generators' proposals with their features."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_as(docs, text_col))
    text = F.col("text")
    base = F.filter(F.concat(*(_matches(text, g) for g in range(BASE))), _passes)
    return rows.select("doc_id", base.alias("base"), F.concat(*(_proposed(text, g) for g in (CONTACT, NUMBER))).alias("spans"))


def _proposed(text: Column, gen: int) -> Column:
    return F.transform(_matches(text, gen), lambda c: _features(c, gen, _format(c["match"], gen)))


def examples(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, spans``: targets (``good`` is 1) and decoys (0), with the features of a proposal in their place."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_as(docs, text_col))
    text, doc = F.col("text"), F.col("doc_id")
    bare = lambda c: F.regexp_replace(c["match"], PREFIX, "")
    addresses = F.filter(_matches(text, 0), _passes)
    phones = F.filter(_matches(text, 3), lambda c: _passes(c) & bare(c).rlike(f"^(?:{GENERATORS[NUMBER][1]})$"))
    both = [let(addresses, lambda own: _pairs(doc, own, CONTACT, lambda c: c["match"])),
            let(phones, lambda own: _pairs(doc, own, NUMBER, bare))]
    joined = F.transform(_matches(text, CONTACT, JOINED), lambda c: _features(c, CONTACT, _format(c["match"], CONTACT), 0))
    numerals = F.transform(_matches(text, NUMBER, NUMERAL), lambda c: _features(c, NUMBER, _drawn(doc, c["start"]), 0))
    return rows.select("doc_id", F.concat(*both, joined, numerals).alias("spans"))


def _pairs(doc: Column, own: Column, gen: int, shown) -> Column:
    """Each span as a target, as ``shown``, and one place in ``DECOYS`` with a drawn format as a decoy."""
    some = F.filter(own, lambda c: F.pmod(F.xxhash64(doc, c["start"], F.lit("place")), F.lit(DECOYS)) == 0)
    return F.concat(F.transform(own, lambda c: _features(c, gen, _format(shown(c), gen), 1)),
                    F.transform(some, lambda c: _features(c, gen, _drawn(doc, c["start"], F.lit("decoy")), 0)))


def text_as(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col], F.lit("")).alias("text")


class Boosted:
    """Boosted regression trees for the log odds of cells with counts."""

    def __init__(self, x: np.ndarray, good: np.ndarray, n: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
        self.start = float(np.log((good.sum() + 1) / (n.sum() - good.sum() + 1)))
        self.trees: list = []
        odds = np.full(len(n), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-odds))
            tree = self._grow(x, good - n * p, n * p * (1 - p) + 1e-6, np.arange(len(n)), depth, rate)
            self.trees.append(tree)
            odds += self._apply(tree, x)

    def _grow(self, x, gradient, weight, rows, depth, rate):
        leaf = float(rate * np.clip(gradient[rows].sum() / (weight[rows].sum() + 1), -4, 4))
        best = (1e-9, None)
        gain = lambda r: gradient[r].sum() ** 2 / (weight[r].sum() + 1)
        if depth:
            whole = gain(rows)
            for f in range(x.shape[1]):
                for v in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= v
                    best = max(best, (gain(rows[left]) + gain(rows[~left]) - whole, (f, int(v))), key=lambda b: b[0])
        if best[1] is None:
            return leaf
        f, v = best[1]
        left = x[rows, f] <= v
        return f, v, *(self._grow(x, gradient, weight, r, depth - 1, rate) for r in (rows[left], rows[~left]))

    def _apply(self, tree, x) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, v, a, b = tree
        return np.where(x[:, f] <= v, self._apply(a, x), self._apply(b, x))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._apply(t, x) for t in self.trees)

    def expression(self, c: Column) -> Column:
        names = list(FEATURES)

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, v, a, b = tree
            return F.when(c[names[f]] <= v, of(a)).otherwise(of(b))

        out = F.lit(self.start)
        for tree in self.trees:
            out = out + of(tree)
        return out


def fit(found: DataFrame, precision: float = PRECISION) -> tuple[Boosted | None, list[float]]:
    """Trees from the ``examples`` of one half of the documents, and for each generator the least log odds from
    which the targets reach ``precision`` among those of the other half, with one decoy more than there are;
    infinite if none do.

    The driver gets counts of at most ``2 * prod(FEATURES.values())`` combinations, whatever the corpus.
    """
    names = list(FEATURES)
    cells = (found.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), F.explode("spans").alias("s"))
             .groupBy("half", *(F.col(f"s.{k}").alias(k) for k in names))
             .agg(F.count("*").alias("n"), F.sum("s.good").alias("good")).collect())
    limits = [math.inf] * len(GENERATORS)
    halves = [sorted([*(r[k] for k in names), r["good"], r["n"]] for r in cells if r["half"] == h) for h in (0, 1)]
    if not halves[0]:
        return None, limits
    table = np.array(halves[0], float)
    model = Boosted(table[:, :-2], table[:, -2], table[:, -1])
    if halves[1]:
        other = np.array(halves[1], float)
        odds = model.odds(other[:, :-2])
        for g in range(len(GENERATORS)):
            own = other[:, 0] == g
            for limit in np.unique(odds[own]):
                over = own & (odds >= limit)
                if other[over, -2].sum() >= precision * (other[over, -1].sum() + 1):
                    limits[g] = float(limit)
                    break
    return model, limits


def _joined(kind, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat(kind(c), F.lit(":"), c["start"], F.lit(":"), c["stop"])), ",")


def _count(spans: str, gen: int) -> Column:
    """How many of the spans are of one generator. (PySpark hands a lambda's second parameter the position, so ``gen`` must not be one.)"""
    return F.size(F.filter(spans, lambda c: c["gen"] == gen)).cast("long")


def _below(places: Column, value: Column, n: Column) -> Column:
    """How many of the ``n`` sorted ``places`` are less than ``value``, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in range(24, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when((at + step <= n) & (F.get(places, at + step - 1) < value), step).otherwise(0))


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``: as many of them end by the span's start as begin before its end.

    Two searches in sorted places for each span, whatever the number of base spans."""
    def kept(starts: Column, stops: Column) -> Column:
        n = F.size(starts)
        return F.filter(spans, lambda c: _below(starts, c["stop"], n) == _below(stops, c["start"] + 1, n))

    starts = F.sort_array(F.transform(base, lambda b: b["start"]))
    stops = F.sort_array(F.transform(base, lambda b: b["stop"]))
    return let(F.struct(starts.alias("starts"), stops.alias("stops")), lambda at: kept(at["starts"], at["stops"]))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans``, a row for each of ``docs``.

    ``base`` lists the fixed rules' spans as ``kind:start:end`` (code points, end
    exclusive) by kind, then start; spans of different kinds may overlap. ``spans`` adds the proposals that the trees
    accept and that no base span overlaps: ``contact``, then ``number``; equal odds are treated alike. A match that fails
    its fixed rule is not personal and is never added. Null and
    empty texts have none; repeated rows and null ids stay rows of their own; an empty table gives no rows. Other columns are ignored.
    Nothing is added where the corpus holds too few spans of a rule to learn from (under 20 in half of the documents).

    Each row is handled alone; only counts of feature combinations are shuffled.
    """
    found = candidates(docs, id_col, text_col)
    model, limits = fit(examples(docs, id_col, text_col), precision)
    none = F.filter("spans", lambda c: F.lit(False))
    if model is None or min(limits) == math.inf:
        extra = none
    else:
        limit = lambda c: F.element_at(F.array(*map(F.lit, limits)), c["gen"] + 1)
        extra = _apart(F.filter("spans", lambda c: model.expression(c) >= limit(c)), F.col("base"))
    rows = found.withColumn("extra", F.when(F.size("spans") > 0, extra).otherwise(none))
    kinds = F.array(*(F.lit(k) for k, _, _ in GENERATORS))
    named = lambda c: F.element_at(kinds, c["gen"] + 1)
    base, more = _joined(named, F.col("base")), _joined(named, F.col("extra"))
    counts = [_count("base", g).alias(f"n_{k}") for g, (k, _, _) in enumerate(GENERATORS[:BASE])]
    return rows.select("doc_id", *counts, base.alias("base"), F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(more, F.lit(""))).alias("spans"))

"""Personal data: generated candidates, boosted trees, calibrated thresholds. DataFrame functions alone touch the texts.

Base spans are regular expression matches of four kinds that pass a check (address parts, Luhn digits, numbers of digits).
Wider generators propose further, overlapping spans: anything around an @ or its spelled forms, runs of digits and separators,
and parts of such runs (formatted phones, solid digits, groups of four, dotted numbers). Each proposal has small integer
features of its format and its context. The labels of the fit are not the base rules': each base span of all documents
is rewritten within its context into forms that the base misses
(see `_variants`: @ and dots spelled or set apart, no plus sign or country, other separators, next to foreign digits). The
span of such a form is right; every other proposal there, and every proposal of the whole documents that meets no base span,
is wrong. For each kind, gradient-boosted trees of depth 2 learn from counts of feature rows of all documents. The threshold is
set where the selected are right PRECISION of the time, over all documents: each half of them is scored by trees of the other
half. Feature rows are small integers with a most, so their distinct ones, which the driver counts, are few. The trees become Spark
expressions. Proposals above the threshold of their best kind are added where they meet no base span; of a chain that
overlaps, swept from the left, the better one stays.

Arrays are swept in chunks with a carried state, and texts are cut by byte, so the time for a text follows its length and its
number of spans.

Defined results: a null or empty text has no spans; repeated rows give a row each and equal texts equal spans; very long
texts and runs are matched whole, without recursion; of equally good spans the earlier, then the longer stays; without base
spans of a kind nothing of that kind is added; an empty table gives no rows; ids are carried, never read; other columns
stay in `with_spans`, but for base and spans, which are replaced, and are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive loops and starts bound to the start of a run (or the last match's end) match the same as
#: plain ones: a later start in a run that failed, or that a match could have taken in, cannot be the leftmost.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
WIDE = {
    "mail": _LOCAL + r"\x20?@\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "marked": _LOCAL + r"\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "spelled": _LOCAL + r"\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++",
    "run": r"[+(]?+[0-9](?:[\x20().-]{0,2}+[0-9])++",
    "groups": r"(?:\G|(?<![0-9]))[0-9]++(?:[.-][0-9]++)++",
    "dotted": r"(?<![0-9])[0-9]{1,3}+(?:\x20?\[?\.\]?\x20?[0-9]{1,3}+){3}(?![0-9])",
    "called": r"(?:\+|(?<![0-9+]))[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}(?![0-9])",
    "local": r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])",
    "solid": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    "quads": r"(?<![0-9])[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])",
}
#: What a text must hold one of for a pattern to be tried; a digit where none is named.
GUARD = {"email": ("@",), "mail": ("@",), "phone": ("+",), "marked": ("[at]", "(at)"), "spelled": (" dot ",)}
CONTEXT, CHUNKS = 24, (1 << 16, 1 << 10, 1 << 5)
#: Words before a span that tell of phones, cards and networks.
HINTS = (r"(?i)\b(tel|phone|call|fax|mobile|handy|cell)\b", r"(?i)\b(card|visa|amex|mastercard|account|konto|iban)\b", r"(?i)\b(ip|host|server|address|addr|mail|email)\b", r"(?i)(token|key|secret|hash|id)\W*$")
ROUNDS, RATE, LEAST_WEIGHT, PRECISION = 16, 0.4, 5.0, 0.98
FEATURES = ("digits", "groups", "longest", "first", "last", "plus", "parens", "dots", "dashes", "blanks", "brackets", "ats", "luhn", "octets", "before", "after", "hint", "generator")

_MATCH = "struct<start:int,end:int,from:int,to:int,value:string,before:string,after:string>"
_SPAN = "struct<kind:int,start:int,end:int,from:int,to:int>"
_PROPOSAL = "struct<start:int,end:int,from:int,to:int,f:array<int>>"
_SWEPT = "struct<start:int,end:int,given:boolean,p:struct<from:int,to:int,f:array<int>>>"
_PENDING = "struct<start:int,end:int,from:int,to:int,margin:double,kind:int>"
_LAST = (1 << 31) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A long for each element: `step` gives the next state and the element's output.

    Each step of an aggregation copies its whole state, so the elements are swept in slices of slices (CHUNKS), and outputs are
    longs: the work grows with the number of elements, not with its square.
    """

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["s"], x)
        return F.struct(after.alias("s"), F.array_append(acc["o"], out.cast("long")).alias("o"))

    def level(held: Column, begin: Column, widths: tuple[int, ...]) -> Column:
        if not widths:
            return F.aggregate(held, F.struct(begin.alias("s"), _none("long").alias("o")), one)
        last = F.floor((F.greatest(F.size(held), F.lit(1)) - 1) / widths[0]).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(held, c * widths[0] + 1, F.lit(widths[0])))
        after = lambda acc: (lambda i: F.struct(i["s"].alias("s"), F.array_append(acc["o"], i["o"]).alias("o")))
        many = lambda acc, chunk: _let(level(chunk, acc["s"], widths[1:]), after(acc))
        return F.aggregate(chunks, F.struct(begin.alias("s"), _none("array<long>").alias("o")), many, lambda acc: F.struct(acc["s"].alias("s"), F.flatten(acc["o"]).alias("o")))

    return _let(items, lambda held: level(held, state, CHUNKS)["o"])


def _length(text: Column) -> Column:
    """Code points and bytes as one number: sums of such numbers hold both sums."""
    return F.coalesce(F.char_length(text).cast("long") * (1 << 32) + F.octet_length(text), F.lit(0).cast("long"))


def _tried(text: Column, patterns: dict[str, str]) -> Column:
    """(i, pattern) of the patterns whose guard the text holds."""
    digit = text.rlike("[0-9]")

    def there(name: str) -> Column:
        words = [F.contains(text, F.lit(word)) for word in GUARD.get(name, ())]
        return reduce(Column.__or__, words) if words else digit

    options = [F.struct(F.lit(i).alias("i"), F.lit(pattern).alias("pattern"), there(name).alias("there")) for i, (name, pattern) in enumerate(patterns.items())]
    return F.filter(F.array(*options), lambda g: g["there"])


def matches(text: Column, pattern: Column) -> Column:
    """Matches in order with their places in code points and bytes, and what is around them.

    What lies between matches and the matches themselves add up to the places.
    """
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    points, octets = lambda n: F.shiftright(n, 32).cast("int"), lambda n: (n % (1 << 32)).cast("int")

    def found(x: Column) -> Column:
        end = x["at"] + _length(x["hit"])
        return F.struct(points(x["at"]).alias("start"), points(end).alias("end"), octets(x["at"]).alias("from"), octets(end).alias("to"), x["hit"].alias("value"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(CONTEXT)).alias("after"))

    def placed(pairs: Column) -> Column:
        at = _scan(pairs, F.lit(0).cast("long"), lambda at, x: (at + _length(x["gap"]) + _length(x["hit"]), at + _length(x["gap"])))
        joined = F.transform(F.arrays_zip(pairs.alias("x"), at.alias("at")), lambda z: F.struct(z["at"].alias("at"), z["x"]["gap"].alias("gap"), z["x"]["hit"].alias("hit"), z["x"]["next"].alias("next")))
        return F.transform(F.filter(joined, lambda x: x["hit"].isNotNull()), found).cast(f"array<{_MATCH}>")

    def cut(gaps: Column) -> Column:
        pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))).alias("next"))
        return F.when(F.size(gaps) > 1, _let(pairs, placed)).otherwise(_none(_MATCH))

    return _let(F.split(text, pattern, -1), cut)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _card_digits(digits: Column) -> Column:
    return F.when(F.char_length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _octets(parts: Column) -> Column:
    return F.forall(parts, lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))


def _passes(kind: Column, value: Column) -> Column:
    return F.when(kind == 1, _octets(F.split(value, r"\."))).when(kind == 2, _card_digits(_digits(value))).when(kind == 3, F.char_length(_digits(value)).between(9, 15)).otherwise(True)


def _base_matches(text: Column) -> Column:
    """(kind, m) of the checked matches of all kinds."""

    def of(g: Column) -> Column:
        hits = F.filter(matches(text, g["pattern"]), lambda x: _passes(g["i"], x["value"]))
        return F.transform(hits, lambda x: F.struct(g["i"].alias("kind"), x.alias("m")))

    return F.flatten(F.transform(_tried(text, BASE), of))


def base_spans(text: Column) -> Column:
    """Checked matches of all kinds: structs of kind (its place in KINDS), start and end, and from and to in bytes."""
    return F.transform(_base_matches(text), lambda x: F.struct(x["kind"].alias("kind"), *[x["m"][c].alias(c) for c in ("start", "end", "from", "to")])).cast(f"array<{_SPAN}>")


def _count(value: Column, char: str) -> Column:
    return F.char_length(value) - F.char_length(F.replace(value, F.lit(char), F.lit("")))


def _side(char: Column) -> Column:
    return F.when(char.isNull() | char.rlike(r"\A[\s]?\z"), 0).when(char.rlike("[A-Za-z]|[^\x00-\x7f]"), 1).when(char.rlike(r"""["'=:]"""), 2).when(char.rlike("[0-9+@-]"), 4).otherwise(3)


def _features(x: Column, generator: Column) -> Column:
    value = x["value"]
    cap = lambda c, most: F.least(F.coalesce(c, F.lit(0)), F.lit(most)).cast("int")
    hint = F.lit(0)
    for i, pattern in reversed(list(enumerate(HINTS, 1))):
        hint = F.when(x["before"].rlike(pattern), i).otherwise(hint)
    ats = F.when(F.contains(value, F.lit("@")), 1).when(value.rlike(r"[\[(]at[\])]"), 2).when(F.contains(value, F.lit(" at ")), 3).otherwise(0)
    marks = [F.startswith(value, F.lit("+")), cap(_count(value, "("), 2), cap(_count(value, "."), 4), cap(_count(value, "-"), 4), cap(_count(value, " "), 4), cap(_count(value, "["), 4), ats]
    around = [_side(F.right(x["before"], F.lit(1))), _side(F.left(x["after"], F.lit(1))), hint, generator]

    def numbers(g: Column) -> Column:
        sizes, digits = F.transform(g, F.char_length), F.array_join(g, "")
        first = [cap(F.char_length(digits), 24), cap(F.size(g), 8), cap(F.array_max(sizes), 20), cap(F.char_length(F.get(g, F.lit(0))), 8), cap(F.char_length(F.try_element_at(g, F.lit(-1))), 8)]
        values = [*first, *marks, _let(digits, _card_digits), (F.size(g) == 4) & _octets(g), *around]
        return F.array(*[v.cast("int") for v in values])

    return _let(F.filter(F.split(value, "[^0-9]+"), lambda g: g != ""), numbers)


def proposals(text: Column) -> Column:
    """Spans of all generators with their features."""

    def of(g: Column) -> Column:
        return F.transform(matches(text, g["pattern"]), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "from", "to")], _features(x, g["i"]).alias("f")))

    return F.flatten(F.transform(_tried(text, WIDE), of)).cast(f"array<{_PROPOSAL}>")


def free_of(proposed: Column, spans: Column) -> Column:
    """Proposals, by start, that meet none of the spans: one sweep from either end over both in order."""
    return _let(proposed, lambda p: F.when(F.size(p) > 0, _free_of(p, spans)).otherwise(_none(_PROPOSAL)))


def _kept(items: Column, marks: Column) -> Column:
    """The elements whose mark is not 0."""
    both = F.filter(F.arrays_zip(items.alias("x"), marks.alias("mark")), lambda z: z["mark"] != 0)
    return F.transform(both, lambda z: z["x"])


def _free_of(proposed: Column, spans: Column) -> Column:
    given = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("given"), F.lit(None).alias("p"))).cast(f"array<{_SWEPT}>")
    others = F.transform(proposed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(False).alias("given"), F.struct(x["from"].alias("from"), x["to"].alias("to"), x["f"].alias("f")).alias("p"))).cast(f"array<{_SWEPT}>")

    def left(end: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["given"], F.greatest(end, x["end"])).otherwise(end), (x["given"] | (x["start"] >= end)).cast("int")

    def right(start: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["given"], F.least(start, x["start"])).otherwise(start), (~x["given"] & (x["end"] <= start)).cast("int")

    once = lambda xs: _kept(xs, _scan(xs, F.lit(0), left))
    twice = lambda xs: _kept(xs, _scan(xs, F.lit(_LAST), right))
    kept = _let(F.reverse(_let(F.sort_array(F.concat(given, others)), once)), twice)
    return F.transform(F.reverse(kept), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["p"]["from"].alias("from"), x["p"]["to"].alias("to"), x["p"]["f"].alias("f"))).cast(f"array<{_PROPOSAL}>")


def apart(chosen: Column) -> Column:
    """Of spans by start, with margin and kind, those that stay: of a chain that overlaps, from the left, the better one."""

    def keep(held: Column, x: Column) -> tuple[Column, Column]:
        begins = x["start"] >= held["end"]
        better = (x["margin"] > held["margin"]) | ((x["margin"] == held["margin"]) & (x["start"] == held["start"]) & (x["end"] > held["end"]))
        # What is held when another chain begins stays: its place, from 1, is the output then.
        return F.when(begins | better, x).otherwise(held), F.when(begins, held["place"]).otherwise(0)

    def swept(xs: Column) -> Column:
        numbered = F.transform(xs, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["margin"].alias("margin"), (i + 1).alias("place")))
        edge = lambda at: F.struct(F.lit(at).alias("start"), F.lit(at).alias("end"), F.lit(0.0).alias("margin"), F.lit(0).alias("place"))
        kind = "struct<start:int,end:int,margin:double,place:int>"
        places = _scan(F.concat(numbered.cast(f"array<{kind}>"), F.array(edge(_LAST)).cast(f"array<{kind}>")), edge(0).cast(kind), keep)
        return F.transform(F.filter(places, lambda p: p > 0), lambda p: F.get(xs, (p - 1).cast("int")))

    return _let(chosen, lambda xs: F.when(F.size(xs) > 1, swept(xs)).otherwise(xs))


def _variants(kind: Column, value: Column) -> Column:
    """Forms of a base match that the base rules miss: (text, characters before the span, and behind it)."""
    digits = _digits(value)
    # Sixteen digits that are no card: the last one is turned where the check would hold.
    drawn = F.rpad(F.substring(F.regexp_replace(F.xxhash64(value).cast("string"), "-", ""), 1, 16), 16, "7")
    foreign = F.when(_luhn(drawn), F.concat(F.left(drawn, F.lit(15)), ((F.right(drawn, F.lit(1)).cast("int") + 1) % 10).cast("string"))).otherwise(drawn)
    host = F.substring_index(value, "@", -1)
    name = F.substring_index(value, "@", 1)
    form = lambda text, lead=F.lit(0), trail=F.lit(0): F.struct(text.alias("text"), lead.cast("int").alias("lead"), trail.cast("int").alias("trail"))
    forms = {
        "email": [form(F.concat(name, F.lit(" @ "), host)), form(F.concat(name, F.lit("[at]"), host)), form(F.concat(name, F.lit("(at)"), F.replace(host, F.lit("."), F.lit("(dot)")))), form(F.concat(name, F.lit(" at "), F.replace(host, F.lit("."), F.lit(" dot "))))],
        "ip": [form(F.replace(value, F.lit("."), F.lit("[.]"))), form(F.replace(value, F.lit("."), F.lit(" . ")))],
        "card": [form(F.regexp_replace(digits, r"([0-9]{4})(?=[0-9])", "$1.")), form(F.concat(foreign, F.lit(" "), digits), F.char_length(foreign) + 1), form(F.concat(digits, F.lit(" "), foreign), trail=F.char_length(foreign) + 1)],
        "phone": [form(F.regexp_replace(value, r"\A\+", "")), form(F.regexp_replace(value, r"\A\+[0-9]{1,3}[\x20.-]?(?=\(?[0-9]{2})", "")), form(F.concat(value, F.lit(" "), foreign), trail=F.char_length(foreign) + 1)],
    }
    return reduce(lambda out, i: out.when(kind == i, F.array(*forms[KINDS[i]])), range(1, len(KINDS)), F.when(kind == 0, F.array(*forms[KINDS[0]])))


@dataclass
class Tree:
    """One split after another: (feature, most, (feature, most, low, high), (feature, most, low, high))."""

    feature: int
    most: int
    sides: tuple[tuple[int, int, float, float], tuple[int, int, float, float]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        (fa, ma, la, ha), (fb, mb, lb, hb) = self.sides
        return np.where(x[:, self.feature] <= self.most, np.where(x[:, fa] <= ma, la, ha), np.where(x[:, fb] <= mb, lb, hb))

    def column(self, f: Column) -> Column:
        side = lambda s: F.when(f[s[0]] <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
        return F.when(f[self.feature] <= self.most, side(self.sides[0])).otherwise(side(self.sides[1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int, float, float]:
    """Gain, feature, most, and the two leaf values."""
    best = (0.0, 0, 1 << 30, *([RATE * float(-g.sum() / (h.sum() + 1.0))] * 2)) if len(x) else (0.0, 0, 1 << 30, 0.0, 0.0)
    for j in range(x.shape[1]):
        n = int(x[:, j].max(initial=0)) + 1
        lg, lh = np.cumsum(np.bincount(x[:, j], g, n)), np.cumsum(np.bincount(x[:, j], h, n))
        rg, rh = lg[-1] - lg, lh[-1] - lh
        gain = np.where((lh > 1e-3) & (rh > 1e-3), _gain(lg, lh) + _gain(rg, rh) - _gain(lg[-1], lh[-1]), 0)
        m = int(gain.argmax())
        if gain[m] > best[0] + 1e-9:
            best = (float(gain[m]), j, m, RATE * float(-lg[m] / (lh[m] + 1.0)), RATE * float(-rg[m] / (rh[m] + 1.0)))
    return best


def _first_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> Tree:
    _, feature, most, _, _ = _best_split(x, g, h)
    low = x[:, feature] <= most
    sides = tuple((b[1], b[2], b[3], b[4]) for b in (_best_split(x[s], g[s], h[s]) for s in (low, ~low)))
    return Tree(feature, most, sides)


def boost(x: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> list[Tree]:
    """Newton boosting of the logistic loss over counted feature rows."""
    trees, score = [], np.zeros(len(x))
    if (positive * weight).sum() < LEAST_WEIGHT:
        return trees
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = _first_split(x, (p - positive) * weight, p * (1 - p) * weight)
        trees.append(tree)
        score += tree.predict(x)
    return trees


def threshold(score: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> float | None:
    """The least score from which on the selected are right PRECISION of the time; None if there is none."""
    order = np.argsort(-score, kind="stable")
    right, all_ = np.cumsum((positive * weight)[order]), np.cumsum(weight[order])
    last = np.append(np.diff(score[order]) != 0, True)  # equal scores go together
    good = np.flatnonzero(last & (right >= PRECISION * all_) & (right > 0)) if len(order) else []
    return float(score[order][good[-1]]) if len(good) else None


@dataclass
class Redactor:
    """For each kind its trees and threshold; None adds nothing of it."""

    trees: list[list[Tree]]
    thresholds: list[float | None]

    @classmethod
    def fit(cls, documents: DataFrame) -> Redactor:
        scratch = Scratch(documents.sparkSession, "pii")
        texts = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        halves = texts.select("text", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(2)).alias("half"))
        met = halves.select("half", _base_matches(F.col("text")).alias("base"), proposals(F.col("text")).alias("proposed"))
        given = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), *[x["m"][c].alias(c) for c in ("start", "end", "from", "to")])).cast(f"array<{_SPAN}>")
        # Texts are read once: their base matches and what the generators add are few beside them.
        met = scratch.save(met.select("half", "base", free_of(F.col("proposed"), given).alias("free")), "met")
        wrong = met.select("half", F.explode("free.f").alias("f"), F.lit(-1).alias("kind"))
        forms = met.select("half", F.explode("base").alias("x")).select("half", F.col("x.kind").alias("of"), "x.m")
        forms = forms.select("half", "of", "m", F.explode(_variants(F.col("of"), F.col("m.value"))).alias("v"))
        start = F.char_length("m.before") + F.col("v.lead")
        end = F.char_length("m.before") + F.char_length("v.text") - F.col("v.trail")
        piece = forms.select("half", "of", start.alias("a"), end.alias("b"), F.concat("m.before", "v.text", F.coalesce("m.after", F.lit(""))).alias("piece"))
        seen = piece.select("half", "of", "a", "b", F.explode(proposals(F.col("piece"))).alias("p"))
        right = (F.col("p.start") == F.col("a")) & (F.col("p.end") == F.col("b"))
        seen = seen.select("half", F.col("p.f").alias("f"), F.when(right, F.col("of")).otherwise(-1).alias("kind"))
        rows = wrong.select("half", "f", "kind").unionByName(seen).groupBy("f", "kind", "half").agg(F.count("*").alias("n")).collect()
        rows.sort(key=lambda r: (r["half"], r["kind"], r["f"]))
        x = np.array([r["f"] for r in rows], np.int64).reshape(-1, len(FEATURES))
        kinds, half, weight = (np.array([r[k] for r in rows], np.int64) for k in ("kind", "half", "n"))
        trees, limits = [], []
        for k in range(len(KINDS)):
            right, counted = (kinds == k).astype(float), weight.astype(float)
            # A half is scored by the trees of the other one, so the threshold counts all documents and none by its own trees.
            score, scored = np.zeros(len(x)), np.zeros(len(x), bool)
            for part in (0, 1):
                own, rest = boost(x[half == part], right[half == part], counted[half == part]), half == 1 - part
                score[rest] = sum((t.predict(x[rest]) for t in own), np.zeros(int(rest.sum())))
                scored |= rest & bool(own)
            trees.append(boost(x, right, counted))
            limits.append(threshold(score[scored], right[scored], counted[scored]) if scored.any() else None)
        return cls(trees, limits)

    def kind_and_margin(self, f: Column) -> Column:
        """The kind whose score is furthest above its threshold, as (margin, kind); null where none is."""
        options = []
        for k, (trees, limit) in enumerate(zip(self.trees, self.thresholds, strict=True)):
            if limit is not None:
                margin = F.round(sum((t.column(f) for t in trees), F.lit(0.0)) - limit, 9)
                options.append(F.struct(margin.alias("margin"), F.lit(-k).alias("kind")))
        if not options:
            return F.lit(None).cast("struct<margin:double,kind:int>")
        return _let(F.array_max(F.array(*options)), lambda best: F.when(best["margin"] >= 0, best))

    def with_spans(self, documents: DataFrame) -> DataFrame:
        """Adds base and spans: arrays of (kind, start, end, from, to), by kind and start; from and to count bytes."""
        out = documents.withColumn("base", F.sort_array(base_spans(F.coalesce("text", F.lit("")))))
        out = out.withColumn("spans", proposals(F.coalesce("text", F.lit(""))))
        # Column by column: Spark resolves one level of lambdas at a time, and gives up on very deep ones.
        out = out.withColumn("spans", free_of(F.col("spans"), F.col("base")))
        fields = ("start", "end", "from", "to")
        scored = lambda c: F.struct(*[c[x].alias(x) for x in fields], self.kind_and_margin(c["f"]).alias("best"))
        chosen = F.filter(F.transform("spans", scored), lambda c: c["best"].isNotNull())
        pending = F.transform(chosen, lambda c: F.struct(*[c[x].alias(x) for x in fields], c["best"]["margin"].alias("margin"), (-c["best"]["kind"]).alias("kind"))).cast(f"array<{_PENDING}>")
        out = out.withColumn("spans", apart(pending))
        added = F.transform("spans", lambda c: F.struct(c["kind"].alias("kind"), *[c[x].alias(x) for x in fields])).cast(f"array<{_SPAN}>")
        return out.withColumn("spans", F.sort_array(F.concat("base", added)))


def span_text(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    fields = lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s["kind"].alias("kind"))
    end = F.struct(F.octet_length(text).alias("from"), F.octet_length(text).alias("to"), F.lit(-1).alias("kind"))
    ordered = F.concat(F.sort_array(F.transform(spans, fields)), F.array(end))

    def cut(data: Column) -> Column:
        # The byte up to which the text is used when a span comes, or -1 for a span that begins within another.
        begin = lambda at, s: (F.greatest(at, s["to"]), F.when(s["from"] >= at, at).otherwise(-1))

        def pieces(xs: Column) -> Column:
            outer = F.filter(F.arrays_zip(xs.alias("x"), _scan(xs, F.lit(0), begin).alias("at")), lambda z: z["at"] >= 0)
            return F.transform(outer, lambda z: F.concat(F.substring(data, (z["at"] + 1).cast("int"), (z["x"]["from"] - z["at"]).cast("int")).cast("string"), F.coalesce(F.get(kinds, z["x"]["kind"]), F.lit(""))))

        return F.array_join(_let(ordered, pieces), "")

    return F.when(F.size(spans) > 0, _let(text.cast("binary"), cut)).otherwise(text)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = Redactor.fit(documents).with_spans(documents)
    counts = [F.expr(f"size(filter(base, b -> b.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))

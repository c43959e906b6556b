"""Rule-based classification, scores and colours as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.text import bound, fold


def ordered_case(text: Column, rules: list[tuple[tuple[str, ...], str]], otherwise: str | None) -> Column:
    """The label of the first rule of which a word occurs in the folded text."""

    def chosen(folded: Column) -> Column:
        out = None
        for words, label in rules:
            hit = F.lit(False)
            for word in words:
                hit = hit | folded.contains(word)
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out.otherwise(otherwise)

    return bound(fold(text), chosen)


#: Surface words in the order in which they are tried.
SURFACES = [(("umela", "umt"), "artificial"), (("skvara", "antuka"), "gravel/clay"), (("prirodni", "trava"), "grass")]
#: Words that allow and forbid, and the terms that they are near to.
ALLOW, DENY, STUDS, ARTIFICIAL = "povolen", "zakazan", "lisov", r"\bag\b"


def surface(notes: Column) -> Column:
    return ordered_case(notes, SURFACES, "unknown")


def distance_to(text: Column, at: Column, word: str) -> Column:
    """Characters between a place (from 1) and the nearest start of a word; null if there is none."""
    after = F.locate(word, F.substring(text, at, F.char_length(text)))
    before = F.locate(word[::-1], F.reverse(F.substring(text, F.lit(1), at + len(word) - 2)))
    ahead = F.when(after > 0, after - 1)
    behind = F.when(before > 0, before)
    return F.least(ahead, behind)


def nearest_verdict(text: Column, term: str, allow: tuple[str, ...], deny: tuple[str, ...]) -> Column:
    """Whether a text allows a term (a regular expression): the word nearest to its first occurrence decides, a tie forbids."""
    nearest = lambda t, words: F.least(*[distance_to(t["text"], t["at"], w) for w in words], F.lit(None).cast("int"))

    def verdict(d: Column) -> Column:
        return F.when(d["at"] == 0, "unknown").when(d["no"].isNull(), F.when(d["yes"].isNotNull(), "allowed").otherwise("unknown")).when(d["yes"].isNull(), "forbidden").when(d["no"] <= d["yes"], "forbidden").otherwise("allowed")

    apart = lambda t: F.struct(t["at"].alias("at"), nearest(t, allow).alias("yes"), nearest(t, deny).alias("no"))
    placed = lambda t: F.struct(t.alias("text"), F.regexp_instr(t, F.lit(term)).alias("at"))
    return bound(text, lambda t: bound(placed(t), lambda at: bound(apart(at), verdict)))


def footwear_line(notes: Column, start: str = "obuv") -> Column:
    """The first line that starts with the keyword itself, trimmed; null without one."""
    line = F.get(F.filter(F.split(notes, "\n"), lambda x: fold(x).startswith(start)), F.lit(0))
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def footwear_summary(studs: Column, artificial: Column) -> Column:
    """Four-way summary of two verdicts; studs that are not allowed leave the other soles to decide."""
    return F.when(studs == "allowed", "lisovky OK").when(artificial == "forbidden", "turf / indoor only").when(artificial == "allowed", "AG or turf, no lisovky").otherwise("no lisovky")


def footwear(notes: Column) -> Column:
    """(text, studs, artificial, summary) of a ground's notes: verdicts are unknown and the rest empty without a line on footwear."""

    def ruled(line: Column) -> Column:
        verdict = lambda term: nearest_verdict(line["folded"], term, (ALLOW,), (DENY,))
        none = F.struct(F.lit("").alias("text"), F.lit("unknown").alias("studs"), F.lit("unknown").alias("artificial"), F.lit("").alias("summary"))
        found = bound(F.struct(verdict(STUDS).alias("studs"), verdict(ARTIFICIAL).alias("artificial")), lambda v: F.struct(line["text"].alias("text"), v["studs"].alias("studs"), v["artificial"].alias("artificial"), footwear_summary(v["studs"], v["artificial"]).alias("summary")))
        return F.when(line["text"].isNull(), none).otherwise(found)

    return bound(footwear_line(notes), lambda x: bound(F.struct(x.alias("text"), fold(x).alias("folded")), ruled))


def boots_label(studs: Column) -> Column:
    return F.when(studs == "allowed", "studs").when(studs == "forbidden", "no studs").otherwise("")


def score_side(score: Column, home: Column) -> tuple[Column, Column]:
    """Goals for and against, from "home:away" text seen from one side; null while unplayed."""
    first, second = (F.regexp_extract(score, r"^\s*(\d+)\s*:\s*(\d+)\s*$", i).try_cast("int") for i in (1, 2))
    return F.when(home, first).otherwise(second), F.when(home, second).otherwise(first)


def result(goals_for: Column, goals_against: Column) -> Column:
    return F.when(goals_for > goals_against, "W").when(goals_for == goals_against, "D").when(goals_for < goals_against, "L")


def confidence(edges: Column) -> Column:
    """high, medium or low by the weakest edge; without edges low."""
    weakest = F.array_min(edges)
    return F.when(weakest >= 4, "high").when(weakest >= 2, "medium").otherwise("low")


def is_official(css_class: Column, score: Column) -> Column:
    return css_class.contains("is-result") & ~css_class.contains("is-gray") & (F.coalesce(score, F.lit("")) != "")


def area(length: Column, width: Column) -> Column:
    """Product of the sides, each rounded half to even."""
    return (F.bround(length) * F.bround(width)).cast("long")


def keeper_badge(keeper: Column, matches: Column) -> Column:
    return (keeper >= 5) & (2 * keeper >= matches)


def captain_badge(captain: Column, matches: Column) -> Column:
    return (captain >= 5) & (5 * captain >= matches)


def career_dot(place: Column, out_of: Column) -> Column:
    """Category of a season in a chart; the first that fits."""
    return F.when(place.isNull(), "no table").when(place == 1, "first").when(place <= 3, "top three").when(place == out_of, "last").otherwise("other")


def share_of(value: Column, most: Column) -> Column:
    return F.round(100 * value / most, 1)


def shade(hex_colour: Column, factor: float) -> Column:
    """A #RRGGBB colour towards black (factor below 1) or white (above), truncated."""
    def channel(i: int) -> Column:
        c = F.conv(F.substring(hex_colour, 2 + 2 * i, 2), 16, 10).cast("int")
        out = c * factor if factor <= 1 else c + (255 - c) * (factor - 1)
        return F.format_string("%02X", F.floor(out).cast("int"))

    return F.concat(F.lit("#"), channel(0), channel(1), channel(2))


def colours(text: Column, stems: dict[str, str], most: int = 3, light: str = "svetl", dark: str = "tmav", shirt_only: bool = False) -> Column:
    """Colours named in a text: parts by comma, slash or " a ", a light or dark prefix for all pieces of a part, pieces
    by dash, each by the first stem it starts with; unknown pieces vanish, repeats too, at most `most` stay."""
    parts = F.split(fold(text), r"\s*,\s*|\s*/\s*|\s+a\s+")
    parts = F.slice(parts, 1, 1) if shirt_only else parts
    known = [F.struct(F.lit(k).alias("stem"), F.lit(v).alias("hex")) for k, v in stems.items()]

    def of_part(part: Column) -> Column:
        bare = F.regexp_replace(F.trim(part), rf"^({light}|{dark})[a-z]*[\s-]+|^({light}|{dark})e?", "")
        pieces = F.split(bare, r"\s*-\s*")

        def of_piece(piece: Column) -> Column:
            found = F.get(F.filter(F.array(*known), lambda s: piece.startswith(s["stem"])), F.lit(0))["hex"]
            return F.when(F.trim(part).startswith(light), shade(found, 1.35)).when(F.trim(part).startswith(dark), shade(found, 0.6)).otherwise(found)

        return F.filter(F.transform(pieces, of_piece), lambda h: h.isNotNull())

    return F.slice(F.array_distinct(F.flatten(F.transform(parts, of_part))), 1, most)


def rgb_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of arrays of three channels."""
    return F.sqrt(sum(((F.get(a, F.lit(i)) - F.get(b, F.lit(i))) * (F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(1, 3)), (F.get(a, F.lit(0)) - F.get(b, F.lit(0))) * (F.get(a, F.lit(0)) - F.get(b, F.lit(0)))))


def clash(first_a: Column, first_b: Column, second_a: Column | None = None, second_b: Column | None = None, least: float = 120.0) -> Column:
    """Whether first colours are too near, unless both sides have second ones that are not. Missing colours do not clash."""
    near = F.coalesce(rgb_distance(first_a, first_b) < least, F.lit(False))
    if second_a is None or second_b is None:
        return near
    return near & ~F.coalesce(rgb_distance(second_a, second_b) >= least, F.lit(False))


def compass(nx: Column, ny: Column) -> Column:
    """The side a normal points to, with y downwards."""
    return F.when(F.abs(nx) >= F.abs(ny), F.when(nx > 0, "E").otherwise("W")).otherwise(F.when(ny > 0, "S").otherwise("N"))

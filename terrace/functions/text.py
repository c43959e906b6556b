"""Text folding, keys, tag stripping and escapes as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decomposed() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one character and marks, and those characters."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in range(0xA0, 0x10000) if not 0xAC00 <= c < 0xE000]
    found = [(c, base) for c, base in pairs if len(base) == 1 and base != c]
    return "".join(c for c, _ in found), "".join(base for _, base in found)


ACCENTED, PLAIN = _decomposed()

#: Entities in the order in which they are decoded, so that "&amp;lt;" ends as "<".
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def fold(text: Column) -> Column:
    """Lower case without diacritics: letters by their Unicode decomposition, then marks of their own.

    Letters without a decomposition (ß, đ, ł, ø) stay, and so do ligatures. Plain ASCII text is lower-cased alone.
    """
    lower = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), lower).otherwise(F.regexp_replace(F.translate(lower, ACCENTED, PLAIN), r"\p{M}+", ""))


def key(text: Column) -> Column:
    """Join key of a name: folded, letters and digits only."""
    return F.regexp_replace(fold(text), "[^a-z0-9]+", "")


def ascii_id(text: Column) -> Column:
    """Identifier of a name: folded, other runs as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """What `body` makes of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_tags(html: Column) -> Column:
    """Readable text: breaks as newlines, tags as blanks, entities decoded, blanks collapsed, ends trimmed.

    Steps whose first character does not occur are left out; a text that no step would change is only looked through once.
    """
    return bound(html, lambda text: F.when(text.rlike(TO_STRIP), _stripped(text)).otherwise(text))


#: What a step of strip_tags would change: tags, entities, breaks, tabs and fixed blanks, runs of blanks, blanks at the ends.
TO_STRIP = r"[<&\t\n\x0B\f\r\x{A0}]|  |^\s|\s$"


def _stripped(html: Column) -> Column:

    def plain(text: Column) -> Column:
        out = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
        return F.regexp_replace(out, r"<[^>]*>", " ")

    def decoded(text: Column) -> Column:
        for entity, char in ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
        return text

    lines = lambda text: F.when(text.contains("\n"), F.regexp_replace(text, r" *\n *", "\n")).otherwise(text)
    spaced = lambda text: bound(F.regexp_replace(text, r"[ \t\x{A0}]+", " "), lines)
    read = lambda text: bound(F.when(text.contains("&"), decoded(text)).otherwise(text), spaced)
    out = bound(html, lambda text: bound(F.when(text.contains("<"), plain(text)).otherwise(text), read))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def surname_key(name: Column) -> Column:
    """What follows the last blank, then the whole name; compare under a collation for a language's own order."""
    return F.concat_ws(" ", F.substring_index(name, " ", -1), name)


def calendar_escape(text: Column) -> Column:
    """Backslash, semicolon, comma and newline escaped as calendar files need."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char in (";", ","):
        out = F.replace(out, F.lit(char), F.lit("\\" + char))
    return F.regexp_replace(out, "\r?\n", r"\\n")


def calendar_fold(line: Column, octets: int = 73) -> Column:
    """Lines of at most `octets` bytes, continued after a line break and a blank. A character is never split.

    Short lines stay as they are and ASCII ones are cut by place; only long lines of wider characters are walked through,
    and their parts are joined once.
    """
    rest = F.substring(line, F.lit(octets + 1), F.char_length(line))
    by_place = F.concat(F.substring(line, 1, octets), F.regexp_replace(rest, f"(?s)(.{{1,{octets - 1}}})", "\r\n $1"))
    chars = F.filter(F.split(line, ""), lambda c: c != "")
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"))

    def add(acc: Column, c: Column) -> Column:
        size = F.octet_length(c)
        full = acc["used"] + size > octets
        part = F.when(full, F.concat(F.lit("\r\n "), c)).otherwise(c)
        return F.struct(F.array_append(acc["parts"], part).alias("parts"), F.when(full, size + 1).otherwise(acc["used"] + size).alias("used"))

    walked = F.aggregate(chars, start, add, lambda acc: F.array_join(acc["parts"], ""))
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(F.octet_length(line) <= octets, line).when(ascii_only, by_place).otherwise(walked)


def code_prefix(code: Column) -> Column:
    return F.regexp_extract(code, r"^(.*?)(\d*)$", 1)


def code_number(code: Column) -> Column:
    """The number at the end of a code, so that P2 comes before P10; null without one."""
    return F.regexp_extract(code, r"(\d+)$", 1).try_cast("int")


def digest(payload: Column, length: int = 8) -> Column:
    """The first digits of SHA-1, for names that follow content."""
    return F.substring(F.sha1(payload), 1, length)


def label_lookup_key(label: Column) -> Column:
    """A label without a trailing parenthesis, folded."""
    return F.trim(fold(F.regexp_replace(label, r"\s*\([^()]*\)\s*$", "")))

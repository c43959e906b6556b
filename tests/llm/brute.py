"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def clean_words(text: str | None) -> list[str]:
    return CLEAN_WORD.findall((text or "").translate(UPPER))


def contamination(text: str | None, items: list[tuple[int, str | None]], size: int = 10) -> tuple[int, int, list[str]]:
    """Number of words, number of words hit, sorted ids of items found."""
    w = clean_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        x = clean_words(item)
        for s in range(max(len(x) - size, 0) + 1 if x else 0):
            window = x[s : s + size]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item_id))
    return len(w), len(hit), sorted(found)


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)} if w else set()


def jaccard_components(texts: list[str | None]) -> list[int]:
    """The first place of each text's component."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def targets(sizes: dict, weights=(5, 2, 1), repeat: int = 3) -> dict:
    """Target of each source: shares by weight, the excess over `repeat` sizes dealt again among the rest."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(repeat * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        level = rest / total if total else 0
        over = [s for s in names if s not in capped and level * weight[s] > repeat * sizes[s]]
        if not over:
            return {s: float(repeat * sizes[s]) if s in capped else level * weight[s] for s in names}
        capped.update(over)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [(kind, m.start(), m.end()) for kind, (pattern, good) in kinds.items() for m in re.finditer(pattern, text) if good(m[0])]


def held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def unigrams(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, int, int, float]]:
    """n_tokens, n_known, train_tokens and base score of each row."""
    end = object()
    tokens = [[*words(t), end] for _, t in rows]
    counts = Counter(x for (i, _), t in zip(rows, tokens, strict=True) if i is not None and not held_out(i, 7, 2) for x in t)
    n, v = sum(counts.values()), len(counts)
    return [(len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)) for t in tokens]


def sha256(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()

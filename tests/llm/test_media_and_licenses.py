import random
import struct
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest
from brute import sha256

from terrace.llm import licenses, media


# Media columns


@pytest.mark.parametrize("size", [64, 128, 64 * 33, 64 * 40_000])
def test_png_round_trip(size):
    rng = np.random.default_rng(size)
    for payload in (rng.integers(0, 256, size, np.uint8).tobytes(), bytes(size), (b"some text " * size)[:size]):
        image = media.encode_png(payload)
        assert media.decode_png(image).tobytes() == payload


def test_every_row_filter_is_undone():
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (40, 64))
    kinds = rng.integers(0, 5, 40).astype(np.uint8)
    lines = np.zeros((40, 64), np.uint8)
    for r in range(40):
        for c in range(64):
            left, above, corner = (int(pixels[y, x]) if y >= 0 and x >= 0 else 0 for y, x in ((r, c - 1), (r - 1, c), (r - 1, c - 1)))
            p = left + above - corner
            paeth = min(((abs(p - v), i, v) for i, v in enumerate((left, above, corner))))[2]
            lines[r, c] = (pixels[r, c] - (0, left, above, (left + above) // 2, paeth)[kinds[r]]) % 256
    assert (media._unfilter(kinds, lines) == pixels).all()


@pytest.mark.parametrize("at", [0, 20, 30, 60, -6])
def test_damage_is_found(at):
    image = bytearray(media.encode_png(bytes(range(64)) * 20))
    image[at] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(image))
    with pytest.raises(ValueError):
        media.decode_png(bytes(image[:-12]))


def test_cosine_hash_is_of_low_frequencies():
    rng = np.random.default_rng(1)
    smooth = np.kron(rng.integers(30, 220, (8, 8)), np.ones((12, 8)))
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    one, noisy, other = (media.cosine_hash(x.astype(np.uint8)) for x in (smooth, (smooth + rng.normal(0, 3, smooth.shape)).clip(0, 255), smooth[::-1]))
    assert len(one) == 16 and bits(one, noisy) < 10 < bits(one, other)


def test_media_query(spark, folder):
    texts = [None, "", "x", "é" * 32, "a" * 64, "b" * 65, "word " * 60_000, "word " * 60_000]
    documents = [*enumerate(texts), (None, "x")]
    got = media.op10_media_columns(spark, folder(documents)).collect()
    assert len(got) == len(documents)
    for r in got:
        data = ((texts[r["doc_id"]] if r["doc_id"] is not None else "x") or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), sha256(payload), zlib.crc32(payload[-64:]))
        image = media.encode_png(payload)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), sha256(image), media.cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64)))
    assert media.op10_media_columns(spark, folder([])).count() == 0


def test_stored_form_is_a_png_by_its_chunks():
    image = media.encode_png(b"z" * 128)
    at, kinds, packed = 8, [], b""
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kinds.append(image[at + 4 : at + 8])
        packed += image[at + 8 : at + 8 + n] if kinds[-1] == b"IDAT" else b""
        at += 12 + n
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and kinds == [b"IHDR", b"IDAT", b"IEND"] and len(zlib.decompress(packed)) == 2 * 65


# Licenses


def test_alignment_rises_and_matches():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(30))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < x2 and y < y2 for (x, y), (x2, y2) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= len(a) and (a != b or len(pairs) == len(a))


def test_alignment_of_words_unique_to_both_is_the_longest_rising_run():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([str(i) for i in rng.sample(range(12), rng.randrange(1, 12))] for _ in range(2))
        best = {(-1, -1): 0}
        for i, w in enumerate(a):
            if w in b:
                best[i, b.index(w)] = 1 + max(n for (x, y), n in best.items() if x < i and y < b.index(w))
        assert len(licenses.align(a, b)) == max(best.values())


def test_scan_finds_edited_licenses_anywhere(spark, folder):
    mit, gpl = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["GPL-3.0-header"]
    filler = " ".join(f"word{i % 97}" for i in range(30_000))
    edited = gpl.replace("either", "any").replace("any later", "each later")
    texts = {1: f"{filler} {mit.upper()} {filler}", 2: f"// {edited}\n{filler}", 3: filler, 4: None, 5: "", 6: "license version the permission", 7: "Released under the MIT License.", 8: mit + " " + gpl}
    got = {r["doc_id"]: r for r in licenses.op9_license_scan(spark, folder([*texts.items(), (7, texts[7]), (None, texts[7])])).collect()}
    assert {i: got[i]["license"] for i in texts} == {1: "MIT-text", 2: "GPL-3.0-header", 3: None, 4: None, 5: None, 6: None, 7: "MIT", 8: "GPL-3.0-header"}
    words = licenses.words_of(gpl)
    same = sum(m.size for m in SequenceMatcher(None, licenses.words_of(edited), words, autojunk=False).get_matching_blocks())
    assert got[2]["coverage"] == pytest.approx(same / len(words)) and got[1]["coverage"] == 1 and got[None]["license"] == "MIT"
    assert got[1]["first_word"] == 30_000 and got[1]["end_word"] == 30_000 + len(licenses.words_of(mit))
    assert licenses.op9_license_scan(spark, folder([])).count() == 0


def test_doubled_and_stretched_notices_are_found_at_every_place():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    mit = licenses.TEMPLATES["MIT"]
    apache = licenses.words_of(licenses.TEMPLATES["Apache-2.0-header"])
    stretched = " ".join(w if i % 3 else f"{w} extra{i} more{i}" for i, w in enumerate(apache))
    for offset in range(0, 70):
        before, after = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", offset), ("z", 45)))
        for copies in (2, 3):
            assert scanner.best(f"{before} {mit * copies} {after}") == ("MIT", 1.0, offset, offset + 5)
        assert scanner.best(f"{before} Released under the MIT Licence. {mit} {after}") == ("MIT", 1.0, offset + 5, offset + 10)
        name, share, first, _ = scanner.best(f"{before} {stretched} {after}")
        assert (name, share, first) == ("Apache-2.0-header", 1.0, offset)


def test_scan_gives_every_license_of_a_document(spark, folder):
    mit, gpl = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["GPL-3.0-header"]
    n, m = len(licenses.words_of(mit)), len(licenses.words_of(gpl))
    got = {r["doc_id"]: [tuple(x) for x in r["matches"]] for r in licenses.op9_license_scan(spark, folder([(1, f"{mit} {gpl} x y {mit}"), (2, None)])).collect()}
    assert got == {1: [("MIT-text", 1.0, 0, n), ("GPL-3.0-header", 1.0, n, n + m), ("MIT-text", 1.0, n + m + 2, 2 * n + m + 2)], 2: []}


def test_words_that_tell_licenses_apart_must_match():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    texts = licenses.TEMPLATES
    cases = {"Released under the BSD License.": None, "Licensed under CC BY 4.0.": "CC-BY-4.0-short", "Licensed under CC BY-NC 3.0.": None,
             texts["GPL-3.0"].replace("version 3", "version 2"): None, texts["GPL-3.0"].replace("GNU", "GNU Lesser"): None,
             **{texts[name]: name for name in texts}}
    assert {t: scanner.best(t)[0] for t in cases} == cases
    assert {m[0] for m in scanner.matches(texts["BSD-3-Clause"])} == {"BSD-3-Clause", "BSD-opening"}

"""Language ID, toxicity and language model: held-out quality, gradients, and defined results."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import UPPER, held_out, unigrams

from terrace.llm import langid, lm, toxicity

EDGES = [(None, None), (None, "ka ro"), (9001, None), (9002, ""), (9003, "12 34 !"), (9004, "karoti " * 8000), (9005, "kamu"), (9005, "kamu")]


# Language ID


@pytest.fixture(scope="module")
def language_case():
    rng = random.Random(8)
    syllables = {"aa": ["ka", "ro", "ti", "mu", "se"], "bb": ["zho", "qwe", "üx", "yöl"], "cc": ["the", "ing", "ton", "er"]}
    text = lambda lang: " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(4, 60)))
    documents = [(i, text(lang), lang if i % 11 else None, f"s{i % 3}") for i in range(500) for lang in [rng.choice("abc") * 2]]
    return documents, {d[0]: ("aa" if d[1].split()[0][:2] in ("ka", "ro", "ti", "mu", "se") else "cc" if d[1].split()[0][:2] in ("th", "in", "to", "er") else "bb") for d in documents}


def test_language_of_held_out_documents(spark, folder, language_case):
    documents, truth = language_case
    sf = folder(documents + EDGES)
    got = langid.op1_language_id(spark, sf).collect()
    assert len(got) == len(documents) + len(EDGES)
    own = [r for r in got if r["doc_id"] in truth]
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 for r in own)
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in own if r["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.97
    rest = sorted(((r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] not in truth), key=repr)
    assert rest == sorted([(None, "und"), (None, "aa"), (9001, "und"), (9002, "und"), (9003, "und"), (9004, "aa"), (9005, "aa"), (9005, "aa")], key=repr)
    again = langid.op1_language_id(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_language_without_labels_or_rows(spark, folder):
    assert [tuple(r)[2:] for r in langid.op1_language_id(spark, folder([(1, "abc")])).collect()] == [("und", 0.0)]
    assert langid.op1_language_id(spark, folder([])).count() == 0


def test_tables_of_byte_pairs_equal_the_convolution():
    rng = np.random.default_rng(1)
    net = langid.train(rng.integers(0, 256, (8, langid.WINDOW)).astype(np.uint8), np.arange(8) % 2, ["a", "b"])
    windows = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    want = []
    for i, width in enumerate(langid.WIDTHS):
        embedded = net.parameters[0][windows]
        conv = sum(embedded[:, j : langid.WINDOW - width + 1 + j] @ net.parameters[1 + 2 * i][j] for j in range(width)) + net.parameters[2 + 2 * i]
        want.append(conv.max(axis=1))
    assert np.allclose(langid.pooled(windows, net.tables()), np.concatenate(want, axis=1), atol=1e-4)


def test_predictions_equal_a_network_of_plain_loops(spark, folder, language_case):
    """Windows of whole texts, filters, maxima and softmax one by one, averaged by length."""
    documents = language_case[0][:150] + [(9004, "karoti zho " * 150, None, None), (9006, "Ü1", None, None)]
    table = spark.read.parquet(folder(documents) + "/documents.parquet")
    net = langid.fit(table)
    p, got = net.parameters, {r["doc_id"]: r for r in langid.identify(table, net).collect()}
    for i, text, *_ in documents[:12] + documents[-2:]:
        data = bytes(b + 32 if 65 <= b < 91 else b for b in text.encode())
        total = np.zeros(len(net.languages))
        for at in range(0, len(data), langid.WINDOW):
            piece = data[at : at + langid.WINDOW]
            x = p[0][list(piece.ljust(langid.WINDOW, b"\0"))]
            pooled = [max(float((x[j : j + w] * p[1 + 2 * k][:, :, f]).sum() + p[2 + 2 * k][f]) for j in range(langid.WINDOW - w + 1)) for k, w in enumerate(langid.WIDTHS) for f in range(langid.FILTERS)]
            logits = np.maximum(pooled, 0) @ p[-2] + p[-1]
            total += np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum() * len(piece)
        assert got[i]["lang_pred"] == net.languages[int(total.argmax())] and got[i]["score"] == pytest.approx(total.max() / total.sum(), abs=1e-3)


# Toxicity


def toxic_case(n: int):
    rng = random.Random(4)
    common, bad, worse = [f"w{i}" for i in range(60)], ["grumble", "sneer", "mock"], ["vile", "hateful", "wretch"]
    documents, labels, grade = [], [], {}
    for i in range(n):
        g = rng.choices([0, 1, 2], [6, 2, 2])[0]
        words = rng.choices(common, k=rng.randint(15, 60)) + (rng.choices(bad, k=3) if g == 1 else rng.choices(worse, k=3) if g == 2 else [])
        rng.shuffle(words)
        documents.append((i, " ".join(words).capitalize() + "."))
        grade[i] = g
        if i % 2:
            labels.append((i, 0 if g == 2 else 1, int(g > 0)))
    return documents, labels, grade


def test_severity_of_unlabelled_documents(spark, folder):
    documents, labels, grade = toxic_case(900)
    edges = [(None, None), (9001, None), (9002, ""), (9003, "w1 vile " + "w2 " * 20_000), (9004, "w1 w2"), (9004, "w1 w2")]
    sf = folder(documents + edges, labels=labels + [(None, 1, 1), (1, None, None), (5, 1, None), labels[0]])
    got = toxicity.op6_toxicity(spark, sf).collect()
    assert len(got) == len(documents) + len(edges)
    rest = [r for r in got if r["doc_id"] in grade and r["doc_id"] % 2 == 0]
    assert np.mean([r["toxic"] == (grade[r["doc_id"]] > 0) for r in rest]) > 0.95
    mean = [np.mean([r["severity"] for r in rest if grade[r["doc_id"]] == g]) for g in range(3)]
    assert mean[0] < 0.3 and mean[0] + 0.4 < mean[1] < mean[2]
    long = next(r for r in got if r["doc_id"] == 9003)
    assert long["p_toxic"] > 0.5 and not next(r for r in got if r["doc_id"] == 9001)["toxic"]
    assert len({(r["severity"], r["p_toxic"]) for r in got if r["doc_id"] == 9004}) == 1


def test_severity_without_labels_or_with_one_grade(spark, folder):
    assert [r["severity"] for r in toxicity.op6_toxicity(spark, folder([(1, "a"), (2, None)])).collect()] == pytest.approx([0, 0], abs=1e-9)
    assert [r["severity"] for r in toxicity.op6_toxicity(spark, folder([(1, "a")], labels=[(1, 1, 1)])).collect()] == pytest.approx([1], abs=1e-9)
    assert toxicity.op6_toxicity(spark, folder([])).count() == 0


def plain_features(text: str | None) -> set[tuple]:
    """Words and beginnings by bytes, and again those that occur often."""
    words = [w.encode() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").translate(UPPER))]
    found = Counter(f for w in words for f in [(None, w), *((k, w[:k]) for k in toxicity.PREFIXES if len(w) >= k)])
    return set(found) | {(*f, "many") for f, n in found.items() if n >= toxicity.MANY}


def hashed_features(text: str | None) -> list[int]:
    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"])
    return [int(f) for _, _, _, features in toxicity._features(batch) for f in features]


def test_severity_equals_plain_sums_of_weights(spark, folder):
    documents, labels, _ = toxic_case(300)
    sf = folder(documents + [(9001, "Été été ÉTÉ vile vilest, wretchedness"), (9002, None)], labels=labels)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(table, toxicity.grades_of(spark.read.parquet(f"{sf}/labels.parquet")))
    got = {r["doc_id"]: r for r in toxicity.severity(table, model).collect()}
    for r in table.collect():
        features = hashed_features(r["text"])
        assert len(features) == len(plain_features(r["text"]))
        above = [1 / (1 + math.exp(t - sum(model.weights[f] for f in features))) for t in model.thresholds]
        assert got[r["doc_id"]]["severity"] == pytest.approx(sum(above)) and got[r["doc_id"]]["grade"] == sum(a >= toxicity.CUT for a in above)


def test_thresholds_rise():
    model = toxicity.fit([np.array([1, 2]), np.array([2, 3]), np.array([3])] * 20, np.array([0, 1, 2] * 20), np.ones(60))
    assert model.thresholds[0] < model.thresholds[1]


# Language model


def test_gradients_are_slopes():
    rng = np.random.default_rng(3)
    net = lm.Gru.start(rng.integers(1, 50, lm.OTHER + 1).astype(float))
    for name in ("inputs", "recurrent", "class_weights", "class_bias", "word_weights", "word_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    words = rng.integers(0, lm.OTHER + 1, (6, 3))
    words[1] = lm.OTHER
    fresh = np.zeros((6, 3), bool)
    fresh[0], fresh[3, 1] = True, True
    h = np.zeros((3, lm.HIDDEN))
    _, grads, _ = net.gradients(h, words, fresh)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in np.argsort(-np.abs(g).ravel())[:3]:
            place, step = np.unravel_index(at, p.shape), 1e-5
            p[place] += step
            up = net.gradients(h, words, fresh)[0]
            p[place] -= 2 * step
            down = net.gradients(h, words, fresh)[0]
            p[place] += step
            assert g[place] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)


def test_probabilities_sum_to_one_and_windows_carry_state():
    rng = np.random.default_rng(3)
    n = lm.OTHER + 1
    net = lm.Gru.start(np.ones(n))
    h = rng.normal(0, 1, (1, lm.HIDDEN)).astype(np.float32)
    assert np.exp(net.log_probabilities(np.repeat(h, n, axis=0), np.arange(n))).sum() == pytest.approx(1, abs=1e-4)
    sizes = [1, lm.WINDOW, lm.WINDOW + 1, 3 * lm.WINDOW + 5]
    words = rng.integers(0, n, sum(sizes))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for i, total in enumerate(lm._run(net, words, bounds)):
        state, want = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for w in words[bounds[i] : bounds[i + 1]]:
            want += net.log_probabilities(state, np.array([w]))[0]
            state, _ = net.step(state, np.array([w]))
        assert total == pytest.approx(want, rel=1e-4)


def test_scoring_works_on_pieces_of_bounded_size(monkeypatch):
    """However many documents are scored at once, an output layer gets 32 steps of 1,024 of them at most, and each score stays its own."""
    rng = np.random.default_rng(4)
    sizes = np.append(rng.integers(1, 60, 2500), 700)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words = rng.integers(0, lm.OTHER + 1, bounds[-1])
    net, seen, plain = lm.Gru.start(np.ones(lm.OTHER + 1)), [], lm._chosen_logs
    monkeypatch.setattr(lm, "_chosen_logs", lambda x, chosen: seen.append(x.size) or plain(x, chosen))
    got = lm._run(net, words, bounds)
    assert max(seen) <= 32 * 1024 * (lm.CLASSES + 1) and len(seen) < 200
    for i in (0, 1500, 2499, 2500):
        assert got[i] == pytest.approx(lm._run(net, words[bounds[i] : bounds[i + 1]], np.array([0, sizes[i]]))[0], rel=1e-5)


def test_words_are_found_and_summed_like_by_plain_search():
    rng = np.random.default_rng(5)
    ends = [np.iinfo(np.int64).min, -1, 0, 1, 2, 3, np.iinfo(np.int64).max]
    hashes = np.unique(np.append(rng.integers(*(x for x in (ends[0], ends[-1])), 4000), ends[1:-1:2]))
    vocabulary = lm.Vocabulary(hashes, np.ones(len(hashes)), np.arange(len(hashes)) % lm.OTHER)
    asked = np.concatenate([hashes, hashes + 1, ends])
    at, there = vocabulary.look_up(asked)
    assert there.tolist() == np.isin(asked, hashes).tolist() and (hashes[at[there]] == asked[there]).all()
    for words in (rng.integers(0, 30, 700), np.arange(700), np.full(700, lm.OTHER), rng.zipf(1.3, 700) % lm.OTHER):
        x = rng.normal(size=(3, 700, lm.HIDDEN))
        want = np.zeros((lm.OTHER + 1, 3 * lm.HIDDEN))
        np.add.at(want, words, x.transpose(1, 0, 2).reshape(700, -1))
        assert np.allclose(lm._sum_by_word(x, words), want)


def test_scores_equal_brute_force_and_learn_order(spark, folder):
    rng = random.Random(6)
    documents = []
    for i in range(300):
        at, words = rng.randrange(30), []
        for _ in range(rng.randint(5, 60)):
            at = (at + 1) % 30 if rng.random() < 0.9 else rng.randrange(30)
            words.append(f"Word{at}" if rng.random() > 0.05 else f"rare{rng.randrange(10**6)}")
        documents.append((i, " ".join(words)))
    edges = [(None, None), (None, "word1 unseen"), (9001, None), (9002, " \t"), (9003, "word1 word2 " * 3000), (9004, "zzz"), (9004, "zzz")]
    rows = documents + edges
    got = lm.op8_language_model(spark, folder(rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for (i, t), values in zip(rows, unigrams(rows), strict=True):
        want.setdefault(i, []).append((held_out(i, 7, 2), *values))
    for r in got:
        assert any((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and r["base_score"] == pytest.approx(w[4], rel=1e-9) for w in want[r["doc_id"]])
        assert r["score"] < 0 and math.isfinite(r["score"])
    own = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert len(own) > 20 and sum(r["score"] for r in own) > 0.9 * sum(r["base_score"] for r in own)


def slow_score(model: lm.LanguageModel, tokens: list[int]) -> float:
    """The network and the share-out of other words, token by token in plain loops."""
    net, known = model.network, {int(h): (int(n), int(c)) for h, n, c in zip(model.vocabulary.hashes, model.vocabulary.numbers, model.vocabulary.counts)}
    counts = {r["hash"]: r["n"] for r in model.counts.collect()}
    h, total, width = np.zeros(lm.HIDDEN), 0.0, lm.HIDDEN
    for token in tokens:
        number = known.get(token, (lm.OTHER, 0))[0]
        logits = net.class_weights.T.astype(float) @ h + net.class_bias
        total += logits[number // lm.PER_CLASS] - math.log(sum(math.exp(x) for x in logits))
        if number < lm.OTHER:
            own = net.word_weights[number // lm.PER_CLASS].T.astype(float) @ h + net.word_bias[number // lm.PER_CLASS]
            total += own[number % lm.PER_CLASS] - math.log(sum(math.exp(x) for x in own))
        else:
            total += math.log((counts.get(token, 0) + 1) / (model.tokens + model.distinct + 1) / model.other)
        x, u = net.inputs[number].astype(float), h @ net.recurrent.astype(float)
        z, r = (1 / (1 + np.exp(-(x[i * width : (i + 1) * width] + u[i * width : (i + 1) * width]))) for i in range(2))
        h = z * h + (1 - z) * np.tanh(x[2 * width :] + r * u[2 * width :])
    return total / math.log(10)


def test_scores_equal_a_network_of_plain_loops(spark, folder, monkeypatch):
    """Over words in the network, words outside it and unseen ones, with a part of the counts joined by hash."""
    monkeypatch.setattr(lm, "BROADCAST_WORDS", 1900)
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{int(2600 * rng.random() ** 2)}" for _ in range(rng.randint(1, 220)))) for i in range(160)] + [(900, "w1 unseen w1"), (901, None)]
    documents = spark.read.parquet(folder(rows) + "/documents.parquet")
    model = lm.LanguageModel(spark, documents.filter("doc_id % 7 <> 2"))
    assert 1700 < len(model.vocabulary.hashes) <= 1900 < model.distinct and (model.vocabulary.numbers == lm.OTHER).sum() > 100
    got = {r["doc_id"]: r["score"] for r in model.score(documents).collect()}
    for i, text in random.Random(1).sample(rows, 12) + rows[-2:]:
        (_, tokens, _), = lm._tokens(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"]), "text")
        assert got[i] == pytest.approx(slow_score(model, tokens.tolist()), rel=1e-4)


def test_every_training_document_moves_the_network(spark, folder):
    """No part of the rows is left out: words seen in one document alone change the weights of their input rows."""
    rows = [(i, f"only{i} " * 3 + "a b") for i in range(40)]
    model = lm.LanguageModel(spark, spark.read.parquet(folder(rows) + "/documents.parquet"))
    first = lm.Gru.start(np.zeros(lm.OTHER + 1)).inputs
    moved = np.abs(model.network.inputs - first).max(axis=1) > 0
    assert moved[model.vocabulary.numbers].all() and len(model.vocabulary.numbers) == 43


def test_rare_words_are_joined_alike(spark, folder, monkeypatch):
    monkeypatch.setattr(lm, "BROADCAST_WORDS", 4)
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(40))) for i in range(60)]
    got = {r["doc_id"]: r for r in lm.op8_language_model(spark, folder(rows)).collect()}
    for (i, _), (n, known, total, base) in zip(rows, unigrams(rows), strict=True):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, total) and got[i]["base_score"] == pytest.approx(base)


def test_language_model_without_training_rows(spark, folder):
    got = lm.op8_language_model(spark, folder([(None, "a b"), (None, None)])).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert lm.op8_language_model(spark, folder([])).count() == 0

"""Fuzzy spans, language weights and quality scores against plain loops over single texts."""

import bisect
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from switchboard.llm import language, licenses, quality
from switchboard.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edit_distance(a, b, most):
    """The number of edits between two texts, or some number beyond ``most``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        if min(row) > most:
            break
    return max(row[-1], min(row))


def edited(rng, text, edits):
    for _ in range(edits):
        k = rng.randrange(1, len(text) - 1)
        if text[k] != " ":
            text = text[:k] + rng.choice(["", "q", text[k] + "z"]) + text[k + 1:]
    return text


def test_fuzzy_spans_equal_all_runs_of_words_within_the_edits():
    rng = random.Random(21)
    notices = (*licenses.BASE, *licenses.MORE)
    scanner = licenses.Scanner(notices)
    found_some = 0
    for _ in range(25):
        parts = []
        for notice in rng.sample(notices, 3):
            parts += [" ".join(rng.choice(["the", "a", "software", "license", "code"]) for _ in range(rng.randrange(6))), edited(rng, notice.words, rng.randrange(notice.edits + 3))]
        words = " ".join(parts).split()
        text = " ".join(words)
        spans = [(k, *(text.count(" ", 0, x) for x in (a, b - 1)), e) for k, a, b, e in scanner.scan(text)]
        for k, first, last, edits in spans:
            notice = notices[k]
            assert edit_distance(notice.words, " ".join(words[first:last + 1]), edits) <= edits <= notice.edits
        for k, notice in enumerate(notices):
            own = [(a, b) for n, a, b, _ in spans if n == k]
            for first in range(len(words)):
                for last in range(first, len(words)):
                    run = " ".join(words[first:last + 1])
                    if abs(len(run) - len(notice.words)) <= notice.edits and edit_distance(notice.words, run, notice.edits) <= notice.edits:
                        found_some += 1
                        assert any(a <= last and first <= b for a, b in own), (notice, run)
    assert found_some > 40


def plain_grams(text):
    low = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode())
    low = b"  " + low + b"  "
    runs = [low[k:k + 4] for k in range(len(low) - 3)]
    return Counter((int.from_bytes(r, "big") * 0x9E3779B1 % 2**32) >> 19 for r in runs if r != b"    ")


def plain_mixture(model, text):
    """Shares of languages by the same rules, one text and one n-gram at a time."""
    counts, kinds = plain_grams(text), len(model.languages)
    n = sum(counts.values())
    if not n:
        return [0.0] * kinds

    def likelihood(weight):
        return sum(c * math.log(sum(w * p for w, p in zip(weight, model.probability[:, g], strict=True))) for g, c in counts.items())

    def steps(chosen):
        weight = [1 / len(chosen) if k in chosen else 0.0 for k in range(kinds)]
        for _ in range(language.STEPS):
            new = [0.0] * kinds
            for g, c in counts.items():
                part = [w * p for w, p in zip(weight, model.probability[:, g], strict=True)]
                for k in range(kinds):
                    new[k] += c * part[k] / sum(part)
            weight = [x / n for x in new]
        return weight, likelihood(weight)

    alone = [likelihood([float(k == j) for k in range(kinds)]) for j in range(kinds)]
    value = max(alone)
    best = [float(j == alone.index(value)) for j in range(kinds)]
    price = 0.5 * math.log(n) + language.LEAST_GAIN * n
    full, likely = steps(range(kinds))
    if likely - value > price:
        order = sorted(range(kinds), key=lambda k: -full[k])
        for size in range(2, kinds + 1):
            weight, likely = steps(order[:size])
            if likely - (size - 1) * price > value:
                best, value = weight, likely - (size - 1) * price
    return best


def test_language_weights_equal_plain_loops():
    rng = random.Random(4)
    kinds = {"aa": "stone river harbour quiet morning walk", "bb": "fluß über straße größer nächte wärme", "cc": "ленты река утро город мост"}
    prose = {name: [" ".join(rng.choice(v.split()) for _ in range(80)) for _ in range(6)] for name, v in kinds.items()}
    seen = [sum((plain_grams(t) for t in prose[name]), Counter()) for name in kinds]
    count = np.array([[own[g] for g in range(language.BUCKETS)] for own in seen], float)
    model = language.Model(list(kinds), (count + language.SMOOTH) / (count.sum(axis=1, keepdims=True) + language.SMOOTH * language.BUCKETS))
    texts = [prose["aa"][0], prose["bb"][1][:40], f"{prose['aa'][1]} {prose['bb'][2]}", " ".join(prose[n][3] for n in kinds), "12 34 !!", "", "Q", "Ω stone", prose["cc"][0].upper()]
    data, at = W.text_bytes(pa.array(texts))
    got = language.proportions(model, data, at)
    for weights, text in zip(got, texts, strict=True):
        assert weights.tolist() == pytest.approx(plain_mixture(model, text), abs=1e-9)
    assert (got[2] > 0.2).tolist() == [True, True, False] and (got[3] > 0.2).all()


def plain_features(text):
    raw, words = text.encode(), [w.encode() for w in WORD.findall(text)]
    per = lambda part, whole: part / max(whole, 1)
    of = lambda test: per(sum(1 for b in raw if test(b)), len(raw))
    lines = [x for x in raw.split(b"\n") if x]
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    symbol = lambda b: b in quality.FIXED_SYMBOLS
    return [math.log1p(len(words)), per(sum(map(len, words)), len(words)), of(symbol), of(lambda b: 48 <= b < 58), of(lambda b: 65 <= b < 91),
            of(lambda b: b in b".,;:!?'\"()-"), of(lambda b: 128 <= b < 192), per(len(set(words)), len(words)),
            per(max(Counter(words).values(), default=0), len(words)), per(len(words), len(lines)), per(len(lines) - len(set(lines)), len(lines)),
            per(len(grams) - len(set(grams)), len(grams)), per(sum(any(map(symbol, w)) for w in words), len(words)),
            per(sum(len(w) > 20 for w in words), len(words)), math.log1p(len(raw))]


def test_quality_scores_equal_sums_of_table_entries():
    rng = random.Random(8)
    vocabulary = ["Harbour", "stone,", "a", "the", "#1", "über", "x=3", "internationalisations", "1984", "(so)", "\n", "\n\n", "\t", "a\nb"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(120))) for _ in range(300)] + ["", " \n ", "one", "é" * 50]
    data, at = W.text_bytes(pa.array(texts))
    x = quality.features(data, at)
    assert x.shape == (len(texts), len(quality.FEATURES))
    for got, text in zip(x, texts, strict=True):
        assert got.tolist() == pytest.approx(plain_features(text), abs=1e-12)
    label = np.array([float(t.count("#") * 3 > t.count("the") + rng.random()) for t in texts])
    model = quality.fit(x, label)
    assert model.pairs and np.abs(model.tables).max() > 0
    for got, row in zip(model.score(x), x.tolist(), strict=True):
        bins = [bisect.bisect_right(b.tolist(), v) for b, v in zip(model.bounds, row, strict=True)]
        total = model.base + sum(model.tables[k][b] for k, b in enumerate(bins)) + sum(t[bins[i]][bins[j]] for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True))
        assert got == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)

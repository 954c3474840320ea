"""Collocations against brute force: awkward texts, routes of several words, ties; the sort on its own."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from revtide.llm import collocations as C

PIECE, GAP = re.compile("[.,;:!?\n-\r]"), re.compile("[ \t]+")


def counted(documents):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in documents:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate({i: i + 32 for i in range(65, 91)})):
            words = [w for w in GAP.split(piece) if w]
            totals[lang] += len(words)
            for size in range(1, 6):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts, totals


def expected(documents, least):
    counts, totals = counted(documents)
    out = []
    for lang, own in counts.items():
        held = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in held.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= own[p[i:j]]}
        for p, a in held.items():
            if p not in inside:
                score, cut = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                out.append((lang, " ".join(p), a, own[p[:cut]], own[p[cut:]], totals[lang], score))
    return sorted(out)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(5)
    words = ["the", "The", "of", "aé", "B", "c\x1cd", "x" * 3000, "zwei", "中文", "of a", "rare1", "rare2"]
    rows = [(None, None), ("en", ""), (None, " \t . , "), ("en", None), ("", "the of the of")]
    for i in range(400):
        text = "".join(rng.choices(words, [9, 3, 6, 4, 4, 2, 0.2, 3, 2, 1, 0.2, 0.2])[0] + rng.choice([" ", " ", "  ", "\t", ".", "\n", "\x0b", ", "]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "en", "en", "de", None]), text))
    rows += [("en", "New York City is big. New York City")] * 60 + [("de", "the of aé B zwei the of aé B zwei " * 40)]
    return rows


def frame(spark, documents):
    return spark.createDataFrame([(i, l, t, i, "x", 0.5) for i, (l, t) in enumerate(documents)], "doc_id long, lang string, text string, hash long, words string, score double").repartition(3)


@pytest.mark.parametrize("least, rows_per_group", [(5, 2_000_000), (3, 40), (20, 1)])
def test_equal_to_brute_force(spark, documents, monkeypatch, least, rows_per_group):
    monkeypatch.setattr(C, "WORDS_PER_FLUSH", 500)
    got = C.collocations(frame(spark, documents), least=least, rows_per_group=rows_per_group)
    assert sorted(tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()) == expected(documents, least)


def test_empty_tables(spark):
    assert C.collocations(frame(spark, [])).count() == 0
    assert C.collocations(frame(spark, [(None, None), ("en", "one word. two")])).count() == 0


def test_sort_reports_counts_and_abandons_light_partitions():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 4, (5, 500)).astype(np.int32)
    rows[3:, rng.random(500) < 0.4] = 0
    rows[4, rng.random(500) < 0.3] = 0
    n = rng.integers(1, 5, 500)
    want = Counter()
    for i in range(500):
        for size in range(2, 6):
            if (rows[:size, i] > 0).all():
                want[tuple(rows[:size, i])] += int(n[i])
    got = {tuple(words): (size, weight) for size, words, weight in C.three_way_sort(rows, n, 30)}
    assert got == {p: (len(p), a) for p, a in want.items() if a >= 30}
    partial = {tuple(words): weight for _, words, weight in C.three_way_sort(rows, n, 10**9, whole_from=3)}
    assert partial == {p: a for p, a in want.items() if len(p) < 3}


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    counts = [([1, 2], 3_000_000_000_000), ([1], None), ([2], None)]
    words = spark.createDataFrame([("en", 1, "a", 4_000_000_000_000), ("en", 2, "b", 5_000_000_000_001), ("en", 3, "c", 90_000_000_000_000)], C.WORDS)
    phrases = spark.createDataFrame(counts[:1], "words array<long>, a long")
    monkeypatch.setattr(C, "phrase_counts", lambda *a, **b: (words, phrases))
    row = C.collocations(frame(spark, [])).first()
    n = 99_000_000_000_001
    assert (row["phrase"], row["n"], row["score"]) == ("a b", n, 1000 * 3_000_000_000_000 * n // (4_000_000_000_000 * 5_000_000_000_001))

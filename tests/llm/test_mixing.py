"""Mixing by pivotal rounding: targets against a plain iteration, masses, determinism, awkward rows."""

import re
from collections import Counter
from fractions import Fraction

import pytest

from revtide.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def shared(sizes, weights=mixing.WEIGHTS, share=Fraction(3, 2), most=2):
    """Share by weight, cut what is above the limit, share the excess among the rest, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got = dict.fromkeys(order, Fraction(0))
    excess, open_ = share * sum(sizes.values()), list(order)
    while excess and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            got[s] += excess * weight[s] / total
        excess = sum(max(Fraction(0), got[s] - most * sizes[s]) for s in open_)
        got = {s: min(v, Fraction(most * sizes[s])) for s, v in got.items()}
        open_ = [s for s in open_ if got[s] < most * sizes[s]]
    return got


def check(documents, mixed):
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in documents.select("doc_id", "source", "text").collect()]
    got = mixed.collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(rows)
    sizes, largest, taken = Counter(), Counter(), Counter()
    for _, source, size in rows:
        sizes[source] += size
        largest[source] = max(largest[source], size)
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert abs(r["copies"] - rate) < 1 + 1e-9 or not r["size"]
    for source, target in shared(sizes).items():
        assert next(r["target"] for r in got if r["source"] == source) == pytest.approx(float(target))
        assert abs(taken[source] - float(target)) <= largest[source] / 2 + 1e-6
    return got


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, source string, text string, rank long, held double, mark string, m int").repartition(3)


def test_mix_of_the_test_table(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = check(documents, mixing.mix(documents))
    again = mixing.mix(documents.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_hot_source_tree_and_awkward_rows(spark):
    data = [(i, "hot", "w " * (1 + i * 7 % 40), i, 0.5, "x", 1) for i in range(700)]
    data += [(i, f"s{i % 23}", "a b c " * (i % 5), 0, None, None, None) for i in range(300)]
    data += [(None, None, "a b c", 0, 0.0, "", 0), (None, "", None, 0, 0.0, "", 0), (3, "only empty", "", 0, 0.0, "", 0)]
    data += [(7, "copies", "one two three", 0, 0.0, "", 0)] * 1000
    check(rows(spark, data), mixing.mix(rows(spark, data), fanout=4))


def test_salted_sources_and_blocks_of_copies_change_nothing(spark, monkeypatch):
    data = [(i % 9, f"s{i % 4}", "w " * (i % 6), 0, 0.0, "", 0) for i in range(200)]
    plain = sorted(map(str, mixing.mix(rows(spark, data)).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    monkeypatch.setattr(mixing, "COPIES_PER_ROW", 2)
    assert sorted(map(str, mixing.mix(rows(spark, data)).collect())) == plain


def test_expectations_are_kept(spark):
    """Sixty equal sources are sixty trials: every document is taken as often as its source's rate says, on average."""
    data = [(100 * s + i, f"s{s:02d}", "w " * (1 + i % 7), 0, 0.0, "", 0) for s in range(60) for i in range(20)]
    got = mixing.mix(rows(spark, data), weights=(1,), share=(1, 2)).collect()
    for i in range(20):
        assert 0.25 < sum(r["copies"] for r in got if r["doc_id"] % 100 == i) / 60 < 0.75


def test_empty_and_weightless_tables(spark):
    assert mixing.mix(rows(spark, [])).count() == 0
    got = mixing.mix(rows(spark, [(1, "a", None, 0, 0.0, "", 0), (2, "b", " ", 0, 0.0, "", 0)])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in got] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mixing.mix(rows(spark, []), share=(5, 2))


def test_no_python_workers(spark):
    plan = mixing.op11_source_mix(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""The prefix trie against brute force, with long, equal, nested, missing and empty conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from revtide.llm import trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth long, id string, n int"


def expected(table):
    turns = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    whole = {}
    for c in original:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(original.get(c - c % 100, [])[:h] + original[c][h:])
    members = defaultdict(list)
    for c, own in whole.items():
        for d in range(len(own) + 1):
            members[own[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in children[node]) if children[node] else 1
        saved = sum(below[k][1] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        below[node] = (leaves, saved)
    out = []
    for node, own in members.items():
        ended = ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else -1
        out.append((min(own), len(node), parent, len(own), len(children[node]), *below[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out)


def nodes(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def frame(spark, table):
    return spark.createDataFrame([(*row, 1, "x", 2) for row in table], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(250, 260), 4099, 9000, 10**12]:
        if c % 17 != 3:
            stem = rng.choice(["abc", "abd", "xyz", "abcabcabc"])
            said = stem[: rng.randrange(len(stem) + 1)] + rng.choice(["", "", "pq", "pqr", "s" * rng.randrange(30)])
            rows += [(c, i, "user" if i % 2 else None, x * (1 + i % 3)) for i, x in enumerate(said)]
    rows += [(77, i, "u", "t" * (i % 4)) for i in range(150)] + [(88, i, "u", "t" * (i % 4)) for i in range(120)]
    rows += [(1234, None, "u", None), (1234, 5, None, "é中"), (1234, -1, "u", "late"), (None, 1, "u", "nobody")]
    rows += [(500 + i, 0, "u", "common") for i in range(20)]
    return rows


def test_equal_to_brute_force(spark, table):
    assert nodes(T.trie(frame(spark, table))) == expected(table)


def test_long_conversations_are_sliced(spark, table):
    some = [r for r in table if r[0] in (77, 88, 0, 100)]
    assert nodes(T.trie(frame(spark, some), rows_per_slice=4)) == expected(some)


def test_empty_and_turnless(spark):
    assert T.trie(frame(spark, [])).count() == 0
    only = [(c, 0, "u", "x") for c in range(101, 110)]
    assert nodes(T.trie(frame(spark, only))) == expected(only)


def test_two_fattest(spark):
    rows = spark.createDataFrame([(a, b) for a in range(70) for b in range(a + 1, 71)], "a long, b long")
    for r in rows.select("a", "b", T.two_fattest(rows.a, rows.b).alias("f")).collect():
        assert r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x)


def test_probes_follow_the_length_in_bits(spark, table, monkeypatch):
    asked = []
    plain = T._locate
    monkeypatch.setattr(T, "_locate", lambda w, n, p, probes: asked.append(probes) or plain(w, n, p, probes))
    assert T.trie(frame(spark, table)).count() == len(expected(table))
    assert asked and len(asked) <= 12 and max(asked) <= 8  # 150 turns have 8 bits

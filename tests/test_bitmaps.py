"""Pairs counted by bitmaps of pages against the pair timeline, and that pairs stay where they were formed."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from frames import revision, revisions, rows, samples
from test_pairs import COUNTS, TAGS

from revtide.operators import cells, coedit, graph, pairs, rollup, talk
from revtide.plans import jobs
from revtide.schemas import SAMPLE_KEY


@pytest.fixture(scope="module")
def history():
    """Some 80 pages, two of them crowded, a user with a third of all edits and hundreds on one page, unnamed editors."""
    rng = random.Random(5)
    out = []
    for i in range(1500):
        user = 1 if i % 3 == 0 else rng.choice([None, 2, 3, 4, 5, 6, 7])
        page = rng.choice([2, 2, 4, 5, *range(6, 80)])
        if user == 1 and i % 2:
            page = 2
        at = rng.randrange(0, 500)
        out.append(revision(i, at, user=user, page=page, ns=(0 if at < 250 else 2) if page == 6 else page % 2))
    return out


@pytest.mark.parametrize("crowded, block, period", [(1, 500, "1 YEAR"), (8, 2, "9 DAYS"), (10**6, 3, "1 YEAR")])
def test_counts_equal_those_of_the_timeline(spark, history, monkeypatch, crowded, block, period):
    monkeypatch.setattr(pairs, "CROWDED", crowded)
    frame, tagged = revisions(spark, history), samples(spark, TAGS)
    expected = pairs.sample_pair_counts(pairs.pair_timeline(tagged, frame, frame, period=period)).cache()
    found = pairs.sample_users(tagged, frame, frame, period=period)
    counted = pairs.counted_pairs(found, users_per_block=block, pairs_per_task=5).cache()
    assert rows(pairs.keyed(counted, found), *COUNTS) == rows(expected, *COUNTS)
    assert max(r.revisions_a for r in expected.collect()) > (256 if period == "1 YEAR" else 16)
    columns = [*SAMPLE_KEY, "event_user_id", "event_user_id_r", "coedit_ratio", "coedit_revisions_ratio"]
    directed = pairs.directed_features(expected)
    assert rows(pairs.keyed(pairs.directed_pairs(counted), found), *columns) == rows(directed, *columns)


def test_one_pass_rolls_up_both_kinds(spark, history):
    frame, tagged = revisions(spark, history), samples(spark, TAGS)
    counts = pairs.sample_pair_counts(pairs.pair_timeline(tagged, frame, frame)).cache()
    expected = rollup.rollup_collab(pairs.directed_features(counts), coedit.undirected_pairs(counts, SAMPLE_KEY))
    got = jobs.collab_rollup(pairs.sample_users(tagged, frame, frame))
    assert got.columns == expected.columns
    for a, b in zip(rows(got, *got.columns), rows(expected, *got.columns), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])


def test_pairs_are_not_shuffled(spark, history):
    frame, tagged = revisions(spark, history), samples(spark, TAGS)
    counted = pairs.counted_pairs(pairs.sample_users(tagged, frame, frame), pairs_per_task=1)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join|Exchange|Window", plan[: plan.index("Generate")])
    assert counted.rdd.getNumPartitions() > 20


def test_without_samples(spark, history):
    frame = revisions(spark, history)
    found = pairs.sample_users(samples(spark, TAGS).limit(0), frame, frame)
    assert pairs.counted_pairs(found).count() == 0


def test_tasks_of_a_pair_join_follow_the_number_of_pairs(spark):
    users = spark.range(200).selectExpr("id % 2 as page_id", "id as event_user_id", "1L as revisions_count", "0 as page_namespace")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        formed = coedit.met(users, ["page_id"], ["revisions_count"], 25, pairs_per_task=500)  # 2 x 4,950 pairs
        assert formed.rdd.getNumPartitions() == 20 and formed.count() == 9_900
        assert coedit.pair_counts(users, users_per_block=25).count() == 9_900
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert coedit.met(users.limit(0), ["page_id"], ["revisions_count"], 25).count() == 0


def test_only_words_that_may_begin_a_phrase_are_shuffled(spark):
    texts = spark.createDataFrame([(i, "a word " * 50 + f"rare{i} in fact rare{i}, in  part") for i in range(40)], "i int, text string")
    listed = [("few", f"rare{i}", "any", 0) for i in range(20)] + [("lead", "a", "start", 0), ("long", "in fact", "any", 0), ("long", "part", "any", 1)]
    phrases = spark.createDataFrame(listed, "strategy string, phrase string, position string, rank int")
    counts = [talk.phrase_counts(texts, ["i"], phrases, max_broadcast=limit) for limit in (0, 100)]
    assert rows(counts[0], "i", "strategy", "n") == rows(counts[1], "i", "strategy", "n")
    assert rows(counts[0].filter("i = 3"), "strategy", "n") == [("few", 2), ("lead", 1), ("long", 2)]
    places = texts.select("i", F.posexplode(F.split("text", r"[\s,]+")).alias("_at", "_word0"))
    kept = talk._beginning(places, phrases.filter("strategy = 'few'").select(F.col("phrase").alias("_word0")))
    assert kept.filter("i < 20").count() == 40 and kept.count() < 60


def test_edges_with_a_known_bound_are_read_once(spark):
    vertices = spark.createDataFrame([("g", v, 1.0) for v in range(4)], "k string, vertex long, x double")
    read = spark.sparkContext.accumulator(0)

    def row(a):
        read.add(1)
        return ("g", a, (a + 1) % 4, 0.5, 0.25)

    lines = spark.sparkContext.parallelize(range(4), 2).map(row)
    edges = spark.createDataFrame(lines, "k string, src long, dst long, coedit_ratio double, coedit_revisions_ratio double")
    got = graph.graph_propagate(vertices, edges, ["x"], 2, ["k"], size=4)
    assert rows(got, "vertex", "x") == [(v, 1.0) for v in range(4)] and read.value == 4


@pytest.mark.parametrize("crowded, block", [(1, 500), (10**6, 2), (3, 3)])
def test_moments_of_cells_make_the_roll_up_of_their_pairs(spark, history, monkeypatch, crowded, block):
    """A cell returns one row whatever the number of its pairs, in parts of any size."""
    monkeypatch.setattr(pairs, "CROWDED", crowded)
    frame, tagged = revisions(spark, history), samples(spark, TAGS)
    found = pairs.sample_users(tagged, frame, frame)
    once = [F.col("num_common_pages"), F.col("articles_a").alias("num_common_articles")]
    directed = pairs.directed_pairs(pairs.counted_pairs(found), once)
    columns = ["num_common_pages", "num_common_articles", "coedit_ratio", "coedit_revisions_ratio"]
    directed = directed.withColumns({c: F.when(F.col("first"), F.col(c)) for c in columns[:2]})
    expected = rollup.rollup(directed, columns, ["sample"], F.count_if("first").alias("undirected"))
    moments = pairs.pair_moments(found, users_per_block=block, pairs_per_task=5).cache()
    got = rollup.merged(moments, columns, ["sample"], F.sum("undirected").alias("undirected")).filter("undirected > 0")
    assert got.columns == expected.columns
    for a, b in zip(rows(got, *got.columns), rows(expected.filter("undirected > 0"), *got.columns), strict=True):
        assert [x is None for x in a] == [x is None for x in b]
        assert [x or 0 for x in a] == pytest.approx([x or 0 for x in b], abs=1e-12)
    assert (moments.groupBy("sample").count().agg(F.max("count")).first()[0] == 1) == (block == 500)


def test_users_over_several_batches_stay_whole():
    held = [(0, 1, 5, 2), (0, 1, 6, -1), (0, 2, 5, 1), (1, 2, 5, 3), (1, 2, 7, 0), (1, 2, 8, 1), (1, 3, 5, 1)]
    names = ["sample", "event_user_id", "page", "edits"]
    for size in (1, 2, 3, 7):
        parts = [held[i : i + size] for i in range(0, len(held), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names) for part in [*parts]]
        got = [tuple(r.values()) for b in cells.user_lists(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
        assert got == [(0, 1, [5, 6], [2, -1]), (0, 2, [5], [1]), (1, 2, [5, 7, 8], [3, 0, 1]), (1, 3, [5], [1])]
    assert list(cells.user_lists(iter([]))) == []

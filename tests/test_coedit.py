import itertools
import math
import random
from collections import Counter, defaultdict
from datetime import timedelta

import pytest
from frames import hours, revision, revisions, rows, samples
from pyspark.sql import functions as F

from revtide.operators import coedit, editor, sampling
from revtide.schemas import SAMPLE_KEY
from revtide.sources import testtables

SF = "/root/testdata/sf0.001"
HISTORY = [
    revision(1, 0, user=1, page=2), revision(2, 1, user=2, page=2), revision(3, 2, user=1, page=2),
    revision(4, 3, user=3, page=4), revision(5, 4, user=1, page=4),
    revision(6, 5, user=2, page=3, ns=1), revision(7, 6, user=3, page=3, ns=1),
    revision(8, 7, user=None, page=2),
]


def test_pairs_and_ratios(spark):
    users = coedit.page_user_counts(revisions(spark, HISTORY)).cache()
    directed = coedit.directed_features(users)
    assert rows(directed, "event_user_id", "event_user_id_r", "coedit_ratio", "coedit_revisions_ratio") == [
        (1, 2, 0.5, 2 / 3), (1, 3, 0.5, 1 / 3), (2, 1, 1.0, 1.0), (3, 1, 1.0, 1.0),
    ]
    # Users 2 and 3 only share a talk page.
    undirected = coedit.undirected_features(users)
    assert sorted((tuple(r.pair), r.num_common_pages, r.num_common_articles) for r in undirected.collect()) == [
        ((1, 2), 1, 1), ((1, 3), 1, 1),
    ]
    pages = coedit.pair_pages(coedit.pair_counts(users))
    assert rows(pages.filter("event_user_id = 2"), "event_user_id_r", "num_common_pages") == [(1, 1), (3, 1)]


@pytest.mark.parametrize("users_per_block", [1, 3, 1000])
def test_blocks_give_each_ordered_pair_once(spark, users_per_block):
    rng = random.Random(3)
    data = {(0, u) for u in range(25)} | {(rng.randrange(1, 6), rng.randrange(25)) for _ in range(40)}
    frame = spark.createDataFrame(
        [(p, u, 1 + (p + u) % 4, p % 2) for p, u in data],
        "page_id long, event_user_id long, revisions_count long, page_namespace int",
    )
    got = coedit.user_interactions(frame, users_per_block=users_per_block)
    by_page = defaultdict(list)
    for p, u in data:
        by_page[p].append(u)
    expected = sorted((p, a, b) for p, us in by_page.items() for a, b in itertools.permutations(us, 2))
    assert rows(got, "page_id", "event_user_id", "event_user_id_r") == expected


def test_invariants_on_order_lines(spark):
    users = coedit.page_user_counts(testtables.coedit_history(spark, SF)).cache()
    directed = coedit.directed_features(users)
    sums = directed.groupBy("event_user_id").agg(F.sum("coedit_ratio").alias("a"), F.sum("coedit_revisions_ratio").alias("b"))
    for r in sums.collect():
        assert r.a == pytest.approx(1) and r.b == pytest.approx(1)
    assert 2 * coedit.undirected_features(users).count() == directed.count()


def test_totals_equal_sums_over_pairs(spark):
    users = coedit.page_user_counts(testtables.coedit_history(spark, SF)).cache()
    pairs = coedit.pair_articles(coedit.pair_counts(users))
    summed = pairs.groupBy("event_user_id").agg(
        F.sum("num_common_articles").alias("editor_pages_total"), F.sum("num_revisions_articles").alias("editor_revisions_total")
    )
    columns = ["event_user_id", "editor_pages_total", "editor_revisions_total"]
    assert rows(summed, *columns) == rows(coedit.editor_totals(users), *columns)


def _brute_editor(history, sample):
    """Editor features of one sample, by looping."""
    template, page, tag = sample
    upto = [r for r in history if r.event_timestamp <= tag]
    result = {}
    for user in {r.event_user_id for r in upto if r.page_id == page and r.event_user_id is not None}:
        mine = sorted((r for r in upto if r.event_user_id == user), key=lambda r: (r.event_timestamp, r.revision_id))
        counts = Counter(r.page_id for r in mine)
        entropy = -sum(c / len(mine) * math.log2(c / len(mine)) for c in counts.values())
        articles = sum(r.page_namespace == 0 for r in mine)
        talks = sum(r.page_namespace == 1 for r in mine)
        result[user] = (
            mine[-1].num_groups, len(counts), len(mine), sum(r.revision_is_identity_revert for r in mine),
            (articles + 1) / (talks + 1), entropy,
        )
    return result


@pytest.mark.parametrize("size", [None, 2])
def test_editor_features_against_loops(spark, size):
    # One user makes a third of all edits.
    history = testtables.revisions(spark, SF).withColumn(
        "event_user_id", F.when(F.col("revision_id") % 3 == 0, 5).otherwise(F.col("event_user_id"))
    )
    tagged = testtables.samples(spark, SF)
    raw = history.collect()
    got = editor.editor_features(tagged, history, history, rows_per_slice=size).collect()
    found = defaultdict(dict)
    for r in got:
        found[tuple(r[k] for k in SAMPLE_KEY)][r.event_user_id] = (
            r.num_groups, r.num_articles, r.num_edits, r.num_reverts_by_others, r.talk_article_ratio,
            r.contribution_frac_entropy,
        )
    for sample in tagged.select(*SAMPLE_KEY).collect():
        expected = _brute_editor(raw, sample)
        mine = found[tuple(sample)]
        assert mine.keys() == expected.keys()
        for user, values in expected.items():
            assert mine[user] == pytest.approx(values, abs=1e-9)


@pytest.mark.parametrize("size", [None, 2])
def test_page_users_in_trailing_periods_against_loops(spark, size):
    history = testtables.revisions(spark, SF).withColumn(
        "event_user_id", F.when(F.col("revision_id") % 3 == 0, 5).otherwise(F.col("event_user_id"))
    )
    tagged = testtables.samples(spark, SF)
    raw = history.collect()
    expected = Counter()
    for s in tagged.select(*SAMPLE_KEY).collect():
        upto = [r for r in raw if r.event_timestamp <= s.tag_date]
        users = {r.event_user_id for r in upto if r.page_id == s.page_id and r.event_user_id is not None}
        for r in upto:
            if r.event_user_id in users and r.event_timestamp >= s.tag_date - timedelta(days=4):
                expected[(*s, r.page_id, r.event_user_id)] += 1
    got = coedit.sample_page_users(tagged, history, history, period="4 DAYS", rows_per_slice=size)
    columns = [*SAMPLE_KEY, "edited_page_id", "event_user_id", "revisions_count"]
    assert rows(got, *columns) == sorted((*k, n) for k, n in expected.items())


def test_sample_editors_start_with_their_first_edit(spark):
    tagged = samples(spark, [("advert", 2, 0, None, 1), ("advert", 2, 1, None, 1)])
    got = sampling.sample_editors(tagged, revisions(spark, HISTORY))
    assert rows(got, "tag_date", "event_user_id") == [(hours(0), 1), (hours(1), 1), (hours(1), 2)]


def test_filters_drop_unknowns(spark):
    frame = spark.createDataFrame(
        [(1, []), (2, ["name"]), (3, None), (None, [])], "event_user_id long, event_user_is_bot_by array<string>"
    )
    assert rows(editor.exclude_bots(frame).filter("event_user_id is not null"), "event_user_id") == [(1,)]
    assert rows(editor.exclude_users(frame, [1]), "event_user_id") == [(2,), (3,)]


def test_concentration_in_both_forms(spark):
    history = revisions(spark, HISTORY)
    per_row = coedit.concentration_ratios(history).filter("page_id = 2")
    assert {r.concentration_ratio for r in per_row.collect()} == {2 / 3} and per_row.count() == 4
    users = coedit.page_user_counts(history)
    pairs = coedit.user_interactions(users)
    expected = pairs.groupBy("page_id").agg(
        F.countDistinct("event_user_id").alias("num_editors"), F.sum("revisions_count").alias("num_revisions")
    )
    got = coedit.concentration_ratios_pairs(users)
    assert rows(got, "page_id", "num_editors", "num_revisions") == rows(expected, "page_id", "num_editors", "num_revisions")

"""Pair timelines of samples against loops over plain rows, and how often pairs are formed."""

import itertools
import random
import re
from collections import Counter, defaultdict
from datetime import timedelta

import pytest
from frames import hours, revision, revisions, rows, samples
from pyspark.sql import functions as F

from revtide.operators import coedit, pairs
from revtide.plans.registry import QUERIES
from revtide.schemas import SAMPLE_KEY

COUNTS = [*SAMPLE_KEY, "user_a", "user_b", "num_common_pages", "articles_a", "articles_b", "revisions_a", "revisions_b"]


@pytest.fixture(scope="module")
def history():
    """Three weeks, a user with a third of all edits, ties in time, unnamed editors, a page that changes its namespace."""
    rng = random.Random(8)
    out = []
    for i in range(400):
        user = 1 if i % 3 == 0 else rng.choice([None, 2, 3, 4, 5, 6, 7])
        page = rng.choice([2, 2, 2, 4, 5, 6, 7, 9])
        at = rng.randrange(0, 500)
        out.append(revision(i, at, user=user, page=page, ns=(0 if at < 250 else 2) if page == 6 else page % 2))
    return out


TAGS = [("advert", p, h, p + 1, 1) for p in (2, 4, 6) for h in (40, 100, 101, 300, 499)] + [("weasel", 2, 100, 3, 0), ("weasel", 80, 100, 81, 0)]


def looped(history, tagged, period):
    """Per sample and page: each editor's edits in the period and the namespace of the first of them."""
    out = {}
    for key in tagged:
        template, page, tag = key
        editors = {r[3] for r in history if r[0] == page and r[2] <= tag and r[3] is not None}
        held = defaultdict(dict)
        for r in sorted(history, key=lambda r: (r[2], r[1])):
            if r[3] in editors and tag - period <= r[2] <= tag:
                n, ns = held[r[0]].get(r[3], (0, r[4]))
                held[r[0]][r[3]] = (n + 1, ns)
        out[key] = held
    return out


@pytest.mark.parametrize("period, days, block", [("1 YEAR", 365, 1000), ("4 DAYS", 4, 2)])
def test_counts_and_interactions_against_loops(spark, history, period, days, block):
    frame, tagged = revisions(spark, history), samples(spark, TAGS)
    line = pairs.pair_timeline(tagged, frame, frame, period=period, users_per_block=block, rows_per_slice=16)
    keys = [(r["template"], r["page_id"], r["tag_date"]) for r in tagged.collect()]
    counts, met = [], []
    for key, held in looped(history, keys, timedelta(days=days)).items():
        total = defaultdict(lambda: [0] * 5)
        for page, users in held.items():
            for a, b in itertools.permutations(sorted(users), 2):
                met.append((*key, page, a, *users[a], b, *users[b]))
                if a < b:
                    (n, ns), (m, ms) = users[a], users[b]
                    row = (1, ns == 0, ms == 0, n * (ns == 0), m * (ms == 0))
                    total[a, b] = [x + y for x, y in zip(total[a, b], row)]
        counts += [(*key, a, b, *v) for (a, b), v in total.items()]
    assert rows(pairs.sample_pair_counts(line), *COUNTS) == sorted(counts)
    columns = [*SAMPLE_KEY, "edited_page_id", "event_user_id", "revisions_count", "page_namespace", "event_user_id_r", "revisions_count_r", "page_namespace_r"]
    assert rows(pairs.sample_interactions(line), *columns) == sorted(met)


def test_directed_features_equal_those_from_page_users(spark, history):
    frame, tagged = revisions(spark, history), samples(spark, TAGS)
    users = coedit.sample_page_users(tagged, frame, frame, period="9 DAYS").cache()
    expected = coedit.directed_features(users, SAMPLE_KEY, page="edited_page_id")
    got = pairs.directed_features(pairs.sample_pair_counts(pairs.pair_timeline(tagged, frame, frame, period="9 DAYS")))
    columns = [*SAMPLE_KEY, "event_user_id", "event_user_id_r", "coedit_ratio", "coedit_revisions_ratio"]
    assert rows(got, *columns) == rows(expected, *columns)


def test_pairs_are_formed_once_and_nothing_is_hinted(spark, history, monkeypatch):
    calls = []
    plain = coedit.met
    monkeypatch.setattr(coedit, "met", lambda *a, **b: calls.append(a) or plain(*a, **b))
    frame, tagged = revisions(spark, history), samples(spark, TAGS)
    counts = pairs.sample_pair_counts(pairs.pair_timeline(tagged, frame, frame))
    pairs.directed_features(counts).join(coedit.undirected_pairs(counts, SAMPLE_KEY), SAMPLE_KEY).count()
    assert len(calls) == 1
    assert "hint" not in counts._jdf.queryExecution().optimizedPlan().toString()
    # A distinct pair asks once, whatever the number of its samples.
    line = pairs.pair_timeline(tagged, frame, frame)
    repeated = line.intervals.groupBy("user_a", "user_b", "page_id", "from_at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    assert repeated.isEmpty()


def test_without_samples_or_pairs(spark, history):
    frame = revisions(spark, history)
    assert pairs.sample_pair_counts(pairs.pair_timeline(samples(spark, [("advert", 80, 5, 81, 1)]), frame, frame)).count() == 0
    assert pairs.sample_pair_counts(pairs.pair_timeline(samples(spark, TAGS).limit(0), frame, frame)).count() == 0


INTERACTIONS = [*SAMPLE_KEY, "edited_page_id", "event_user_id", "revisions_count", "page_namespace", "event_user_id_r", "revisions_count_r", "page_namespace_r"]


@pytest.mark.parametrize("period, block", [("1 YEAR", 1000), ("4 DAYS", 2)])
def test_interactions_of_page_users_equal_those_of_the_timeline(spark, history, period, block):
    unnumbered = [revision(None, at, user=8, page=page) for at in (20, 90) for page in (2, 4)]
    frame, tagged = revisions(spark, history + unnumbered), samples(spark, TAGS)
    expected = pairs.sample_interactions(pairs.pair_timeline(tagged, frame, frame, period=period, users_per_block=block))
    users = coedit.sample_page_users(tagged, frame, frame, period=period).filter("revisions_count > 0")
    got = coedit.user_interactions(users, SAMPLE_KEY, page="edited_page_id", users_per_block=block, pairs_per_task=5)
    assert got.dtypes == expected.dtypes
    assert rows(got, *INTERACTIONS) == rows(expected, *INTERACTIONS)


def test_repeated_users_of_a_page_keep_all_their_pairs(spark):
    held = [(2, 1, 3, 0), (2, 1, 3, 0), (2, 4, 1, None), (2, 5, 2, 0), (3, 1, 1, 1), (None, 1, 1, 0), (None, 4, 1, 0)]
    users = spark.createDataFrame(held, "page_id long, event_user_id long, revisions_count long, page_namespace int")
    named = [h for h in held if h[0] is not None]
    expected = [(*a, *b[1:]) for a, b in itertools.permutations(named, 2) if a[0] == b[0] and a[1] != b[1]]
    for block in (1, 1000):
        got = coedit.user_interactions(users, users_per_block=block)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_registered_interactions_leave_as_they_are_joined(spark, tmp_path):
    """One page, two tags: pairs are not looked up again, mirrored or dealt anew once they are formed."""
    kinds = ["click"] * 20 + ["signup"] + ["click"] * 20 + ["signup"]
    events = [(i, hours(200 + 10 * i), i % 13, kind, 1.0, '{"k": 4}') for i, kind in enumerate(kinds)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["user_interactions"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange|Generate|Window|Aggregate", plan[: re.search(r"\w+Join", plan).start()])
    expected = []
    for tag in (20, 41):
        upto = Counter(e[2] for e in events[: tag + 1] if e[2] % 10)
        expected += [(hours(200 + 10 * tag), a, upto[a], b, upto[b]) for a, b in itertools.permutations(upto, 2)]
    assert rows(found, "tag_date", "event_user_id", "revisions_count", "event_user_id_r", "revisions_count_r") == sorted(expected)
    users = coedit.sample_page_users(*[samples(spark, TAGS).limit(0), *[revisions(spark, [])] * 2])
    assert coedit.user_interactions(users, SAMPLE_KEY, page="edited_page_id").count() == 0


def test_tasks_of_interactions_follow_the_number_of_pairs(spark):
    users = spark.range(200).selectExpr("id % 2 as page_id", "id as event_user_id", "1L as revisions_count", "0 as page_namespace")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        formed = coedit.user_interactions(users, users_per_block=25, pairs_per_task=500)  # 2 x 4,950 pairs, both ways
        assert formed.rdd.getNumPartitions() == 20 and formed.count() == 19_800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

from datetime import datetime

import pytest
from frames import hours, revision, revisions, rows, samples
from pyspark.sql import functions as F

from revtide.operators import article, sampling, timeline
from revtide.plans import runs
from revtide.sources import testtables

SF = "/root/testdata/sf0.001"


def _features(spark, history, tag=1000):
    return article.article_features(samples(spark, [("advert", 2, tag, None, 1)]), revisions(spark, history)).first()


def test_ties_follow_revision_id(spark):
    history = [revision(12, 5, size=30), revision(10, 5, size=10), revision(11, 5, size=25)]
    metrics = timeline.page_metrics(revisions(spark, history))
    assert rows(metrics, "revision_id", "edit_size", "next_edit_size") == [(10, 10, 15), (11, 15, 5), (12, 5, 0)]
    assert _features(spark, history).curr_size == 30


def test_half_hours_round_to_even(spark):
    history = [revision(1, 0), revision(2, 0.5), revision(3, 2), revision(4, 4.5)]
    metrics = timeline.page_metrics(revisions(spark, history))
    assert rows(metrics, "revision_id", "time_to_respond", "time_responded_to") == [
        (1, 0.0, 0.0), (2, 0.0, 2.0), (3, 2.0, 2.0), (4, 2.0, 0.0),
    ]


def test_unknown_sizes(spark):
    history = [revision(i, i, size=s) for i, s in enumerate([100, 150, None, 120])]
    metrics = timeline.page_metrics(revisions(spark, history))
    got = [tuple(r) for r in metrics.orderBy("revision_id").select("edit_size", "next_edit_size").collect()]
    assert got == [(100, 50), (50, None), (None, None), (120, 0)]


def test_only_anonymous_editors(spark):
    got = _features(spark, [revision(1, 0, user=None), revision(2, 1, user=None)])
    assert (got.num_editors, got.top_contributor_frac, got.contribution_frac_entropy) == (0, 0.0, 0.0)
    assert (got.frac_anon_revisions, got.concentration_ratio) == (1.0, 0.0)


def test_single_revision(spark):
    got = _features(spark, [revision(1, 0, size=77)])
    assert (got.edit_size, got.time_to_respond, got.curr_size, got.article_age_years) == (77.0, 0.0, 77, 0)
    assert got.recent_edit_size is None


def test_recent_edge_is_excluded(spark):
    got = _features(spark, [revision(1, 0), revision(2, 10), revision(3, 48)], tag=48)
    assert got.frac_recent_revisions == pytest.approx(2 / 3)
    assert got.recent_response_time == pytest.approx((10 + 38) / 2)


def test_recent_share_uses_the_last_revision_and_recent_means_the_tag(spark):
    got = _features(spark, [revision(1, 0), revision(2, 40)], tag=500)
    assert got.frac_recent_revisions == 1.0
    assert got.recent_edit_size is None and got.recent_response_time is None


def test_sample_without_history_keeps_nulls(spark):
    got = _features(spark, [revision(1, 100)], tag=50)
    assert got.num_revisions is None and got.edit_size is None and got.top_contributor_frac is None


def test_age_in_mean_years(spark):
    day = 24
    assert _features(spark, [revision(1, 0), revision(2, 365 * day)], tag=400 * day).article_age_years == 0
    assert _features(spark, [revision(1, 0), revision(2, 366 * day)], tag=400 * day).article_age_years == 1


def test_tag_day_is_kept_by_date_cut_only(spark):
    history = revisions(spark, [revision(1, 5), revision(2, 20)])
    tagged = samples(spark, [("advert", 2, 10, None, 1)])
    assert rows(sampling.asof_cut(tagged, history, ["revision_id"]), "revision_id") == [(1,)]
    assert rows(sampling.asof_cut_day(tagged, history, ["revision_id"]), "revision_id") == [(1,), (2,)]


def test_talk_volume_without_talk_edits_is_null(spark):
    history = revisions(spark, [revision(1, 5), revision(2, 200, page=3, ns=1)])
    tagged = samples(spark, [("advert", 2, 10, 3, 1), ("advert", 2, 300, 3, 1), ("weasel", 2, 10, None, 0)])
    got = article.talk_volume_features(tagged, history)
    assert rows(got.filter("num_revisions is null"), "tag_date") == [(hours(10),)]
    assert rows(got.filter("num_revisions is not null"), "tag_date", "page_talk_ratio") == [(hours(300), 1.0)]


def test_leap_day_window_starts_on_the_28th(spark):
    tagged = samples(spark, [("advert", 2, datetime(2020, 2, 29), None, 1)])
    history = revisions(spark, []).unionByName(
        spark.createDataFrame(
            [(2, 1, datetime(2019, 2, 28)), (2, 2, datetime(2019, 2, 27, 23))],
            "page_id long, revision_id long, event_timestamp timestamp_ntz",
        ),
        allowMissingColumns=True,
    )
    assert rows(sampling.trailing_cut(tagged, history, ["revision_id"], "1 YEAR"), "revision_id") == [(1,)]


def test_pre_tag_prefix(spark):
    history = [revision(1, 0), revision(2, 1, tag=1), revision(3, 2, tag=1)]
    history += [revision(7, 0, page=5), revision(8, 1, page=5)]
    got = sampling.edits_pre_tag(revisions(spark, history))
    assert rows(got, "page_id", "revision_id", "has_tag") == [(2, 1, True), (2, 2, True), (5, 7, False)]


def test_user_article_last_row_has_no_answer(spark):
    history = [revision(1, 0, user=1, size=10), revision(2, 3, user=2, size=30), revision(3, 9, user=1, size=90)]
    tagged = samples(spark, [("advert", 2, 3, None, 1), ("advert", 2, 9, None, 1)])
    got = article.user_article_features(tagged, revisions(spark, history))
    assert rows(got, "tag_date", "event_user_id", "num_edits", "next_edit_size", "time_responded_to", "frac_page_edits") == [
        (hours(3), 1, 1, 20.0, 3.0, 0.5),
        (hours(3), 2, 1, 0.0, 0.0, 0.5),
        (hours(9), 1, 2, 10.0, 1.5, 2 / 3),
        (hours(9), 2, 1, 60.0, 6.0, 1 / 3),
    ]


def test_snapshot_gap_and_direction(spark):
    tagged = samples(spark, [("advert", 2, 48, 3, 1)])
    talk = revisions(spark, [revision(1, 12, page=3), revision(2, 53, page=3), revision(3, 78, page=3)])
    forward = sampling.nearest_snapshot(tagged, talk)
    assert rows(forward, "revision_id", "day_gap") == [(2, 0)]
    assert rows(sampling.nearest_snapshot(tagged, talk, direction="backward"), "revision_id", "day_gap") == [(1, -2)]


def test_daily_range_has_no_gaps(spark):
    history = revisions(spark, [revision(1, 0, size=5), revision(2, 1, size=9), revision(3, 24 * 4, size=2)])
    daily = timeline.daily_activity(timeline.edit_sizes(history))
    assert rows(daily, "days_since_start", "daily_edit_count", "daily_edit_vol") == [
        (0, 2, 9), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 7),
    ]
    smooth = timeline.rolling_mean(daily, "daily_edit_vol", 3, "s")
    assert [r.s for r in smooth.orderBy("days_since_start").collect()] == pytest.approx([0, 0, 3.0, 0, 7 / 3])


def test_halo_windows_span_ranges_of_days(spark):
    """A page with a third of all days spans several tasks; 60-day windows reach over borders of ranges."""
    days = [(1, d, d * d % 97) for d in range(-30, 400)] + [(p, d, d % 7 + p) for p in range(2, 9) for d in range(10 * p)]
    daily = spark.createDataFrame(days, "page_id long, days_since_start long, v long")
    by_page = {}
    for page, day, value in days:
        by_page.setdefault(page, []).append((day, value))
    expected = {}
    for page, own in by_page.items():
        for i, (day, _) in enumerate(own):
            expected[page, day] = sum(v for _, v in own[i - 59 : i + 1]) / 60 if i >= 59 else 0.0
    for span in (16, 60, 366):
        smooth = timeline.rolling_mean(daily, "v", 60, "s", days_per_range=span)
        assert {(r.page_id, r.days_since_start): r.s for r in smooth.collect()} == pytest.approx(expected)
    task = timeline.rolling_mean(daily, "v", 60, "s", days_per_range=16).filter("page_id = 1").select(F.spark_partition_id().alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert task.distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(
    "operator", ["article_features", "user_article_features", "talk_volume_features", "talk_vs_article_activity"]
)
def test_the_history_is_read_twice_at_most(spark, tmp_path, monkeypatch, operator):
    """Counts the scans of the history in every written and in the returned plan of an operator."""
    path = str(tmp_path / "history")
    testtables.revisions(spark, SF).withColumn("of_history", F.lit(1)).write.parquet(path)

    def fixed(df):
        return spark.createDataFrame(df.collect(), df.schema)

    reads = []

    def count(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        reads.append(sum("Relation" in line and "of_history" in line for line in plan.splitlines()))
        return df

    plain = runs.settle
    for module in (article, timeline, runs):
        monkeypatch.setattr(module, "settle", lambda df: plain(count(df)))
    history = spark.read.parquet(path)
    if operator == "talk_vs_article_activity":
        count(timeline.talk_vs_article_activity(history, fixed(testtables.talk_mapping(spark, SF))))
    else:
        count(getattr(article, operator)(fixed(testtables.samples(spark, SF)), history))
    assert 0 < sum(reads) <= 2


def test_template_transitions(spark):
    history = revisions(spark, [revision(i, 24 * i, tag=t) for i, t in enumerate([0, 1, 1, 0])])
    got = timeline.template_transitions(history, timeline.page_starts(history))
    assert rows(got, "days_since_start", "transition") == [(1, "added"), (3, "removed")]


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_results_do_not_depend_on_slices_or_partitions(spark, partitions):
    history, tagged = testtables.revisions(spark, SF), testtables.samples(spark, SF)
    # A third of all revisions goes to one page.
    history = history.withColumn("page_id", F.when(F.col("revision_id") % 3 == 0, 2).otherwise(F.col("page_id")))
    expected = {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for size, count in ((None, before), (4, partitions)):
        spark.conf.set("spark.sql.shuffle.partitions", count)
        try:
            for fn in (article.article_features, article.user_article_features):
                got = fn(tagged, history, rows_per_slice=size)
                got = sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in got.collect())
                assert expected.setdefault(fn, got) == got
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

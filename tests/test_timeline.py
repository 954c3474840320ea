"""Revisions without a page."""

from datetime import datetime

from revtide.operators import timeline


def test_rows_without_a_page_are_no_page(spark):
    rows = [(page, i, datetime(2024, 1, 1, i), 100 * i) for i, page in enumerate([None, 7, None, 7, None])]
    table = spark.createDataFrame(rows, "page_id long, revision_id long, event_timestamp timestamp_ntz, revision_text_bytes long")
    got = sorted((r["revision_id"], r["edit_size"], r["time_to_respond"]) for r in timeline.page_metrics(table).collect())
    assert got == [(1, 100, 0), (3, 200, 2)]
    assert timeline.edit_sizes(table).count() == 2


def test_hot_pages_are_dealt_by_slice_wherever_rows_come_from(spark, monkeypatch):
    import __spark_entry__ as entry

    plans, plain = [], timeline.settle

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(timeline, "settle", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()["talk_vs_article_activity"](spark, "/root/testdata/sf0.001")
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        dealt = [line for plan in plans for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
        assert any("page_id" in line and "_slice" in line for line in dealt)
        assert any("page_id" in line and "_range" in line for line in dealt)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

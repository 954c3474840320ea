import json
from datetime import datetime

from frames import revisions, rows, samples
from pyspark.sql import functions as F

from revtide import schemas
from revtide.operators import templates
from revtide.plans import jobs
from revtide.schemas import SAMPLE_KEY
from revtide.session import scratch_path, settle
from revtide.sources import files, testtables

SF = "/root/testdata/sf0.001"


def test_partition_filters_reach_the_scan(spark):
    path = scratch_path(spark, "warehouse")
    frame = spark.range(20).select("id", (F.col("id") % 2).cast("string").alias("snapshot"), F.lit("enwiki").alias("wiki_db"))
    files.write_parquet(frame, path, partition_by=["snapshot", "wiki_db"])
    got = files.scan_partition(spark, path, ["id"], snapshot="1", wiki_db="enwiki")
    assert rows(got, "id") == [(i,) for i in range(1, 20, 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_read_talk_export_with_renames(spark, tmp_path):
    line = {"page_id": 3, "user_id": 9, "revision_id": 1, "revision_timestamp": "2019-05-01T10:00:00Z", "revision_text": "x"}
    other = {**line, "revision_id": 2, "user_id": None, "revision_timestamp": "2019-05-01 10:00:00.25"}
    (tmp_path / "talk.json").write_text("\n".join(map(json.dumps, (line, other))))
    got = files.read_revisions(spark, str(tmp_path), schemas.TALK_REVISIONS, rename=True)
    assert rows(got.filter("event_user_id is not null"), "revision_id", "event_timestamp") == [(1, datetime(2019, 5, 1, 10))]
    assert got.filter("revision_id = 2").first().event_timestamp == datetime(2019, 5, 1, 10, 0, 0, 250000)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("x,page_id,event_timestamp\n1,7,2004-05-06 07:08:09\n")
    assert rows(files.read_labels(spark, str(tmp_path)), "page_id", "tag_date") == [(7, datetime(2004, 5, 6, 7, 8, 9))]
    (tmp_path / "map").mkdir()
    (tmp_path / "map" / "m.csv").write_text("article_page_id,title,talk_page_id\n2,t,3\n")
    assert rows(files.read_talk_mapping(spark, str(tmp_path / "map")), "talk_page_id", "article_page_id") == [(3, 2)]


def test_items_of_any_size_are_written_alike(spark):
    path = scratch_path(spark, "items")
    items = spark.createDataFrame([("a", i, 0.1 * i, None) for i in range(500)] + [("b", 1, None, "x\ny")], "k string, v int, d double, t string")
    known = spark.createDataFrame([("a",), ("b",), ("none",)], "k string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_batch(known, items, ["v"], path, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert rows(files.read_items(spark, path, items.schema), *items.columns) == rows(items, *items.columns)
    manifest = files.read_manifest(spark, path).collect()
    spans = sorted((r["first"].v, r["last"].v, r.n_items) for r in manifest if r.k == "a")
    assert len(spans) > 1 and sum(n for *_, n in spans) == 500
    assert all(low[1] < high[0] and low[1] - low[0] + 1 == low[2] for low, high in zip(spans, spans[1:]))
    assert [(r.file, r.n_items) for r in manifest if r.k == "none"] == [(None, 0)]


def test_a_batch_counts_once_its_manifest_is_written(spark):
    path = scratch_path(spark, "batches")
    known = spark.createDataFrame([("a",), ("b",), ("none",)], "k string")
    items = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert files.read_items(spark, path, items.schema).count() == 0
    assert files.pending_samples(known, path, ["k"]).count() == 3
    # A job that dies between data and manifest.
    items.write.json(f"{path}/items/batch=blost")
    assert files.read_items(spark, path, items.schema).count() == 0 and files.pending_samples(known, path, ["k"]).count() == 3
    files.write_batch(known.filter("k <> 'b'"), items.filter("k = 'a'"), ["v"], path, ["k"])
    pending = files.pending_samples(known, path, ["k"])
    assert rows(pending, "k") == [("b",)]
    files.write_batch(pending, items.join(pending, "k"), ["v"], path, ["k"])
    assert rows(files.read_items(spark, path, items.schema), "k", "v") == [("a", 1), ("a", 2), ("b", 3)]
    assert files.pending_samples(known, path, ["k"]).count() == 0


def test_large_pages_span_several_files(spark):
    path = scratch_path(spark, "split")
    frame = spark.createDataFrame([(1, i, i) for i in range(100)] + [(2, 500, 0)], "page_id long, revision_id long, event_timestamp long")
    # Ranges this small would be merged again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.partition_by_page(frame, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = spark.read.schema(frame.schema).json(path)
    assert rows(back, "page_id", "revision_id") == rows(frame, "page_id", "revision_id")
    named = back.select("page_id", F.input_file_name().alias("f")).distinct()
    counts = {r.page_id: r["count"] for r in named.groupBy("page_id").count().collect()}
    assert counts[1] > 1 and counts[2] == 1


def test_exports_are_sorted(spark):
    path = scratch_path(spark, "sorted")
    files.ordered_export(spark.range(500).select((F.col("id") * 37 % 500).alias("a")), path, ["a"])
    names = spark.read.parquet(path).select("a", F.input_file_name().alias("f")).groupBy("f").agg(
        F.min("a").alias("lo"), F.max("a").alias("hi")
    )
    spans = rows(names, "lo", "hi")
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_resume_keeps_only_pending(spark):
    both = samples(spark, [("advert", 2, 5, None, 1), ("weasel", 2, 5, None, 1)])
    assert rows(files.resume_pending(both, both.filter("template = 'advert'")), "template") == [("weasel",)]


def test_settled_stage_is_read_back(spark):
    frame = spark.range(5).withColumn("x", F.rand(1))
    settled = settle(frame)
    assert rows(settled, "id", "x") == rows(settled, "id", "x")
    assert "FileScan parquet" in settled._jdf.queryExecution().executedPlan().toString()


def test_export_job_writes_all_templates_at_once(spark):
    out = scratch_path(spark, "export")
    texts = testtables.wikitext(spark, SF)
    history, talk = testtables.revisions(spark, SF), testtables.talk_texts(spark, SF)
    pages = texts.select("page_id", F.lit(0).alias("page_namespace"))
    jobs.export_histories(texts, history, talk, pages, out)
    tagged = templates.revisions_with_template(texts)
    names = ["page_id", "revision_id", "event_timestamp"]
    schema = history.select(*names).schema
    back = files.load_all(spark, f"{out}/page_history", schema)
    expected = templates.flag_has_template(history, tagged)
    assert rows(back, "template", *names) == rows(expected, "template", *names)
    activity = spark.read.json(f"{out}/talk_activity")
    assert "revision_text" not in activity.columns and activity.count() == spark.read.json(f"{out}/talk_text").count()


def test_user_history_export(spark):
    out = scratch_path(spark, "users")
    history = testtables.user_arrays(spark, SF).join(
        testtables.revisions(spark, SF).select("revision_id", "page_title"), "revision_id"
    )
    tagged = spark.createDataFrame([("Page_1",), ("Page_2",)], "page_title string")
    jobs.export_user_histories(history, tagged, out, bad_users=[8])
    raw = history.collect()
    users = {r.event_user_id for r in raw if r.page_title in ("Page_1", "Page_2")} - {None, 8}
    expected = [(r.revision_id,) for r in raw if r.event_user_id in users and r.event_user_is_bot_by == []]
    back = spark.read.parquet(out)
    assert rows(back, "revision_id") == sorted(expected)
    assert {"num_groups", "num_blocks_historical", "num_curr_blocks"} <= set(back.columns)


def test_documents_of_all_kinds(spark):
    out = scratch_path(spark, "documents")
    tagged, history = testtables.samples(spark, SF), testtables.revisions(spark, SF)
    kinds = {
        **jobs.activity_documents(tagged, history),
        **jobs.editor_documents(tagged, history, history, period="1 YEAR"),
        **jobs.talk_documents(tagged, history, testtables.talk_texts(spark, SF)),
    }
    jobs.write_documents(tagged, kinds, out)
    read = {name: files.read_items(spark, f"{out}/{name}", kind.rows.schema) for name, kind in kinds.items()}
    assert set(read) == {"article", "user_article", "editor", "directed", "undirected", "talk_volume", "conversation", "talk_language"}
    assert read["article"].count() == tagged.count() and set(read["article"].toPandas().template) <= set(schemas.TEMPLATES)
    editors = read["user_article"].groupBy(*SAMPLE_KEY).count()
    assert editors.join(read["article"], SAMPLE_KEY).filter("count <> num_editors").count() == 0
    assert read["directed"].count() > 0 and read["undirected"].count() > 0
    assert read["talk_volume"].count() == tagged.filter("talk_page_id is not null").count()
    assert read["conversation"].count() == read["talk_language"].count() > 0
    for name in read:
        held = files.read_manifest(spark, f"{out}/{name}")
        assert held.select(*SAMPLE_KEY).distinct().count() == tagged.count()
        assert held.agg(F.sum("n_items")).first()[0] == read[name].count()

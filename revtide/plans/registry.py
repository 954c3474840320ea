"""Registered queries: each operator applied to the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from revtide import schemas
from revtide.functions import wikitext as W
from revtide.functions.numbers import round_doubles
from revtide.functions import markers as M
from revtide.operators import article, coedit, editor, graph, model, pairs, rollup, sampling, talk, templates, timeline
from revtide.plans import jobs
from revtide.plans.oracles import DOC_FEATURES, LEXICON, VERTEX_FEATURES
from revtide.schemas import SAMPLE_KEY
from revtide.session import scratch_path, settle
from revtide.sources import files
from revtide.sources import testtables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEEP = [
    "page_id",
    "page_title",
    "page_namespace",
    "revision_id",
    "event_timestamp",
    "event_user_id",
    "revision_text_bytes",
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, folder: round_doubles(fn(spark, folder))
    return fn


def _schema(df: DataFrame, *columns: str) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in df.select(*columns).schema.fields])


# -- sources and sinks -------------------------------------------------------------------------


@query
def scan_revisions(spark, folder):
    path = scratch_path(spark, "scan")
    snapshot = F.when(F.col("revision_id") % 2 == 0, "2020-09").otherwise("2021-01")
    stored = T.revisions(spark, folder).withColumn("snapshot", snapshot).withColumn("wiki_db", F.lit("enwiki"))
    files.write_parquet(stored, path, partition_by=["snapshot", "wiki_db"])
    return files.scan_partition(spark, path, KEEP, snapshot="2020-09", wiki_db="enwiki")


@query
def parquet_roundtrip(spark, folder):
    path = scratch_path(spark, "tagged")
    files.write_parquet(templates.revisions_with_template(T.wikitext(spark, folder)), path)
    return spark.read.parquet(path)


@query
def json_roundtrip(spark, folder):
    path = scratch_path(spark, "json")
    rows = T.revisions(spark, folder).select(*KEEP, "template")
    files.write_json(rows, path)
    return files.load_all(spark, path, _schema(rows, *KEEP))


@query
def read_revisions(spark, folder):
    path = scratch_path(spark, "revisions")
    rows = T.revisions(spark, folder).select(*KEEP)
    renamed = rows.withColumnsRenamed({"event_timestamp": "revision_timestamp", "event_user_id": "user_id"})
    files.write_json(renamed, path, partition_by=[])
    return files.read_revisions(spark, path, renamed.schema, rename=True)


@query
def read_labels(spark, folder):
    path = scratch_path(spark, "labels")
    rows = T.samples(spark, folder)
    written = rows.select("template", F.col("tag_date").cast("string").alias("event_timestamp"), "page_id")
    written.write.csv(path, header=True)
    return files.read_labels(spark, path)


@query
def partition_by_page(spark, folder):
    path = scratch_path(spark, "pages")
    rows = T.revisions(spark, folder).select(*KEEP)
    files.partition_by_page(rows, path)
    return files.read_revisions(spark, path, rows.schema)


@query
def load_all(spark, folder):
    path = scratch_path(spark, "all")
    rows = T.revisions(spark, folder).select(*KEEP, "has_template", "template")
    files.write_json(rows, path)
    return files.load_all(spark, path, _schema(rows, *KEEP, "has_template"))


def _written(spark, folder, items):
    path = scratch_path(spark, "items")
    files.write_batch(T.samples(spark, folder), items.rows, items.order, path)
    return path


@query
def feature_document(spark, folder):
    items = jobs.activity_documents(T.samples(spark, folder), T.revisions(spark, folder))["user_article"]
    return files.read_items(spark, _written(spark, folder, items), items.rows.schema)


@query
def feature_manifest(spark, folder):
    items = jobs.activity_documents(T.samples(spark, folder), T.revisions(spark, folder))["user_article"]
    return files.read_manifest(spark, _written(spark, folder, items)).groupBy(*SAMPLE_KEY).agg(
        F.sum("n_items").alias("n_items"),
        F.min("first.event_user_id").alias("first_user"),
        F.max("last.event_user_id").alias("last_user"),
    )


@query
def conversation_document(spark, folder):
    rows = jobs.conversation(jobs.snapshot_utterances(T.samples(spark, folder), T.talk_texts(spark, folder)))
    items = jobs.Items(rows, ["sec_num", "utt_ind"])
    return files.read_items(spark, _written(spark, folder, items), rows.schema)


@query
def snapshot_export(spark, folder):
    path = scratch_path(spark, "snapshots")
    jobs.export_snapshots(T.samples(spark, folder), T.talk_texts(spark, folder), path)
    schema = "template string, talk_page_id long, tag_date timestamp_ntz, revision_id long, page_id long, revision_timestamp timestamp_ntz, revision_text string"
    return spark.read.schema(schema).option("timestampNTZFormat", files.STAMP_FORMAT).json(path)


@query
def talk_export(spark, folder):
    path = scratch_path(spark, "talk")
    rows = templates.talk_history(T.talk_texts(spark, folder), templates.revisions_with_template(T.wikitext(spark, folder)))
    order = ["template", "page_id", "revision_id"]
    files.write_json(rows.repartitionByRange(*order).sortWithinPartitions(*order), path)
    return files.load_all(spark, path, _schema(rows, *[c for c in rows.columns if c != "template"]))


@query
def resume_pending(spark, folder):
    samples = T.samples(spark, folder)
    done = samples.filter(F.col("tag_date") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))
    return files.resume_pending(samples, done)


@query
def ordered_export(spark, folder):
    path = scratch_path(spark, "ordered")
    rows = T.revisions(spark, folder).select(*KEEP, "template")
    files.ordered_export(rows, path, ["page_title", "revision_id"], partition_by=["template"])
    return spark.read.parquet(path)


@query
def clustered_export(spark, folder):
    path = scratch_path(spark, "clustered")
    rows = T.revisions(spark, folder).select(*KEEP)
    files.clustered_export(rows, path, "event_user_id", "revision_id")
    return spark.read.parquet(path)


# -- projections, filters, joins ----------------------------------------------------------------


@query
def blp_pages(spark, folder):
    return templates.blp_pages(T.revisions(spark, folder).select("page_id", "page_namespace"))


@query
def semi_by_ids(spark, folder):
    return templates.semi_by_ids(T.revisions(spark, folder).select(*KEEP), T.samples(spark, folder))


@query
def normalise_titles(spark, folder):
    return files.normalise_titles(T.revisions(spark, folder))


@query
def by_template(spark, folder):
    return templates.by_template(templates.revisions_with_template(T.wikitext(spark, folder)))


@query
def exclude_users(spark, folder):
    return editor.exclude_users(T.revisions(spark, folder).select(*KEEP), [8, 46])


@query
def exclude_bots(spark, folder):
    return editor.exclude_bots(T.user_arrays(spark, folder)).select("revision_id", "event_user_id")


@query
def array_sizes(spark, folder):
    return editor.array_sizes(T.user_arrays(spark, folder).drop("event_user_is_bot_by"))


@query
def asof_cut(spark, folder):
    return sampling.asof_cut(T.samples(spark, folder), T.revisions(spark, folder), ["revision_id"])


@query
def asof_cut_day(spark, folder):
    return sampling.asof_cut_day(T.samples(spark, folder), T.revisions(spark, folder), ["revision_id"])


@query
def trailing_year(spark, folder):
    return sampling.trailing_cut(T.samples(spark, folder), T.revisions(spark, folder), ["revision_id"], "1 YEAR")


@query
def edits_pre_tag(spark, folder):
    rows = T.revisions(spark, folder).select("page_id", "revision_id", "event_timestamp", "has_template")
    return sampling.edits_pre_tag(rows)


@query
def sample_editors(spark, folder):
    return sampling.sample_editors(T.samples(spark, folder), T.revisions(spark, folder))


@query
def talk_activity(spark, folder):
    tagged = templates.revisions_with_template(T.wikitext(spark, folder))
    return templates.talk_activity(templates.talk_history(T.talk_texts(spark, folder), tagged))


@query
def history_subset(spark, folder):
    tagged = templates.revisions_with_template(T.wikitext(spark, folder))
    return editor.history_subset(T.revisions(spark, folder).select(*KEEP), tagged, "page_title")


@query
def flag_has_template(spark, folder):
    rows = T.revisions(spark, folder).select("page_id", "page_title", "revision_id", "event_timestamp")
    return templates.flag_has_template(rows, settle(templates.revisions_with_template(T.wikitext(spark, folder))))


@query
def attach_talk_page(spark, folder):
    return sampling.attach_talk_page(T.samples(spark, folder), T.talk_mapping(spark, folder))


@query
def labels_with_talk(spark, folder):
    return sampling.labels_with_talk(T.samples(spark, folder), T.talk_mapping(spark, folder))


@query
def sample_revisions(spark, folder):
    columns = ["revision_id", "event_user_id", "revision_text_bytes"]
    return sampling.asof_cut(T.samples(spark, folder), T.revisions(spark, folder), columns)


@query
def nearest_snapshot(spark, folder):
    return sampling.nearest_snapshot(T.samples(spark, folder), T.talk_texts(spark, folder))


# -- page timelines and article features ---------------------------------------------------------


@query
def page_metrics(spark, folder):
    rows = T.revisions(spark, folder).select("page_id", "revision_id", "event_timestamp", "revision_text_bytes")
    return timeline.page_metrics(rows).drop("event_timestamp", "revision_text_bytes")


@query
def article_features(spark, folder):
    return article.article_features(T.samples(spark, folder), T.revisions(spark, folder))


@query
def user_article_features(spark, folder):
    return article.user_article_features(T.samples(spark, folder), T.revisions(spark, folder))


@query
def talk_volume_features(spark, folder):
    return article.talk_volume_features(T.samples(spark, folder), T.revisions(spark, folder))


@query
def daily_activity(spark, folder):
    return timeline.daily_activity(timeline.edit_sizes(T.revisions(spark, folder)))


@query
def rolling_activity(spark, folder):
    daily = timeline.daily_activity(timeline.edit_sizes(T.long_revisions(spark, folder)))
    return timeline.rolling_mean(daily, "daily_edit_vol", 60, "smoothed")


@query
def template_transitions(spark, folder):
    rows = T.revisions(spark, folder)
    return timeline.template_transitions(rows, timeline.page_starts(rows))


@query
def talk_vs_article_activity(spark, folder):
    return timeline.talk_vs_article_activity(T.long_revisions(spark, folder), T.talk_mapping(spark, folder))


# -- editors and co-editing ----------------------------------------------------------------------


@query
def editor_features(spark, folder):
    rows = T.revisions(spark, folder)
    return editor.editor_features(T.samples(spark, folder), rows, rows)


def _named(spark, folder):
    return T.revisions(spark, folder).filter(F.col("event_user_id").isNotNull())


@query
def talk_article_ratio(spark, folder):
    return editor.talk_article_ratio(_named(spark, folder), ["event_user_id"])


@query
def editor_page_entropy(spark, folder):
    return editor.editor_page_entropy(_named(spark, folder), ["event_user_id"])


@query
def page_user_counts(spark, folder):
    rows = T.revisions(spark, folder)
    return coedit.sample_page_users(T.samples(spark, folder), rows, rows, period="1 YEAR")


@query
def user_interactions(spark, folder):
    rows = T.revisions(spark, folder)
    users = coedit.sample_page_users(T.samples(spark, folder), rows, rows, period="1 YEAR")
    # Edits without a revision id do not count, and who has no others there is no partner.
    return coedit.user_interactions(settle(users.filter("revisions_count > 0")), SAMPLE_KEY, page="edited_page_id")


def _coedit_users(spark, folder):
    return settle(coedit.page_user_counts(T.coedit_history(spark, folder)))


@query
def pair_articles(spark, folder):
    return coedit.pair_articles(coedit.pair_counts(_coedit_users(spark, folder)))


@query
def pair_pages(spark, folder):
    return coedit.pair_pages(coedit.pair_counts(_coedit_users(spark, folder)))


@query
def directed_features(spark, folder):
    return coedit.directed_features(_coedit_users(spark, folder))


@query
def undirected_features(spark, folder):
    found = coedit.undirected_features(_coedit_users(spark, folder))
    return found.select(
        F.col("pair")[0].alias("user_a"), F.col("pair")[1].alias("user_b"), "num_common_pages", "num_common_articles"
    )


@query
def concentration_ratios(spark, folder):
    return coedit.concentration_ratios(T.revisions(spark, folder).select("page_id", "event_user_id", "revision_id"))


@query
def concentration_ratios_pairs(spark, folder):
    return coedit.concentration_ratios_pairs(coedit.page_user_counts(T.coedit_history(spark, folder)))


# -- roll-ups, unions, combination ---------------------------------------------------------------


@query
def rollup_user_article(spark, folder):
    return rollup.rollup_user_article(user_article_features(spark, folder))


@query
def rollup_editor(spark, folder):
    return rollup.rollup_editor(editor_features(spark, folder))


@query
def rollup_collab(spark, folder):
    rows = T.revisions(spark, folder)
    return jobs.collab_rollup(pairs.sample_users(T.samples(spark, folder), rows, rows, period="1 YEAR"))


@query
def rollup_language(spark, folder):
    return jobs.language_rollup(T.samples(spark, folder), T.talk_texts(spark, folder), LEXICON)


@query
def labelled_union(spark, folder):
    samples = T.samples(spark, folder)
    rows = article.article_features(samples, T.revisions(spark, folder)).join(
        samples.select(*SAMPLE_KEY, "label"), SAMPLE_KEY
    )
    negative = rows.filter(F.col("label") == 0).select(*SAMPLE_KEY, "num_revisions")
    positive = rows.filter(F.col("label") == 1).select(*SAMPLE_KEY, "num_revisions", "edit_size")
    return rollup.labelled_union(negative, positive)


@query
def combined_features(spark, folder):
    blocks = {
        "article": article_features(spark, folder).select(*SAMPLE_KEY, "num_revisions", "edit_size"),
        "talk": talk_volume_features(spark, folder).select(*SAMPLE_KEY, "page_talk_ratio"),
        "user": rollup_user_article(spark, folder).select(*SAMPLE_KEY, "mean_num_edits", "frac_page_edits_ent"),
    }
    return rollup.combine(T.samples(spark, folder), blocks)


@query
def row_counts(spark, folder):
    named = {
        "revisions": T.revisions(spark, folder),
        "samples": T.samples(spark, folder),
        "tagged": templates.revisions_with_template(T.wikitext(spark, folder)),
    }
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in named.items()]
    return reduce(DataFrame.unionByName, counts)


# -- text ----------------------------------------------------------------------------------------


@query
def extract_templates(spark, folder):
    names = T.wikitext(spark, folder).select(
        "revision_id", W.extract_templates(F.col("revision_text")).alias("names")
    )
    return names.select(
        "revision_id",
        F.array_join(F.array_sort("names"), "|").alias("templates"),
        F.size("names").alias("n_templates"),
    )


@query
def reliability_templates(spark, folder):
    names = W.reliability_templates(F.col("revision_text"), schemas.TEMPLATES)
    found = T.wikitext(spark, folder).select("revision_id", names.alias("names")).filter(F.col("names").isNotNull())
    return found.select("revision_id", F.array_join(F.array_sort("names"), "|").alias("templates"))


@query
def revisions_with_template(spark, folder):
    return templates.revisions_with_template(T.wikitext(spark, folder))


@query
def html_to_text(spark, folder):
    return talk.html_to_text(T.html_pages(spark, folder))


def _sections(spark, folder):
    return talk.talk_sections(T.talk_texts(spark, folder).select("page_id", "revision_id", "revision_text"))


@query
def talk_sections(spark, folder):
    return _sections(spark, folder)


@query
def talk_utterances(spark, folder):
    return talk.talk_utterances(_sections(spark, folder))


@query
def utterance_details(spark, folder):
    return talk.utterance_details(talk.talk_utterances(_sections(spark, folder)))


@query
def speakers(spark, folder):
    return talk.speakers(talk.talk_utterances(_sections(spark, folder)))


@query
def politeness_markers(spark, folder):
    counted = talk.marker_counts(talk.talk_utterances(_sections(spark, folder)), lexicon=LEXICON)
    return counted.select(
        "page_id",
        "revision_id",
        "sec_num",
        "utt_ind",
        "conv_id",
        *[m.strategy for m in LEXICON],
        F.col("indent_depth").alias("reply_depth"),
    )


@query
def comment_politeness(spark, folder):
    return talk.marker_counts(talk.comment_utterances(T.revisions(spark, folder)), lexicon=LEXICON).drop("text")


@query
def word_list_counts(spark, folder):
    """Markers in all documents by a phrase table: the lexicon, and as word lists the words that only texts
    labelled as good, or only those labelled as bad, hold."""
    docs = T.table(spark, folder, "documents").select("doc_id", "text")
    labels = T.table(spark, folder, "labels").select("doc_id", "quality")
    words = docs.join(labels, "doc_id").select("quality", F.explode(M.word_list(F.col("text"))).alias("phrase"))
    kinds = words.groupBy("phrase").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    lists = kinds.select(
        F.when(F.col("low") == 1, "positive").otherwise("negative").alias("strategy"),
        "phrase",
        F.lit("any").alias("position"),
        F.lit(0).alias("rank"),
    )
    phrases = lists.union(spark.createDataFrame(M.phrase_rows(M.LEXICON), lists.schema))
    counts = talk.phrase_counts(docs, ["doc_id"], phrases)
    return talk.phrase_columns(docs, ["doc_id"], counts, [*[m.strategy for m in M.LEXICON], "positive", "negative"])


# -- models --------------------------------------------------------------------------------------


@query
def feature_correlations(spark, folder):
    return model.feature_correlations(T.document_features(spark, folder), DOC_FEATURES)


@query
def top_correlations(spark, folder):
    return model.top_correlations(model.feature_correlations(T.document_features(spark, folder), DOC_FEATURES), 3)


@query
def train_test_split(spark, folder):
    return model.train_test_split(T.document_features(spark, folder), ["doc_id"]).select("doc_id", "label", "is_test")


@query
def standard_scale(spark, folder):
    split = model.train_test_split(T.document_features(spark, folder), ["doc_id"])
    columns = ["n_chars", "n_commas", "constant"]
    return model.standard_scale(split, columns, ~F.col("is_test")).select("doc_id", "is_test", *columns)


@query
def logreg_scores(spark, folder):
    scored = model.run_experiment(T.document_features(spark, folder), DOC_FEATURES, ["doc_id"])
    return scored.select("doc_id", "label", "score", "prediction")


def _fixed_scores(spark, folder):
    docs = T.document_features(spark, folder).withColumn("score", F.col("n_chars"))
    return docs.withColumn("prediction", (F.col("n_chars") > 300).cast("int"))


@query
def roc_auc(spark, folder):
    return model.roc_auc(_fixed_scores(spark, folder))


@query
def confusion_matrix(spark, folder):
    return model.confusion_matrix(_fixed_scores(spark, folder))


@query
def f1_accuracy(spark, folder):
    return model.f1_accuracy(_fixed_scores(spark, folder))


@query
def experiment_report(spark, folder):
    samples = settle(T.samples(spark, folder))
    blocks = jobs.feature_blocks(
        samples,
        T.revisions(spark, folder),
        T.revisions(spark, folder),
        T.talk_texts(spark, folder),
        period="1 YEAR",
        lexicon=LEXICON,
    )
    return jobs.run_experiments(samples, blocks)


@query
def experiment_blocks(spark, folder):
    samples, history = settle(T.samples(spark, folder)), T.revisions(spark, folder)
    blocks = {"article": article.article_features(samples, history), "talk": article.talk_volume_features(samples, history)}
    return jobs.run_experiments(samples, {name: settle(block) for name, block in blocks.items()})


# -- graphs --------------------------------------------------------------------------------------


def _graph(spark, folder):
    rows = T.revisions(spark, folder)
    return jobs.editor_graph(settle(T.samples(spark, folder)), rows, rows, VERTEX_FEATURES, period="1 YEAR")


def _links(spark, folder, **asked):
    """The same graph, for what needs no row per edge."""
    rows = T.revisions(spark, folder)
    return jobs.editor_links(settle(T.samples(spark, folder)), rows, rows, VERTEX_FEATURES, period="1 YEAR", **asked)


@query
def graph_vertices(spark, folder):
    return _graph(spark, folder).vertices


@query
def graph_edges(spark, folder):
    return _graph(spark, folder).edges


@query
def graph_self_loops(spark, folder):
    g = _graph(spark, folder)
    return graph.graph_self_loops(g.edges, g.vertices)


def _propagated(spark, folder):
    g = _links(spark, folder)
    return graph.graph_propagate(g.vertices, graph.graph_self_loops(g.edges, g.vertices), VERTEX_FEATURES, size=g.size)


@query
def graph_propagate(spark, folder):
    return _propagated(spark, folder)


@query
def graph_message_sum(spark, folder):
    g = _links(spark, folder, arriving=True)
    return graph.graph_message_sum(g.vertices, graph.graph_self_loops(g.edges, g.vertices), VERTEX_FEATURES, size=g.size)


@query
def graph_readout(spark, folder):
    return graph.graph_readout(_propagated(spark, folder), VERTEX_FEATURES)


@query
def graph_logreg(spark, folder):
    readout = graph.graph_readout(_propagated(spark, folder), VERTEX_FEATURES)
    labelled = readout.join(T.samples(spark, folder).select(*SAMPLE_KEY, "label"), SAMPLE_KEY)
    features = [f"mean_{c}" for c in VERTEX_FEATURES]
    scored = model.run_experiment(labelled, features, SAMPLE_KEY, buckets=5)
    return scored.select(*SAMPLE_KEY, "label", "score", "prediction")

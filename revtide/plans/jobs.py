"""End-to-end jobs: one run over all templates and samples, with written stages where results fork."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtide.functions import markers as M
from revtide.operators import article, coedit, editor, graph, model, pairs, rollup, sampling, talk, templates
from revtide.plans.runs import MAX_BROADCAST
from revtide.schemas import SAMPLE_KEY
from revtide.session import settle
from revtide.sources import files


class Graph(NamedTuple):
    """`size` bounds the number of edges with a loop per vertex; of `Links`, of those that are rows."""

    vertices: DataFrame
    edges: DataFrame | graph.Links
    size: int


def export_histories(
    texts: DataFrame, history: DataFrame, talk_texts: DataFrame, pages: DataFrame, out: str
) -> None:
    """Mine templates and write the flagged page histories and talk histories, by template."""
    spark = texts.sparkSession
    listed = templates.semi_by_ids(texts, templates.blp_pages(pages))
    files.write_parquet(templates.revisions_with_template(listed), f"{out}/templates")
    tagged = spark.read.parquet(f"{out}/templates")
    flagged = templates.flag_has_template(history, tagged)
    files.write_json(flagged.repartitionByRange("template", "page_title", "revision_id").sortWithinPartitions(
        "template", "page_title", "revision_id"), f"{out}/page_history")
    talk_rows = templates.talk_history(talk_texts, tagged)
    files.write_json(talk_rows.repartitionByRange("template", "page_id", "revision_id").sortWithinPartitions(
        "template", "page_id", "revision_id"), f"{out}/talk_text")
    files.write_json(templates.talk_activity(talk_rows), f"{out}/talk_activity")


def export_user_histories(
    history: DataFrame, tagged: DataFrame, out: str, *, bad_users: Sequence[int] = ()
) -> None:
    """Full histories of everyone who edited a tagged page, without bots, clustered by user."""
    users = editor.history_subset(history, tagged, "page_title").select("event_user_id").distinct()
    kept = editor.exclude_bots(editor.history_subset(history, editor.exclude_users(users, bad_users), "event_user_id"))
    rows = editor.array_sizes(kept.drop("event_user_is_bot_by"))
    files.clustered_export(rows, out, "event_user_id", "revision_id")


def chosen_texts(chosen: DataFrame, texts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The texts named by `chosen.revision_id`, each once. Up to MAX_BROADCAST ids, counted, go to the scan of the
    texts, which then are not shuffled; more are joined as any other table."""
    ids = chosen.select("revision_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
    return texts.select(*columns).join(ids, "revision_id", "left_semi")


def export_snapshots(samples: DataFrame, texts: DataFrame, out: str) -> None:
    """The talk page as it stood nearest to each tagging, by template, clustered by (talk page, tag date)."""
    chosen = settle(sampling.nearest_snapshot(samples, texts).select("talk_page_id", "tag_date", "revision_id"))
    wanted = samples.select("template", "talk_page_id", "tag_date").distinct().join(chosen, ["talk_page_id", "tag_date"])
    found = chosen_texts(chosen, texts, ["page_id", "revision_id", F.col("event_timestamp").alias("revision_timestamp"), "revision_text"])
    rows = wanted.join(found, "revision_id")
    order = ["template", "talk_page_id", "tag_date"]
    files.write_json(rows.repartitionByRange(*order).sortWithinPartitions(*order), out)


def snapshot_utterances(samples: DataFrame, texts: DataFrame, *, from_html: bool = True) -> DataFrame:
    """The utterances of each sample's talk snapshot, with the sample key.

    Snapshots are chosen once, on narrow columns; only chosen texts are read and parsed, each once.
    Texts may hold HTML; its tags are stripped unless `from_html` is off.
    """
    chosen = settle(sampling.nearest_snapshot(samples, texts).select("talk_page_id", "tag_date", "revision_id"))
    needed = chosen_texts(chosen, texts, ["revision_id", "page_id", "revision_text"])
    utterances = talk.talk_utterances(talk.talk_sections(needed, from_html=from_html)).drop("page_id")
    keyed = samples.select(*SAMPLE_KEY, "talk_page_id").join(chosen, ["talk_page_id", "tag_date"])
    return keyed.join(utterances, "revision_id")


def language_counts(
    samples: DataFrame, texts: DataFrame, lexicon: Sequence[M.Marker] = M.LEXICON, *, from_html: bool = True
) -> DataFrame:
    """Marker counts per utterance of each sample's talk snapshot."""
    return _counted(snapshot_utterances(samples, texts, from_html=from_html), lexicon)


def _counted(utterances: DataFrame, lexicon: Sequence[M.Marker]) -> DataFrame:
    return talk.marker_counts(utterances, lexicon=lexicon).select(
        *SAMPLE_KEY,
        "talk_page_id",
        "revision_id",
        "sec_num",
        "utt_ind",
        "conv_id",
        "utt_id",
        *[m.strategy for m in lexicon],
        F.col("indent_depth").alias("reply_depth"),
    )


def language_rollup(
    samples: DataFrame, texts: DataFrame, lexicon: Sequence[M.Marker] = M.LEXICON, *, from_html: bool = True
) -> DataFrame:
    counts = language_counts(samples, texts, lexicon, from_html=from_html)
    return rollup.rollup_language(counts, [m.strategy for m in lexicon], SAMPLE_KEY)


def collab_rollup(found: pairs.SampleUsers) -> DataFrame:
    """Roll-up of co-editing per sample. Pairs are counted once, for directed and undirected features alike, and reduced where they are counted."""
    columns = ["num_common_pages", "num_common_articles", "coedit_ratio", "coedit_revisions_ratio"]
    rolled = rollup.merged(pairs.pair_moments(found), columns, ["sample"], F.sum("undirected").alias("undirected"))
    return pairs.keyed(rolled.filter("undirected > 0").drop("undirected"), found)


def editor_graph(
    samples: DataFrame,
    revisions: DataFrame,
    history: DataFrame,
    features: Sequence[str],
    *,
    period: str = "1 YEAR",
) -> Graph:
    """Vertex and edge tables of all samples. Vertices are written; edges are not, and whoever reads them counts pairs."""
    found = pairs.sample_users(samples, revisions, history, period=period)
    editors = editor.editor_features(samples, revisions, history)
    meeting = pairs.keyed(found.users.filter("all_articles > 0").select("sample").distinct(), found)
    vertices = settle(graph.graph_vertices(editors, meeting, features))
    directed = pairs.keyed(pairs.directed_pairs(pairs.counted_pairs(found)), found)
    per_graph = vertices.groupBy(*SAMPLE_KEY).agg(F.count(F.lit(1)).alias("n"))
    size = per_graph.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
    return Graph(vertices, graph.graph_edges(directed), size)


def editor_links(
    samples: DataFrame,
    revisions: DataFrame,
    history: DataFrame,
    features: Sequence[str],
    *,
    period: str = "1 YEAR",
    arriving: bool = False,
) -> Graph:
    """`editor_graph` with edges as `Links`. Pairs are formed only of users outside the core, with anyone.

    Pages other than the sample's are looked at only for samples that have such users, or where the sums of edge
    features are asked for (`arriving`).
    """
    core, all_editors = pairs.sample_core(samples, revisions, history, period=period)
    others = settle(all_editors.join(core, [*SAMPLE_KEY, "event_user_id"], "left_anti").groupBy(*SAMPLE_KEY).count())
    meeting = core.groupBy(*SAMPLE_KEY).count().filter("count > 1").select(*SAMPLE_KEY)
    asked = samples.select(*SAMPLE_KEY) if arriving else others.select(*SAMPLE_KEY)
    found = pairs.sample_users(asked, revisions, history, period=period)
    numbered = core.join(found.samples, SAMPLE_KEY).select("sample", "event_user_id")
    mixed = pairs.keyed(found.users.filter("all_articles > 0").select("sample").distinct(), found)
    vertices = settle(graph.graph_vertices(editor.editor_features(samples, revisions, history), meeting.unionByName(mixed), features))
    rest = graph.graph_edges(pairs.keyed(pairs.directed_pairs(pairs.counted_pairs(found, numbered)), found))
    sums = None
    if arriving:
        sums = pairs.keyed(pairs.arriving_sums(found), found).withColumnRenamed("event_user_id", "vertex")
    # All of a graph's editors, and the others with anyone, both ways.
    n, m = F.col("n"), F.coalesce(F.col("count"), F.lit(0))
    per_graph = vertices.groupBy(*SAMPLE_KEY).agg(F.count(F.lit(1)).alias("n")).join(others, SAMPLE_KEY, "left")
    size = per_graph.agg(F.coalesce(F.sum(2 * m * n + n), F.lit(0))).first()[0]
    return Graph(vertices, graph.Links(core.withColumnRenamed("event_user_id", "vertex"), rest, sums), size)


def feature_blocks(
    samples: DataFrame,
    revisions: DataFrame,
    history: DataFrame,
    texts: DataFrame,
    *,
    period: str = "1 YEAR",
    lexicon: Sequence[M.Marker] = M.LEXICON,
) -> dict[str, DataFrame]:
    """One row per sample and block of features; each block is written once."""
    blocks = {
        "article": article.article_features(samples, revisions),
        "user_article": rollup.rollup_user_article(article.user_article_features(samples, revisions)),
        "talk_volume": article.talk_volume_features(samples, revisions),
        "talk_language": language_rollup(samples, texts, lexicon),
        "editor": rollup.rollup_editor(editor.editor_features(samples, revisions, history)),
        "collab": collab_rollup(pairs.sample_users(samples, revisions, history, period=period)),
    }
    return {name: settle(block) for name, block in blocks.items()}


def run_experiments(samples: DataFrame, blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Fit and report every block on its own and all of them together."""
    labelled = samples.select(*SAMPLE_KEY, "label")
    sets = {name: rollup.combine(labelled, {name: block}) for name, block in blocks.items()}
    sets["combined"] = rollup.combine(labelled, blocks)

    def scored(name: str, df: DataFrame) -> DataFrame:
        features = [c for c in df.columns if c not in (*SAMPLE_KEY, "label")]
        rows = model.run_experiment(df, features, SAMPLE_KEY)
        return rows.select(F.lit(name).alias("feature_set"), "label", "score", "prediction")

    return model.experiment_report(settle(reduce(DataFrame.unionByName, [scored(n, d) for n, d in sets.items()])))


class Items(NamedTuple):
    """One kind of feature document: its items, and what orders those of a sample."""

    rows: DataFrame
    order: Sequence[str]


def activity_documents(samples: DataFrame, revisions: DataFrame) -> dict[str, Items]:
    """Per sample: its article features, and its editors' features on the page."""
    return {
        "article": Items(article.article_features(samples, revisions), []),
        "user_article": Items(article.user_article_features(samples, revisions), ["event_user_id"]),
    }


def editor_documents(
    samples: DataFrame, revisions: DataFrame, history: DataFrame, *, period: str = "1 YEAR"
) -> dict[str, Items]:
    """Per sample: editor features, directed and undirected co-editing features."""
    found = pairs.sample_users(samples, revisions, history, period=period)
    counts = settle(pairs.counted_pairs(found))
    return {
        "editor": Items(editor.editor_features(samples, revisions, history), ["event_user_id"]),
        "directed": Items(pairs.keyed(pairs.directed_pairs(counts).drop("first"), found), ["event_user_id", "event_user_id_r"]),
        "undirected": Items(coedit.undirected_pairs(pairs.keyed(counts, found), SAMPLE_KEY), ["pair"]),
    }


def talk_documents(
    samples: DataFrame, revisions: DataFrame, texts: DataFrame, lexicon: Sequence[M.Marker] = M.LEXICON
) -> dict[str, Items]:
    """Per sample: talk volume, the conversation in its talk snapshot, and the marker counts of its utterances."""
    utterances = settle(snapshot_utterances(samples, texts))
    order = ["sec_num", "utt_ind"]
    return {
        "talk_volume": Items(article.talk_volume_features(samples, revisions), []),
        "conversation": Items(conversation(utterances), order),
        "talk_language": Items(_counted(utterances, lexicon).drop("talk_page_id", "revision_id"), order),
    }


def conversation(utterances: DataFrame) -> DataFrame:
    """Utterances of snapshots as corpus rows, with the sample key."""
    return talk.utterance_details(utterances, keep=(*SAMPLE_KEY, "talk_page_id", "sec_name"))


def write_documents(samples: DataFrame, documents: Mapping[str, Items], out: str) -> None:
    """Each kind of document as a batch below its own folder, all templates in one job per kind."""
    for name, (rows, order) in documents.items():
        files.write_batch(samples, rows, order, f"{out}/{name}")

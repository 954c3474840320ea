"""The shared test tables seen as revisions, samples, wikitext, talk texts and pages.

Each view is one projection (or one grouped projection) of a Parquet table, so work on it grows
with the table. The SQL twins live in `revtide/plans/oracles.py`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.schemas import TEMPLATES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _template_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (number % len(TEMPLATES) + 1).cast("int"))


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    """Edit events: even pages are articles, the next odd page is the article's talk page."""
    k = F.get_json_object("props", "$.k").cast("int")
    topic = F.floor(F.col("k") / 2).cast("int")
    anonymous = F.col("user_id") % 10 == 0
    kind = F.col("event_type")
    comment = (
        F.when(kind == "click", "Please see the talk page, thanks")
        .when(kind == "view", "I think you could add a source")
        .when(kind == "purchase", "rv; sorry, but we really need this")
        .when(kind == "error", "Why? So maybe by the way undone")
        .otherwise("tagged")
    )
    return table(spark, folder, "events").withColumn("k", k).select(
        F.col("k").cast("long").alias("page_id"),
        (F.col("k") % 2).alias("page_namespace"),
        F.concat(F.lit("Page_"), topic.cast("string")).alias("page_title"),
        F.col("event_id").alias("revision_id"),
        F.col("ts").alias("event_timestamp"),
        F.when(~anonymous, F.col("user_id")).alias("event_user_id"),
        anonymous.alias("event_user_is_anonymous"),
        (kind == "click").alias("revision_minor_edit"),
        F.round(F.col("value") * 100).cast("long").alias("revision_text_bytes"),
        (kind == "purchase").alias("revision_is_identity_reverted"),
        (kind == "error").alias("revision_is_identity_revert"),
        F.when(kind == "signup", 1).otherwise(0).alias("has_template"),
        _template_of(topic).alias("template"),
        (F.col("user_id") % 4 + F.col("event_id") % 2).cast("int").alias("num_groups"),
        (F.col("event_id") % 3).cast("int").alias("num_blocks_historical"),
        (F.col("event_id") % 2).cast("int").alias("num_curr_blocks"),
        F.timestamp_add("DAY", F.col("user_id").cast("int"), _ntz("2023-01-01 00:00:00")).alias(
            "event_user_registration_timestamp"
        ),
        comment.alias("event_comment"),
    )


def long_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """The same edits over eight times as long a time, for windows of many days."""
    base = _ntz("2024-01-01 00:00:00")
    seconds = F.timestamp_diff("SECOND", base, "event_timestamp")
    return revisions(spark, folder).withColumn("event_timestamp", F.timestamp_add("SECOND", (seconds * 7).cast("int"), "event_timestamp"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """First tagging of an article in each of two periods."""
    half = F.when(F.col("event_timestamp") >= _ntz("2024-01-21 00:00:00"), 2).otherwise(1)
    topic = F.floor(F.col("page_id") / 2).cast("int")
    tagged = revisions(spark, folder).filter(
        (F.col("page_namespace") == 0)
        & (F.col("has_template") == 1)
        & (F.col("event_timestamp") >= _ntz("2024-01-11 00:00:00"))
    )
    return (
        tagged.groupBy("template", "page_id", half.alias("half"))
        .agg(F.min("event_timestamp").alias("tag_date"))
        .select(
            "template",
            "page_id",
            "tag_date",
            F.when(topic % 7 != 0, F.col("page_id") + 1).alias("talk_page_id"),
            F.when(topic % 2 == 0, 1).otherwise(0).alias("label"),
        )
    )


def talk_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Article -> talk page, for the articles that have one."""
    pages = revisions(spark, folder).filter(F.col("page_namespace") == 0).select("page_id").distinct()
    return pages.filter(F.floor(F.col("page_id") / 2).cast("int") % 7 != 0).select(
        (F.col("page_id") + 1).alias("talk_page_id"), F.col("page_id").alias("article_page_id")
    )


def coedit_history(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as edits: parts are pages, suppliers their editors."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("page_id"),
        (F.col("l_partkey") % 3).cast("int").alias("page_namespace"),
        F.col("l_suppkey").alias("event_user_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("revision_id"),
        F.col("l_shipdate").alias("event_timestamp"),
    )


def wikitext(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as revisions with text; most carry templates, some nested, some capitalised."""
    number = F.col("doc_id") % 8
    head = (
        F.when(number == 0, "{{weasel|date=x}} ")
        .when(number == 1, "{{ Advert \n|d=1}}{{}} ")
        .when(number == 2, "{{cite web|u={{harvid|A}}}} {{peacock}} ")
        .when(number == 3, "{{fanpov}}{{FANPOV}}{{fanpov|again}} ")
        .when(number == 4, "{{autobiography|{{weasel}} ")
        .when(number == 5, "{{infobox\n|name=a}} ")
        .otherwise("")
    )
    return table(spark, folder, "documents").select(
        (F.col("doc_id") % 50).alias("page_id"),
        F.concat(F.lit("Page "), (F.col("doc_id") % 50).cast("string")).alias("page_title"),
        F.col("doc_id").alias("revision_id"),
        F.when(F.col("doc_id") % 97 != 0, F.concat(head, F.col("text"))).alias("revision_text"),
        F.col("doc_id").alias("user_id"),
        F.col("n_chars").alias("revision_text_bytes"),
    )


def talk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as talk-page revisions: sections, indented replies, signatures, a tail."""
    role, turn = F.col("role"), F.col("turn")
    stamp = F.concat(F.lit(" 10:0"), turn.cast("string"), F.lit(", 1 January 2024 (UTC)\n"))
    sign = F.concat(F.lit(" [[User:"), role, F.lit("|"), role, F.lit("]]"))
    body = F.translate(F.col("text"), "\n", " ")
    opening = (
        F.when(turn % 4 == 0, "Please help. Thank you, could you look? ")
        .when(turn % 4 == 1, "Sorry, I think we really should. By the way, good work. ")
        .when(turn % 4 == 2, "Why? Perhaps you can you will. ")
        .otherwise("Hello! Great work but so wrong. ")
    )
    text = F.concat(
        F.when(turn % 2 == 0, F.lit("lead text\n")).otherwise(F.lit("")),
        F.lit("== Topic =="),
        F.lit("\n"),
        opening,
        body,
        sign,
        stamp,
        F.lit(":"),
        opening,
        F.lit("reply [[User talk:x]] "),
        sign,
        F.lit("\n"),
        F.lit("::unsigned tail\n"),
        F.lit("=== Sub ===\n\n"),
        F.when(turn % 3 == 0, F.concat(body, F.lit(" [[User:plain]]\n"))).otherwise(body),
    )
    topic = F.col("conv_id") % 50
    hours = ((F.col("conv_id") * 37 + turn * 101) % 480).cast("int")
    return table(spark, folder, "conversations").select(
        (topic * 2 + 1).alias("page_id"),
        F.concat(F.lit("Talk:Page "), topic.cast("string")).alias("page_title"),
        (F.col("conv_id") * 100 + turn).alias("revision_id"),
        F.timestamp_add("HOUR", hours, _ntz("2024-01-10 00:00:00")).alias("event_timestamp"),
        text.alias("revision_text"),
    )


def user_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Edits with the raw user arrays: bot marks (empty, filled or unknown), groups and blocks."""
    user = F.col("user_id")
    empty = F.array().cast("array<string>")
    bots = F.when(user % 7 == 0, F.array(F.lit("name"))).when(user % 11 != 0, empty)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("revision_id"),
        F.when(user % 10 != 0, user).alias("event_user_id"),
        bots.alias("event_user_is_bot_by"),
        F.array_repeat(F.lit("group"), (user % 4).cast("int")).alias("event_user_groups"),
        F.array_repeat(F.lit("block"), (user % 3).cast("int")).alias("event_user_blocks_historical"),
        F.array_repeat(F.lit("block"), (user % 2).cast("int")).alias("event_user_blocks"),
    )


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", "html")


def document_features(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a few numeric features, one of them constant, one often missing."""
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length("text") - F.length(F.translate("text", ".", ""))).cast("double").alias("n_stops"),
        (F.length("text") - F.length(F.translate("text", ",", ""))).cast("double").alias("n_commas"),
        F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("is_en"),
        F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") % 17).cast("double").alias("sparse"),
        F.lit(1.0).alias("constant"),
    )
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    return docs.join(labels, "doc_id")

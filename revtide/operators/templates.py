"""Template mining: names in wikitext, tagged revisions, and the flagged history of their pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtide.functions import wikitext as W
from revtide.schemas import TEMPLATES


def revisions_with_template(texts: DataFrame, templates: Sequence[str] = TEMPLATES) -> DataFrame:
    """One row per (revision, quality template) with the name as written and in lower case.

    The text is read, matched and dropped inside the scan stage; nothing wide is shuffled.
    """
    found = F.explode(W.reliability_templates(F.col("revision_text"), templates))
    return texts.select("page_id", W.underscored(F.col("page_title")).alias("page_title"), "user_id", "revision_id", found.alias("col")).withColumn(
        "template", F.lower("col")
    )


def by_template(tagged: DataFrame) -> DataFrame:
    """Tagged rows, revisions and pages per template, all templates in one pass.

    Distinct values are counted level by level (revision, page, template), so the few templates
    never gather their rows in one task. A revision belongs to one page.
    """
    per_revision = tagged.groupBy("template", "page_title", "revision_id").agg(F.count(F.lit(1)).alias("n"))
    per_page = per_revision.groupBy("template", "page_title").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("revisions")
    )
    return per_page.groupBy("template").agg(
        F.sum("n").alias("n"), F.sum("revisions").alias("revisions"), F.count(F.lit(1)).alias("pages")
    )


def blp_pages(pages: DataFrame) -> DataFrame:
    """Article pages of a page list, each once."""
    return pages.filter(F.col("page_namespace") == 0).dropDuplicates(["page_id"])


def semi_by_ids(df: DataFrame, ids: DataFrame, on: str = "page_id") -> DataFrame:
    """Keep rows whose id is listed, as a semi join instead of a literal list."""
    return df.join(ids.select(on).distinct(), on, "left_semi")


def flag_has_template(history: DataFrame, tagged: DataFrame) -> DataFrame:
    """History of every page tagged with a template, once per template, with has_template.

    All templates go through one join: titles per template select the pages, and
    (template, revision) pairs set the flag.
    """
    titles = tagged.select("template", "page_title").distinct()
    marked = tagged.select("template", "revision_id").distinct().withColumn("_hit", F.lit(1))
    return (
        history.drop("template", "has_template")
        .join(titles, "page_title")
        .join(marked, ["template", "revision_id"], "left")
        .withColumn("has_template", F.when(F.col("_hit").isNotNull(), 1).otherwise(0))
        .drop("_hit")
    )


def talk_history(texts: DataFrame, tagged: DataFrame) -> DataFrame:
    """Talk-page revisions of tagged pages per template; titles are matched in their spaced form."""
    titles = tagged.select(
        "template", W.talk_title(W.spaced(F.col("page_title"))).alias("page_title")
    ).distinct()
    return texts.join(titles, "page_title")


def talk_activity(talk: DataFrame) -> DataFrame:
    """Talk revisions without their text."""
    return talk.drop("revision_text")

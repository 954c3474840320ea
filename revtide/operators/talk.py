"""Talk texts: sections, utterances, speakers and marker counts.

Everything happens row by row in native expressions, so a text is read whole, in place, and no
grouping is needed before the roll-up. Only counts by a table of phrases group the words they found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtide.functions import markers as M
from revtide.functions import wikitext as W
from revtide.plans.runs import MAX_BROADCAST, lookup
from revtide.session import settle

SLOT_BITS = 19
SLOTS = 2**SLOT_BITS  # words of the bitmap that tells which words may begin a phrase


def html_to_text(pages: DataFrame, column: str = "html") -> DataFrame:
    return pages.withColumn("text", W.html_to_text(F.col(column))).drop(column)


def talk_sections(texts: DataFrame, *, from_html: bool = False) -> DataFrame:
    """One row per section; the text before the first heading has section number 0 and no name."""
    text = W.html_to_text(F.col("revision_text")) if from_html else F.col("revision_text")
    kept = [c for c in texts.columns if c != "revision_text"]
    numbered = texts.select(*kept, F.posexplode(W.sections(text)).alias("sec_num", "section"))
    return numbered.select(*kept, "sec_num", "section.sec_name", "section.sec_text")


def talk_utterances(sections: DataFrame) -> DataFrame:
    """One row per utterance with its author, date stamp, indentation and ids.

    conv_id is the page and section number written together, as in the exported documents; join on
    (page_id, sec_num), which is unambiguous.
    """
    kept = [c for c in sections.columns if c != "sec_text"]
    rows = sections.select(*kept, F.posexplode(W.utterances(F.col("sec_text"))).alias("utt_ind", "utt"))
    text = F.regexp_replace("utt.text", r"(?U)^\s+", "")
    conv_id = F.concat(F.col("page_id").cast("string"), F.col("sec_num").cast("string"))
    return rows.select(
        *kept,
        "utt_ind",
        text.alias("text"),
        W.username(F.col("utt.user")).alias("user"),
        W.stamp(F.col("utt.date")).alias("date"),
        W.indent_depth(text).alias("indent_depth"),
        conv_id.alias("conv_id"),
        F.concat(conv_id, F.lit("."), F.col("utt_ind").cast("string")).alias("utt_id"),
    )


def utterance_details(utterances: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Utterances as corpus rows: speaker, parsed time, reply depth and the utterance replied to."""
    return utterances.select(
        *keep,
        *[c for c in ("page_id", "revision_id", "sec_num", "utt_ind") if c in utterances.columns and c not in keep],
        F.col("utt_id").alias("id"),
        "conv_id",
        F.col("user").alias("speaker"),
        F.try_to_timestamp("date", F.lit("HH:mm, d MMMM yyyy")).cast("timestamp_ntz").alias("time"),
        "text",
        F.col("indent_depth").alias("reply_depth"),
        F.lit(None).cast("string").alias("reply_to"),
    )


def speakers(utterances: DataFrame) -> DataFrame:
    return utterances.select(F.col("user").alias("speaker")).distinct()


def marker_counts(
    texts: DataFrame, column: str = "text", lexicon: Sequence[M.Marker] = M.LEXICON
) -> DataFrame:
    """Add one count per strategy to each text."""
    words = texts.withColumn("_words", M.spaced_words(F.col(column)))
    return words.select(*texts.columns, *[M.marker_count(F.col("_words"), m) for m in lexicon])


def phrase_counts(
    texts: DataFrame,
    keys: Sequence[str],
    phrases: DataFrame,
    column: str = "text",
    *,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """(keys, strategy, n) of the strategies that occur in a text, from a table of phrases of any length.

    phrases    strategy, phrase, position (any, start or inner, see `Marker`), rank among the strategy's phrases
    keys       identify a text

    Every text is cut into words once; a word finds the phrases that begin with it, so the work does not grow
    with the number of phrases. Up to `max_broadcast` phrases, counted, are broadcast. With more, phrases of
    strategies that hold single words only are looked up apart, as their words travel alone; words that begin no phrase are
    left out by a bitmap of SLOTS words before the shuffle, and a frequent word is dealt over copies of its phrases. Counts equal those of `marker_counts`. Phrases without a word and texts
    that are NULL match nothing; a phrase listed twice counts once.
    """
    cut = phrases.select("strategy", "position", "rank", M.word_list(F.col("phrase")).alias("_phrase"))
    table = settle(
        cut.filter(F.size("_phrase") > 0)
        .groupBy("strategy", "position", "_phrase")
        .agg(F.min("rank").alias("_rank"))
        .select(
            "strategy",
            "position",
            F.col("_phrase")[0].alias("_word0"),
            F.expr("slice(_phrase, 2, size(_phrase))").alias("_rest"),
            F.size("_phrase").alias("_length"),
            "_rank",
        )
    )
    # Phrases of one word need no order: their hits are counted before the shuffle.
    lengths = settle(table.groupBy("strategy", "position").agg((F.max("_length") > 1).alias("_long")))
    table = table.join(lengths, ["strategy", "position"])
    words = texts.select(*keys, M.word_list(F.col(column)).alias("_words"))
    if table.count() <= max_broadcast:
        return _looked_up(words, keys, table, max_broadcast)
    single, longer = [settle(table.filter(F.col("_long") == long)) for long in (False, True)]
    return _looked_up(words, keys, single, max_broadcast).unionByName(_looked_up(words, keys, longer, max_broadcast))


def _looked_up(words: DataFrame, keys: Sequence[str], table: DataFrame, max_broadcast: int) -> DataFrame:
    """(keys, strategy, n) from the words of each text and phrases by their first word."""
    size, longest = table.agg(F.count(F.lit(1)), F.coalesce(F.max("_length"), F.lit(1))).first()
    shifted = [F.expr(f"slice(_words, {i + 1}, size(_words))").alias(f"_word{i}") for i in range(longest)]
    places = words.select(*keys, *shifted).select(
        *keys, F.posexplode(F.arrays_zip(*[f"_word{i}" for i in range(longest)])).alias("_at", "_here")
    )
    places = places.select(*keys, "_at", "_here.*")
    if size > max_broadcast:
        places = _beginning(places, table)
    following = F.array(*[F.col(f"_word{i}") for i in range(1, longest)]).cast("array<string>")
    found = lookup(places, table, ["_word0"], "_at", size <= max_broadcast)
    found = found.withColumn("_next", following).filter(F.expr("slice(_next, 1, _length - 1) = _rest"))
    hit = F.struct(F.col("_at").alias("at"), F.col("_rank").alias("rank"), F.col("_length").alias("length"))
    hits = [F.collect_list(F.when(F.col("_long"), hit)).alias("_hits")] if longest > 1 else []
    summed = found.groupBy(*keys, "strategy", "position").agg(
        F.count_if(~F.col("_long")).cast("int").alias("_single"),
        F.max((F.col("_at") == 0).cast("int")).alias("_leading"),
        *hits,
    )
    anywhere = F.col("_single") + M.greedy_count(F.col("_hits")) if hits else F.col("_single")
    counted = (
        F.when(F.col("position") == "start", F.col("_leading"))
        .when(F.col("position") == "inner", anywhere - F.col("_leading"))
        .otherwise(anywhere)
    )
    return summed.select(*keys, "strategy", counted.alias("n")).filter("n > 0")


def _beginning(places: DataFrame, table: DataFrame) -> DataFrame:
    """Places whose word may begin a phrase, by a bitmap of a fixed number of words, which is broadcast.

    A word that begins one is never lost; how many others stay depends on how full the bitmap is.
    """
    place = F.xxhash64("_word0")
    slot, bit = F.pmod(place, F.lit(SLOTS)), F.pmod(F.shiftright(place, SLOT_BITS), F.lit(64)).cast("int")
    one = F.expr("shiftleft(1L, _bit)")
    filled = table.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or(one).alias("_filled"))
    marked = places.withColumns({"_slot": slot, "_bit": bit}).join(F.broadcast(filled), "_slot")
    return marked.filter(F.col("_filled").bitwiseAND(one) != 0).drop("_slot", "_bit", "_filled")


def phrase_columns(texts: DataFrame, keys: Sequence[str], counts: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Keys of all texts with one column per strategy, 0 where it does not occur."""
    column = lambda s: F.sum(F.when(F.col("strategy") == s, F.col("n"))).cast("int").alias(s)
    wide = counts.groupBy(*keys).agg(*[column(s) for s in strategies])
    return texts.select(*keys).join(wide, list(keys), "left").na.fill(0, list(strategies))


def comment_utterances(revisions: DataFrame) -> DataFrame:
    """Edit comments as utterances; anonymous editors speak as 'none'."""
    return revisions.select(
        "page_id",
        "revision_id",
        F.coalesce(F.col("event_user_id").cast("string"), F.lit("none")).alias("user"),
        F.coalesce("event_comment", F.lit("")).alias("text"),
    )

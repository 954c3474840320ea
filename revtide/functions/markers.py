"""Politeness markers counted per text, as one native expression per strategy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Marker(NamedTuple):
    """A strategy: `words` are alternatives (a phrase may hold spaces), `position` where they count.

    any: anywhere; start: the first words only; inner: anywhere but the first words.
    """

    strategy: str
    words: tuple[str, ...]
    position: str


# Starter lexicon. Strategy names follow the politeness literature.
LEXICON = [
    Marker("please", ("please",), "inner"),
    Marker("please_start", ("please",), "start"),
    Marker("gratitude", ("thank", "thanks", "appreciate"), "any"),
    Marker("apologizing", ("sorry", "apologise", "apologize", "excuse me", "forgive me"), "any"),
    Marker("deference", ("great", "good", "nice", "interesting", "cool", "excellent", "awesome"), "start"),
    Marker("greeting", ("hi", "hello", "hey"), "start"),
    Marker("hedges", ("think", "suggest", "believe", "guess", "maybe", "perhaps", "possibly", "seem", "seems"), "any"),
    Marker("factuality", ("really", "actually", "honestly", "surely", "in fact"), "any"),
    Marker("indirect_btw", ("by the way", "btw"), "any"),
    Marker("first_person", ("i", "my", "mine", "myself"), "any"),
    Marker("first_person_start", ("i", "my", "mine", "myself"), "start"),
    Marker("first_person_plural", ("we", "our", "us", "ourselves"), "any"),
    Marker("second_person", ("you", "your", "yours", "yourself"), "any"),
    Marker("second_person_start", ("you", "your", "yours", "yourself"), "start"),
    Marker("direct_question", ("what", "why", "who", "how"), "start"),
    Marker("direct_start", ("so", "then", "and", "but", "or"), "start"),
    Marker("subjunctive", ("could you", "would you"), "any"),
    Marker("indicative", ("can you", "will you"), "any"),
]


def word_table(positive: Sequence[str] = (), negative: Sequence[str] = ()) -> list[Marker]:
    """Markers for a user's own positive and negative word lists."""
    pairs = [("positive", positive), ("negative", negative)]
    return [Marker(name, tuple(words), "any") for name, words in pairs if words]


def phrase_rows(lexicon: Sequence[Marker]) -> list[tuple[str, str, str, int]]:
    """A lexicon as rows of a phrase table: strategy, phrase, position, rank within the strategy."""
    return [(m.strategy, phrase, m.position, rank) for m in lexicon for rank, phrase in enumerate(m.words)]


def word_list(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def greedy_count(hits: Column) -> Column:
    """Phrases that do not overlap, from the left; of those that begin together the one listed first.

    `hits` holds structs of place, rank and number of words.
    """
    step = lambda state, hit: F.when(
        hit["at"] >= state["free"], F.struct((state["n"] + 1).alias("n"), (hit["at"] + hit["length"]).alias("free"))
    ).otherwise(state)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("free"))
    return F.aggregate(F.array_sort(hits), start, step)["n"]


def spaced_words(text: Column) -> Column:
    """Lower-cased words with a blank on each side of every word, so neighbours never share one."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def pattern(marker: Marker, *, start: bool) -> str:
    words = "|".join(w.replace(" ", "  ") for w in marker.words)
    return f"^ *(?: (?:{words}) )" if start else f" (?:{words}) "


def marker_count(words: Column, marker: Marker) -> Column:
    """Occurrences of a marker in `spaced_words`; the pattern only runs where one of its words occurs."""
    anywhere = F.regexp_count(words, F.lit(pattern(marker, start=False)))
    leading = F.regexp_count(words, F.lit(pattern(marker, start=True)))
    counted = {"any": anywhere, "start": leading, "inner": anywhere - leading}[marker.position]
    present = reduce(or_, [words.contains(f" {w.replace(' ', '  ')} ") for w in marker.words])
    return F.when(present, counted).otherwise(F.lit(0)).cast("int").alias(marker.strategy)

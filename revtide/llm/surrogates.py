"""Surrogates for personal data, in DataFrame functions only.

Detected mentions are replaced by keyed surrogates of the same kind and form. All mentions of an entity
(same kind and canonical form: lower case, and digits only where punctuation is free) get the same
surrogate, written the way each mention is written; different entities get different surrogates, none
of which equals an entity of the corpus. Surrogates come from sha256(key, kind, entity, try). Every
round checks them against each other and against the corpus; those that collide try again.

Form: digits become digits, vowels vowels, consonants consonants, of the same script and case; other
characters stay. Phones keep the first digit, cards the first digit and a valid check digit, IPv4
numbers stay valid, e-mails keep their top-level domain, names keep title and last letter, so gender
and script stay. Where so many entities share a form that no other is left, the form gives way, never
the replacement: first the kept last letter or digit and the widths of octets vary, then the length.

A text's replacements depend on its content only: mentions are gathered per distinct text, so copies
are worked on once. Texts without mentions are passed on in the scan; only the others are shuffled.
NULL texts stay NULL; repeated rows and NULL keys stay.
"""

from __future__ import annotations

import unicodedata
from itertools import count as count_from

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.llm.naming import aside, restore
from revtide.llm.native import let, upto
from revtide.session import settle

# The patterns of the kinds, in order of precedence.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\w)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ -]?\(\d{1,4}\)[ -]?\d{2,4}(?:-?\d{2,4}){0,2}|\+\d{1,3}(?:[ -]\d{2,4}){2,4}|\(\d{3}\)[ -]?\d{3}-?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|[.-]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Dr|Prof)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
# `\1` would count groups of the whole pattern, so the card's separator is spelled out there.
CARD = "|".join(rf"\d{{4}}{s}\d{{4}}{s}\d{{4}}{s}\d{{1,7}}" for s in ("", " ", "-"))
ANY = "|".join(f"(?:{p})" if kind != "card" else rf"(?<![\w.])(?:{CARD})(?!\w)" for kind, p in KINDS.items())
TITLE = r"^(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Dr|Prof)\.? "

# Letters are exchanged within their class: vowels and consonants of Latin, Greek and Cyrillic; letters
# of no class within their script, and those of no script named here for Latin ones.
CLASSES = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "àâäáãåèéêëìíîïòóôõöùúûü",
    "çñßš",
    "αεηιουω",
    "βγδζθκλμνξπρσςτφχψ",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщъьж",
    "āăąēĕėęěīĭįōŏőūŭůűųøæœý",
    "ćĉċčďđĝğġģĥķĺļľłńņňŕřśŝşšţťŵźżž",
    "άέήίόύώ",
)
RANGES = {
    "Greek": (0x3B1, 0x3C9),
    "Cyrillic": (0x430, 0x45F),
    "Armenian": (0x561, 0x586),
    "Georgian": (0x10D0, 0x10F0),
    "Hebrew": (0x5D0, 0x5EA),
    "Arabic": (0x628, 0x63A),
    "Devanagari": (0x905, 0x939),
    "Bengali": (0x985, 0x9B9),
    "Tamil": (0xB85, 0xBB9),
    "Telugu": (0xC05, 0xC39),
    "Thai": (0xE01, 0xE2E),
    "Ethiopic": (0x1200, 0x1246),
    "Hiragana": (0x3042, 0x3093),
    "Katakana": (0x30A2, 0x30F3),
    "Hangul": (0xAC00, 0xAD00),
    "Han": (0x4E00, 0x4F00),
    "Cherokee": (0xAB70, 0xABBF),
    "Coptic": (0x2C80, 0x2CB1),
    "Glagolitic": (0x2C30, 0x2C5E),
    "Deseret": (0x10428, 0x1044F),
    "Adlam": (0x1E922, 0x1E943),
}
SCRIPTS = {name: "".join(c for c in map(chr, range(a, z + 1)) if unicodedata.category(c) in ("Ll", "Lo")) for name, (a, z) in RANGES.items()}
LATIN = "abcdefghijklmnopqrstuvwxyz"
# Rounds that keep the form; then as many as a quarter of them with the length kept, then longer ones.
MAX_TRIES = 64


def kind_of(mention: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        hit = F.regexp_extract(mention, f"^(?:{pattern})$", 0) != ""
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("phone")


def canonical(kind: Column, mention: Column) -> Column:
    """Equal for all spellings of one entity."""
    letters = F.regexp_replace(F.lower(mention), r"[^\p{L}\p{N}]", "")
    named = F.regexp_replace(F.lower(F.regexp_replace(mention, TITLE, "")), r"\s+", " ")
    return F.when(kind.isin("email", "ip"), F.lower(mention)).when(kind == "name", named).otherwise(letters)


def mentions_of(text: Column) -> Column:
    """All mentions, in order. Texts without a digit, '@' or title are not searched further."""
    likely = F.regexp_like(text, F.lit(r"[0-9@]|(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Dr|Prof)\.? \p{Lu}"))
    return F.when(likely, F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)).otherwise(F.array().cast("array<string>"))


def _luhn_fixed(digits: Column) -> Column:
    """The digits with the last one set so that the card check holds."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    total = F.aggregate(
        upto(F.length(body)),
        F.lit(0),
        lambda a, i: a
        + let(
            F.substring(body, F.length(body) - i, F.lit(1)).cast("int"),
            lambda d: F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d),
        ),
    )
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _padded(kind: Column, entity: Column, more: int) -> Column:
    """The entity with `more` letters or digits of its own kind, as a form with room."""
    last = F.when(kind == "name", F.regexp_extract(entity, r"(\p{L})\P{L}*$", 1)).otherwise(F.substring(entity, -1, 1))
    return F.when(kind == "email", F.concat(F.lit("b" * more), entity)).when(kind == "ip", entity).otherwise(F.concat(entity, F.repeat(last, F.lit(more))))


def surrogate(kind: Column, entity: Column, attempt: int, key: str) -> Column:
    """A surrogate for a canonical entity: of the same length and form in the first `MAX_TRIES` attempts."""
    loose = attempt >= MAX_TRIES
    more = max(0, attempt - MAX_TRIES - MAX_TRIES // 4 + 4) // 4
    original = entity
    entity = _padded(kind, original, more) if more else original

    def byte_at(noise: Column, i: Column | int) -> Column:
        return F.conv(F.substring(noise, (i % 32) * 2 + 1 if isinstance(i, Column) else F.lit(i % 32 * 2 + 1), F.lit(2)), 16, 10).cast("int")

    def quad(noise: Column) -> Column:
        # A fifth number only where nearly all addresses there are must be taken.
        return F.concat_ws(".", *[(byte_at(noise, i) % 255 + 1 if i == 0 else byte_at(noise, i)).cast("string") for i in range(4 if more < 64 else 5)])

    def spell(noise: Column) -> Column:
        n = F.length(entity)
        top = n - F.locate(".", F.reverse(entity)) + 1  # place of the last dot, for e-mails

        def letter(i: Column) -> Column:
            here = F.substring(entity, i + 1, F.lit(1))
            byte = byte_at(noise, i)

            def one_of(members: str) -> Column:
                return F.substring(F.lit(members), byte % len(members) + 1, F.lit(1))

            swapped = one_of(LATIN)
            for script, members in SCRIPTS.items():
                swapped = F.when(F.regexp_like(here, F.lit(rf"\p{{Is{script}}}")), one_of(members)).otherwise(swapped)
            swapped = F.when(F.regexp_like(here, F.lit(r"\p{L}")), swapped).otherwise(here)
            for members in reversed(CLASSES):
                swapped = F.when(F.contains(F.lit(members), here), one_of(members)).otherwise(swapped)
            before = F.substring(entity, i, F.lit(1))
            start = (i == 0) | (before == ".")
            octet = F.length(F.regexp_extract(F.substring(entity, i + 1, n), r"^\d+", 0))
            in_ip = (
                F.when(here == ".", here)
                .when(start & (octet == 3), F.lit("1"))
                .when(start, (byte % 9 + 1).cast("string"))
                .otherwise((byte % 10).cast("string"))
            )
            stay = ((kind == "email") & (i + 1 >= top)) | ((kind == "iban") & (i < 2))
            if not loose:
                stay = stay | (kind.isin("phone", "card") & (i == 0)) | ((kind == "name") & ((i == n - 1) | F.substring(entity, i + 2, F.lit(1)).isin(" ")))
            return F.when(kind == "ip", in_ip).when(stay, here).otherwise(swapped)

        spelled = F.array_join(F.transform(upto(n), letter), "")
        return F.when(kind == "ip", quad(noise)).otherwise(spelled) if loose else spelled

    noise = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, original, F.lit(str(attempt))), 256)
    spelled = let(noise, spell)
    return F.when(kind == "card", let(spelled, _luhn_fixed)).otherwise(spelled)


def entities_of(mentions: DataFrame) -> DataFrame:
    """Distinct entities: kind, entity."""
    return mentions.select("kind", "entity").distinct()


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate): distinct within a kind, and never an entity itself, however written.

    Rounds go on until no collision is left; each works on what collided before. After `MAX_TRIES`
    rounds the forms widen from round to round, so every entity gets its surrogate. Capitals merge
    some letters, so spellings are compared in capitals.
    """
    entities = settle(entities)
    own = entities.select("kind", F.upper("entity").alias("_mark"))
    done: DataFrame | None = None
    waiting = entities
    for attempt in count_from():
        tried = waiting.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), attempt, key)).withColumn("_mark", F.upper("surrogate"))
        taken = own if done is None else own.unionByName(done.select("kind", F.upper("surrogate").alias("_mark")))
        free = tried.join(taken, ["kind", "_mark"], "left_anti")
        first = free.groupBy("kind", "_mark").agg(F.min(F.struct("entity", "surrogate")).alias("_first"))
        winners = settle(first.select("kind", "_first.entity", "_first.surrogate"))
        done = winners if done is None else settle(done.unionByName(winners))
        waiting = settle(waiting.join(winners.select("kind", "entity"), ["kind", "entity"], "left_anti"))
        if waiting.isEmpty():
            return done


def render(kind: Column, mention: Column, entity: Column, substitute: Column) -> Column:
    """The whole surrogate written like the mention: same punctuation, spacing, capitals and title."""
    title = F.when(kind == "name", F.regexp_extract(mention, TITLE, 0)).otherwise(F.lit(""))
    body = F.substring(mention, F.length(title) + 1, F.length(mention))
    every = kind.isin("email", "ip", "name")
    used = F.when(every, F.length(body)).otherwise(F.length(F.regexp_replace(body, r"[^\p{L}\p{N}]", "")))
    rest = F.substring(substitute, used + 1, F.length(substitute))
    rest = F.when((F.upper(body) == body) & (F.lower(body) != body), F.upper(rest)).otherwise(rest)

    def letter(i: Column) -> Column:
        here = F.substring(body, i + 1, F.lit(1))
        place = F.when(every, i + 1).otherwise(F.length(F.regexp_replace(F.substring(body, F.lit(1), i + 1), r"[^\p{L}\p{N}]", "")))
        new = F.substring(substitute, place, F.lit(1))
        fixed = ~every & ~F.regexp_like(here, F.lit(r"[\p{L}\p{N}]"))
        return F.when(fixed, here).when((F.upper(here) == here) & (F.lower(here) != here), F.upper(new)).otherwise(new)

    written = F.concat(title, F.array_join(F.transform(upto(F.length(body)), letter), ""), rest)
    return F.when(kind == "ip", substitute).otherwise(written)


def pseudonymise(documents: DataFrame, secret: str, *, text: str = "text", count: str | None = None) -> DataFrame:
    """All rows and columns of `documents` with mentions replaced; `count` names a column for their number."""
    rows, at = aside(documents)
    columns, body = rows.columns, F.col(at[text])
    found = rows.select(F.sha2(body, 256).alias("_digest"), mentions_of(body).alias("_found")).filter(F.size("_found") > 0)
    texts = settle(found.groupBy("_digest").agg(F.first("_found").alias("_found")))
    spelled = settle(
        texts.select(F.explode("_found").alias("mention"))
        .distinct()
        .withColumn("kind", kind_of(F.col("mention")))
        .withColumn("entity", canonical(F.col("kind"), F.col("mention")))
    )
    assigned = assign(entities_of(spelled), secret)
    written = spelled.join(assigned, ["kind", "entity"]).select("mention", render(F.col("kind"), F.col("mention"), F.col("entity"), F.col("surrogate")).alias("_new"))
    placed = texts.select("_digest", F.posexplode("_found").alias("_at", "mention")).join(written, "mention")
    ready = settle(
        placed.groupBy("_digest")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_new"))).alias("_new"))
        .select("_digest", F.transform("_new", lambda x: x["_new"]).alias("_new"))
    )
    with_count = [] if count is None else [F.size("_found").cast("long").alias(count)]
    marked = rows.withColumn("_found", F.coalesce(mentions_of(body), F.array().cast("array<string>")))
    clean = marked.filter(F.size("_found") == 0).select(*columns, *with_count)
    pieces = F.split(body, ANY, -1)
    woven = F.array_join(F.flatten(F.zip_with(pieces, "_new", lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")
    touched = marked.filter(F.size("_found") > 0).withColumn("_digest", F.sha2(body, 256)).join(ready, "_digest")
    replaced = touched.select(*[woven.alias(c) if c == at[text] else F.col(c) for c in columns], *with_count)
    return restore(clean.unionByName(replaced), documents.columns, *([] if count is None else [count]))


SECRET = "a key of the caller's; fixed here so that test runs repeat"


def op9_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All `documents` with surrogates for personal data."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return pseudonymise(documents, SECRET, count="n_mentions")

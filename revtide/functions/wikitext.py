"""Text patterns on wikitext and HTML as native column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the data format.
TEMPLATE_BODY = r"(?s)(?<=\{\{)(.*?)(?=\}\})"
HEADING = r"(?dU)(==+.*==+)\s*"
SIGNATURE = r"(?d)(\[\[User:.+\]\])(.*\(UTC\))?(?:$|\n)"
USER_LINK = r"(?d)\[\[(User:.*?)\|"
STAMP = r"(?U)(\d\d:\d\d,\s\d+\s[A-z]*\s\d{4})"

# Character references by name, as the standard library lists them, and the code points 128 to 159 as browsers read them.
NAMED = {name[:-1]: plain for name, plain in html5.items() if name.endswith(";")}
WINDOWS = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def extract_templates(text: Column) -> Column:
    """Distinct template names in a text; of nested templates the outer one. NULL for a NULL text."""
    bodies = F.regexp_extract_all(text, F.lit(TEMPLATE_BODY), F.lit(1))
    names = F.transform(bodies, lambda body: stripped(F.split_part(body, F.lit("|"), F.lit(1))))
    return F.array_distinct(names)


def reliability_templates(text: Column, templates: Sequence[str]) -> Column:
    """The names, as written, that match one of `templates` in lower case; NULL when none does."""
    listed = F.filter(extract_templates(text), lambda name: F.lower(name).isin(*templates))
    return F.when(F.size(listed) > 0, listed)


def underscored(title: Column) -> Column:
    return F.translate(title, " ", "_")


def spaced(title: Column) -> Column:
    return F.translate(title, "_", " ")


def talk_title(title: Column) -> Column:
    return F.concat(F.lit("Talk:"), title)


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags removed, character references decoded."""
    text = html
    for block in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        text = F.regexp_replace(text, block, "")
    return F.when(F.contains(text, F.lit("&")), decode_references(text)).otherwise(text)


def decode_references(text: Column) -> Column:
    """Character references that end in a semicolon, decoded once: by name, decimal or hexadecimal number.

    Unknown names stay as written; numbers that are no character become U+FFFD. The text is cut at each
    ampersand and every piece looked up on its own, so what decoding yields is not decoded again.
    """
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")
    windows = F.array(*[F.lit(c) for c in WINDOWS])

    def plain(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        digits = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.substring(name, 3, 6)).otherwise(
            F.conv(F.substring(name, 2, 7), 10, 16)
        )
        point = F.conv(digits, 16, 10).cast("int")
        character = (
            F.when(point.between(128, 159), F.get(windows, point - 128))
            .when((point < 1) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .otherwise(F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
        )
        found = F.when(F.startswith(name, F.lit("#")), character).otherwise(F.try_element_at(named, name))
        rest = F.substr(piece, F.length(name) + 2)
        return F.when((name == "") | found.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(found, rest))

    pieces = F.split(text, "&", -1)
    return F.array_join(F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(plain(piece))), "")


def sections(text: Column) -> Column:
    """Array of (sec_name, sec_text): the lead with a NULL name, then one entry per heading."""
    bodies = F.split(text, HEADING, -1)
    names = F.concat(
        F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(HEADING), F.lit(1))
    )
    return F.zip_with(names, bodies, lambda name, body: F.struct(name.alias("sec_name"), body.alias("sec_text")))


def utterances(section: Column) -> Column:
    """Array of (text, user, date) split at signatures; text after the last signature is dropped.

    A section without a signature is one utterance by an unknown user.
    """
    users = F.regexp_extract_all(section, F.lit(SIGNATURE), F.lit(1))
    dates = F.regexp_extract_all(section, F.lit(SIGNATURE), F.lit(2))
    texts = F.slice(F.split(section, SIGNATURE, -1), 1, F.size(users))
    signed = F.transform(
        F.arrays_zip(texts.alias("text"), users.alias("user"), dates.alias("date")),
        lambda u: F.struct(u["text"].alias("text"), u["user"].alias("user"), u["date"].alias("date")),
    )
    unknown = F.array(
        F.struct(section.alias("text"), F.lit("unknown").alias("user"), F.lit("unknown").alias("date"))
    )
    return F.when(F.size(users) > 0, signed).otherwise(unknown)


def username(link: Column) -> Column:
    """User name inside a link, or the input where it is not one."""
    name = F.regexp_extract(link, USER_LINK, 1)
    return F.when(name != "", name).otherwise(link)


def stamp(date: Column) -> Column:
    """Time stamp inside a signature date, or 'unknown'."""
    found = F.regexp_extract(date, STAMP, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def indent_depth(text: Column) -> Column:
    return (F.length(text) - F.length(F.ltrim(text, F.lit(":")))).cast("int")

"""Column names, explicit schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# The quality-warning templates that are mined.
TEMPLATES = ["weasel", "peacock", "autobiography", "advert", "fanpov"]

# A sample is one tagging of one page.
SAMPLE_KEY = ["template", "page_id", "tag_date"]


def _struct(*fields) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


_L, _I, _S, _B, _T = LongType(), IntegerType(), StringType(), BooleanType(), TimestampNTZType()

REVISIONS = _struct(
    ("page_id", _L, True),
    ("page_title", _S, True),
    ("page_namespace", _I, True),
    ("revision_id", _L, True),
    ("event_timestamp", _T, True),
    ("event_user_id", _L, True),
    ("revision_minor_edit", _B, True),
    ("revision_text_bytes", _L, True),
    ("revision_is_identity_reverted", _B, True),
    ("revision_is_identity_revert", _B, True),
    ("revision_first_identity_reverting_revision_id", _L, True),
    ("revision_seconds_to_identity_revert", _L, True),
    ("event_user_registration_timestamp", _T, True),
    ("event_user_is_anonymous", _B, True),
    ("event_user_revision_count", _L, True),
    ("has_template", _I, True),
    ("event_comment", _S, True),
)

USER_HISTORIES = _struct(
    ("event_user_text", _S, True),
    ("event_timestamp", _T, True),
    ("page_title", _S, True),
    ("page_id", _L, True),
    ("page_namespace", _I, True),
    ("revision_id", _L, True),
    ("revision_is_identity_reverted", _B, True),
    ("revision_is_identity_revert", _B, True),
    ("revision_minor_edit", _B, True),
    ("revision_text_bytes", _L, True),
    ("revision_first_identity_reverting_revision_id", _L, True),
    ("event_user_id", _L, True),
    ("event_user_registration_timestamp", _T, True),
    ("num_groups", _I, True),
    ("num_blocks_historical", _I, True),
    ("num_curr_blocks", _I, True),
)

TALK_REVISIONS = _struct(
    ("revision_text", _S, True),
    ("user_id", _L, True),
    ("page_id", _L, True),
    ("page_title", _S, True),
    ("revision_text_bytes", _L, True),
    ("revision_id", _L, True),
    ("revision_timestamp", _T, True),
    ("revision_minor_edit", _B, True),
    ("revision_parent_id", _L, True),
    ("user_text", _S, True),
)

LABELS = _struct(("event_timestamp", _T, True), ("page_id", _L, True))
PAGE_LIST = _struct(("page_id", _L, True), ("page_namespace", _I, True))
TALK_MAPPING = _struct(("talk_page_id", _L, True), ("article_page_id", _L, True))

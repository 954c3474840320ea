"""Small inline frames for the hand fixtures."""

from __future__ import annotations

from datetime import datetime, timedelta

BASE = datetime(2024, 1, 1)
SCHEMA = (
    "page_id long, revision_id long, event_timestamp timestamp_ntz, event_user_id long, page_namespace int, "
    "revision_text_bytes long, revision_minor_edit boolean, revision_is_identity_reverted boolean, "
    "revision_is_identity_revert boolean, has_template int, num_groups int, num_blocks_historical int, "
    "num_curr_blocks int, event_user_registration_timestamp timestamp_ntz"
)


def hours(n: float) -> datetime:
    return BASE + timedelta(hours=n)


def revision(rev, at, user=1, size=100, page=2, ns=0, minor=False, reverted=False, revert=False, tag=0, groups=0):
    return (
        page, rev, hours(at), user, ns, size, minor, reverted, revert, tag, groups, 0, 0, datetime(2023, 12, 1),
    )


def revisions(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def samples(spark, rows):
    """Rows of (template, page_id, tag hour, talk_page_id, label)."""
    data = [(t, p, hours(h) if not isinstance(h, datetime) else h, talk, label) for t, p, h, talk, label in rows]
    return spark.createDataFrame(
        data, "template string, page_id long, tag_date timestamp_ntz, talk_page_id long, label int"
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())

"""Article, user-article and talk-volume features of every sample as of its tag.

The history of a page is read once however many samples it has. Samples become marks on the page's
timeline; each revision belongs to the interval closed by the next mark; measures are summed per
(page, user, interval) and then accumulated over the intervals. So nothing is emitted per
(sample, revision), and the rows that are windowed are bounded by the number of marks of a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revtide.functions import clock
from revtide.functions.numbers import ratio, share_entropy, weight_log
from revtide.operators.timeline import edit_size
from revtide.plans.runs import ROWS_PER_SLICE, running
from revtide.schemas import SAMPLE_KEY
from revtide.session import settle

# Rows of a timeline by `kind`. At one position an echo comes first and a mark last.
ECHO, EVENT, MARK = -1, 0, 1
# Roles of marks.
NOW, RECENT_FROM = 1, 2
ORDER = ["at", "kind", "revision_id"]


def tag_cuts(samples: DataFrame, *, page: str = "page_id", whole_day: bool = False) -> DataFrame:
    """Distinct (page_id, tag_date) with `upto`, the last position that counts as before the tag.

    Cuts are used several times in a plan; hand in samples that are written, not derived.
    """
    upto = clock.micros("tag_date")
    return (
        samples.filter(F.col(page).isNotNull())
        .select(F.col(page).alias("page_id"), "tag_date")
        .distinct()
        .withColumn("upto", clock.day_end(upto) if whole_day else upto)
    )


def _events(revisions: DataFrame, cuts: DataFrame, *columns: str) -> DataFrame:
    kept = revisions.join(cuts.select("page_id").distinct(), "page_id", "left_semi")
    return kept.select(
        "page_id", clock.micros("event_timestamp").alias("at"), F.lit(EVENT).alias("kind"), "revision_id", *columns
    )


def _run(line: DataFrame, revisions: DataFrame, rows_per_slice: int | None, **outputs) -> DataFrame:
    sizes = revisions.select("page_id", clock.micros("event_timestamp").alias("at"))
    placed = running(line, ["page_id"], ORDER, sizes=sizes, rows_per_slice=rows_per_slice, **outputs)
    # A mark closes the interval that began after the mark before it.
    return placed.withColumn("interval", F.col("marks_seen") - (F.col("kind") == MARK).cast("int"))


def _before() -> dict:
    """The previous revision of the page, whatever lies in between."""
    here = F.struct("at", "event_user_id", F.col("revision_text_bytes").alias("bytes"))
    return {"before": F.when(F.col("kind") == EVENT, here)}


def page_state(
    cuts: DataFrame,
    revisions: DataFrame,
    *,
    recent_days: int = 2,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Every page measure as of every cut: one row per (page_id, tag_date) with any revision."""
    reach = F.lit(recent_days * clock.DAY)
    marks = cuts.select(
        "page_id",
        "tag_date",
        F.lit(MARK).alias("kind"),
        F.inline(
            F.array(
                F.struct(F.lit(NOW).alias("role"), F.col("upto").alias("at")),
                F.struct(F.lit(RECENT_FROM).alias("role"), (clock.micros("tag_date") - reach).alias("at")),
            )
        ),
    )
    # An echo follows each revision by the reach of "recent": the echoes up to a revision are the
    # revisions that are no longer recent when it is the last one. Both come from one reading of a revision.
    columns = ["event_user_id", "revision_text_bytes", "revision_minor_edit"]
    events = _events(revisions, cuts, *columns)
    nothing = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("revision_id", *columns)]
    both = F.array(
        F.struct("at", "kind", "revision_id", *columns),
        F.struct((F.col("at") + reach).alias("at"), F.lit(ECHO).alias("kind"), *nothing),
    )
    line = _run(
        events.select("page_id", F.inline(both)).unionByName(marks, allowMissingColumns=True),
        revisions,
        rows_per_slice,
        prior=_before(),
        total={
            "marks_seen": (F.col("kind") == MARK).cast("int"),
            "faded": (F.col("kind") == ECHO).cast("int"),
        },
    )
    line = line.filter(F.col("kind") != ECHO)
    event = F.col("kind") == EVENT
    size = edit_size(F.col("revision_text_bytes"), F.col("before.bytes"))
    wait = clock.elapsed_hours(F.col("at"), F.col("before.at"))
    per_user = line.groupBy("page_id", "event_user_id", "interval").agg(
        F.count_if(event).alias("n"),
        F.sum(F.when(event, size)).alias("size_sum"),
        F.count(F.when(event, size)).alias("size_n"),
        F.sum(F.when(event, wait)).alias("wait_sum"),
        F.sum(F.when(event, F.col("revision_minor_edit").cast("int"))).alias("minor_sum"),
        F.count(F.when(event, F.col("revision_minor_edit"))).alias("minor_n"),
        F.min(F.when(event, F.col("at"))).alias("first_at"),
        F.max(F.when(event, F.col("faded"))).alias("faded"),
        # What the mark that closes the interval knows; numbers only, so the aggregate hashes.
        F.max(F.when(~event, F.col("before.at"))).alias("last_at"),
        F.max(F.when(~event, F.col("before.bytes"))).alias("last_bytes"),
        F.max("role").alias("role"),
        F.max("tag_date").alias("tag_date"),
    )
    of_user = Window.partitionBy("page_id", "event_user_id").orderBy("interval")
    named = F.col("event_user_id").isNotNull() & (F.col("n") > 0)
    held = F.sum("n").over(of_user.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per_user = per_user.withColumn("held", held)
    had = F.col("held") - F.col("n")
    per_interval = per_user.groupBy("page_id", "interval").agg(
        *[F.sum(c).alias(c) for c in ("n", "size_sum", "size_n", "wait_sum", "minor_sum", "minor_n")],
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.max("last_bytes").alias("last_bytes"),
        F.sum(F.when(named, F.col("n"))).alias("named_n"),
        F.count_if(named & (had == 0)).alias("editors"),
        F.sum(F.when(named, weight_log(F.col("held")) - weight_log(had))).alias("weighted"),
        F.max(F.when(named, F.col("held"))).alias("top"),
        F.max("faded").alias("faded"),
        F.max("role").alias("role"),
        F.max("tag_date").alias("tag_date"),
    )
    over_page = (
        Window.partitionBy("page_id").orderBy("interval").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = ["n", "size_sum", "size_n", "wait_sum", "minor_sum", "minor_n", "named_n", "editors", "weighted"]
    state = per_interval.select(
        "page_id",
        "tag_date",
        "role",
        *[F.coalesce(F.sum(c).over(over_page), F.lit(0)).alias(c) for c in sums],
        F.min("first_at").over(over_page).alias("first_at"),
        "last_at",
        "last_bytes",
        F.max("top").over(over_page).alias("top"),
        # The last revision has seen the most echoes.
        F.max("faded").over(over_page).alias("faded"),
    ).filter(F.col("role").isNotNull())

    def at_mark(role: int, column: str):
        return F.max(F.when(F.col("role") == role, F.col(column)))

    return (
        state.groupBy("page_id", "tag_date")
        .agg(
            *[at_mark(NOW, c).alias(c) for c in [*sums, "first_at", "last_at", "last_bytes", "top", "faded"]],
            *[at_mark(RECENT_FROM, c).alias(f"{c}_old") for c in ("size_sum", "size_n", "wait_sum", "n")],
        )
        .filter(F.col("n") > 0)
    )


def _share_columns():
    n, named_n = F.col("n"), F.col("named_n")
    return {
        "num_revisions": n,
        "num_editors": F.col("editors").cast("long"),
        "frac_recent_revisions": ratio(n - F.col("faded"), n),
        "top_contributor_frac": F.coalesce(ratio(F.col("top"), named_n), F.lit(0.0)),
    }


def article_features(
    samples: DataFrame,
    revisions: DataFrame,
    *,
    recent_days: int = 2,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Article features per sample; a sample without any revision up to its tag keeps NULLs."""
    samples = settle(samples.select(*SAMPLE_KEY))
    state = page_state(tag_cuts(samples), revisions, recent_days=recent_days, rows_per_slice=rows_per_slice)
    n = F.col("n")
    shares = _share_columns()
    features = state.select(
        "page_id",
        "tag_date",
        ratio(F.col("size_sum"), F.col("size_n")).alias("edit_size"),
        ratio(F.col("wait_sum"), n).alias("time_to_respond"),
        clock.whole_years(F.col("last_at"), F.col("first_at")).alias("article_age_years"),
        F.col("last_bytes").alias("curr_size"),
        ratio(F.col("minor_sum"), F.col("minor_n")).alias("frac_minor_edits"),
        F.col("last_bytes").alias("last_edit_size"),
        *[c.alias(name) for name, c in shares.items()],
        ratio(n - F.col("named_n"), n).alias("frac_anon_revisions"),
        ratio(F.col("editors"), n).alias("concentration_ratio"),
        share_entropy(F.col("named_n"), F.col("weighted")).alias("contribution_frac_entropy"),
        ratio(F.col("size_sum") - F.col("size_sum_old"), F.col("size_n") - F.col("size_n_old")).alias(
            "recent_edit_size"
        ),
        ratio(F.col("wait_sum") - F.col("wait_sum_old"), n - F.col("n_old")).alias("recent_response_time"),
    )
    return samples.select(*SAMPLE_KEY).join(features, ["page_id", "tag_date"], "left")


def talk_volume_features(
    samples: DataFrame, revisions: DataFrame, *, rows_per_slice: int | None = ROWS_PER_SLICE
) -> DataFrame:
    """Talk-page volume per sample with a talk page, the tag's whole day included.

    NULL features where the talk page has no revision by then.
    """
    with_talk = settle(samples.filter(F.col("talk_page_id").isNotNull()).select(*SAMPLE_KEY, "talk_page_id"))
    # Articles and talk pages are cut on one line of all pages.
    cuts = tag_cuts(with_talk, whole_day=True).unionByName(tag_cuts(with_talk, page="talk_page_id", whole_day=True)).distinct()
    state = settle(page_state(cuts, revisions, rows_per_slice=rows_per_slice))
    talk = state.select(
        F.col("page_id").alias("talk_page_id"),
        "tag_date",
        *[c.alias(name) for name, c in _share_columns().items()],
        ratio(F.col("size_sum"), F.col("size_n")).alias("mean_edit_size"),
        ratio(F.col("wait_sum"), F.col("n")).alias("mean_response_time"),
    )
    articles = state.select("page_id", "tag_date", F.col("n").alias("article_revisions"))
    keyed = with_talk.select(*SAMPLE_KEY, "talk_page_id")
    joined = keyed.join(articles, ["page_id", "tag_date"], "left").join(talk, ["talk_page_id", "tag_date"], "left")
    return joined.select(
        *SAMPLE_KEY,
        *_share_columns(),
        "mean_edit_size",
        "mean_response_time",
        ratio(F.col("article_revisions"), F.col("num_revisions")).alias("page_talk_ratio"),
    )


def user_article_features(
    samples: DataFrame, revisions: DataFrame, *, rows_per_slice: int | None = ROWS_PER_SLICE
) -> DataFrame:
    """Per sample and named editor: mean sizes and waits, number and share of edits, reverts.

    What a revision says about the one before it (its wait, its size change) is credited to the
    earlier editor in the later revision's interval, so a cut needs no repair of its last row.
    """
    samples = settle(samples.select(*SAMPLE_KEY))
    tags = tag_cuts(samples)
    marks = tags.select("page_id", "tag_date", F.col("upto").alias("at"), F.lit(MARK).alias("kind"))
    columns = [
        "event_user_id",
        "revision_text_bytes",
        "revision_is_identity_reverted",
        "revision_is_identity_revert",
    ]
    placed = _run(
        _events(revisions, tags, *columns).unionByName(marks, allowMissingColumns=True),
        revisions,
        rows_per_slice,
        prior=_before(),
        total={"marks_seen": (F.col("kind") == MARK).cast("int"), "rows_upto": (F.col("kind") == EVENT).cast("int")},
    )
    placed = settle(placed)
    cuts = placed.filter(F.col("kind") == MARK).select("page_id", "tag_date", "interval", "rows_upto")
    line = placed.filter(F.col("kind") == EVENT)
    change = F.abs(F.col("revision_text_bytes") - F.col("before.bytes"))
    zero = F.lit(0)
    size = edit_size(F.col("revision_text_bytes"), F.col("before.bytes"))
    wait = clock.elapsed_hours(F.col("at"), F.col("before.at"))
    own = F.struct(
        F.col("event_user_id"),
        F.lit(1).alias("n"),
        F.coalesce(size, zero).alias("size_sum"),
        size.isNotNull().cast("int").alias("size_n"),
        wait.alias("wait_sum"),
        F.coalesce(F.col("revision_is_identity_reverted").cast("int"), zero).alias("reverted"),
        F.coalesce(F.col("revision_is_identity_revert").cast("int"), zero).alias("revert"),
        F.lit(0.0).alias("answer_sum"),
        zero.cast("long").alias("next_sum"),
        zero.alias("next_unknown"),
    )
    earlier = F.struct(
        F.col("before.event_user_id").alias("event_user_id"),
        zero.alias("n"),
        zero.cast("long").alias("size_sum"),
        zero.alias("size_n"),
        F.lit(0.0).alias("wait_sum"),
        zero.alias("reverted"),
        zero.alias("revert"),
        wait.alias("answer_sum"),
        F.coalesce(change, zero).alias("next_sum"),
        change.isNull().cast("int").alias("next_unknown"),
    )
    credited = line.select("page_id", "interval", F.inline(F.array(own, earlier))).filter(
        F.col("event_user_id").isNotNull()
    )
    sums = [
        "n", "size_sum", "size_n", "wait_sum", "reverted", "revert", "answer_sum", "next_sum", "next_unknown",
    ]
    stepped = credited.groupBy("page_id", "event_user_id", "interval").agg(*[F.sum(c).alias(c) for c in sums])
    of_user = Window.partitionBy("page_id", "event_user_id").orderBy("interval")
    so_far = of_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = stepped.select(
        "page_id",
        "event_user_id",
        *[F.sum(c).over(so_far).alias(c) for c in sums],
        F.col("interval").alias("from_interval"),
        F.lead("interval").over(of_user).alias("next_interval"),
    )
    # A state holds from its interval until the editor's next one.
    last = tags.groupBy("page_id").agg((F.count(F.lit(1)) - 1).alias("last_interval"))
    until = F.coalesce(F.col("next_interval") - 1, F.col("last_interval"))
    held = (
        states.join(last, "page_id")
        .filter(F.col("from_interval") <= until)
        .withColumn("interval", F.explode(F.sequence("from_interval", until)))
    )
    n = F.col("n")
    features = held.join(cuts, ["page_id", "interval"]).select(
        "page_id",
        "tag_date",
        "event_user_id",
        ratio(F.col("size_sum"), F.col("size_n")).alias("edit_size"),
        ratio(F.col("next_sum"), n - F.col("next_unknown")).alias("next_edit_size"),
        ratio(F.col("wait_sum"), n).alias("time_to_respond"),
        ratio(F.col("answer_sum"), n).alias("time_responded_to"),
        n.alias("num_edits"),
        ratio(n, F.col("rows_upto")).alias("frac_page_edits"),
        F.col("reverted").alias("revision_is_identity_reverted"),
        F.col("revert").alias("revision_is_identity_revert"),
    )
    return samples.select(*SAMPLE_KEY).join(features, ["page_id", "tag_date"])

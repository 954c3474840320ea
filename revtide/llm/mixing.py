"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every source gets a target number of words: the wanted total is shared by weight, no target may exceed
`most` times the source, and what is cut off is shared again by weight among the others. A document of a
source with rate r = target / size is to be taken r times on average: floor(r) times for certain, and once
more with the fraction that is left.

The fractions are rounded by pivotal pairing. Two documents with expected words a and b put a + b on one
of them as far as it can hold it; which one is drawn so that both keep their expectation. One of the two
becomes integral, the other goes on with the residual. So the words taken of a source stay equal to the
target until the last residual, which is drawn on its own: a source misses its target by less than one
document. Pairing runs as a reduction tree: groups of about `FANOUT` documents of one source are folded in
one row each, their residuals are dealt into `FANOUT` times fewer groups, and so on until a source has one
group. Larger documents go first, so residuals tend to end up in small ones.

Draws are hashes of ids and texts, so reruns agree, on any number of machines. Rows that agree in id,
source and text are counted before anything is dealt; m of them hold m times the fraction, whose whole part
goes to as many of them at once, so copies of a row never gather in one group. Texts are read in the scan
stage and never shuffled.

NULL texts and texts without words have size 0 and are taken 0 times; a NULL source is a source of its own,
after all others; NULL ids are kept as they are; extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revtide.llm.native import let
from revtide.session import settle

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # words wanted over words there
MOST = 2
FANOUT = 64
COPIES_PER_ROW = 10_000
MAX_BROADCAST = 100_000  # sources, a few numbers each
SALTS = 64
WORD = r"[^ \t\n\x0B\f\r]+"
SEED = 20_11


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) made from the parts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11).cast("double") / F.lit(float(1 << 53))


def units(documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, mark, m): rows that agree in id, source and text, counted."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), F.col(key), body).alias("mark"),
    )
    return rows.groupBy("key", "source", "size", "mark").agg(F.count(F.lit(1)).alias("m"))


def ranked_sources(counted: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_units, weight): weights repeat in the order of sources, NULL last.

    Sorted by ranges; a source's place is its place within its partition and the rows of those before.
    """
    sums = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    placed = settle(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_part", before.alias("_before"))  # a row per partition of the sort
    rank = F.col("_before") + within
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(rank, F.lit(len(weights))).cast("int"))
    return placed.withColumn("_part", part).join(starts, "_part").select("source", "source_size", "n_units", rank.alias("rank"), weight.alias("weight"))


def targets(sources: DataFrame, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """Adds `target`: weight times the level at which all targets, none above its limit, make up the share.

    A source is full when its limit lies at or below weight * level. Each round takes what full sources hold
    from the total and shares the rest anew; full sources stay full, since the level only rises.
    """
    up, down = share
    limit = F.col("source_size") * most
    num, den = 0, 1
    big = "decimal(38,0)"
    while True:
        full = limit.cast("decimal(20,0)") * F.lit(den).cast("decimal(18,0)") <= F.col("weight").cast("decimal(5,0)") * F.lit(num).cast("decimal(33,0)")
        sums = sources.agg(
            F.sum(F.col("source_size").cast(big)).alias("all"),
            F.sum(F.when(full, limit).otherwise(0).cast(big)).alias("held"),
            F.sum(F.when(full, 0).otherwise(F.col("weight")).cast(big)).alias("open"),
        ).first()
        if not sums["all"] or not sums["open"]:
            break
        level = (int(sums["all"]) * up - int(sums["held"]) * down, int(sums["open"]) * down)
        if level[0] * den == num * level[1]:
            break
        num, den = level
    level = F.col("weight").cast("double") * F.lit(float(num)) / F.lit(float(den))
    return sources.withColumn("target", F.when(full, limit.cast("double")).otherwise(level))


def _with_sources(counted: DataFrame, sources: DataFrame) -> DataFrame:
    """Units with their source's numbers: broadcast where few, else spread over salts so that no source gathers."""
    columns = ["source", "rank", "source_size", "n_units", "target"]
    few = sources.select(*columns).withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if sources.count() <= MAX_BROADCAST:
        return counted.join(F.broadcast(few), same).drop("_source")
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = counted.withColumn("salt", F.pmod("mark", F.lit(SALTS)))
    return dealt.join(salted, same & (F.col("salt") == F.col("_salt"))).drop("_source", "_salt", "salt")


def _fold(group: Column, level: int) -> Column:
    """Pivotal rounding along a group: its decided members, and the one that holds the residual.

    A member has `size`, `held` (its expected words, at most its size), `up` and further fields. Of two,
    one is drawn to take all it can of both; then it is full, or the other is empty.
    """

    def put(member: Column, held: Column) -> Column:
        return member.withField("held", held)

    def step(state: Column, new: Column) -> Column:
        old = state["open"]

        def settle_pair(total: Column) -> Column:
            up = F.least(old["size"] - old["held"], new["held"])
            down = F.least(old["held"], new["size"] - new["held"])
            chance = F.coalesce(F.try_divide(down, up + down), F.lit(0.0))
            first = _draw(F.lit(level), old["mark"], new["mark"], F.size(state["done"])) < chance

            def outcome(taker: Column, other: Column) -> Column:
                whole = total >= taker["size"]
                full, rest = put(taker, taker["size"]), put(other, total - taker["size"])
                empty, kept = put(other, F.lit(0.0)), put(taker, total)
                return F.when(whole, F.struct(full.alias("done"), rest.alias("open"))).otherwise(F.struct(empty.alias("done"), kept.alias("open")))

            return F.when(first, outcome(old, new)).otherwise(outcome(new, old))

        return let(
            let(old["held"] + new["held"], settle_pair),
            lambda out: F.struct(F.concat(state["done"], F.array(out["done"])).alias("done"), out["open"].alias("open")),
        )

    def fold(ordered: Column) -> Column:
        start = F.struct(F.slice(ordered, 1, 0).alias("done"), F.element_at(ordered, 1).alias("open"))
        return F.aggregate(F.slice(ordered, 2, F.size(ordered)), start, step)

    return let(group, fold)


def round_fractions(members: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(rank, member) with `held` rounded to 0 or `size`: the reduction tree over (rank, groups, member)."""
    done, level = [], 0
    open_ = members.withColumn("groups", F.greatest(F.ceil(F.col("groups") / fanout), F.lit(1)).cast("long"))
    while True:
        depth = open_.agg(F.max("groups").alias("groups")).first()["groups"]
        if depth is None:
            break
        member = F.col("member")
        # A larger size sorts first; equal members are interchangeable.
        ordered = F.transform(
            F.array_sort(F.collect_list(F.struct((-member["size"]).alias("after"), member["mark"].alias("mark"), member.alias("member")))),
            lambda x: x["member"],
        )
        dealt = open_.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), member["mark"]), F.col("groups")))
        grouped = dealt.groupBy("rank", "groups", "bucket").agg(ordered.alias("members"))
        folded = settle(grouped.select("rank", "groups", _fold(F.col("members"), level).alias("state")))
        done.append(folded.select("rank", F.explode("state.done").alias("member")))
        last = F.col("groups") == 1
        open_ = folded.filter(~last).select("rank", F.ceil(F.col("groups") / fanout).cast("long").alias("groups"), F.col("state.open").alias("member"))
        final = folded.filter(last).select("rank", F.col("state.open").alias("member"))
        member = F.col("member")
        held = F.when(member["held"] * 2 >= member["size"], member["size"]).otherwise(F.lit(0.0))
        done.append(final.withColumn("member", member.withField("held", held)))
        level += 1
        if depth <= 1:
            break
    if not done:
        return members.select("rank", "member")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    most: int = MOST,
    fanout: int = FANOUT,
) -> DataFrame:
    """(key, source, size, source_size, target, copies): how often each row is taken. One row per row of `documents`.

    `share[0] / share[1]` must not exceed `most`, or the targets cannot hold the total.
    """
    if share[0] > most * share[1]:
        raise ValueError("the wanted share does not fit under the limit per source")
    counted = settle(units(documents, key=key, text=text, source=source))
    sources = settle(targets(settle(ranked_sources(counted, weights)), share, most))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    parts = _with_sources(counted, sources).withColumn("low", F.floor(rate).cast("long")).withColumn("part", rate - F.floor(rate))
    mass = F.col("m") * F.col("part")
    parts = settle(parts.withColumn("ups", F.least(F.floor(mass), F.col("m")).cast("long")).withColumn("held", (mass - F.floor(mass)) * F.col("size")))
    carried = ["key", "source", "size", "m", "source_size", "target", "low", "ups"]
    drawn = (F.col("held") > 0) & (F.col("ups") < F.col("m"))
    member = F.struct(
        "mark", F.col("size").cast("double").alias("size"), "held", F.struct(*carried).alias("of")
    )
    rounded = round_fractions(parts.filter(drawn).select("rank", F.col("n_units").alias("groups"), member.alias("member")), fanout)
    decided = rounded.select("member.of.*", (F.col("member.held") > 0).cast("long").alias("extra"))
    settled = parts.filter(~drawn).select(*carried, F.lit(0).cast("long").alias("extra"))
    return _expand(decided.unionByName(settled)).withColumnRenamed("key", key)


def _expand(decided: DataFrame) -> DataFrame:
    """A row per document again: of m equal rows the first `ups + extra` are taken once more than `low`."""
    copies = F.col("low") + (F.col("i") <= F.col("ups") + F.col("extra")).cast("long")
    one = F.lit(1).cast("long")

    def rows(df: DataFrame, first: Column, last: Column) -> DataFrame:
        return df.withColumn("i", F.explode(F.sequence(first, last))).select("key", "source", "size", "source_size", "target", copies.alias("copies"))

    many = F.col("m") > COPIES_PER_ROW
    blocks = decided.filter(many).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES_PER_ROW))))
    first = F.col("b") * COPIES_PER_ROW + 1
    spread = rows(blocks.repartition("key", "b"), first, F.least(F.col("m"), first + (COPIES_PER_ROW - 1)))
    return rows(decided.filter(~many), one, F.col("m")).unionByName(spread)


def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each of all `documents` the mix takes, repeats counted."""
    mixed = mix(spark.read.parquet(f"{folder}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")

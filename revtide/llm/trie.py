"""The prefix trie of conversations as a z-fast trie: hashed handles, fat binary search, batches of insertions.

Conversations are strings of turns; the trie has a node per distinct prefix. It is kept compacted: a node
stands for the depths (lo, hi] of its representative conversation along which nothing branches or ends, and
is found by its handle, the prefix at the 2-fattest depth in (lo, hi].

1. Turns are numbered along each conversation and rebuilt; a prefix is told by the sum of 93-bit hashes of
   (depth, role, text), a running sum that is sliced where one conversation holds very many turns.
2. Equal conversations are counted and share one string.
3. A batch locates all waiting strings: a fat binary search over handles, one join per probe and as many
   probes as the longest string's length has bits, then a look at the child in the string's direction, then
   the last depth that agrees along the exit node. Of all strings that leave the trie at the same place with
   the same next turn, one drawn by hash is inserted; exit nodes are split at all depths where strings leave or
   end. Since the draw is random, the strings that wait at one place halve in expectation with each batch.
4. Sums over subtrees are taken on the compacted trie by pointer doubling.
5. Edges are expanded to a node per depth.

Turns are ordered by turn number, NULL first, ties by hashes of role and text (so the order does not depend
on how rows are stored). NULL roles and texts are empty, rows without conv_id belong to no conversation, extra
columns are ignored, and an empty table has no nodes. Texts are read in the scan stage and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.llm.tasks import map_arrow
from revtide.plans.runs import ROWS_PER_SLICE, running
from revtide.session import settle

CODE = "decimal(38,0)"
HEADS = 6  # conversations share up to HEADS - 1 turns
GROUP = 100
IDS_PER_CHUNK_BITS = 12
DEPTHS_PER_ROW = 10_000
PROBES_PER_STAGE = 2


def _code(depth: Column) -> Column:
    """A 93-bit number for a turn at a depth."""
    high = F.xxhash64(F.col("a"), F.col("b"), depth).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return (high + F.pmod(F.xxhash64(F.col("b"), depth, F.col("a")), F.lit(1_000_000_000)).cast("decimal(10,0)")).cast("decimal(30,0)")


# -- conversations as strings of turns ---------------------------------------------------------


def numbered(
    conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows_per_slice: int | None = ROWS_PER_SLICE
) -> DataFrame:
    """(conv_id, pos, a, b, width): turns of each conversation from 1, with two hashes and the length of the text."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = conversations.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 63))).alias("at"),
        F.xxhash64(F.lit(1), who, said).alias("a"),
        F.xxhash64(F.lit(2), who, said).alias("b"),
        F.length(said).cast("long").alias("width"),
    )
    return running(turns, ["conv_id"], ["at", "a", "b"], total={"pos": F.lit(1)}, rows_per_slice=rows_per_slice).drop("at")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id), and their turns (conv_id, depth, a, b, width) after the shared head is put in.

    The head are the first h turns of the conversation whose id is a multiple of `GROUP`, h by the id's checksum.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    ids = turns.select("conv_id").distinct().withColumn("h", h).withColumn("base", base)
    heads = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).withColumnsRenamed({"conv_id": "base", "pos": "depth"})
    lead = ids.join(heads, "base").filter(F.col("depth") <= F.col("h"))
    held = heads.groupBy("base").agg(F.max("depth").alias("held"))
    own = turns.withColumn("h", h).filter(F.col("pos") > F.col("h")).withColumn("base", base).join(held, "base", "left")
    depth = F.least(F.col("h"), F.coalesce("held", F.lit(0).cast("long"))) + F.col("pos") - F.col("h")
    columns = ["conv_id", "depth", "a", "b", "width"]
    return ids.select("conv_id"), lead.select(*columns).unionByName(own.withColumn("depth", depth).select(*columns))


# -- the compacted trie ------------------------------------------------------------------------


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that is divisible by the largest power of two."""
    low = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", b, low), low)


def _described(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes (rep, lo, hi) with the codes of their extent, parent, handle and first turn, and text up to both ends."""
    marks = F.inline(
        F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), at.alias("depth"))
                for kind, at in (("id", F.col("hi")), ("parent", F.col("lo")), ("handle", two_fattest(F.col("lo"), F.col("hi"))), ("name", F.col("lo") + 1))
            ]
        )
    )
    found = nodes.select("rep", "lo", "hi", marks).join(paths.withColumnRenamed("sid", "rep"), ["rep", "depth"])

    def of(kind: str, column: str = "code") -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    zero = F.lit(0)
    return found.groupBy("rep", "lo", "hi").agg(
        of("id").alias("id"),
        F.coalesce(of("parent"), zero.cast(CODE)).alias("parent"),
        of("handle").alias("handle"),
        of("name").alias("name"),
        of("id", "upto").alias("upto_hi"),
        F.coalesce(of("parent", "upto"), zero.cast("long")).alias("upto_lo"),
    )


def _locate(waiting: DataFrame, nodes: DataFrame, paths: DataFrame, probes: int) -> DataFrame:
    """(sid, size, exit, rep, lo, hi, lcp) of every waiting string: its exit node (NULL is the root) and how far it agrees."""
    none = (-F.col("sid")).cast(CODE)  # no prefix has so small a code
    handles = nodes.select(F.col("handle").alias("code"), F.struct("id", "rep", "lo", "hi").alias("hit"))
    names = nodes.select(F.col("name").alias("code"), F.struct("id", "rep", "lo", "hi").alias("child"))
    at = F.lit(None).cast(handles.schema["hit"].dataType)
    state = waiting.select("sid", "size", F.lit(0).cast("long").alias("a"), F.col("size").alias("b"), at.alias("node"))

    def coded(df: DataFrame, depth: Column) -> DataFrame:
        joined = df.withColumn("depth", depth).join(paths.select("sid", "depth", "code"), ["sid", "depth"], "left")
        return joined.withColumn("code", F.coalesce("code", none)).drop("depth")

    done = None
    for probe in range(1, probes + 1):
        open_ = F.col("a") < F.col("b")
        state = coded(state.withColumn("f", F.when(open_, two_fattest(F.col("a"), F.col("b"))).otherwise(0)), F.col("f"))
        state = state.join(handles, "code", "left")
        hit = F.col("hit").isNotNull()
        state = state.select(
            "sid",
            "size",
            F.when(hit, F.least("hit.hi", "b")).otherwise(F.col("a")).alias("a"),
            F.when(open_ & ~hit, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
            F.coalesce("hit", "node").alias("node"),
        )
        if probe % PROBES_PER_STAGE == 0 or probe == probes:  # short plans; strings that are found stay behind
            state = settle(state)
            found = state.filter(F.col("a") >= F.col("b"))
            done = found if done is None else done.unionByName(found)
            state = state.filter(F.col("a") < F.col("b"))
            if probe < probes and state.isEmpty():
                break
    state = coded(done, F.coalesce("node.hi", F.lit(0).cast("long")) + 1).join(names, "code", "left")
    state = state.select("sid", "size", F.coalesce("child", "node").alias("node")).select("sid", "size", F.col("node.id").alias("exit"), "node.rep", "node.lo", "node.hi")
    along = state.filter(F.col("exit").isNotNull()).select("sid", "rep", "lo", "hi").join(paths.select("sid", "depth", "code"), "sid")
    along = along.filter((F.col("depth") > F.col("lo")) & (F.col("depth") <= F.col("hi"))).select("sid", "rep", "depth", "code")
    same = paths.select(F.col("sid").alias("rep"), "depth", "code")
    agreed = along.join(same, ["rep", "depth", "code"]).groupBy("sid").agg(F.max("depth").alias("agreed"))
    lcp = F.coalesce("agreed", "lo", F.lit(0).cast("long"))
    return state.join(agreed, "sid", "left").select("sid", "size", "exit", "rep", "lo", "hi", lcp.alias("lcp"))


def _insert(located: DataFrame, nodes: DataFrame | None, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie with one string of each (place, next turn) put in, and the strings that still wait."""
    further = located.filter(F.col("lcp") < F.col("size")).withColumn("depth", F.col("lcp") + 1).join(paths.select("sid", "depth", "code"), ["sid", "depth"])
    drawn = further.groupBy("code").agg(F.min_by(F.struct("sid", "size", "lcp"), F.xxhash64("sid")).alias("of"))
    drawn = settle(drawn.select("of.*"))
    leaves = drawn.select(F.col("sid").alias("rep"), F.col("lcp").alias("lo"), F.col("size").alias("hi"))
    waiting = settle(further.join(drawn.select("sid"), "sid", "left_anti").select("sid", "size"))
    if nodes is None:
        return settle(_described(leaves, paths)), waiting
    inner = (F.col("lo") < F.col("lcp")) & (F.col("lcp") < F.col("hi"))
    splits = located.filter(F.col("exit").isNotNull() & inner).groupBy(F.col("exit").alias("id"), "rep", "lo", "hi").agg(F.collect_set("lcp").alias("cuts"))
    # Of (lo, hi] cut at c1 < c2 ...: (lo, c1], (c1, c2], ..., (ck, hi].
    stops = F.array_sort(F.concat("cuts", F.array("hi")))
    pieces = splits.select("rep", "lo", F.posexplode(stops).alias("i", "stop"), stops.alias("stops"))
    pieces = pieces.select("rep", F.when(F.col("i") == 0, F.col("lo")).otherwise(F.get("stops", F.col("i") - 1)).alias("lo"), F.col("stop").alias("hi"))
    kept = nodes.join(splits.select("id"), "id", "left_anti").select(*nodes.columns)
    return settle(kept.unionByName(_described(leaves.unionByName(pieces), paths))), waiting


def build(strings: DataFrame, paths: DataFrame) -> DataFrame:
    """The compacted trie of strings (sid, size >= 1) with paths (sid, depth, code, upto).

    One row per node: rep, lo, hi, id, parent, handle, name, upto_hi, upto_lo; parent 0 is the root.
    """
    nothing = F.lit(None)
    first = strings.select("sid", "size", nothing.cast(CODE).alias("exit"), *[nothing.cast("long").alias(c) for c in ("rep", "lo", "hi")], F.lit(0).cast("long").alias("lcp"))
    nodes, waiting = _insert(first, None, paths)
    while True:
        longest = waiting.agg(F.max("size")).first()[0]
        if longest is None:
            return nodes
        located = settle(_locate(waiting, nodes, paths, longest.bit_length()))
        nodes, waiting = _insert(located, nodes, paths)


# -- sums over subtrees ------------------------------------------------------------------------


def _ancestors(nodes: DataFrame) -> list[DataFrame]:
    """(id, up): the ancestors at distance 1, 2, 4, ...; the root is 0."""
    found, jump = [], settle(nodes.select("id", F.col("parent").alias("up")))
    while not jump.isEmpty():
        found.append(jump)
        jump = settle(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")))
    return found


def _over_subtrees(values: DataFrame, jumps: list[DataFrame], columns: dict[str, str]) -> DataFrame:
    """(id, columns) summed (or the least, as `columns` says) over all descendants and the node itself.

    After k steps a node holds all descendants nearer than 2 ** k.
    """
    how = {"sum": F.sum, "min": F.min}
    for jump in jumps:
        sent = values.join(jump, "id").select(F.col("up").alias("id"), *columns)
        values = settle(values.unionByName(sent).groupBy("id").agg(*[how[h](c).alias(c) for c, h in columns.items()]))
    return values


# -- all nodes ---------------------------------------------------------------------------------


def ends(conversations: DataFrame) -> DataFrame:
    """(id, ends_sha256) of nodes at which conversations (conv_id, id) end: the digest of their ids in order.

    Ids are joined in chunks first; a digest reads its chunks in order, a batch at a time.
    """
    chunk = F.shiftright("conv_id", IDS_PER_CHUNK_BITS).alias("chunk")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = conversations.groupBy("id", chunk).agg(ids.alias("ids")).withColumn("id", F.col("id").cast("string"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=["id", "ends_sha256"])

        for batch in batches:
            for node, ids in zip(batch["id"].to_pylist(), batch["ids"].to_pylist()):
                if node != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield out()
            done.clear()
        if state is not None:
            done.append((current, state.hexdigest()))
        yield out()

    ordered = chunks.repartition("id").sortWithinPartitions("id", "chunk").select("id", "ids")
    return map_arrow(ordered, digest, "id string, ends_sha256 string").withColumn("id", F.col("id").cast(CODE))


def trie(
    conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows_per_slice: int | None = ROWS_PER_SLICE
) -> DataFrame:
    """A row per node of the trie of rebuilt conversations, see the module; `code` tells the prefix."""
    zero = F.lit(0).cast("long")
    turns = settle(numbered(conversations, key=key, turn=turn, role=role, text=text, rows_per_slice=rows_per_slice))
    ids, rows = rebuilt(turns)
    rows = rows.withColumn("turn_code", _code(F.col("depth")))
    prefixes = running(
        rows.select("conv_id", "depth", "width", "turn_code"), ["conv_id"], ["depth"],
        total={"code": F.col("turn_code"), "upto": F.col("width")}, rows_per_slice=rows_per_slice,
    )
    prefixes = settle(prefixes.select("conv_id", "depth", "width", F.col("code").cast(CODE).alias("code"), "upto"))
    last = prefixes.groupBy("conv_id").agg(F.max("depth").alias("size"))
    last = last.join(prefixes.select("conv_id", F.col("depth").alias("size"), "code"), ["conv_id", "size"])
    whole = settle(
        ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("size", zero).alias("size"), F.coalesce("code", F.lit(0).cast(CODE)).alias("id"))
    )
    ended = settle(whole.groupBy("id", "size").agg(F.min("conv_id").alias("sid"), F.count(F.lit(1)).alias("n")))
    strings = ended.filter(F.col("size") > 0)
    paths = settle(prefixes.join(strings.select(F.col("sid").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "sid"))
    nodes = build(strings.select("sid", "size"), paths.drop("width"))

    jumps = _ancestors(nodes)
    kids = nodes.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    root = whole.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select(F.lit(0).cast(CODE).alias("id"))
    known = nodes.select("id", "parent", "rep", "lo", "hi", "upto_lo", "upto_hi").unionByName(root, allowMissingColumns=True)
    known = settle(known.join(kids, "id", "left").join(ended.select("id", "n", F.col("sid").alias("least")), "id", "left"))
    own = known.select("id", F.coalesce("n", zero).alias("n"), "least", F.col("kids").isNull().cast("long").alias("leaves"))
    counted = _over_subtrees(own, jumps, {"n": "sum", "least": "min", "leaves": "sum"})
    edges = known.drop("n", "least").join(counted, "id").withColumn("spared", F.coalesce((F.col("n") - 1) * (F.col("upto_hi") - F.col("upto_lo")), zero))
    edges = settle(edges)
    saved = _over_subtrees(edges.select("id", F.col("spared").alias("saved")), jumps, {"saved": "sum"})
    above = counted.select(F.col("id").alias("parent"), F.col("least").alias("above"))
    full = edges.join(saved, "id").join(above, "parent", "left").join(ends(whole.select("conv_id", "id")), "id", "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    full = settle(full.withColumn("ends_sha256", F.coalesce("ends_sha256", empty)))

    top = full.filter(F.col("lo").isNull()).select(
        F.col("least").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("kids", zero).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256", F.col("id").alias("code"),
    )
    blocks = full.filter(F.col("lo").isNotNull()).withColumn("from", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"), F.lit(DEPTHS_PER_ROW).cast("long"))))
    depths = blocks.withColumn("depth", F.explode(F.sequence("from", F.least(F.col("hi"), F.col("from") + (DEPTHS_PER_ROW - 1)))))
    placed = depths.join(paths.select(F.col("sid").alias("rep"), "depth", "width", "code", "upto"), ["rep", "depth"])
    at_end = F.col("depth") == F.col("hi")
    return top.unionByName(
        placed.select(
            F.col("least").alias("conv_id"),
            "depth",
            F.when(F.col("depth") == F.col("lo") + 1, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(at_end, F.coalesce("kids", zero)).otherwise(F.lit(1).cast("long")).alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("saved") - (F.col("n") - 1) * (F.col("upto") - F.col("width") - F.col("upto_lo"))).alias("saved_tokens"),
            F.when(at_end, F.col("ends_sha256")).otherwise(empty).alias("ends_sha256"),
            "code",
        )
    )


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of the prefix trie of all rebuilt `conversations`."""
    return trie(spark.read.parquet(f"{folder}/conversations.parquet")).drop("code")

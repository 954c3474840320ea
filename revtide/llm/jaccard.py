"""Exact n-gram Jaccard join by pivots, and the classes it links.

Jaccard distance is a metric, but in prose nearly all pairs of documents are at distance 1, so a few
document pivots at the top would make every document a boundary document of every region (measured on
the test tables; see README). The join therefore works in levels:

1. Equal sets are one node, found by a digest. Shingles that occur in one set only are counted out; a
   set in which more than 1 - t of the shingles are such has distance above 1 - t to every other set
   and is done.
2. Single shingles are the first pivots. Two sets within the distance share one of the first
   |x| - ceil(t |x|) + 1 shingles of both in any common order (rarest first), so a set is replicated to
   the shingles in that window only. Of the sets that meet at a shingle the most central one (fewest
   rare shingles) becomes its pivot document, and the sets meeting there join the pivot's region.
3. Every set is compared with its pivots, which links the sets within the distance of a pivot. Where a
   region still holds several components, the sets outside its largest one become pivots in turn. By the
   triangle inequality only sets whose distances to the region's pivot differ by the radius at most can
   be linked, so a region is cut into rings of that width and such a set is replicated to its own ring
   and the two beside it. Large rings are cut into blocks, and pairs of blocks are tasks of their own.

Connected components join the links of all regions. No group is ever gathered whole, and no pair is
dropped: links are left out only between sets that other links connect anyway.

Documents: A-Z lower-cased, words split at ASCII white space; with fewer words than a shingle has, the
whole sequence is one shingle; without words (NULL, empty) the set is empty and linked with nothing.
Repeated rows are copies like others. NULL keys never name a class while it has another key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.llm import shards as S
from revtide.llm import words as W
from revtide.llm.components import connect
from revtide.llm.naming import aside, restore
from revtide.llm.tasks import map_arrow, per_group
from revtide.session import settle

SHINGLE = 4
PERCENT = 85
BATCH_BYTES = 12 << 20
BLOCK_TOKENS = 128_000
ROWS_PER_BUCKET = 5000

_ASK = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("head", pa.bool_()), ("payload", pa.binary())])
ASK = "bucket long, batch long, head boolean, payload binary"


def least_shared(size, percent: int = PERCENT):
    """Shingles that a set of `size` shares at least with any set it is linked with."""
    return -(-size * percent // 100)


def linked(shared, a, b, percent: int = PERCENT):
    return 100 * shared >= percent * (a + b - shared)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash), distinct, by row and hash."""
    words = W.words_of(texts, lower=True)
    good = W.inside(words.counts, shingle)
    doc = words.doc
    rows, hashes = [doc[: len(good)][good]], [W.windows(words.hashes, shingle)[good]]
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    for row in short:
        a, b = words.bounds[row], words.bounds[row + 1]
        rows.append(np.array([row]))
        hashes.append(W.windows(words.hashes[a:b], int(b - a)))
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


class Batch:
    """Distinct sets of some documents: digests, sizes, keys of the documents that have each."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.sizes: list[int] = []
        self.keys: list[list] = []
        self.owner: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.bytes = 0

    def add(self, keys: list, texts: pa.Array, shingle: int) -> None:
        rows, values = shingle_sets(texts, shingle)
        self.bytes += texts.nbytes
        bounds = np.searchsorted(rows, np.arange(len(keys) + 1))
        for i, key in enumerate(keys):
            own = values[bounds[i] : bounds[i + 1]]
            digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            at = self.number.setdefault(digest, len(self.sizes))
            if at == len(self.sizes):
                self.sizes.append(len(own))
                self.keys.append([])
                self.tokens.append(own)
                self.owner.append(np.full(len(own), at, np.uint32))
            self.keys[at].append(key)

    def rows(self, buckets: int, kind: pa.DataType, place: int) -> Iterator[tuple]:
        """(bucket, batch, head, payload): what the batch asks of each bucket, and its head.

        The batch's id holds its place in the partition: neighbours may have the very same sets.
        A shingle that several sets of the batch have is asked once, with its count.
        """
        names = list(self.number)
        batch = int.from_bytes(hashlib.blake2b(b"".join(names) + f"{TaskContext.get().partitionId()} {place}".encode(), digest_size=8).digest(), "little", signed=True)
        token = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.uint64)
        owner = np.concatenate(self.owner) if self.owner else np.zeros(0, np.uint32)
        short = np.array([int.from_bytes(n[:8], "little") for n in names], np.uint64)
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((owner, token, bucket))
        token, owner, bucket = token[order], owner[order], bucket[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(token)))
        many = count > 1
        known, known_count, known_bucket = token[first[many]], count[many].astype(np.uint32), bucket[first[many]]
        single, single_owner, single_bucket = token[first[~many]], owner[first[~many]], bucket[first[~many]]
        order = np.lexsort((single_owner, single_bucket))
        single, single_owner, single_bucket = single[order], single_owner[order], single_bucket[order]
        for b in np.unique(bucket).tolist():
            a, z = np.searchsorted(known_bucket, [b, b + 1])
            c, y = np.searchsorted(single_bucket, [b, b + 1])
            used, sizes = np.unique(single_owner[c:y], return_counts=True)
            head = np.array([z - a, len(used), y - c], np.uint32)
            parts = (head, known_count[a:z], used.astype(np.uint32), sizes.astype(np.uint32), known[a:z], short[used], single[c:y])
            yield b, batch, False, b"".join(p.tobytes() for p in parts)
        inner = np.repeat(many, count)
        members = pa.table(
            {
                "digest": pa.array(names, pa.binary()),
                "n": pa.array(self.sizes, pa.int64()),
                "keys": pa.array(self.keys, pa.list_(kind)),
            }
        )
        local = pa.table({"token": pa.array(np.repeat(known, known_count)), "owner": pa.array(owner[inner]), "bucket": pa.array(np.repeat(known_bucket, known_count))})
        yield batch % buckets, batch, True, _pair(S.pack(members), S.pack(local))


def _pair(a: bytes, b: bytes) -> bytes:
    return np.uint64(len(a)).tobytes() + a + b


def _unpair(data: bytes) -> tuple[pa.Table, pa.Table]:
    cut = 8 + int(np.frombuffer(data, np.uint64, 1)[0])
    return S.unpack(data[8:cut]), S.unpack(data[cut:])


def _asker(buckets: int, shingle: int, kind: pa.DataType):
    def out(batch: Batch, place: int) -> pa.RecordBatch:
        rows = list(batch.rows(buckets, kind, place))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _ASK.types)], schema=_ASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place = Batch(), 0
        for batch in batches:
            for part in W.slices(batch, "_text"):
                current.add(part.column(0).to_pylist(), part.column(1), shingle)
                if current.bytes >= BATCH_BYTES:
                    yield out(current, place)
                    current, place = Batch(), place + 1
        if current.number:
            yield out(current, place)

    return run


def _parse(data: bytes) -> list[np.ndarray]:
    """known counts, owners used, their numbers of singles, known, owners' digests, singles."""
    n_known, n_used, n_single = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    out, at = [], 12
    for size, kind in ((n_known, np.uint32), (n_used, np.uint32), (n_used, np.uint32), (n_known, np.uint64), (n_used, np.uint64), (n_single, np.uint64)):
        out.append(np.frombuffer(data, kind, size, at))
        at += size * out[-1].itemsize
    return out


def rarity(count: np.ndarray) -> np.ndarray:
    """A class of how many sets have a shingle, fine enough to order by."""
    return np.minimum(4 * np.log2(np.maximum(count, 1)), 255).astype(np.uint8)


def _counter(table: pa.Table) -> pa.Table:
    """In a bucket: how many sets have each shingle; answers what a batch needs to know."""
    heads = table.filter(table["head"])
    asked = table.filter(pa.compute.invert(table["head"]))
    parsed = [_parse(p.as_py()) for p in asked["payload"]]
    answers = []
    if parsed:
        known = np.concatenate([p[3] for p in parsed])
        known_count = np.concatenate([p[0] for p in parsed]).astype(np.int64)
        single = np.concatenate([p[5] for p in parsed])
        digest = np.concatenate([np.repeat(p[4], p[2]) for p in parsed])
        order = np.lexsort((digest, single))  # a set in several batches counts once
        s, d = single[order], digest[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        every = np.concatenate([s[new], known])
        weight = np.concatenate([np.ones(int(new.sum()), np.int64), known_count])
        names, inverse = np.unique(every, return_inverse=True)
        total = np.bincount(inverse, weight, len(names)).astype(np.int64)
        for p in parsed:
            known_class = rarity(total[np.searchsorted(names, p[3])])
            count = total[np.searchsorted(names, p[5])]
            shared = count > 1
            owner = np.repeat(p[1], p[2])[shared]
            head = np.array([len(known_class), len(owner)], np.uint32)
            answers.append(b"".join(x.tobytes() for x in (head, owner, p[5][shared], known_class, rarity(count[shared]))))
    return pa.table(
        [
            pa.concat_arrays([heads["batch"].combine_chunks(), asked["batch"].combine_chunks()]) if table.num_rows else pa.array([], pa.int64()),
            pa.array([-1] * heads.num_rows + asked["bucket"].to_pylist(), pa.int64()),
            pa.array(heads["payload"].to_pylist() + answers, pa.binary()),
        ],
        names=["batch", "bucket", "payload"],
    )


def _gatherer(percent: int):
    def run(table: pa.Table) -> pa.Table:
        buckets = table["bucket"].to_pylist()
        payloads = dict(zip(buckets, table["payload"]))
        members, local = _unpair(payloads.pop(-1).as_py())
        sizes = members["n"].to_numpy()
        local_token, local_owner, local_bucket = (local[c].to_numpy() for c in ("token", "owner", "bucket"))
        token, owner, level = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
        for bucket, payload in payloads.items():
            data = payload.as_py()
            n_known, n_owner = (int(x) for x in np.frombuffer(data, np.uint32, 2))
            owner.append(np.frombuffer(data, np.uint32, n_owner, 8))
            token.append(np.frombuffer(data, np.uint64, n_owner, 8 + 4 * n_owner))
            known_class = np.frombuffer(data, np.uint8, n_known, 8 + 12 * n_owner)
            level.append(np.frombuffer(data, np.uint8, n_owner, 8 + 12 * n_owner + n_known))
            a, b = np.searchsorted(local_bucket, [bucket, bucket + 1])
            mine = local_token[a:b]
            place = np.cumsum(np.concatenate([[True], mine[1:] != mine[:-1]])) - 1 if b > a else np.zeros(0, np.int64)
            token.append(mine)
            owner.append(local_owner[a:b])
            level.append(known_class[place])
        token, owner, level = np.concatenate(token), np.concatenate(owner).astype(np.int64), np.concatenate(level)
        order = np.lexsort((token, level, owner))
        token, owner, level = token[order], owner[order], level[order]
        shared = np.bincount(owner, minlength=len(sizes))
        lone = sizes - shared
        active = (shared > 0) & (shared >= least_shared(sizes, percent))
        window = np.where(active, sizes - least_shared(sizes, percent) + 1 - lone, 0)
        rare = np.bincount(owner, np.exp2(-level / 4), len(sizes)) + lone
        keep = active[owner]
        offsets = np.concatenate([[0], np.cumsum(np.where(active, shared, 0))]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(token[keep].view(np.int64), pa.int64()))
        return pa.table(
            [members["digest"], members["n"], members["keys"], tokens, pa.array(window, pa.int32()), pa.array(rare / np.maximum(sizes, 1))],
            names=["digest", "n", "keys", "tokens", "window", "rare"],
        )

    return run


class Region:
    """Sets of a part of a region: sizes, and shingles as numbers local to it."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], percent: int):
        self.sizes, self.percent = sizes, percent
        _, self.ids = np.unique(np.concatenate(tokens), return_inverse=True)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.mark = np.zeros(int(self.ids.max()) + 1, np.int64)

    def shared_with(self, i: int) -> np.ndarray:
        own = self.ids[self.bounds[i] : self.bounds[i + 1]]
        self.mark[own] = 1
        out = np.add.reduceat(self.mark[self.ids], self.bounds[:-1])
        self.mark[own] = 0
        return out

    def links_of(self, i: int) -> np.ndarray:
        return linked(self.shared_with(i), self.sizes, self.sizes[i], self.percent)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in the first `keys` columns."""
    waiting: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        names = list(zip(*(table.column(i).to_pylist() for i in range(keys))))
        cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if waiting and names[a] != last:
                yield pa.concat_tables(waiting)
                waiting = []
            waiting.append(table.slice(a, b - a))
            last = names[a]
    if waiting:
        yield pa.concat_tables(waiting)


def _tokens(table: pa.Table) -> list[np.ndarray]:
    return [t.values.to_numpy().view(np.uint64) for t in table["tokens"]]


def _to_pivot(percent: int):
    """Distance of every set to the pivot of its region; the pivot leads each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            region = Region(table["n"].to_numpy(), _tokens(table), percent)
            shared = region.shared_with(0)
            distance = 1 - shared / (region.sizes + region.sizes[0] - shared)
            near = linked(shared, region.sizes, region.sizes[0], percent)
            yield pa.RecordBatch.from_arrays(
                [c.combine_chunks() for c in (table["pivot"], table["digest"])] + [pa.array(distance), pa.array(near)], ["pivot", "digest", "distance", "near"]
            )

    return run


def _between(percent: int):
    """Links between the sets that the pivot left apart (`apart`) and the others of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 4):
            digests, roots, distance = table["digest"].to_pylist(), table["root"].to_pylist(), table["distance"].to_numpy()
            apart = table["apart"].to_numpy(zero_copy_only=False)
            if apart.all() or not apart.any():
                continue
            region = Region(table["n"].to_numpy(), _tokens(table), percent)
            _, parent = np.unique(roots, return_inverse=True)
            found = []
            for at in np.flatnonzero(apart).tolist():
                # Only other components matter, and only distances to the pivot that differ by the radius.
                hope = ~apart & (parent != parent[at]) & (np.abs(distance - distance[at]) <= _radius(percent))
                if hope.any():
                    for j in np.flatnonzero(hope & region.links_of(at)).tolist():
                        if parent[j] != parent[at]:
                            found.append((digests[at], digests[j]))
                            parent[parent == parent[j]] = parent[at]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    return run


def _radius(percent: int) -> float:
    return 1 - percent / 100 + 1e-9


def _blocks(size: Column) -> Column:
    return F.ceil(size / F.lit(BLOCK_TOKENS)).cast("int")


def _place(digest: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(1)), blocks).cast("int")


def find_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between the digests of distinct sets, with the same components as all links.

    `sets`: digest, n, tokens (shared shingles, rarest first), window (how many of them lead to
    pivots), rare; a row per set.
    """
    whole = sets.select("digest", "n", "tokens")
    # A pivot is the most central set at its shingle: least rare, then by digest.
    rank = F.struct(F.col("rare"), F.col("digest"))
    meets = sets.select("digest", "rare", F.size("tokens").alias("size"), F.explode(F.slice("tokens", F.lit(1), F.col("window"))).alias("token"))
    pivots = meets.groupBy("token").agg(F.min(rank)["digest"].alias("pivot"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    regions = settle(meets.join(pivots, "token").select("pivot", "digest", "size").distinct())

    # Every set against the pivots of its regions; large regions in blocks, each led by the pivot.
    blocks = regions.groupBy("pivot").agg(_blocks(F.sum("size")).alias("blocks"))
    dealt = regions.join(blocks, "pivot").select("pivot", _place(F.col("digest"), F.col("blocks")).alias("block"), "digest").filter(F.col("digest") != F.col("pivot"))
    led = dealt.withColumn("lead", F.lit(False)).unionByName(dealt.select("pivot", "block", F.col("pivot").alias("digest"), F.lit(True).alias("lead")).distinct())
    full = led.join(whole, "digest").select("pivot", "block", "digest", "lead", "n", "tokens")
    ordered = full.repartition("pivot", "block").sortWithinPartitions("pivot", "block", F.desc("lead"))
    placed = settle(map_arrow(ordered, _to_pivot(percent), "pivot binary, digest binary, distance double, near boolean").distinct())
    by_pivot = placed.filter(F.col("near") & (F.col("pivot") != F.col("digest"))).select(F.col("pivot").alias("a"), F.col("digest").alias("b"))

    # What is connected by now needs no comparison. In a region that holds several components, sets
    # outside the largest one meet the rest of it, within the window of distances to the pivot.
    roots = connect(by_pivot)
    sizes = sets.select("digest", F.size("tokens").alias("size"))
    known = placed.join(roots, F.col("digest") == F.col("node"), "left").join(sizes, "digest").select(
        "pivot", "digest", "distance", "size", F.coalesce("root", "digest").alias("root")
    )
    known = settle(known)
    counted = known.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("_n"))
    largest = counted.groupBy("pivot").agg(F.max(F.struct("_n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    ring = F.floor(F.col("distance") / _radius(percent)).cast("int")
    split = settle(known.join(largest, "pivot").withColumn("ring", ring))
    rest = split.select("pivot", "ring", "digest", "distance", "size", "root")
    apart = split.filter(F.col("root") != F.col("main")).select("pivot", "digest", "distance", "size", "root", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).alias("ring"))
    tiles = rest.groupBy("pivot", "ring").agg(_blocks(F.sum("size")).alias("wide")).join(apart.groupBy("pivot", "ring").agg(_blocks(F.sum("size")).alias("high")), ["pivot", "ring"])

    def tiled(rows: DataFrame, own: str, other: str, flag: bool) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at")
        return rows.join(tiles, ["pivot", "ring"]).select("pivot", "ring", "digest", "distance", "root", _place(F.col("digest"), F.col(own)).alias(f"{own}_at"), every, F.lit(flag).alias("apart"))

    tasks = tiled(rest, "wide", "high", False).unionByName(tiled(apart, "high", "wide", True))
    meeting = tasks.join(whole, "digest").select("pivot", "ring", "wide_at", "high_at", "digest", "distance", "root", "apart", "n", "tokens")
    across = map_arrow(meeting.repartition("pivot", "ring", "wide_at", "high_at").sortWithinPartitions("pivot", "ring", "wide_at", "high_at"), _between(percent), "a binary, b binary")
    return by_pivot.unionByName(across)


def classes(documents: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for every row: the class is named by its smallest key."""
    kind = dict(documents.dtypes)[key]
    buckets = max(S.parts_of(documents), math.ceil(documents.count() / ROWS_PER_BUCKET))
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    arrow_kind = pa.schema(rows.limit(0).toArrow().schema).field("key").type
    asked = map_arrow(rows, _asker(buckets, shingle, arrow_kind), ASK)
    counted = per_group(asked, "bucket", _counter, "batch long, bucket long, payload binary")
    schema = f"digest binary, n long, keys array<{kind}>, tokens array<long>, window int, rare double"
    gathered = settle(per_group(counted, "batch", _gatherer(percent), schema))
    # Batches may have the same set; all of them know the same shared shingles of it.
    active = settle(gathered.filter(F.col("window") > 0).select("digest", "n", "tokens", "window", "rare").dropDuplicates(["digest"]))
    links = settle(find_links(active, percent))
    labels = connect(links)
    sets = gathered.filter(F.col("n") > 0).select("digest", F.array_min("keys").alias("first")).groupBy("digest").agg(F.min("first").alias("first"))
    rooted = sets.join(labels, F.col("digest") == F.col("node"), "left").select("digest", "first", F.coalesce("root", "digest").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(named, "root").select("digest", "component_id")
    members = gathered.select("digest", F.col("n").alias("n_shingles"), F.explode("keys").alias(key))
    return members.join(known, "digest", "left").select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))


def keep_one(documents: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows, whole, that name their class. Rows with one and the same key stay or go together; NULL keys stay."""
    found = classes(documents, key=key, **options)
    gone = settle(found.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct())
    rows, at = aside(documents)
    return restore(rows.join(gone, F.col(at[key]) == F.col("_gone"), "left_anti"), documents.columns)


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all `documents`."""
    return classes(spark.read.parquet(f"{folder}/documents.parquet"))

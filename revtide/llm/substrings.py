"""Substring deduplication with prefix-partitioned suffix trees.

A window of `depth` words is removed where the same words also start in a document with a smaller id.
Suffixes start at words and are followed `depth` words deep.

1. Documents are dealt into shards once; all later steps read that one shuffle.
2. A shard asks which anchors of its windows occur in other documents. The anchor of a window is the
   smallest hash among its runs of (depth + 1) / 2 words, so equal windows have equal anchors, and
   neighbouring windows mostly share theirs. Windows whose anchor is unique cannot repeat and are left.
3. The other suffixes are dealt to groups by prefixes of variable length: a prefix that is too frequent
   (counted over all documents beforehand) is extended until it is not, so that a group is a set of
   whole subtrees that fits into memory. A shard sends each of its distinct suffixes once, with the
   smallest id that has it: however often a passage repeats, a group gets it once from each shard.
4. A group sorts its suffixes and reads its subtrees off the common prefixes of neighbours. Internal
   nodes `depth` words deep are the repeats; each gets the smallest id below it.
5. Repeats return to the shards that have them, which remove the words they cover. Runs of removed
   windows are the maximal repeats.

Ids are integers. Rows with a NULL id neither remove nor lose anything; rows with equal ids do not
remove each other's words. NULL and empty texts have no words. Within a shard windows are told apart
by 64-bit hashes, between shards by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.llm import shards as S
from revtide.llm import words as W
from revtide.llm.tasks import map_arrow, per_group, per_pair, ship

DEPTH = 13
SLOTS = 1 << 16
ROW = "to long, by long, payload binary"
_ROW = pa.schema([("to", pa.int64()), ("by", pa.int64()), ("payload", pa.binary())])


def _rows(to: list, by: list, payloads: list) -> pa.Table:
    return pa.table([pa.array(to, pa.int64()), pa.array(by, pa.int64()), pa.array(payloads, pa.binary())], schema=_ROW)


def levels(depth: int) -> list[int]:
    """Lengths of prefixes tried, shortest first: about half as long again each time."""
    out = [1]
    while out[-1] < depth:
        out.append(min(depth, max(out[-1] + 1, out[-1] * 3 // 2)))
    return out


# -- prefixes of variable length ---------------------------------------------------------------


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def _census(depth: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(levels(depth)) - 1, SLOTS), np.int64)
        for batch in batches:
            for part in W.slices(batch, "_text"):
                words = W.words_of(part.column(0))
                for i, length in enumerate(levels(depth)[:-1]):
                    counts[i] += np.bincount(_slot(W.windows(words.hashes, length)[W.inside(words.counts, length)]), minlength=SLOTS)
        total = max(1, int(counts[0].sum()))
        level, slot = np.nonzero(counts * 8 * groups > total)
        level = np.append(level, -1)  # the total
        slot = np.append(slot, 0)
        yield pa.RecordBatch.from_arrays([pa.array(level, pa.int64()), pa.array(slot, pa.int64()), pa.array(np.append(counts[level[:-1], slot[:-1]], total), pa.int64())], ["level", "slot", "n"])

    return run


def frequent_prefixes(documents: DataFrame, text: str, depth: int, groups: int) -> np.ndarray:
    """For each prefix length and hash slot: whether it is too frequent for a group of its own.

    Counted over all documents. At most 8 * groups slots per length and scan partition leave a task,
    at most 4 * groups per length reach the driver: counts that sum up to a whole.
    """
    rows = documents.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = map_arrow(rows, _census(depth, groups), "level long, slot long, n long").groupBy("level", "slot").agg(F.sum("n").alias("n"))
    total = found.filter("level < 0").agg(F.max("n")).first()[0] or 1
    heavy = np.zeros((len(levels(depth)), SLOTS), bool)
    for row in found.filter((F.col("level") >= 0) & (F.col("n") * 4 * groups > total)).collect():
        heavy[row["level"], row["slot"]] = True
    return heavy


def group_of(hashes: np.ndarray, n: int, heavy: np.ndarray, depth: int, groups: int) -> np.ndarray:
    """The group of the suffixes at the first `n` places: by their shortest prefix that is rare enough."""
    out = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    for level, length in enumerate(levels(depth)):
        prefix = W.windows(hashes, length)[:n]
        out[open_] = (W.mix(prefix[open_]) % np.uint64(groups)).astype(np.int64)
        open_ &= heavy[level][_slot(prefix)]
        if not open_.any():
            break
    return out


# -- shards ------------------------------------------------------------------------------------


class Part:
    """Windows of a few documents of a shard."""

    def __init__(self, table: pa.Table, depth: int):
        self.table, self.depth = table, depth
        self.words = W.words_of(table["text"])
        known = table["key"].is_valid().to_numpy(zero_copy_only=False)
        self.keys = table["key"].fill_null(0).to_numpy().astype(np.int64)
        self.doc = self.words.doc
        good = W.inside(self.words.counts, depth)
        self.at = np.flatnonzero(good & known[self.doc[: len(good)]])

    def windows(self) -> np.ndarray:
        return W.windows(self.words.hashes, self.depth)[self.at]

    def anchors(self) -> np.ndarray:
        size = (self.depth + 1) // 2
        runs = W.windows(self.words.hashes, size)
        n = len(self.words.hashes) - self.depth + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        least = runs[:n].copy()
        for i in range(1, self.depth - size + 1):
            np.minimum(least, runs[i : i + n], out=least)
        return least[self.at]

    def owners(self) -> np.ndarray:
        return self.keys[self.doc[self.at]]

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words joined by one space, and where each begins and ends."""
        text = b" ".join(b"\n".join(t.encode() for t in self.table["text"].to_pylist()).split())
        sizes = self.words.ends - self.words.starts
        ends = np.cumsum(sizes + 1) - 1
        return text, ends - sizes, ends


def _parts(table: pa.Table, depth: int) -> Iterator[Part]:
    for part in S.tables(table["payload"]):
        yield Part(part, depth)


def _anchor_asker(depth: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in _parts(table, depth):
            anchors, owner = part.anchors(), part.owners()
            if len(anchors):
                new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])])
                values.append(anchors[new])
                owners.append(owner[new])
        value, owner = np.concatenate(values), np.concatenate(owners)
        bucket = (value % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((owner, value, bucket))
        value, owner, bucket = value[order], owner[order], bucket[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(value)) - 1
        many = owner[first] != owner[last] if len(value) else np.zeros(0, bool)
        value, bucket = value[first], bucket[first]
        shard = table["shard"][0].as_py()
        to, payloads = [], []
        for b in np.unique(bucket).tolist():
            a, z = np.searchsorted(bucket, [b, b + 1])
            own, twice = value[a:z], many[a:z]
            to.append(b)
            payloads.append(np.uint64(twice.sum()).tobytes() + own[twice].tobytes() + own[~twice].tobytes())
        return _rows(to, [shard] * len(to), payloads)

    return run


def _anchor_counter(table: pa.Table) -> pa.Table:
    """In a bucket: the anchors that occur in several documents, for each shard that has them."""
    asked = []
    for payload in table["payload"]:
        data = np.frombuffer(payload.as_py(), np.uint64)
        asked.append((data[1 : 1 + int(data[0])], data[1 + int(data[0]) :]))
    every = np.sort(np.concatenate([x for twice, once in asked for x in (twice, twice, once)]))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    payloads = []
    for twice, once in asked:
        at = np.minimum(np.searchsorted(shared, once), max(len(shared) - 1, 0))
        hit = once[shared[at] == once] if len(shared) else once[:0]
        payloads.append(np.concatenate([twice, hit]).tobytes())
    return _rows(table["by"].to_pylist(), table["to"].to_pylist(), payloads)


def _suffix_sender(depth: int, groups: int, heavy):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(p.as_py(), np.uint64) for p in right["payload"])]))
        if not len(shared) or not left.num_rows:
            return _rows([], [], [])
        texts: list[bytes] = []
        hashes, owners, starts, ends, source, places = [], [], [], [], [], []
        for part in _parts(left, depth):
            anchors = part.anchors()
            wanted = shared[np.minimum(np.searchsorted(shared, anchors), len(shared) - 1)] == anchors
            if not wanted.any():
                continue
            at = part.at[wanted]
            text, begin, end = part.joined()
            group = group_of(part.words.hashes, len(part.words.hashes) - depth + 1, heavy.value, depth, groups)[at]
            hashes.append(part.windows()[wanted])
            owners.append(part.owners()[wanted])
            starts.append(begin[at])
            ends.append(end[at + depth - 1])
            places.append(group)
            source.append(np.full(len(at), len(texts)))
            texts.append(text)
        if not hashes:
            return _rows([], [], [])
        value, owner, start, end, group, part_of = (np.concatenate(x) for x in (hashes, owners, starts, ends, places, source))
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        last = np.append(first[1:], len(value)) - 1
        least, several = owner[first], owner[first] != owner[last]
        pick = order[first]
        start, end, group, part_of = start[pick].tolist(), end[pick].tolist(), group[pick], part_of[pick].tolist()
        order = np.argsort(group, kind="stable")
        shard = left["shard"][0].as_py()
        to, payloads = np.unique(group).tolist(), []
        cuts = np.searchsorted(group[order], [*to, groups])
        for a, z in zip(cuts, cuts[1:]):
            rows = order[a:z].tolist()
            rows = sorted((texts[part_of[i]][start[i] : end[i]], i) for i in rows)
            own = np.array([i for _, i in rows])
            ids, place = np.unique(least[own], return_inverse=True)
            head = np.array([len(rows), len(ids)], np.uint64).tobytes() + ids.tobytes() + place.astype(np.uint32).tobytes() + several[own].tobytes()
            payloads.append(S.squeeze(head + b"\n".join([s for s, _ in rows])))
        return _rows(to, [shard] * len(to), payloads)

    return run


def deep_nodes(suffixes: list[bytes], order: list[int], depth: int) -> Iterator[tuple[int, int]]:
    """Ranges of `order` (suffixes in sorted order) below the internal nodes that are `depth` words deep.

    Neighbours belong to one such node when their common prefix has `depth` words; the nodes of a
    range of neighbours with one ancestor that deep form its subtree.
    """
    begin, last = 0, None
    for at, i in enumerate(order):
        path = suffixes[i].split(b" ", depth)[:depth] if suffixes[i].count(b" ") >= depth else suffixes[i]
        if path != last:
            if at - begin > 1:
                yield begin, at
            begin, last = at, path
    if len(order) - begin > 1:
        yield begin, len(order)


def _tree(depth: int):
    def run(table: pa.Table) -> pa.Table:
        suffixes: list[bytes] = []
        shards, least, several = [], [], []
        for by, payload in zip(table["by"].to_pylist(), table["payload"]):
            data = S.unsqueeze(payload.as_py())
            n, m = (int(x) for x in np.frombuffer(data, np.uint64, 2))
            at = 16 + 8 * m
            least.append(np.frombuffer(data, np.int64, m, 16)[np.frombuffer(data, np.uint32, n, at)])
            several.append(np.frombuffer(data, bool, n, at + 4 * n))
            suffixes += data[at + 5 * n :].split(b"\n")
            shards.append(np.full(n, by))
        shard, low, twice = np.concatenate(shards), np.concatenate(least), np.concatenate(several)
        order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
        ranges = list(deep_nodes(suffixes, order, depth))
        leaf = np.array(order)
        # A node of one leaf is a repeat where several documents of that shard have it.
        in_node = np.zeros(len(leaf), bool)
        for a, b in ranges:
            in_node[a:b] = True
        alone = np.flatnonzero(~in_node & twice[leaf])
        begin = np.concatenate([np.array([a for a, _ in ranges], np.int64), alone])
        size = np.concatenate([np.array([b - a for a, b in ranges], np.int64), np.ones(len(alone), np.int64)])
        if not len(begin):
            return _rows([], [], [])
        first = np.cumsum(size) - size
        rows = leaf[np.repeat(begin - first, size) + np.arange(size.sum())]
        smallest = np.repeat(np.minimum.reduceat(low[rows], first), size)
        words = W.words_of(pa.array([suffixes[i].decode() for i in leaf[begin].tolist()], pa.large_string()))
        name = np.repeat(W.windows(words.hashes, depth)[words.bounds[:-1]], size)
        told = twice[rows] | (low[rows] != smallest)
        rows, smallest, name = rows[told], smallest[told], name[told]
        order_ = np.lexsort((smallest, shard[rows]))
        to = shard[rows][order_]
        name, smallest = name[order_], smallest[order_]
        names = np.unique(to)
        cuts = np.searchsorted(to, np.append(names, np.iinfo(np.int64).max))
        payloads = [S.squeeze(name[a:z].tobytes() + np.diff(smallest[a:z], prepend=0).tobytes()) for a, z in zip(cuts, cuts[1:])]
        return _rows(names.tolist(), [table["to"][0].as_py()] * len(names), payloads)

    return run


def _remover(depth: int, kind: pa.DataType):
    schema = pa.schema([("key", kind), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for payload in right["payload"]:
            data = S.unsqueeze(payload.as_py())
            half = len(data) // 2
            names.append(np.frombuffer(data[:half], np.uint64))
            least.append(np.cumsum(np.frombuffer(data[half:], np.int64)))
        name, smallest = np.concatenate(names), np.concatenate(least)
        order = np.argsort(name, kind="stable")
        name, smallest = name[order], smallest[order]
        out = []
        for part in _parts(left, depth):
            gone = np.zeros(len(part.words.hashes) + 1, np.int64)
            if len(name) and len(part.at):
                hashes = part.windows()
                place = np.minimum(np.searchsorted(name, hashes), len(name) - 1)
                hit = part.at[(name[place] == hashes) & (smallest[place] < part.owners())]
                gone = np.zeros(len(part.words.hashes) + depth + 1, np.int64)
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + depth, -1)
            covered = np.cumsum(gone)[: len(part.words.hashes)] > 0
            bounds = part.words.bounds
            removed = np.concatenate([[0], np.cumsum(covered)])
            removed = removed[bounds[1:]] - removed[bounds[:-1]]
            kept = []
            for text, a, b, n in zip(part.table["text"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), removed.tolist()):
                own = text.encode().split()
                if n:
                    own = [w for w, c in zip(own, covered[a:b].tolist()) if not c]
                kept.append(b" ".join(own).decode())
            out.append(pa.table([part.table["key"].cast(kind), pa.array(part.words.counts), pa.array(removed), pa.array(kept, pa.string())], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def remove_repeats(documents: DataFrame, *, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(key, n_words, n_removed, kept): every row with its text less the windows seen in smaller ids."""
    spark = documents.sparkSession
    ship(spark)
    shards, groups = S.sizes_of(documents, text)
    heavy = spark.sparkContext.broadcast(frequent_prefixes(documents, text, depth, groups))
    kind = dict(documents.dtypes)[key]
    arrow_kind = documents.select(key).limit(0).toArrow().schema.field(0).type
    dealt = S.deal(documents, key, text, shards)
    asked = per_group(dealt, "shard", _anchor_asker(depth, groups), ROW)
    shared = per_group(asked, "to", _anchor_counter, ROW)
    sent = per_pair(dealt, "shard", shared, "to", _suffix_sender(depth, groups, heavy), ROW)
    repeats = per_group(sent, "to", _tree(depth), ROW)
    done = per_pair(dealt, "shard", repeats, "to", _remover(depth, arrow_kind), f"key {kind}, n_words long, n_removed long, kept string")
    return done.withColumnRenamed("key", key)


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All `documents` less the 13-word windows that documents with smaller ids have."""
    done = remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

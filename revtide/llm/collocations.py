"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A piece is what lies between punctuation marks or line ends; its words are runs of anything but blanks and
tabs, A-Z lower-cased. A suffix pointer stands at each word and is followed to `LONGEST` words, inside its
piece. Everything is counted per language.

1. One scan counts words, and prefixes of every length by hash slots. Both are summed by Spark.
2. Words below the threshold cut suffixes short, and so do pairs of words. Tasks know frequent words and, counted
   in another scan, slots of pairs that may be frequent from bitmaps of bounded size; what these let through too
   much is only sorted in vain.
3. A last scan routes suffix pointers by their leading words: by one word, or by as many as it takes until
   fewer than `ROWS_PER_GROUP` pointers share the slot of that prefix. A task sends equal suffixes once, with
   their number, packed per group.
4. A group sorts its pointers with a three-way partition on one word at a time. The partition equal to the
   pivot is a phrase and its weight is the phrase's count; a partition lighter than the threshold is abandoned.
   Prefixes shorter than their route lie in several groups; these report what they have and Spark adds it up.
5. Scores, cuts and the removal of phrases that only occur inside longer ones are joins of the phrase table.

Words and prefixes are told apart by 64-bit hashes; spellings come from the word table. NULL texts are
empty, a NULL language counts as 'und', ids are not used, repeated rows count as often as they occur, extra
columns are ignored, and empty tables give no rows. Words of any length are kept whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revtide.llm import shards as S
from revtide.llm import words as W
from revtide.llm.tasks import map_arrow, per_group, ship
from revtide.session import settle

LONGEST = 5
LEAST = 100
TOP = 2000
ROWS_PER_GROUP = 2_000_000
WORDS_PER_FLUSH = 600_000
MAX_BITS = 27
BLOCKS = 8  # a bitmap is built in 2 ** BLOCKS blocks
WORDS = "lang string, hash long, word string, n long"
_WORDS = pa.schema([("lang", pa.string()), ("hash", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
ROUTED = "bucket long, payload binary"
_ROUTED = pa.schema([("bucket", pa.int64()), ("payload", pa.binary())])
COUNTED = "size int, " + ", ".join(f"w{i} long" for i in range(LONGEST)) + ", a long"
_COUNTED = pa.schema([("size", pa.int32()), *[(f"w{i}", pa.int64()) for i in range(LONGEST)], ("a", pa.int64())])
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANKED = np.where(_BREAK, 0x20, np.arange(256)).astype(np.uint8)
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


# -- words of pieces, inside tasks -------------------------------------------------------------


class Block:
    """Words of some texts: `hashes` (language mixed in, never 0), `joined` (the next word is in the same piece)."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        data, offsets = W.text_bytes(batch.column(batch.schema.get_field_index("text")))
        blanked = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_BLANKED[data]))
        found = W.words_of(blanked, lower=True)
        langs = batch.column(batch.schema.get_field_index("lang"))
        langs = (langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs).dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names], np.uint64)
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), found.counts)
        self.data, self.starts, self.ends = data, found.starts, found.ends
        with np.errstate(over="ignore"):
            hashes = W.mix(found.hashes * _STEP + salts[self.lang])
        self.hashes = np.maximum(hashes, np.uint64(1))
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        self.joined = np.zeros(len(self.starts), bool)
        if len(self.starts):
            same = breaks[self.starts[1:]] == breaks[self.ends[:-1]]
            self.joined[:-1] = same
            last = np.cumsum(found.counts)[found.counts > 0] - 1
            self.joined[last] = False

    def word(self, i: int) -> str:
        return _SMALL[self.data[self.starts[i] : self.ends[i]]].tobytes().decode()


def prefixes(hashes: np.ndarray, joined: np.ndarray) -> Iterator[np.ndarray]:
    """For 1, 2, ... words: hash of the prefix of that length at each position, 0 where the piece ends before."""
    n, current = len(hashes), hashes
    yield current
    reach = np.ones(n, bool)
    for size in range(1, LONGEST):
        room = max(0, n - size)  # positions that have `size` more words after them
        reach[:room] &= joined[size - 1 : size - 1 + room]
        reach[room:] = False
        further = np.zeros(n, np.uint64)
        further[:room] = hashes[n - room :]
        with np.errstate(over="ignore"):
            current = np.where(reach, W.mix(current * _STEP + further), np.uint64(0))
        yield current


def _slot(prefix: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Slots of prefixes of different lengths lie apart."""
    return (prefix >> np.uint64(64 - bits)).astype(np.int64) + (np.int64(size) << bits)


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Block]]:
    held, n = [], 0
    for batch in batches:
        for part in W.slices(batch, "text"):
            block = Block(part)
            held.append(block)
            n += len(block.hashes)
            if n >= WORDS_PER_FLUSH:
                yield held
                held, n = [], 0
    if held:
        yield held


def _counter(bits: int):
    """Rows (lang, hash, word, n) for the words of a flush, and (NULL, slot, NULL, n) for its prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _flushes(batches):
            hashes = np.concatenate([b.hashes for b in blocks])
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            starts = np.cumsum([0] + [len(b.hashes) for b in blocks])
            owner = np.searchsorted(starts, first, "right") - 1
            rows = [(blocks[o], int(f - starts[o])) for o, f in zip(owner, first)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b.names[b.lang[i]] for b, i in rows], pa.string()),
                    pa.array(found.view(np.int64)),
                    pa.array([b.word(i) for b, i in rows], pa.string()),
                    pa.array(n.astype(np.int64)),
                ],
                schema=_WORDS,
            )
            joined = np.concatenate([b.joined for b in blocks])
            for size, prefix in enumerate(prefixes(hashes, joined), 1):
                if size == LONGEST:
                    break
                slots, n = np.unique(_slot(prefix[prefix > 0], size, bits), return_counts=True)
                none = pa.nulls(len(slots), pa.string())
                yield pa.RecordBatch.from_arrays([none, pa.array(slots), none, pa.array(n.astype(np.int64))], schema=_WORDS)

    return run


# -- routing and sorting suffix pointers -------------------------------------------------------


def _marked(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the leading bits of each hash."""
    place = hashes >> np.uint64(64 - (int(len(packed) * 8).bit_length() - 1))
    return (packed[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _frequent_runs(blocks: list[Block], frequent) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a flush, and whether a word and the next one of its piece are both frequent."""
    hashes = np.concatenate([b.hashes for b in blocks])
    joined = np.concatenate([b.joined for b in blocks])
    known = _marked(np.frombuffer(frequent.value, np.uint8), hashes)
    return hashes, joined & known & np.append(known[1:], False)


def _pairs(hashes: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Hash of the words at each position and after it, 0 where they are not joined."""
    both = prefixes(hashes, joined)
    next(both)
    return next(both)


def _pair_counter(frequent, bits: int):
    """Rows (block, payload): how often the slots of a block of the pair bitmap occur in a flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _flushes(batches):
            hashes, joined = _frequent_runs(blocks, frequent)
            pairs = _pairs(hashes, joined)
            slots, n = np.unique((pairs[joined] >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
            block = slots >> np.uint32(bits - BLOCKS)
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, int)
            ends = np.append(edges[1:], len(block))
            payloads = [S.squeeze(np.diff(slots[a:b], prepend=slots[a]).tobytes() + slots[a].tobytes() + n[a:b].astype(np.uint32).tobytes()) for a, b in zip(edges, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(block[edges].astype(np.int64)), pa.array(payloads, pa.binary())], schema=_ROUTED)

    return run


def _pair_flags(bits: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        width = 1 << (bits - BLOCKS)
        total = np.zeros(width, np.int64)
        for payload in table["payload"].drop_null():
            data = np.frombuffer(S.unsqueeze(payload.as_py()), np.uint32)
            size = len(data) // 2
            slots = np.cumsum(data[:size], dtype=np.int64) + data[size]
            total[slots & (width - 1)] += data[size + 1 :]
        flags = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.table({"block": table["bucket"][:1], "flags": pa.array([flags], pa.binary())})

    return run


def _router(frequent, paired, heavy, bits: int, buckets: int):
    """Rows (bucket, payload): the distinct suffixes of a flush with their numbers and routes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = heavy.value
        for blocks in _flushes(batches):
            hashes, joined = _frequent_runs(blocks, frequent)
            del blocks
            joined &= _marked(np.frombuffer(paired.value, np.uint8), _pairs(hashes, joined))
            at = np.flatnonzero(joined)
            if not len(at):
                continue
            route = np.ones(len(at), np.uint8)
            target = whole = None
            for size, prefix in enumerate(prefixes(hashes, joined), 1):
                prefix = prefix[at]
                whole = prefix if whole is None else np.where(prefix > 0, prefix, whole)
                if target is None:
                    target = prefix.copy()
                else:  # shorter prefixes in heavy slots go on; a suffix that ends there goes by all of itself
                    go = route == size
                    target[go] = whole[go]
                if size < LONGEST:
                    slots = _slot(prefix, size, bits)
                    spot = np.minimum(np.searchsorted(many, slots), max(len(many) - 1, 0))
                    hot = (many[spot] == slots) if len(many) else np.zeros(len(slots), bool)
                    route[(route == size) & hot] += 1
            _, first, n = np.unique(whole, return_index=True, return_counts=True)
            at, route, target = at[first], route[first], target[first]
            del whole, prefix, slots, spot, hot
            rows = np.zeros((LONGEST, len(at)), np.uint64)
            alive = np.ones(len(at), bool)
            for i in range(LONGEST):
                rows[i, alive] = hashes[at[alive] + i]
                alive[alive] = joined[at[alive] + i]
            bucket = (W.mix(target) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((rows[1], rows[0], bucket))
            bucket = bucket[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(edges[1:], len(bucket))
            payloads = [_pack(rows[:, order[a:b]], n[order[a:b]], route[order[a:b]]) for a, b in zip(edges, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges]), pa.array(payloads, pa.binary())], schema=_ROUTED)

    return run


def _pack(rows: np.ndarray, n: np.ndarray, route: np.ndarray) -> bytes:
    """Suffixes as numbers of words in a list of their hashes; 0 is the end of a suffix."""
    found, place = np.unique(rows, return_inverse=True)
    head = np.array([len(found), rows.shape[1]], np.int64)
    return S.squeeze(head.tobytes() + found.tobytes() + place.astype(np.uint16 if len(found) < 65536 else np.uint32).reshape(rows.shape).tobytes() + n.astype(np.int64).tobytes() + route.tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = S.unsqueeze(data)
    words, width = np.frombuffer(data, np.int64, 2)
    at = 16
    found = np.frombuffer(data, np.uint64, words, at)
    at += 8 * words
    kind = np.dtype(np.uint16 if words < 65536 else np.uint32)
    place = np.frombuffer(data, kind, LONGEST * width, at).reshape(LONGEST, width)
    at += kind.itemsize * LONGEST * width
    n = np.frombuffer(data, np.int64, width, at)
    return found, place, n, np.frombuffer(data, np.uint8, width, at + 8 * width)


def three_way_sort(rows: np.ndarray, n: np.ndarray, least: int, whole_from: int = 1) -> list[tuple[int, np.ndarray, int]]:
    """(size, words, weight) of prefixes of two words or more in `rows` (words x suffixes; 0 ends a suffix).

    Partitions lighter than `least` are abandoned; prefixes shorter than `whole_from` are not known in full
    here and are reported whatever their weight.
    """
    found = []
    stack = [(np.arange(rows.shape[1]), 0)]
    while stack:
        at, depth = stack.pop()
        if depth + 1 >= whole_from and n[at].sum() < least:
            continue
        words = rows[depth][at]
        pivot = words[len(words) // 2]
        for side in (words < pivot, words > pivot):
            part = at[side]
            if len(part):
                stack.append((part, depth))
        equal = at[words == pivot]
        if not pivot:  # suffixes that end here
            continue
        weight = int(n[equal].sum())
        if depth + 1 >= whole_from and weight < least:
            continue
        if depth:
            found.append((depth + 1, rows[: depth + 1, equal[0]], weight))
        if depth + 1 < len(rows):
            stack.append((equal, depth + 1))
    return found


def _sorter(least: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(p.as_py()) for p in table["payload"]]
        known = np.unique(np.concatenate([p[0] for p in parts]))
        if known[0] != 0:
            known = np.concatenate([[np.uint64(0)], known])
        rows = np.concatenate([np.searchsorted(known, p[0]).astype(np.int32)[p[1]] for p in parts], axis=1)
        n = np.concatenate([p[2] for p in parts])
        route = np.concatenate([p[3] for p in parts])
        del parts
        found = []
        for length in np.unique(route):
            own = route == length
            found += three_way_sort(rows[:, own], n[own], least, int(length))
        out = np.zeros((LONGEST, len(found)), np.int64)
        for i, (size, words, _) in enumerate(found):
            out[:size, i] = known[words].view(np.int64)
        sizes = pa.array([f[0] for f in found], pa.int32())
        return pa.table([sizes, *[pa.array(row) for row in out], pa.array([f[2] for f in found], pa.int64())], schema=_COUNTED)

    return run


# -- counting ----------------------------------------------------------------------------------


def _gather(blocks: DataFrame) -> bytes:
    """A bitmap from all its blocks (block, flags); 2 ** (MAX_BITS - 3) bytes at most."""
    table = blocks.toArrow()
    return b"".join(flags for _, flags in sorted(zip(table["block"].to_pylist(), table["flags"].to_pylist())))


def _every_block(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """Add a row with nothing but the key for each block, so that none is missing."""
    return df.unionByName(spark.range(1 << BLOCKS).select(F.col("id").alias(key)), allowMissingColumns=True)


def _word_bitmap(spark: SparkSession, hashes: DataFrame) -> bytes:
    """Bitmap of the leading bits of the hashes, built by Spark."""
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(1 + 16 * hashes.count()))))
    width = 1 << (bits - BLOCKS)
    place = F.shiftrightunsigned("hash", 64 - bits)
    rows = hashes.select(F.shiftright(place, bits - BLOCKS).alias("block"), place.bitwiseAND(F.lit(width - 1)).cast("int").alias("bit")).distinct()

    def build(table: pa.Table) -> pa.Table:
        flags = np.zeros(width, bool)
        flags[table["bit"].drop_null().to_numpy()] = True
        return pa.table({"block": table["block"][:1], "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    return _gather(per_group(_every_block(spark, rows, "block"), "block", build, "block long, flags binary"))


def phrase_counts(
    documents: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, rows_per_group: int = ROWS_PER_GROUP
) -> tuple[DataFrame, DataFrame]:
    """(lang, hash, word, n) of all words, and (words array<long>, a) of phrases of two words and more with a >= least."""
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(S.parts_of(documents), math.ceil(letters / 6 / rows_per_group))
    bits = max(12, math.ceil(math.log2(16 * buckets)))
    counted = map_arrow(rows, _counter(bits), WORDS).groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))
    counted = settle(counted)
    vocabulary = counted.filter(F.col("lang").isNotNull())
    slots = counted.filter(F.col("lang").isNull() & (F.col("n") > rows_per_group)).select("hash").toArrow()  # LONGEST * words / rows_per_group at most
    heavy = spark.sparkContext.broadcast(np.sort(slots["hash"].to_numpy().astype(np.int64)))
    frequent = spark.sparkContext.broadcast(_word_bitmap(spark, vocabulary.filter(F.col("n") >= least).select("hash")))
    pair_bits = min(MAX_BITS, max(16, math.ceil(math.log2(1 + letters / 150))))  # a slot for some 25 words
    pairs = _every_block(spark, map_arrow(rows, _pair_counter(frequent, pair_bits), ROUTED), "bucket")
    paired = spark.sparkContext.broadcast(_gather(per_group(pairs, "bucket", _pair_flags(pair_bits, least), "block long, flags binary")))
    routed = map_arrow(rows, _router(frequent, paired, heavy, bits, buckets), ROUTED)
    names = [f"w{i}" for i in range(LONGEST)]
    sums = per_group(routed, "bucket", _sorter(least), COUNTED).groupBy("size", *names).agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    phrases = sums.select(F.slice(F.array(*names), F.lit(1), F.col("size")).alias("words"), "a")
    return vocabulary, settle(phrases)


# -- scores ------------------------------------------------------------------------------------


def collocations(documents: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that does not only occur inside a longer one."""
    vocabulary, phrases = phrase_counts(documents, text=text, lang=lang, least=least, rows_per_group=rows_per_group)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    common = settle(vocabulary.filter(F.col("n") >= least).select("lang", "hash", "word", "n"))
    counts = phrases.unionByName(common.select(F.array("hash").alias("words"), F.col("n").alias("a")))
    size = F.size("words")

    # A phrase inside a longer one that occurs as often is inside one that is a word longer and occurs as often.
    ends = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    inside = phrases.filter(size > 2).select(F.explode(ends).alias("words"), "a").distinct()
    kept = phrases.join(inside, ["words", "a"], "left_anti")

    cuts = kept.select("words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.slice("words", F.lit(1), F.col("cut"))).withColumn("rest", F.slice("words", F.col("cut") + 1, size))
    cuts = cuts.join(counts.select(F.col("words").alias("first"), F.col("a").alias("l")), "first")
    cuts = cuts.join(counts.select(F.col("words").alias("rest"), F.col("a").alias("r")), "rest")

    placed = kept.select("words", F.posexplode("words").alias("place", "hash")).join(common.select("lang", "hash", "word"), "hash")
    spelled = placed.groupBy("words").agg(
        F.min("lang").alias("lang"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"),
    )
    scored = cuts.join(spelled, "words").join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")

    def exact(column: str) -> Column:
        return F.col(column).cast("decimal(19,0)")

    # 1000 * a * n has 38 digits at most up to a * n of 10 ** 35, that is 10 ** 17 words.
    scored = scored.withColumn("up", (exact("a") * F.col("n").cast("decimal(18,0)") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"))
    scored = scored.withColumn("down", (exact("l") * F.col("r").cast("decimal(18,0)")).cast("decimal(38,0)")).withColumn("score", F.expr("up div down"))
    return scored.groupBy("words").agg(
        F.min_by(F.struct("lang", "phrase", "a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("best")
    ).select("best.*")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 collocations of each language of all `documents`."""
    found = collocations(spark.read.parquet(f"{folder}/documents.parquet"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= TOP)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

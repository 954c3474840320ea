"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are short, documents long, so Jaccard similarity says little; containment (shared shingles over
the item's shingles) is what is searched. Items are partitioned by size. An item of q shingles keeps
its q - ceil(t q) + 1 smallest shingle hashes: a document with containment of t or more lacks fewer
shingles than that, so it holds at least one of them. Looking these bottom hashes up in a document's
shingles therefore misses nothing; what it finds is verified by exact shingle containment.

Shingles have five words, A-Z lower-cased; an item with fewer words is one shingle of its whole length.
Items without words, NULL items and NULL or empty documents match nothing. The items are a query set:
they are read in blocks of bounded size, each matched against all documents. Documents are scanned
whole, in place, without a shuffle. Repeated rows give repeated pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.llm import words as W
from revtide.llm.naming import aside, restore
from revtide.llm.tasks import map_arrow

SHINGLE = 5
PERCENT = 80
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32_000_000


def needed(size: np.ndarray | int, percent: int = PERCENT):
    """Shingles of an item of `size` that a document must hold."""
    return -(-size * percent // 100)


class Partition:
    """Items of one shingle length and one size class, with their bottom hashes as an index."""

    def __init__(self, shingle: int, items: list[int], sets: list[np.ndarray], percent: int):
        self.shingle = shingle
        self.items = np.array(items)
        self.sizes = np.array([len(s) for s in sets])
        self.sets = np.concatenate(sets)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        bottom = [s[: len(s) - needed(len(s), percent) + 1] for s in sets]  # the sets are sorted
        hashes = np.concatenate(bottom)
        owner = np.repeat(np.arange(len(sets)), [len(b) for b in bottom])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]
        self.least = int(needed(self.sizes.min(), percent))
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def candidates(self, shingles: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (document, item) pairs that share a bottom hash."""
        hit = np.flatnonzero(self.gate[(shingles & np.uint64(0xFFFF)).astype(np.int64)])
        low = np.searchsorted(self.hashes, shingles[hit], "left")
        count = np.searchsorted(self.hashes, shingles[hit], "right") - low
        hit, low, count = hit[count > 0], low[count > 0], count[count > 0]
        first = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.unique(np.stack([np.repeat(doc[hit], count), self.owner[first]], 1), axis=0)


def build(items: list[tuple[int, str]], shingle: int = SHINGLE, percent: int = PERCENT) -> list[Partition]:
    """The index of a block of items: (number, text)."""
    classes: dict[tuple[int, int], tuple[list, list]] = {}
    words = W.words_of(pa.array([t for _, t in items], pa.large_string()), lower=True)
    for (number, _), a, b in zip(items, words.bounds[:-1], words.bounds[1:]):
        if b > a:
            length = min(shingle, int(b - a))
            found = np.unique(W.windows(words.hashes[a:b], length))
            own = classes.setdefault((length, len(found).bit_length()), ([], []))
            own[0].append(number)
            own[1].append(found)
    return [Partition(length, numbers, sets, percent) for (length, _), (numbers, sets) in sorted(classes.items())]


def search(texts: pa.Array, index: list[Partition], percent: int = PERCENT) -> list[tuple[int, int, int, int]]:
    """(row, item, item's shingles, shared) for all pairs at or above the containment."""
    words = W.words_of(texts, lower=True)
    doc, bounds = words.doc, words.bounds
    out = []
    for length in sorted({p.shingle for p in index}):
        good = W.inside(words.counts, length)
        shingles = W.windows(words.hashes, length)
        where = np.flatnonzero(good)
        for part in (p for p in index if p.shingle == length):
            # A document with fewer shingles than the smallest item needs cannot hold one.
            big = where[(words.counts[doc[where]] - length + 1) >= part.least]
            for row, item in part.candidates(shingles[big], doc[big]).tolist():
                own = part.sets[part.bounds[item] : part.bounds[item + 1]]
                here = shingles[bounds[row] : bounds[row + 1] - length + 1]
                shared = int(np.isin(own, here).sum())
                if shared >= needed(len(own), percent):
                    out.append((row, int(part.items[item]), len(own), shared))
    return out


def _searcher(index, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                found = search(part.column(1), index.value, percent)
                rows = pa.array([r for r, *_ in found], pa.int64())
                columns = [pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), *columns], ["_key", "_item", "n_shingles", "n_shared"])

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, item, n_shingles, n_shared, containment) for every document that holds an item."""
    spark = documents.sparkSession
    items = benchmark.select(F.col(item).alias("_item"), F.coalesce(F.col(item_text), F.lit("")).alias("_text"))
    rows, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()
    blocks = max(1, math.ceil(rows / BLOCK_ITEMS), math.ceil(chars / BLOCK_CHARS))
    sides = documents.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = dict(sides.dtypes)["_key"], dict(items.dtypes)["_item"]
    found = []
    for block in range(blocks):
        # A block has about BLOCK_ITEMS items; it is the stated query set, not the corpus.
        own = items.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block).toArrow().to_pylist()
        index = spark.sparkContext.broadcast(build([(i, r["_text"]) for i, r in enumerate(own)], percent=percent))
        names = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(own)], f"_item long, `{item}` {kinds[1]}")
        pairs = map_arrow(sides, _searcher(index, percent), f"_key {kinds[0]}, _item long, n_shingles long, n_shared long")
        found.append(pairs.join(names, "_item").drop("_item"))
    every = reduce(DataFrame.unionByName, found)
    return every.select(F.col("_key").alias(key), item, "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def _keeper(index, percent: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text):
                keep = np.ones(part.num_rows, bool)
                keep[[row for row, *_ in search(part.column(part.schema.get_field_index(text)), index.value, percent)]] = False
                yield part.filter(pa.array(keep))

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows, whole, that hold no benchmark item. Every row is judged by its own text, in the scan; keys are not used."""
    spark = documents.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_text), F.lit("")).alias("_text")).distinct()
    rows, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()
    blocks = max(1, math.ceil(rows / BLOCK_ITEMS), math.ceil(chars / BLOCK_CHARS))
    kept, at = aside(documents)
    for block in range(blocks):
        # A block has about BLOCK_ITEMS distinct items; it is the stated query set, not the corpus.
        own = items.filter(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == block).toArrow()["_text"].to_pylist()
        index = spark.sparkContext.broadcast(build(list(enumerate(own)), percent=percent))
        kept = map_arrow(kept, _keeper(index, percent, at[text]), kept.schema)
    return restore(kept, documents.columns)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of `documents` and `benchmark` items they hold."""
    return contaminated(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))

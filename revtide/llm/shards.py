"""Documents dealt evenly into shards, and packed rows between shards and buckets.

A shard holds the documents whose key and text hash to it, compressed, so a shuffle moves whole texts
cheaply and hot sources, copies, NULL or repeated keys do not gather; a row dealt again after a loss goes
the same way. Repeated rows, alike in key and text, share a shard, where they are packed together. Operators that ask something of all texts (how often does this
word sequence occur, what are the ids of this word) send one row per (shard, bucket) with everything
the shard asks of that bucket, distinct within the shard, and get one row back. The number of rows
follows from shards and buckets, never from how often something repeats; both follow the bytes of text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtide.llm import words as W
from revtide.llm.tasks import map_arrow

ROWS_PER_SHARD = 4000
BYTES_PER_ROW = 4096  # longer texts on average make more shards
BYTES_PER_GROUP = 16 << 20
DEALT = "shard long, payload binary"
DEALT_ARROW = pa.schema([("shard", pa.int64()), ("payload", pa.binary())])


def parts_of(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return squeeze(sink.getvalue().to_pybytes())


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(unsqueeze(data)).read_all()


class Sizes(NamedTuple):
    """Into how many shards and groups documents of a size are dealt."""

    shards: int
    groups: int


def sizes_of(documents: DataFrame, text: str, rows_per_shard: int = ROWS_PER_SHARD) -> Sizes:
    """Numbers that follow rows and bytes of text, counted, so that neither a shard nor a group grows with the
    corpus; at least one for each partition of a shuffle."""
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0))
    rows, letters = documents.agg(F.count(F.lit(1)), size).first()
    least = parts_of(documents)
    shards = max(least, math.ceil(rows / rows_per_shard), math.ceil(letters / (rows_per_shard * BYTES_PER_ROW)))
    return Sizes(shards, max(least, math.ceil(letters / BYTES_PER_GROUP)))


def _dealer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        order = np.argsort(shard, kind="stable")
        table = table.take(pa.array(order)).drop_columns(["shard"])
        shard = shard[order]
        starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, int)
        ends = np.append(starts[1:], len(shard))
        rows = [pack(table.slice(a, b - a)) for a, b in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(shard[starts], pa.int64()), pa.array(rows, pa.binary())], schema=DEALT_ARROW)


def deal(documents: DataFrame, key: str, text: str, shards: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(shard, payload): the key, text (NULL as empty) and extra columns of a shard's documents, a row per scan batch."""
    shard = F.pmod(F.xxhash64(key, text), F.lit(shards)).alias("shard")
    rows = documents.select(shard, F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *extra)
    return map_arrow(rows, _dealer, DEALT)


def tables(column: pa.ChunkedArray | pa.Array) -> Iterator[pa.Table]:
    """The packed tables of a shard, cut so that each part has a few MB of text at most."""
    for payload in column:
        for part in W.slices(unpack(payload.as_py()).combine_chunks(), "text"):
            yield part

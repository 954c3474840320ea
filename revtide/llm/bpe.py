"""Byte-pair encoding and decoding through a table of distinct words.

Texts are split at ASCII white space, which the tokenizer drops and never merges across, so a text's
ids are its words' ids one after another (NFC, lower-casing, pre-tokenizing and special tokens act
within such words). Each shard of documents sends its distinct words to the buckets of the word table;
there every distinct word is encoded once for the whole corpus, its ids are joined with the id-to-piece
table, and the shard gets ids and pieces back and joins them to its words by position.

Vocabulary size, not corpus size, bounds what is broadcast: the tokenizer's own file. NULL texts count
as empty and give no ids; repeated rows and NULL keys stay.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.llm import shards as S
from revtide.llm.tasks import per_group, per_pair, ship

ASKED = "bucket long, shard long, payload binary"
ANSWERED = "shard long, bucket long, payload binary"
_ASKED = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("payload", pa.binary())])
_ANSWERED = pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary())])

ROWS_PER_SHARD = 2500  # ids and decoded texts of a shard take several times its text


@lru_cache(maxsize=2)
def _load(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


@lru_cache(maxsize=2)
def piece_table(definition: str) -> dict[int, str]:
    """id -> piece, added tokens included."""
    return {i: piece for piece, i in _load(definition).get_vocab(with_added_tokens=True).items()}


def split_words(text: str) -> list[bytes]:
    return text.encode().split()


def vocabulary(table: pa.Table, buckets: int) -> list[tuple[int, list[bytes]]]:
    """Distinct words of a shard by bucket, in byte order: the same whenever it is worked out."""
    found: set[bytes] = set()
    for part in S.tables(table["payload"]):
        for text in part["text"].to_pylist():
            found.update(split_words(text))
    lists: dict[int, list[bytes]] = {}
    for word in found:
        lists.setdefault(zlib.crc32(word) % buckets, []).append(word)
    return [(bucket, sorted(lists[bucket])) for bucket in sorted(lists)]


def _asker(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        asked = vocabulary(table, buckets)
        shard = table["shard"][0].as_py()
        rows = [S.squeeze(b"\n".join(found)) for _, found in asked]
        return pa.table([pa.array([b for b, _ in asked], pa.int64()), pa.array([shard] * len(asked), pa.int64()), pa.array(rows, pa.binary())], schema=_ASKED)

    return run


def _encoder(definition):
    def run(table: pa.Table) -> pa.Table:
        tokenizer = _load(definition.value)
        lists = [S.unsqueeze(p.as_py()).split(b"\n") for p in table["payload"]]
        ids: dict[bytes, np.ndarray] = dict.fromkeys(word for found in lists for word in found)
        known = list(ids)
        for low in range(0, len(known), 20_000):
            some = known[low : low + 20_000]
            for word, encoding in zip(some, tokenizer.encode_batch([w.decode() for w in some], add_special_tokens=False)):
                ids[word] = np.array(encoding.ids, np.uint32)
        rows = []
        for found in lists:
            sizes = np.array([len(ids[w]) for w in found], np.uint32)
            rows.append(S.squeeze(np.uint32(len(found)).tobytes() + sizes.tobytes() + np.concatenate([ids[w] for w in found]).astype(np.uint32).tobytes()))
        return pa.table([table["shard"], table["bucket"], pa.array(rows, pa.binary())], schema=_ANSWERED)

    return run


def _joiner(buckets: int, definition):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = dict(vocabulary(left, buckets))
        pieces = piece_table(definition.value)
        place: dict[bytes, int] = {}  # word -> its number; ids and pieces are kept by number
        spelled: list[str] = []
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for bucket, payload in zip(right["bucket"].to_pylist(), right["payload"]):
            data = np.frombuffer(S.unsqueeze(payload.as_py()), np.uint32)
            n = int(data[0])
            own = data[1 : n + 1].astype(np.int64)
            names = [pieces[i] for i in data[n + 1 :].tolist()]
            ends = np.cumsum(own).tolist()
            place.update(zip(asked.pop(bucket), range(len(spelled), len(spelled) + n)))
            spelled += [" ".join(names[a:b]) for a, b in zip([0, *ends], ends)]
            sizes.append(own)
            flat.append(data[n + 1 :].astype(np.int32))
        size, ids = np.concatenate(sizes), np.concatenate(flat)
        start = np.cumsum(size) - size
        mute = bool((size == 0).any())  # words of white space that is not ASCII have no ids
        out = []
        for part in S.tables(left["payload"]):
            texts, numbers, counts = [], [], []
            for text in part["text"].to_pylist():
                found = [place[word] for word in split_words(text)]
                counts.append(len(found))
                numbers += found
                texts.append(" ".join([spelled[i] for i in found if spelled[i]] if mute else [spelled[i] for i in found]))
            at = np.array(numbers, np.int64)
            own = size[at]
            ends = np.cumsum(own)
            picked = ids[np.repeat(start[at] - (ends - own), own) + np.arange(own.sum())]
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(picked, pa.int32()))
            out.append(pa.table([part["key"], lists, pa.array(texts, pa.string())], names=["key", "ids", "decoded"]))
        if not out:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32())), pa.array([], pa.string())], names=["key", "ids", "decoded"])
        return pa.concat_tables(out)

    return run


def encode_decode(documents: DataFrame, tokenizer_file: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string) for every row."""
    spark = documents.sparkSession
    ship(spark)
    with open(tokenizer_file, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    shards, buckets = S.sizes_of(documents, text, ROWS_PER_SHARD)
    dealt = S.deal(documents, key, text, shards)
    asked = per_group(dealt, "shard", _asker(buckets), ASKED)
    answered = per_group(asked, "bucket", _encoder(definition), ANSWERED)
    kind = dict(documents.dtypes)[key]
    joined = per_pair(dealt, "shard", answered, "shard", _joiner(buckets, definition), f"key {kind}, ids array<int>, decoded string")
    return joined.withColumnRenamed("key", key)


def tokenizer_path(tokenizer_file: str | None = None) -> str:
    """The given file, else that of the public 49k word vocabulary."""
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = str(public_tokenizers.path("word_bpe_49k.json"))
    return tokenizer_file


def digest(encoded: DataFrame, key: str = "doc_id", more=()) -> DataFrame:
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op3_bpe(spark: SparkSession, folder: str, tokenizer_file: str | None = None) -> DataFrame:
    """Ids and decoded texts of all `documents`, as counts and digests."""
    return digest(encode_decode(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path(tokenizer_file)))

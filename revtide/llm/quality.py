"""Quality classifier: a factorisation machine over hashed words, structure and metadata of a text.

score = sigmoid(b + w.x + sum over pairs <v_i, v_j> x_i x_j); the pair sum costs linear time by
1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). x has hashed words (log counts, unit length),
shape statistics (symbols, capitals, repeats, ...) and metadata of the text (length, lines, script).

It is fitted on at most `MAX_TRAIN` labelled rows, those with the smallest key hashes among the rows
allowed for training; all other work covers all rows. Equal inputs give equal models. NULL texts count
as empty and are scored too; repeated rows stay. Several labels for one id: the largest counts. NULL
labels are left out. Without labels every score is 1 (nothing is known against any text); with labels
of one class only, all scores approach that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from revtide.llm import words as W
from revtide.llm.naming import aside, restore
from revtide.llm.tasks import map_arrow

MAX_TRAIN = 8192
BUCKETS = 4096
FACTORS = 8
CUTOFF = 0.7
ROWS = 256  # rows of a dense block
# Bytes counted by the shape statistics.
CLASSES = {"symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "mark": b"!?", "point": b".,;:", "space": b" \t\n\r\x0b\x0c"}
N_STATS = len(CLASSES) + 9
FEATURES = "part array<int>, weight array<float>, stats array<double>"


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Dense blocks for the rows of a small batch: hashed words and statistics."""
    words = W.words_of(texts)
    data, offsets = W.text_bytes(texts)
    n = len(texts)
    doc = words.doc
    counts = np.bincount(doc * BUCKETS + (words.hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    block = np.log1p(counts, dtype=np.float32)
    block /= np.maximum(np.sqrt((block**2).sum(1, keepdims=True)), 1e-9)

    size = np.maximum(np.diff(offsets), 1)
    n_words = np.maximum(words.counts, 1)
    owner = np.repeat(np.arange(n), np.diff(offsets))

    def share(hit: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, hit, n)

    table = np.zeros((len(CLASSES), 256))
    for i, members in enumerate(CLASSES.values()):
        table[i, list(members)] = 1
    stats = [share(row[data], owner) / size for row in table]
    stats.append(share(data >= 128, owner) / size)
    stats.append(np.log1p(np.diff(offsets)))
    stats.append(np.log1p(words.counts))
    stats.append(np.log1p(share(data == 10, owner)))
    stats.append(share((words.ends - words.starts).astype(float), doc) / n_words)
    stats.append((counts > 0).sum(1) / np.minimum(n_words, BUCKETS))
    same = np.zeros(len(doc))
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
    stats.append(share(same, doc) / n_words)
    pairs = np.unique(np.stack([doc[: max(len(doc) - 2, 0)].astype(np.uint64), W.windows(words.hashes, 3)]), axis=1) if len(doc) > 2 else np.zeros((2, 0), np.uint64)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=n)
    stats.append(1 - np.minimum(distinct / n_words, 1))
    stats.append(counts.max(1) / n_words)
    return block, np.stack(stats, 1)


def _feature_rows(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text", rows=ROWS):
                block, stats = features(part.column(part.schema.get_field_index("_text")))
                cells = [np.flatnonzero(row) for row in block]
                arrays = [
                    pa.array([c.astype(np.int32) for c in cells], pa.list_(pa.int32())),
                    pa.array([row[c] for row, c in zip(block, cells)], pa.list_(pa.float32())),
                    pa.array(list(stats), pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *arrays], [*columns, "part", "weight", "stats"])

    return run


def fit(parts: list[np.ndarray], weights: list[np.ndarray], stats: np.ndarray, label: np.ndarray, epochs: int = 12, rate: float = 0.02, decay: float = 2e-4, seed: int = 7) -> Model:
    """Adam on the logistic loss, in fixed order; statistics are standardised first."""
    rng = np.random.default_rng(seed)
    width = BUCKETS + N_STATS
    if not len(label):
        return Model(50.0, np.zeros(width, np.float32), np.zeros((width, FACTORS), np.float32), np.zeros(N_STATS), np.ones(N_STATS))
    mean, spread = stats.mean(0), stats.std(0) + 1e-3
    base = (label.sum() + 1) / (len(label) + 2)
    state = [np.array([np.log(base / (1 - base))]), np.zeros(width), rng.normal(0, 0.02, (width, FACTORS))]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    step = 0
    # Small label tables get as many updates as large ones.
    for _ in range(max(epochs, -(-epochs * MAX_TRAIN // (8 * len(label))))):
        order = rng.permutation(len(label))
        for low in range(0, len(order), ROWS):
            rows = order[low : low + ROWS]
            x = np.zeros((len(rows), width))
            for i, r in enumerate(rows):
                x[i, parts[r]] = weights[r]
            x[:, BUCKETS:] = np.clip((stats[rows] - mean) / spread, -6, 6) / 3
            sums = x @ state[2]
            raw = state[0] + x @ state[1] + 0.5 * (sums**2 - (x**2) @ (state[2] ** 2)).sum(1)
            gap = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - label[rows]) / len(rows)
            grads = [gap.sum(keepdims=True), x.T @ gap + decay * state[1], x.T @ (gap[:, None] * sums) - ((x**2).T @ gap)[:, None] * state[2] + decay * state[2]]
            step += 1
            for s, m, v, g in zip(state, first, second, grads):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                s -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(float(state[0][0]), state[1].astype(np.float32), state[2].astype(np.float32), mean, spread)


def raw_scores(model: Model, block: np.ndarray, stats: np.ndarray) -> np.ndarray:
    x = np.concatenate([block, (np.clip((stats - model.mean) / model.spread, -6, 6) / 3).astype(np.float32)], 1)
    sums = x @ model.factors
    return model.bias + x @ model.linear + 0.5 * (sums**2 - (x**2) @ (model.factors**2)).sum(1)


def _scorer(model: Model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text", rows=ROWS):
                raw = raw_scores(model, *features(part.column(part.schema.get_field_index("_text"))))
                score = np.round(1 / (1 + np.exp(-np.clip(raw, -40, 40).astype(np.float64))), 6)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(score)], [*columns, "score"])

    return run


def held_out(key: Column) -> Column:
    """Rows never trained on."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most `max_train` labelled rows that are not held out; that many features reach the driver."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    chosen = usable.groupBy(key).agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64(key), key).limit(max_train)
    rows = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), key)
    rows = rows.groupBy(key, "_label").agg(F.min("_text").alias("_text"))  # an id that occurs in several rows counts once
    kind = dict(rows.dtypes)[key]
    found = map_arrow(rows.select(key, "_label", "_text"), _feature_rows([key, "_label"]), f"`{key}` {kind}, _label int, {FEATURES}").toArrow()
    found = found.take(pc.sort_indices(found, [(key, "ascending")])).slice(0, max_train)
    parts, weights = ([np.asarray(v) for v in found[name].to_numpy()] for name in ("part", "weight"))
    stats = np.array(found["stats"].to_pylist(), float).reshape(-1, N_STATS)
    return fit(parts, weights, stats, found["_label"].to_numpy().astype(float))


def score_texts(documents: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row."""
    rows = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return map_arrow(rows, _scorer(model, [key]), f"`{key}` {dict(rows.dtypes)[key]}, score double")


def keep_good(documents: DataFrame, model: Model, cutoff: float = CUTOFF, *, text: str = "text") -> DataFrame:
    """The rows, whole, whose score reaches the cutoff: scored in the scan, without a join."""
    rows, at = aside(documents)
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    scored = map_arrow(rows.withColumn("_text", F.coalesce(F.col(at[text]), F.lit(""))), _scorer(model, rows.columns), schema)
    return restore(scored.filter(F.col("score") >= cutoff), documents.columns)


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all `documents`, learnt from `labels.quality`."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    return score_texts(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted")
    )

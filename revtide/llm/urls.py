"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

A rule fits its host and all subdomains where the path starts with the rule's path; the longest rule
wins. URLs without a rule are judged by a model fitted here, at call time, to a small labelled table.
NULL and strings without "://" have empty host and path, no rule, and are scored like any other.
Repeated rows stay; other columns of the input are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.llm import words as W
from revtide.llm.tasks import map_arrow

# The rules of the contract as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

# Stems of the labelled table; every stem is put into the same frames.
UNWANTED = "casino bets betting poker slots jackpot lottery adult porn xxx sex escort spam pills viagra warez crack torrent loans payday ads track"
WANTED = (
    "news library school museum garden recipes science weather travel history docs code forum health music sports city "
    "books radio maps art wiki study county market kitchen bakery river forest theater village family studio press "
    "thing within other thread"
)
FRAMES = (
    "http://{0}.example.com/en/12",
    "https://www.{0}-win.example.org/de/345?page=2",
    "https://m.free-{0}.example.net/fr/67.html",
    "http://blog.{0}-farm.com/es/890#top",
    "https://{0}-x.example.org/en/3",
    "http://www.cheap-{0}.example.com/fr/45?utm_source=feed",
    "https://{0}.example.net/de/678",
)
# Wanted hosts have these parts instead.
MILD = {"-win": "-town", "free-": "the-", "-farm": "-page", "-x.": "-home.", "cheap-": "my-"}

SIZES = (3, 4, 5)
BUCKETS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 if it is to be blocked)."""
    rows = [(frame.format(stem), 1) for frame in FRAMES for stem in UNWANTED.split()]
    mild = FRAMES
    for part, other in MILD.items():
        mild = [frame.replace(part, other) for frame in mild]
    return rows + [(frame.format(stem), 0) for frame in mild for stem in WANTED.split()]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams, and the row of each. Each text is framed by ^ and $."""
    column = pa.array([f"^{t}$" for t in texts.to_pylist()], pa.large_string())
    data, offsets = W.text_bytes(column)
    counts = np.diff(offsets)
    letters = W.mix(data.astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(counts)), counts)
    buckets, rows = [], []
    for size in SIZES:
        good = W.inside(counts, size)
        buckets.append((W.windows(letters, size)[good] % np.uint64(BUCKETS)).astype(np.int64))
        rows.append(owner[: len(good)][good])
    return np.concatenate(buckets), np.concatenate(rows)


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each row with weights of unit length."""
    buckets, rows = grams(column)
    key = np.unique(rows.astype(np.int64) * BUCKETS + buckets)
    rows, buckets = key // BUCKETS, key % BUCKETS
    return rows, buckets, 1 / np.sqrt(np.bincount(rows, minlength=len(column)))[rows]


def fit(table: list[tuple[str, int]], steps: int = 1500, rate: float = 40.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression; the table is small by contract. Without rows all is allowed."""
    weights, bias = np.zeros(BUCKETS), -2.0
    if not table:
        return weights, bias
    rows, buckets, values = _features(pa.array([strip(u) for u, _ in table]))
    label = np.array([y for _, y in table], float)
    for _ in range(steps):
        score = 1 / (1 + np.exp(-(np.bincount(rows, values * weights[buckets], len(table)) + bias)))
        gap = (score - label) / len(table)
        weights -= rate * (np.bincount(buckets, values * gap[rows], BUCKETS) + decay * weights)
    return weights, bias


def strip(url: str) -> str:
    """Host and path of a URL, as the model sees them."""
    rest = url.partition("://")[2]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)) + slash + path


def _scorer(weights: np.ndarray, bias: float, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_seen", 1 << 20):
                seen = part.column(part.schema.get_field_index("_seen"))
                rows, buckets, values = _features(seen)
                score = 1 / (1 + np.exp(-(np.bincount(rows, values * weights[buckets], len(seen)) + bias)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(score)], [*columns, "score"])

    return run


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits, else NULL."""
    name = verdict = None
    for decision, top, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(start)
        name = F.when(fits, top + start) if name is None else name.when(fits, top + start)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def judge_urls(pages: DataFrame, *, key: str = "page_id", url: str = "url", rules=RULES, table=None, cutoff: float = 0.75) -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row."""
    weights, bias = fit(labelled_urls() if table is None else table)
    split = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    split = split.withColumn("_seen", F.concat("host", "path"))
    schema = f"`{key}` {dict(split.dtypes)[key]}, host string, path string, score double"
    scored = map_arrow(split, _scorer(weights, bias, [key, "host", "path"]), schema)
    rule, decision = rule_of(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("score") > cutoff, "block").otherwise("allow")
    return scored.select(key, "host", "path", rule.alias("rule"), F.coalesce(decision, model).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on the URLs of all `pages`."""
    return judge_urls(spark.read.parquet(f"{folder}/pages.parquet"))

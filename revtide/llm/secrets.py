"""Secret scan with an incremental ledger of blobs.

Every version of a text is addressed by its content (sha256). The ledger has a row for each scan of a
blob: which rule versions were run, and what they found. Only pairs of blob and rule version that the
ledger lacks are scanned, each blob once however many paths hold it; findings are joined back to all
paths. The ledger is only ever appended to, a row with its findings at a time, so a lost job leaves
no blob marked as seen without its findings.

NULL texts count as empty. Equal texts, repeated rows and NULL ids are all kept: one row comes back
for each row that goes in. Spans are in code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.llm.tasks import map_arrow
from revtide.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """`group` must have `least` characters for a match to count; a text without any of `hints` is skipped."""

    kind: str
    version: int
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the kinds.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII,
        group=2,
        least=8,
        hints=("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=16, hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", least=32),
)
MORE_RULES = (
    Rule("block", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("login", 1, r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@[^\s/:@]+", hints=("://",)),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = "blob string, rules array<string>, spans array<struct<rule: string, kind: string, start: long, stop: long>>"
_HEX_RUN = re.compile(r"[0-9a-f]{32}")


def find(text: str, rule: Rule, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches that are long enough."""
    for match in pattern.finditer(text):
        if len(match.group(rule.group)) >= rule.least:
            yield match.span()


def scan_text(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[dict]:
    small = text.lower()
    found = []
    for rule, pattern in rules:
        if rule.hints and not any(hint in small for hint in rule.hints):
            continue
        if rule.kind == "hex" and not _HEX_RUN.search(text):
            continue
        found += [{"rule": rule.key, "kind": rule.kind, "start": a, "stop": b} for a, b in find(text, rule, pattern)]
    return found


def _scanner(rules: tuple[Rule, ...]):
    by_key = {rule.key: rule for rule in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {key: (rule, re.compile(rule.pattern, rule.flags)) for key, rule in by_key.items()}
        seen: set[str] = set()  # repeated rows of one id; at most the rows of one partition
        for batch in batches:
            out = []
            for blob, text, pending in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if blob not in seen:
                    seen.add(blob)
                    out.append({"blob": blob, "rules": pending, "spans": scan_text(text or "", [compiled[k] for k in pending])})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


_SPAN = pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
_ARROW = pa.schema([("blob", pa.string()), ("rules", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, empty before its first use."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def update_ledger(versions: DataFrame, ledger_path: str, *, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """Scan what the ledger at `ledger_path` lacks, append it, and return the ledger.

    `versions` has a row for each path and version. One row stands for each blob: that with the
    smallest key. Only those rows' texts are shuffled, by key, so a text with many copies is moved once.
    """
    spark = versions.sparkSession
    addressed = versions.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn(
        "blob", F.sha2("_text", 256)
    )
    seen = read_ledger(spark, ledger_path).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("_seen"))
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    pending = (
        addressed.groupBy("blob")
        .agg(F.min("_key").alias("_first"))
        .join(seen, "blob", "left")
        .select("blob", "_first", F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>"))).alias("pending"))
        .filter(F.size("pending") > 0)
    )
    rows = addressed.alias("a").join(
        pending.alias("p").hint("shuffle_hash"),
        F.col("a._key").eqNullSafe(F.col("p._first")) & (F.col("a.blob") == F.col("p.blob")),
    )
    scanned = map_arrow(rows.select("a.blob", "_text", "pending"), _scanner(tuple(rules)), LEDGER)
    scanned.write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path)


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """Blobs with findings of the given rule versions: blob, spans."""
    keys = [rule.key for rule in rules]
    return (
        ledger.select("blob", F.filter("spans", lambda s: s["rule"].isin(keys)).alias("spans"))
        .filter(F.size("spans") > 0)
        .groupBy("blob")
        .agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    )


def scan_versions(versions: DataFrame, ledger_path: str, *, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """(key, blob, spans) for every row of `versions`, after bringing the ledger up to date."""
    ledger = update_ledger(versions, ledger_path, key=key, text=text, rules=rules)
    paths = versions.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
    found = findings(ledger, rules)
    none = F.array().cast("array<struct<rule: string, kind: string, start: long, stop: long>>")
    return paths.join(found, "blob", "left").select(key, "blob", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    order = F.create_map(*[F.lit(x) for pair in ((k, i) for i, k in enumerate(kinds)) for x in pair])
    sortable = F.transform(spans, lambda s: F.struct(s["start"], order[s["kind"]].alias("place"), s["stop"], s["kind"]))
    text = F.transform(F.array_sort(sortable), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(text, ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of all `documents`, through a fresh ledger in the shared folder."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    scanned = scan_versions(documents, scratch_path(spark, "ledger"))
    base = tuple(rule.kind for rule in BASE_RULES)
    base_spans = F.filter("spans", lambda s: s["kind"].isin(*base))
    counts = [_count(kind).alias(f"n_{kind}") for kind in base]
    return scanned.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base_spans, base), 256).alias("base_sha256"),
        _joined(F.col("spans"), tuple(rule.kind for rule in RULES)).alias("spans"),
    )

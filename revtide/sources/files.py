"""Readers and writers with explicit schemas. Outputs stay partitioned; nothing is merged into one file."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from revtide import schemas
from revtide.functions import wikitext as W

STAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def scan_partition(
    spark: SparkSession, path: str, columns: Sequence[str], *, snapshot: str | None = None, wiki_db: str | None = None
) -> DataFrame:
    """Selected columns of a table stored by snapshot and wiki_db; both filters prune folders."""
    df = spark.read.parquet(path)
    if snapshot is not None:
        df = df.filter(F.col("snapshot") == snapshot)
    if wiki_db is not None:
        df = df.filter(F.col("wiki_db") == wiki_db)
    return df.select(*columns)


def write_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str, *, partition_by: Sequence[str] = ("template",)) -> None:
    """All templates in one job, one folder each. Time stamps keep their microseconds."""
    writer = df.write.mode("overwrite").option("timestampNTZFormat", STAMP_FORMAT)
    writer.partitionBy(*partition_by).json(path)


def read_revisions(spark: SparkSession, path: str, schema: StructType, *, rename: bool = False) -> DataFrame:
    """JSON lines of revisions; `rename` maps the talk export's names onto the common ones.

    Time stamps may carry fractions or a zone marker, so they are read as text and parsed here. Row
    order is left to the operators, which order explicitly.
    """
    stamps = [f.name for f in schema.fields if f.dataType.typeName().startswith("timestamp")]
    as_text = StructType(
        [StructField(f.name, StringType() if f.name in stamps else f.dataType, True) for f in schema.fields]
    )
    df = spark.read.schema(as_text).json(path)
    df = df.withColumns({name: parse_stamp(name) for name in stamps})
    if rename:
        df = df.withColumnsRenamed({"revision_timestamp": "event_timestamp", "user_id": "event_user_id"})
    return df


def parse_stamp(name: str):
    """ISO text to a time stamp without zone; a trailing zone marker is dropped."""
    return F.regexp_replace(F.col(name), r"(Z|[+-]\d\d:\d\d)$", "").cast("timestamp_ntz")


def read_csv_columns(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of `schema`, found by header name and cast; other columns are not parsed."""
    wide = spark.read.csv(path, header=True)
    return wide.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels (page_id, tag_date) of one template."""
    labels = read_csv_columns(spark, path, schemas.LABELS)
    return labels.select("page_id", F.col("event_timestamp").alias("tag_date"))


def read_talk_mapping(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_columns(spark, path, schemas.TALK_MAPPING)


def read_page_list(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_columns(spark, path, schemas.PAGE_LIST)


def partition_by_page(df: DataFrame, path: str, *, key: str = "page_id", order: Sequence[str] = ("event_timestamp", "revision_id")) -> None:
    """One folder per page. Tasks take ranges of (page, time, revision), so a large page spans several files in order."""
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ranged.write.mode("overwrite").option("timestampNTZFormat", STAMP_FORMAT).partitionBy(key).json(path)


def load_all(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Every template's folder below `path` in one read; `template` comes from the folder name."""
    return read_revisions(spark, path, StructType([*schema.fields, StructField("template", StringType(), True)]))


def ordered_export(df: DataFrame, path: str, order: Sequence[str], *, partition_by: Sequence[str] = ()) -> None:
    """Globally sorted files: range partitions, sorted inside."""
    ranged = df.repartitionByRange(*partition_by, *order).sortWithinPartitions(*partition_by, *order)
    ranged.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def clustered_export(df: DataFrame, path: str, key: str, tie: str) -> None:
    """Files sorted by `key`; ranges run over (key, tie), so a large key spans several files."""
    df.repartitionByRange(key, tie).sortWithinPartitions(key, tie).write.mode("overwrite").parquet(path)


def resume_pending(samples: DataFrame, done: DataFrame, key: Sequence[str] = schemas.SAMPLE_KEY) -> DataFrame:
    """Samples that have no output yet."""
    return samples.join(done.select(*key).distinct(), list(key), "left_anti")


def write_batch(
    samples: DataFrame, items: DataFrame, order: Sequence[str], path: str, key: Sequence[str] = schemas.SAMPLE_KEY
) -> str:
    """Write the items of some samples as one batch and enter it in the manifest; the batch's name.

    Items are JSON lines, one each, sorted by (key, order) over ranges of both: a sample of any size is written in
    the same form, a large one spans files. The batch has a fresh folder. Its manifest is written last and
    names, per sample and file, the first and last item and their number; a sample without items has one row without
    a file. A job that dies before leaves a folder that no manifest names: readers pass over it, and its
    samples are still pending.
    """
    batch = f"b{uuid.uuid4().hex}"
    folder = f"{path}/items/batch={batch}"
    ranged = items.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    ranged.write.option("timestampNTZFormat", STAMP_FORMAT).json(folder)
    written = items.sparkSession.read.schema(items.schema).option("timestampNTZFormat", STAMP_FORMAT).json(folder)
    place = F.struct(*(order or key))
    spans = written.groupBy(*key, F.col("_metadata.file_name").alias("file")).agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n_items")
    )
    manifest = samples.select(*key).distinct().join(spans, list(key), "left")
    manifest.withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long"))).write.parquet(f"{path}/manifest/batch={batch}")
    return batch


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, file, first, last, n_items, batch) of all whole batches; None before the first one."""
    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_items(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The items of all whole batches. The names of batches, one per run, select the folders to read."""
    manifest = read_manifest(spark, path)
    names = [] if manifest is None else manifest.agg(F.collect_set("batch")).first()[0]
    if not names:
        return spark.createDataFrame([], schema)
    typed = StructType([*schema.fields, StructField("batch", StringType(), True)])
    rows = spark.read.schema(typed).option("timestampNTZFormat", STAMP_FORMAT).json(f"{path}/items")
    return rows.filter(F.col("batch").isin(*names)).drop("batch")


def pending_samples(samples: DataFrame, path: str, key: Sequence[str] = schemas.SAMPLE_KEY) -> DataFrame:
    """Samples that are in no whole batch below `path` yet."""
    manifest = read_manifest(samples.sparkSession, path)
    return samples if manifest is None else resume_pending(samples, manifest, key)


def normalise_titles(df: DataFrame) -> DataFrame:
    """Titles in stored and spaced form, and the title of the talk page."""
    spaced = W.spaced(F.col("page_title"))
    return df.select(
        "page_id",
        W.underscored(F.col("page_title")).alias("title_stored"),
        spaced.alias("title_spaced"),
        W.talk_title(spaced).alias("title_talk"),
    )

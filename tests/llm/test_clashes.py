"""Filtering and rewriting operators beside columns that carry the operators' own names; NULL and repeated ids."""

import pytest
from pyspark.sql import functions as F

from revtide.llm import contamination, jaccard, quality, surrogates

NAMES = ["score", "_text", "_found", "_digest", "_new", "_leak", "_gone", "_key", "key", "shard", "mention", "c0", "c1", "n_shared", "stats", "row"]
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ITEM = "red orange yellow green blue indigo violet black white grey brown pink"


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (None, f"{LONG} and {ITEM} again"), (None, "clean text without an id"), (7, f"before {ITEM} after"), (7, "clean text under a used id"),
        (1, LONG), (2, LONG), (3, None), (4, ""), (5, "write to Anna.Weber@example.org or 4111 1111 1111 1111"), (5, "write to Anna.Weber@example.org or 4111 1111 1111 1111"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(f"own {name}").alias(name) for name in NAMES]).repartition(3).cache()


def kept(df, table):
    assert df.columns == table.columns
    assert df.filter(" OR ".join(f"`{n}` <> 'own {n}'" for n in NAMES)).isEmpty()
    return sorted(map(str, (tuple(r) for r in df.select("doc_id", "text").collect())))


def test_quality(spark, table):
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 5, 7)], "doc_id long, quality int")
    model = quality.train(table, labels)
    assert kept(quality.keep_good(table, model, 0.0), table) == kept(table, table)


def test_decontamination_judges_each_row_by_its_text(spark, table):
    benchmark = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "")], "item_id long, text string")
    got = kept(contamination.decontaminate(table, benchmark), table)
    assert got == kept(table.filter(~F.coalesce(F.col("text"), F.lit("")).contains(ITEM)), table)
    assert contamination.decontaminate(table.limit(0), benchmark).count() == 0
    assert kept(contamination.decontaminate(table, benchmark.limit(0)), table) == kept(table, table)


def test_repeated_items_are_one(spark, table, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", 2)
    benchmark = spark.createDataFrame([(i, ITEM if i % 2 else f"some other item of the table, number {i}") for i in range(20)], "item_id long, text string")
    assert len(kept(contamination.decontaminate(table, benchmark), table)) == 8


def test_jaccard(table):
    assert len(kept(jaccard.keep_one(table, shingle=5, percent=80), table)) == 9  # of 1 and 2 one goes


def test_surrogates(table):
    got = surrogates.pseudonymise(table, "k")
    texts = kept(got, table)
    assert len(texts) == table.count() and not any("Weber" in t or "4111" in t for t in texts)

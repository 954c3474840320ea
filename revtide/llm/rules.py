"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 5-word windows. On top of them each rule
of `MEASURES` rejects a text whose measure exceeds a cutoff, chosen per stratum (language) from
labelled holdouts: the strictest cutoff of the grid for which "this rule rejects clean texts of this
stratum at a rate of `alpha / number of measures` or more" is refuted by the exact binomial test
(P(X <= k | n, rate), summed term by term). A cutoff counts only if all laxer ones pass too, so the grid
needs no further correction (fixed sequence); measures and strata are corrected by Bonferroni:
each test has level `delta / (measures * strata)`. With probability 1 - delta the method rejects fewer
than `alpha` of the clean texts of every stratum. Where the labels of a stratum cannot support any
cutoff, the method rejects nothing there.

NULL texts count as empty, NULL strata as one stratum 'none'. Several labels for one id: the largest
counts; NULL labels are left out. Repeated rows stay. Texts are read in the scan stage and never
shuffled; their measures (a few numbers) are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.llm.native import BLANKS, let, upto, words
from revtide.session import settle

WINDOW = 5
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
ALPHA, DELTA = 0.05, 0.05

# Measures that are high in bad texts, with their cutoffs from lax to strict.
MEASURES = {
    "symbol_share": [0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03],
    "capital_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2],
    "stutter_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
}


def _length_of(text: Column, marks: str) -> Column:
    """How many characters of `text` are among `marks`."""
    return F.length(text) - F.length(F.translate(text, marks, ""))


def repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more in the same text.

    Windows are compared by 64-bit hashes. Only texts that repeat a window sort theirs: equal ones
    become neighbours, and their positions give the length of what they cover together.
    """
    starts = upto(F.size(hashes) - F.lit(window - 1))
    of = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))

    def covered(all_: Column) -> Column:
        placed = F.array_sort(F.transform(all_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(ordered: Column) -> Column:
            same = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        total = F.aggregate(
            let(placed, again),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct((a["n"] + p + window - F.greatest(p, a["end"])).alias("n"), (p + window).alias("end")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(all_)) < F.size(all_), total).otherwise(F.lit(0))

    return let(of, covered)


def measure(documents: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts and shares of every text: key, stratum, counts (long), shares (double)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda l: F.length(F.translate(l, BLANKS, "")) > 0)

    def of_words(w: Column) -> Column:
        def of_hashes(h: Column) -> Column:
            stutter = F.size(F.filter(h, lambda x, i: (i > 0) & (F.get(h, i - 1) == x)))
            return F.struct(F.size(h).alias("n_words"), repeat_words(h).alias("n_repeat_words"), stutter.alias("n_stutter"))

        return let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes)

    dup_lines = let(lines, lambda l: (F.size(l) - F.size(F.array_distinct(l))))
    counted = documents.select(
        key,
        F.coalesce(F.col(stratum).cast("string"), F.lit("none")).alias("stratum"),
        let(words(body), of_words).alias("w"),
        dup_lines.alias("n_dup_lines"),
        (F.length(body) - _length_of(body, BLANKS)).alias("word_chars"),
        _length_of(body, SYMBOLS).alias("n_symbols"),
        _length_of(body, CAPITALS).alias("n_capitals"),
    )

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    return counted.select(
        key,
        "stratum",
        *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")],
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("w.n_stutter", "w.n_words").alias("stutter_share"),
    )


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate); 1 where k is at or above the mean."""
    odds = F.lit(rate / (1 - rate))
    steps = F.sequence(F.lit(0).cast("long"), F.least(k, F.ceil(n * rate).cast("long")))
    total = F.aggregate(
        steps,
        F.struct((n * F.log1p(F.lit(-rate))).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] + F.log((n - i) / (i + 1) * odds)).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(total)


def thresholds(measured: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, a cutoff per measure or NULL): one row per stratum that has clean labelled texts."""
    clean = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_label")).filter(F.col("_label") == 1)
    held = measured.join(clean, key, "left_semi")
    wrong = [
        F.sum((F.col(name) > cut).cast("long")).alias(f"{name}_{i}") for name, cuts in MEASURES.items() for i, cut in enumerate(cuts)
    ]
    counts = settle(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *wrong))
    level = delta / (len(MEASURES) * max(1, counts.count()))
    rate = alpha / len(MEASURES)
    chosen = []
    for name, cuts in MEASURES.items():
        passed = F.array(*[binomial_tail(F.col(f"{name}_{i}"), F.col("n"), rate) <= level for i in range(len(cuts))])
        first_failure = F.array_position(passed, False)
        last = F.when(first_failure == 0, len(cuts)).otherwise(first_failure - 1).cast("int")
        grid = F.array(*[F.lit(float(c)) for c in cuts])
        chosen.append(F.when(last > 0, F.element_at(grid, F.greatest(last, F.lit(1)))).alias(f"max_{name}"))
    return settle(counts.select("stratum", "n", *chosen))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    over = F.lit(False)
    for name in MEASURES:
        over = over | F.coalesce(F.col(name) > F.col(f"max_{name}"), F.lit(False))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    joined = measured.join(limits.drop("n"), "stratum", "left")
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~over)


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdicts on all `documents`; cutoffs from `labels`, per language."""
    measured = settle(measure(spark.read.parquet(f"{folder}/documents.parquet")))
    limits = thresholds(measured, spark.read.parquet(f"{folder}/labels.parquet"))
    return judge(measured, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

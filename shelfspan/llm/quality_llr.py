"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus, beside plain counts.

Method. Tokens are runs of letters and digits and runs of other signs, lower case; every token and every pair of neighbours falls
into one of `buckets` hash buckets. Two multinomials over the buckets, smoothed by `smoothing`, are counted: one over all
documents, one over documents trusted by their labels. A document's score is the mean over its features of ln(p_trusted / p_raw);
it is kept when the score is at least `threshold`. Only DataFrame functions; the only thing fetched is one line per bucket.

Defined cases: a null text has no words; documents without features score 0 (and fail the base rule); a null or unlabelled id is
never trusted; an id labelled more than once is trusted if every label is; without trusted text every score is 0. Repeated rows
count as often as they stand. Other columns are carried along whatever their names, unless a name is asked for by the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.llm.common import blank_words, let, no_nulls

TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]+"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Ratio:
    """ln(p_trusted / p_raw) of every bucket."""

    weights: tuple[float, ...]
    threshold: float


def feature_buckets(text: Column, buckets: int) -> Column:
    def pairs(tokens: Column) -> Column:
        single = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
        double = F.transform(
            F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
            lambda t, k: F.pmod(F.xxhash64(F.get(tokens, k), t), F.lit(buckets)).cast("int"),
        )
        return F.concat(single, double)

    return let(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), pairs)


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """Ids whose labels all say good quality and not toxic; at most `most` of them, the smallest by hash."""
    good = (
        labels.select(
            F.col("doc_id").alias("trusted_id"),
            (F.coalesce(F.col("quality") == 1, F.lit(False)) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"),
        )
        .where(F.col("trusted_id").isNotNull())
        .groupBy("trusted_id")
        .agg(F.min("good").alias("good"))
        .where("good")
    )
    return good.orderBy(F.xxhash64("trusted_id"), "trusted_id").select("trusted_id").limit(most)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 16384,
    smoothing: float = 1.0,
    threshold: float = -0.25,
    most_trusted: int = 20_000,
) -> Ratio:
    """Counts the raw multinomial over all documents and the trusted one over at most `most_trusted` labelled documents.

    The bound makes the list of trusted ids small enough (8 bytes each) to be sent to every task.
    """
    ids = F.broadcast(trusted_ids(labels, most_trusted))
    rows = docs.select(F.col("doc_id").alias("id"), feature_buckets(no_nulls(F.col("text")), buckets).alias("bucket"))
    flagged = rows.join(ids, rows["id"] == ids["trusted_id"], "left").select(
        F.explode("bucket").alias("bucket"), F.col("trusted_id").isNotNull().cast("long").alias("trusted")
    )
    counted = flagged.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("trusted")).collect()
    raw, trusted = [0] * buckets, [0] * buckets
    for row in counted:
        raw[row["bucket"]], trusted[row["bucket"]] = row["raw"], row["trusted"]
    if not sum(trusted):
        return Ratio((0.0,) * buckets, threshold)
    whole_raw, whole_trusted = sum(raw) + smoothing * buckets, sum(trusted) + smoothing * buckets
    return Ratio(
        tuple(math.log((t + smoothing) / whole_trusted) - math.log((r + smoothing) / whole_raw) for r, t in zip(raw, trusted)),
        threshold,
    )


def score(text: Column, ratio: Ratio) -> Column:
    # One literal that Spark folds into an array once.
    weights = F.split(F.lit(",".join(map(repr, ratio.weights))), ",").cast("array<double>")

    def mean(features: Column) -> Column:
        total = F.aggregate(features, F.lit(0.0), lambda sum_, b: sum_ + F.get(weights, b))
        return F.when(F.size(features) == 0, F.lit(0.0)).otherwise(total / F.size(features))

    return let(feature_buckets(text, len(ratio.weights)), mean)


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of three words that the text holds at least twice.

    Windows are compared by hash first; only where hashes repeat are the windows themselves sorted and compared.
    """

    def windows(make) -> Column:
        last = F.size(words) - 2
        places = F.when(last >= 1, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: make(F.get(words, k), F.get(words, k + 1), F.get(words, k + 2), k))

    def covered(ordered: Column) -> Column:
        def same(row: Column, other: Column) -> Column:
            return F.coalesce(F.get(ordered, other)["window"] == row["window"], F.lit(False))

        twice = F.filter(ordered, lambda row, k: F.when(k > 0, same(row, k - 1)).otherwise(F.lit(False)) | same(row, k + 1))
        places = F.sort_array(F.transform(twice, lambda row: row["place"]))
        first = F.struct(F.lit(0).alias("words"), F.lit(-3).alias("to"))  # to: where the last window began

        def step(state: Column, place: Column) -> Column:
            return F.struct((state["words"] + F.least(F.lit(3), place - state["to"])).alias("words"), place.alias("to"))

        return F.aggregate(places, first, step, lambda state: state["words"])

    hashed = windows(lambda a, b, c, k: F.xxhash64(a, b, c))
    exact = F.sort_array(windows(lambda a, b, c, k: F.struct(F.concat_ws(" ", a, b, c).alias("window"), k.alias("place"))))
    alike = let(hashed, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(alike, let(exact, covered)).otherwise(F.lit(0)).cast("long")


def counts(text: Column) -> dict[str, Column]:
    def repeated_lines(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = let(blank_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")))
    return {
        "_words": words,
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, repeated_lines).cast("long"),
    }


def verdict(text: Column, ratio: Ratio) -> Column:
    """Struct of the counts, the score and the two verdicts for a text column."""
    text = no_nulls(text)
    parts = F.struct(*(c.alias(n) for n, c in counts(text).items()), score(text, ratio).alias("score"))

    def verdicts(q: Column) -> Column:
        n, repeated = q["_words"]["n"], q["_words"]["repeated"]
        failed = (n < MIN_WORDS) | (repeated * 100 > n * MAX_REPEATED_PERCENT)
        return F.struct(
            n.alias("n_words"),
            q["word_chars"].alias("word_chars"),
            q["n_symbols"].alias("n_symbols"),
            q["n_dup_lines"].alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (q["score"] >= ratio.threshold)).alias("kept"),
            q["score"].alias("score"),
        )

    return let(parts, verdicts)


def kept(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """The documents that pass both the base rule and the ratio."""
    return docs.where(verdict(docs["text"], ratio)["kept"])

"""Measures of a hypothesis against a reference, and what annotators made of it."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ngrams, tokens


def overlap(ref: Column, hyp: Column) -> Column:
    """The share of the reference's distinct tokens that the hypothesis has."""
    r, h = tokens(F.lower(ref)), tokens(F.lower(hyp))
    return F.when(F.size(r) > 0, F.size(F.array_intersect(r, h)) / F.size(F.array_distinct(r))).otherwise(0.0)


def edit_count(*columns: Column) -> Column:
    """The most arrows in any of the columns."""
    counts = [F.coalesce(F.size(F.split(c, "->")) - 1, F.lit(0)) for c in columns]
    return F.greatest(*counts) if len(counts) > 1 else counts[0]


def verdict(judged: Column, edits: Column, n_words: Column, threshold: int = 25) -> Column:
    """The annotators' judgement, the acceptable ones graded by their share of edited words."""
    said = F.lower(judged)
    ratio = F.try_divide(edits * 100.0, n_words)
    return (
        F.when(judged.isNull(), "Unknown").when(F.contains(said, F.lit("sangat baik")), "Good").when(F.contains(said, F.lit("buruk")), "Bad")
        .when(F.contains(said, F.lit("dapat diterima")), F.when(edits == 0, "Good").when((n_words > 0) & (ratio <= threshold), f"Acceptable (<{threshold}%)").otherwise("Bad"))
        .otherwise("Human Other")
    )


def bleu(pairs: DataFrame) -> DataFrame:
    """(pair_id, bleu) of pairs (pair_id, ref, hyp): sentence BLEU of four n-grams.

    Counts of zero are replaced by 1 / (2^k * 5 / ln(length)), k counting them (the fourth method of Chen and Cherry, 2014). No common
    token gives 0.
    """
    sides = F.array(*[F.struct(F.lit(side).alias("side"), tokens(F.lower(F.col(side))).alias("t")) for side in ("ref", "hyp")])
    each = pairs.select("pair_id", F.explode(sides).alias("s")).select("pair_id", "s.side", "s.t")
    grams = each.select("pair_id", "side", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col("t"), n).alias("g")) for n in (1, 2, 3, 4)])).alias("x")).select("pair_id", "side", "x.n", F.explode("x.g").alias("gram"))
    counts = grams.groupBy("pair_id", "n", "gram").agg(F.count_if(F.col("side") == "hyp").alias("h"), F.count_if(F.col("side") == "ref").alias("r"))
    hits = counts.groupBy("pair_id").agg(*[F.sum(F.when(F.col("n") == n, F.least("h", "r")).otherwise(0)).alias(f"m{n}") for n in (1, 2, 3, 4)])
    sized = pairs.select("pair_id", F.size(tokens(F.lower(F.col("ref")))).alias("rl"), F.size(tokens(F.lower(F.col("hyp")))).alias("hl")).join(hits, "pair_id", "left")
    total = F.lit(0.0)
    zeros: Column = F.lit(0)
    for n in (1, 2, 3, 4):
        all_ = F.greatest(F.lit(1), F.col("hl") - (n - 1))
        none = F.coalesce(F.col(f"m{n}"), F.lit(0)) == 0
        zeros = zeros + F.when(none & (F.col("hl") > 1), 1).otherwise(0)
        smooth = F.ln(F.ln("hl") / (F.pow(F.lit(2.0), zeros) * 5 * all_))
        total = total + F.when(~none, F.ln(F.col(f"m{n}") / all_)).when(F.col("hl") > 1, smooth).otherwise(0.0) / 4
    brevity = F.when(F.col("hl") > F.col("rl"), 0.0).otherwise(1 - F.col("rl") / F.col("hl"))
    return sized.select("pair_id", F.round(F.when(F.coalesce("m1", F.lit(0)) == 0, 0.0).otherwise(F.exp(total + brevity)), 6).alias("bleu"))


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """The word edit distance of two arrays of numbers, a row of the table at a time."""
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for k, x in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(np.concatenate(([k], new)) - steps) + steps
    return int(row[-1])


def wer(pairs: DataFrame) -> DataFrame:
    """(pair_id, wer): word edits a reference word; an empty reference gives 0 for an empty hypothesis, else 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ref, hyp in zip(batch.column("ref").to_pylist(), batch.column("hyp").to_pylist()):
                number: dict[str, int] = {}
                a, b = (np.array([number.setdefault(w, len(number)) for w in side], np.int64) for side in (ref, hyp))
                out.append(distance(a, b) / len(a) if len(a) else float(len(b) > 0))
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(out, pa.float64())], ["pair_id", "wer"])

    cut = pairs.select("pair_id", *[F.coalesce(tokens(F.lower(F.col(c))), F.array().cast("array<string>")).alias(c) for c in ("ref", "hyp")])
    return cut.mapInArrow(run, f"pair_id {dict(pairs.dtypes)['pair_id']}, wer double")

"""Near-duplicate texts by MinHash over runs of seven words, verified exactly."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ngrams, words
from tessera.sources.folders import bounded, checkpointed

SHINGLE, THRESHOLD, LEAST_WORDS, BANDS, ROWS = 7, 0.8, 5, 24, 4
#: Shingles that are hashed at once, so that they stay in the processor's cache.
CHUNK = 1 << 16


def shingle_sets(docs: DataFrame, size: int = SHINGLE, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, shingles): distinct hashes of word runs; texts below `least` words are left out, below `size` they are one run."""
    cut = docs.select("doc_id", words(F.col("text")).alias("parts"))  # a column of its own, or each run would cut the text again
    runs = F.when(F.size("parts") >= size, ngrams(F.col("parts"), size)).otherwise(F.array(F.array_join("parts", " ")))
    return cut.where(F.size("parts") >= least).select("doc_id", F.array_distinct(F.transform(runs, lambda x: F.xxhash64(x))).alias("shingles"))


def _bands(bands: int, rows: int):
    rng = np.random.default_rng(7)
    times, plus = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("shingles")
            flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            keys = np.empty((batch.num_rows, bands), np.uint64)
            at = 0
            while at < batch.num_rows:  # so many texts at once as have CHUNK shingles, or one
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
                x = flat[ends[at] : ends[end]]
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                least = np.empty((end - at, bands * rows), np.uint64)
                for k, (t, p) in enumerate(zip(times, plus)):
                    least[:, k] = np.minimum.reduceat(x * t + p, ends[at:end] - ends[at])
                least = least.reshape(end - at, bands, rows)
                key = np.tile(np.arange(bands, dtype=np.uint64), (end - at, 1))
                for r in range(rows):
                    key = (key ^ least[:, :, r]) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(27)
                keys[at:end] = key
                at = end
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed], ["doc_id", "bands"])

    return run


def duplicate_pairs(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, jaccard) of pairs a < b that share a band and are as similar as the threshold."""
    signed = checkpointed(shingle_sets(docs, size).mapInArrow(_bands(bands, rows), "doc_id long, bands array<long>"))
    banded = signed.select("doc_id", F.explode("bands").alias("band"))
    pairs = checkpointed(banded.alias("l").join(banded.alias("r"), F.expr("l.band = r.band and l.doc_id < r.doc_id")).select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).distinct())
    met = bounded(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = checkpointed(shingle_sets(docs.join(met, "doc_id", "left_semi"), size))  # only texts that share a band are written whole
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(s)) for k, s in (("a", "x"), ("b", "y")))
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("x", "y")))
    similar = F.col("n") / (F.size("x") + F.size("y") - F.col("n"))
    return both.select("a", "b", F.round(similar, 6).alias("jaccard")).where(F.col("jaccard") >= threshold)


def clusters(pairs: DataFrame) -> DataFrame:
    """(doc_id, cluster): the least document that can be reached over the pairs."""
    labels = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("cluster", F.col("doc_id"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = None
    while True:
        near = both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("cluster").alias("near"))
        labels = labels.join(near, "doc_id", "left").select("doc_id", F.least("cluster", "near").alias("cluster"))
        # a label is a document too: its own label is one step further
        over = labels.select(F.col("doc_id").alias("cluster"), F.col("cluster").alias("further"))
        labels = labels.join(over, "cluster").select("doc_id", F.col("further").alias("cluster"))
        labels = checkpointed(labels)
        now = labels.agg(F.sum("cluster"), F.count("*")).first()
        if now == last:
            return labels
        last = now


def deduplicated(docs: DataFrame, size: int = SHINGLE, **options) -> DataFrame:
    """`docs` with the least document of each cluster. Texts with the same words in a row are taken together before any are compared, so a text that is copied n times costs n rows."""
    parts = words(F.col("text"))
    keyed = docs.select("doc_id", F.when(F.size(parts) >= LEAST_WORDS, F.md5(F.array_join(parts, " "))).alias("content")).where("content is not null")
    first = checkpointed(keyed.groupBy("content").agg(F.min("doc_id").alias("least")))
    alone = docs.join(first.select(F.col("least").alias("doc_id")), "doc_id", "left_semi")
    found = clusters(checkpointed(duplicate_pairs(alone, size, **options)))
    copies = keyed.join(first, "content").where("doc_id <> least").select("doc_id")
    gone = copies.unionByName(found.where("doc_id <> cluster").select("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti")

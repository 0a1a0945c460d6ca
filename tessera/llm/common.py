"""What the operators of this subpackage share: word hashing, Arrow loops, checkpoints, components."""

import re
import tempfile
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Distinct words whose hashes a Python worker keeps before it starts anew, and characters that it works on at once. Neither changes a result.
CACHED_WORDS, PIECE = 200_000, 1_000_000


class Cache(dict):
    """A dictionary that computes what it lacks, and empties itself when it has grown too large."""

    def __init__(self, of: Callable, most: int = CACHED_WORDS) -> None:
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.of(key)
        return value

    def forget(self) -> None:
        self.clear()


_used: Callable = lambda: None  # noqa: E731 - gives the cache that this process used last, while it exists


def alone(cache) -> None:
    """Lets this process keep no other words than those of `cache`.

    Spark's Python workers outlive a stage: what each stage had cached would stay in memory beside the next one's. What
    was used before is emptied, by its forget(), and computed again if it is needed again.
    """
    global _used
    if (before := _used()) is not cache:
        if before is not None:
            before.forget()
        _used = weakref.ref(cache)
        pa.default_memory_pool().release_unused()


_HASHES = Cache(xxhash.xxh64_intdigest)


def words(text: str) -> list[str]:
    """Lower-cased runs of Unicode letters, digits and underscores."""
    return WORD.findall(text.lower())


def hashes(tokens: list[str]) -> np.ndarray:
    """One stable 64-bit hash a word."""
    alone(_HASHES)
    return np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers, one for each place of a word in a gram.
PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def grams(w: np.ndarray, places: Iterable[int]) -> np.ndarray:
    """A 64-bit hash of the words at `places` after each start; starts that reach beyond the end are left out."""
    places = list(places)
    n = len(w) - places[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, at in enumerate(places):
        total += w[at : at + n] * PLACES[i]
    return mix(total)


def over_texts(batches: Iterable[pa.RecordBatch], key: str = "doc_id", chars: int = PIECE) -> Iterator[tuple[list, list]]:
    """(keys, texts) in pieces of about `chars` characters, whatever the size of the Arrow batches."""
    for batch in batches:
        keys, texts, k, t, size = batch.column(key).to_pylist(), batch.column("text"), [], [], 0
        for at in range(len(keys)):
            text = texts[at].as_py()
            k.append(keys[at])
            t.append(text)
            size += len(text or "")
            if size >= chars:
                yield k, t
                k, t, size = [], [], 0
        if k:
            yield k, t


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the given arrays or lists."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: the session's spark.checkpoint.dir.

    Where none is set, a temporary folder is made, in local mode only.
    """
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    folder = sc.getConf().get("spark.checkpoint.dir") or (there.get() if there.isDefined() else None)
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not there.isDefined():
        sc.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def packed(docs: DataFrame, **columns) -> DataFrame:
    """`docs` with each row in one struct, `row`, beside the given columns: no name of theirs can clash with one of docs."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[column.alias(name) for name, column in columns.items()])


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of packed(), with their own columns alone."""
    return rows.select(*[F.col("row")[c].alias(c) for c in columns])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph with `edges` (a, b): root is the least node of the component.

    Alternates the large-star and small-star steps until the edges no longer change. Each step is an aggregation and a
    join by node, so that a hub of many edges is spread by the join's skew handling and no component is held in one task.
    A graph without edges gives no rows.
    """
    now = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e")).select("e.a", "e.b").where("a < b").distinct()
        now = settled(small)
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if found == mark:
            break
        mark = found
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

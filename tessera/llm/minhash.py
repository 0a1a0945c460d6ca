"""MinHash near-duplicates from two permutations, one of them shifted circularly for each coordinate."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, grams, hashes, over_texts, packed, read, settled, table, unpacked, words

#: A pair at the threshold shares a band with a chance of 1 - (1 - 0.5 ** 3) ** 27 = 0.97. Copies in which up to 12 % of the
#: words, anywhere, are others keep a Jaccard similarity of f / (2 - f) >= 0.5, f = 0.88 ** 3 being the share of unbroken shingles.
SHINGLE, THRESHOLD, BANDS, ROWS = 3, 0.5, 27, 3
#: SQL has no circulant permutation, so the query is tested against brute force.
ORACLE = None
_SIGNED = pa.schema([("doc_id", pa.int64()), ("content", pa.string()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])
#: Shingles that are hashed at once, few enough for a core's cache.
BLOCK = 32_768


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams; a shorter text is one shingle, a text without words none."""
    w = hashes(words(text))
    return np.unique(grams(w, range(min(size, len(w))))) if len(w) else w


def _permute(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit integers, in place."""
    for shift, times in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(times), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row of `size` coordinates for each non-empty set.

    The first permutation places each shingle on the ring of the 32-bit integers; coordinate k is the least value of the
    second permutation after the ring has been turned by k.
    """
    out = np.empty((len(sets), size), np.uint32)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= BLOCK):
            total += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        turned, spare = np.empty_like(x), np.empty_like(x)
        place = _permute(x ^ np.uint32(0x5BD1E995), spare)
        for k in range(size):
            np.add(place, np.uint32(k), out=turned)
            out[at:end, k] = np.minimum.reduceat(_permute(turned, spare), starts)
        at = end
    return out


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in over_texts(batches):
            sets = [(i, s) for i, t in zip(ids, texts) if t and len(s := shingles(t, shingle))]
            if not sets:
                continue
            found = signatures([s for _, s in sets], bands * rows).astype(np.uint64).reshape(len(sets) * bands, rows)
            keys = np.zeros(len(found), np.uint64)
            for r in range(rows):
                keys = (keys + found[:, r] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(29)
            keys = (keys.reshape(len(sets), bands) + np.arange(bands, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            yield table({"doc_id": [i for i, _ in sets], "content": [xxhash.xxh3_128_hexdigest(s.tobytes()) for _, s in sets], "size": [len(s) for _, s in sets], "bands": list(keys.view(np.int64))}, _SIGNED)

    return run


def _verify(shingle: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, sets = None, []  # the rows come in order: a leader's own text before its members'
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            a, ids, texts = batch.column("a").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(len(a)):
                if a[at] != leader:
                    leader, sets = a[at], []
                mine = shingles(texts[at].as_py() or "", shingle)
                if ids[at] == leader:
                    sets.append(mine)
                    continue
                best = 0.0
                for other in sets:
                    both = np.intersect1d(mine, other, assume_unique=True).size
                    best = max(best, both / max(1, mine.size + other.size - both))
                if best >= threshold:
                    found.append((leader, ids[at], best))
            if found:
                yield table(dict(zip(("a", "b", "jaccard"), map(list, zip(*found)))), _PAIRS)

    return run


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b), a < b, whose texts have a Jaccard similarity of at least the threshold.

    Each text is sent once for each pair in which it is b, and once as a; the rows of one a are read as a stream.
    """
    need = pairs.select("a", F.col("b").alias("doc_id")).unionByName(pairs.select("a", F.col("a").alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    rows = texts.join(need, "doc_id").select("a", "doc_id", "text")
    return rows.repartition("a").sortWithinPartitions("a", "doc_id").mapInArrow(_verify(shingle, threshold), "a long, b long, jaccard double")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, duplicate_of): every document of a group of near copies but its least doc_id, which is duplicate_of.

    docs has doc_id and text; other columns are ignored. A group is a component of the graph whose edges are the pairs
    that share a band and have an exact Jaccard similarity of at least `threshold` over word n-grams. Texts with the same
    set of n-grams are first taken together. In a bucket every member is compared with the least one; then members that
    are in different components still are compared with each other, component against component, unless their numbers of n-grams
    are too far apart for the threshold. So no pair that could join two groups is left out and a group of n copies costs n comparisons; a bucket of many
    texts that are unlike each other costs comparisons by the square of their number. Rows with the same doc_id are one document. A null doc_id or text, and a
    text without words, has no duplicates. Texts are read whole, however long. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    signed = settled(texts.mapInArrow(_sign(shingle, bands, rows), "doc_id long, content string, size long, bands array<long>"))
    first = signed.groupBy("content").agg(F.min(F.struct("doc_id", "size", "bands")).alias("f"))
    banded = first.select(F.col("f.doc_id").alias("b"), F.col("f.size").alias("size"), F.explode("f.bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min(F.struct("b", "size")).alias("a"), F.count("*").alias("n")).where("n > 1").select("key", F.col("a.b").alias("a"), F.col("a.size").alias("a_size"))
    buckets = settled(banded.join(shared, "key").select("key", "a", "a_size", "b", "size"))
    fit = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)  # noqa: E731 - the Jaccard similarity is this ratio at most
    edges = settled(verified(docs, buckets.where("a < b").where(fit("a_size", "size")).select("a", "b").distinct(), shingle, threshold))
    root = components(edges)
    placed = buckets.join(root, buckets.b == root.node, "left").select("key", "a", "b", "size", F.coalesce("root", "b").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    open_ = settled(placed.join(mixed, "key").where("b <> a").select("key", "root", "b", "size"))  # the least of a bucket has met all others
    groups = open_.groupBy("key", "root").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    one, other = (groups.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("root", "low", "high")]) for k in (1, 2))
    two = one.join(other, "key").where("root1 < root2").where((F.col("high1") >= threshold * F.col("low2")) & (F.col("high2") >= threshold * F.col("low1"))).select("key", "root1", "root2")
    left, right = (open_.select("key", F.col("root").alias(f"root{k}"), F.col("b").alias(f"b{k}"), F.col("size").alias(f"size{k}")) for k in (1, 2))
    rest = two.join(left, ["key", "root1"]).join(right, ["key", "root2"]).where(fit("size1", "size2")).select(F.least("b1", "b2").alias("a"), F.greatest("b1", "b2").alias("b")).distinct()
    rest = settled(rest)
    if not rest.isEmpty():
        more = settled(verified(docs, rest, shingle, threshold))
        if not more.isEmpty():
            root = components(edges.unionByName(more))
    same = signed.select("doc_id", "content").distinct()
    named = first.select("content", F.col("f.doc_id").alias("node")).join(root, "node", "left").select("content", F.coalesce("root", "node").alias("duplicate_of"))
    # rows of one doc_id with different texts can stand in several groups: the least wins
    return same.join(named, "content").groupBy("doc_id").agg(F.min("duplicate_of").alias("duplicate_of")).where("doc_id <> duplicate_of")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each group of near copies, the one of the least doc_id; see near_duplicates().

    Rows with a null doc_id stay, as do those with a null text, an empty one or one without words, but for repeats of their doc_id. Repeated rows of the
    same doc_id are one document: of these the one with the least text stays, null first, of equal texts the one with the least hash of all its columns that can be hashed. Other columns, of
    whatever names, stay as they are. An empty table stays empty.
    """
    gone = near_duplicates(docs, **options).select(F.col("doc_id").alias("id"))
    hashable = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    rows = packed(docs, id=docs["doc_id"].cast("long"), text=docs["text"], tie=F.xxhash64(*hashable))
    kept = rows.where("id is not null").join(gone, "id", "left_anti")
    once = kept.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("text", "tie"))).where("rank = 1")
    return unpacked(once.select("row").unionByName(rows.where("id is null").select("row")), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))

"""Embedding near-duplicates: balanced binary codes by a learned rotation, multi-index Hamming tables, and cosines of the vectors."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, read, settled

THRESHOLD, ROUNDS, MISSED = 0.95, 8, 0.002
#: Bits by which two vectors that met are compared before their vectors travel, and the standard deviations that a pair at the threshold may be off.
SKETCH, DEVIATIONS = 64, 6
#: Vectors of one class that are laid against as many others at once, where they must be compared one by one.
BLOCK = 2048
ORACLE = f"""
WITH RECURSIVE link AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding, b.embedding) >= {THRESHOLD}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), class AS (
  SELECT a AS vec_id, min(b) AS class_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT vec_id, class_id, coalesce(n_links, 0) AS n_links FROM class LEFT JOIN degree USING (vec_id) WHERE vec_id IS NOT NULL
"""
_SUM = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("x", pa.float64())])
_CODED = pa.schema([("vec_id", pa.int64()), ("sketch", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _rows(column: pa.Array, n: int) -> np.ndarray:
    """The unit vectors of a column of n lists of equal lengths."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch, each divided by its norm."""
    return _rows(batch.column("embedding"), batch.num_rows) if batch.num_rows else np.empty((0, dim))


def _summed(vectors: DataFrame, dim: int, of) -> np.ndarray:
    """The sum over all vectors of a matrix that `of` makes of a block of them; each task sends its own sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch, dim)
            total = of(x) if total is None else total + of(x)
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], schema=_SUM)

    rows = vectors.select("embedding").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # of a size given by the dimension
    out = np.zeros((max(r["i"] for r in rows) + 1, max(r["j"] for r in rows) + 1))
    for r in rows:
        out[r["i"], r["j"]] = r["x"]
    return out


def learned(vectors: DataFrame, dim: int, n: int, rotations: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """(mean, projections): principal axes turned by `rotations` rotations, each learned from another start.

    Every round takes all vectors' codes under the rotation, and turns it to where the codes agree best with the vectors, for
    which one pass sums what all rotations need.
    """
    moments = _summed(vectors, dim, lambda x: np.vstack([x.sum(0), x.T @ x]))
    mean = moments[0] / n
    spread = moments[1:] / n - np.outer(mean, mean)
    axes = np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1]
    turns = [np.linalg.qr(np.random.default_rng(k).standard_normal((dim, dim)))[0] for k in range(rotations)]
    for _ in range(rounds):
        now = list(turns)

        def agree(x: np.ndarray, now: list = now) -> np.ndarray:
            v = (x - mean) @ axes
            return np.vstack([np.where(v @ r >= 0, 1.0, -1.0).T @ v for r in now])

        both = _summed(vectors, dim, agree).reshape(rotations, dim, dim)
        turns = []
        for b in both:
            left, _, right = np.linalg.svd(b)
            turns.append((left @ right).T)
    return mean, [axes @ r for r in turns]


def centred_norms(vectors: DataFrame, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(norms, shares): how the norms of the unit vectors less their mean are spread, in steps of 1 / 128."""
    mean = _summed(vectors, dim, lambda x: x.sum(0)[None])[0] / n
    counts = _summed(vectors, dim, lambda x: np.histogram(np.linalg.norm(x - mean, axis=1), 257, (0, 257 / 128))[0][None].astype(float))[0]
    some = np.flatnonzero(counts)
    return (some + 0.5) / 128, counts[some] / counts.sum()


def chance(threshold: float, norms: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(chances that a bit differs, shares) of pairs at the threshold: angle / pi, seen from the mean, `norms` (and shares) away."""
    far, share = norms or (np.ones(1), np.ones(1))
    return np.minimum(0.5, 2 / math.pi * np.arcsin(np.minimum(1, math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 / far))), share


def tables(n: int, threshold: float, missed: float = MISSED, norms: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[int, int]:
    """(bits of a table's keys, tables) for n vectors, so that equal keys in one table or another are expected of all but
    `missed` of the pairs at the threshold, and of more of the closer ones.

    Longer keys need more tables, shorter ones make more chance meetings: the least sum of both is taken, which lets keys
    grow with the logarithm of n.
    """
    p, share = chance(threshold, norms)

    def count(bits: int) -> int:
        miss = 1 - (1 - p) ** bits
        lo, hi = 0, 1
        while share @ miss**hi > missed and hi < 1 << 12:
            lo, hi = hi, 2 * hi
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if share @ miss**mid > missed else (lo, mid)
        return hi

    most = max(8, min(40, math.ceil(math.log2(max(2, n))) + 2))
    bits = min(range(most, 3, -1), key=lambda b: count(b) * (1 + min(1.0, n / 2**b) + n / 2**b))
    return bits, count(bits)


def _codes(mean: np.ndarray, axes: np.ndarray, dim: int, bits: int, count: int):
    """Each vector's keys, with their table's number above, and its sketch: the SKETCH bits behind those of the keys."""
    weights, sketch = 1 << np.arange(bits, dtype=np.int64), np.left_shift(np.uint64(1), np.arange(SKETCH, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            if not len(x):
                continue
            on = (x - mean) @ axes >= 0
            keys = on[:, : bits * count].reshape(len(x), count, bits) @ weights | np.arange(count, dtype=np.int64) << 41
            mark = (on[:, bits * count : bits * count + SKETCH] * sketch).sum(1, dtype=np.uint64).view(np.int64)
            size = pa.array(np.arange(len(x) + 1, dtype=np.int32) * count)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(mark), pa.ListArray.from_arrays(size, pa.array(keys.ravel()))], schema=_CODED)

    return run


def _cosines(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array((_rows(batch.column("x"), batch.num_rows) * _rows(batch.column("y"), batch.num_rows)).sum(1) >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, use: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose vectors have a cosine of at least the threshold."""
    left, right = (use.select(F.col("vec_id").alias(k), F.col("embedding").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return settled(pairs.join(left, "a").join(right, "b").select("x", "y", "a", "b").mapInArrow(_cosines(threshold), "a long, b long"))


def classes(use: DataFrame, dim: int, n: int, threshold: float, rounds: int, missed: float) -> DataFrame:
    """(node, root) of the vectors of `use` (vec_id, embedding) that have a near one, root being the least of their class.

    Vectors with an equal key meet. All of a key are compared with its least one, first by sketches, then by cosines. Then what
    is in one bucket but in different classes yet is compared too, class against class, so that no pair that met and could
    join two classes is left out, while n copies take n comparisons a table.
    """
    norms = centred_norms(use, dim, n)
    bits, count = tables(n, threshold, missed, norms)
    p, share = chance(threshold, norms)
    order = np.argsort(p)
    p = float(p[order][min(len(p) - 1, int(np.searchsorted(np.cumsum(share[order]), 0.999)))])
    most = math.ceil(SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)))
    mean, axes = learned(use, dim, n, -(-(bits * count + SKETCH) // dim), rounds)
    coded = use.mapInArrow(_codes(mean, np.hstack(axes), dim, bits, count), "vec_id long, sketch long, keys array<long>")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most
    keyed = coded.select(F.explode("keys").alias("key"), "vec_id", "sketch")
    # the rows of keys that only one vector has go here already
    first = keyed.groupBy("key").agg(F.min(F.struct("vec_id", "sketch")).alias("f"), F.count("*").alias("n")).where("n > 1").select("key", F.col("f.vec_id").alias("a"), F.col("f.sketch").alias("s"))
    met = settled(keyed.join(first, "key"))
    edges = _verified(met.where(F.col("a") < F.col("vec_id")).where(near("s", "sketch")).select("a", F.col("vec_id").alias("b")).distinct(), use, threshold)
    root = components(edges)
    placed = met.join(root, met.vec_id == root.node, "left").select("key", "vec_id", "sketch", "a", F.coalesce("root", "vec_id").alias("root"))
    open_ = placed.join(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "key")
    there = settled(open_.where(F.col("vec_id") != F.col("a")))  # the least of a key has met all others
    roots = there.select("key", "root").distinct()
    two = roots.select("key", F.col("root").alias("r1")).join(roots.select("key", F.col("root").alias("r2")), "key").where("r1 < r2")
    one = there.select("key", F.col("root").alias("r1"), F.col("vec_id").alias("u"), F.col("sketch").alias("p"))
    other = there.select("key", F.col("root").alias("r2"), F.col("vec_id").alias("v"), F.col("sketch").alias("q"))
    rest = two.join(one, ["key", "r1"]).join(other, ["key", "r2"]).where(near("p", "q")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    more = _verified(rest, use, threshold)
    return root if more.isEmpty() else components(edges.unionByName(more))


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            angle = np.arccos(np.clip((_rows(batch.column("embedding"), batch.num_rows) * _rows(batch.column("centre"), batch.num_rows)).sum(1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("class_id"), batch.column("copies"), pa.array(angle)], ["vec_id", "class_id", "copies", "angle"])


def _counted(threshold: float):
    """Links of the vectors of two blocks of a class; the rows come block pair by block pair."""

    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        x = _rows(t["embedding"].combine_chunks(), t.num_rows)
        copies, side = t["copies"].to_numpy(), t["side"].to_numpy()
        lo = np.flatnonzero(side == 0)
        hi = np.flatnonzero(side == 1)
        out = np.zeros(t.num_rows, np.int64)
        if t["lo"][0].as_py() != t["hi"][0].as_py():
            like = x[lo] @ x[hi].T >= threshold
            out[lo], out[hi] = like @ copies[hi], like.T @ copies[lo]
        else:
            out = (x @ x.T >= threshold) @ copies - copies
        return pa.RecordBatch.from_arrays([t["vec_id"].combine_chunks(), pa.array(out)], ["vec_id", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("class_id", "lo", "hi")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if parts and tuple(key[a]) != now:
                    yield links(parts)
                    parts = []
                now = tuple(key[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield links(parts)

    return run


def degrees(members: DataFrame, dim: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links): the vectors of its class that each of `members` (vec_id, class_id, copies, embedding) is near to, other copies of it too.

    By the triangle inequality of angles around a class's centre, the sum of its vectors: two vectors whose angles to it add up to the threshold's
    at most are near. So the vectors that are as deep within the class as the farthest allows are near to all; only the
    others are compared with each other, in pairs of blocks of about `block` vectors, of which each leaves counts.
    """
    centre = members.groupBy("class_id").agg(F.array(*[F.sum(F.col("embedding")[k].cast("double")) for k in range(dim)]).alias("centre"))
    turned = settled(members.join(centre, "class_id").select("vec_id", "class_id", "copies", "embedding", "centre").mapInArrow(_angles, "vec_id long, class_id long, copies long, angle double"))
    whole = turned.groupBy("class_id").agg(F.max("angle").alias("far"), F.sum("copies").alias("total"))
    deep = (F.col("angle") + F.col("far")) <= math.acos(threshold) - 1e-7
    placed = turned.join(whole, "class_id").select("vec_id", "class_id", "copies", "total", deep.alias("deep"))
    placed = settled(placed)
    within = placed.where("deep").select("vec_id", (F.col("total") - 1).alias("n_links"))
    outer = placed.where("not deep")
    size = placed.groupBy("class_id").agg(F.count_if(~F.col("deep")).alias("outer"), F.sum(F.when(F.col("deep"), F.col("copies")).otherwise(0)).alias("inner"))
    blocks = F.ceil(F.col("outer") / block).cast("int")
    cut = outer.join(size, "class_id").join(members.select("vec_id", "embedding"), "vec_id").withColumn("own", F.pmod(F.hash("vec_id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    laid = cut.select("class_id", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "vec_id", "copies", "embedding")
    counted = laid.repartition("class_id", "lo", "hi").sortWithinPartitions("class_id", "lo", "hi").mapInArrow(_counted(threshold), "vec_id long, links long")
    summed = counted.groupBy("vec_id").agg(F.sum("links").alias("links"))
    # _counted takes a vector's own copies as links of it but for itself, within its own block
    rest = outer.join(size.select("class_id", "inner"), "class_id").join(summed, "vec_id").select("vec_id", (F.col("inner") + F.col("links") + F.col("copies") - 1).alias("n_links"))
    return within.unionByName(rest)


def near_classes(vectors: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS, missed: float = MISSED, block: int = BLOCK) -> DataFrame:
    """(vec_id, class_id, n_links) of every vec_id: the least vec_id of its class of near vectors, and how many vectors it is near to itself.

    vectors has vec_id and embedding; other columns are ignored. Two vectors are near if their cosine is at least `threshold`; classes are
    the components of near vectors. Equal vectors are taken together first. Codes are of the unit vectors less their mean, balanced by
    rotations of the principal axes, learned from all vectors. Vectors that share a key of any table meet; keys and tables grow
    with the number of vectors, so that `missed` of the pairs at the threshold are expected not to meet, fewer of closer ones. Links are counted
    within a class from the vectors themselves (see degrees()), without pairs. A class of very many vectors that aren't all
    near to its centre costs comparisons by the square of those far from it, in blocks over many tasks.

    Null ids have no row. Null and empty vectors, zero vectors, those with a null or non-finite element, and those of another length than most
    are a class of their own, without links. Rows of the same vec_id are one, with the least vector that is none of these. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id is not null")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18)) & F.exists("embedding", lambda x: x != 0)
    own = settled(given.groupBy("vec_id").agg(F.min(F.when(fine, F.col("embedding"))).alias("embedding")))
    sizes = own.where("embedding is not null").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    alone = lambda df: df.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    if not sizes:
        return alone(own)
    dim = sizes[0]["dim"]
    fit = own.where(F.size("embedding") == dim).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64("embedding", F.lit(1))})
    use = settled(fit.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.min_by("embedding", "vec_id").alias("embedding")))
    root = classes(use.select("vec_id", "embedding"), dim, use.count(), threshold, rounds, missed)
    members = settled(use.join(root, use.vec_id == root.node).select("vec_id", F.col("root").alias("class_id"), "copies", "embedding"))
    linked = degrees(members, dim, threshold, block).join(members.select("vec_id", "class_id"), "vec_id")
    every = use.select("h1", "h2", "vec_id", "copies").join(linked, "vec_id", "left").select("h1", "h2", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("n_links", F.col("copies") - 1).alias("n_links"))
    named = fit.select("vec_id", "h1", "h2").join(every, ["h1", "h2"]).select("vec_id", "class_id", "n_links")
    return named.unionByName(alone(own.where(~F.coalesce(F.size("embedding") == dim, F.lit(False)))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "embeddings"))

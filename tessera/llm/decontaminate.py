"""Benchmark decontamination by spaced seeds: hashes that ignore fixed token positions."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import grams, hashes, over_texts, packed, read, settled, table, unpacked, words

#: Eight of twelve words count in each mask; a hit needs one mask whose eight words all agree.
MASKS = ("111010011011", "110111001101", "101101110011", "111100101101")
#: An overlap counts from so many agreeing words on (or all of a shorter item), with a mismatch taking away PENALTY.
MIN_MATCH, PENALTY = 13, 2
#: Seeds of the test sets that are sent to every executor; beyond it a table of 2 ** TABLE_BITS bits is, and the seeds that pass it are joined by a shuffle.
BROADCAST_SEEDS, TABLE_BITS = 4_000_000, 27
#: SQL can't express the extension around hits; tested against brute force.
ORACLE = None
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("matched_words", pa.int64()), ("overlap_words", pa.int64()), ("item_words", pa.int64())])
_SEEDS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("seed", pa.int64()), ("at", pa.int32())])
_PLACES = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
_SPAN = len(MASKS[0])


def seeds(w: np.ndarray, short: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of all masks over the words, and of plain runs of each length in `short`, for items below the masks' span."""
    every = [grams(w, p) ^ np.uint64(k + 1) for k, p in enumerate(_PLACES)] + [grams(w, range(n)) ^ np.uint64(100 + n) for n in short]
    return np.concatenate(every), np.concatenate([np.arange(len(x), dtype=np.int32) for x in every])


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(start in item, agreeing words, length) of the best stretch of the item laid on the document at `shift`."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi <= lo:
        return 0, 0, 0
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    score = np.where(same, 1, -PENALTY).cumsum()
    before = np.minimum.accumulate(np.concatenate(([0], score[:-1])))
    end = int(np.argmax(score - before))
    start = int(np.flatnonzero(np.concatenate(([0], score[:-1]))[: end + 1] == before[end])[-1])
    return lo + start, int(same[start : end + 1].sum()), end + 1 - start


def _best(doc: np.ndarray, hits: set[tuple[int, int]], items: list[tuple[int, np.ndarray]], min_match: int) -> dict[int, tuple]:
    """Of one text: by item_id, the best overlap of those that count. hits are (place in items, shift)."""
    best: dict = {}
    for k, shift in sorted(hits):
        item, w = items[k]
        start, matched, length = overlap(doc, w, shift)
        new = (matched, -(start + shift), -start, -length, -len(w))
        if matched >= min(min_match, len(w)) and (item not in best or new > best[item]):
            best[item] = new
    return best


def _rows(found: list[tuple]) -> pa.RecordBatch:
    """Rows of (doc_id, item_id, what _best() has)."""
    d, i, *best = map(list, zip(*found))
    m, s, t, n, w = best
    back = lambda x: [-v for v in x]
    return table({"doc_id": d, "item_id": i, "doc_start": back(s), "item_start": back(t), "matched_words": m, "overlap_words": back(n), "item_words": back(w)}, _FOUND)


class _Index:
    """The seeds of the test sets, sorted, behind a bit table of their high bits."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.short = tuple(sorted({len(w) for _, w in items if len(w) < _SPAN}))
        parts = [(*seeds(w, (len(w),) if len(w) < _SPAN else ()), k) for k, (_, w) in enumerate(items)]
        seed = np.concatenate([p[0] for p in parts] or [np.empty(0, np.uint64)])
        order = np.argsort(seed)
        self.seed, self.at = seed[order], np.concatenate([p[1] for p in parts] or [np.empty(0, np.int32)])[order]
        self.item = np.repeat(np.array([p[2] for p in parts], np.int64), [len(p[0]) for p in parts])[order]
        self.bits = np.uint64(64 - max(16, min(26, int(len(seed) * 16).bit_length())))
        self.maybe = np.zeros(1 << (64 - int(self.bits)), bool)
        self.maybe[(self.seed >> self.bits).astype(np.int64)] = True

    def hits(self, w: np.ndarray) -> set[tuple[int, int]]:
        """The (place in items, shift) at which any seed of the document agrees with one of the item."""
        seed, at = seeds(w, self.short)
        some = np.flatnonzero(self.maybe[(seed >> self.bits).astype(np.int64)])
        if not len(some):
            return set()
        lo, hi = np.searchsorted(self.seed, seed[some], "left"), np.searchsorted(self.seed, seed[some], "right")
        n = hi - lo
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return set(zip(self.item[which].tolist(), (np.repeat(at[some], n) - self.at[which]).tolist()))


def _search(shared, min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, index = shared.value
        for ids, texts in over_texts(batches):
            found = []
            for i, text in zip(ids, texts):
                if text and len(w := hashes(words(text))) and (hits := index.hits(w)):
                    found += [(i, item, *what) for item, what in _best(w, hits, items, min_match).items()]
            if found:
                yield _rows(found)

    return run


def _holds(shared, min_match: int):
    """A column function of text: whether it holds a passage of an item."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items, index = shared.value
        for texts in batches:
            found = np.zeros(len(texts), bool)
            for k, text in enumerate(texts):
                if (t := text.as_py()) and len(w := hashes(words(t))) and (hits := index.hits(w)):
                    found[k] = bool(_best(w, hits, items, min_match))
            yield pa.array(found)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")


def _emit(short: tuple[int, ...], own: bool, maybe=None):
    """Seeds as rows; `own`: of an item, which below the span has the seed of its own length only. `maybe`: a bit table that seeds must pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text")):
                if len(w := hashes(words(text.as_py()))):
                    seed, at = seeds(w, ((len(w),) if len(w) < _SPAN else ()) if own else short)
                    if maybe is not None:
                        place = (seed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                        keep = (maybe.value[place >> 6] >> (place & 63) & 1).astype(bool)
                        seed, at = seed[keep], at[keep]
                    if len(seed):
                        yield table({"id": np.full(len(seed), i), "row": np.full(len(seed), row), "seed": seed.view(np.int64), "at": at}, _SEEDS)

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = {len(words(t)) for t in batch.column("text").to_pylist()}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(k for k in n if 0 < k < _SPAN), pa.int64())], ["n"])


def _check(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                doc, item, text, item_text, shifts = (batch.column(c)[k].as_py() for c in ("doc_id", "item_id", "text", "item_text", "shifts"))
                items = [(item, hashes(words(item_text)))]
                found += [(doc, i, *what) for i, what in _best(hashes(words(text)), {(0, s) for s in shifts}, items, min_match).items()]
            if found:
                yield _rows(found)

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()


def _known(items: DataFrame, broadcast_seeds: int):
    """The items' words and their index, to be sent to the executors, if they have few seeds; else None."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size // 2 * len(MASKS) > broadcast_seeds:  # a word and its space take two characters at least
        return None
    known = [(i, w) for i, text in sorted(map(tuple, items.collect())) if len(w := hashes(words(text)))]
    return items.sparkSession.sparkContext.broadcast((known, _Index(known)))


def _joined(texts: DataFrame, items: DataFrame, min_match: int) -> DataFrame:
    """The overlaps, of (doc_id, row, text), by a shuffle of the texts' seeds that may be one of the items'."""
    spark = texts.sparkSession
    short = tuple(sorted(r[0] for r in items.mapInArrow(_lengths, "n long").distinct().collect()))  # fewer than the masks' span
    items = items.withColumn("row", F.xxhash64("text"))
    test = settled(items.select(F.col("item_id").alias("doc_id"), "row", "text").mapInArrow(_emit((), True), "id long, row long, seed long, at int")).select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), "seed", F.col("at").alias("item_at"))
    place = test.select(F.shiftrightunsigned("seed", 64 - TABLE_BITS).alias("p"))
    bits = place.groupBy(F.expr("cast(p >> 6 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()  # 2 ** (TABLE_BITS - 6) rows at most
    maybe = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    maybe[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    train = texts.mapInArrow(_emit(short, False, spark.sparkContext.broadcast(maybe)), "id long, row long, seed long, at int")
    met = train.join(test, "seed").groupBy(F.col("id").alias("doc_id"), "row", "item_id", "item_row").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))
    both = met.join(texts.dropDuplicates(["doc_id", "row"]), ["doc_id", "row"]).join(items.select("item_id", F.col("row").alias("item_row"), F.col("text").alias("item_text")), ["item_id", "item_row"])
    return both.select("doc_id", "text", "item_id", "item_text", "shifts").mapInArrow(_check(min_match), ", ".join(f"{f.name} long" for f in _FOUND))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, matched_words, overlap_words, item_words) of the documents that hold a passage of a test item.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Test and training seeds meet by hash, in
    each scan task while the test sets have at most `broadcast_seeds` seeds (their words times the number of masks), else by a shuffle of those
    training seeds that pass a bit table of the test seeds; both give the same rows. Around each hit the item is laid on the document; the best stretch counts with min_match agreeing words
    (all, if the item is shorter), each substituted word taking away two. For each document and item the best overlap is
    given, the first of equal ones. Items shorter than the masks' span must agree whole. Null doc_id, item_id and
    texts, and texts without words, have no overlaps; rows of the same doc_id, and rows of the same item_id, are searched each by their own text, and
    the best overlap of all is given. Whole texts are searched, however long. Empty tables give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = _items(benchmark)
    columns = [f.name for f in _FOUND]
    known = _known(items, broadcast_seeds)
    if known is not None:
        found = texts.mapInArrow(_search(known, min_match), ", ".join(f"{c} long" for c in columns))
    else:
        found = _joined(texts.withColumn("row", F.xxhash64("text")), items, min_match)
    rest = [F.col(c) if c == "matched_words" else -F.col(c) for c in columns[4:5] + columns[2:4] + columns[5:]]
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*[x.alias(f"v{k}") for k, x in enumerate(rest)])).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.v1")).alias("doc_start"), (-F.col("b.v2")).alias("item_start"), F.col("b.v0").alias("matched_words"), (-F.col("b.v3")).alias("overlap_words"), (-F.col("b.v4")).alias("item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The rows of `docs` whose texts hold no passage of the benchmark, with all columns; see contaminated().

    Each row stays or goes by its own text, whatever its doc_id; null and empty texts stay, equal texts stay or go together, very long ones are searched whole. Other columns, of whatever names, pass.
    While the test sets are small this is a filter without a shuffle. An empty table, or an empty benchmark, changes nothing.
    """
    items = _items(benchmark)
    known = _known(items, broadcast_seeds)
    if known is not None:
        return docs.where(~_holds(known, min_match)(docs["text"]))
    texts = docs.where(docs["text"].isNotNull()).select(F.xxhash64(docs["text"]).alias("doc_id"), F.xxhash64(docs["text"], F.lit(1)).alias("row"), docs["text"].alias("text"))
    leaks = _joined(texts, items, min_match).select(F.col("doc_id").alias("t1")).distinct()
    rows = packed(docs, t1=F.when(docs["text"].isNotNull(), F.xxhash64(docs["text"])))
    return unpacked(rows.join(leaks, "t1", "left_anti"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

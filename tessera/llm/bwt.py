"""Repeated passages from merged Burrows-Wheeler transforms: the shards' orders are interleaved, and refined word by word."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import grams, hashes, over_texts, read, settled, words

#: Words of the shortest passage, and of the grams by which passages meet.
LENGTH, GRAM = 50, 8
#: Starts of passages in one segment at most, words of a shard, whose suffixes are sorted, and words that a task merges at once, or one meeting's.
RUN, SHARD, MERGED = 200, 1 << 16, 2_000_000
#: SQL has no suffix order; tested against brute force.
ORACLE = None
_MEETING = pa.schema([("meeting", pa.int64()), ("doc_id", pa.int64())])
_SEGMENT = pa.schema([("meeting", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])
_FOUND = pa.schema([("meeting", pa.int64()), ("segment", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("first_doc", pa.int64())])


def meetings(w: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each start of `length` words, the least hash of the grams within: equal passages have the same, wherever they are."""
    least = grams(w, range(gram))
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def runs(m: np.ndarray, most: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(first, how many) of the runs of equal values, cut after `most`."""
    first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    n = np.diff(np.append(first, len(m)))
    if n.max() > most:
        cuts = -(-n // most)
        first = np.concatenate([np.arange(f, f + k, most) for f, k in zip(first, n)]) if cuts.max() > 1 else first
        n = np.diff(np.append(first, len(m)))
    return first, n


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The positions of a shard in the order of their suffixes, by doubling, up to `depth` words at least. 0 ends a segment; the ends differ from each other."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < depth:
        behind = np.full(n, -1, np.int64)
        behind[:-step] = rank[step:]
        key = rank << 32 | (behind + 1)
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([False], key[order][1:] != key[order][:-1])).cumsum()
        if new[-1] == rank.max() and new[-1] == n - 1:
            break
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
    return order


def narrow(n: int) -> type:
    """The type for numbers below n: of half the size, as long as they fit."""
    return np.int32 if n < 1 << 31 else np.int64


def counted(key: np.ndarray) -> np.ndarray:
    """The stable order of keys from 0 to 2 ** 32 - 1, by counting: a pass over the lower 16 bits, one over the upper ones if there are any."""
    kind = narrow(len(key))
    order = np.argsort(key.astype(np.uint16), kind="stable").astype(kind)  # a radix sort, as the type has 16 bits
    if len(key) and key.max() >= 1 << 16:
        upper = (key >> 16).astype(np.uint16)[order]
        order = order[np.argsort(upper, kind="stable").astype(kind)]
    return order


def merged(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their first `depth` words, length of the prefix each shares with the one before, `depth` at most).

    A shard is an array of word numbers with a 0 behind each segment; positions count through all shards. Each shard
    brings its own suffix order, of which its transform's first column and last-to-first mapping are kept. The shards' rows are interleaved at first one shard
    behind another. A round walks the rows in the order of the round before, steps from each to the row of the word in front, and
    lets it take the next free slot of its block: counting alone, no suffix is compared. After h rounds the rows lie by h words,
    each shard's among them in its own order, and a bound that appears between two rows gives their common prefix. A row that
    is alone between its bounds has its slot and takes no part any more.
    """
    text = np.concatenate(shards)
    n, offsets = len(text), np.cumsum([0, *map(len, shards)])[:-1]
    kind = narrow(n)
    rows, row_of = np.empty(n, kind), np.empty(n, kind)
    for s, o in zip(shards, offsets.tolist()):
        rows[o : o + len(s)] = sorted_suffixes(s, depth) + o
    row_of[rows] = np.arange(n, dtype=kind)
    front = row_of[rows - 1]  # last to first: the row of the suffix that begins a word before; none in front of a segment
    front[text[rows - 1] == 0] = -1
    behind = row_of[np.minimum(rows + 1, n - 1)]
    del row_of
    first = text[rows]
    ended = first == 0
    first += int(ended.sum())
    first[ended] = np.arange(int(ended.sum()))  # the ends differ from each other, and come first
    del text, ended
    slot_row = counted(first)  # the row in each slot, after the round of the first word
    at = np.empty(n, kind)
    at[slot_row] = np.arange(n, dtype=kind)
    in_order = first[slot_row]
    bound = np.concatenate(([True], in_order[1:] != in_order[:-1]))
    del first, in_order
    shared = np.full(n, depth, np.min_scalar_type(depth))
    shared[bound] = 0
    open_ = np.flatnonzero(~(bound & np.append(bound[1:], True))).astype(kind)  # slots of blocks of several rows
    marked = np.zeros(n, bool)
    for h in range(1, depth):
        if not len(open_):
            break
        block = np.cumsum(bound, dtype=kind)
        marked[:] = False
        marked[at[behind[slot_row[open_]]]] = True
        source = np.flatnonzero(marked).astype(kind)
        walk = front[slot_row[source]]
        before = block[source]
        del source
        small = np.zeros(int(block[-1]) + 1, kind)
        small[block[open_]] = np.cumsum(np.diff(block[open_], prepend=block[open_[:1]]) > 0, dtype=kind)  # numbers of the open blocks, in order
        own = small[block[at[walk]]]
        del block, small
        order = counted(own)
        walk, own, before = walk[order], own[order], before[order]
        del order
        slot_row[open_], at[walk] = walk, open_
        del walk
        fresh = open_[np.concatenate(([True], (own[1:] != own[:-1]) | (before[1:] != before[:-1])))]
        del own, before
        fresh = fresh[~bound[fresh]]
        bound[fresh] = True
        shared[fresh] = h
        open_ = open_[~(bound[open_] & np.append(bound, True)[open_ + 1])]
    return rows[slot_row], shared


def repeats(segments: list[np.ndarray], docs_lo: np.ndarray, docs_hi: np.ndarray, length: int, shard: int = SHARD) -> list[list[tuple[int, int, int]]]:
    """For each segment its passages (start, end, first document) of `length` words or more that two documents have.

    docs_lo and docs_hi are the least and the greatest document of each segment.
    """
    sizes = np.array([len(s) for s in segments])
    n = int(sizes.sum()) + len(sizes)
    kind = narrow(n)
    begin = np.cumsum(sizes + 1) - sizes - 1
    segment_of = np.repeat(np.arange(len(sizes), dtype=kind), sizes + 1)
    word = np.ones(n, bool)
    word[begin + sizes] = False
    joined = np.concatenate(segments)
    known = np.unique(joined)
    text = np.zeros(n, kind)
    text[word] = np.searchsorted(known, joined).astype(kind) + 1
    del word, joined, known
    cuts = np.flatnonzero(np.diff((begin + sizes) // shard, prepend=0)) if n > shard else np.empty(0, int)
    positions, shared = merged([s for s in np.split(text, begin[cuts]) if len(s)], length)
    del text
    block = np.flatnonzero(shared < length)
    size = np.diff(np.append(block, n))
    segment = segment_of[positions]
    lo = np.minimum.reduceat(docs_lo[segment], block)
    hi = np.maximum.reduceat(docs_hi[segment], block)
    del shared, block, segment, segment_of
    first = np.empty(n, np.int64)
    first[positions] = np.repeat(lo, size)
    both = np.zeros(n, bool)
    both[positions] = np.repeat(lo < hi, size)
    del positions, lo, hi, size
    both &= np.arange(n, dtype=kind) <= np.repeat((begin + sizes - length).astype(kind), sizes + 1)
    start = np.flatnonzero(both & ~np.concatenate(([False], both[:-1])))
    end = np.flatnonzero(both & ~np.append(both[1:], False)) + length
    out: list[list[tuple[int, int, int]]] = [[] for _ in segments]
    of = np.searchsorted(begin, start, "right") - 1
    for s, a, b, f in zip(of.tolist(), (start - begin[of]).tolist(), (end - begin[of]).tolist(), (np.minimum.reduceat(np.append(first, 1 << 62), np.stack((start, end - length + 1), 1).ravel())[::2] if len(start) else first[:0]).tolist()):
        out[s].append((a, b, f))
    return out


def _meet(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in over_texts(batches):
            found, of = [], []
            for i, text in zip(ids, texts):
                w = hashes(words(text))
                if len(w) >= length:
                    found.append(np.unique(meetings(w, length, gram)))
                    of.append(np.full(len(found[-1]), i, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(of))], schema=_MEETING)

    return run


def _cut(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(batch.num_rows):
                w = hashes(words(batch.column("text")[at].as_py()))
                if len(w) < length:
                    continue
                wanted = np.sort(batch.column("meetings")[at].values.to_numpy(zero_copy_only=False))
                doc = batch.column("doc_id")[at].as_py()
                m = meetings(w, length, gram).view(np.int64)
                first, n = runs(m)
                own = m[first]
                there = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                use = np.flatnonzero(wanted[there] == own)
                short = (w >> np.uint64(32)).astype(np.uint32)
                rows: list[list] = [[], [], [], [], []]
                for meeting, a, k in zip(own[use].tolist(), first[use].tolist(), n[use].tolist()):
                    raw = short[a : a + k + length - 1].tobytes()
                    name = xxhash.xxh64_intdigest(raw) - (1 << 63)
                    new = (meeting, name) not in sent  # the words once a task, then the name only
                    if new:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add((meeting, name))
                    for column, value in zip(rows, (meeting, name, doc, a, raw if new else None)):
                        column.append(value)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SEGMENT)], schema=_SEGMENT)

    return run


def _merge(length: int, shard: int, most: int = MERGED):
    """Stretches of distinct segments; the rows come meeting by meeting, and are merged so many words at once that make up `most`."""

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        raw = t["words"].combine_chunks()
        segments = [np.frombuffer(x.as_buffer(), np.uint32) for x in raw]
        stretches = repeats(segments, t["least"].to_numpy(), t["most"].to_numpy(), length, shard)
        many = np.array([len(f) for f in stretches])
        flat = np.array([x for f in stretches for x in f], np.int64).reshape(-1, 3)
        which = np.repeat(np.arange(len(many)), many)
        return pa.RecordBatch.from_arrays([pa.array(t["meeting"].to_numpy()[which]), pa.array(t["segment"].to_numpy()[which]), *[pa.array(flat[:, k].copy()) for k in range(3)]], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            meeting = batch.column("meeting").to_numpy()
            words_ = np.diff(np.concatenate(([0], np.cumsum([len(x.as_buffer()) // 4 for x in batch.column("words")]))))
            cuts = [0, *(np.flatnonzero(meeting[1:] != meeting[:-1]) + 1).tolist(), len(meeting)]
            begin = 0
            for a, b in zip(cuts, cuts[1:]):
                if size >= most and meeting[a] != last:
                    if begin < a:
                        parts.append(batch.slice(begin, a - begin))
                    yield found(parts)
                    parts, size, begin = [], 0, a
                size += int(words_[a:b].sum())
                last = meeting[a]
            parts.append(batch.slice(begin))
        if parts:
            yield found(parts)

    return run


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc): the stretches of each document made of `length`-word passages that another document has too.

    docs has doc_id and text; other columns are ignored. Words are compared in lower case, without what stands between
    them. first_doc is the least document with any of the passages in the stretch. Equal passages have the same least gram hash, their
    meeting; the stretches of meetings that only one document has are left out by an aggregation, the others are cut out as segments. Equal
    segments are aggregated to one with its least and greatest document before they are sent to their meeting's task, in which the
    shards' transforms are merged (see merged()); what that finds is joined back to all documents of the segment, so that no task holds the
    documents of a passage, however many have it. Any passage is in the task of its meeting
    whole, so the result is exact but for equal hashes of different words (64 bits a gram, then 32 bits a word). Repeats within one document don't count.
    Null texts and doc_ids, and texts below `length` words, have no repeats; very long texts are cut whole; rows of the same doc_id are one document, so that equal ones are no
    repeats of each other, and one stretch of the same document in several rows is given once. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    met = texts.mapInArrow(_meet(length, gram), "meeting long, doc_id long").repartition("meeting")
    common = met.groupBy("meeting").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("meeting")
    of = met.join(common, "meeting").groupBy("doc_id").agg(F.collect_set("meeting").alias("meetings"))
    cut = settled(texts.join(of, "doc_id").select("doc_id", "text", "meetings").mapInArrow(_cut(length, gram), "meeting long, segment long, doc_id long, start long, words binary"))
    segments = cut.groupBy("meeting", "segment").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("words").alias("words"))
    found = segments.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(_merge(length, shard), "meeting long, segment long, lo long, hi long, first_doc long")
    placed = cut.select("meeting", "segment", "doc_id", "start").join(found, ["meeting", "segment"])
    found = placed.select("doc_id", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi")).alias("end"), "first_doc")
    by_doc = Window.partitionBy("doc_id").orderBy("start", "end")
    new = found.withColumn("reach", F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
    stretch = new.withColumn("stretch", F.sum(F.when(F.col("start") > F.coalesce("reach", F.lit(-1)), 1).otherwise(0)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return stretch.groupBy("doc_id", "stretch").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("first_doc").alias("first_doc")).drop("stretch")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))

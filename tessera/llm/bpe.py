"""Byte-level BPE encoding and decoding in batched numpy merge rounds, with the vocabulary of a public tokenizer."""

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import PIECE, alone, over_texts, read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is split before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: SQL has no merge loop; tested against another encoder and by the round trip.
ORACLE = None
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decodes", pa.bool_())])
_NONE = np.iinfo(np.int64).max
#: Distinct words and token ids that an encoder keeps, and bytes of one batch of words that it merges at once.
KEPT, KEPT_IDS, BATCH_BYTES = 400_000, 4_000_000, 2_000_000
#: Bytes from which a word is merged by itself, through a heap of its pairs, as rounds would take the square of its length.
LONG = 512


class Encoder:
    """Merges by rank. `ranks` is the vocabulary: bytes of each token, and its id, which is its rank too."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.split = regex.compile(PATTERN)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        key, to = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None:
                    key.append(left << 32 | right)
                    to.append(rank)
        order = np.argsort(np.array(key, np.int64))
        #: Pair keys in order, and the rank of the token that each pair makes.
        self.key, self.to = np.array([*np.array(key, np.int64)[order], _NONE], np.int64), np.array([*np.array(to, np.int64)[order], _NONE], np.int64)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.pairs: dict[int, int] | None = None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in one array, how many each word has). Each round merges in every word its pair of the lowest rank, the leftmost of equal ones; words without a pair are done."""
        flat = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        which, n = np.arange(len(words)), sizes.copy()
        done_at, done_ids = [], []
        while len(which):
            ends = np.cumsum(n)
            starts = ends - n
            rank = np.full(len(flat), _NONE)
            pair = flat[:-1] << 32 | flat[1:]
            at = np.searchsorted(self.key, pair)
            rank[:-1] = np.where(self.key[at] == pair, self.to[at], _NONE)
            rank[ends - 1] = _NONE  # not across words
            least = np.minimum.reduceat(rank, starts)
            more = least != _NONE
            if not more.all():
                stay = np.repeat(more, n)
                done_at.append(which[~more])
                done_ids.append((flat[~stay], n[~more]))
                which, n, flat, rank, least = which[more], n[more], flat[stay], rank[stay], least[more]
                if not len(which):
                    break
                starts = np.cumsum(n) - n
            lowest = np.flatnonzero(rank == np.repeat(least, n))
            owner = np.searchsorted(starts, lowest, "right") - 1
            first = lowest[np.concatenate(([True], owner[1:] != owner[:-1]))]
            flat[first] = least
            keep = np.ones(len(flat), bool)
            keep[first + 1] = False
            flat, n = flat[keep], n - 1
        order = np.argsort(np.concatenate(done_at)) if done_at else np.empty(0, np.int64)
        counts = np.concatenate([c for _, c in done_ids])[order] if done_at else np.empty(0, np.int64)
        starts = np.concatenate([c for _, c in done_ids]).cumsum() if done_at else counts
        ids = np.concatenate([x for x, _ in done_ids]) if done_at else flat
        begin = (starts - np.concatenate([c for _, c in done_ids]))[order] if done_at else counts
        total = int(counts.sum())
        take = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(total)
        return ids[take].astype(np.int32), counts

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: the pair of the lowest rank is merged, the leftmost of equal ones, until there is none, in n log n steps."""
        start = self.byte[np.frombuffer(word, np.uint8)]
        n = len(start)
        key = start[:-1] << 32 | start[1:]
        at = np.searchsorted(self.key, key)
        rank = np.where(self.key[at] == key, self.to[at], -1)
        some = np.flatnonzero(rank >= 0)
        heap = np.sort(rank[some] << 32 | some).tolist()  # in order, so a heap
        ids, now = start.tolist(), [*rank.tolist(), -1]
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
        if self.pairs is None:
            self.pairs = dict(zip(self.key[:-1].tolist(), self.to[:-1].tolist()))
        get, pop, push = self.pairs.get, heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if now[i] != r:  # merged or changed since
                continue
            gone = behind[i]
            ids[i], now[gone] = r, -1
            ids[gone] = -1
            behind[i] = k = behind[gone]
            now[i] = -1
            if k < n:
                before[k] = i
                if (new := get(r << 32 | ids[k], -1)) >= 0:
                    now[i] = new
                    push(heap, new << 32 | i)
            if (p := before[i]) >= 0:
                now[p] = new = get(ids[p] << 32 | r, -1)
                if new >= 0:
                    push(heap, new << 32 | p)
        done = np.array(ids, np.int64)
        return done[done >= 0].astype(np.int32)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        if max(map(len, raw)) >= LONG:
            for long in (w for w, b in zip(words, raw) if len(b) >= LONG):
                ids = self.merge_long(long.encode())
                self.known[long] = len(self.known)
                self.start, self.size, self.ids = np.append(self.start, len(self.ids)), np.append(self.size, len(ids)), np.concatenate((self.ids, ids))
            words, raw = [w for w, b in zip(words, raw) if len(b) < LONG], [b for b in raw if len(b) < LONG]
        at = 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) <= BATCH_BYTES):
                size += len(raw[end])
                end += 1
            ids, n = self.merge(raw[at:end])
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(n) - n))
            self.size, self.ids = np.concatenate((self.size, n)), np.concatenate((self.ids, ids))
            self.known.update(zip(words[at:end], range(len(self.known), len(self.known) + end - at)))
            at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of each text."""
        alone(self)
        if len(self.known) > KEPT or len(self.ids) > KEPT_IDS:
            self.forget()
        split = [self.split.findall(t) for t in texts]
        if new := [w for w in dict.fromkeys(w for s in split for w in s) if w not in self.known]:
            self._learn(new)
        out = []
        for s in split:
            at = np.fromiter(map(self.known.__getitem__, s), np.int64, len(s))
            n = self.size[at]
            ends = np.cumsum(n)
            out.append(self.ids[np.repeat(self.start[at] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode(errors="replace")


def vocabulary(path: str) -> dict[bytes, int]:
    """The ranks in a file of base64 tokens and ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    ranks = shared.value
    if id(ranks) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(ranks)] = Encoder(ranks)
    return _ENCODERS[id(ranks)]


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for keys, texts in over_texts(batches, chars=PIECE):
            some = [t for t in texts if t is not None]
            found = iter(encoder.encode(some))
            ids = [None if t is None else next(found) for t in texts]
            n = np.array([0 if x is None else len(x) for x in ids], np.int64)
            flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], n.cumsum())).astype(np.int32)), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in ids]))
            right = [None if t is None else encoder.decode(x) == t for t, x in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n), lists, pa.array(right, pa.bool_())], schema=_SCHEMA)

    return run


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decodes) of every row: the text's tokens, and whether they decode to it exactly.

    docs has doc_id and text; other columns are ignored. The vocabulary is read by the driver. Whole texts are encoded, however
    long; a word of LONG bytes or more takes n log n steps. Equal texts have equal ids. A null text has null token_ids and decodes and 0 tokens, an empty one an empty list. Every row gives one row, also
    those with a null or repeated doc_id; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_run(shared), "doc_id long, n_tokens long, token_ids array<int>, decodes boolean")


def _unrun(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            ids = batch.column("token_ids")
            texts = [None if not x.is_valid else encoder.decode(np.array(x.as_py(), np.int64)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows with doc_id and token_ids; other columns are ignored.

    Null token_ids give a null text, empty ones an empty text; lists of any length are decoded whole, each row by itself, also those of null or repeated
    doc_ids. An id outside the vocabulary, or a null one, is an error. An empty table gives no rows.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))
    return tokens.select(tokens["doc_id"].cast("long").alias("doc_id"), "token_ids").mapInArrow(_unrun(shared), "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))

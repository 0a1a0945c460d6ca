"""Quality without labels: votes of heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import CACHED_WORDS, PIECE, alone, over_texts, read, table

#: Documents on which the scorer is fitted, about; votes and their statistics are of all documents.
TRAINED = 6000
#: Buckets of hashed features, and the score from which a document is kept.
BUCKETS, THRESHOLD = 1 << 15, 0.5
#: SQL can't fit the model; tested against a brute-force count of votes and scores, and by held-out accuracy.
ORACLE = None
_SHAPE = re.compile(r"[^\W\d_]+|\d+|_+|[^\w]+|.", re.DOTALL)
_SYMBOLS = re.compile(r"[^\w\s.,;:!?\"'()%-]")
_ENDS = ".,;:!?\"')"
_VOTED = pa.schema([("pattern", pa.int64()), ("n", pa.int64())])
_LEARN = pa.schema([("key", pa.int64()), ("pattern", pa.int64()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
LABELLERS = 9
#: What a token's number holds besides its shape's bucket: upper case, symbols, a sentence's end, at most three letters, a bar or bullet alone, plain words or numbers.
_UPPER, _SYMBOL, _END, _SHORT, _BAR, _PLAIN = (1 << (32 + k) for k in range(6))


@functools.lru_cache(1 << 16)
def _bucket(shape: str) -> int:
    return xxhash.xxh32_intdigest(shape) % BUCKETS


def _token(token: str) -> int:
    """A token's flags above its shape's bucket. The shape tells letters by case, digits and the very symbols, runs being one."""
    rest = token.rstrip(_ENDS)
    if rest.isalpha() and (first := rest[0]).isupper() <= (len(rest) == 1 or rest[1:].islower()) and (first.isupper() or rest.islower()):  # most tokens: a word, and what ends a sentence
        tail = token[len(rest) :]
        flags = (_SHORT if len(rest) <= 3 else 0) | (_END if tail else 0) | (_SYMBOL if token.endswith("!!") else _PLAIN)
        word = "Aa" if first.isupper() else "a"
        return flags | _bucket(f"{word} {tail if len(tail) < 4 else tail[0] + '+'}" if tail else word)
    return _odd_token(token, rest)


def _odd_token(token: str, rest: str) -> int:
    shape = []
    letters = 0
    for part in _SHAPE.findall(token):
        if part[0].isalpha():
            letters += len(part)
            shape.append("A" if part.isupper() and len(part) > 1 else "Aa" if part[0].isupper() else "a")
        else:
            shape.append("9" if part[0].isdigit() else part if len(part) < 4 else part[0] + "+")
    flags = (_UPPER if letters > 1 and token.isupper() else 0) | (_SHORT if 0 < letters <= 3 else 0)
    flags |= _SYMBOL if _SYMBOLS.search(token) or token.endswith("!!") else 0
    flags |= _END if len(rest) < len(token) else 0
    flags |= _BAR if not letters and not any(c.isdigit() for c in token) else 0
    flags |= _PLAIN if rest.replace("-", "").replace("'", "").isalnum() and not flags & (_UPPER | _SYMBOL) else 0
    return flags | _bucket(" ".join(shape))


class Tokens:
    """Numbers of tokens: each distinct one is looked at once, and forgotten with all others when there are `most`."""

    def __init__(self, most: int = CACHED_WORDS // 2) -> None:
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.index, self.lower = _Numbered(), _Numbered()
        self.number, self.name = np.empty(0, np.int64), np.empty(0, np.int64)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, names, sizes): of the tokens between white space, text behind text, and how many each text has.

        A name is the number of a token's lower-case form, good for comparisons within these texts.
        """
        alone(self)
        if len(self.index) >= self.most:  # common tokens come back at once; a dictionary that grows without end would be slow and large
            self.forget()
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if new := self.index.taken():
            self.number = np.concatenate((self.number, np.fromiter(map(_token, new), np.int64, len(new))))
            self.name = np.concatenate((self.name, np.fromiter(map(self.lower.__getitem__, map(str.lower, new)), np.int64, len(new))))
            self.lower.taken()
        return self.number[at], self.name[at], sizes


class _Numbered(dict):
    """Numbers its keys as they come."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        self.new.append(key)
        return value

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Measured:
    """What the labellers and the scorer need of some texts, counted in flat arrays of all their tokens."""

    def __init__(self, tokens: Tokens, texts: list[str]) -> None:
        number, name, self.n = tokens.read(texts)
        k = len(texts)
        self.of = of = np.repeat(np.arange(k), self.n)
        self.per = np.maximum(1, self.n)
        self.shape = number & 0xFFFFFFFF
        flagged = lambda flag: np.bincount(of[(number & flag) != 0], minlength=k) / self.per
        self.share = {flag: flagged(flag) for flag in (_UPPER, _SYMBOL, _END, _SHORT, _BAR, _PLAIN)}
        self.again = [np.bincount(of[d:][(name[d:] == name[:-d]) & (of[d:] == of[:-d])], minlength=k) / self.per for d in (1, 2, 3)]
        self.distinct = _distinct(of << 32 | name, 32, k)
        self.shapes = _distinct(of * BUCKETS + self.shape, BUCKETS.bit_length() - 1, k)

    def votes(self) -> np.ndarray:
        """The labellers' votes on each text: a digit of base three each, 0 for bad, 1 for none, 2 for good."""
        n, share = self.n, self.share

        def between(x: np.ndarray, bad_low: float, low: float, high: float, bad_high: float, least: int = 0) -> np.ndarray:
            return np.where(n < least, 1, np.where((low <= x) & (x <= high), 2, np.where((x < bad_low) | (x > bad_high), 0, 1)))

        distinct = self.distinct / self.per * np.maximum(1.0, np.sqrt(n / 200))  # the larger a text, the more its words recur
        cast = (
            between(self.again[0], 0, 0, 0.05, 0.2),
            between(share[_UPPER], 0, 0, 0.15, 0.5),
            between(share[_SYMBOL], 0, 0, 0.05, 0.25),
            between(distinct, 0.2, 0.35, 9e9, 9e9),
            between(share[_END], 0.005, 0.02, 0.5, 0.8, 30),
            between(share[_SHORT], 0.03, 0.1, 0.8, 0.95, 30),
            between(share[_BAR], 0, 0, 0.05, 0.2),
            between(share[_PLAIN], 0.6, 0.85, 1, 1),
            between(self.shapes / np.log2(np.maximum(2, n)), 0.3, 0.6, 6, 12, 20),
        )
        return np.where(n < 8, (3**LABELLERS - 1) // 2, sum(v * 3**k for k, v in enumerate(cast)))

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, buckets, values): shares of shapes and pairs of shapes by the square root, in the order of texts and buckets, then repeats of words."""
        of, shape = self.of, self.shape
        same = of[1:] == of[:-1]
        pair = (shape[1:] * 40503 + shape[:-1] * 30011 + 7)[same] % BUCKETS
        key = np.sort(_small(np.concatenate((of * BUCKETS + shape, of[1:][same] * BUCKETS + pair))))
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        many = np.diff(np.append(first, len(key)))
        text, at = np.divmod(key[first].astype(np.int64), BUCKETS)
        some = np.flatnonzero(self.n)
        extra = np.stack([*self.again, self.distinct / self.per])[:, some]
        return np.concatenate((text, np.tile(some, 4))), np.concatenate((at, np.repeat(BUCKETS + np.arange(4), len(some)))), np.concatenate((np.sqrt(many / self.per[text]), extra.ravel()))

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """The probability of good quality of each text, about 0 for one without tokens."""
        texts, at, value = self.features()
        z = np.bincount(texts, weights[at] * value, len(self.n)) + bias
        return 1 / (1 + np.exp(-np.clip(np.where(self.n > 0, z, -50.0), -50, 50)))


def _small(key: np.ndarray) -> np.ndarray:
    return key.astype(np.int32) if len(key) and key.max() < 1 << 31 else key


def _distinct(key: np.ndarray, bits: int, k: int) -> np.ndarray:
    """How many distinct keys each of k texts has; a text's number stands above `bits`."""
    key = np.sort(_small(key))
    return np.bincount((key[np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))] >> bits).astype(np.int64), minlength=k)


_TOKENS = Tokens()


def posteriors(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """(probability of good by pattern of votes, accuracy of each labeller when it votes), by expectation-maximisation.

    Good documents are one class; bad ones are bad in several ways, of which each labeller sees some, so there is a bad class
    for each labeller. Within a class the labellers vote independently, each with its own rates of each vote. It starts with
    the patterns without a bad vote as good, and each other pattern shared among the classes of the labellers that vote bad.
    """
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    digit = patterns[:, None] // 3 ** np.arange(LABELLERS) % 3
    one = np.eye(3)[digit] * [1, 0, 1]  # pattern, labeller, vote; no vote tells nothing
    bad = (digit == 0).astype(float)
    member = np.concatenate(((bad.sum(1, keepdims=True) == 0) + 0.05, bad), 1)  # a class a column
    member /= member.sum(1, keepdims=True)
    for _ in range(rounds):
        weight = n[:, None] * member
        cast = np.einsum("pc,plv->clv", weight, one) + [0.5, 0, 0.5]
        rate = np.log((cast + [0, 1, 0]) / cast.sum(2, keepdims=True))
        log = np.einsum("clv,plv->pc", rate, one) + np.log((weight.sum(0) + 0.5) / (n.sum() + 5))
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved, member = np.abs(new - member).max(), new
        if moved < 1e-9:
            break
    good = member[:, 0]
    right = ((digit == 2) * good[:, None] + bad * (1 - good)[:, None]) * n[:, None]
    accuracy = right.sum(0) / np.maximum(1e-9, ((digit != 1) * n[:, None]).sum(0))
    return dict(zip(patterns.tolist(), good.tolist())), accuracy


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in over_texts(batches):
        pattern, n = np.unique(Measured(_TOKENS, [t or "" for t in texts]).votes(), return_counts=True)
        yield table({"pattern": pattern, "n": n}, _VOTED)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in over_texts(batches, "key"):
        measured = Measured(_TOKENS, texts)
        of, at, value = measured.features()
        order = np.argsort(of, kind="stable")
        size = pa.array(np.concatenate(([0], np.bincount(of, minlength=len(texts)).cumsum())).astype(np.int32))
        columns = [pa.array(keys, pa.int64()), pa.array(measured.votes()), pa.ListArray.from_arrays(size, pa.array(at[order].astype(np.int32))), pa.ListArray.from_arrays(size, pa.array(value[order].astype(np.float32)))]
        yield pa.RecordBatch.from_arrays(columns, schema=_LEARN)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic scorer of sparse rows for targets between 0 and 1, both classes weighing the same."""
    weights, bias, seen = np.zeros(BUCKETS + 4), 0.0, np.full(BUCKETS + 4, 1e-8)
    share = np.clip(target.mean(), 0.02, 0.98) if len(target) else 0.5
    weigh = target * 0.5 / share + (1 - target) * 0.5 / (1 - share)
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(float)
    size = np.array([len(r[0]) for r in rows])
    of = np.repeat(np.arange(len(rows)), size)
    for _ in range(rounds):
        z = np.bincount(of, weights[at] * value, len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * weigh
        slope = np.bincount(at, error[of] * value, BUCKETS + 4) / len(rows) + decay * weights
        seen += slope * slope
        weights -= rate * slope / np.sqrt(seen)
        bias -= rate * error.mean()
    return weights, bias


def _scorer(shared):
    """A column function of text: its score."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = shared.value
        for texts in batches:
            parts = [Measured(_TOKENS, some).scores(weights, bias) for some in _pieces(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def _pieces(texts: pa.Array, chars: int = PIECE) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def model(docs: DataFrame, trained: int = TRAINED) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, accuracies of the labellers), learned from the texts alone.

    Every row with a text is voted on, and the accuracies come from the votes on all. The scorer is fitted on about
    `trained` distinct texts at most, those of the least hashes, with their posteriors as targets; equal texts are one there, however many
    rows have them. Null texts take no part. A table without texts gives a scorer of zeros.
    """
    use = docs.where(F.col("text").isNotNull())
    voted = use.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_vote, "pattern long, n long")
    counts = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}  # 3 ** LABELLERS rows at most
    total = sum(counts.values())
    if not total:
        return np.zeros(BUCKETS + 4), 0.0, np.full(LABELLERS, 0.5)
    good, accuracy = posteriors(counts)
    part = min(1.0, trained / total)
    chosen = use.select(F.xxhash64("text").alias("key"), "text").where(F.pmod("key", F.lit(1 << 30)) < part * (1 << 30))
    sample = chosen.groupBy("key").agg(F.min("text").alias("text"))
    rows = sorted(sample.mapInArrow(_learn, "key long, pattern long, at array<int>, value array<float>").collect(), key=lambda r: r["key"])
    if not rows:
        return np.zeros(BUCKETS + 4), 0.0, accuracy
    target = np.array([good.get(r["pattern"], 0.5) for r in rows])
    weights, bias = fit([(np.array(r["at"], np.int64), np.array(r["value"], np.float32)) for r in rows], target)
    return weights, bias, accuracy


def _shared(docs: DataFrame, trained: int):
    return docs.sparkSession.sparkContext.broadcast(model(docs, trained)[:2])  # of a size given by BUCKETS


def scores(docs: DataFrame, trained: int = TRAINED) -> DataFrame:
    """(doc_id, score) of every row of docs, the score being the probability of good quality.

    docs has doc_id and text; other columns are ignored. Whole texts are scored. Null and empty texts score about 0. Each row is scored by
    itself, also those with a null or repeated doc_id; equal texts score alike. An empty table gives no rows.
    """
    shared = _shared(docs, trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in over_texts(batches):
            yield table({"doc_id": ids, "score": Measured(_TOKENS, [t or "" for t in texts]).scores(*shared.value)}, _SCORED)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, threshold: float = THRESHOLD, trained: int = TRAINED) -> DataFrame:
    """The rows of `docs` whose texts score `threshold` at least, with all columns.

    Each row stays or goes by its own text, whatever its doc_id, without a shuffle. Null and empty texts score about 0 and go; very long ones are scored whole; equal
    texts stay or go together. Other columns, of whatever names, pass. An empty table stays empty.
    """
    return docs.where(_scorer(_shared(docs, trained))(docs["text"]) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents")).where(F.col("score") >= THRESHOLD)

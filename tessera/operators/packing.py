"""Token lists as blocks and windows for language models, and losses over them."""

import base64
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100
#: Tokens that leave a Python worker at once, which bounds its memory and changes no result.
SENT = 500_000
#: A public vocabulary, and how text is cut before its merges.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def packed(docs: DataFrame, seq_len: int, eos: int, batch_rows: int = 1000) -> DataFrame:
    """(batch, block, input_ids) of docs (rn, ids), rn being the row's number from 1.

    Of each `batch_rows` rows the non-empty lists, each with eos behind it, are joined and cut to full blocks; what is left over goes.
    """
    use = docs.select(F.floor((F.col("rn") - 1) / batch_rows).cast("long").alias("batch"), "rn", "ids").where(F.size("ids") > 0).withColumn("ids", F.concat("ids", F.array(F.lit(eos))))
    by = Window.partitionBy("batch").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    placed = use.withColumn("at", F.coalesce(F.sum(F.size("ids")).over(by), F.lit(0)).cast("int"))
    # each list is cut where blocks begin, so that a block is made of slices
    first, last = F.floor(F.col("at") / seq_len).cast("int"), F.floor((F.col("at") + F.size("ids") - 1) / seq_len).cast("int")
    cut = placed.select("batch", "at", "ids", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.lit(0), F.col("block") * seq_len - F.col("at"))
    hi = F.least(F.size("ids"), (F.col("block") + 1) * seq_len - F.col("at"))
    parts = cut.select("batch", "block", "at", F.slice("ids", lo + 1, hi - lo).alias("part"))
    blocks = parts.groupBy("batch", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("input_ids"))
    return blocks.where(F.size("input_ids") == seq_len).select("batch", F.col("block").cast("long").alias("block"), "input_ids")


def windows(docs: DataFrame, seq_len: int, stride: int, drop_first: bool = False) -> DataFrame:
    """(doc_id, start, input_ids, n_pred) of docs (doc_id, ids): a window each `stride` tokens, of which the last n_pred are scored."""
    n = F.size("ids")
    each = docs.where(n >= 2).select("doc_id", "ids", F.explode(F.sequence(F.lit(0), n - 2, F.lit(stride))).alias("start"))
    ids = F.slice("ids", F.col("start") + 1, seq_len)
    pred = F.least(F.lit(stride), F.size(ids) - 1)
    return each.select("doc_id", F.col("start").cast("long").alias("start"), ids.alias("input_ids"), (F.when(F.col("start") == 0, 0).otherwise(pred) if drop_first else pred).cast("long").alias("n_pred"))


def collated(ids: Column, n_pred: Column, seq_len: int, pad: int) -> Column:
    """A window filled up: ids with padding, labels outside the scored tail ignored, and the mask."""
    gap = F.lit(seq_len) - F.size(ids)
    at = F.size(ids) - n_pred
    labels = F.transform(ids, lambda x, i: F.when(i >= at, x).otherwise(IGNORED))
    return F.struct(
        F.concat(ids, F.array_repeat(F.lit(pad), gap)).alias("input_ids"), F.concat(labels, F.array_repeat(F.lit(IGNORED), gap)).alias("labels"),
        F.concat(F.transform(ids, lambda x: F.lit(1)), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
    )


def perplexity(loss: Column, n: Column) -> Column:
    """exp of the mean loss weighted by tokens; NaN without any."""
    total = F.sum(n)
    return F.when(total > 0, F.exp(F.sum(loss * n) / F.nullif(total, F.lit(0)))).otherwise(F.lit(float("nan")))


def in_vocabulary(docs: DataFrame, size: int) -> DataFrame:
    """One row: the least and greatest token id; an id beyond the vocabulary raises."""
    out = docs.agg(F.min(F.array_min("ids")).alias("min_id"), F.max(F.array_max("ids")).alias("max_id"))
    bad = (F.col("min_id") < 0) | (F.col("max_id") >= size)
    return out.select(F.when(bad, F.raise_error(F.lit("token id beyond the vocabulary"))).otherwise(F.col("min_id")).alias("min_id"), "max_id")


def left_truncated(ids: Column, most: int) -> Column:
    """The last `most` - 1 tokens."""
    return F.when(F.size(ids) >= most, F.slice(ids, -(most - 1), most - 1)).otherwise(ids)


def cost(n_tokens: Column, price: float) -> Column:
    """What so many tokens cost at a price for a million, a quarter of them being charged."""
    return n_tokens / 4.0 / 1_000_000 * price


def steps(rows: int, batch: int, accumulate: int, epochs: float, eval_steps: int, saves: int) -> tuple[int, int]:
    """(steps in all, steps between saves), the latter a multiple of eval_steps."""
    total = max(1, math.ceil(math.ceil(rows / (batch * accumulate)) * epochs))
    return total, max(1, math.ceil(total / max(1, saves) / eval_steps)) * eval_steps


def step_columns(rows: Column, batch: int, accumulate: int, epochs: float, eval_steps: int, saves: int) -> tuple[Column, Column]:
    """steps() of a column of row counts."""
    total = F.greatest(F.lit(1), F.ceil(F.ceil(rows / (batch * accumulate)) * epochs)).cast("long")
    return total, (F.greatest(F.lit(1), F.ceil(total / max(1, saves) / eval_steps)) * eval_steps).cast("long")


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            keys, texts, first, ids, size = batch.column("doc_id"), batch.column("text"), 0, [], 0
            for at in range(batch.num_rows):
                t = texts[at].as_py()
                ids.append(None if t is None else np.array(encoding.encode_ordinary(t), np.int32))  # a list would take nine times as much
                size += 0 if t is None else ids[-1].size
                if size >= SENT or at == batch.num_rows - 1:
                    n = pa.array([None if x is None else x.size for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([keys.slice(first, len(ids)), n, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "token_ids"])
                    first, ids, size = at + 1, [], 0

    return run


def tokenised(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids): byte-pair tokens of each text by a vocabulary of base64 tokens and ids; null for a null text."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(path), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, token_ids array<int>")

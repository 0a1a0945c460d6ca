"""The corpus pipeline: documents that pass the quality classifier lose shared lines, near copies and test passages, and are encoded.

STAGES are applied one after another; each result is written as Parquet and read again as the next one's docs. All but
the last keep the columns of documents.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, linededup, minhash, quality
from tessera.llm.common import read, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose texts the quality classifier accepts, with all columns.

    Every row is judged by its own text: null and empty texts go, very long ones are read whole, equal texts stay or go
    together, a null or repeated doc_id plays no part. Other columns pass. An empty table stays empty.
    """
    return quality.accepted(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that many sites share; n_chars is counted anew where lines went.

    Null and empty texts, and texts of shared lines alone, stay as they are; lines and texts of any length count; a null
    source is no site; equal texts lose the same lines. Other columns pass. An empty table stays empty.
    """
    return linededup.without_boilerplate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least doc_id.

    Rows with a null doc_id stay; null and empty texts, and those without words, are no copies; long texts are compared whole. Of
    repeated rows of one doc_id the one with the least text stays. Other columns pass. An empty table stays empty.
    """
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose texts hold no passage of the benchmark.

    Every row is judged by its own text: null and empty texts stay, very long ones are searched whole, equal texts stay or
    go together. Other columns pass. An empty table, or an empty benchmark, changes nothing.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decodes) of each row.

    A null text has null token_ids and 0 tokens, an empty one an empty list; texts of any length are encoded whole, equal
    ones alike; null and repeated doc_ids keep their rows. Other columns go. An empty table gives no rows.
    """
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("encode", encode),
]

#: SQL can express neither the classifier nor the merge loop; the tests compare the pipeline with its parts and with brute force.
ORACLE_SQL = None


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of documents.

    Each stage is written to the session's checkpoint folder; what a stage has read goes when it is written itself. The
    table that the last one reads stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, behind = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(here := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(here)
            if behind:
                _removed(spark, behind)
            behind = here
    return docs

"""Trees of topics, subtopics and questions: expansion, flattening, and what is still to do."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip

#: The nested column that the operators here take.
TREE = "array<struct<title: string, questions: array<string>>>"


def custom_id(topic: Column, sub: Column, question: Column) -> Column:
    """topic0000-sub000-q000."""
    return F.format_string("topic%04d-sub%03d-q%03d", topic, sub, question)


def flattened(topics: DataFrame) -> DataFrame:
    """(custom_id, topic, subtopic, question) of topics (idx, topic, subtopics), counted from 0.

    Subtopics and questions count where they stand, also those behind a subtopic without questions, which gives no rows. Titles are trimmed.
    """
    subs = topics.select(F.col("idx").cast("int").alias("idx"), "topic", F.posexplode("subtopics").alias("s", "sub"))
    each = subs.select("idx", "topic", "s", strip(F.col("sub.title")).alias("subtopic"), F.posexplode("sub.questions").alias("q", "question"))
    return each.select(custom_id(F.col("idx"), F.col("s"), F.col("q")).alias("custom_id"), strip(F.col("topic")).alias("topic"), "subtopic", "question")


def expanded(items: Column, n: int, trimmed: Callable[[Column], Column] = strip) -> Column:
    """The first n of a list's distinct entries, trimmed, without blank ones, compared without case; null if there are fewer."""
    plain = F.filter(F.transform(items, lambda x: trimmed(x)), lambda x: x != "")
    lowered = F.transform(plain, F.lower)
    first = F.filter(plain, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.when(F.size(first) >= n, F.slice(first, 1, n))


def zipped(titles: Column, questions: Column) -> Column:
    """array<struct<title, questions>> of two lists by place; lists of different lengths raise."""
    return F.when(F.size(titles) == F.size(questions), F.arrays_zip(titles.alias("title"), questions.alias("questions"))).otherwise(F.raise_error(F.lit("lists of different lengths")))


def ranked(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """`records` (topic, ...) with `pos` from seeds (topic, pos), to be ordered by (pos, topic): topics that aren't seeds come last."""
    return records.join(seeds.select("topic", F.col("pos").cast("double").alias("pos")), "topic", "left").withColumn("pos", F.coalesce("pos", F.lit(float("inf"))))


def failures(rows: DataFrame, by: str, message: str) -> DataFrame:
    """(by, n_failed, first): how many messages each group has, and the first three of them by order. No group is collected but for these."""
    found = rows.where(F.col(message).isNotNull()).select(F.col(by), F.col(message).alias("said"))
    top = found.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("said"))).where("place <= 3")
    first = top.groupBy(by).agg(F.array_sort(F.collect_list("said")).alias("first"))
    return found.groupBy(by).agg(F.count("*").alias("n_failed")).join(first, by)

"""Files from tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.folders import checkpointed


def save(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; what is there already is an error, or replaced."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def save_splits(splits: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """Named splits as folders of one table."""
    for name, df in splits.items():
        save(df, f"{path}/split={name}", overwrite)


def save_text(df: DataFrame, column: str, path: str) -> None:
    """One column, as `text`."""
    df.select(F.col(column).alias("text")).write.mode("overwrite").parquet(path)


def format_pairs(pairs):
    """[[a, b], …] as lines "a -> b"."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p[0], F.lit(" -> "), p[1])), "\n")


def save_csv(df: DataFrame, path: str, pairs: str = "corrections") -> None:
    """A sheet with a header, correction pairs as lines of one cell."""
    out = df.withColumn(pairs, format_pairs(F.col(pairs))) if pairs in df.columns else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One record a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append" if append else "overwrite").text(path)


def numbered(df: DataFrame, *order) -> DataFrame:
    """`df` with `rn`, the row's number from 1 in the order of the given columns.

    Rows are spread by ranges of the order, counted within their range, and moved by the counts of the ranges before: one shuffle, and no
    task sees more than a range. Equal rows of the order are numbered in any order.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = checkpointed(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    placed = ranged.withColumn("__range", F.shiftright("__at", 33))  # the id is the partition above 33 bits of the row's place in it
    counts = placed.groupBy("__range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("__range", before.alias("__before")))  # a row a partition
    place = F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.join(starts, "__range").withColumn("rn", place + F.col("__before") + 1).drop("__at", "__range", "__before")


def shard_numbers(df: DataFrame, size: int, *order) -> DataFrame:
    """`df` with `shard`, consecutive shards of `size` rows from 1."""
    return numbered(df, *order).withColumn("shard", (F.floor((F.col("rn") - 1) / size) + 1).cast("long"))


def save_shards(df: DataFrame, path: str, size: int, *order) -> None:
    """JSONL in folders shard=k of `size` rows each."""
    out = shard_numbers(df, size, *order)
    out.select("shard", F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").partitionBy("shard").text(path)


def save_document(df: DataFrame, path: str, *order) -> None:
    """One small JSON file: a list of the records in order, indented, null fields left out."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.select(F.struct(*df.columns).alias("record"), F.row_number().over(Window.orderBy(*by)).alias("rn"))  # small, as its reader holds it whole
    listed = placed.agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "record"))), lambda x: x["record"]).alias("all"))
    listed.select(F.to_json("all", {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_run(details: DataFrame, summary: DataFrame, path: str) -> None:
    """The results of one run: `details.jsonl`, a record a line, and `summary.json`, one record."""
    save_jsonl(details, f"{path}/details.jsonl")
    summary.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary.json")

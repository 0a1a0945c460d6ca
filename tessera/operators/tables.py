"""Joins that treat a missing match in different ways, set operations, ordered deduplication, samples and shards."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip


def without_texts(df: DataFrame, other: DataFrame, trimmed: bool = False) -> DataFrame:
    """Rows whose text is not among the other table's; `trimmed` compares without outer white space, and drops nulls."""
    key = (lambda c: strip(c)) if trimmed else (lambda c: c)
    gone = other.select(key(F.col("text")).alias("__gone")).where("__gone is not null").distinct()
    out = df.join(gone, key(df["text"]) == F.col("__gone"), "left_anti")
    return out.where("text is not null") if trimmed else out


def without_ids(df: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """Rows whose id is in none of the sources, each a table of one column."""
    seen = None
    for source in sources:
        ids = source.toDF("__id")
        seen = ids if seen is None else seen.unionByName(ids)
    return df.join(seen.where("__id is not null").distinct(), df[key] == F.col("__id"), "left_anti")


def looked_up(df: DataFrame, table: DataFrame, key: str, value: str, on_miss: str = "drop") -> DataFrame:
    """`df` with the table's value by key. A miss drops the row, keeps df's own value, gives null, or raises."""
    if on_miss == "drop":
        return df.join(table.select(key, value), key)
    found = df.join(table.select(key, F.col(value).alias("__found"), F.lit(True).alias("__hit")), key, "left")
    if on_miss == "keep":
        new = F.coalesce("__found", value)
    elif on_miss == "null":
        new = F.col("__found")
    else:
        new = F.when(F.col("__hit"), F.col("__found")).otherwise(F.raise_error(F.concat(F.lit(f"no {value} for "), F.col(key).cast("string"))))
    return found.withColumn(value, new).drop("__found", "__hit")


def by_long_text(df: DataFrame, table: DataFrame, text: str, value: str, order: str) -> DataFrame:
    """`df` with the value of the table's last row (by `order`) of the same long text; the texts meet by hash first."""
    last = table.groupBy(text).agg(F.max_by(value, order).alias(value)).withColumn("__hash", F.xxhash64(text)).withColumnRenamed(text, "__text")
    return df.withColumn("__hash", F.xxhash64(text)).join(last, "__hash").where(F.col(text) == F.col("__text")).drop("__hash", "__text")


def patched(df: DataFrame, array: str, patches: DataFrame, key: str) -> DataFrame:
    """`df` with elements of an array of strings replaced where they are "-" by patches (key, idx, new); indices beyond the array do nothing."""
    once = patches.groupBy(key, "idx").agg(F.max("new").alias("new"))  # of several for one place the greatest
    grouped = once.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("idx", "new")))).alias("__new"))
    found = df.join(grouped, key, "left")
    new = F.transform(array, lambda x, i: F.when(x == "-", F.coalesce(F.try_element_at("__new", i), x)).otherwise(x))
    return found.withColumn(array, F.when(F.col("__new").isNull(), F.col(array)).otherwise(new)).drop("__new")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last, with `first_seen`, the order of the first."""
    rest = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__last"), F.min(order).alias("first_seen"))
    return out.select(key, "__last.*", "first_seen")


def first_distinct(df: DataFrame, column: str, order: str, fold_case: bool = True) -> DataFrame:
    """(pos, column): the first of equal entries, trimmed, without blank ones."""
    plain = strip(F.col(column))
    key = F.lower(plain) if fold_case else plain
    return df.select(F.col(order).alias("pos"), plain.alias(column), key.alias("__key")).where(F.col("__key") != "").groupBy("__key").agg(F.min(F.struct("pos", column)).alias("m")).select("m.*")


def shuffle_key(key: Column, seed: int = 42) -> Column:
    """What a table is ordered by to shuffle it, the same on every run and in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in an order: a top-n, not a sort."""
    return df.orderBy(*order).limit(n)


def held_out(df: DataFrame, n: int, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(validation, training): n shuffled rows, and all rows whose trimmed text none of them has."""
    valid = head(df, n, shuffle_key(F.col(key), seed), F.col(key))
    return valid, without_texts(df, valid, trimmed=True)


def top_k(scores: Column, k: int) -> Column:
    """The k greatest of an array of structs, the greatest first."""
    return F.slice(F.reverse(F.array_sort(scores)), 1, k)


def row_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows there are, and how many meet each condition, in one pass."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def each_row_once(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def chat(asked: Column, told: Column) -> Column:
    """A turn of each side in one string, between tags of the roles."""
    said = [F.concat(F.lit(f"<{role}>\n"), text, F.lit(f"\n</{role}>")) for role, text in (("user", asked), ("assistant", told))]
    return F.concat_ws("\n", *said)

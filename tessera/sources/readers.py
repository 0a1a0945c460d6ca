"""Tables from files. Bad inputs are skipped or raise, as each reader says."""

import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import first_present, is_blank, strip, valid_content

#: Columns that may hold a table's text, the most wanted first.
PREFERRED = ("ban", "cbn", "id", "jv", "content")
#: Entries of a lexicon's file that leave a Python worker at once.
ENTRIES = 10_000


def text_only(df: DataFrame, preferred: Iterable[str] = PREFERRED, strict: bool = True) -> DataFrame:
    """One column `text`. Without a column to take, an error, or the table as it is if not strict."""
    name = first_present(df.columns, preferred)
    if name is None:
        if strict:
            raise ValueError(f"no text column among {df.columns}")
        return df
    return df.select(F.col(name).alias("text"))


def nonblank(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(column)))


def collapse_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits as one table, in the order of their names."""
    parts = [splits[k] for k in sorted(splits)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_corpora(spark: SparkSession, paths: Iterable[str], preferred: Iterable[str] = PREFERRED) -> DataFrame:
    """The texts of several Parquet tables. Those that are missing or can't be read are left out; none at all is an error."""
    parts = []
    for path in paths:
        try:
            parts.append(nonblank(text_only(spark.read.parquet(path), preferred)))
        except (AnalysisException, ValueError) as why:
            print(f"left out {path}: {str(why).splitlines()[0]}")
    if not parts:
        raise ValueError("no table could be read")
    return collapse_splits({f"{k:06d}": p for k, p in enumerate(parts)})


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, the first column being an index; rows with any null go, all else is text."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.drop(df.columns[0]).dropna("any")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A sheet with a header, whose cells may hold line breaks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON."""
    reader = spark.read.option("multiLine", True)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One record a line, blank lines aside. A bad line raises with its file (bad_lines() gives its number), or is skipped if not strict."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(~is_blank(F.col("value")))
    parsed = raw.withColumn("ok", F.try_parse_json("value").isNotNull())
    if strict:
        fail = F.raise_error(F.concat(F.lit("bad JSON in "), F.col("file"), F.lit(", see bad_lines(): "), F.substr("value", F.lit(1), F.lit(200))))
        parsed = parsed.withColumn("value", F.when(F.col("ok"), F.col("value")).otherwise(fail))
    else:
        parsed = parsed.where("ok")
    return parsed.select(F.from_json("value", schema).alias("r")).select("r.*")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that are no JSON, counted from 1. A file is read by one task, so this is for finding what read_jsonl() raised."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    return whole.where(~is_blank(F.col("value")) & F.try_parse_json("value").isNull()).select("file", (F.col("pos") + 1).cast("long").alias("line"), "value")


def read_ids(spark: SparkSession, path: str, field: str = "custom_id") -> DataFrame:
    """The string ids in a JSONL file; bad lines and other ids are skipped."""
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant(F.variant_get("v", f"$.{field}", "variant"))
    return raw.where(kind == "STRING").select(F.try_variant_get("v", f"$.{field}", "string").alias("id")).distinct()


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of a file with one a line, in lower case."""
    return spark.read.text(path).select(F.lower(strip(F.col("value"))).alias("word")).where("word <> ''").distinct()


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): the distinct lines of a small file in the order in which they first stand there, case being kept."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line")).select("pos", strip(F.col("line")).alias("line"))
    return text.where("line <> ''").groupBy("line").agg(F.min("pos").alias("pos")).select("pos", "line").orderBy("pos")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(text, title) of the .txt files below a folder that look like content; folders with `dict` in their path are skipped."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    found = raw.select(strip(F.col("value")).alias("text"), F.regexp_extract(name, r"([^/]*)\.txt$", 1).alias("title"), F.regexp_extract(name, r"^(.*)/[^/]*$", 1).alias("folder"))
    return found.where(~F.contains("folder", F.lit("dict")) & valid_content(F.col("text"))).select("text", "title")


def _object_entries(whole: str) -> Iterator[tuple[str, object]]:
    """The keys and values of a JSON object one by one in their order, numbers as None; ValueError where it is none."""

    def refused(name: str) -> None:
        raise ValueError(f"{name} is no JSON")

    decoder = json.JSONDecoder(parse_int=lambda x: None, parse_float=lambda x: None, parse_constant=refused)
    skip = re.compile(r"[ \t\n\r]*").match

    def behind(sign: str, at: int) -> int:
        if whole[at : at + 1] not in sign or at >= len(whole):
            raise ValueError(f"no {sign} at {at}")
        return skip(whole, at + 1).end()

    at = behind("{", skip(whole, 0).end())
    more = whole[at : at + 1] != "}"
    while more:
        if whole[at : at + 1] != '"':
            raise ValueError(f"no key at {at}")
        key, at = decoder.raw_decode(whole, at)
        at = behind(":", skip(whole, at).end())
        try:
            value, at = decoder.raw_decode(whole, at)
        except RecursionError:
            raise ValueError(f"too deep at {at}") from None
        yield key, value
        at = skip(whole, at).end()
        more = whole[at : at + 1] != "}"
        if more:
            at = behind(",", at)
    if behind("}", at) != len(whole):
        raise ValueError("more than an object")


def _lexicon_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, key, translations) of the JSON objects in files. What is no object gives none.

    The entries leave a file one by one: as variants each would carry the names of all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda x: x.encode("utf-8", "replace").decode()  # noqa: E731 - halves of surrogate pairs
        for batch in batches:
            for file, value in zip(*batch.columns):
                try:
                    whole = value.as_py()
                    for _ in _object_entries(whole):
                        pass
                except ValueError:
                    continue
                entries = enumerate(_object_entries(whole))
                while some := list(islice(entries, ENTRIES)):
                    listed = [[plain(x) for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)] for _, (_, v) in some]
                    columns = [file.as_py()] * len(some), [i for i, _ in some], [plain(k) for _, (k, _) in some], listed
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())))], ["file", "pos", "key", "translations"])

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.mapInArrow(run, "file string, pos long, key string, translations array<string>")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, translations) of a JSON object from words to a string or list of strings, all in lower case. What is neither has no translations; of words that differ in case only the last stays. A file that is no object gives none."""
    pairs = _lexicon_entries(spark, path).select(F.struct("file", "pos").alias("at"), F.lower("key").alias("word"), F.transform("translations", lambda x: F.lower(x)).alias("translations"))
    return pairs.groupBy("word").agg(F.max_by("translations", "at").alias("translations"))


def read_lexicon_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): the keys of a JSON object in lower case; a file that is missing or no object gives none."""
    try:
        return _lexicon_entries(spark, path).select(F.lower("key").alias("word")).distinct()
    except AnalysisException:
        return spark.createDataFrame([], "word string")


def shards(spark: SparkSession, folder: str, prefix: str, suffix: str = ".jsonl") -> list[str]:
    """The files of a folder, on whatever file system, with the prefix and suffix, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found]
    return [f"{folder.rstrip('/')}/{n}" for n in sorted(names) if n.startswith(prefix) and n.endswith(suffix)]


def resolve(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(entry, path): for each entry the file of that very name, else the first by path whose name starts with it.

    Files stand under each beginning of their names, so that both kinds meet by equality.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    begun = files.select("path", name.alias("name")).select("path", "name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substr("name", F.lit(1), n))).alias("entry"))
    met = entries.join(begun, "entry")
    return met.groupBy("entry").agg(F.min(F.struct((F.col("name") != F.col("entry")).alias("o"), "path")).alias("m")).select("entry", "m.path")

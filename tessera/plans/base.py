"""The register of named queries, and what they share."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Pieces of SQL: the words, and the tokens between white space, of an expression.
SQL_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
SQL_TOKENS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda tk: tk <> '')"
#: Documents of a language that a word of its lexicon stands in, at least.
LEAST_DOCS = 20


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) by its name, with the SQL of the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_words(text: str) -> str:
    return SQL_WORDS.format(text)


def sql_tokens(text: str) -> str:
    return SQL_TOKENS.format(text)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, src, ref): a user's turn and the assistant's next one."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return asked.join(told, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "src", "ref")


SQL_PAIRS = """pairs AS (
  SELECT concat_ws('-', u.conv_id, u.turn) AS pair_id, u.text AS src, a.text AS ref
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""
SQL_LEXICON = f"""lexicon AS (
  SELECT lang, word, count(*) AS df
  FROM (SELECT lang, unnest(list_distinct({sql_words("text")})) AS word FROM documents)
  GROUP BY lang, word HAVING count(*) >= {LEAST_DOCS}
)"""
#: Words of French paired with German ones by rank.
SQL_PAIRED = """ranked AS (
  SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY df DESC, word) AS r FROM lexicon WHERE lang IN ('fr', 'de')
), paired AS (
  SELECT s.word, list(t.word ORDER BY t.r) AS translations
  FROM ranked s JOIN ranked t ON t.lang = 'de' AND t.r IN (s.r, s.r + 1) WHERE s.lang = 'fr' GROUP BY s.word
)"""


def token_id(word: Column) -> Column:
    """A number below 2^28 for a word, the same in every engine; it stands in for a tokenizer's id."""
    return F.conv(F.substr(F.md5(word), F.lit(1), F.lit(7)), 16, 10).cast("int")


def token_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, ids): the numbers of a document's words."""
    return docs.select("doc_id", F.transform(F.coalesce(words(F.col("text")), F.array().cast("array<string>")), token_id).alias("ids"))


SQL_IDS = f"""ids AS (
  SELECT doc_id, list_transform(coalesce({sql_words("text")}, []), lambda w: CAST('0x' || substr(md5(w), 1, 7) AS BIGINT)) AS ids FROM documents
)"""

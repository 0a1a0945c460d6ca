"""Queries that pick rows: predicates on texts, language filters, samples, shards."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import has_any, tokens, valid_content
from tessera.operators import lid
from tessera.operators.tables import head, held_out, row_counts, shuffle_key, top_k, without_texts
from tessera.plans.base import query, sql_tokens, sql_words, table, turn_pairs, SQL_PAIRS
from tessera.sources.readers import collapse_splits, nonblank, text_only
from tessera.sources.writers import numbered, shard_numbers

#: Parts of words that a text may not hold, and the size of the validation split.
BANNED, HELD_OUT = ("avec", "ierung", "cion ", "lytion"), 500


@query(r"SELECT doc_id, lang, source, n_chars FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\S')")
def q_nonblank_text(spark: SparkSession, d: str) -> DataFrame:
    return nonblank(table(spark, d, "documents")).select("doc_id", "lang", "source", "n_chars")


@query("SELECT text FROM benchmark")
def q_text_only(spark: SparkSession, d: str) -> DataFrame:
    return text_only(table(spark, d, "benchmark").withColumnRenamed("text", "content"))


@query(f"SELECT doc_id, len({sql_tokens('text')}) AS n_words FROM documents WHERE len({sql_tokens('text')}) BETWEEN 10 AND 2000")
def q_word_count_range(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(tokens(F.col("text")))
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", n.cast("long").alias("n_words")).where("n_words between 10 and 2000")


@query(f"WITH {SQL_PAIRS} SELECT pair_id FROM pairs WHERE len({sql_tokens('src')}) BETWEEN 20 AND 50 AND len({sql_tokens('ref')}) BETWEEN 20 AND 50")
def q_pair_word_range(spark: SparkSession, d: str) -> DataFrame:
    both = turn_pairs(spark, d)
    return both.where(F.size(tokens(F.col("src"))).between(20, 50) & F.size(tokens(F.col("ref"))).between(20, 50)).select("pair_id")


@query(f"SELECT doc_id FROM documents WHERE NOT ({' OR '.join(f'contains(lower(text), {w!r})' for w in BANNED)})")
def q_banned_substring(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(~has_any(F.col("text"), BANNED)).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE lang = 'de'")
def q_attr_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'de'").select("doc_id", "source")


@query(f"SELECT doc_id FROM documents WHERE NOT starts_with(text, 'The image') AND len({sql_tokens('text')}) > 10")
def q_valid_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(valid_content(F.col("text"))).select("doc_id")


def _sql_score(parts: str, lang: str) -> str:
    strong, weak = ("[" + ", ".join(f"'{w}'" for w in ws) + "]" for ws in lid.WEIGHTS[lang])
    return f"(2 * len(list_filter({parts}, lambda w: list_contains({strong}, w))) + len(list_filter({parts}, lambda w: list_contains({weak}, w))))"


_LANGS = sorted(lid.WEIGHTS)
_BEST = "CASE " + " ".join(f"WHEN {' AND '.join(f'{a} >= {b}' for b in _LANGS if b != a)} THEN '{a}'" for a in _LANGS) + " END"
_SQL_LINES = rf"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), parts AS (
  SELECT doc_id, i, regexp_matches(line, '\S') AS filled, {sql_words("line")} AS ws FROM lines
), scored AS (
  SELECT doc_id, i, filled, {", ".join(f"{_sql_score('ws', lang)} AS {lang}" for lang in _LANGS)} FROM parts
), labelled AS (
  SELECT doc_id, i, filled, {_BEST} AS label FROM scored
), firsts AS (
  SELECT doc_id, count(*) AS n, max(CASE WHEN i = 1 THEN label END) AS one, max(CASE WHEN i = 2 THEN label END) AS two,
         count(*) FILTER (WHERE filled) AS full_lines, count(*) FILTER (WHERE filled AND label = 'fr') AS good
  FROM labelled GROUP BY doc_id
)
SELECT doc_id FROM firsts WHERE """


@query(_SQL_LINES + "one = 'fr' AND (n = 1 OR two = 'fr')")
def q_lid_and(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(lid.both_lines(F.col("text"), ["fr"])).select("doc_id")


@query(_SQL_LINES + "NOT (one = 'fr' AND (n = 1 OR two = 'fr'))")
def q_lid_not(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(~lid.both_lines(F.col("text"), ["fr"]) & F.col("text").isNotNull()).select("doc_id")


@query(_SQL_LINES + "one IN ('es', 'fr') OR two IN ('es', 'fr')")
def q_lid_or(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(lid.either_line(F.col("text"), ["es", "fr"])).select("doc_id")


@query(_SQL_LINES + "full_lines > 0 AND good * 2 > full_lines")
def q_lid_majority(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(lid.most_lines(F.col("text"), ["fr"])).select("doc_id")


_SQL_SCORES = f"""
WITH w AS (SELECT doc_id, {sql_words("text")} AS ws FROM documents WHERE text IS NOT NULL),
scores AS (SELECT doc_id, {", ".join(f"{_sql_score('ws', lang)} AS {lang}" for lang in _LANGS)} FROM w),
long AS ({" UNION ALL ".join(f"SELECT doc_id, '{lang}' AS lang, {lang} AS score FROM scores" for lang in _LANGS)})
"""


@query(_SQL_SCORES + "SELECT doc_id, lang, score, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS rk FROM long) WHERE rk <= 2")
def q_lid_topk(spark: SparkSession, d: str) -> DataFrame:
    best = top_k(lid.scored(F.col("ws")), 2)
    parts = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("ws"))
    return parts.select("doc_id", F.posexplode(best).alias("p", "s")).select("doc_id", "s.lang", F.col("s.score").cast("long").alias("score"), (F.col("p") + 1).cast("long").alias("rank"))


def _sql_softmax(over: tuple) -> str:
    top = f"greatest({', '.join(over)})"
    total = " + ".join(f"exp({lang} - {top})" for lang in over)
    return _SQL_SCORES + " UNION ALL ".join(f"SELECT doc_id, '{lang}' AS lang, round(exp({lang} - {top}) / ({total}), 6) AS p FROM scores" for lang in ("es", "fr"))


def _softmax(spark: SparkSession, d: str, before: bool) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    each = docs.select("doc_id", F.explode(lid.probabilities(F.col("text"), ["fr", "es", "xx"], before)).alias("s"))
    return each.select("doc_id", "s.lang", F.round("s.p", 6).alias("p"))


@query(_sql_softmax(("es", "fr")))
def q_lid_limit_before(spark: SparkSession, d: str) -> DataFrame:
    return _softmax(spark, d, True)


@query(_sql_softmax(tuple(_LANGS)))
def q_lid_limit_after(spark: SparkSession, d: str) -> DataFrame:
    return _softmax(spark, d, False)


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('de', 'es', 'fr') GROUP BY lang")
def q_split_collapse(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return collapse_splits({lang: docs.where(F.col("lang") == lang) for lang in ("fr", "de", "es")}).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, text, 'documents' AS origin FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark")
def q_union_sources(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("origin"))
    return first.unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("origin")))


_SQL_HELD = f"valid AS (SELECT doc_id, text FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT {HELD_OUT})"


@query(f"WITH {_SQL_HELD} SELECT doc_id FROM valid")
def q_val_split(spark: SparkSession, d: str) -> DataFrame:
    return held_out(table(spark, d, "documents"), HELD_OUT, "doc_id")[0].select("doc_id")


@query(rf"WITH {_SQL_HELD} SELECT doc_id FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '^\s+|\s+$', '', 'g') NOT IN (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') FROM valid WHERE text IS NOT NULL)")
def q_train_no_val(spark: SparkSession, d: str) -> DataFrame:
    return held_out(table(spark, d, "documents"), HELD_OUT, "doc_id")[1].select("doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS rn FROM documents")
def q_shuffle(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", shuffle_key(F.col("doc_id")).alias("k"))
    return numbered(docs, "k", "doc_id").select("doc_id", F.col("rn").cast("long").alias("rn"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 + 1 AS shard FROM documents")
def q_shards(spark: SparkSession, d: str) -> DataFrame:
    return shard_numbers(table(spark, d, "documents").select("doc_id"), 100, "doc_id").select("doc_id", "shard")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) * 2 <= (SELECT count(*) FROM documents) THEN 'first' ELSE 'second' END AS half FROM documents")
def q_halves(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    n = docs.count()
    return numbered(docs, "doc_id").select("doc_id", F.when(F.col("rn") * 2 <= n, "first").otherwise("second").alias("half"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def q_longest(spark: SparkSession, d: str) -> DataFrame:
    return head(table(spark, d, "documents"), 10, F.desc("n_chars"), "doc_id").select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE text IS NULL OR text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)")
def q_anti_text(spark: SparkSession, d: str) -> DataFrame:
    return without_texts(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '^\s+|\s+$', '', 'g') NOT IN (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') FROM benchmark WHERE text IS NOT NULL)")
def q_anti_trim(spark: SparkSession, d: str) -> DataFrame:
    return without_texts(table(spark, d, "documents"), table(spark, d, "benchmark"), trimmed=True).select("doc_id")


@query(rf"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE regexp_matches(text, '\S')) AS n_filled, count(*) FILTER (WHERE len({sql_tokens("text")}) BETWEEN 10 AND 2000) AS n_sized,
       count(*) FILTER (WHERE lang = 'fr') AS n_fr FROM documents""")
def q_row_counts(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return row_counts(table(spark, d, "documents"), n_filled=F.rlike(text, F.lit(r"\S")), n_sized=F.size(tokens(text)).between(10, 2000), n_fr=F.col("lang") == "fr")


@query(f"SELECT doc_id FROM documents WHERE (text IS NULL OR text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)) AND len({sql_tokens('text')}) < 7500")
def q_token_cap(spark: SparkSession, d: str) -> DataFrame:
    """Texts that another table hasn't, below a length; the length is checked before the join."""
    short = table(spark, d, "documents").where(F.size(tokens(F.col("text"))) < 7500)
    return without_texts(short, table(spark, d, "benchmark")).select("doc_id")

"""Queries over multiple-choice questions made of the benchmark's items."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import mcqa
from tessera.plans.base import query, sql_tokens, table

#: The fourth parts of an item's text are its choices. Some questions are spoilt by the text's length, so that every check has work.
_SQL_ITEMS = f"""parts AS (SELECT item_id, text, length(text) AS n, {sql_tokens("text")} AS t FROM benchmark WHERE text IS NOT NULL),
quarters AS (SELECT item_id, n, text, list_transform([0, 1, 2, 3], lambda k: array_to_string(list_slice(t, k * (len(t) // 4) + 1, (k + 1) * (len(t) // 4)), ' ')) AS four FROM parts),
items AS (SELECT item_id, n, text, CASE n % 7 WHEN 1 THEN [] WHEN 2 THEN ['a', 'a', 'b', 'c'] ELSE ['a', 'b', 'c', 'd'] END AS labels,
  CASE WHEN n % 7 = 3 THEN four[1:3] ELSE four END AS texts, CASE WHEN n % 7 = 4 THEN 'z' ELSE substr('abcd', (item_id % 4 + 1)::INTEGER, 1) END AS answer FROM quarters),
checked AS (SELECT *, CASE WHEN len(labels) = 0 THEN 'no_labels' WHEN len(labels) <> len(texts) THEN 'mismatched_label_text' WHEN len(list_distinct(labels)) <> len(labels) THEN 'duplicate_labels'
  WHEN NOT list_contains(labels, answer) THEN 'gold_not_in_labels' ELSE 'ok' END AS reason FROM items)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "benchmark").where("text is not null").select("item_id", F.length("text").alias("n"), "text", tokens(F.col("text")).alias("t"))
    quarter = F.floor(F.size("t") / 4).cast("int")
    four = F.array(*[F.array_join(F.slice("t", quarter * k + 1, quarter), " ") for k in range(4)])
    odd = F.col("n") % 7
    labels = F.when(odd == 1, F.array().cast("array<string>")).when(odd == 2, F.array(*map(F.lit, "aabc"))).otherwise(F.array(*map(F.lit, "abcd")))
    answer = F.when(odd == 4, "z").otherwise(F.substring(F.lit("abcd"), (F.col("item_id") % 4 + 1).cast("int"), F.lit(1)))
    texts = F.when(odd == 3, F.slice(four, 1, 3)).otherwise(four)
    return parts.select("item_id", "n", "text", F.struct(labels.alias("label"), texts.alias("text")).alias("choices"), answer.alias("answer"))


@query(f"WITH {_SQL_ITEMS} SELECT reason, count(*) AS n FROM checked GROUP BY reason")
def q_mcqa_validate(spark: SparkSession, d: str) -> DataFrame:
    why = F.coalesce(mcqa.problem(F.col("choices"), F.col("answer")), F.lit("ok"))
    return _items(spark, d).groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_SQL_ITEMS} SELECT item_id, answer FROM checked WHERE len(labels) > 0 AND len(labels) = len(texts) AND list_contains(labels, answer)")
def q_mcqa_export(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).where(mcqa.exportable(F.col("choices"), F.col("answer"))).select("item_id", "answer")


@query(
    f"""WITH {_SQL_ITEMS} SELECT item_id, array_to_string(list_transform(list_zip(four), lambda p: p[1]), ' / ') AS texts, 'a,b,c,d' AS labels FROM quarters"""
    .replace("list_transform(list_zip(four), lambda p: p[1])", "four")
)
def q_mcqa_options(spark: SparkSession, d: str) -> DataFrame:
    """The options as the printed list they come in, parsed."""
    items = table(spark, d, "benchmark").where("text is not null").select("item_id", tokens(F.col("text")).alias("t"))
    quarter = F.floor(F.size("t") / 4).cast("int")
    shown = F.concat(F.lit("["), F.concat_ws(", ", *[F.concat(F.lit(f"'{lab}. "), F.array_join(F.slice("t", quarter * k + 1, quarter), " "), F.lit("'")) for k, lab in enumerate("ABCD")]), F.lit("]"))
    made = items.select("item_id", mcqa.parsed_options(shown).alias("c"))
    return made.select("item_id", F.array_join("c.text", " / ").alias("texts"), F.array_join("c.label", ",").alias("labels"))


_INITIAL, _ANSWER = mcqa.PRESETS["bali"]


@query(
    rf"""WITH {_SQL_ITEMS} SELECT item_id, '{_INITIAL}' || chr(10) || chr(10) || 'context ' || item_id || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10)
|| 'a. ' || texts[1] || chr(10) || 'b. ' || texts[2] || chr(10) || 'c. ' || texts[3] || chr(10) || 'd. ' || texts[4] || chr(10) || chr(10) || '{_ANSWER}' AS prompt FROM checked WHERE reason = 'ok'"""
)
def q_mcqa_prompt(spark: SparkSession, d: str) -> DataFrame:
    good = _items(spark, d).where(mcqa.problem(F.col("choices"), F.col("answer")).isNull())
    context = F.concat(F.lit("context "), F.col("item_id").cast("string"))
    return good.select("item_id", mcqa.prompt(context, F.col("text"), F.col("choices"), _INITIAL, _ANSWER).alias("prompt"))


#: A label's score is minus the length of its text, halved; ties go to the first.
_SQL_PICK = f"""{_SQL_ITEMS}, each AS (SELECT item_id, n, answer, labels[k] AS lab, k, -(length(texts[k]) // 8) / 2.0 AS score FROM (SELECT *, unnest(range(1, 5)) AS k FROM checked WHERE reason = 'ok')),
picked AS (SELECT item_id, n, answer, lab AS pred, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, k) AS rn FROM each) WHERE rn = 1)"""


def _picked(spark: SparkSession, d: str) -> DataFrame:
    good = _items(spark, d).where(mcqa.problem(F.col("choices"), F.col("answer")).isNull())
    tokens_ = F.map_from_entries(F.transform(F.arrays_zip(F.col("choices.label").alias("l"), F.col("choices.text").alias("t")), lambda x: F.struct(x["l"], F.array_repeat(-F.floor(F.length(x["t"]) / 8) / 4.0, 2))))
    scored = good.select("item_id", "n", "answer", "choices", mcqa.label_scores(tokens_).alias("scores"))
    pred = mcqa.pick(F.col("choices.label"), F.col("scores"))
    return scored.select("item_id", "n", "answer", pred.alias("pred"), F.element_at("scores", pred).alias("score"))


@query(f"WITH {_SQL_PICK} SELECT item_id, pred, round(score, 6)::DOUBLE AS score FROM picked")
def q_mcqa_pick(spark: SparkSession, d: str) -> DataFrame:
    return _picked(spark, d).select("item_id", "pred", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(
    f"""WITH {_SQL_PICK}, done AS (SELECT CASE WHEN pred = answer THEN 1.0 ELSE 0.0 END AS correct, CASE WHEN n % 2 = 0 THEN ['even', 'all_items'] ELSE ['odd', 'all_items'] END AS category, CASE WHEN n % 3 > 0 THEN n % 3 END AS grade FROM picked)
SELECT 'overall' AS level, 'all' AS grp, count(*) AS n, coalesce(round(avg(correct), 6), 0.0)::DOUBLE AS accuracy FROM done
UNION ALL SELECT 'category', c, count(*), round(avg(correct), 6)::DOUBLE FROM (SELECT correct, unnest(category) AS c FROM done) GROUP BY c
UNION ALL SELECT 'grade', coalesce(grade::VARCHAR, 'None'), count(*), round(avg(correct), 6)::DOUBLE FROM done GROUP BY coalesce(grade::VARCHAR, 'None')"""
)
def q_mcqa_accuracy(spark: SparkSession, d: str) -> DataFrame:
    category = F.when(F.col("n") % 2 == 0, F.array(F.lit("even"), F.lit("all_items"))).otherwise(F.array(F.lit("odd"), F.lit("all_items")))
    rows = _picked(spark, d).select((F.col("pred") == F.col("answer")).alias("correct"), category.alias("category"), F.when(F.col("n") % 3 > 0, F.col("n") % 3).alias("grade"))
    return mcqa.accuracy(rows)


@query("SELECT round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS median, quantile_disc(ms, 0.95) AS p95 FROM (SELECT value AS ms FROM events)")
def q_latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("value").alias("ms")).agg(*mcqa.latency(F.col("ms")))

"""Multiple-choice questions: shape, checks, prompts, picks and statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip

#: What stands before and behind a question, by language.
PRESETS = {"bali": ("Pilih pasaut ane pinih beneh!", "Pasaut: "), "cirebon": ("Pilih jawaban sing paling bener!", "Jawaban: ")}
#: A string of a printed Python list: in single or double quotes, with what is escaped in it.
_ITEM = r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""


def parsed_options(options: Column) -> Column:
    """struct<label, text> of a printed Python list of strings such as "A. one": the parts before and behind the first dot, labels in lower case.

    Strings are in single quotes, or in double ones where they hold an apostrophe; commas, quotes and backslashes within them are theirs.
    """
    raw = F.transform(F.regexp_extract_all(options, F.lit(_ITEM), F.lit(0)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    items = F.transform(raw, lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
    parts = F.transform(items, lambda x: F.split(x, r"\.", 2))
    return F.struct(F.transform(parts, lambda p: F.lower(strip(p[0]))).alias("label"), F.transform(parts, lambda p: strip(F.coalesce(F.get(p, 1), F.lit("")))).alias("text"))


def question(question: Column, options: Column, answer: Column, grade: Column, key: Column) -> Column:
    """struct<context, question, choices, answer, category, grade, question_id> of a row with printed options; the id is made of `key`, the same on every run."""
    name = F.md5(key)
    uid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.struct(
        F.lit("").alias("context"), question.alias("question"), parsed_options(options).alias("choices"), F.lower(answer).alias("answer"), F.array().cast("array<string>").alias("category"),
        grade.cast("int").alias("grade"), uid.alias("question_id"),
    )


def problem(choices: Column, answer: Column) -> Column:
    """Why a question can't be used, the first reason that holds; null if it can."""
    labels, texts = choices["label"], choices["text"]
    return (
        F.when(F.coalesce(F.size(labels), F.lit(-1)) <= 0, "no_labels").when(F.size(labels) != F.coalesce(F.size(texts), F.lit(-1)), "mismatched_label_text")
        .when(F.size(F.array_distinct(labels)) != F.size(labels), "duplicate_labels").when(~F.coalesce(F.array_contains(labels, answer), F.lit(False)), "gold_not_in_labels")
    )


def prompt(context: Column, question: Column, choices: Column, initial: str, answer: str) -> Column:
    """The parts that aren't empty, a blank line between; the answer's beginning keeps its last space."""
    listed = F.transform(F.arrays_zip(choices["label"].alias("label"), choices["text"].alias("text")), lambda x: F.concat(x["label"], F.lit(". "), x["text"]))
    asked = strip(F.coalesce(question, F.lit("")))
    block = F.array_join(F.concat(F.filter(F.array(asked), lambda x: x != ""), listed), "\n")
    parts = F.array(F.lit(initial.rstrip()), strip(F.coalesce(context, F.lit(""))), block, F.lit(answer))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def pick(labels: Column, scores: Column) -> Column:
    """The label of the greatest score, the first listed of equal ones; scores is a map by label."""
    ranked = F.transform(labels, lambda lab, i: F.struct((-F.element_at(scores, lab)).alias("s"), i.alias("i"), lab.alias("lab")))
    return F.array_min(ranked)["lab"]


def label_scores(token_scores: Column) -> Column:
    """The sum of the token log-probabilities of each label, as map<string, double>."""
    return F.transform_values(token_scores, lambda _, v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x))


def accuracy(rows: DataFrame) -> DataFrame:
    """(level, grp, n, accuracy) of rows (correct, category array, grade): overall, by category and by grade."""
    right = F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy")
    over = rows.agg(F.lit("overall").alias("level"), F.lit("all").alias("grp"), F.count("*").alias("n"), F.coalesce(right, F.lit(0.0)).alias("accuracy"))
    by = rows.select(F.explode("category").alias("grp"), "correct").groupBy("grp").agg(F.count("*").alias("n"), right).select(F.lit("category").alias("level"), "grp", "n", "accuracy")
    grade = rows.groupBy(F.coalesce(F.col("grade").cast("string"), F.lit("None")).alias("grp")).agg(F.count("*").alias("n"), right).select(F.lit("grade").alias("level"), "grp", "n", "accuracy")
    return over.unionByName(by).unionByName(grade)


def latency(ms: Column) -> list[Column]:
    """Mean, median, and the nearest-rank 95th percentile."""
    return [F.round(F.avg(ms), 6).alias("mean"), F.round(F.percentile(ms, 0.5), 6).alias("median"), F.expr("percentile_disc(0.95) within group (order by ms)").alias("p95")]


def exportable(choices: Column, answer: Column) -> Column:
    """Whether a question has as many labels as texts, some of each, and its answer among the labels."""
    labels, texts = choices["label"], choices["text"]
    return F.coalesce((F.size(labels) > 0) & (F.size(labels) == F.size(texts)) & F.array_contains(labels, answer), F.lit(False))


def exported(rows: DataFrame, question: str = "question") -> tuple[DataFrame, DataFrame]:
    """(records that are whole, without overlap_ratio; one row (saved, dropped)) of rows with question, choices and answer."""
    good = F.col(question).isNotNull() & F.coalesce(exportable(F.col("choices"), F.col("answer")), F.lit(False))
    return rows.where(good).drop("overlap_ratio"), rows.agg(F.count_if(good).alias("saved"), F.count_if(~good).alias("dropped"))

"""Queries over files that are written and read again, and over what runs leave behind."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import lexicon as lex
from tessera.operators import lid, mcqa, packing, topics
from tessera.plans.base import SQL_LEXICON, SQL_PAIRED, SQL_PAIRS, query, sql_tokens, sql_words, table, turn_pairs
from tessera.plans.lexical import _known, _lexicon, _paired
from tessera.plans.selections import _SQL_LINES
from tessera.sources import readers, writers
from tessera.sources.folders import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def _lines(df: DataFrame, value, path: str) -> str:
    df.select(value.alias("value")).write.mode("overwrite").text(path)
    return path


@query("SELECT doc_id::VARCHAR AS doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0 AND lang IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL")
def q_tsv(spark: SparkSession, d: str) -> DataFrame:
    """A sheet with an index and empty cells."""
    path = _folder(spark, "sheet.tsv")
    rows = table(spark, d, "documents").select(F.lit(0).alias("i"), "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), "source")
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_tsv(spark, path)


_SQL_TOPICS = "SELECT lang AS topic, count(*) AS n, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 'infinity'::DOUBLE END AS pos FROM documents WHERE lang IS NOT NULL GROUP BY lang"


def _topics(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "documents").where("lang is not null").groupBy(F.col("lang").alias("topic")).agg(F.count("*").alias("n"))
    return topics.ranked(records, spark.createDataFrame([("fr", 0), ("en", 1)], "topic string, pos long"))


@query(f"SELECT topic, n, row_number() OVER (ORDER BY pos, topic) - 1 AS place FROM ({_SQL_TOPICS})")
def q_json_document(spark: SparkSession, d: str) -> DataFrame:
    """A document of records in order, written; `place` is where each stands in the file."""
    path = _folder(spark, "topics.json")
    writers.save_document(_topics(spark, d).select("topic", "n", "pos"), path, "pos", "topic")
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<topic: string, n: long>>")).alias("place", "r"))
    return whole.select("r.topic", "r.n", F.col("place").cast("long").alias("place"))


@query(f"SELECT topic, n FROM ({_SQL_TOPICS})")
def q_json_read(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "topics.json")
    writers.save_document(_topics(spark, d).select("topic", "n", "pos"), path, "pos", "topic")
    return readers.read_json(spark, path, "topic string, n long")


@query("SELECT DISTINCT 'id ' || doc_id AS id FROM documents WHERE doc_id % 4 < 2")
def q_jsonl_ids(spark: SparkSession, d: str) -> DataFrame:
    """Lines of which some are cut off, and some have a number for an id."""
    kind = F.col("doc_id") % 4
    own = F.concat(F.lit("id "), F.col("doc_id").cast("string"))
    whole = F.to_json(F.struct(own.alias("custom_id"), F.col("text")))
    line = F.when(kind < 2, whole).when(kind == 2, F.substr(whole, F.lit(1), F.lit(20))).otherwise(F.to_json(F.struct(F.col("doc_id").alias("custom_id"))))
    return readers.read_ids(spark, _lines(table(spark, d, "documents"), line, _folder(spark, "ids.jsonl")))


@query("SELECT count(*) AS n FROM documents WHERE doc_id % 5 = 0")
def q_jsonl_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    whole = F.to_json(F.struct("doc_id"))
    path = _lines(table(spark, d, "documents"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("{"), whole)).otherwise(whole), _folder(spark, "bad.jsonl"))
    return readers.bad_lines(spark, path).agg(F.count("*").alias("n"))


@query(rf"SELECT DISTINCT lower(w) AS word FROM (SELECT unnest({sql_tokens('text')}) AS w FROM documents WHERE text IS NOT NULL)")
def q_word_list(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("w"))
    return readers.read_word_list(spark, _lines(words, F.concat(F.lit(" "), "w", F.lit(" ")), _folder(spark, "words.txt")))


@query(
    rf"""WITH l AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, ({sql_tokens("text")})[1] AS line FROM benchmark WHERE len({sql_tokens("text")}) > 0)
SELECT line, min(i) AS pos FROM l GROUP BY line"""
)
def q_ordered_lines(spark: SparkSession, d: str) -> DataFrame:
    """The distinct lines of one file in their order."""
    items = table(spark, d, "benchmark").select("item_id", F.get(text.tokens(F.col("text")), 0).alias("line")).where("line is not null")
    path = _folder(spark, "seeds.txt")
    items.orderBy("item_id").coalesce(1).select(F.concat(F.lit("  "), "line").alias("value")).write.text(path)
    return readers.read_ordered_lines(spark, path).select(F.col("pos").cast("long").alias("pos"), "line")


@query(rf"SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM benchmark WHERE item_id % 3 <> 0 AND NOT starts_with(regexp_replace(text, '^\s+|\s+$', '', 'g'), 'The image') AND len({sql_tokens('text')}) > 10")
def q_text_tree(spark: SparkSession, d: str) -> DataFrame:
    """A file for each item, in folders of which one is a dictionary's."""
    path = _folder(spark, "tree")
    items = table(spark, d, "benchmark").select(F.when(F.col("item_id") % 3 == 0, "mydict").otherwise("texts").alias("kind"), F.col("text").alias("value"))
    items.write.partitionBy("kind").option("maxRecordsPerFile", 1).text(path)
    return readers.read_tree(spark, path).select("text")


def _lexicon_file(spark: SparkSession, d: str) -> str:
    """A JSON object of the bilingual lexicon."""
    titled = F.initcap("word")
    key = F.when(F.lower(titled) == F.col("word"), titled).otherwise(F.col("word"))  # of ß the title is Ss
    entry = F.struct(key.alias("key"), F.to_json("translations").alias("value"))
    row = _paired(spark, d).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    body = F.array_join(F.transform("e", lambda x: F.concat(F.lit('"'), x["key"], F.lit('": '), x["value"])), ", ")
    return _lines(row, F.concat(F.lit('{"odd": 5, '), body, F.lit("}")), _folder(spark, "lexicon.json"))


@query(f"WITH {SQL_LEXICON}, {SQL_PAIRED} SELECT word, array_to_string(translations, '|') AS translations FROM paired UNION ALL SELECT 'odd', ''")
def q_lexicon_file(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_lexicon(spark, _lexicon_file(spark, d)).select("word", F.array_join("translations", "|").alias("translations"))


@query(f"WITH {SQL_LEXICON}, {SQL_PAIRED} SELECT word FROM paired UNION ALL SELECT 'odd'")
def q_lexicon_words(spark: SparkSession, d: str) -> DataFrame:
    """The keys of a lexicon's file, and of one that isn't there: none."""
    path = _lexicon_file(spark, d)
    return readers.read_lexicon_words(spark, path).unionByName(readers.read_lexicon_words(spark, f"{path}-missing"))


@query("SELECT (conv_id % 3)::BIGINT AS part, count(*) AS n FROM conversations GROUP BY conv_id % 3")
def q_shard_files(spark: SparkSession, d: str) -> DataFrame:
    """Shards found by the beginning and the end of their names, read file by file."""
    base = _folder(spark, "parts")
    rows = table(spark, d, "conversations").withColumn("part", F.col("conv_id") % 3)
    for k in range(3):
        writers.save_jsonl(rows.where(F.col("part") == k), f"{base}/batch_{k}.jsonl")
        writers.save_jsonl(rows.limit(1), f"{base}/other_{k}.jsonl")
    found = readers.shards(spark, base, "batch_")
    parts = readers.collapse_splits({p: readers.read_jsonl(spark, p, "part long") for p in found})
    return parts.groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT 'kept' AS state, doc_id, quality FROM labels UNION ALL SELECT 'replaced', doc_id, toxic FROM labels WHERE quality = 1")
def q_saved_tables(spark: SparkSession, d: str) -> DataFrame:
    """What a guarded write leaves where a table is already, and what an overwriting one puts in its place."""
    labels, a, b = table(spark, d, "labels"), _folder(spark, "kept"), _folder(spark, "replaced")
    for path in (a, b):
        writers.save(labels.select("doc_id", "quality"), path)
    try:
        writers.save(labels.limit(0).select("doc_id", "quality"), a)
    except Exception as why:
        if "PATH_ALREADY_EXISTS" not in str(why):
            raise
    writers.save(labels.where("quality = 1").select("doc_id", F.col("toxic").alias("quality")), b, overwrite=True)
    return spark.read.parquet(a).select(F.lit("kept").alias("state"), "doc_id", "quality").unionByName(spark.read.parquet(b).select(F.lit("replaced").alias("state"), "doc_id", "quality"))


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, doc_id FROM documents WHERE doc_id IS NOT NULL")
def q_saved_splits(spark: SparkSession, d: str) -> DataFrame:
    docs, path = table(spark, d, "documents").select("doc_id").where("doc_id is not null"), _folder(spark, "splits")
    writers.save_splits({"train": docs.where("doc_id % 10 <> 0"), "validation": docs.where("doc_id % 10 = 0")}, path)
    return spark.read.parquet(path).select("split", "doc_id")


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user'")
def q_jsonl_append(spark: SparkSession, d: str) -> DataFrame:
    turns, path = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), _folder(spark, "log.jsonl")
    writers.save_jsonl(turns, path)
    writers.save_jsonl(turns.where("role = 'user'"), path, append=True)
    return readers.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query(
    """SELECT 'detail' AS kind, item_id AS item, length(text)::BIGINT AS n FROM benchmark WHERE text IS NOT NULL
UNION ALL SELECT 'summary', NULL, sum(length(text))::BIGINT FROM benchmark"""
)
def q_run_results(spark: SparkSession, d: str) -> DataFrame:
    """The details and the summary of a run, written and read again."""
    items, path = table(spark, d, "benchmark").where("text is not null"), _folder(spark, "run")
    details = items.select(F.col("item_id").alias("item"), F.length("text").cast("long").alias("n"))
    writers.save_run(details, details.agg(F.sum("n").alias("n")), path)
    one = readers.read_jsonl(spark, f"{path}/details.jsonl", "item long, n long").select(F.lit("detail").alias("kind"), "item", "n")
    return one.unionByName(readers.read_json(spark, f"{path}/summary.json", "n long").select(F.lit("summary").alias("kind"), F.lit(None).cast("long").alias("item"), "n"))


@query("SELECT lang AS topic, source AS title, list(doc_id ORDER BY doc_id)::VARCHAR AS ids FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source")
def q_zip_strict(spark: SparkSession, d: str) -> DataFrame:
    """Titles and their questions from two lists of the same length, by place."""
    rows = table(spark, d, "documents").where("lang is not null and source is not null")
    each = rows.groupBy("lang", "source").agg(F.array_sort(F.collect_list(F.col("doc_id"))).alias("q"))
    lists = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "q"))).alias("s")).select("lang", F.col("s.source").alias("titles"), F.col("s.q").alias("questions"))
    made = lists.select("lang", F.explode(topics.zipped(F.col("titles"), F.col("questions"))).alias("z"))
    return made.select(F.col("lang").alias("topic"), "z.title", F.concat(F.lit("["), F.array_join(F.col("z.questions").cast("array<string>"), ", "), F.lit("]")).alias("ids"))


@query(
    """WITH f AS (SELECT source, 'failed ' || lpad(doc_id::VARCHAR, 9, '0') AS m FROM documents WHERE lang = 'de')
SELECT source, count(*) AS n_failed, array_to_string((list(m ORDER BY m))[1:3], '; ') AS first FROM f GROUP BY source"""
)
def q_failures(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("lang") == "de", F.format_string("failed %09d", "doc_id"))
    return topics.failures(table(spark, d, "documents").select("source", said.alias("m")), "source", "m").select("source", "n_failed", F.array_join("first", "; ").alias("first"))


@query("SELECT source, n, total, (greatest(1, ceil(total / 4.0 / 10)) * 10)::BIGINT AS save_every FROM (SELECT source, n, greatest(1, ceil(ceil(n / 32.0) * 1.5))::BIGINT AS total FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source))")
def q_train_steps(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    total, every = packing.step_columns(F.col("n"), 8, 4, 1.5, 10, 4)
    return counts.select("source", "n", total.alias("total"), every.alias("save_every"))


@query(
    """WITH e AS (SELECT DISTINCT source AS entry FROM documents WHERE source IS NOT NULL), f AS (SELECT DISTINCT 'out/' || source || '.jsonl' AS path FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT 'out/' || source FROM documents WHERE source LIKE '%1')
SELECT entry, coalesce(min(CASE WHEN path = 'out/' || entry THEN path END), min(path)) AS path FROM e JOIN f ON starts_with(path, 'out/' || entry) GROUP BY entry"""
)
def q_resolved_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a manifest by the file of their name, else the first that begins with it."""
    names = table(spark, d, "documents").where("source is not null").select("source").distinct()
    files = names.select(F.concat(F.lit("out/"), "source", F.lit(".jsonl")).alias("path")).unionByName(names.where("source like '%1'").select(F.concat(F.lit("out/"), "source").alias("path")))
    return readers.resolve(names.select(F.col("source").alias("entry")), files)


def _sql_either(side: str, langs: str) -> str:
    lines = _SQL_LINES.replace("SELECT doc_id FROM firsts WHERE ", "").replace("\nWITH ", "").replace("FROM documents", f"FROM (SELECT pair_id AS doc_id, {side} AS text FROM pairs)")
    for name in ("lines", "parts", "scored", "labelled", "firsts"):
        lines = lines.replace(f"{name} AS (", f"{name}_{side} AS (").replace(f"FROM {name}\n", f"FROM {name}_{side}\n").replace(f"FROM {name} ", f"FROM {name}_{side} ")
    return lines.rstrip(), f"SELECT doc_id FROM firsts_{side} WHERE one IN ({langs}) OR two IN ({langs})"


_SRC, _REF = _sql_either("src", "'en', 'de'"), _sql_either("ref", "'en', 'es'")


@query(f"WITH {SQL_PAIRS}, {_SRC[0]}, {_REF[0]} SELECT pair_id FROM pairs WHERE pair_id IN ({_SRC[1]}) AND pair_id IN ({_REF[1]})")
def q_lid_two_columns(spark: SparkSession, d: str) -> DataFrame:
    return turn_pairs(spark, d).where(lid.either_in_both(F.col("src"), ["en", "de"], F.col("ref"), ["en", "es"])).select("pair_id")


@query(
    """WITH c AS (SELECT DISTINCT CASE WHEN source = 'src0' THEN 'final' ELSE 'checkpoint-' || (substr(source, 4)::INTEGER * 7) END AS name, CASE WHEN source <> 'src0' THEN substr(source, 4)::INTEGER * 7 END AS step FROM documents WHERE source LIKE 'src%')
SELECT name, row_number() OVER (ORDER BY step NULLS FIRST, name) AS place FROM c"""
)
def q_checkpoint_order(spark: SparkSession, d: str) -> DataFrame:
    step = (F.substr("source", F.lit(4)).cast("int") * 7).cast("string")
    name = F.when(F.col("source") == "src0", "final").otherwise(F.concat(F.lit("checkpoint-"), step))
    names = table(spark, d, "documents").where("source like 'src%'").select(name.alias("name")).distinct()
    return writers.numbered(names, *text.checkpoint_order(F.col("name"))).select("name", F.col("rn").cast("long").alias("place"))


_SQL_METRICS = f"""WITH {SQL_LEXICON}, {SQL_PAIRED}, known AS (SELECT DISTINCT word FROM lexicon WHERE lang = 'en'), {SQL_PAIRS},
s AS (SELECT pair_id, {sql_words("ref")} AS there, unnest({sql_words("src")}) AS word FROM pairs WHERE regexp_matches(src, '\\S') AND regexp_matches(ref, '\\S')),
met AS (SELECT pair_id, there, coalesce(p.translations, CASE WHEN k.word IS NULL THEN [s.word] ELSE [] END) AS t FROM s LEFT JOIN paired p ON p.word = s.word LEFT JOIN known k ON k.word = s.word),
hits AS (SELECT pair_id, count(*) AS n, count(*) FILTER (WHERE len(list_intersect(t, there)) > 0) AS m FROM met GROUP BY pair_id),
metrics AS (SELECT pair_id, round(coalesce(m * 100.0 / n, 0), 6)::DOUBLE AS bt_valid_match_percentage, round(coalesce((n - m) * 100.0 / n, 0), 6)::DOUBLE AS bt_invalid_match_percentage,
coalesce(m, 0) AS bt_valid_match_count, coalesce(n - m, 0) AS bt_invalid_match_count, coalesce(n, 0) AS bt_total_src_words FROM pairs LEFT JOIN hits USING (pair_id))"""


@query(_SQL_METRICS + " SELECT * FROM metrics")
def q_match_metrics(spark: SparkSession, d: str) -> DataFrame:
    return lex.match_metrics(turn_pairs(spark, d), _paired(spark, d), _known(_lexicon(spark, d)))


@query(
    _SQL_METRICS + f""", w AS (SELECT pair_id, unnest({sql_words("src")}) AS word FROM pairs), v AS (SELECT pair_id, count(*) AS n, count(l.word) AS good FROM w LEFT JOIN (SELECT DISTINCT word FROM lexicon WHERE lang = 'fr') l ON l.word = w.word GROUP BY pair_id),
shares AS (SELECT pair_id, round(coalesce(good * 100.0 / n, 0), 6)::DOUBLE AS valid_pct FROM pairs LEFT JOIN v USING (pair_id))
SELECT m.*, valid_pct, valid_pct >= 25 AS reaches FROM metrics m JOIN shares USING (pair_id)"""
)
def q_metric_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of annotated pairs in one table."""
    found = _lexicon(spark, d)
    return lex.pair_metrics(turn_pairs(spark, d), _paired(spark, d), found.where("lang = 'fr'"), 25, _known(found))


@query(
    """SELECT item_id, text AS question, 'a,b' AS labels, 'it''s item ' || item_id || ', one|say "two", ok' AS texts, 'a' AS answer, (item_id % 6)::INTEGER AS grade FROM benchmark"""
)
def q_mcqa_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with options as a printed list: apostrophes, quotes and commas in them."""
    n = F.col("item_id").cast("string")
    options = F.concat(F.lit('["A. it\'s item '), n, F.lit(", one\", 'B.  say \"two\", ok']"))
    made = table(spark, d, "benchmark").select("item_id", mcqa.question(F.col("text"), options, F.lit("A"), (F.col("item_id") % 6).cast("string"), F.concat(F.lit("q"), n)).alias("q"))
    return made.select("item_id", "q.question", F.array_join("q.choices.label", ",").alias("labels"), F.array_join("q.choices.text", "|").alias("texts"), "q.answer", "q.grade")


@query("SELECT count(*) FILTER (WHERE item_id % 3 > 0) AS saved, count(*) FILTER (WHERE item_id % 3 = 0) AS dropped, count(*) FILTER (WHERE item_id % 3 > 0) AS records FROM benchmark WHERE text IS NOT NULL")
def q_mcqa_dump(spark: SparkSession, d: str) -> DataFrame:
    """Whole records written as one document; how many were saved and dropped, and how many stand in the file."""
    labels = F.array(F.lit("a"), F.lit("b"))
    rows = table(spark, d, "benchmark").where("text is not null").select("item_id", F.col("text").alias("question"), F.when(F.col("item_id") % 3 > 0, "b").otherwise("z").alias("answer"), F.struct(labels.alias("label"), labels.alias("text")).alias("choices"), F.lit(0.5).alias("overlap_ratio"))
    good, counts = mcqa.exported(rows)
    path = _folder(spark, "questions.json")
    writers.save_document(good, path, "item_id")
    return counts.crossJoin(readers.read_json(spark, path, "item_id long").agg(F.count("*").alias("records")))  # a row each

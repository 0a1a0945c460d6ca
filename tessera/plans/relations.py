"""Queries that join tables by key, deduplicate, and pack and measure token lists."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dedup, packing, tables
from tessera.plans.base import SQL_IDS, SQL_PAIRS, query, sql_words, table, token_lists, turn_pairs
from tessera.sources.writers import numbered

#: Tokens of a block and of a window, and rows that are packed together.
SEQ_LEN, STRIDE, BATCH_ROWS, VOCABULARY = 128, 96, 1000, 1 << 28


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels UNION ALL SELECT conv_id FROM conversations UNION ALL SELECT item_id FROM benchmark)")
def q_anti_id_union(spark: SparkSession, d: str) -> DataFrame:
    ids = [table(spark, d, name).select(key) for name, key in (("labels", "doc_id"), ("conversations", "conv_id"), ("benchmark", "item_id"))]
    return tables.without_ids(table(spark, d, "documents"), "doc_id", *ids).select("doc_id")


@query("SELECT d.doc_id, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def q_join_drop(spark: SparkSession, d: str) -> DataFrame:
    return tables.looked_up(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "quality", "drop")


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q_join_keep(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return tables.looked_up(docs, table(spark, d, "labels"), "doc_id", "quality", "keep")


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q_join_null(spark: SparkSession, d: str) -> DataFrame:
    return tables.looked_up(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "quality", "null")


@query("SELECT l.doc_id, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def q_join_raise(spark: SparkSession, d: str) -> DataFrame:
    return tables.looked_up(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents"), "doc_id", "lang", "raise")


@query("SELECT d.doc_id, p.last_id FROM documents d JOIN (SELECT text, max(doc_id) AS last_id FROM documents GROUP BY text) p ON p.text = d.text")
def q_join_long_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    prompts = docs.select("text", F.col("doc_id").alias("last_id"), F.col("doc_id").alias("at"))
    return tables.by_long_text(docs, prompts, "text", "last_id", "at").select("doc_id", "last_id")


@query(
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations)
SELECT conv_id, string_agg(CASE WHEN role = 'assistant' AND i >= 2 THEN md5(text) WHEN role = 'assistant' THEN '-' ELSE role END, ' ' ORDER BY i) AS patched FROM t GROUP BY conv_id"""
)
def q_patch_array(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("entry", F.when(F.col("role") == "assistant", "-").otherwise(F.col("role")))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "entry", "text"))).alias("t"))
    arrays = listed.select("conv_id", F.transform("t", lambda x: x["entry"]).alias("entries"))
    fixes = listed.select("conv_id", F.posexplode("t").alias("idx", "x")).where("x.entry = '-' and idx >= 2").select("conv_id", "idx", F.md5("x.text").alias("new"))
    beyond = listed.select("conv_id", F.lit(1 << 20).alias("idx"), F.lit("lost").alias("new"))
    return tables.patched(arrays, "entries", fixes.unionByName(beyond), "conv_id").select("conv_id", F.array_join("entries", " ").alias("patched"))


@query("SELECT conv_id, role AS last_role, md5(text) AS last_md5, first_seen FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first_seen, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def q_dedup_last(spark: SparkSession, d: str) -> DataFrame:
    last = tables.last_by(table(spark, d, "conversations"), "conv_id", "turn")
    return last.select("conv_id", F.col("role").alias("last_role"), F.md5("text").alias("last_md5"), "first_seen")


@query(
    r"""WITH plain AS (SELECT conv_id * 1000000 + turn AS pos, regexp_replace(string_split(text, '.')[1], '^\s+|\s+$', '', 'g') AS entry FROM conversations)
SELECT pos, entry FROM (SELECT pos, entry, row_number() OVER (PARTITION BY lower(entry) ORDER BY pos) AS rn FROM plain WHERE entry <> '') WHERE rn = 1"""
)
def q_distinct_ci(spark: SparkSession, d: str) -> DataFrame:
    firsts = table(spark, d, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("at"), F.split("text", r"\.")[0].alias("entry"))
    return tables.first_distinct(firsts, "entry", "at")


_SQL_SHINGLES = f"""w AS (SELECT doc_id, {sql_words("text")} AS ws FROM documents WHERE text IS NOT NULL),
runs AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 6), ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 5)) AS i FROM w WHERE len(ws) >= 7)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 5 AND 6
), sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM runs x JOIN runs y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
pairs AS (SELECT a, b, round(s.n / (p.n + q.n - s.n), 6)::DOUBLE AS jaccard FROM shared s JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE round(s.n / (p.n + q.n - s.n), 6) >= 0.8)"""


@query(f"WITH {_SQL_SHINGLES} SELECT a, b, jaccard FROM pairs")
def q_minhash_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_pairs(table(spark, d, "documents"))


@query(
    f"""WITH RECURSIVE {_SQL_SHINGLES}, edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS there FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.there)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT node FROM reach GROUP BY node HAVING min(there) < node)"""
)
def q_minhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicated(table(spark, d, "documents")).select("doc_id")


@query(f"WITH {SQL_IDS} SELECT doc_id, len(ids) AS n_tokens, array_to_string(ids, ' ') AS token_ids FROM ids")
def q_token_docs(spark: SparkSession, d: str) -> DataFrame:
    return token_lists(table(spark, d, "documents")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.array_join("ids", " ").alias("token_ids"))


@query(f"SELECT sum(len({sql_words('text')})) AS n_words, round(sum(len({sql_words('text')})) / 4.0 / 1000000 * 0.3, 9)::DOUBLE AS cost FROM documents")
def q_token_total(spark: SparkSession, d: str) -> DataFrame:
    """Words stand in for tokens; q_tokenise counts those of a vocabulary."""
    n = F.sum(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))
    return table(spark, d, "documents").where("text is not null").agg(n.alias("n_words")).withColumn("cost", F.round(packing.cost(F.col("n_words"), 0.3), 9))


@query()
def q_tokenise(spark: SparkSession, d: str) -> DataFrame:
    """Without SQL: byte-pair tokens of a public vocabulary."""
    return packing.tokenised(table(spark, d, "documents"))


_SQL_RN = f"{SQL_IDS}, rows AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH_ROWS} AS batch, doc_id, ids FROM ids)"
_SQL_STREAM = """stream AS (
  SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY doc_id, i) - 1 AS spot
  FROM (SELECT batch, doc_id, unnest(list_append(ids, 0)) AS id, generate_subscripts(list_append(ids, 0), 1) AS i FROM rows WHERE len(ids) > 0)
)"""


@query(
    f"""WITH {_SQL_RN}, {_SQL_STREAM}
SELECT batch, spot // {SEQ_LEN} AS block, string_agg(id, ' ' ORDER BY spot) AS input_ids FROM stream GROUP BY batch, spot // {SEQ_LEN} HAVING count(*) = {SEQ_LEN}"""
)
def q_pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = numbered(token_lists(table(spark, d, "documents")), "doc_id")
    return packing.packed(rows, SEQ_LEN, 0, BATCH_ROWS).select("batch", "block", F.array_join("input_ids", " ").alias("input_ids"))


_SQL_WINDOWS = f"""{SQL_IDS}, starts AS (SELECT doc_id, ids, unnest(range(0, len(ids) - 1, {STRIDE})) AS start FROM ids WHERE len(ids) >= 2),
cut AS (SELECT doc_id, start, list_slice(ids, start + 1, start + {SEQ_LEN}) AS w FROM starts),
windows AS (SELECT doc_id, start, w, CASE WHEN start = 0 THEN 0 ELSE least({STRIDE}, len(w) - 1) END AS n_pred FROM cut)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.windows(token_lists(table(spark, d, "documents")), SEQ_LEN, STRIDE, drop_first=True)


@query(f"WITH {_SQL_WINDOWS} SELECT doc_id, start, n_pred, array_to_string(w, ' ') AS input_ids FROM windows")
def q_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("doc_id", "start", "n_pred", F.array_join("input_ids", " ").alias("input_ids"))


@query(
    f"""WITH {_SQL_WINDOWS} SELECT doc_id, start, array_to_string(list_concat(w, list_transform(range({SEQ_LEN} - len(w)), lambda x: 0)), ' ') AS input_ids,
array_to_string(list_concat(list_transform(range(len(w) - n_pred), lambda x: -100), list_concat(list_slice(w, len(w) - n_pred + 1, len(w)), list_transform(range({SEQ_LEN} - len(w)), lambda x: -100))), ' ') AS labels,
len(w) AS n_real FROM windows"""
)
def q_window_collate(spark: SparkSession, d: str) -> DataFrame:
    made = _windows(spark, d).select("doc_id", "start", packing.collated(F.col("input_ids"), F.col("n_pred"), SEQ_LEN, 0).alias("c"))
    real = F.aggregate("c.attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("doc_id", "start", F.array_join("c.input_ids", " ").alias("input_ids"), F.array_join("c.labels", " ").alias("labels"), real.alias("n_real"))


@query(
    f"""WITH {SQL_IDS}, loss AS (SELECT doc_id, len(ids) AS n, list_sum(list_transform(ids, lambda x: (x % 1000) / 200.0)) / len(ids) AS nll FROM ids WHERE len(ids) > 0)
SELECT lang, round(exp(sum(nll * n) / sum(n)), 4) AS ppl FROM loss l JOIN documents d ON d.doc_id = l.doc_id GROUP BY lang"""
)
def q_perplexity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    nll = F.aggregate("ids", F.lit(0.0), lambda a, x: a + (x % 1000) / 200.0) / F.size("ids")
    losses = token_lists(docs).where(F.size("ids") > 0).select("doc_id", nll.alias("nll"), F.size("ids").alias("n"))
    return docs.select("doc_id", "lang").join(losses, "doc_id").groupBy("lang").agg(F.round(packing.perplexity(F.col("nll"), F.col("n")), 4).alias("ppl"))


@query(f"WITH {SQL_IDS} SELECT min(list_min(ids)) AS min_id, max(list_max(ids)) AS max_id FROM ids")
def q_token_range(spark: SparkSession, d: str) -> DataFrame:
    return packing.in_vocabulary(token_lists(table(spark, d, "documents")), VOCABULARY).select(F.col("min_id").cast("long").alias("min_id"), F.col("max_id").cast("long").alias("max_id"))


@query(f"WITH {SQL_IDS} SELECT doc_id, array_to_string(CASE WHEN len(ids) >= 512 THEN list_slice(ids, len(ids) - 510, len(ids)) ELSE ids END, ' ') AS kept FROM ids")
def q_left_truncate(spark: SparkSession, d: str) -> DataFrame:
    return token_lists(table(spark, d, "documents")).select("doc_id", F.array_join(packing.left_truncated(F.col("ids"), 512), " ").alias("kept"))


@query(f"WITH {SQL_PAIRS} SELECT pair_id, '<user>' || chr(10) || src || chr(10) || '</user>' || chr(10) || '<assistant>' || chr(10) || ref || chr(10) || '</assistant>' AS chat FROM pairs")
def q_chat_template(spark: SparkSession, d: str) -> DataFrame:
    return turn_pairs(spark, d).select("pair_id", tables.chat(F.col("src"), F.col("ref")).alias("chat"))

"""Queries by word lists: lexicons, shares of known words, glossaries, translations, and scores of pairs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import between_tags
from tessera.operators import lexicon as lex
from tessera.operators import scores
from tessera.plans.base import LEAST_DOCS, SQL_LEXICON, SQL_PAIRED, SQL_PAIRS, query, sql_tokens, sql_words, table, turn_pairs

#: Percent of known words from which a text is good.
GOOD = 50.0
_SQL_EACH = f"each AS (SELECT doc_id, lang, unnest({sql_words('text')}) AS word FROM documents)"
_SQL_FOREIGN = "known AS (SELECT DISTINCT word FROM lexicon WHERE lang = 'en')"


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return lex.frequent_words(table(spark, d, "documents"), LEAST_DOCS)


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return lex.paired(_lexicon(spark, d), "fr", "de")


def _known(lexicon: DataFrame) -> DataFrame:
    return lexicon.where("lang = 'en'").select("word").distinct()


@query(f"WITH {SQL_LEXICON} SELECT lang, word, df FROM lexicon")
def q_lexicon_build(spark: SparkSession, d: str) -> DataFrame:
    return _lexicon(spark, d)


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS word FROM documents) GROUP BY word")
def q_bpe_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return lex.word_counts(table(spark, d, "documents"))


def _sql_valid(known: str, foreign: bool) -> str:
    more = f", {_SQL_FOREIGN}" if foreign else ""
    join = " LEFT JOIN known k ON k.word = e.word" if foreign else ""
    return f"""WITH {SQL_LEXICON}{more}, {_SQL_EACH}, shares AS (
  SELECT e.doc_id, count(*) AS n, count(*) FILTER (WHERE {known}) AS good FROM each e LEFT JOIN lexicon l ON l.lang = e.lang AND l.word = e.word{join} GROUP BY e.doc_id
), valid AS (
  SELECT d.doc_id, coalesce(n, 0) AS total_words, round(coalesce(good * 100.0 / n, 0.0), 6)::DOUBLE AS valid_pct, round(coalesce(100.0 - good * 100.0 / n, 0.0), 6)::DOUBLE AS invalid_pct
  FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN shares s ON s.doc_id = d.doc_id
)
"""


@query(_sql_valid("l.word IS NOT NULL", False) + "SELECT * FROM valid")
def q_valid_pct(spark: SparkSession, d: str) -> DataFrame:
    return lex.valid_share(table(spark, d, "documents"), _lexicon(spark, d))


@query(_sql_valid("l.word IS NOT NULL OR k.word IS NULL", True) + "SELECT * FROM valid")
def q_valid_pct_other(spark: SparkSession, d: str) -> DataFrame:
    found = _lexicon(spark, d)
    return lex.valid_share(table(spark, d, "documents"), found, _known(found))


@query(_sql_valid("l.word IS NOT NULL AND k.word IS NULL", True) + "SELECT * FROM valid")
def q_valid_pct_strict(spark: SparkSession, d: str) -> DataFrame:
    found = _lexicon(spark, d)
    return lex.valid_share(table(spark, d, "documents"), found, _known(found), strict=True)


@query(_sql_valid("l.word IS NOT NULL", False) + f"SELECT doc_id, valid_pct, CASE WHEN valid_pct >= {GOOD} THEN 'good' ELSE 'bad' END AS bucket FROM valid")
def q_valid_split(spark: SparkSession, d: str) -> DataFrame:
    return lex.split_by(q_valid_pct(spark, d), "valid_pct", GOOD).select("doc_id", "valid_pct", "bucket")


@query(
    _sql_valid("l.word IS NOT NULL", False)
    + """, long AS (
  SELECT d.lang AS grp, unnest(['valid_pct', 'total_words']) AS metric, unnest([v.valid_pct, v.total_words::DOUBLE]) AS v FROM documents d JOIN valid v ON v.doc_id = d.doc_id
) SELECT grp, metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25,
  round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM long GROUP BY grp, metric"""
)
def q_valid_describe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return lex.describe(docs.select("doc_id", "lang").join(q_valid_pct(spark, d), "doc_id"), F.col("lang"), "valid_pct", "total_words")


@query(_sql_valid("l.word IS NOT NULL", False) + "SELECT coalesce(round(avg(valid_pct), 6), 0.0) AS mean_valid_pct FROM valid")
def q_metric_mean(spark: SparkSession, d: str) -> DataFrame:
    return q_valid_pct(spark, d).agg(F.coalesce(F.round(F.avg("valid_pct"), 6), F.lit(0.0)).alias("mean_valid_pct"))


@query(f"WITH {SQL_LEXICON}, {SQL_PAIRED} SELECT word, array_to_string(translations, ',') AS translations FROM paired")
def q_lexicon_paired(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).select("word", F.array_join("translations", ",").alias("translations"))


@query(
    f"""WITH {SQL_LEXICON}, {SQL_PAIRED}
SELECT translation, string_agg(word, ',' ORDER BY word) AS words FROM (SELECT word, unnest(translations) AS translation FROM paired) GROUP BY translation"""
)
def q_dict_invert(spark: SparkSession, d: str) -> DataFrame:
    return lex.inverted(_paired(spark, d)).select("translation", F.array_join("words", ",").alias("words"))


def _sql_glossary(repeats: bool) -> str:
    grams = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, i, array_to_string(list_slice(t, i, i + {n - 1}), ' ') AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM cut WHERE len(t) >= {n})" for n in (3, 2, 1)
    )
    once = "" if repeats else ", min(i) AS i"
    group = "" if repeats else " GROUP BY doc_id, n, gram, translations"
    at = "doc_id, n, i, gram, translations" if repeats else f"doc_id, n{once}, gram, translations"
    return f"""WITH {SQL_LEXICON}, {SQL_PAIRED}, cut AS (SELECT doc_id, {sql_tokens("lower(text)")} AS t FROM documents), grams AS ({grams}),
met AS (SELECT {at} FROM grams JOIN paired ON word = gram{group}),
listed AS (SELECT doc_id, string_agg('- ' || gram || ': ' || array_to_string(translations, ', ') || chr(10), '' ORDER BY n DESC, i) AS glossary FROM met GROUP BY doc_id),
glossaries AS (SELECT d.doc_id, coalesce(glossary, '') AS glossary FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id)
"""


@query(_sql_glossary(False) + "SELECT * FROM glossaries")
def q_glossary(spark: SparkSession, d: str) -> DataFrame:
    return lex.glossary(table(spark, d, "documents"), _paired(spark, d))


@query(_sql_glossary(True) + "SELECT * FROM glossaries")
def q_glossary_repeat(spark: SparkSession, d: str) -> DataFrame:
    return lex.glossary(table(spark, d, "documents"), _paired(spark, d), repeats=True)


@query(
    _sql_glossary(False)
    + """SELECT d.doc_id, md5('Translate the text between the tags. Use the glossary.' || chr(10) || chr(10) || '<glossary>' || chr(10) || glossary || '</glossary>' || chr(10) || chr(10)
|| '<id_text>' || chr(10) || text || chr(10) || '</id_text>') AS prompt_md5, text AS id_text FROM documents d JOIN glossaries g ON g.doc_id = d.doc_id WHERE text IS NOT NULL"""
)
def q_prompt(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    made = lex.prompts(docs.select("doc_id", "text"), q_glossary(spark, d))
    return made.select("doc_id", F.md5("prompt_text").alias("prompt_md5"), between_tags(F.col("prompt_text"), "<id_text>\n", "\n</id_text>").alias("id_text"))


def _sql_matched(known: bool) -> str:
    own = "CASE WHEN k.word IS NULL THEN [s.word] ELSE [] END" if known else "[s.word]"
    join = "LEFT JOIN known k ON k.word = s.word" if known else ""
    more = f", {_SQL_FOREIGN}" if known else ""
    return f"""WITH {SQL_LEXICON}, {SQL_PAIRED}, {SQL_PAIRS}{more}, s AS (SELECT pair_id, {sql_words("ref")} AS there, unnest({sql_words("src")}) AS word FROM pairs),
met AS (SELECT pair_id, there, coalesce(p.translations, {own}) AS t FROM s LEFT JOIN paired p ON p.word = s.word {join}),
hits AS (SELECT pair_id, count(*) AS n, count(*) FILTER (WHERE len(list_intersect(t, there)) > 0) AS m FROM met GROUP BY pair_id)
SELECT p.pair_id, coalesce(n, 0) AS total_words, coalesce(m, 0) AS matched_words, round(coalesce(m * 100.0 / n, 0.0), 6)::DOUBLE AS match_pct
FROM pairs p LEFT JOIN hits h ON h.pair_id = p.pair_id"""


@query(_sql_matched(False))
def q_bt_match(spark: SparkSession, d: str) -> DataFrame:
    return lex.matched(turn_pairs(spark, d), _paired(spark, d))


@query(_sql_matched(True))
def q_bt_match_known(spark: SparkSession, d: str) -> DataFrame:
    return lex.matched(turn_pairs(spark, d), _paired(spark, d), _known(_lexicon(spark, d)))


@query(
    f"""WITH {SQL_LEXICON}, {SQL_PAIRED}, {SQL_PAIRS}, s AS (
  SELECT pair_id, there, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT pair_id, {sql_words("ref")} AS there, {sql_words("src")} AS ws FROM pairs)
), met AS (SELECT pair_id, i, ws[i] AS word, there, translations FROM s LEFT JOIN paired p ON p.word = ws[i]),
cands AS (SELECT pair_id, i, there, translations[k] AS t, k FROM (SELECT *, unnest(range(1, len(translations) + 1)) AS k FROM met WHERE translations IS NOT NULL)),
near AS (SELECT pair_id, i, t, k, min(abs(j - i)) AS dist FROM (SELECT *, unnest(range(1, len(there) + 1)) AS j FROM cands) WHERE there[j] = t GROUP BY pair_id, i, t, k),
best AS (SELECT pair_id, i, t FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, i ORDER BY dist, k) AS rn FROM near) WHERE rn = 1),
joined AS (SELECT m.pair_id, string_agg(coalesce(b.t, m.translations[1], m.word), ' ' ORDER BY m.i) AS back FROM met m LEFT JOIN best b ON b.pair_id = m.pair_id AND b.i = m.i GROUP BY m.pair_id)
SELECT p.pair_id, coalesce(back, '') AS back FROM pairs p LEFT JOIN joined j ON j.pair_id = p.pair_id"""
)
def q_back_translate(spark: SparkSession, d: str) -> DataFrame:
    return lex.back_translated(turn_pairs(spark, d), _paired(spark, d))


_EDGE = r"[^\p{L}\p{N}_''`êÊ]"


@query(
    rf"""WITH {SQL_LEXICON}, {SQL_PAIRED}, target AS (SELECT word FROM lexicon WHERE lang = 'de'), cut AS (
  SELECT doc_id, regexp_extract_all(text, '\s+|[^ \t\n\f\r]+') AS ps, regexp_matches(text, '^\s') AS a, regexp_matches(text, '\s$') AS b FROM documents WHERE text <> ''
), pieces AS (SELECT doc_id, list_concat(list_concat(CASE WHEN a THEN [''] ELSE [] END, ps), CASE WHEN b THEN [''] ELSE [] END) AS ps FROM cut),
each AS (SELECT doc_id, i, ps[i] AS piece FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM pieces)),
cleaned AS (SELECT *, regexp_replace(piece, '{_EDGE}', '', 'g') AS clean, regexp_matches(piece, '^\s+$') AS space FROM each),
marked AS (SELECT *, regexp_matches(clean, '^\p{{Ll}}+$') AS plain FROM cleaned),
met AS (
  SELECT m.*, t.word IS NOT NULL AS known, p.translations[1] AS fix FROM marked m LEFT JOIN target t ON m.plain AND t.word = m.clean LEFT JOIN paired p ON m.plain AND p.word = m.clean
), done AS (
  SELECT *, plain AND NOT known AND fix IS NOT NULL AS fixed, NOT space AND (NOT plain OR known) AS good,
         regexp_extract(piece, '^({_EDGE}*)', 1) || fix || regexp_extract(piece, '({_EDGE}*)$', 1) AS new FROM met
)
SELECT doc_id, string_agg(CASE WHEN fixed THEN new ELSE piece END, '' ORDER BY i) AS corrected_text,
       round(count(*) FILTER (WHERE good) * 100.0 / count(*) FILTER (WHERE NOT space), 6)::DOUBLE AS valid_pct,
       round((count(*) FILTER (WHERE NOT space) - count(*) FILTER (WHERE good) - count(*) FILTER (WHERE fixed)) * 100.0 / count(*) FILTER (WHERE NOT space), 6)::DOUBLE AS invalid_pct,
       round(count(*) FILTER (WHERE fixed) * 100.0 / count(*) FILTER (WHERE NOT space), 6)::DOUBLE AS corrected_pct, count(DISTINCT piece) FILTER (WHERE fixed) AS n_corrections
FROM done GROUP BY doc_id"""
)
def q_correct_text(spark: SparkSession, d: str) -> DataFrame:
    found = _lexicon(spark, d)
    done = lex.corrected(table(spark, d, "documents").where("text <> ''").select("doc_id", "text"), found.where("lang = 'de'").select("word"), _paired(spark, d))
    return done.withColumn("n_corrections", F.size("corrections").cast("long")).drop("corrections")


_T = f"toks AS (SELECT pair_id, {sql_tokens('lower(ref)')} AS r, {sql_tokens('lower(src)')} AS h FROM pairs)"


@query(f"WITH {SQL_PAIRS}, {_T} SELECT pair_id, CASE WHEN len(r) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct(r), list_distinct(h))) / len(list_distinct(r)), 6) END::DOUBLE AS overlap FROM toks")
def q_overlap(spark: SparkSession, d: str) -> DataFrame:
    return turn_pairs(spark, d).select("pair_id", F.round(scores.overlap(F.col("ref"), F.col("src")), 6).alias("overlap"))


def _sql_bleu() -> str:
    sides = " UNION ALL ".join(
        f"SELECT pair_id, {n} AS n, '{s}' AS side, array_to_string(list_slice({s}, i, i + {n - 1}), ' ') AS gram FROM (SELECT pair_id, {s}, unnest(range(1, len({s}) - {n - 2})) AS i FROM toks WHERE len({s}) >= {n})"
        for n in (1, 2, 3, 4) for s in "rh"
    )
    zero = lambda n: f"CASE WHEN coalesce(m{n}, 0) = 0 AND hl > 1 THEN 1 ELSE 0 END"
    part = []
    for n in (1, 2, 3, 4):
        zeros, total = " + ".join(zero(k) for k in range(1, n + 1)), f"greatest(1, hl - {n - 1})"
        part.append(f"CASE WHEN m{n} > 0 THEN ln(m{n} / {total}) WHEN hl > 1 THEN ln(ln(hl) / (pow(2.0, {zeros}) * 5 * {total})) ELSE 0.0 END / 4")
    return f"""WITH {SQL_PAIRS}, {_T}, grams AS ({sides}),
counts AS (SELECT pair_id, n, gram, least(count(*) FILTER (WHERE side = 'h'), count(*) FILTER (WHERE side = 'r')) AS c FROM grams GROUP BY pair_id, n, gram),
hits AS (SELECT pair_id, {", ".join(f"sum(c) FILTER (WHERE n = {n}) AS m{n}" for n in (1, 2, 3, 4))} FROM counts GROUP BY pair_id),
sized AS (SELECT t.pair_id, len(r) AS rl, len(h) AS hl, m1, m2, m3, m4 FROM toks t LEFT JOIN hits USING (pair_id))
SELECT pair_id, CASE WHEN coalesce(m1, 0) = 0 THEN 0.0 ELSE round(exp({" + ".join(part)} + CASE WHEN hl > rl THEN 0.0 ELSE 1 - rl / hl END), 6) END::DOUBLE AS bleu FROM sized"""


@query(_sql_bleu())
def q_bleu(spark: SparkSession, d: str) -> DataFrame:
    return scores.bleu(turn_pairs(spark, d).withColumnRenamed("src", "hyp"))


@query()
def q_wer(spark: SparkSession, d: str) -> DataFrame:
    """Without SQL: the edit distance of long word lists is compared with a plain table of distances in the tests."""
    done = scores.wer(turn_pairs(spark, d).withColumnRenamed("src", "hyp"))
    return done.select("pair_id", F.round("wer", 6).alias("wer"))


_EDITS = "CASE WHEN quality = 1 THEN 'a -> b' ELSE 'a -> b' || chr(10) || 'c -> d' END"
_MORE = "CASE WHEN toxic = 1 THEN 'x -> y' || chr(10) || 'z -> w' || chr(10) || 'v -> u' END"
_JUDGED = "CASE WHEN quality = 1 AND toxic = 0 THEN 'Sangat Baik' WHEN quality = 1 THEN 'Dapat Diterima' WHEN toxic = 1 THEN 'Dapat diterima.' ELSE 'Buruk' END"
_SQL_EDITS = f"edits AS (SELECT doc_id, greatest(len(string_split({_EDITS}, '->')) - 1, coalesce(len(string_split({_MORE}, '->')) - 1, 0)) AS n_edits, {_JUDGED} AS judged FROM labels)"


def _edits(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "labels").select("doc_id", F.expr(_EDITS.replace("chr(10)", "'\\n'")).alias("a"), F.expr(_MORE.replace("chr(10)", "'\\n'")).alias("b"), F.expr(_JUDGED).alias("judged"))
    return notes.select("doc_id", scores.edit_count(F.col("a"), F.col("b")).cast("long").alias("n_edits"), "judged")


@query(f"WITH {_SQL_EDITS} SELECT doc_id, n_edits FROM edits")
def q_edit_count(spark: SparkSession, d: str) -> DataFrame:
    return _edits(spark, d).select("doc_id", "n_edits")


@query(
    f"""WITH {_SQL_EDITS}, n AS (SELECT doc_id, len({sql_tokens("text")}) AS w FROM documents WHERE text IS NOT NULL)
SELECT e.doc_id, CASE WHEN judged = 'Sangat Baik' THEN 'Good' WHEN judged = 'Buruk' THEN 'Bad' WHEN n_edits = 0 THEN 'Good'
WHEN w > 0 AND n_edits * 100.0 / w <= 25 THEN 'Acceptable (<25%)' ELSE 'Bad' END AS verdict FROM edits e JOIN n ON n.doc_id = e.doc_id"""
)
def q_verdict(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    sized = table(spark, d, "documents").where("text is not null").select("doc_id", n.alias("w"))
    return _edits(spark, d).join(sized, "doc_id").select("doc_id", scores.verdict(F.col("judged"), F.col("n_edits"), F.col("w")).alias("verdict"))


@query(f"WITH {SQL_LEXICON}, {SQL_PAIRED} SELECT word, word || ':' || chr(10) || array_to_string(list_transform(translations, lambda t: '  - ' || t || chr(10)), '') AS entry FROM paired")
def q_entry_text(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).select("word", lex.entry_text(F.col("word"), F.col("translations")).alias("entry"))


@query(f"WITH {SQL_LEXICON}, {SQL_PAIRED} SELECT 'req_' || word || '_' || k AS request_id, word, k AS draw FROM paired, (SELECT unnest([1, 2]) AS k)")
def q_word_draws(spark: SparkSession, d: str) -> DataFrame:
    return lex.drawn(_paired(spark, d))


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def q_needs_translation(spark: SparkSession, d: str) -> DataFrame:
    """Lists that are empty, null or filled by the labels."""
    listed = lambda c: F.when(F.col(c) == 1, F.array(F.lit("word"))).when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>"))
    return table(spark, d, "labels").where(lex.needs_translation(listed("quality"), listed("toxic"))).select("doc_id")

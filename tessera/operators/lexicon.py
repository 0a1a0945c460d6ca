"""Word sets, bilingual lexicons, glossaries, and measures by them."""

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

from tessera.functions.text import clean_word, is_blank, leading_symbols, ngrams, tokens, trailing_symbols, words
from tessera.sources import folders
from tessera.sources.folders import bounded, checkpointed

#: White space as Spark's expressions know it, what is cut by it, and what correction works on: pieces of it and of the rest.
EDGES = tuple(" \t\n\x0b\f\r")
SPACE, PIECES = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile(r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+")
#: Characters that a Python worker sends at once, and distinct pieces that it keeps. Neither changes a result.
PIECE, CACHED = 1_000_000, 200_000


def frequent_words(docs: DataFrame, least: int = 20) -> DataFrame:
    """(lang, word, df): words that stand in at least `least` documents of a language."""
    each = docs.select("lang", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    return each.groupBy("lang", "word").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs, from which a vocabulary of subwords can be learned."""
    return docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def paired(lexicon: DataFrame, source: str, target: str) -> DataFrame:
    """(word, translations): words of two languages paired by rank of frequency, each with the target's words of its rank and the next."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "word"))
    ranked = lexicon.where(F.col("lang").isin(source, target)).select("lang", "word", rank.alias("r"))
    to = ranked.where(F.col("lang") == target).select(F.col("word").alias("t"), F.explode(F.array("r", F.col("r") - 1)).alias("r"), F.col("r").alias("own"))
    met = ranked.where(F.col("lang") == source).select("word", "r").join(to, "r")
    return met.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("own", "t"))), lambda x: x["t"]).alias("translations"))


def inverted(pairs: DataFrame) -> DataFrame:
    """(translation, words): for each translation the words that have it, in order."""
    each = pairs.select("word", F.explode("translations").alias("translation"))
    return each.groupBy("translation").agg(F.array_sort(F.collect_list("word")).alias("words"))


def valid_share(docs: DataFrame, lexicon: DataFrame, other: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(doc_id, total_words, valid_pct, invalid_pct) of docs (doc_id, lang, text): the share of words in their language's lexicon.

    With `other` (word), words in neither list count as valid too; with `strict` instead only those of the lexicon that aren't in
    the other list. Texts without words have 0.
    """
    each = docs.select("doc_id", "lang", F.explode_outer(words(F.col("text"))).alias("word"))
    met = each.join(bounded(lexicon.select("lang", "word").distinct().withColumn("known", F.lit(True))), ["lang", "word"], "left")
    known = F.coalesce("known", F.lit(False))
    if other is not None:
        met = met.join(bounded(other.select("word").distinct().withColumn("foreign", F.lit(True))), "word", "left")
        foreign = F.coalesce("foreign", F.lit(False))
        known = (known & ~foreign) if strict else (known | ~foreign)
    out = met.groupBy("doc_id").agg(F.count("word").alias("total_words"), F.count_if(F.col("word").isNotNull() & known).alias("good"))
    pct = F.when(F.col("total_words") > 0, F.col("good") * 100.0 / F.col("total_words")).otherwise(0.0)
    return out.select("doc_id", "total_words", F.round(pct, 6).alias("valid_pct"), F.round(F.when(F.col("total_words") > 0, 100.0 - pct).otherwise(0.0), 6).alias("invalid_pct"))


def split_by(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """`df` with `bucket`: good from the threshold on, else bad; a missing value counts as 0."""
    return df.withColumn("bucket", F.when(F.coalesce(F.col(column), F.lit(0.0)) >= threshold, "good").otherwise("bad"))


def describe(df: DataFrame, group: Column, *columns: str) -> DataFrame:
    """Count, mean, standard deviation, least, quartiles and greatest of each column by group, one row a group and column."""
    long = df.select(group.alias("grp"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select("grp", "m.metric", "m.v")
    q = {f"p{int(p * 100)}": F.round(F.percentile("v", p), 6) for p in (0.25, 0.5, 0.75)}
    return long.groupBy("grp", "metric").agg(
        F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("min"), *[x.alias(k) for k, x in q.items()], F.max("v").alias("max")
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[str | None]]]:
    """(doc_id, texts) of rows in the order of doc_id: one text, unless the id stands there again."""
    last, texts = None, []
    for batch in batches:
        column = batch.column(1)
        for at, key in enumerate(batch.column(0).to_pylist()):
            if texts and key != last:
                yield last, texts
                texts = []
            last = key
            texts.append(column[at].as_py())
    if texts:
        yield last, texts


def _over_documents(docs: DataFrame, text: Column, maker: Callable[[], Callable[[object, list[str | None]], list[tuple]]], **columns: str) -> DataFrame:
    """(doc_id, columns) of the rows that what `maker` gives a task makes of an id and its texts. The texts are shuffled once, and their parts never."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *[StructField(k, DataType.fromDDL(v)) for k, v in columns.items()]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, made, weight = maker(), [], 0
        for key, texts in _documents(batches):
            made += of(key, texts)
            weight += 100 + sum(len(t) for t in texts if t)
            if weight >= PIECE and made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)
                made, weight = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    rows = docs.select("doc_id", text.alias("text")).repartition("doc_id").sortWithinPartitions("doc_id")
    return rows.mapInArrow(run, schema)


def _sent(table: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """A table of two columns written once, and, if it has at most BROADCAST_ROWS rows, a dictionary of it for the Python workers."""
    done = checkpointed(table)
    return done, table.sparkSession.sparkContext.broadcast(dict(map(tuple, done.toLocalIterator()))) if done.count() <= folders.BROADCAST_ROWS else None


def glossary(docs: DataFrame, pairs: DataFrame, repeats: bool = False) -> DataFrame:
    """(doc_id, glossary): the lexicon's entries for the three-, two- and one-word runs of a lower-cased text, in order.

    A line "- run: a, b" for each; with `repeats` once for each occurrence, else once. A lexicon of more than BROADCAST_ROWS
    words is joined by shuffling all runs.
    """
    row = F.concat(F.lit("- "), F.col("word"), F.lit(": "), F.array_join("translations", ", "), F.lit("\n"))
    rows = F.collect_list("row") if repeats else F.collect_set("row")
    lines = pairs.where("word is not null").where(F.size("translations") > 0).select("word", row.alias("row")).groupBy("word").agg(F.array_join(F.array_sort(rows), "").alias("row"))
    lines, sent = _sent(lines)
    if sent is None:
        return _joined_glossary(docs, lines, repeats)
    lengths = [n for n in (3, 2, 1) if any(w.count(" ") == n - 1 for w in sent.value)]

    def listed(key: object, texts: list[str | None]) -> list[tuple]:
        if key is None:
            return [(key, "")] * len(texts)
        known, out = sent.value, []
        cut = [[p for p in SPACE.split(t) if p] for t in texts if t is not None]
        for n in lengths:
            runs = [parts if n == 1 else [" ".join(parts[i : i + n]) for i in range(len(parts) - n + 1)] for parts in cut]
            met = [[(g, i) for i, g in enumerate(r) if g in known] for r in runs]
            if not repeats:
                met = [[(g, i) for g, i in dict(reversed(m)).items()] for m in met]
                least: dict[str, int] = {}
                for g, i in chain(*met):
                    least[g] = min(i, least.get(g, i))
                met = [list(least.items())]
            out += [x for _, x in sorted((i, known[g]) for g, i in chain(*met))]
        return [(key, "".join(out))] * len(texts)

    return _over_documents(docs, F.lower("text"), lambda: listed, glossary="string")


def _joined_glossary(docs: DataFrame, lines: DataFrame, repeats: bool) -> DataFrame:
    """glossary() by lines (word, row) of any number."""
    cut = docs.select("doc_id", tokens(F.lower(F.col("text"))).alias("parts"))

    def placed(n: int) -> Column:
        return F.transform(ngrams(F.col("parts"), n), lambda g, i: F.struct(F.lit(-n).alias("n"), i.alias("i"), g.alias("gram")))

    each = cut.select("doc_id", F.explode(F.flatten(F.array(*map(placed, (3, 2, 1))))).alias("g")).select("doc_id", "g.n", "g.i", "g.gram")
    met = each.join(lines, F.col("gram") == F.col("word")).select("doc_id", "n", "i", "gram", "row")
    if not repeats:
        met = met.groupBy("doc_id", "n", "gram", "row").agg(F.min("i").alias("i"))
    listed = met.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "i", "row"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["row"]), "")
    return docs.select("doc_id").join(listed, "doc_id", "left").select("doc_id", F.coalesce(text, F.lit("")).alias("glossary"))


def prompts(docs: DataFrame, glossaries: DataFrame) -> DataFrame:
    """(doc_id, prompt_text): the text in its case, behind its glossary."""
    head = F.lit("Translate the text between the tags. Use the glossary.\n\n")
    whole = F.concat(head, F.lit("<glossary>\n"), F.col("glossary"), F.lit("</glossary>\n\n<id_text>\n"), F.col("text"), F.lit("\n</id_text>"))
    return docs.join(glossaries, "doc_id").select("doc_id", whole.alias("prompt_text"))


def matched(pairs: DataFrame, lexicon: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(pair_id, total_words, matched_words, match_pct) of pairs (pair_id, src, ref): source words of which a translation stands in the reference.

    A word without translations stands for itself, unless it is among the `known` (word).
    """
    each = pairs.select("pair_id", F.array_distinct(words(F.col("ref"))).alias("there"), F.explode_outer(words(F.col("src"))).alias("word"))
    met = each.join(bounded(lexicon), "word", "left")
    own = F.array("word")
    if known is not None:
        met = met.join(bounded(known.select("word").distinct().withColumn("known", F.lit(True))), "word", "left")
        own = F.when(F.col("known"), F.array().cast("array<string>")).otherwise(own)
    hit = F.arrays_overlap(F.when(F.size(F.coalesce("translations", F.array().cast("array<string>"))) > 0, F.col("translations")).otherwise(own), "there")
    out = met.groupBy("pair_id").agg(F.count("word").alias("total_words"), F.count_if(F.col("word").isNotNull() & hit & (F.size("there") > 0)).alias("matched_words"))
    pct = F.when(F.col("total_words") > 0, F.col("matched_words") * 100.0 / F.col("total_words")).otherwise(0.0)
    return out.select("pair_id", "total_words", "matched_words", F.round(pct, 6).alias("match_pct"))


def match_metrics(pairs: DataFrame, lexicon: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """matched() as five columns: percentages and counts of the words that match and that don't, and their number; all 0 if a side is blank."""
    blank = F.coalesce(is_blank(F.col("src")), F.lit(True)) | F.coalesce(is_blank(F.col("ref")), F.lit(True))
    some = matched(pairs.where(~blank), lexicon, known)
    n, m = F.coalesce("total_words", F.lit(0)).cast("long"), F.coalesce("matched_words", F.lit(0)).cast("long")
    pct = lambda x: F.round(F.when(n > 0, x * 100.0 / n).otherwise(0.0), 6)
    return pairs.select("pair_id").join(some, "pair_id", "left").select(
        "pair_id", pct(m).alias("bt_valid_match_percentage"), pct(n - m).alias("bt_invalid_match_percentage"), m.alias("bt_valid_match_count"),
        (n - m).alias("bt_invalid_match_count"), n.alias("bt_total_src_words"),
    )


def pair_metrics(pairs: DataFrame, lexicon: DataFrame, vocabulary: DataFrame, threshold: float = 25, known: DataFrame | None = None) -> DataFrame:
    """The metrics of annotated pairs in one table: match_metrics(), the share of source words in `vocabulary` (word), and whether that reaches the threshold."""
    each = pairs.select("pair_id", F.explode_outer(words(F.col("src"))).alias("word"))
    met = each.join(bounded(vocabulary.select("word").distinct().withColumn("there", F.lit(True))), "word", "left")
    share = met.groupBy("pair_id").agg(F.round(F.coalesce(F.count_if("there") * 100.0 / F.nullif(F.count("word"), F.lit(0)), F.lit(0.0)), 6).alias("valid_pct"))
    return match_metrics(pairs, lexicon, known).join(share, "pair_id").withColumn("reaches", F.col("valid_pct") >= threshold)


def back_translated(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(pair_id, back): each source word replaced by the translation that stands nearest to its place in the reference.

    Of equally near ones the first listed; if none stands there the first listed; a word without translations stays.
    """
    each = pairs.select("pair_id", words(F.col("ref")).alias("there"), F.posexplode(words(F.col("src"))).alias("i", "word"))
    met = each.join(bounded(lexicon.where(F.size("translations") > 0)), "word", "left")
    places = lambda t: F.filter(F.transform("there", lambda x, k: F.when(x == t, F.abs(k - F.col("i")))), lambda d: d.isNotNull())
    near = F.filter(F.transform("translations", lambda t, k: F.struct(F.array_min(places(t)).alias("d"), k.alias("k"), t.alias("t"))), lambda s: s["d"].isNotNull())
    chosen = F.coalesce(F.array_min(near)["t"], F.get("translations", F.lit(0)), F.col("word"))
    listed = met.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("i", chosen.alias("w")))).alias("ws"))
    return pairs.select("pair_id").join(listed, "pair_id", "left").select("pair_id", F.coalesce(F.array_join(F.transform("ws", lambda x: x["w"]), " "), F.lit("")).alias("back"))


def corrected(docs: DataFrame, target: DataFrame, reverse: DataFrame) -> DataFrame:
    """(doc_id, corrected_text, valid_pct, invalid_pct, corrected_pct, corrections) of docs (doc_id, text).

    Between runs of white space, which stay, a piece of lower-case letters only (symbols aside) is valid if the target list (word) has it, replaced
    by its first translation in the reverse lexicon (word, translations), its symbols around it, or else invalid. Any other piece is valid, also
    the empty one before leading or after trailing white space.
    """
    known, fixes = target.select(F.col("word").alias("key"), F.lit(True).alias("known")), reverse.where(F.size("translations") > 0).select(F.col("word").alias("key"), F.get("translations", F.lit(0)).alias("to"))
    (known, listed), (fixes, replaced) = (_sent(t.where("key is not null")) for t in (known.distinct(), fixes.groupBy("key").agg(F.min("to").alias("to"))))
    done = _joined_correction(docs, known, fixes) if listed is None or replaced is None else _over_documents(docs.where("text is not null"), F.col("text"), lambda: _corrector(listed, replaced), ws="string", n="long", good="long", new="long", corrections="array<string>")
    pct = lambda x: F.round(x * 100.0 / F.col("n"), 6)
    return done.select(
        "doc_id", F.col("ws").alias("corrected_text"), pct(F.col("good")).alias("valid_pct"), pct(F.col("n") - F.col("good") - F.col("new")).alias("invalid_pct"), pct(F.col("new")).alias("corrected_pct"), "corrections",
    )


def _corrector(listed: Broadcast, replaced: Broadcast) -> Callable[[object, list[str]], list[tuple]]:
    """What corrected() makes of a document, by a dictionary of valid words and one of replacements."""

    known, to = listed.value, replaced.value

    @lru_cache(CACHED)
    def judged(piece: str) -> tuple[str, str]:
        """(kind, what stands in its place) of a piece that is no white space."""
        if piece.isascii() and piece.isalpha():
            word, plain = piece, piece.islower()
        else:
            kinds = {c: unicodedata.category(c) for c in set(piece)}
            word = "".join([c for c in piece if kinds[c][0] in "LN" or c in "_'`êÊ"])
            plain = word != "" and all(kinds[c] == "Ll" for c in word)
        if not plain or word in known:
            return "good", piece
        if word not in to:
            return "bad", piece
        return "new", piece[: piece.index(word[0])] + to[word] + piece[piece.rindex(word[-1]) + 1 :]

    def corrected(key: object, texts: list[str]) -> list[tuple]:
        kinds, changed, placed = Counter(), set(), []
        for text in texts:
            pieces = PIECES.findall(text) or [""]
            if pieces[0][:1] in EDGES:
                pieces.insert(0, "")
            if pieces[-1][:1] in EDGES:
                pieces.append("")
            words = pieces[::2]  # every other piece is white space
            found = list(map(judged, words))
            kinds.update([kind for kind, _ in found])
            changed.update([f"{word} -> {out}" for word, (kind, out) in zip(words, found) if kind == "new"])
            pieces[::2] = [out for _, out in found]
            placed.append(pieces)
        whole = placed[0] if len(placed) == 1 else [x for _, x in sorted(chain(*map(enumerate, placed)))]
        return [(key, "".join(whole), kinds.total(), kinds["good"], kinds["new"], sorted(changed))]

    return corrected


def _joined_correction(docs: DataFrame, listed: DataFrame, fixes: DataFrame) -> DataFrame:
    """(doc_id, ws, n, good, new, corrections): what corrected() counts, by word lists (key, known) and (key, to) of any number."""
    text = F.col("text")
    cut = F.split(text, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")
    edge = lambda p: F.when(F.rlike(text, F.lit(p)), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(edge(r"^\s"), cut, edge(r"\s$"))
    each = docs.select("doc_id", F.posexplode(pieces).alias("i", "piece")).withColumn("clean", clean_word(F.col("piece")))
    plain = F.rlike("clean", F.lit(r"^\p{Ll}+$"))
    each = each.withColumn("space", F.rlike("piece", F.lit(r"^\s+$"))).withColumn("key", F.when(plain, F.col("clean")))
    met = each.join(listed, "key", "left").join(fixes, "key", "left")
    fixed = plain & F.col("known").isNull() & F.col("to").isNotNull()
    new = F.concat(leading_symbols(F.col("piece")), F.col("to"), trailing_symbols(F.col("piece")))
    met = met.withColumn("out", F.when(fixed, new).otherwise(F.col("piece"))).withColumn("fixed", fixed).withColumn("valid", ~F.col("space") & (~plain | F.col("known").isNotNull()))
    done = met.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "out"))).alias("ws"), F.count_if(~F.col("space")).alias("n"), F.count_if("valid").alias("good"), F.count_if("fixed").alias("new"),
        F.array_sort(F.collect_set(F.when(F.col("fixed"), F.concat("piece", F.lit(" -> "), "out")))).alias("corrections"),
    )
    return done.withColumn("ws", F.array_join(F.transform("ws", lambda x: x["out"]), ""))


def entry_text(word: Column, translations: Column) -> Column:
    """An entry as lines: the word, and its translations below it."""
    return F.concat(word, F.lit(":\n"), F.array_join(F.transform(translations, lambda t: F.concat(F.lit("  - "), t, F.lit("\n"))), ""))


def needs_translation(source: Column, target: Column) -> Column:
    """Whether an entry has translations in one list and none in the other."""
    none = F.array().cast("array<string>")
    return (F.size(F.coalesce(source, none)) > 0) & (F.size(F.coalesce(target, none)) == 0)


def drawn(lexicon: DataFrame, times: int = 2) -> DataFrame:
    """(request_id, word, draw): each word so many times, in place of draws until all have come up as often."""
    each = lexicon.select("word", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("draw"))
    return each.select(F.concat(F.lit("req_"), "word", F.lit("_"), F.col("draw").cast("string")).alias("request_id"), "word", "draw")

"""Small cases worked out by hand, and properties."""

import pytest
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import payload, text
from tessera.operators import dedup, lexicon, lid, mcqa, packing, scores, tables, topics


def one(spark, value, **columns):
    """The value of an expression over one row of the given columns."""
    given = spark.createDataFrame([Row(**columns)]) if columns else spark.range(1)
    return given.select(value.alias("v")).first()["v"]


def pairs(spark, given):
    return spark.createDataFrame(list(given.items()), "word string, translations array<string>")


def word_table(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def test_glossary(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, None)], "doc_id long, text string")
    lex = pairs(spark, {"a": ["x"], "a b": ["y", "z"], "b c a": ["w"], "c": []})
    assert {r[0]: r[1] for r in lexicon.glossary(docs, lex).collect()} == {1: "- b c a: w\n- a b: y, z\n- a: x\n", 2: "", 3: ""}
    assert lexicon.glossary(docs, lex, repeats=True).where("doc_id = 1").first()[1] == "- b c a: w\n- a b: y, z\n- a: x\n- a: x\n"


def test_valid_share(spark):
    docs = spark.createDataFrame([(1, "l", "Aku, aku! 12 xx"), (2, "l", None), (3, "l", ""), (4, "l", "!!")], "doc_id long, lang string, text string")
    lex, xx, aku = spark.createDataFrame([("l", "aku")], "lang string, word string"), word_table(spark, "xx"), word_table(spark, "aku")
    pct = lambda *a, **k: {r["doc_id"]: r["valid_pct"] for r in lexicon.valid_share(docs, lex, *a, **k).collect()}
    assert pct() == {1: 50.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert pct(xx)[1] == 75.0 and pct(aku, strict=True)[1] == 0.0
    assert pct(word_table(spark))[1] == 100.0


def test_matched(spark):
    given = spark.createDataFrame([("p", "bok tiang bagus", "rambut saya bagus"), ("q", None, "x"), ("r", "x", "")], "pair_id string, src string, ref string")
    lex = pairs(spark, {"bok": ["rambut"], "tiang": ["aku"]})
    assert {r["pair_id"]: r["match_pct"] for r in lexicon.matched(given, lex).collect()} == {"p": 66.666667, "q": 0.0, "r": 0.0}
    assert lexicon.matched(given, lex, word_table(spark, "bagus")).where("pair_id = 'p'").first()["match_pct"] == 33.333333


def test_back_translated(spark):
    given = spark.createDataFrame([("near", "p q", "b a b"), ("tie", "o p", "a x b")], "pair_id string, src string, ref string")
    done = {r[0]: r[1] for r in lexicon.back_translated(given, pairs(spark, {"p": ["a", "b"], "q": ["z", "y"]})).collect()}
    assert done == {"near": "b z", "tie": "o a"}


def test_corrected(spark):
    docs = spark.createDataFrame([(1, " Halo tiang xyz don't")], "doc_id long, text string")
    r = lexicon.corrected(docs, word_table(spark, "tiang"), pairs(spark, {"xyz": ["abc"]})).first()
    assert (r["corrected_text"], r["valid_pct"], r["invalid_pct"], r["corrected_pct"], r["corrections"]) == (" Halo tiang abc don't", 80.0, 0.0, 20.0, ["xyz -> abc"])


def test_scores(spark):
    assert one(spark, scores.overlap(F.lit("a a b"), F.lit("b c"))) == 0.5 and one(spark, scores.overlap(F.lit(""), F.lit("b"))) == 0.0
    assert one(spark, scores.edit_count(F.lit("x -> y\nz -> w"), F.lit("q -> r"))) == 2 and one(spark, scores.edit_count(F.lit(None).cast("string"))) == 0
    said = {("Dapat Diterima", 0, 5): "Good", ("Dapat Diterima", 2, 8): "Acceptable (<25%)", ("Dapat Diterima", 2, 7): "Bad", ("Dapat Diterima", 1, 0): "Bad", ("Sangat Baik", 1, 1): "Good", ("Buruk", 0, 9): "Bad", (None, 0, 1): "Unknown", ("lainnya", 0, 1): "Human Other"}
    for (judged, edits, n), want in said.items():
        assert one(spark, scores.verdict(F.lit(judged).cast("string"), F.lit(edits), F.lit(n))) == want


def test_wer_against_a_table(spark):
    import random

    rng = random.Random(1)
    given = [(str(k), " ".join(rng.choices("abc", k=rng.randint(0, 9))), " ".join(rng.choices("abc", k=rng.randint(0, 9)))) for k in range(60)] + [("n", None, None)]

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1] / len(a) if a else float(len(b) > 0)

    found = {r["pair_id"]: r["wer"] for r in scores.wer(spark.createDataFrame(given, "pair_id string, ref string, hyp string")).collect()}
    assert found == {k: slow((r or "").split(), (h or "").split()) for k, r, h in given}


def test_bleu_of_the_same(spark):
    given = spark.createDataFrame([("same", "a b c d e", "a b c d e"), ("none", "a b", "x y"), ("empty", "", "")], "pair_id string, ref string, hyp string")
    assert {r[0]: r[1] for r in scores.bleu(given).collect()} == {"same": 1.0, "none": 0.0, "empty": 0.0}


def test_language_filters(spark):
    de, en = "der Hund und die Katze nicht", "the dog and the cat"
    cases = {f"{de}": (True, True, True), f"{de}\n{en}": (False, True, False), f"{de}\n{de}\n{en}": (True, True, True), f"{en}\n{de}\n": (False, True, False), "": (True, True, False)}
    for value, want in cases.items():
        found = tuple(one(spark, f(F.lit(value), ["de"])) for f in (lid.both_lines, lid.either_line, lid.most_lines))
        assert found == want, value
    assert one(spark, lid.both_lines(F.lit(None).cast("string"), ["de"])) is False
    p = one(spark, lid.probabilities(F.lit(de), ["de", "en", "nothing"]))
    assert [x["lang"] for x in p] == ["de", "en"] and abs(sum(x["p"] for x in p) - 1) < 1e-9
    assert sum(x["p"] for x in one(spark, lid.probabilities(F.lit(de), ["de", "en"], limit_before=False))) < 1


def test_questions(spark):
    options = one(spark, mcqa.parsed_options(F.lit("['A. foo.bar', 'B. baz']")))
    assert (options["label"], options["text"]) == (["a", "b"], ["foo.bar", "baz"])
    choices = lambda labels, texts: F.struct(F.array(*map(F.lit, labels)).cast("array<string>").alias("label"), F.array(*map(F.lit, texts)).cast("array<string>").alias("text"))
    for labels, texts, answer, want in [("aa", "x", "z", "mismatched_label_text"), ("aa", "xy", "a", "duplicate_labels"), ("ab", "xy", "z", "gold_not_in_labels"), ("", "", "a", "no_labels"), ("ab", "xy", "b", None)]:
        assert one(spark, mcqa.problem(choices(labels, texts), F.lit(answer))) == want
    assert one(spark, mcqa.pick(F.array(F.lit("b"), F.lit("a")), F.create_map(F.lit("a"), F.lit(-1.0), F.lit("b"), F.lit(-1.0)))) == "b"
    for values, want in ((range(1, 21), 19), (range(1, 5), 4)):
        assert spark.createDataFrame([(float(v),) for v in values], "ms double").agg(*mcqa.latency(F.col("ms"))).first()["p95"] == want
    assert one(spark, mcqa.prompt(F.lit(None).cast("string"), F.lit(" q? "), choices("ab", "xy"), "Do. ", "Answer: ")) == "Do.\n\nq?\na. x\nb. y\n\nAnswer: "


def test_payload(spark):
    for raw, want in (('```json\n{"a":1}\n```', '{"a":1}'), ("Sure: [1,2]", '{"items": [1,2]}'), ("none", None)):
        assert one(spark, payload.payload(F.lit(raw))) == want
    for raw, want in (('{"t":"ab"}', "ab"), ('{"t":["a","b"]}', "ab"), ('{"t":5}', None), ("broken", None)):
        assert one(spark, payload.text_or_list(F.lit(raw), "t")) == want


def test_packing(spark):
    docs = spark.createDataFrame([(1, [1, 2, 3]), (2, [4]), (3, [5, 6]), (4, [])], "rn long, ids array<int>")
    of = lambda n: [r["input_ids"] for r in packing.packed(docs, 4, 0, n).orderBy("batch", "block").collect()]
    assert of(1000) == [[1, 2, 3, 0], [4, 0, 5, 6]] and of(2) == [[1, 2, 3, 0]]
    long = spark.createDataFrame([(1, list(range(10))), (2, [1]), (3, [])], "doc_id long, ids array<int>")
    w = packing.windows(long, 8, 2).orderBy("start").collect()
    assert [r["start"] for r in w] == [0, 2, 4, 6, 8] and [r["n_pred"] for r in w] == [2, 2, 2, 2, 1]
    assert [r["n_pred"] for r in packing.windows(long, 8, 2, drop_first=True).orderBy("start").collect()] == [0, 2, 2, 2, 1]
    with pytest.raises(Exception, match="vocabulary"):
        packing.in_vocabulary(long, 5).collect()
    assert one(spark, packing.left_truncated(F.array(*map(F.lit, range(5))), 3)) == [3, 4]
    assert packing.steps(1000, 2, 4, 1.5, 10, 4) == (188, 50)


def test_tables(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (1, "c", 3)], "id long, v string, at long")
    assert sorted((r["id"], r["v"]) for r in tables.last_by(df, "id", "at").collect()) == [(1, "c"), (2, "b")]
    topics_ = spark.createDataFrame([(0, "A"), (1, "a "), (2, " "), (3, "b")], "at long, t string")
    assert sorted((r["pos"], r["t"]) for r in tables.first_distinct(topics_, "t", "at").collect()) == [(0, "A"), (3, "b")]
    assert sorted(r["t"] for r in tables.first_distinct(topics_, "t", "at", fold_case=False).collect()) == ["A", "a", "b"]
    train = spark.createDataFrame([(" x ",), ("y",), (None,)], "text string")
    assert [r[0] for r in tables.without_texts(train, spark.createDataFrame([("x",)], "text string"), trimmed=True).collect()] == ["y"]
    with pytest.raises(Exception, match="no v"):
        tables.looked_up(spark.createDataFrame([(9,)], "id long"), df.where("at = 1"), "id", "v", "raise").collect()


def test_topics(spark):
    tree = spark.createDataFrame([(0, " T ", [(" s ", []), ("u", ["q0", "q1"])])], "idx int, topic string, subtopics array<struct<title: string, questions: array<string>>>")
    assert sorted(tuple(r) for r in topics.flattened(tree).collect()) == [("topic0000-sub001-q000", "T", "u", "q0"), ("topic0000-sub001-q001", "T", "u", "q1")]
    assert one(spark, topics.custom_id(F.lit(0), F.lit(1), F.lit(2))) == "topic0000-sub001-q002"
    assert one(spark, topics.expanded(F.array(*map(F.lit, ["A", "a ", " ", "b", "c"])), 2)) == ["A", "b"]
    assert one(spark, topics.expanded(F.array(F.lit("A"), F.lit("a")), 2)) is None
    assert len(one(spark, topics.zipped(F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit("q")), F.array(F.lit("r")))))) == 2
    with pytest.raises(Exception, match="lengths"):
        one(spark, topics.zipped(F.array(F.lit("a")), F.array().cast("array<array<string>>")))
    told = spark.createDataFrame([("t", f"m{k}") for k in range(5)] + [("t", None), ("u", None)], "topic string, message string")
    assert [tuple(r) for r in topics.failures(told, "topic", "message").collect()] == [("t", 5, ["m0", "m1", "m2"])]


def test_text(spark):
    assert one(spark, text.strip(F.lit("\t a \n"))) == "a" and one(spark, text.checkpoint_step(F.lit("checkpoint-12"))) == 12 and one(spark, text.checkpoint_step(F.lit("final"))) is None
    assert one(spark, text.between_tags(F.lit("<a>x</a><a>y</a>"), "<a>", "</a>")) == "y"
    assert text.first_present(["x", "ban"], ("ban",)) == "ban" and text.first_present(["x", "y"], ("ban",)) is None and text.first_present(["x"], ()) == "x"


def test_deduplicated(spark):
    base = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(4, base), (2, base), (3, base + " more"), (1, "one two three four five six"), (5, "short"), (6, None), (7, "")], "doc_id long, text string")
    assert sorted(r[0] for r in dedup.deduplicated(docs).select("doc_id").collect()) == [1, 2, 5, 6, 7]
    again = dedup.deduplicated(dedup.deduplicated(docs))
    assert again.count() == 5


def test_tokenised_in_small_batches(spark, monkeypatch):
    """Many texts of a batch leave in parts, with nulls and empty texts in their places; what a worker holds is bounded by SENT."""
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else f"Le texte {i} " * (i % 40) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    wanted = [(r["doc_id"], r["n_tokens"], r["token_ids"]) for r in packing.tokenised(docs).collect()]
    assert [r[0] for r in wanted] == list(range(300)) and all((r[1] is None) == (t is None) for r, t in zip(wanted, texts))
    monkeypatch.setattr(packing, "SENT", 50)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
    parts = list(packing._encoder(packing.VOCABULARY)(iter([batch])))
    assert len(parts) > 10 and pa.Table.from_batches(parts).to_pydict() == dict(zip(("doc_id", "n_tokens", "token_ids"), map(list, zip(*wanted))))


def test_only_texts_that_share_a_band_are_written(spark, monkeypatch):
    """And a batch's bands are the same in chunks of any size."""
    some = [" ".join(f"w{i}x{k}" for k in range(5 + i)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate([*some, some[7], some[9] + " more"])), "doc_id long, text string")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "shingles": [[5, -7], [9], list(range(300))]})
    got = []
    for chunk in (1, 4, 1 << 16):
        monkeypatch.setattr(dedup, "CHUNK", chunk)
        got.append([b.to_pydict() for b in dedup._bands(24, 4)(iter([batch]))])
    assert got[0] == got[1] == got[2] and len(set(map(tuple, got[0][0]["bands"]))) == 3
    written = []
    monkeypatch.setattr(dedup, "checkpointed", lambda df: written.append(done := df.checkpoint()) or done)
    assert {(r["a"], r["b"]) for r in dedup.duplicate_pairs(docs).collect()} >= {(7, 40)}
    assert [df.count() for df in written if "shingles" in df.columns][0] < 10

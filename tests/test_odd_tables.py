"""Queries against their SQL over small tables of odd rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators import lexicon
from tessera.plans.catalog import ORACLES, QUERIES
from tessera.sources import folders
from tests.conftest import DATA
from tests.oracle import connection, differs


def compared(spark, folder, name, docs):
    """What differs over documents (text, lang), numbered from 1."""
    texts, langs = zip(*docs)
    pq.write_table(pa.table({"doc_id": pa.array(range(1, len(docs) + 1), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())}), folder / "documents.parquet")
    return differs(spark, connection(folder), QUERIES[name], ORACLES[name], str(folder))


def test_first_words_keep_their_digits(spark, tmp_path):
    texts = ["a +1 b", "0a0 b1 c", "a\n b", "\tA a", "a  b", " a b", "a", "", None, "a A b", "100 001"]
    assert compared(spark, tmp_path, "q_topic_expand", [(t, "en") for t in texts]) is None


def test_lexicon_file_gives_sharp_s_back(spark, tmp_path):
    docs = [("ß éa", "fr")] * 20 + [("ßen a", "de")] * 20
    for name in ("q_lexicon_file", "q_lexicon_words"):
        assert compared(spark, tmp_path, name, docs) is None


#: Words of two languages, odd white space, symbols, letters without case, and texts without words.
ODD = [
    ("le la les du", "fr"), ("der die das von", "de"), *[("le la zwei", "fr")] * 20, *[("der die das", "de")] * 20, ("  La  le,\n\nle le. ", "fr"), ("'le' (la) le-la lé \t", "fr"), (" ", "de"), ("\n", "fr"), ("Le LA der", "de"),
    ("`le` _la_ êla 中文 ½ a1 ǆ ſ le", "fr"), ("le la   le", "en"), (None, "fr"), ("zwei\rle\fla", None), ("«le» ¡la! der die", "es"),
]


@pytest.mark.parametrize("most", [1_000_000, 0])
@pytest.mark.parametrize("name", ["q_correct_text", "q_glossary", "q_glossary_repeat", "q_prompt"])
def test_documents_by_lexicons(spark, tmp_path, monkeypatch, name, most):
    """With the lexicon sent to the workers, and joined."""
    monkeypatch.setattr(folders, "BROADCAST_ROWS", most)
    assert compared(spark, tmp_path, name, ODD) is None


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_ids_that_stand_twice(spark, monkeypatch, most):
    monkeypatch.setattr(folders, "BROADCAST_ROWS", most)
    docs = spark.createDataFrame([(1, "b a"), (2, "a"), (1, "a c a"), (None, "a"), (3, None)], "doc_id long, text string")
    words = spark.createDataFrame([("a", ["x"]), ("b", ["y", "z"])], "word string, translations array<string>")
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert got(lexicon.glossary(docs, words)) == [(1, "- a: x\n- b: y, z\n")] * 2 + [(2, "- a: x\n"), (3, ""), (None, "")]
    assert got(lexicon.glossary(docs, words, repeats=True)) == [(1, "- a: x\n- b: y, z\n- a: x\n- a: x\n")] * 2 + [(2, "- a: x\n"), (3, ""), (None, "")]
    done = got(lexicon.corrected(docs, words.where("word = 'c'").select("word"), words))
    assert [r[0] for r in done] == [1, 2, None] and done[0][5] == ["a -> x", "b -> y"] and done[1][1] == "x"


@pytest.mark.parametrize("name", ["q_correct_text", "q_glossary", "q_glossary_repeat"])
def test_no_rows_of_words_are_shuffled(spark, name):
    """Shuffled is what the last stage reads: texts, once."""
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("RepartitionByExpression") == 1

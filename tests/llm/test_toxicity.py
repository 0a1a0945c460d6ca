from itertools import product

from tessera.llm import toxicity
from tests.llm.tools import ODD, docs, rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_all_distances():
    terms = ["moron", "morose", "pathetic", "scum"]
    lexicon = toxicity.Lexicon(terms, prefix=0)
    letters = "moren"
    for word in map("".join, product(letters, repeat=5)):
        want = min(((d, t) for t in terms if (d := distance(word, t)) <= toxicity.edits(t)), default=None)
        assert lexicon.match(word) == want, word
    for word in ("pathtic", "patheticc", "patetik", "phatetic", "pathology", "scam", ""):
        want = min(((d, t) for t in terms if (d := distance(word, t)) <= toxicity.edits(t)), default=None)
        assert lexicon.match(word) == want, word


def test_prefix_is_kept():
    assert toxicity.Lexicon(["moron"], prefix=1).match("boron") is None
    assert toxicity.Lexicon(["moron"], prefix=1).match("morn") == (1, "moron")
    assert toxicity.Lexicon([], ["worthy"]).match("worthi") is None


def test_documents(spark):
    given = [
        (1, "You are a pathetic moron."), (2, "you patthetic mroon idiott, you scum"), (3, 'He said the word "moron" is an insult'), (4, "A kind text about morning and harbour"),
        (5, "x " * 200_000 + "you pathetic idiot"), (5, "you pathetic idiot"), (6, "moronic? he quoted the word"),
    ] + [r for r in ODD if r[0] != 5]
    found = {r["doc_id"]: r for r in toxicity.toxic(docs(spark, given)).collect()}
    assert set(found) == {1, 2, 5} and found[1]["n_abusive"] == 2 and found[1]["terms"] == ["moron", "pathetic"]
    assert rows(toxicity.toxic(docs(spark, []))) == []


def test_frequent_neighbour_is_a_word_of_its_own(spark):
    given = [(k, "the morons of you, stupid idiots: trashy") for k in range(1)] + [(k, f"a scumm number {k}, you clowne") for k in range(10, 20)]
    found = {r["doc_id"] for r in toxicity.toxic(docs(spark, given)).collect()}
    assert found == {0}


def test_terms_are_learned(spark):
    given = [(k, f"word{k} zorgle friend{k} is kind{k * 7} and zorgle again{k * 3}") for k in range(20)] + [(k, f"good day{k} and a friend{k}") for k in range(20, 60)]
    labels = spark.createDataFrame([(k, 1, int(k < 20)) for k in range(60)] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.learned_terms(docs(spark, given), labels) == ["zorgle"]
    assert toxicity.learned_terms(docs(spark, given), labels.where("false")) == []


def test_copies_and_corpus_size_keep_a_misspelling(spark):
    one = "so you are patthetic and idiott to nobody"
    for copies in (1, 2, 3, 12):
        given = [(k, one) for k in range(copies)]
        assert {r["doc_id"] for r in toxicity.toxic(docs(spark, given)).collect()} == set(range(copies)), copies
    # commoner than the correct spelling, beside other hits
    given = [(k, f"note{k} about{k} him: a stupid mooron of kind{k}") for k in range(20)] + [(50 + k, f"day{k} then{k} you mooron again{k}") for k in range(20)]
    found = {r["doc_id"] for r in toxicity.toxic(docs(spark, given)).collect()}
    assert found == {r[0] for r in given}


def test_one_misspelled_hit_in_abusive_context(spark):
    given = [(1, "you pathettik one"), (2, "are you a 1diot"), (3, "you oron"), (4, "you scumm"), (5, "so dumbb you were"), (6, "a pathettik day"), (7, 'you wrote "pathettik" there')]
    assert {r["doc_id"] for r in toxicity.toxic(docs(spark, given)).collect()} == {1, 2, 3, 4, 5}

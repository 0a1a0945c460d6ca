import random
import time

import tiktoken
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from tessera.llm import bpe
from tests.llm.tools import ODD, docs, rows

RANKS = bpe.vocabulary(bpe.VOCABULARY)
OURS = bpe.Encoder(RANKS)
OTHER = tiktoken.Encoding("other", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@cases(st.lists(st.text(max_size=60), max_size=5))
def test_same_ids_as_another_encoder(texts):
    found = OURS.encode(texts)
    assert [x.tolist() for x in found] == [OTHER.encode_ordinary(t) for t in texts]
    assert [OURS.decode(x) for x in found] == texts


def test_long_words():
    rng = random.Random(2)
    texts = ["a" * 5000, "ab" * 3000, "".join(rng.choice("abcdeé 1\n") for _ in range(20_000)), "=" * 777 + "x"]
    assert [x.tolist() for x in OURS.encode(texts)] == [OTHER.encode_ordinary(t) for t in texts]


def test_words_of_a_megabyte():
    rng = random.Random(3)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(340_000))
    b64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    for text in ("a" * 1_000_000, "ab" * 500_000, cjk, b64):
        began = time.thread_time()
        (ids,) = OURS.encode([text])
        assert time.thread_time() - began < 60
        assert OURS.decode(ids) == text
        assert ids.tolist() == OTHER.encode_ordinary(text)


def test_both_ways_to_merge():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("abehint nrsé") for _ in range(rng.randint(2, 60))).encode()
        ids, n = OURS.merge([word])
        assert OURS.merge_long(word).tolist() == ids.tolist() and n.tolist() == [len(ids)]


def test_table(spark):
    given = docs(spark, [(1, "Hello world, été!"), (1, "again"), *ODD])
    done = bpe.encode(given)
    by = {(r["doc_id"], r["n_tokens"]): r for r in done.collect()}
    assert done.count() == 2 + len(ODD) and all(r["decodes"] for r in by.values() if r["token_ids"] is not None)
    assert by[5, 0]["token_ids"] is None and by[5, 0]["decodes"] is None and by[6, 0]["token_ids"] == []
    assert rows(bpe.decode(done)) == rows(given.select("doc_id", "text"))
    assert rows(bpe.encode(docs(spark, []))) == []

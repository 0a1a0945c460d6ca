import random
import tracemalloc

import numpy as np

from tessera.llm import bwt
from tessera.llm.common import words
from tests.llm.tools import ODD, docs, rows


def brute(texts, length):
    """(doc, start, end, first_doc) by a table of all passages."""
    split = [(i, words(t)) for i, t in texts if i is not None and t]
    where = {}
    for i, w in split:
        for k in range(len(w) - length + 1):
            where.setdefault(tuple(w[k : k + length]), set()).add(i)
    out = set()
    for i, w in split:
        run = None
        for k in range(len(w) - length + 1):
            owners = where[tuple(w[k : k + length])]
            if len(owners) > 1:
                if run and k <= run[1]:
                    run = (run[0], k + length, min(run[2], *owners))
                else:
                    if run:
                        out.add((i, *run))
                    run = (k, k + length, min(owners))
        if run:
            out.add((i, *run))
    return sorted(out)


def test_merge_orders_suffixes():
    rng = np.random.default_rng(1)
    shards = [np.concatenate([np.append(rng.integers(1, 4, rng.integers(3, 30)), 0) for _ in range(6)]) for _ in range(3)]
    depth = 6
    positions, shared = bwt.merged(shards, depth)
    text = np.concatenate(shards).tolist()

    def key(p):
        out = []
        for x in text[p : p + depth]:
            out.append(x)
            if x == 0:
                break
        return out

    assert sorted(positions.tolist()) == list(range(len(text)))
    keys = [key(p) for p in positions]
    assert keys == sorted(keys)
    for k in range(1, len(keys)):
        a, b = keys[k - 1], keys[k]
        n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j] or a[j] == 0), min(len(a), len(b)))
        assert shared[k] == min(n, depth)


def test_against_brute_force(spark):
    rng = random.Random(3)
    bank = [[rng.choice("abcdefgh") * 2 + str(rng.randint(0, 9)) for _ in range(rng.randint(8, 40))] for _ in range(12)]
    texts = []
    for i in range(60):
        parts = [[f"own{i}w{j}" for j in range(rng.randint(0, 6))] + rng.choice(bank) for _ in range(3)]
        texts.append((i, " ".join(w for p in parts for w in p)))
    texts += [(100, texts[3][1]), (101, texts[3][1]), (102, texts[3][1])] + ODD
    found = rows(bwt.repeated_passages(docs(spark, texts), length=8, gram=3, shard=150).select("doc_id", "start_word", "end_word", "first_doc"))
    assert found == brute(texts, 8)


def test_memory_of_a_merge():
    rng = np.random.default_rng(2)
    segments = []
    for _ in range(1000):
        one = rng.integers(1, 1 << 32, 3000, dtype=np.uint32)[np.minimum(rng.zipf(1.2, 100) - 1, 2999)]
        other = one.copy()
        other[rng.integers(100)] = 0
        segments += [one, other]
    owners = np.arange(len(segments)) + (1 << 40)
    tracemalloc.start()
    found = bwt.repeats(segments, owners, owners, 50, shard=1 << 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 * sum(map(len, segments))
    for k in range(0, len(segments), 2):
        at = int(np.flatnonzero(segments[k] != segments[k + 1])[0]) if (segments[k] != segments[k + 1]).any() else 100
        expected = [(a, b, int(owners[k])) for a, b in ((0, at), (at + 1, 100)) if b - a >= 50]
        assert found[k] == found[k + 1] == expected


def test_nothing(spark):
    assert rows(bwt.repeated_passages(docs(spark, []))) == []

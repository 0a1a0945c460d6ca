import random

from tessera.llm import minhash
from tests.llm.tools import ODD, docs, rows


def brute(given, threshold=minhash.THRESHOLD):
    sets = {}
    for i, t in given:
        if i is not None and t is not None and len(s := minhash.shingles(t)):
            sets[i] = set(s.tolist())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, find(i)) for i in ids if find(i) != i)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    given = []
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 120))]
        for _ in range(rng.choice((1, 2, 3, 9))):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = f"new{rng.random()}"
            given.append((1000 - len(given), " ".join(text)))
    given += [(2000 + k, given[0][1]) for k in range(5)] + ODD + [(3000, "one two"), (3001, "One, two!")]
    found = rows(minhash.near_duplicates(docs(spark, given)).select("doc_id", "duplicate_of"))
    want = brute(given)
    assert set(found) <= set(want) and len(found) >= 0.95 * len(want)


def test_signatures_are_circulant():
    sets = [minhash.shingles(" ".join(f"a{k}" for k in range(n, n + 400))) for n in (0, 40, 4000)]
    s = minhash.signatures(sets, 256)
    near, far = (s[0] == s[1]).mean(), (s[0] == s[2]).mean()
    true = len(set(sets[0].tolist()) & set(sets[1].tolist())) / len(set(sets[0].tolist()) | set(sets[1].tolist()))
    assert abs(near - true) < 0.12 and far < 0.05
    assert (minhash.signatures(sets[1:], 256) == s[1:]).all()


def test_chain_beyond_the_least(spark):
    """b and c are alike and share a's bucket without being like a: they still are found."""
    words = [f"t{k}" for k in range(100)]
    a, b, c = words[:], words[:], words[:]
    for k in range(0, 100, 12):
        b[k] = c[k] = f"z{k}"
    c[1] = "q"
    given = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    assert rows(minhash.near_duplicates(docs(spark, given), bands=40, rows=1).select("doc_id", "duplicate_of")) == brute(given)


def test_keep_one(spark):
    given = docs(spark, [(3, "a b c d e f"), (2, "A b c, d e f"), (1, "other words in here now"), *ODD])
    kept = minhash.keep_one(given)
    assert kept.columns == given.columns
    assert sorted(i for (i,) in kept.select("doc_id").collect() if i is not None) == [1, 2, 5, 6, 7, 8, 9] and kept.where("doc_id is null").count() == 2
    clash = given.withColumnsRenamed({"key": "__gone", "a": "row", "b": "id", "start": "rank", "content": "tie"})
    assert rows(minhash.keep_one(clash).select("doc_id")) == rows(kept.select("doc_id")) and minhash.keep_one(clash).columns == clash.columns
    twice = docs(spark, [(1, "b text of its own"), (1, "a text of its own here"), (1, None), (2, "z"), (2, "y"), (2, "y")])
    assert rows(minhash.keep_one(twice).select("doc_id", "text")) == [(1, None), (2, "y")]
    assert rows(minhash.near_duplicates(docs(spark, []))) == [] and rows(minhash.keep_one(docs(spark, []))) == []


def test_copies_with_a_tenth_of_the_words_replaced(spark):
    rng = random.Random(11)
    given = []
    for group in range(60):
        base = [f"g{rng.randrange(5000)}" for _ in range(200)]
        text = list(base)
        for k in rng.sample(range(200), 20):
            text[k] = f"new{rng.random()}"
        given += [(2 * group, " ".join(base)), (2 * group + 1, " ".join(text))]
    found = rows(minhash.near_duplicates(docs(spark, given)).select("doc_id", "duplicate_of"))
    assert set(found) <= {(2 * g + 1, 2 * g) for g in range(60)} and len(found) >= 0.95 * 60


def test_recall_at_the_threshold():
    rng = random.Random(12)
    shared = 0
    for _ in range(400):
        both = [rng.getrandbits(64) for _ in range(300)]
        a, b = (minhash.np.unique(minhash.np.array(both[:200] + [rng.getrandbits(64) for _ in range(100)], minhash.np.uint64)) for _ in range(2))
        s = minhash.signatures([a, b], minhash.BANDS * minhash.ROWS).reshape(2, minhash.BANDS, minhash.ROWS)
        shared += (s[0] == s[1]).all(1).any()
    assert shared >= 0.95 * 400  # 200 of 400 shingles are common


def test_chain_beyond_the_least_at_a_higher_threshold(spark):
    words = [f"t{k}" for k in range(100)]
    a, b, c = words[:], words[:], words[:]
    for k in range(0, 100, 12):
        b[k] = c[k] = f"z{k}"
    c[1] = "q"
    given = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    found = rows(minhash.near_duplicates(docs(spark, given), threshold=0.7, bands=40, rows=1).select("doc_id", "duplicate_of"))
    assert found == brute(given, 0.7) == [(3, 2)]

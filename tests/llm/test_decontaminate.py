import random

from tessera.llm import decontaminate as dec
from tessera.llm.common import hashes, words
from tests.llm.tools import ODD, docs, rows


def brute(texts, items, least=dec.MIN_MATCH):
    """(doc, item, matched) with every alignment tried that has a mask's words in common."""
    out = []
    for i, t in texts:
        w = words(t or "") if i is not None else []
        for j, u in items:
            v = words(u or "") if j is not None else []
            best = 0
            for shift in range(-len(v) + 1, len(w)):
                same = {k for k in range(len(v)) if 0 <= k + shift < len(w) and w[k + shift] == v[k]}
                if len(v) < dec._SPAN:
                    hit = len(same) == len(v) and v
                else:
                    hit = any(all(k + p in same for p in places) for k in range(len(v) - dec._SPAN + 1) for places in dec._PLACES)
                if hit:
                    best = max(best, dec.overlap(hashes(w), hashes(v), shift)[1])
            if best >= min(least, len(v)) and best:
                out.append((i, j, best))
    return sorted(out)


def made():
    rng = random.Random(4)
    word = lambda: f"v{rng.randint(0, 5000)}"
    items = [(j, " ".join(word() for _ in range(rng.randint(14, 60)))) for j in range(12)] + [(50, "only four words here"), (51, ""), (52, None), (None, "no id at all")]
    texts = []
    for i in range(40):
        own = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            part = words(items[i % 12][1])
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "changed"
            own[len(own) // 2 : len(own) // 2] = part[: rng.randint(10, 60)]
        texts.append((i, " ".join(own)))
    return texts + [(90, "x " * 50_000 + items[0][1]), (91, "so only four words here."), *[r for r in ODD if r[0] != 9]], items


def test_against_brute_force_both_ways(spark):
    texts, items = made()
    test = spark.createDataFrame([(j, u, 1, "x") for j, u in items], "item_id long, text string, doc_id long, seed string")
    small = [(i, t) for i, t in texts if i != 90]
    want = brute(small, items)
    found = dec.contaminated(docs(spark, texts), test)
    assert [r for r in rows(found.select("doc_id", "item_id", "matched_words")) if r[0] != 90] == want and len(want) > 12
    assert (90, 0) in rows(found.select("doc_id", "item_id"))
    assert rows(dec.contaminated(docs(spark, texts), test, broadcast_seeds=0)) == rows(found)


def test_filter_and_nothing(spark):
    texts, items = made()
    test = spark.createDataFrame(items, "item_id long, text string")
    given = docs(spark, [(1000 + k, t) for k, (_, t) in enumerate(texts)])  # an id a row
    leaks = {r[0] for r in dec.contaminated(given, test).select("doc_id").collect()}
    for seeds in (dec.BROADCAST_SEEDS, 0):
        kept = dec.clean(given, test, broadcast_seeds=seeds)
        assert kept.columns == given.columns
        left = [(r["doc_id"], r["text"]) for r in given.collect() if r["doc_id"] not in leaks]
        assert len(leaks) > 12 and rows(kept.select("doc_id", "text")) == sorted(left, key=lambda r: tuple((x is not None, x) for x in r))
    assert rows(dec.contaminated(docs(spark, []), test)) == [] and rows(dec.contaminated(given, test.where("false"))) == []
    assert rows(dec.contaminated(given, test.where("false"), broadcast_seeds=-1)) == []
    assert dec.clean(given, test.where("false")).count() == given.count() and rows(dec.clean(docs(spark, []), test)) == []


def test_ties_repeated_rows_and_clashing_names(spark):
    item = " ".join(f"q{k}" for k in range(30))
    twice = f"{item} and between them {item}"
    part = " ".join(f"q{k}" for k in range(20)) + " and others"
    given = docs(spark, [(1, twice), (1, part), (1, "nothing of it"), (2, part), (2, part), (3, "nothing")])
    test = spark.createDataFrame([(5, item), (5, "an item of another test set under the same number, long enough for a seed of its own"), (6, item)], "item_id long, text string")
    want = [(1, i, 0, 0, 30, 30, 30) for i in (5, 6)] + [(2, i, 0, 0, 20, 20, 30) for i in (5, 6)]  # the first of equal ones
    for seeds in (dec.BROADCAST_SEEDS, 0):
        assert rows(dec.contaminated(given, test, broadcast_seeds=seeds)) == want
        names = given.withColumnsRenamed({"key": "__leak", "a": "row", "b": "t1", "start": "seed"})
        kept = dec.clean(names, test, broadcast_seeds=seeds)
        assert kept.columns == names.columns and rows(kept.select("doc_id", "text")) == [(1, "nothing of it"), (3, "nothing")]
        other = docs(spark, [(4, "here an item of another test set under the same number, long enough for a seed of its own")])
        assert [r["item_id"] for r in dec.contaminated(other, test, broadcast_seeds=seeds).collect()] == [5]

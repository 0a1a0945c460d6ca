import os

import numpy as np
import pytest

from tessera.llm import quality
from tests.conftest import DATA
from tests.llm.tools import ODD, docs, rows


def test_posteriors_find_the_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    way = rng.integers(0, quality.LABELLERS, len(good))  # in which a bad document is bad
    votes = np.zeros(len(good), np.int64)
    for k in range(quality.LABELLERS):
        draw, seen = rng.random(len(good)), ~good & ((way == k) | (way == (k + 1) % quality.LABELLERS))
        votes += np.where(seen & (draw < 0.9), 0, np.where(draw < 0.004, 0, np.where(draw < 0.1, 1, 2))) * 3**k
    pattern, n = np.unique(votes, return_counts=True)
    chance, accuracy = quality.posteriors(dict(zip(pattern.tolist(), n.tolist())))
    said = np.array([chance[v] for v in votes.tolist()]) > 0.5
    assert (said == good).mean() > 0.9 and accuracy.shape == (quality.LABELLERS,) and ((0 <= accuracy) & (accuracy <= 1)).all()


@pytest.mark.skipif(not os.path.exists(f"{DATA}/sf0.01"), reason="no tables")
def test_held_out_accuracy(spark):
    given = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    score = {r["doc_id"]: r["score"] for r in quality.scores(given).collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").collect()}
    right = {q: np.mean([(score[i] >= quality.THRESHOLD) == bool(q) for i, x in label.items() if x == q]) for q in (0, 1)}
    assert right[1] > 0.97 and right[0] > 0.8, right


def brute(text):
    """(digits of the votes, {bucket: value}) of one text, token by token."""
    tokens = text.split()
    n = len(tokens)
    facts = [quality._odd_token(t, t.rstrip(".,;:!?\"')")) for t in tokens]
    share = lambda flag: sum(1 for f in facts if f & flag) / n
    lower, shape = [t.lower() for t in tokens], [f & 0xFFFFFFFF for f in facts]
    again = [sum(a == b for a, b in zip(lower[d:], lower)) / n for d in (1, 2, 3)] if n else []
    cast = [1] * quality.LABELLERS
    if n >= 8:
        say = lambda x, a, b, c, d: 2 if b <= x <= c else 0 if x < a or x > d else 1
        cast = [
            say(again[0], 0, 0, 0.05, 0.2), say(share(quality._UPPER), 0, 0, 0.15, 0.5), say(share(quality._SYMBOL), 0, 0, 0.05, 0.25),
            say(len(set(lower)) / n * max(1.0, (n / 200) ** 0.5), 0.2, 0.35, 9e9, 9e9), say(share(quality._END), 0.005, 0.02, 0.5, 0.8) if n >= 30 else 1,
            say(share(quality._SHORT), 0.03, 0.1, 0.8, 0.95) if n >= 30 else 1, say(share(quality._BAR), 0, 0, 0.05, 0.2), say(share(quality._PLAIN), 0.6, 0.85, 1, 1),
            say(len(set(shape)) / np.log2(n), 0.3, 0.6, 6, 12) if n >= 20 else 1,
        ]
    count = {}
    for k in [*shape, *((b * 40503 + a * 30011 + 7) % quality.BUCKETS for a, b in zip(shape, shape[1:]))]:
        count[k] = count.get(k, 0) + 1
    value = {k: (v / n) ** 0.5 for k, v in count.items()}
    return cast, value | ({quality.BUCKETS + k: v for k, v in enumerate([*again, len(set(lower)) / n])} if n else {})


def texts_of_all_kinds():
    rng = np.random.default_rng(4)
    stock = ["word", "Word", "WORD", "a", "it's", "well-known", "end.", "what?!", "wow!!", "wow!!!!!", "12", "3.5%", "x9", "--", "\u2022", "|", "#tag", "@you", "\u65e5\u672c\u8a9e", "\u00c9cole", "\u01c5x", "__", "a_b", "...", "'", "(so)", "O"]
    made = [" ".join(rng.choice(stock, rng.integers(0, 80))) for _ in range(300)]
    return made + ["", " ", "a", "same " * 400, "x" * 100_000, "tie tie tie tie tie tie tie tie"]


def test_votes_and_scores_as_by_brute_force():
    texts = texts_of_all_kinds()
    weights = np.random.default_rng(6).standard_normal(quality.BUCKETS + 4)
    for part in (texts, texts[:1], texts[-3:], ["", ""]):
        measured = quality.Measured(quality.Tokens(most=50), part)
        want = [brute(t) for t in part]
        assert measured.votes().tolist() == [sum(v * 3**k for k, v in enumerate(cast)) for cast, _ in want]
        z = [sum(weights[k] * v for k, v in value.items()) + 0.25 if value else -50 for _, value in want]
        assert np.allclose(measured.scores(weights, 0.25), 1 / (1 + np.exp(-np.clip(z, -50, 50))), atol=1e-9)


def test_query_is_the_brute_force_score_of_the_fitted_model(spark):
    given = docs(spark, [(k, t) for k, t in enumerate(texts_of_all_kinds())])
    weights, bias, _ = quality.model(given)
    score = {r["doc_id"]: r["score"] for r in quality.scores(given).collect()}
    for k, t in enumerate(texts_of_all_kinds()):
        value = brute(t)[1]
        z = sum(weights[b] * v for b, v in value.items()) + bias if value else -50
        assert abs(score[k] - 1 / (1 + np.exp(-np.clip(z, -50, 50)))) < 1e-9


def test_sample_is_bounded_and_without_nulls_and_copies(spark):
    made = spark.range(100_000).selectExpr("id as doc_id", "case when id % 5 < 2 then null when id % 5 < 4 then 'one text of very many copies, said again and again to all of us' else concat('text number ', id, ' of its own, with words enough to vote on it.') end as text")
    seen = []
    fit = quality.fit
    quality.fit = lambda rows_, target, **o: seen.append(len(rows_)) or fit(rows_, target, **o)
    try:
        quality.model(made, trained=600)
    finally:
        quality.fit = fit
    assert 0 < seen[0] <= 700


def test_rows(spark):
    good = [(100 + k, f"This is the sentence number {k}, and it says what it means. Another one follows, with a plain word{k} in it. " * 3) for k in range(60)]
    junk = [(200 + k, "BUY NOW!!! $$$ ### " * 20 + str(k)) for k in range(20)]
    given = docs(spark, good + junk + ODD)
    found = quality.scores(given)
    assert found.count() == len(good) + len(junk) + len(ODD)
    by = {r["doc_id"]: r["score"] for r in found.collect() if r["doc_id"] is not None}
    assert all(by[i] < 0.01 for i in (5, 6, 7)) and np.mean([by[i] for i, _ in good]) > np.mean([by[i] for i, _ in junk])
    kept = quality.accepted(given)
    assert kept.columns == given.columns
    assert rows(kept.where("doc_id is not null").select("doc_id").distinct()) == sorted((i,) for i, s in by.items() if s >= quality.THRESHOLD)
    assert rows(kept.where("doc_id is null").select("doc_id")) == rows(found.where(f"doc_id is null and score >= {quality.THRESHOLD}").select("doc_id"))
    assert rows(quality.scores(docs(spark, []))) == [] and rows(quality.accepted(docs(spark, []))) == []
    nulls = docs(spark, [(k, None) for k in range(5)])
    assert rows(quality.accepted(nulls)) == []
    clash = given.withColumnsRenamed({"key": "__bad", "start": "pattern"})
    assert quality.accepted(clash).columns == clash.columns

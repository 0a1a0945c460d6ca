import numpy as np
import tiktoken

import corpus_pipeline
from tessera.llm import bpe, quality
from tests.conftest import DATA
from tests.llm import test_decontaminate, test_linededup, test_minhash, test_quality
from tests.llm.tools import ODD, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_against_brute_force(spark, tmp_path):
    """On whole documents of the small table: what each stage keeps, by the brute-force versions of the operators' tests."""
    d = f"{DATA}/sf0.001"
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns = now.columns
    stages = [stage for _, stage in corpus_pipeline.STAGES]

    weights, bias, _ = quality.model(now)
    score = lambda t: sum(weights[k] * v for k, v in test_quality.brute(t)[1].items()) + bias if t and t.split() else -50
    want = sorted(r["doc_id"] for r in now.collect() if 1 / (1 + np.exp(-score(r["text"]))) >= quality.THRESHOLD)
    kept = stages[0](spark, now, d)
    assert kept.columns == columns and sorted(r["doc_id"] for r in kept.collect()) == want and 0 < len(want) < now.count()

    want = test_linededup.brute([(r["doc_id"], r["text"], r["source"]) for r in kept.collect()], 10)
    lines = stages[1](spark, kept, d)
    assert lines.columns == columns and rows(lines.select("doc_id", "text")) == [(i, t) for i, _, t in want] and any(n for _, n, _ in want)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    given = [(r["doc_id"], r["text"]) for r in lines.collect()]
    gone = {i for i, _ in test_minhash.brute(given)}
    one = stages[2](spark, lines, d)
    left = {r["doc_id"] for r in one.collect()}
    assert one.columns == columns and left >= {i for i, _ in given} - gone and len(left & gone) <= 0.05 * len(gone) and gone

    given = [(r["doc_id"], r["text"]) for r in one.collect() if len(r["text"]) < 700]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {i for i, _, _ in test_decontaminate.brute(given, items)}
    clean = stages[3](spark, one, d)
    after = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and {i for i, _ in given} - after == leaks

    other = tiktoken.Encoding("other", pat_str=bpe.PATTERN, mergeable_ranks=bpe.vocabulary(bpe.VOCABULARY), special_tokens={})
    ids = {r["doc_id"]: r["token_ids"] for r in stages[4](spark, clean, d).collect()}
    assert ids == {r["doc_id"]: other.encode_ordinary(r["text"]) for r in clean.collect()}
    assert {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, d).collect()} == ids


def test_odd_rows_and_nothing(spark):
    d = f"{DATA}/sf0.001"
    for given in (ODD, [], [(None, None)] * 3):
        frame = spark.createDataFrame([(i, t, None, None, None) for i, t in given], SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, d).count() <= len(given)


def test_clashing_names(spark):
    d = f"{DATA}/sf0.001"
    more = ("__bad", "__gone", "__leak", "__kept", "__removed", "__lines", "__id", "row", "id", "removed", "kept", "t1", "t2", "bad", "rank", "tie", "score", "site")
    frame = spark.read.parquet(f"{d}/documents.parquet").limit(40).selectExpr("*", *[f"{k} as {name}" for k, name in enumerate(more)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, frame, d)
        assert done.columns == frame.columns and all(tuple(r)[5:] == tuple(range(len(more))) for r in done.collect())

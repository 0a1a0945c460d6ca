import numpy as np
import pytest

from tessera.llm import itq
from tests.conftest import DATA
from tests.llm.tools import rows
from tests.oracle import connection

SCHEMA = "vec_id long, embedding array<float>, a long, b long, key long, dim int, root long, class_id long, copies long"


def table(spark, given):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6, 7) for i, v in given], SCHEMA)


def brute(every, threshold=0.95):
    """(vec_id, class_id, n_links) of the rows of a matrix."""
    unit = every.astype(float) / np.linalg.norm(every, axis=1, keepdims=True).astype(float)
    like = unit @ unit.T >= threshold
    np.fill_diagonal(like, False)
    root = np.arange(len(every))
    while True:
        new = np.minimum(root, np.where(like, root[None, :], len(root)).min(1))
        if (new == root).all():
            return [(k, int(r), int(d)) for k, (r, d) in enumerate(zip(root, like.sum(1)))]
        root = new


def found(spark, every, **options):
    return rows(itq.near_classes(table(spark, [(i, v.tolist()) for i, v in enumerate(every)]), **options))


def agreement(mine, want):
    """(recall of the rows with links, rows that differ)."""
    linked = {r for r in want if r[2]}
    return len(linked & set(mine)) / len(linked), len(set(mine) - set(want)), len(linked)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((1500, 32))
    near = base[:500] + rng.standard_normal((500, 32)) * 0.22
    every = np.vstack([base, near, near[:20]]).astype(np.float32)
    recall, wrong, n = agreement(found(spark, every), brute(every))
    assert n > 300 and recall >= 0.98 and wrong <= 0.02 * n


@pytest.mark.parametrize("block", [7, itq.BLOCK])
def test_large_classes_tight_and_loose(spark, block):
    rng = np.random.default_rng(5)
    parts = [rng.standard_normal((300, 32))]
    for noise, n in ((0.05, 120), (0.2, 90), (0.26, 60)):
        parts.append(rng.standard_normal(32) + rng.standard_normal((n, 32)) * noise)
    every = np.vstack([*parts, parts[1][:30], parts[3][:5]]).astype(np.float32)
    recall, wrong, n = agreement(found(spark, every, block=block), brute(every))
    assert n > 250 and recall >= 0.99 and wrong <= 3


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    given = [(1, v), (2, v), (2, v), (3, [2 * x for x in v]), (4, None), (None, v), (5, [0.0] * 4), (6, [1.0]), (7, [1.0, None, 1.0, 1.0]), (8, [float("nan")] * 4), (9, [-x for x in v]), (10, []), (11, [1.0, float("inf"), 0.0, 0.0])]
    assert rows(itq.near_classes(table(spark, given))) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)] + [(k, k, 0) for k in range(4, 12)]
    assert rows(itq.near_classes(table(spark, []))) == [] and rows(itq.near_classes(table(spark, [(1, None)]))) == [(1, 1, 0)]


def test_tables_grow_with_the_vectors():
    small, large = itq.tables(1000, 0.95), itq.tables(100_000_000, 0.95)
    assert large[0] > small[0] and large[1] > small[1]


def test_norms_and_a_common_component(spark):
    rng = np.random.default_rng(2)
    for common in (0.5, 1.5):
        base = rng.standard_normal((1500, 32)) / 32**0.5
        base[:, 0] += common
        unit = base / np.linalg.norm(base, axis=1, keepdims=True)
        near = unit[:500] + rng.standard_normal((500, 32)) * 0.055
        every = np.vstack([unit, near, unit[:50] * 7])
        every = (every * 5.0 ** rng.uniform(-1, 1, (len(every), 1))).astype(np.float32)
        mine, want = found(spark, every), brute(every)
        assert {r[2] for r in mine[2000:]} - {0}  # parallel vectors
        recall, _, n = agreement(mine, want)
        assert n > 300 and recall >= 0.97, (common, recall)


def test_planted_neighbours_as_sql_says(spark, tmp_path):
    """The given table with near copies planted in it, by the query and by its SQL."""
    given = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(3)
    more = [(r["vec_id"] + 10_000 * (1 + k), (np.array(r["embedding"]) + rng.standard_normal(len(r["embedding"])) * 0.01).tolist()) for r in given.collect() if r["vec_id"] % 7 == 0 for k in range(1 + r["vec_id"] % 3)]
    given.unionByName(spark.createDataFrame(more, given.schema)).write.parquet(str(tmp_path / "embeddings.parquet"))
    mine = rows(itq.query(spark, str(tmp_path)).select("vec_id", "class_id", "n_links"))
    want = sorted(connection(tmp_path).sql(f"SELECT vec_id, class_id, n_links FROM ({itq.ORACLE})").fetchall())
    assert mine == want and sum(r[2] > 0 for r in mine) > 100

"""Links and components of vectors against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from mnemoframe.llm import near_vectors
from mnemoframe.llm.near_vectors import roots


def brute(x, ids, least=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= least, 1))
    n = np.bincount(np.concatenate([a, b]), minlength=len(ids))
    return n, ids[roots(a, b, len(ids))]


def vectors():
    draw = np.random.default_rng(3)
    centre = draw.standard_normal((40, 24))
    near = np.repeat(centre, 6, axis=0) + 0.08 * draw.standard_normal((240, 24))
    dense = draw.standard_normal(24) + 0.05 * draw.standard_normal((150, 24))
    return np.concatenate([draw.standard_normal((600, 24)), near, dense, np.repeat(near[:1], 30, axis=0), 3 * near[1:2]]).astype(np.float32)


@pytest.mark.parametrize("crowded", [1024, 40])
def test_links_against_all_pairs(spark, crowded):
    x = vectors()
    ids = np.arange(len(x)) * 2 + 1
    n, c = brute(x.astype(np.float64), ids)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, node int").repartition(6)
    got = sorted(near_vectors.neighbours(df, crowded=crowded).collect())
    assert [r.id for r in got] == ids.tolist() and all(r.n_links <= k for r, k in zip(got, n))
    assert sum(r.n_links for r in got) >= 0.97 * n.sum()
    assert np.mean([r.component_id == k for r, k in zip(got, c)]) >= 0.99


def test_recall_right_at_the_threshold(spark):
    draw = np.random.default_rng(5)
    a = draw.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = draw.standard_normal((400, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.902 * a + np.sqrt(1 - 0.902 ** 2) * o
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    assert sum(r.n_links for r in near_vectors.neighbours(df).collect()) >= 0.9 * 800


def test_odd_vectors_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.id or 0), r.n_links, r.component_id) for r in near_vectors.neighbours(df).collect())
    assert got == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), *[(i, 0, i) for i in range(3, 10)]]
    assert near_vectors.neighbours(df.limit(0)).count() == 0


def test_a_pair_outside_the_window_of_one_table_is_met_in_the_next():
    class Two(near_vectors.Plan):
        """Both rows share the cells of two tables, and the window of the second only."""

        def placed(self, unit):
            cells = np.broadcast_to(np.array([7, 8]), (len(unit), 2))
            return cells, np.stack([np.arange(len(unit)) * 9.0, np.zeros(len(unit))], axis=1), np.zeros((len(unit), near_vectors.COUNTED), np.float32)

    def met(cell):
        same = {k: pa.array([v, v], pa.int64()) for k, v in (("cell", cell), ("low", 0), ("high", 0), ("side", 0))}
        batch = pa.RecordBatch.from_pydict(same | {"node": pa.array([1, 2], pa.int64()), "vector": pa.array([[1.0, 0.0], [1.0, 0.1]])})
        return len(near_vectors.linked(batch, Two(0.9, 2), 0.9)[0])

    assert [met(7), met(8)] == [0, 1]

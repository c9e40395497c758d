"""Near-duplicate vectors against all pairs, odd rows included."""
import numpy as np

from tidewire.llm import near_vectors


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 8))
    x = np.concatenate([base, base[:8] + rng.normal(size=(8, 8)) * 0.1, base[:3] * 2, base[:3]])
    rows = [(i, [float(v) for v in e], i % 2) for i, e in enumerate(x)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, [1e200] * 8]
    rows += [(100 + i, e, 0) for i, e in enumerate(odd)] + [(200, rows[0][1], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = (np.arange(len(x))[:, None] - np.arange(len(x))[None, :]) % 2 == 0
    link = (unit @ unit.T >= 0.98) & same & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([min([root[i], *root[link[i]]]) for i in range(len(x))])
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(table, tile=4).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] for i in range(len(x))} == {i: (int(link[i].sum()), int(root[i])) for i in range(len(x))}
    assert all(got[i] == (0, i) for i in got if i >= 100)

"""Near vectors against brute force, lattice decoding, and recall at the threshold."""

import numpy as np
import pytest

from quarryline.llm import lattice


def test_nearest_point_beats_all_neighbours():
    x = np.random.default_rng(1).normal(size=(500, 8)) * 3
    p = lattice.nearest_point(x)
    d = ((x - p) ** 2).sum(axis=1)
    for root in lattice.ROOTS:
        assert (((x - p - root) ** 2).sum(axis=1) >= d - 1e-9).all()
    assert d.max() <= 1 + 1e-9 and len(lattice.ROOTS) == 240


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    rule = lattice.Lattice()
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    t = rng.normal(size=a.shape)
    t -= (t * a).sum(axis=1, keepdims=True) * a
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * t
    met = np.mean([bool(set(x) & set(y)) for x, y in zip(lattice.cells(a, rule), lattice.cells(b, rule))])
    close = np.bitwise_count(lattice.sketches(a, rule).view(np.uint64) ^ lattice.sketches(b, rule).view(np.uint64)).sum(axis=1) <= lattice.most_differing(rule)
    assert met >= 0.95 and close.all()


@pytest.mark.parametrize("block", [4, 1024])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [base[i % 30] * (1 + i) + rng.normal(size=16) * 0.05 * (i % 3) * (1 + i) for i in range(120)]
    rows = [list(map(float, r)) for r in rows]
    rows += [rows[5]] * 6 + [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    ids = [*range(len(rows))]
    out = lattice.near_vectors(spark.createDataFrame([(i, r, 1) for i, r in zip(ids, rows)], "vec_id long, embedding array<double>, node int").repartition(3), lattice.Lattice(block=block))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    good = [i for i in ids if rows[i] and all(c is not None and np.isfinite(c) for c in rows[i]) and any(rows[i])]
    cos = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) if len(a) == len(b) else -1
    links = {i: [j for j in good if j != i and cos(rows[i], rows[j]) >= 0.95] if i in good else [] for i in ids}
    root = {}
    for i in ids:
        if i not in root:
            seen, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            root |= {j: min(seen) for j in seen}
    assert got == {i: (len(links[i]), root[i], root[i] == i) for i in ids}


def test_empty(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0

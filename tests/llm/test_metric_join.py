import math

import numpy as np
import pytest

from oeeforge.llm import metric_join as m

from vector_tables import clustered, frame, odd_rows


def brute(rows, least=0.93):
    usable = []
    for p, (i, v, k) in enumerate(rows):
        if v is not None and k is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v):
            usable.append((p, np.array(v, np.float32).astype(np.float64), k))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (p, x, k) in enumerate(usable):
        for q, y, other in usable[a + 1 :]:
            if k == other and len(x) == len(y) and m.linked_exactly(x, y, least):
                links[p] += 1
                links[q] += 1
                parent[root(p)] = root(q)
    least_id = {}
    for p, (i, _, _) in enumerate(rows):
        if i is not None:
            least_id[root(p)] = min(i, least_id.get(root(p), i))
    out = [(i, links[p], least_id.get(root(p))) for p, (i, _, _) in enumerate(rows)]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=str)


def near_copies(seed, n, dim=64):
    """Groups about the limit of likeness, chains, copies, and rows without structure, of four labels."""
    rng = np.random.default_rng(seed)
    x = clustered(seed, n, dim, centres=max(2, n // 40), spread=0.045)
    rows = [(int(i), v.tolist(), int(rng.integers(0, 3)) if i % 3 else 9) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[0][1], rows[0][2]) for i in range(30)]
    step = np.eye(dim)
    chain = [math.cos(0.35 * a) * step[0] + math.sin(0.35 * a) * step[1] for a in range(9)]
    return rows + [(6000 - i, v.tolist(), 9) for i, v in enumerate(chain)] + odd_rows(dim) + [
        (700, [0.0] * dim, 9), (700, [0.0] * dim, 9), (701, rows[3][1], None), (None, rows[0][1], rows[0][2]), (None, step[5].tolist(), 77), (702, [1.0, 2.0], 9), (703, [2.0, 4.0], 9)]


@pytest.mark.parametrize("cell,tile", [(4096, 2048), (40, 2048), (30, 16), (100_000, 16)])
def test_links_equal_brute_force(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(m, "CELL", cell)
    monkeypatch.setattr(m, "TILE", tile)
    monkeypatch.setattr(m, "STRIP", max(8, tile // 2))
    rows = near_copies(cell + tile, 420)
    got = m.join(frame(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_structure_lets_cells_leave_out_far_nodes(spark, monkeypatch):
    monkeypatch.setattr(m, "CELL", 20)
    x = clustered(1, 600, 64, centres=30, spread=0.002)
    pivots = {(1, 64): m.far_apart(m.unit(x.astype(np.float64)), 30)}
    nodes = frame(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]).selectExpr("cast(1 as long) label_key", "64 dim", "embedding vector")
    _, _, grids = m._cells(nodes, pivots, math.sqrt(2 - 2 * m.LEAST))
    assert len(grids) == 30
    own = x.astype(np.float64)
    to = m.distances(m.unit(own), pivots[1, 64])
    radius = np.array([to[to.argmin(1) == j, j].max() for j in range(30)])
    open_ = m.reach(to, to.argmin(1), radius, m.distances(pivots[1, 64], pivots[1, 64]), math.sqrt(2 - 2 * m.LEAST))
    assert open_.sum() < 0.2 * open_.size


def test_limit_is_exact():
    x = np.array([1.0, 0.0])
    y = np.array([0.93, math.sqrt(1 - 0.93**2)])
    for factor in (1e-200, 1.0, 1e200):
        assert m.linked_exactly(x * factor, x, 0.93) and not m.linked_exactly(x, np.array([0.0, factor]), 0.93)
    assert m.linked_exactly(np.array([3.0, 4.0]), np.array([4.0, 3.0]), 0.96) and not m.linked_exactly(x, np.array([0.92999999999, y[1]]), 0.93)


def test_large_and_tiny_vectors_and_empty_tables(spark):
    rows = [(1, [1e30, 1e30], 1), (2, [1e-30, 1e-30], 1), (3, [1.0, -1.0], 1), (4, [3e38, 3e38], 1)]
    assert sorted(map(tuple, m.join(frame(spark, rows)).collect())) == brute(rows)
    assert m.join(frame(spark, rows).limit(0)).count() == 0 and m.join(frame(spark, odd_rows())).count() == 6

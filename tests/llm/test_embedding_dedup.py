import numpy as np
import pytest

from loreloom.llm import embedding_dedup as e
from tests.llm.helpers import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, entry string, links string, first string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "b", "c") for i, v, label in rows], SCHEMA)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, least=0.93):
    n = len(rows)
    links, low = np.zeros(n, int), [r[0] for r in rows]
    pairs = []
    for a in range(n):
        for b in range(n):
            if a == b or rows[a][2] is None or rows[a][2] != rows[b][2]:
                continue
            x, y = rows[a][1], rows[b][1]
            if not (usable(x) and usable(y) and len(x) == len(y)):
                continue
            x, y = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a] += 1
                pairs.append((a, b))
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            least_id = min(low[a], low[b])
            moved |= low[a] != least_id or low[b] != least_id
            low[a] = low[b] = least_id
    return sorted(((r[0], int(k), c, r[0] == c) for r, k, c in zip(rows, links, low)), key=repr)


def corpus(noise=0.02, groups=12, size=64):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(groups):
        base, label = rng.standard_normal(size), int(rng.integers(3))
        for _ in range(int(rng.integers(1, 14))):
            rows.append((len(rows), (base + noise * rng.standard_normal(size)).tolist(), label))
    rows += [(1000 + i, rng.standard_normal(size).tolist(), int(rng.integers(3))) for i in range(150)]
    rows += [(2000, rows[0][1], rows[0][2]), (2001, rows[0][1], rows[0][2]), (2001, rows[0][1], rows[0][2]),
             (2002, rows[0][1], None), (2003, rows[0][1], (rows[0][2] + 1) % 3)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * size, 1), (3003, [float("nan")] * size, 1),
             (3004, [None] + [1.0] * (size - 1), 1), (3005, [float("inf")] * size, 1), (3006, [3.0, 4.0], 1), (3007, [6.0, 8.0], 1),
             (3008, [-3.0, 4.0], 1), (3009, [0.0] * size, 1)]
    return rows


def test_links_and_components_equal_brute_force(spark):
    rows = corpus()
    got = rows_of(e.link_vectors(vectors(spark, rows).repartition(5)), "vec_id", "n_links", "component_id", "kept")
    assert got == brute(rows)


def test_tiles_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(e, "CHUNK", 3)
    rows = corpus()
    got = rows_of(e.link_vectors(vectors(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    assert got == brute(rows)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        base = rng.standard_normal(64)
        base /= np.linalg.norm(base)
        other = rng.standard_normal(64)
        other -= other @ base * base
        other /= np.linalg.norm(other)
        cosine = rng.uniform(0.931, 0.99)
        rows += [(2 * i, base.tolist(), 0), (2 * i + 1, (cosine * base + np.sqrt(1 - cosine**2) * other).tolist(), 0)]
    found = sum(r.n_links for r in e.link_vectors(vectors(spark, rows)).collect())
    expected = sum(r[1] for r in brute(rows))
    assert 0.9 * expected <= found <= expected


def test_empty_and_single(spark):
    assert e.link_vectors(vectors(spark, [])).count() == 0
    assert rows_of(e.link_vectors(vectors(spark, [(4, [1.0, 2.0], 1)])), "vec_id", "n_links", "component_id", "kept") == [(4, 0, 4, True)]


@pytest.mark.parametrize("n", [1, 5, 200])
def test_rotation_is_orthonormal(n):
    mean, projection = e.learn_rotation(np.random.default_rng(1).standard_normal((n, 16)), 16)
    assert np.allclose(projection.T @ projection, np.eye(16), atol=1e-8)

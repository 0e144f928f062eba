import numpy as np
import pytest

from veritally.llm import embed_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, id long, cells int, copies int"


def brute(rows, least=0.95):
    """n_links and component of each row, in double precision."""
    ok = [i for i, (v, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, comp = [0] * len(rows), list(range(len(rows)))
    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], np.float32).astype(np.float64) for i in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    old, new = comp[b], comp[a]
                    comp = [new if c == old else c for c in comp]
    first = {}
    for (v, _), c in zip(rows, comp, strict=True):
        first[c] = min(first.get(c, v), v)
    return sorted((v, n, first[c], v == first[c]) for (v, _), n, c in zip(rows, links, comp, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(v, None if e is None else [None if x is None else float(x) for x in e], 1, 7, 8, 9) for v, e in rows], SCHEMA)


def vectors(seed, n=160, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i % 3 == 0 or not out:
            x = rng.normal(size=dim)
        else:
            x = np.array(out[rng.integers(len(out))][1]) + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2])
        out.append((i, [float(v) for v in x.astype(np.float32)]))
    rng.shuffle(out)
    return [(int(i), list(map(float, e))) for i, e in out]


@pytest.mark.parametrize(("dim", "margin"), [(16, 36.4), (64, E.MARGIN)])
def test_equals_brute_force(spark, rows, dim, margin):
    """At twice the angle of the threshold for certain; at the default margin in the dimensions it is meant for."""
    data = vectors(1, dim=dim)
    got = rows(E.near_duplicates(frame(spark, data), margin=margin, cell=8), "vec_id", "n_links", "component_id", "kept")
    assert got == brute(data)


def test_blocks_of_a_hot_cell(spark, rows, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 7)
    data = vectors(2, 90)
    assert rows(E.near_duplicates(frame(spark, data), margin=36.4, cell=50), "vec_id", "n_links", "component_id", "kept") == brute(data)


def test_edge_cases(spark, rows):
    nan, inf = float("nan"), float("inf")
    data = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (8, [1.0, 0.0]), (7, [1.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-30, 0.0]), (12, [3e38, 1e38]), (12, [0.0, 1.0]), (13, [1e38, 3.4e37])]
    assert rows(E.near_duplicates(frame(spark, data)), "vec_id", "n_links", "component_id", "kept") == brute(data)
    assert rows(E.near_duplicates(frame(spark, [])), "vec_id") == []


def test_null_ids_link_with_nothing(spark, rows):
    data = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (7, [0.0, 1.0]), (None, None), (None, [1.0, 0.0])]
    got = rows(E.near_duplicates(frame(spark, data)), "vec_id", "n_links", "component_id", "kept")
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (7, 0, 7, True)] + [(None, 0, None, False)] * 4


@pytest.mark.parametrize("cell", [None, 25])
def test_blocks_by_bytes_and_few_products_at_once(spark, rows, monkeypatch, cell):
    """Blocks of a few vectors, with all cells visited: every pair is met once."""
    monkeypatch.setattr(E, "BLOCK_BYTES", 8 * 16 * 9)
    monkeypatch.setattr(E, "PRODUCTS", 20)
    data = vectors(5, 120)
    assert rows(E.near_duplicates(frame(spark, data), cell=cell), "vec_id", "n_links", "component_id", "kept") == brute(data)


def test_recall_at_the_threshold(spark, rows):
    """Pairs at a cosine just above the least, spread over many cells."""
    rng = np.random.default_rng(4)
    data = []
    for i in range(400):
        x, z = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        data += [(2 * i, list(x)), (2 * i + 1, list(0.951 * x + np.sqrt(1 - 0.951**2) * z))]
    got = rows(E.near_duplicates(frame(spark, data), cell=16), "vec_id", "n_links")
    assert sum(n for _, n in got) >= 0.99 * 800


def test_low_rank_vectors_at_the_production_margin(spark):
    """Pairs just above the least, in 64 dimensions but few directions, far from all centres: no link is missed."""
    for rank in (8, 12):
        rng = np.random.default_rng(rank)
        x, z = rng.normal(size=(2, 3000, rank))
        x /= np.linalg.norm(x, axis=1)[:, None]
        z -= (z * x).sum(axis=1)[:, None] * x
        z /= np.linalg.norm(z, axis=1)[:, None]
        y = (np.concatenate([x, 0.9505 * x + np.sqrt(1 - 0.9505**2) * z]) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T).astype(np.float32)
        d = y.astype(np.float64)
        d /= np.sqrt((d * d).sum(axis=1))[:, None]
        want = (d @ d.T >= 0.95).sum(axis=1) - 1
        got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(frame(spark, list(enumerate(y.tolist()))), cell=64).select("vec_id", "n_links").collect()}
        assert [got[i] for i in range(len(y))] == want.tolist()

from random import Random

import numpy as np
import pytest

from tidemark.llm import embed_dedup as e

SCHEMA = "vec_id bigint, embedding array<{}>, label int, n int, raw string"


def plain(rows, threshold=e.THRESHOLD, kind=np.float32):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None for x in v):
            x = np.array(v, kind).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                good[i] = x / np.linalg.norm(x)
    up, n = {i: i for i in good}, dict.fromkeys(good, 0)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(good)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold:
                n[i] += 1
                n[j] += 1
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (n.get(i, 0), root(i) if i in up else i) for i, *_ in rows}


def made(dims=24, seed=1, groups=40):
    rnd = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = rnd.standard_normal(dims)
        for _ in range(rnd.integers(1, 9)):
            noise = rnd.standard_normal(dims) * rnd.choice([0.0, 0.1, 0.2, 0.28, 0.33, 0.4])
            rows.append((base + noise) * rnd.choice([1.0, 0.001, 500.0]))
    rows += [rows[0]] * 5
    return [(int(i), [float(np.float32(x)) for x in v], 1, 2, "x") for i, v in zip(rnd.permutation(len(rows) * 2), rows)]


ODD = [None, [], [0.0] * 24, [None] * 24, [1.0] * 23 + [None], [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0], [3.0]]


@pytest.mark.parametrize(("kind", "tile"), [("float", 512), ("double", 8)])
def test_links(spark, monkeypatch, kind, tile):
    monkeypatch.setattr(e, "TILE", tile)
    rows = made() + [(10_000 + i, v, None, None, None) for i, v in enumerate(ODD)]
    df = spark.createDataFrame([*rows, (None, rows[0][1], None, None, None)], SCHEMA.format(kind)).repartition(3)
    got = e.vector_groups(df, tile=tile).collect()
    want = plain(rows, kind=np.float64 if kind == "double" else np.float32)
    assert {r.id: (r.n_links, r.component) for r in got if r.id is not None} == want and len(got) == len(rows) + 1
    assert all(r.kept == (r.id == r.component) for r in got if r.id is not None)
    assert [(r.n_links, r.component, r.kept) for r in got if r.id is None] == [(0, None, True)]


def test_bounds_lose_no_pair():
    rnd = np.random.default_rng(4)
    for dims in (3, 64, 2100):
        base = rnd.standard_normal(dims)
        x = np.stack([base + rnd.standard_normal(dims) * s for s in np.linspace(0, 0.5, 200)])
        x /= np.linalg.norm(x, axis=1)[:, None]
        q, s, err = e.quantised(x)
        block = {"q": q, "scale": s, "error": err}
        i, j, low, high = e.bounds(block, block, -2)
        real = (x @ x.T)[i, j]
        assert len(i) == 200 * 200 and (low <= real).all() and (real <= high).all()
        assert (high - low).max() < 0.06 or dims == 3
        i, j, _, _ = e.bounds(block, block, 0.95)
        assert set(zip(*np.nonzero(x @ x.T >= 0.95), strict=True)) <= set(zip(i, j, strict=True))
        part = e.bounds({k: v[:50] for k, v in block.items()}, {k: v[50:90] for k, v in block.items()}, -2)
        turned = {(p, q): (least, most) for p, q, least, most in zip(*e.bounds(block, block, -2), strict=True)}
        assert all(turned[q + 50, p] == (least, most) for p, q, least, most in zip(*part, strict=True))


def test_band_of_misses():
    rnd = np.random.default_rng(5)
    bits, tables = e.hash_shape(50_000, 0.95)
    planes = e.directions(64, bits, tables)
    lost = 0
    for _ in range(2000):
        x = rnd.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rnd.standard_normal(64)
        y -= (y @ x) * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y)
        same = ((x @ planes > 0) == (y @ planes > 0)).reshape(tables, bits).all(1)
        lost += not same.any()
    assert lost == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_pairs_that_the_bounds_leave_open(spark, kind):
    """Pairs so near the threshold that int8 products can't tell, among copies of one vector."""
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal(48)
    x /= np.linalg.norm(x)
    rows = []
    for off in (-5e-3, -1e-3, -1e-5, 1e-5, 1e-3, 5e-3) * 8:
        y = rnd.standard_normal(48)
        y -= (y @ x) * x
        c = 0.95 + off
        rows.append(c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y))
    rows = [(i, [float(np.float32(v)) for v in row], None, None, None) for i, row in enumerate([x, x, *rows])]
    got = e.vector_groups(spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(4), tile=8).collect()
    want = plain(rows, kind=np.float64 if kind == "double" else np.float32)
    assert {r.id: (r.n_links, r.component) for r in got} == want and want[0][0] == 25


def test_empty(spark):
    assert e.vector_groups(spark.createDataFrame([], SCHEMA.format("float"))).count() == 0
    assert [tuple(r) for r in e.vector_groups(spark.createDataFrame([(1, None, None, None, None)], SCHEMA.format("float"))).collect()] == [(1, 0, 1, True)]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in e.op2_embedding_dedup(spark, sf_dir).collect()} == plain(rows)

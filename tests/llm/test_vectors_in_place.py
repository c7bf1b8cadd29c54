"""Near-duplicate vectors without moving vectors: blocks meet where they lie, bounds refute no link, repeated vectors are named by key."""

import itertools

import numpy as np

from quorate.llm import common, embeddings

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    """(n_links, component_id) per id, ids being distinct and all vectors comparable."""
    ids = [i for i, _ in rows]
    unit = np.array([np.array(v, np.float32) for _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(links, low[None], low.max()).min(axis=1))
        if (new == low).all():
            return {i: (int(n), int(c), c == i) for i, n, c in zip(ids, links.sum(axis=1), low)}
        low = new


def told(frame):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in frame.collect()}


def groups(n, dim, seed=3):
    """Vectors of which a third lies in one dense group, a third in small ones, a third alone."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base[: n // 3] = base[0] + 0.25 * rng.normal(size=(n // 3, dim))
    base[n // 3 : 2 * n // 3] = base[np.arange(n // 3, 2 * n // 3) // 4 * 4 % n] + 0.22 * rng.normal(size=(2 * n // 3 - n // 3, dim))
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(n), base)]


def test_no_vector_is_shuffled_to_be_compared(spark, monkeypatch):
    """Blocks are read where they lie; what is shuffled for a comparison would grow with the square of the table."""
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.stage(df, name)

    monkeypatch.setattr(embeddings, "stage", kept)
    monkeypatch.setattr(embeddings, "BLOCKS", 3, raising=False)
    rows = groups(300, 20)
    assert told(embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), tile=32)) == brute(rows)
    assert "Exchange" not in plans["near"]


def test_blocks_and_tiles_lose_nothing(spark, monkeypatch):
    """Several tiles a block and several blocks, also where vectors of a cell fill many tiles."""
    monkeypatch.setattr(embeddings, "BLOCKS", 2)
    monkeypatch.setattr(embeddings, "PIECE", 7)
    rows = groups(400, 64)
    want = brute(rows)
    assert sum(n > 0 for n, *_ in want.values()) > 200 and sum(n == 0 for n, *_ in want.values()) > 100
    assert told(embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), tile=40)) == want


def test_repeated_vectors_by_key(spark, monkeypatch):
    """Vectors that come often, under one id or many, with either sign of zero, are one class; the join may be a shuffle."""
    rows = [(i, [float(i % 5 == k) + 0.0 for k in range(5)]) for i in range(60)] + [(100, [1.0, -0.0, 0.0, -0.0, 0.0]), (7, [0.0, 0.0, 1.0, 0.0, 0.0])]
    rows += [(200, [0.1, 0.1, 0.1, 0.1, 0.1]), (None, [1.0, 0.0, 0.0, 0.0, 0.0]), (201, None), (60, [1.0, float("nan"), 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    for most in (500_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got = sorted(map(tuple, embeddings.near_duplicates(frame).collect()), key=str)
        count = lambda i: 12 + (i % 5 in (0, 2)) - 1
        want = [(i, count(i), i % 5, i < 5) for i in range(60)] + [(100, 12, 0, False), (7, 12, 2, False), (200, 0, 200, True)]
        want += [(None, 0, None, True), (201, 0, 201, True), (60, 0, 60, True)]
        assert got == sorted(want, key=str)


def test_pairs_at_the_threshold():
    """The bound in single precision refutes no link, and a pair is decided alike wherever it stands."""
    rng = np.random.default_rng(8)
    a = embeddings._unit(rng.normal(size=(300, 48)))
    side = rng.normal(size=(300, 48))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * embeddings._unit(side)
    axes = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    for m in (8, 24, 48):
        heads = [embeddings._head(embeddings._unit(x) @ axes[:, :m]) for x in (a, b)]
        rows, cols, links = embeddings.close_pairs(lambda at: a[at], lambda at: b[at], *heads, 0.95)
        all_links = np.zeros((300, 300), bool)
        all_links[np.ix_(rows, cols)] = links
        one = np.array([[np.einsum("ij,ij->i", x[None], y[None])[0] >= 0.95 for y in embeddings._unit(b)] for x in embeddings._unit(a)])
        assert (all_links == one).all()
        for i, j in itertools.islice(zip(*np.nonzero(one)), 20):
            got = embeddings.close_pairs(lambda at: a[[i]][at], lambda at: b[[j]][at], heads[0][[i]], heads[1][[j]], 0.95)
            assert got is not None and got[2].all()

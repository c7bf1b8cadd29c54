"""Line dedup without moving texts: the chain of sketches, the fast refutation of pairs, the pair join's condition."""

import numpy as np
from pyspark.sql import functions as F

from quorate.llm import common, components, lines, sieve


def test_chain_is_exact(spark, monkeypatch, tmp_path):
    """Ids inside and outside are told apart without error, also where several sketches take in wrong ids."""
    monkeypatch.setattr(sieve, "LISTED", 3)
    monkeypatch.setattr(sieve, "SKETCH_BITS", 1 << 15)
    ids = spark.range(40_000).select(F.xxhash64("id").alias("id"), (F.col("id") % 4 == 0).alias("inside"))
    inside = common.stage(ids.where("inside").select("id"), "inside")
    levels = sieve.chain(inside, ids)
    rows = ids.toPandas()
    assert len(levels) > 3
    assert (sieve.is_inside(rows["id"].to_numpy(), levels) == rows["inside"].to_numpy()).all()


def test_texts_are_not_shuffled(spark, monkeypatch):
    """The documents come back from where they lie, however many lines go."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = [(i, f"the same line in all of them\n\n \nown line number {i * 7919} of this text", "s") for i in range(40)] + [(None, None, "s"), (41, "", "s")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r["doc_id"]: r for r in got.collect()}
    assert found[0]["text"] == rows[0][1] and found[0]["n_dropped"] == 0 and found[None]["text"] is None and found[41]["text"] == ""
    assert all(found[i]["n_dropped"] == 1 and found[i]["n_lines"] == 4 and found[i]["text"].startswith("\n \nown") for i in range(1, 40))


def test_near_enough_refutes_no_link():
    rng = np.random.default_rng(9)
    a, b = [], []
    for i in range(600):
        x = rng.choice(list("abcde "), rng.integers(1, 300))
        y = x.copy()
        y[rng.integers(0, len(y), i % 5)] = "#"
        a.append("".join(x))
        b.append("".join(y) if i % 6 else a[i // 2])
    near = lines.near_enough(a, b, 0.8)
    sets = [(lines.shingle_set(x), lines.shingle_set(y)) for x, y in zip(a, b)]
    link = np.array([len(s & t) >= 0.8 * len(s | t) for s, t in sets])
    assert (near | ~link).all() and link.any() and not near.all()


def test_pairs_compare_ids_first(spark):
    """A row meets itself in its bucket; what is dear must not be evaluated for that."""
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 1)], "bucket long, id long, component long")
    pairs = components._pairs(rows, "assert_true(x.id <> y.id) is null")
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (2, 3)]

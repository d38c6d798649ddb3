"""Neighbours by one-bit codes against brute force: ties, copies, odd vectors."""

import numpy as np

from minutewise.llm import rabitq


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, code string, dim int, spot int")


def slow(rows, k=10):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for own, (q, x) in enumerate(good):
        if q % 100 == 0:
            near = sorted((float(rabitq.distances(v[None], x)[0]), i) for at, (i, v) in enumerate(good) if at != own and len(v) == len(x))[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def search(spark, rows, params=rabitq.RabitqParams()):
    index = rabitq.build_index(frame(spark, rows), params)
    return sorted(tuple(r) for r in rabitq.search(index, index.where("vec_id % 100 = 0"), params).select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 48))
    rows = [(k, (centres[k % 12] + 0.4 * rng.standard_normal(48)).astype(np.float32).tolist()) for k in range(900)]
    copy = rows[3][1]
    rows += [(k, copy) for k in range(900, 1250)]  # a large group of equal vectors, ties go to small ids
    rows += [(2000, None), (2100, []), (2200, [0.0] * 48), (2300, [float("nan"), *[1.0] * 47]), (2400, [float("inf"), *[1.0] * 47]), (2500, [None, *[1.0] * 47])]
    rows += [(None, copy), (3000, [1.0, 2.0]), (3001, [1.0, 2.5])]
    assert search(spark, rows, rabitq.RabitqParams(block_bytes=80_000)) == slow(rows)
    # Without a centre the bounds are wider and the neighbours the same.
    assert search(spark, rows, rabitq.RabitqParams(block_bytes=80_000, centred_lengths=0)) == slow(rows)


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.5]), (100, [2.0, 0.0]), (100, [2.0, 0.0]), (7, [0.5, 0.5])]
    assert search(spark, rows) == slow(rows)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 0.0, 2.0]), (5, [1.0, 1.0, 2.0]), (7, [1.0, 1.0, 2.0])]
    assert search(spark, rows) == slow(rows)
    assert search(spark, [(0, [1.0, 2.0])]) == [] and search(spark, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal(64)
    turn = rabitq.rotation(64, 1)
    assert np.allclose(turn @ turn.T, np.eye(64))
    low, high = rabitq.estimate(*rabitq.encode(x, np.zeros(64), turn), q @ turn, 4.0)
    real = rabitq.distances(x, q) ** 2
    assert ((low <= real) & (real <= high)).mean() > 0.999
    assert np.median(high - low) < 2.5 * np.median(real)
